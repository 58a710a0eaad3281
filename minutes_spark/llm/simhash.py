"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row in the table holds its Hamming distances to reference fingerprints: the
zero fingerprint, every single bit, and some spread ones. Two fingerprints within ``radius``
differ by at most ``radius`` in every coordinate. Going through all pairs is avoided by the
differences between a bit's coordinate and the zero's, which are equal for two fingerprints
wherever they agree: of ``bands`` groups of such differences at most ``radius`` can differ, so
the fingerprints share the differences of some choice of ``bands - radius`` groups. Rows that
share a choice are compared: first the largest coordinate difference, then the distance.

Cases: a null or wordless text has fingerprint zero; fingerprints of equal texts are one node;
rows with a null id keep a component but never name one; repeated rows stay; an empty table
gives an empty result; other columns of the input stay unless they have a result's name.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import durable

RADIUS = 3
BANDS = 6
SHINGLE = 3
#: Members of a block of a shared choice; larger groups are compared block by block.
BLOCK = 1024
_BITS = 64


def references():
    """Zero, every single bit, and 15 rows of a Hadamard matrix as spread fingerprints."""
    spread = []
    for row in (1, 2, 4, 8, 16, 32, 3, 5, 9, 17, 33, 6, 10, 18, 63):
        spread.append(sum(1 << i for i in range(_BITS) if bin(row & i).count("1") % 2))
    return np.array([0, *(1 << i for i in range(_BITS)), *spread], dtype=np.uint64)


def fingerprint_of(data, width=SHINGLE):
    """Fingerprint of a UTF-8 text: a bit is set if it is set in over half of the shingle hashes."""
    words = data.lower().split()
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    joined = b" ".join(words)
    cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in cuts], dtype="<u8")
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    found = [0 if x is None else fingerprint_of(x) for x in texts.cast(pa.binary()).to_pylist()]
    return pa.array(np.array(found, dtype=np.uint64).view(np.int64))


def fingerprints(docs, text="text"):
    """``docs`` with a long ``fingerprint``."""
    return docs.withColumn("fingerprint", _fingerprint(F.col(text)))


def distance_table(nodes):
    """Distances of ``fp`` to all references, in their order."""
    return nodes.withColumn(
        "distances",
        F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(r.view(np.int64))))).cast("byte") for r in references())),
    )


def shared_choices(table, radius=RADIUS, bands=BANDS):
    """A row for each choice of ``bands - radius`` groups: its key, from coordinate differences."""
    edges = [round(_BITS * i / bands) for i in range(bands + 1)]
    d = F.col("distances")

    def group(band):
        # d(x, bit) - d(x, 0) is -1 or 1; as a number, one binary digit per coordinate
        terms = [((1 - (d[i + 1] - d[0])) / 2).cast("long") * (1 << (i - edges[band])) for i in range(edges[band], edges[band + 1])]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total

    grouped = table.withColumns({f"_g{b}": group(b) for b in range(bands)})
    keys = [
        F.xxhash64(F.lit(n), *(F.col(f"_g{b}") for b in chosen))
        for n, chosen in enumerate(combinations(range(bands), bands - radius))
    ]
    return grouped.select("fp", F.explode(F.array(*keys)).alias("key"))


def _components(a, b, size):
    """Smallest index reachable from each of ``size`` indexes over the links a-b."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _link_blocks(radius):
    refs = references()

    def links(group, fp):
        """Rows are sorted by group; links inside each group, by growing distance in the order."""
        distances = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
        left, right = [], []
        at = np.arange(len(fp) - 1)
        lag = 1
        while len(at):
            at = at[at + lag < len(fp)]
            at = at[group[at] == group[at + lag]]
            if not len(at):
                break
            near = at[np.abs(distances[at, 0] - distances[at + lag, 0]) <= radius]
            near = near[np.abs(distances[near] - distances[near + lag]).max(1) <= radius] if len(near) else near
            near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= radius]
            left.append(near)
            right.append(near + lag)
            lag += 1
        if not left:
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        label = _components(a, b, len(fp))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return fp[moved], fp[label[moved]]

    def run(batches):
        held_group, held_fp = [], []
        columns = ("key", "low", "high")

        def flush(group, fp):
            found = links(group, fp)
            if found and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns], 1)
            held_group.append(key)
            held_fp.append(batch.column("fp").to_numpy().view(np.uint64))
            key, fp = np.concatenate(held_group), np.concatenate(held_fp)
            change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if not len(change):
                held_group, held_fp = [key], [fp]
                continue
            last = change[-1]
            number = np.zeros(len(key), np.int64)
            number[change] = 1
            yield from flush(np.cumsum(number)[:last], fp[:last])
            held_group, held_fp = [key[last:]], [fp[last:]]
        if held_fp:
            fp = np.concatenate(held_fp)
            if len(fp):
                yield from flush(np.zeros(len(fp), np.int64), fp)

    return run


def links(nodes, radius=RADIUS, bands=BANDS, block=BLOCK):
    """Pairs (a, b) of different fingerprints that connect exactly what links within ``radius`` connect.

    A group of rows that share a choice is split into blocks by hash, and pairs of blocks are
    compared; each comparison gives the links of a forest, never all its pairs.
    """
    keyed = durable(shared_choices(distance_table(nodes.select("fp")), radius, bands), "choices")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = durable(sizes, "choice-sizes")
    split = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = split.select("key", "fp", own.alias("own"), other.alias("other")).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"
    )
    ordered = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
    return ordered.mapInArrow(_link_blocks(radius), "a long, b long")


def _checksum(edges):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges):
    """(fp, root): the smallest member of each linked fingerprint's component, roots left out.

    Rounds of large-star and small-star on pairs (a > b), each written to the shared folder,
    until nothing changes.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = durable(edges, "links")
    before = _checksum(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours move to the smallest
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.filter("a != b").distinct(), "large-star")
        # small star: smaller neighbours and the row itself move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        edges = durable(small.filter("a != b").distinct(), "small-star")
        after = _checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def _labelled(docs, text, key, radius, bands, block):
    """(key, text_hash, fingerprint, root, component_id) of every row."""
    rows = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    marked = durable(fingerprints(rows, "_text").drop("_text"), "fingerprints")
    nodes = durable(
        marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("low")), "fingerprint-nodes"
    )
    stars = components(links(nodes, radius, bands, block))
    rooted = durable(
        nodes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted"
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = durable(
        rooted.join(lows, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id"), "components"
    )
    return marked.join(named, "fingerprint")


def near_duplicates(docs, text="text", key="doc_id", radius=RADIUS, bands=BANDS, block=BLOCK):
    """(key, fingerprint, component_id) of every row; the component's smallest key names it."""
    return _labelled(docs, text, key, radius, bands, block).select(key, "fingerprint", "component_id")


def deduplicated(docs, text="text", key="doc_id", radius=RADIUS, bands=BANDS, block=BLOCK):
    """One row of each component: one of those with its smallest key. Rows without a key all stay.

    A key that stands in several components with different texts keeps a row in each of them
    that it names; the hash of the text tells those rows apart.
    """
    found = _labelled(docs.filter(F.col(key).isNotNull()), text, key, radius, bands, block)
    firsts = found.filter(F.col(key) == F.col("component_id")).groupBy(key, "root").agg(F.min("text_hash").alias("_text_hash"))
    several = F.count("*").over(Window.partitionBy(key)) > 1
    kept = firsts.select(key, F.when(several, F.col("_text_hash")).alias("_text_hash"))
    named = docs.join(durable(kept, "kept"), key)
    own = F.col("_text_hash").isNull() | (F.col("_text_hash") == F.xxhash64(text))
    chosen = named.filter(own).dropDuplicates([key, "_text_hash"]).select(*docs.columns)
    return chosen.unionByName(docs.filter(F.col(key).isNull()))
