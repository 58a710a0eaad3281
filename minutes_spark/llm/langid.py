"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ``order``. A byte costs log2((n + d) / c)
bits where its context was followed by it c times, n times in all and by d different bytes;
else the context's escape, log2((n + d) / d), and the cost in the next shorter context; behind
order 0 every byte costs 8 bits. Statistics are frozen after fitting, so costs are tables: the
trees of all languages are merged and each node holds one cost per language.

Cases: a null text or one without a letter is ``und`` with score 0, and so is every text if
nothing was learned; ties go to the first language in code-point order; repeated rows get equal
results; columns of the input stay, except that a column of a result's name is replaced.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Index, chunks_of, utf8

UNDETERMINED = "und"
#: Bytes of training text per language; blocks of text are drawn by the hash of key, text and block
#: number up to about so much, each copy of a text on its own, so that no large group of copies is
#: drawn whole. A language with no more than that is taken whole.
SAMPLE_BYTES = 4 << 20
#: Characters of a block at most; a sample is made of so many blocks at least, if their characters are bytes.
BLOCK, BLOCKS = 1 << 14, 16
_DRAWS = 1 << 40
#: Bytes of context in front of a byte.
ORDER = 3
_PAD = 0x0A
#: Costs (bytes times languages) that are held at once.
_CELLS = 1_000_000
RESULT = "lang_pred string, score double, bits_per_byte double"


def _laid_out(offsets, data, chunk, order):
    """Bytes of a chunk's pieces, each behind ``order`` bytes of context, and where they stand; then a pad."""
    parts, spans, at = [], [], 0
    pad = np.full(order, _PAD, np.uint8)
    for index, start, end in chunk:
        low = offsets[index]
        before = data[low + max(0, start - order) : low + start]
        parts += [pad[len(before) :], before, data[low + start : low + end]]
        spans.append((index, at + order, at + order + end - start))
        at += order + end - start
    return np.concatenate([*parts, pad[:1]]), spans


def _grams(laid, order):
    grams = laid.astype(np.uint64)
    out = grams.copy()
    for back in range(1, order + 1):
        out[back:] |= grams[:-back] << np.uint64(8 * back)
    return out


def _count_grams(order):
    def run(batches):
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            offsets, data = utf8(batch.column("text"))
            for chunk in chunks_of(np.diff(offsets), 1 << 20):
                laid, spans = _laid_out(offsets, data, chunk, order)
                grams, own = _grams(laid, order), {}
                for index, start, end in spans:
                    own.setdefault(languages[index], []).append(grams[start:end])
                for language, found in own.items():
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"],
                    )

    return run


@dataclass
class LanguageModel:
    """Costs per node and language. ``index[k]``: nodes of k+1 bytes; ``cost``, ``escape`` by length."""

    languages: list
    order: int
    index: list
    cost: list
    escape: list

    @classmethod
    def build(cls, languages, order, grams, owners, counts):
        """From the counts of (order + 1)-byte strings per language, oldest byte highest."""
        width = len(languages)
        nodes, tables = [None] * (order + 2), [None] * (order + 2)
        top = np.unique(grams)
        for length in range(order + 1, 0, -1):
            if length == order + 1:
                nodes[length], own, size = top, grams, 8 * length
            else:
                mask = np.uint64((1 << (8 * length)) - 1)
                longer = nodes[length + 1]
                nodes[length] = np.unique(np.concatenate([longer >> np.uint64(8), longer & mask]))
                own = grams & mask
            tables[length] = np.zeros((len(nodes[length]), width))
            np.add.at(tables[length], (np.searchsorted(nodes[length], own), owners), counts)
        cost, escape, index = [np.full((1, width), 8.0)], [], []
        for length in range(1, order + 2):
            here, seen = nodes[length], tables[length]
            if length == 1:
                context, contexts = np.zeros(len(here), np.int64), 1
            else:
                context = np.searchsorted(nodes[length - 1], here >> np.uint64(8)) + 1
                contexts = len(nodes[length - 1]) + 1
            total, kinds = np.zeros((contexts, width)), np.zeros((contexts, width))
            np.add.at(total, context, seen)
            np.add.at(kinds, context, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                bits = np.log2((total + kinds)[context] / seen)
            if length == 1:
                shorter = np.repeat(cost[0], len(here), 0)
            else:
                mask = np.uint64((1 << (8 * (length - 1))) - 1)
                shorter = cost[-1][np.searchsorted(nodes[length - 1], here & mask) + 1]
            bits = np.where(seen > 0, bits, leave[context] + shorter)
            escape.append(leave.astype(np.float32))
            cost.append(np.vstack([np.zeros((1, width)), bits]).astype(np.float32))
            keys = here if length == 1 else context.astype(np.uint64) << np.uint64(8) | here & np.uint64(255)
            index.append(Index(keys))
        return cls(languages, order, index, cost, escape)

    def bits(self, laid):
        """Cost of every byte in every language; the first ``order`` bytes have no context."""
        grams = [None]
        wide = laid.astype(np.uint64)
        for length in range(1, self.order + 2):
            if length == 1:
                lookup = self.index[0].find(np.arange(256, dtype=np.uint64))
                grams.append(lookup[laid])
                continue
            keys = wide.copy()
            keys[1:] |= grams[-1][:-1].astype(np.uint64) << np.uint64(8)
            found = self.index[length - 1].find(keys)
            found[0] = 0
            grams.append(found)
        out = self.cost[-1][grams[-1]]
        left = np.flatnonzero(grams[-1] == 0)
        left = left[left >= self.order]
        for length in range(self.order + 1, 0, -1):
            if not len(left):
                break
            context = grams[length - 1][left - 1] if length > 1 else np.zeros(len(left), np.int64)
            out[left] += self.escape[length - 1][context]
            if length == 1:
                out[left] += self.cost[0][0]
                break
            shorter = grams[length - 1][left]
            out[left] += self.cost[length - 1][shorter]
            left = left[shorter == 0]
        return out

    def totals(self, array):
        """Code length of each text in each language, and its bytes."""
        offsets, data = utf8(array)
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), len(self.languages)))
        size = max(4096, _CELLS // max(1, len(self.languages)))
        for chunk in chunks_of(lengths, size):
            laid, spans = _laid_out(offsets, data, chunk, self.order)
            index, start, end = (np.array(x) for x in zip(*spans))
            edges = np.stack([start, end], 1).ravel()
            sums = np.add.reduceat(self.bits(laid), edges, axis=0, dtype=np.float64)[::2]
            np.add.at(out, index, sums)
        return out, lengths


def training_sample(docs, text="text", lang="lang", key="doc_id", sample_bytes=SAMPLE_BYTES):
    """The languages in ``lang``, and rows (text, lang) with about ``sample_bytes`` of text of each."""
    block = max(1, min(BLOCK, sample_bytes // BLOCKS))
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    rows = rows.dropna(subset=["text", "lang"]).filter(F.col("text") != "")
    # a number below _DRAWS for each block of a text
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / block).cast("int"))
    rows = rows.withColumn("hash", F.xxhash64("key", "text", F.lit("sample")))
    draws = F.transform(numbers, lambda i: F.pmod(F.xxhash64("hash", i), F.lit(_DRAWS)))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min(F.array_min(draws)).alias("least"))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in sizes.collect()}
    languages = sorted(sizes)
    if not languages:
        return [], rows.select("text", "lang")
    # the block with the smallest number is drawn in any case
    limits = {k: max(_DRAWS * sample_bytes // n, least + 1) for k, (n, least) in sizes.items()}
    pairs = (x for k in languages for x in (F.lit(k), F.lit(min(limits[k], _DRAWS)).cast("long")))
    rows = rows.withColumn("limit", F.element_at(F.create_map(*pairs), F.col("lang")))
    drawn = F.filter(F.transform(draws, lambda n, i: F.when(n < F.col("limit"), i)), lambda i: i.isNotNull())
    parts = F.transform(drawn, lambda i: F.substring(F.col("text"), i * block + 1, F.lit(block)))
    parts = F.when(F.col("limit") == _DRAWS, F.array("text")).otherwise(parts)
    return languages, rows.select(F.explode(parts).alias("text"), "lang")


def fit(docs, text="text", lang="lang", key="doc_id", order=ORDER, sample_bytes=SAMPLE_BYTES):
    """Context trees of the languages in ``lang``, from about ``sample_bytes`` of text of each."""
    languages, drawn = training_sample(docs, text, lang, key, sample_bytes)
    if not languages:
        return LanguageModel([], order, [], [], [])
    counts = (
        drawn.mapInArrow(_count_grams(order), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    at = {k: i for i, k in enumerate(languages)}
    owners = np.array([at[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    grams = counts.column("gram").to_numpy().astype(np.uint64)
    if not len(grams):
        return LanguageModel([], order, [], [], [])
    return LanguageModel.build(languages, order, grams, owners, counts.column("n").to_numpy())


def predict(docs, model, text="text"):
    """``docs`` with lang_pred, score (posterior of the language at equal priors) and bits_per_byte."""
    if not model.languages:
        return docs.withColumns(
            {"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")}
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def guess(texts: pa.Array) -> pa.Array:
        held = shared.value
        totals, lengths = held.totals(texts)
        best = totals.argmin(1)
        least = totals[np.arange(len(totals)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - totals, -1000)).sum(1)
        names = pa.array(held.languages).take(pa.array(best))
        rate = least / np.maximum(lengths, 1)
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(rate)], ["lang_pred", "score", "bits_per_byte"])

    known = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    asked = docs.withColumn("_guess", guess(F.col(text)))
    return asked.withColumns(
        {
            "lang_pred": F.when(known, F.col("_guess.lang_pred")).otherwise(UNDETERMINED),
            "score": F.when(known, F.col("_guess.score")).otherwise(0.0),
            "bits_per_byte": F.when(known, F.col("_guess.bits_per_byte")),
        }
    ).drop("_guess")


def recognised(predicted):
    """Rows whose language is known: some language's model needs fewer than 8 bits for a byte."""
    return predicted.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") < 8))
