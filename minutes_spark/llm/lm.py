"""Language-model scores: the marginal probability of a text over all its segmentations.

The vocabulary is a given one. Its scores (negative merge ranks) give the pieces a first weight,
1 / (ZIPF - score); ROUNDS of expectation maximisation over all training words, by forward
and backward sums in the lattice of each word, turns the weights into the probabilities of a
unigram model. A word's probability is the sum over all its segmentations, computed in logs by
the forward recursion; a text's is the product over its words and one end. A character that is
no piece is spelled in byte pieces.

Texts are read once: bags of words are written per block of text, with the block's distinct
words beside them. Words are counted and scored once each, and what a block needs comes back to
it, so only distinct words of blocks are shuffled, never occurrences, and a word has at most
one row per block.

Cases: a null text counts as empty and has the end token alone; letters A-Z count as lower
case; without training rows counts are 0 and the first weights hold; repeated rows get equal
scores; rows with a null key are scored.
"""

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable
from .pieces import MODEL, Vocabulary

#: Bytes of text whose bags of words are handled at once.
BLOCK_BYTES = 16 << 20
ZIPF = 2.7
#: Weight of the vocabulary's own scores against the counts.
PRIOR = 1e-3
ADD = 0.1
ROUNDS = 1


def _bags(key_type):
    kinds = pa.schema(
        [
            ("block", pa.int64()), ("word", pa.binary()), ("local", pa.int32()), ("n_train", pa.int64()),
            ("key", key_type), ("train", pa.bool_()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
        ]
    )

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        words, trained, keys, flags, ids, counts, size = {}, [], [], [], [], [], 0

        def flush():
            nonlocal number
            block = part << 32 | number
            number += 1
            n, m = len(words), len(keys)
            columns = [
                pa.array([block] * (n + m), pa.int64()),
                pa.array([*words, *[None] * m], pa.binary()),
                pa.array([*range(n), *[None] * m], pa.int32()),
                pa.array([*trained, *[None] * m], pa.int64()),
                pa.concat_arrays([pa.nulls(n, key_type), pa.array(keys, key_type)]),
                pa.array([*[None] * n, *flags], pa.bool_()),
                pa.array([*[None] * n, *ids], pa.list_(pa.int32())),
                pa.array([*[None] * n, *counts], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=kinds)

        for batch in batches:
            own_keys, own_flags = batch.column("key").to_pylist(), batch.column("train").to_pylist()
            for key, train, text in zip(own_keys, own_flags, batch.column("text").cast(pa.binary())):
                data = text.as_py() or b""
                bag = Counter(data.lower().split())
                local = []
                for word, n in bag.items():
                    at = words.setdefault(word, len(words))
                    local.append(at)
                    if at == len(trained):
                        trained.append(0)
                    if train:
                        trained[at] += n
                keys.append(key)
                flags.append(bool(train))
                ids.append(np.array(local, np.int32))
                counts.append(np.fromiter(bag.values(), np.int32, len(bag)))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield flush()
                    words, trained, keys, flags, ids, counts, size = {}, [], [], [], [], [], 0
        if keys:
            yield flush()

    return run


@lru_cache(2)
def _vocabulary(path):
    return Vocabulary.load(path)


def first_weights(path=MODEL):
    """Log probabilities of the pieces from the scores of the vocabulary; byte pieces get the least weight."""
    vocabulary = _vocabulary(path)
    weights = np.zeros(len(vocabulary.raw))
    for number, raw in enumerate(vocabulary.raw):
        if raw and not (raw == b" " * len(raw) and len(raw) > 1):
            weights[number] = 1 / (ZIPF - min(0.0, vocabulary.scores[number]))
    spelled = [b for b in vocabulary.byte if b is not None]
    weights[spelled] = min(w for w in weights if w > 0)
    with np.errstate(divide="ignore"):
        return np.log(weights / weights.sum())


def arcs_of(vocabulary, text, logs):
    """(start, end, ids, log weight) of the lattice of a word, by start."""
    out, size = [], len(text)
    for at in range(size):
        node = vocabulary.trie.get(text[at])
        if node is None or None not in node:
            spelled = vocabulary.bytes_of(text[at])
            out.append((at, at + 1, spelled, float(sum(logs[b] for b in spelled))))
        end = at
        while node is not None:
            end += 1
            piece = node.get(None)
            if piece is not None:
                out.append((at, end, piece[0], logs[piece[0]]))
            if end == size:
                break
            node = node.get(text[end])
    return out


def _add(a, b):
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def forward(arcs, size):
    """Log of the summed weights of all ways to each position."""
    sums = [-math.inf] * (size + 1)
    sums[0] = 0.0
    for start, end, _, weight in arcs:
        sums[end] = _add(sums[end], sums[start] + weight)
    return sums


def _expected(path, logs):
    def run(batches):
        vocabulary, found = _vocabulary(path), np.zeros(len(logs.value))
        weights = logs.value.tolist()
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                text = " " + word.decode()
                arcs, size = arcs_of(vocabulary, text, weights), len(text)
                before, after = forward(arcs, size), [-math.inf] * (size + 1)
                after[size] = 0.0
                for start, end, _, weight in reversed(arcs):
                    after[start] = _add(after[start], weight + after[end])
                total = before[size]
                for start, end, ids, weight in arcs:
                    share = n * math.exp(before[start] + weight + after[end] - total)
                    if type(ids) is list:
                        for number in ids:
                            found[number] += share
                    else:
                        found[ids] += share
        used = np.flatnonzero(found)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(found[used])], ["piece", "n"])

    return run


def _entry_scores(path, logs):
    """Entries come sorted by word, so each word is scored once; a cut of the input repeats one word."""

    def run(batches):
        vocabulary, weights, last, log = _vocabulary(path), logs.value.tolist(), None, 0.0
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    text = " " + word.decode()
                    last, log = word, forward(arcs_of(vocabulary, text, weights), len(text))[-1]
                out.append(log)
            columns = [batch.column("block"), batch.column("local"), batch.column("c"), pa.array(out, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["of_block", "local", "c", "log"])

    return run


def _summed(total, kinds, end_count, end_log):
    floor = math.log10(total + ADD * (kinds + 1))
    end_base = math.log10(end_count + ADD) - floor

    def run(blocks, words):
        local = words.column("local").to_numpy()
        c, log = np.zeros(len(local)), np.zeros(len(local))
        c[local], log[local] = words.column("c").to_numpy(), words.column("log").to_numpy()
        base = np.log10(c + ADD) - floor
        ids, counts = (blocks.column(x).combine_chunks() for x in ("ids", "counts"))
        sizes = np.array(ids.value_lengths().to_numpy(), dtype=np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flat = ids.flatten().to_numpy()
        n = counts.flatten().to_numpy().astype(np.float64)

        def of(values):
            return np.bincount(owner, n * values, len(sizes))

        return pa.table(
            {
                "key": blocks.column("key"),
                "held_out": pa.array(~blocks.column("train").to_numpy(zero_copy_only=False).astype(bool)),
                "n_tokens": pa.array(of(np.ones(len(flat))).astype(np.int64) + 1),
                "n_known": pa.array(of((c > 0)[flat]).astype(np.int64) + int(end_count > 0)),
                "base_score": pa.array(of(base[flat]) + end_base),
                "score": pa.array((of(log[flat]) + end_log) / math.log(10)),
            }
        )

    return run


def score(docs, train, key="doc_id", text="text", model=MODEL, rounds=ROUNDS):
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train``: condition for rows to learn from; a null condition counts as false.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text")
    )
    kind = rows.schema["key"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int", "string"):
        rows, kind = rows.withColumn("key", F.col("key").cast("string")), "string"
    shape = f"block long, word binary, local int, n_train long, key {kind}, train boolean, ids array<int>, counts array<int>"
    bags = durable(rows.mapInArrow(_bags(arrow), shape), "bags")
    entries = bags.filter("word IS NOT NULL").select("block", "word", "local", "n_train")
    blocks = bags.filter("word IS NULL").select("block", "key", "train", "ids", "counts")
    # one shuffle by word; the first entry of a word stands for it where words are counted
    own = Window.partitionBy("word")
    first_entry = F.row_number().over(own.orderBy("block")) == 1
    counts = entries.select(
        "word", F.sum("n_train").over(own).alias("c"), first_entry.alias("lead"), "block", "local"
    )
    entries = durable(counts, "word-entries")
    words = entries.filter("lead AND c > 0").select("word", "c")
    counted, kinds = words.agg(F.sum("c"), F.count("*")).first()
    ends = blocks.agg(F.count_if("train")).first()[0]
    total, kinds = (counted or 0) + ends, (kinds or 0) + int(ends > 0)

    first = first_weights(model)
    share, learned = (ends / (2 * total) if total else 0.5), first
    for _ in range(rounds if counted else 0):
        logs = spark.sparkContext.broadcast(learned)
        seen = words.mapInArrow(_expected(model, logs), "piece int, n double")
        # at most one row per piece of the vocabulary
        expected = np.zeros(len(first))
        for row in seen.groupBy("piece").agg(F.sum("n").alias("n")).collect():
            expected[row["piece"]] = row["n"]
        weights = expected + PRIOR * expected.sum() * np.exp(first)
        share = ends / (weights.sum() + ends)
        with np.errstate(divide="ignore"):
            learned = np.log(weights / weights.sum())
    learned = learned + math.log(1 - share)
    logs = spark.sparkContext.broadcast(learned)
    needed = entries.mapInArrow(_entry_scores(model, logs), "of_block long, local int, c long, log double")
    out = f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    summed = _summed(total, kinds, ends, math.log(share))
    done = blocks.groupBy("block").cogroup(needed.groupBy("of_block")).applyInArrow(summed, out)
    return done.withColumnRenamed("key", key).withColumn("train_tokens", F.lit(total).cast("long"))
