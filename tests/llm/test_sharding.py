"""Splitters and slots against plain sorting."""

import random
import time
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import functions as F

from minutes_spark.llm import sharding


def test_slots_follow_the_plain_order_and_equal_texts_share_a_shard(spark):
    draw = random.Random(3)
    texts = [None, ""] + ["".join(draw.choices("abc xyz", k=draw.randrange(1, 400))) for _ in range(60)]
    rows = [(n, draw.choice(texts)) for n in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"shards": 5, "tolerance": 0.2}, {"shards": 3, "tolerance": 0.2, "slice_bytes": 8_000}):
        placed = sharding.shard(docs, **options).withColumn("hash", F.xxhash64("text")).collect()
        assert len(placed) == len(rows) and set(placed[0].asDict()) == {"doc_id", "text", "size", "shard", "slot", "hash"}
        plain = sorted(placed, key=lambda r: (r.hash, r.doc_id))
        by_shard = sorted(placed, key=lambda r: (r.shard, r.slot))
        assert [r.doc_id for r in by_shard] == [r.doc_id for r in plain]
        shards = {}
        for r in placed:
            shards.setdefault(r.text, set()).add(r.shard)
        assert all(len(found) == 1 for found in shards.values())


def test_the_driver_handles_many_boundaries(monkeypatch):
    draw = random.Random(4)
    keys = sorted({draw.getrandbits(128) for _ in range(200_000)})
    sums = [0, *accumulate(draw.randrange(8, 400) for _ in keys)]

    def histogram(_, bounds):
        cuts = [0, *(bisect_left(keys, b) for b in bounds), len(keys)]
        return [
            (sums[b] - sums[a], b - a, keys[a] if b > a else None, keys[b - 1] if b > a else None)
            for a, b in zip(cuts, cuts[1:])
        ]

    counting = 0.0

    def timed(*args):
        nonlocal counting
        begun = time.perf_counter()
        found = histogram(*args)
        counting += time.perf_counter() - begun
        return found

    monkeypatch.setattr(sharding, "_histogram", timed)
    begun = time.perf_counter()
    bounds = sharding.splitters(None, 20_000, 20)
    assert time.perf_counter() - begun - counting < 10
    assert len(bounds) == 19_999
    for at, b in enumerate(bounds, 1):
        off = abs(sums[bisect_left(keys, b)] - sums[-1] * at / 20_000)
        assert off <= max(400, sums[-1] / 20_000 * 0.1)
