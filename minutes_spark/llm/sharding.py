"""Sharding by histogram sort: shards of near equal bytes in key order.

Rows are ordered by (hash of the text, key), so equal texts stand together. Candidate
boundaries are probed: each round counts the exact bytes below every probe, in one pass over a
narrow table of keys and sizes, and narrows the interval of each boundary until it is within
tolerance. Then the rows are exchanged once. A group of equal texts is cut only where it is
larger than the tolerance. Shards are made of slices of about ``slice_bytes``, bounded the same
way, so no task gets a whole shard; a row's slot is its rank in the slice plus the rows of the
shard's slices before it.

Cases: a null text has no bytes but its row has a size; rows that are equal in text and key
stay together; an empty table gives an empty result; a column with a result's name is replaced, and
``_h``, ``_k``, ``_slice`` and ``_ahead`` are names of the operator's own. Of a text of any length only its
hash and size are sorted and counted. The driver holds a few numbers for each slice and probe, and its
work grows with their number times its logarithm.
"""

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

SHARDS = 24
ROW_BYTES = 8
#: Deviation of a boundary, as a share of a shard's mean bytes.
TOLERANCE = 0.0005
SLICE_BYTES = 16 << 20
PROBES = 8
_HALF = 1 << 63
_ALL = 1 << 64


def _keyed(docs, text, key):
    """Order columns _h and _k, and size."""
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    rank = F.col(key).cast("long") if whole else F.xxhash64(F.col(key).cast("string"))
    return docs.withColumns(
        {
            "_h": F.xxhash64(text),
            "_k": F.coalesce(rank, F.lit(-_HALF)),
            "size": (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long"),
        }
    )


def _number(h, k):
    """The pair as one whole number in the same order."""
    return (h + _HALF) * _ALL + k + _HALF


def _interval_of(bounds):
    """Column function: how many of the sorted boundaries are at or below (_h, _k)."""
    high = np.array([b // _ALL - _HALF for b in bounds], dtype=np.int64)
    low = np.array([b % _ALL - _HALF for b in bounds], dtype=np.int64)

    @F.arrow_udf("int")
    def interval(h: pa.Array, k: pa.Array) -> pa.Array:
        h, k = h.to_numpy(), k.to_numpy()
        first, last = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
        out = first.copy()
        for value in np.unique(h[first != last]):
            rows = np.flatnonzero(h == value)
            a, b = first[rows[0]], last[rows[0]]
            out[rows] = a + np.searchsorted(low[a:b], k[rows], "right")
        return pa.array(out.astype(np.int32))

    return interval(F.col("_h"), F.col("_k"))


def _histogram(keys, bounds):
    """[(bytes, rows, least key, greatest key)] of the intervals that the boundaries make."""
    pair = F.struct("_h", "_k")
    rows = (
        keys.withColumn("_i", _interval_of(bounds)).groupBy("_i")
        .agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min(pair).alias("a"), F.max(pair).alias("b"))
        .collect()
    )
    out = [(0, 0, None, None)] * (len(bounds) + 1)
    for r in rows:
        out[r["_i"]] = (r["n"], r["rows"], _number(*r["a"]), _number(*r["b"]))
    return out


def splitters(keys, parts, loose=None, tolerance=TOLERANCE, probes=PROBES):
    """``parts - 1`` boundaries at equal bytes; every ``loose``-th one within tolerance, others within a tenth."""
    (total, _, least, most), = _histogram(keys, [])
    if not total or parts < 2:
        return []
    loose = loose or 1
    # of each boundary: the interval it lies in, bytes below its ends, the best boundary so far
    state = {}
    for i in range(1, parts):
        slack = total / parts * (loose * tolerance if i % loose == 0 else 0.1)
        state[i] = {"goal": total * i / parts, "slack": slack, "a": least, "b": most + 1, "below": 0, "upto": total, "best": (total * i / parts, least)}
    open_, counted = dict(state), {least: 0, most + 1: total}
    while open_:
        asked = set()
        for s in open_.values():
            wide, share = s["b"] - s["a"], (s["goal"] - s["below"]) / max(1, s["upto"] - s["below"])
            points = {s["a"] + wide * j // (probes + 1) for j in range(1, probes + 1)} | {s["a"] + int(wide * share)}
            # whole groups of equal texts first: inside one hash only when nothing else is left
            if s["b"] // _ALL - s["a"] // _ALL > 1:
                points = {p // _ALL * _ALL for p in points} | {(s["a"] // _ALL + 1) * _ALL}
            asked |= {p for p in points if s["a"] < p < s["b"]}
        bounds = sorted(asked)
        if not bounds:
            break
        found = _histogram(keys, bounds)
        below = np.cumsum([n for n, *_ in found]).tolist()
        ends = {p: n for p, n in zip(bounds, below)}
        counted.update(ends)
        for i, s in list(open_.items()):
            # the probes inside; bytes below them grow with them, so the two around the goal count
            lo, hi = bisect_right(bounds, s["a"]), bisect_left(bounds, s["b"])
            inner, at = lo < hi, bisect_right(below, s["goal"], lo, hi)
            near = [bisect_left(below, below[at - 1], lo, at)] if at > lo else []
            near += [at] if at < hi else []
            for j in near:
                off = abs(below[j] - s["goal"])
                if off < s["best"][0]:
                    s["best"] = (off, bounds[j])
            if at > lo:
                s["a"], s["below"] = bounds[at - 1], below[at - 1]
            if at < hi:
                s["b"], s["upto"] = bounds[at], below[at]
            # no row lies between the ends and the keys of the interval
            held = found[bisect_left(bounds, s["a"]) + 1] if s["a"] in ends else found[0]
            if held[2] is not None and (s["b"] in ends or s["b"] == most + 1) and s["a"] in ends:
                s["a"], s["b"] = max(s["a"], held[2]), min(s["b"], held[3] + 1)
                counted[s["a"]], counted[s["b"]] = s["below"], s["upto"]
                for p in (s["a"], s["b"]):
                    off = abs(counted[p] - s["goal"])
                    if off < s["best"][0]:
                        s["best"] = (off, p)
            if s["best"][0] <= s["slack"] or s["b"] - s["a"] <= 1 or not inner:
                del open_[i]
    return sorted(s["best"][1] for s in state.values())


def shard(docs, shards=SHARDS, text="text", key="doc_id", tolerance=TOLERANCE, slice_bytes=SLICE_BYTES):
    """``docs`` with size, shard and slot."""
    keyed = _keyed(docs.drop("size", "shard", "slot"), text, key)
    keys = durable(keyed.select("_h", "_k", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * slice_bytes)))
    bounds = splitters(keys, shards * per_shard, per_shard, tolerance)
    counts = [rows for _, rows, *_ in _histogram(keys, bounds)]
    counts += [0] * (shards * per_shard - len(counts))
    before, rows = [], 0
    for i, n in enumerate(counts):
        rows = 0 if i % per_shard == 0 else rows
        before.append((i, rows))
        rows += n
    # two numbers for each slice of some megabytes
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "_slice int, _ahead long"))
    placed = keyed.withColumn("_slice", _interval_of(bounds) if bounds else F.lit(0)).join(offsets, "_slice")
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_h", "_k"))
    return placed.withColumns(
        {"shard": F.floor(F.col("_slice") / per_shard).cast("int"), "slot": (F.col("_ahead") + rank - 1).cast("long")}
    ).drop("_h", "_k", "_slice", "_ahead")
