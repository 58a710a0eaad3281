"""Conversation repair, exact top-k and whitening against brute force."""

import hashlib
import heapq
import random
import re

import numpy as np
import pytest
from minutes_spark.llm import repair, topk, whitening
from minutes_spark.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# --- conversation repair --------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit, repaired) over all edits, by a search in the order of cost and audit."""
    seen, faults = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        said = "".join(r[:1] for r, _ in out)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return cost, audit, list(out), faults
        if (at, said[-1:]) in done:
            continue
        done.add((at, said[-1:]))
        steps = [("I", 5, at, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            steps.append(("D", 2, at + 1, None))
            if faults[at] in ("", "truncated"):
                more = 5 if faults[at] else 0
                steps += [("K", more, at + 1, (role, text))] + [("R", 1 + more, at + 1, (r, text)) for r in ("user", "assistant")]
        for label, price, to, row in steps:
            new = out + ((row,) if row else ())
            if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in new)) and all(r for r, _ in new):
                heapq.heappush(heap, (cost + price, audit + label, to, new))
    raise AssertionError


def conversations(seed, count=60, most=14):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unknown"]
    texts = ["Hello.", "Why?", "no end", "", " \t", None, "Done! ", "é\n", "Yes.", "a?b"]
    for conv in range(count):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(roles[:3]) if rng.random() < 0.8 else rng.choice(roles)
            text = rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."
            rows.append((None if conv == 5 else conv, None if rng.random() < 0.03 else turn * rng.choice([1, 1, 1, 2]), role, text))
    return rows + rows[7:9]


def expected(rows):
    groups, told = {}, {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32])
    for r in rows:
        groups.setdefault(r[0], []).append((r[0], r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " "))
    for conv, held in groups.items():
        held.sort(key=key)
        cost, audit, out, faults = cheapest([(r[2], r[3]) for r in held])
        turns = [r[1] for r in held if r[1] is not None]
        said = [r[2][:1] for r in held]
        told[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(said, said[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest(),
        )
    return told


@pytest.mark.parametrize("most_rows", [repair.BLOCK_ROWS, 3, 1])
def test_repair_equals_search_over_all_edits(spark, most_rows):
    rows = conversations(11)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int")
    told, turns = repair.repair(df.repartition(3), most_rows=most_rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in told.collect()}
    want = expected(rows)
    assert got == want
    lines = {}
    for r in turns.orderBy("conv_id", "block").collect():
        lines.setdefault(r["conv_id"], []).extend(f"{a}:{b}" for a, b in zip(r["roles"], r["texts"]))
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == row[-1]


def test_a_conversation_much_longer_than_a_block(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"{i % 700} said." if rng.random() < 0.8 else f"{i} cut") for i in range(5000)]
    rows += [(1, None, None, "x" * 100_000 + ".")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    many = repair.repair(df, most_rows=64, most_chars=10_000)[0].collect()
    one = repair.repair(df.coalesce(1), most_rows=10_000)[0].collect()
    assert many == one and len(many) == 1
    said = [(" ", rows[-1][3])] * 3 + [(r, t) for _, _, r, t in rows[:-3]]
    solved = repair.Rows([r for r, _ in said], [t for _, t in said], [len(said)])
    assert many[0]["blank"] == 0 and many[0]["duplicate"] == int(solved.duplicate.sum())
    assert len(many[0]["audit"].replace("I", "")) == len(said)


def test_repair_of_empty_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    told, turns = repair.repair(df)
    assert told.count() == turns.count() == 0


def test_dropped_conversations_stay_in_the_query(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, "user", None) for i in range(60)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    assert len(rows) == 61
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["audit"] for r in rows} <= {"", "D", "DD"} and all(r["repaired_sha256"] == empty for r in rows)
    assert any(r["audit"] == "" and r["blank"] == 0 for r in rows)


# --- exact top-k ----------------------------------------------------------------------------


def vectors(seed, count, width, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)) * 0.3
    v = (centres[rng.integers(0, 5, count)] + rng.normal(size=(count, width)) * 0.1).astype(np.float32)
    v[:copies] = v[0]
    return [(i, x.tolist()) for i, x in enumerate(v)]


ODD = [(1000, None), (1020, []), (1040, [None, 1.0]), (1060, [NAN, 0.0]), (1080, [INF]), (1100, [2.0, -3.0]), (None, [0.5, 0.5]), (20, [9.0])]


def best(queries, rows, k):
    width = max([len(v or []) for _, v in rows], default=1)
    ok = lambda v: v is not None and all(c is not None and np.isfinite(c) for c in v)
    whole = lambda v: np.floor(np.array([*v, *[0.0] * (width - len(v))]) * 64).astype(np.int64)
    held = [(i, whole(v)) for i, v in rows if ok(v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in queries if i is not None and ok(v)}:
        scored = sorted((-int(x @ whole(v)), i is None, i or 0) for i, x in held if i != q)[:k]
        out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(scored, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [{}, {"cell_queries": 7, "cell_rows": 60}])
def test_top_k_equals_all_products(spark, cells):
    rows = vectors(5, 700, 12, copies=90) + ODD + [(41, [1.0] * 12)] * 2
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, lane string")
    got = topk.top_k(df.filter("vec_id % 20 = 0 or vec_id is null"), df, **cells)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    asked = [r for r in rows if r[0] is None or r[0] % 20 == 0]
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(asked, rows, 20)


def test_top_k_of_few_rows_and_of_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [-1.0, 0.0])], schema)
    rows = [tuple(r) for r in topk.top_k(few.filter("vec_id % 20 = 0"), few).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 20, 64 * 64 * 5), (0, 2, 3, -64 * 64), (20, 1, 0, 64 * 64 * 5), (20, 2, 3, -64 * 64)]
    assert topk.top_k(few.limit(0), few).count() == topk.top_k(few.limit(0), few.limit(0)).count() == 0
    lone = spark.createDataFrame([(0, [1.0])], schema)
    assert topk.top_k(lone, lone).count() == 0


def test_bounds_leave_out_far_candidates():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 400
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 10)
    spread = topk._spread(x[:500], 32)
    table = np.sqrt(((x[:, None] - spread[None]) ** 2).sum(2)).astype(np.float32)

    class Counted(np.ndarray):
        seen = 0

        def __getitem__(self, at):
            Counted.seen += len(at)
            return np.asarray(self)[at]

    squares = (x**2).sum(1)
    at, score = topk.search_cell(x[0], table[0], (x.view(Counted), squares), np.ascontiguousarray(table.T), (0, 1), 20)
    want = sorted((-int(s), i) for i, s in enumerate(x @ x[0]) if i)[:20]
    assert [(-int(s), int(i)) for s, i in zip(score, at)] == want
    assert Counted.seen < 2000


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(i) * 3, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.filter("vec_id = 20"), df, k=5).orderBy("rank").collect()
    q = [2**20 + 20, 60, 1]
    want = sorted(((-sum(64 * a * 64 * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != 20))[:5]
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in want]


# --- whitening ------------------------------------------------------------------------------


def whitened(rows, weights="one"):
    width = max(len(v) for _, v in rows)
    x = {i: tuple(int(np.floor(c * 64)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]) for i, v in rows}
    fit = sorted(set(x.values())) if weights == "one" else list(x.values())
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], dtype=np.float64) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in x.items():
        moved = [n * a - s for a, s in zip(v, sums)]
        z = np.array(moved, dtype=np.float64) / n @ axes / np.sqrt(np.maximum(values, 1e-300))
        out[i] = (sum(m * m for m in moved), z)
    return n, values, out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_plain_eigenvectors(spark, weights):
    rows = vectors(8, 400, 24, copies=130) + [(900, [0.25] * 5)]
    bad = [(901, None), (902, [None] * 24), (903, [NAN] * 24), (904, [1.0, -INF])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + bad], "vec_id long, embedding array<float>, x int")
    got = whitening.whiten(df, weights=weights).collect()
    n, values, want = whitened(rows, weights)
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-10
    signs = {}
    for r in got:
        deviation, z = want[r["vec_id"]]
        c = r["component"]
        assert int(r["deviation"]) == deviation
        assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        if abs(z[c - 1]) > 1e-3:
            signs.setdefault(c, set()).add(bool(r["whitened"] * z[c - 1] > 0))
        assert abs(r["whitened"]) == pytest.approx(abs(z[c - 1]), abs=1e-8)
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 16


def test_whitening_of_flat_lone_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)] + [(None, [0.0, 0.0, 1.0])], schema)
    rows = whitening.whiten(line).collect()
    assert len(rows) == 10 and {r["component"] for r in rows} == {1} and {r["n"] for r in rows} == {9}
    assert rows[0]["explained"] == pytest.approx(1.0) and rows[0]["identity_error"] < 1e-10
    for few in (line.limit(1), line.limit(0), spark.createDataFrame([(1, None), (2, [])], schema)):
        assert whitening.whiten(few).count() == 0


def test_whitening_with_sums_beyond_64_bits(spark):
    rows = [(i, [float(i) * 2.0**40, 1.0 * (i % 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df).collect()}
    want = whitened(rows)[2]
    assert got == {i: d for i, (d, _) in want.items()}


def test_whitening_query(spark):
    rows = QUERIES["op13_embedding_whitening"](spark, ROOT)
    assert dict(rows.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    held = spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()
    n, values, want = whitened([(r["vec_id"], r["embedding"]) for r in held])
    for r in rows.collect():
        assert r["n"] == n and r["deviation"] == want[r["vec_id"]][0] and r["identity_error"] < 1e-4
        assert abs(r["whitened"]) == pytest.approx(abs(want[r["vec_id"]][1][r["component"] - 1]), abs=1e-7)
