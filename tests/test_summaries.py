import json
import math
import random

from minutes_spark.operators import summaries as G
from minutes_spark.plans.jobs import summarize

SPEECH = "document_id string, sequence int, speaker_name_raw string, speech_text string"


def packed(costs, limit):
    chunks, current, chunk = [], 0, 0
    for cost in costs:
        if current and current + cost > limit:
            current, chunk = 0, chunk + 1
        current += cost
        chunks.append(chunk)
    return chunks


def test_packing_equals_the_sequential_rule(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for doc in range(25):
        sizes = [rng.choice([0, 3, 20, 80, 250]) for _ in range(rng.randint(1, 60))]
        rows += [(f"d{doc}", n, "議長", "あ" * size) for n, size in enumerate(sizes)]
        for n, chunk in enumerate(packed([math.ceil((size + 6) / 2) for size in sizes], 60)):
            expected[f"d{doc}", n] = chunk
    speeches = spark.createDataFrame(rows, SPEECH)
    for per_block in (1000, 7, 1):
        got = G.pack_chunks(speeches, 60, per_block=per_block).collect()
        assert {(r.document_id, r.sequence): r.chunk for r in got} == expected
        assert len(got) == len(rows)


def test_packing_a_document_of_many_speeches(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 10, 60, 300]) for _ in range(100_000)]
    rows = spark.createDataFrame([("long", n, "議長", "あ" * size) for n, size in enumerate(sizes)] + [("short", 0, "a", "b")], SPEECH)
    got = G.pack_chunks(rows.repartition(4), 2000, per_block=4096).collect()
    expected = dict(enumerate(packed([math.ceil((size + 6) / 2) for size in sizes], 2000)))
    assert {r.sequence: r.chunk for r in got if r.document_id == "long"} == expected


def test_requests(spark):
    rows = [("a", 0, "議長", "開会します。"), ("a", 1, "田中議員", "質問します。"), ("b", 0, "甲", "あ" * 40), ("b", 1, "乙", "い" * 10)]
    got = {(r.document_id, r.part): (r.route, r.content) for r in G.request_table(spark.createDataFrame(rows, SPEECH), 20).collect()}
    assert got == {
        ("a", 0): ("single", "議長: 開会します。\n\n田中議員: 質問します。"),
        ("b", 0): ("chunked", "甲: " + "あ" * 40),
        ("b", 1): ("chunked", "乙: " + "い" * 10),
    }


def test_replies(spark):
    good = {"summary": "要約", "topics": ["財政"], "key_points": []}
    replies = [
        json.dumps(good), "```json\n" + json.dumps(good) + "\n```", "```\n{}\n```", "{'summary': 1}", json.dumps(good) + " x",
        "", '{"summary": "s", "topics": "t"}',
    ]
    df = G.with_parsed_reply(spark.createDataFrame(list(enumerate(replies)), "n int, reply string"))
    got = [(r.summary, r.topics, r.error is None) for r in df.orderBy("n").collect()]
    assert got == [
        ("要約", ["財政"], True), ("要約", ["財政"], True), (None, None, True), (None, None, False), (None, None, False),
        (None, None, False), ("s", None, True),
    ]


def test_merge_input(spark):
    rows = [("d", 0, 'a "q"', ["x", "y"], []), ("d", 1, "b", [], ["k\n"]), ("e", 0, "c", [], [])]
    df = spark.createDataFrame(rows, "document_id string, part int, summary string, topics array<string>, key_points array<string>")
    (only,) = G.merge_input(df).collect()
    parts = [dict(zip(("summary", "topics", "key_points"), r[2:])) for r in rows[:2]]
    assert only.content == "\n\n".join(
        f"## パート{n + 1}の要約\n" + json.dumps(p, ensure_ascii=False, indent=2) for n, p in enumerate(parts)
    )


def test_summarize(spark):
    def model(kind, content):
        if "壊" in content:
            return "oops", 1
        if "止" in content:
            raise TimeoutError("no answer")
        return '{"summary": "%s", "topics": ["t"], "key_points": []}' % kind, 10

    rows = [("a", 0, "甲", "短い"), ("b", 0, "甲", "あ" * 40), ("b", 1, "乙", "い" * 40), ("c", 0, "甲", "壊"), ("d", 0, "甲", "止")]
    got = {r.document_id: (r.summary_text, r.error, r.token_count) for r in summarize(spark.createDataFrame(rows, SPEECH), model, 25).collect()}
    assert got == {"a": ("single", None, 10), "b": ("merge", None, 30), "c": (None, "reply is not JSON", 1), "d": (None, "TimeoutError: no answer", 0)}
