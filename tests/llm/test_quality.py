"""The verdict on every document against expectation maximisation in plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from minutes_spark.llm import quality
from minutes_spark.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"


def test_verdicts_follow_from_the_votes(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text")
    names = [f"vote_{r.name}" for r in quality.RULES]
    voted = quality.features(docs).withColumns(quality.votes()).select("doc_id", "n_words", "n_repeat_words", *names)
    rows = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], tuple(r[n] for n in names)) for r in voted.collect()}
    share, rates = quality.learn(list(Counter(v for *_, v in rows.values()).items()), len(names))
    got = QUERIES["op4_quality_rules"](spark, ROOT).collect()
    assert len(got) == len(rows) == docs.count()
    for r in got:
        words, repeated, vote = rows[r["doc_id"]]
        failed = words < 50 or 100 * repeated > 50 * words
        good = quality.posterior(vote, share, rates)
        assert r["base_failed"] == failed and r["quality"] == pytest.approx(good, abs=1e-9)
        assert abs(good - 0.5) < 1e-9 or r["kept"] == (not failed and good >= 0.5)


def test_texts_are_written_only_on_demand(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y")], "doc_id long, text string, kept string")
    whole, lean = quality.judge(docs), quality.judge(docs, with_text=False)
    assert "text" in whole.columns and "text" not in lean.columns
    order = [F.col(c) for c in lean.columns]
    assert whole.select(order).orderBy("doc_id").collect() == lean.select(order).orderBy("doc_id").collect()
