import hashlib
import json
import random
import shutil
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from minutes_spark import schemas
from minutes_spark.operators import links, state as H, words as W
from minutes_spark.operators.scan import numbered, running
from minutes_spark.plans import jobs
from minutes_spark.sources import tables
from minutes_spark.streaming.incremental import parse_new_pages, parse_whole_documents

BASE = "https://city.example"


def found(spark, html, **options):
    pages = spark.createDataFrame([("p", html)], "page_id string, html string")
    return [
        (r.url, r.title, r.section_kind)
        for r in links.extract_links(pages, BASE, "media/files", **options).orderBy("pos").collect()
    ]


def test_links(spark):
    html = """<a href="/media/files/0.pdf">before</a><main><h2>令和6年 <b>定例会</b></h2>
        <a href="/media/files/a/1.pdf"> 第1回 </a><h1>臨時会</h1><!-- <h3>臨時会</h3> -->
        <a href="media/files/2.PDF"></a><h3>委員会</h3><p>
        <a href="https://city.example/media/files/%E8%AD%B0.pdf"><br></a><h4>その他 <a href="/media/files/3.pdf">x</a></h4>
        <a href="/files/4.pdf">no</a><a href="/media/files/5.txt">no</a><a>no</a><script>"<h2>定例会</h2>"</script>
        <a href="/media/files/6.pdf?x">no</a></main>"""
    assert found(spark, html) == [
        (BASE + "/media/files/0.pdf", "before", "other"),
        (BASE + "/media/files/a/1.pdf", "第1回", "regular"),
        (BASE + "/media/files/2.PDF", "2", "regular"),
        (BASE + "/media/files/%E8%AD%B0.pdf", "議", "committee"),
        (BASE + "/media/files/3.pdf", "x", "other"),
    ]


def test_unclosed_tags_take_linear_time():
    start = time.perf_counter()
    anchors = links.page_anchors("<p>text " * 40_000 + "</b>" * 40_000 + '<h2>x</h2><a href="/1">y</a>', ("h2",))
    assert anchors == [(0, "/1", "y", "x")] and time.perf_counter() - start < 5


def test_files(spark, tmp_path):
    (tmp_path / "r6-first.pdf").write_bytes(b"hello-world")
    (tmp_path / "b.PDF").write_bytes(bytes([1, 2, 3, 4, 5]))
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.name: r for r in tables.scan_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"r6-first.pdf", "b.PDF"}
    assert got["r6-first.pdf"].sha256 == hashlib.sha256(b"hello-world").hexdigest()
    assert (got["b.PDF"].bytes, got["b.PDF"].url, got["r6-first.pdf"].title) == (5, "local://b.PDF", "r6 first")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "name string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("b", "9")], "name string, sha256 string")
    assert {r.name: r.state for r in tables.content_diff(new, old).collect()} == {"a": "same", "b": "changed", "c": "new"}
    assert [tuple(r) for r in tables.shared_content(new).collect()] == [("1", 2, "a")]


def test_files_beyond_one_value_are_hashed_as_streams(spark, tmp_path):
    size = (1 << 31) + 5
    with (tmp_path / "議 a%.pdf").open("wb") as out:
        out.truncate(size)
    (tmp_path / "b.pdf").write_bytes(b"hello-world")
    (tmp_path / "empty.pdf").touch()
    want, zeros = hashlib.sha256(), bytes(1 << 24)
    for at in range(0, size, len(zeros)):
        want.update(zeros[: size - at])
    got = {r.name: (r.sha256, r.bytes) for r in tables.scan_documents(spark, str(tmp_path)).collect()}
    assert got == {
        "議 a%.pdf": (want.hexdigest(), size), "b.pdf": (hashlib.sha256(b"hello-world").hexdigest(), 11)}
    short = {r.name: (r.sha256, r.bytes) for r in tables.scan_documents(spark, str(tmp_path), longest=5).collect()}
    assert short == got


def test_reports_from_kept_counts_read_no_speeches(spark):
    from minutes_spark.plans.catalog import QUERIES

    for name in ("dashboard_from_kept_counts", "speaker_ranking_from_kept_counts"):
        read = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert any("/speech_counts/" in file for file in read)
        assert not any("/speeches/" in file or "lineitem" in file for file in read)


def test_replace_partitions_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "words")
    schema = "word string, municipality_id string"
    spark.createDataFrame([("a", "m1"), ("b", "m2")], schema).write.partitionBy("municipality_id").parquet(path)
    new = spark.createDataFrame([("c", "m1"), ("d", "m1")], schema)
    for _ in range(2):
        tables.replace_partitions(new, path, ["municipality_id"])
        assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("c", "m1"), ("d", "m1"), ("b", "m2")}


def test_running_blocks(spark):
    rows = [(k, n, 1 if n % 5 == 0 else 0, f"v{n}" if n % 7 == 0 else None) for k in "ab" for n in range(40)]
    df = spark.createDataFrame(rows, "k string, n int, one int, v string")

    def run(block):
        out = running(df, ["k"], ["n"], block, sums={"s": "one"}, lasts={"last": "v"})
        return [(r.k, r.n, r.s, r["last"]) for r in out.orderBy("k", "n").collect()]

    expected = [(k, n, n // 5 + 1, f"v{n - n % 7}") for k in "ab" for n in range(40)]
    assert run(F.lit(0)) == run(F.floor(F.col("n") / 6)) == run(F.col("n")) == expected
    out = numbered(df.filter("one = 1"), ["k"], ["n"], F.floor(F.col("n") / 11))
    assert sorted(r.sequence for r in out.collect()) == sorted(list(range(8)) * 2)


def test_state(spark):
    old = spark.createDataFrame([("a", "old", 1)], "k string, v string, created int")
    new = spark.createDataFrame([("a", "x", 2), ("b", "y", 3), ("b", "z", 4)], "k string, v string, created int")
    assert {tuple(r) for r in H.insert_if_absent(old, new, ["k"], ["created"]).collect()} == {("a", "old", 1, False), ("b", "y", 3, True)}
    assert {tuple(r) for r in H.upsert_latest(old, new, ["k"], ["created"], keep=["created"]).collect()} == {("a", "x", 1), ("b", "z", 4)}
    assert {tuple(r) for r in H.replace_rows(old, new, ["k"]).collect()} == {("a", "x", 2), ("b", "y", 3), ("b", "z", 4)}
    docs = spark.createDataFrame([("1", "discovered"), ("2", "downloaded"), ("3", "parsed")], "document_id string, status string")
    done = spark.createDataFrame([("1", True, False), ("2", True, True)], "document_id string, fetched boolean, stored boolean")
    assert {tuple(r) for r in H.advance_status(docs, done).collect()} == {("1", "downloaded"), ("2", "parsed"), ("3", "parsed")}
    assert [r.document_id for r in H.to_fetch(docs).collect()] == ["1"]
    assert {r.status for r in H.reset_status(docs).collect()} == {"discovered", "downloaded"}


def test_runs(spark):
    rows = [("r1", "done", "u1", None), ("r2", "done", "u2", None), ("r2", "failed", "u3", "e"), ("r3", "failed", "u4", "f"), ("r3", "skipped", "u5", None)]
    out = spark.createDataFrame(rows, "run_id string, outcome string, url string, error string")
    runs, errors = H.run_records(out), H.run_errors(out)
    assert {r.run_id: r.status for r in runs.collect()} == {"r1": "success", "r2": "partial", "r3": "failed"}
    logs = {r.run_id: r.log for r in H.log_with_errors(runs, errors).collect()}
    assert logs["r2"] == '{"total":2,"done":1,"skipped":0,"failed":1,"errors":[{"url":"u3","error":"e"}]}'


def test_run_summarize(spark, tmp_path):
    now, source, target = datetime(2024, 1, 1), str(tmp_path / "v1"), str(tmp_path / "v2")
    data = {
        "documents": [{"document_id": d, "municipality_id": "m", "status": s, "created_at": now}
                      for d, s in (("a", "parsed"), ("b", "parsed"), ("c", "downloaded"), ("d", "parsed"), ("e", "parsed"))],
        "speeches": [{"document_id": d, "municipality_id": "m", "sequence": 0, "speaker_name_raw": "甲", "speech_text": d} for d in "abcd"],
        "document_summaries": [{"document_id": "d", "summary_text": "old"}],
    }
    for name, rows in data.items():
        schema = schemas.TABLES[name]
        full = [tuple(row.get(f) for f in schema.fieldNames()) for row in rows]
        tables.write_table(spark.createDataFrame(full, schema), source, name)

    def model(kind, content):
        if content.endswith("b"):
            raise ValueError("busy")
        return '{"summary": "new", "topics": [], "key_points": []}', 7

    counters = jobs.run_summarize(spark, source, target, model, "model-1").first()
    assert (counters.total, counters.done, counters.failed) == (2, 1, 1)
    stored = tables.read_table(spark, target, "document_summaries").orderBy("document_id").collect()
    assert [(r.document_id, r.summary_text, r.model_id, r.token_count) for r in stored] == [("a", "new", "model-1", 7), ("d", "old", None, None)]


def test_words(spark):
    tokens = [
        ("財政", "ザイセイ", "名詞", "一般"), ("財政", "x", "名詞", "固有名詞"), ("それ", "ソレ", "名詞", "代名詞"), ("議員", "ギイン", "名詞", "一般"),
        ("走る", "ハシル", "動詞", "自立"), ("１２", "*", "名詞", "一般"), ("水", "ミズ", "名詞", "一般"), ("予算", "*", "名詞", "サ変接続"), ("十分", "", "名詞", None),
    ]
    speeches = spark.createDataFrame([("m", "d", 0, "x")], "municipality_id string, document_id string, sequence int, speech_text string")
    counts = W.count_words(W.filter_tokens(W.tokenize(speeches, lambda text: tokens)))
    got = {r.word: (r["count"], r.reading, r.part_of_speech) for r in counts.collect()}
    assert got == {"財政": (2, "ザイセイ", "名詞/一般"), "予算": (1, None, "名詞/サ変接続"), "十分": (1, "", None)}
    cloud = W.word_cloud(spark.createDataFrame([("m", "a", 5), ("m", "b", 3), ("m", "c", 1)], "municipality_id string, word string, count long"))
    assert [(r.word, r.font_size, r.tier) for r in cloud.orderBy("rank").collect()] == [("a", 38.0, "high"), ("b", 24.0, "middle"), ("c", 10.0, "low")]


def test_word_totals_after_changes_equal_a_full_count(spark):
    draw = random.Random(5)
    schema = "municipality_id string, document_id string, sequence int, token_no int, surface string, reading string, pos string, pos_detail_1 string"

    def rows(documents):
        return [
            (draw.choice(("m", "n", None)) if d == "d0" else ("m", "n")[len(d) % 2], d, s, t,
             draw.choice("abcdefgh"), draw.choice(("*", "x", None)), "名詞", draw.choice(("一般", None)))
            for d in documents for s in range(2) for t in range(draw.randrange(4))
        ]

    def state(tokens):
        return W.document_words(spark.createDataFrame(tokens, schema))

    def content(df):
        return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)

    for _ in range(3):
        names = [f"d{n}" for n in range(12)]
        kept, removed, added = rows(names[:5]), rows(names[5:8]), rows(names[3 + 3:])
        after = state(kept).unionByName(state(added))
        totals = W.word_totals(state(kept).unionByName(state(removed)))
        got = W.merged_totals(totals, state(removed), state(added), after)
        assert content(got) == content(W.word_totals(after))
        tokens = spark.createDataFrame(kept + added, schema)
        assert content(W.counts_of_totals(got)) == content(W.count_words(tokens))


def test_extract_job_and_incremental_pages(spark, tmp_path):
    now, source, target = datetime(2024, 1, 1), str(tmp_path / "v1"), str(tmp_path / "v2")
    text = "２．出席議員\n１番　南 澤 克 彦\n○南 澤 議 員\n　はい。\n○大下議長\nいいえ。"
    data = {
        "documents": [{"document_id": d, "municipality_id": "m", "url": d, "status": s, "created_at": now}
                      for d, s in (("a", "downloaded"), ("b", "downloaded"), ("c", "parsed"))],
        "document_assets": [{"document_id": "a", "storage_path": "x"}],
        "pages": [{"document_id": d, "page": 1, "text": text} for d in "abc"],
        "speakers": [], "speaker_aliases": [],
        "speeches": [{"document_id": "a", "sequence": 9, "speech_text": "old"}, {"document_id": "c", "sequence": 0, "speech_text": "kept"}],
    }
    for name, rows in data.items():
        schema = schemas.TABLES[name]
        full = [tuple(row.get(f) for f in schema.fieldNames()) for row in rows]
        tables.write_table(spark.createDataFrame(full, schema), source, name)
    for _ in range(2):
        counters = jobs.run_extract(spark, source, target).first()
        assert (counters.total, counters.done, counters.skipped) == (2, 1, 1)
        speeches = tables.read_table(spark, target, "speeches").orderBy("document_id", "sequence").collect()
        assert [(r.document_id, r.sequence, r.speech_text, r.confidence) for r in speeches] == [
            ("a", 0, "はい。", 1.0), ("a", 1, "いいえ。", 0.3), ("c", 0, "kept", None)]
        status = {r.document_id: r.status for r in tables.read_table(spark, target, "documents", "m").collect()}
        assert status == {"a": "parsed", "b": "downloaded", "c": "parsed"}
        assert tables.read_table(spark, target, "speakers").count() == 1
        own = tables.read_table(spark, target, "speeches", "m")
        assert own.count() == 2 and "PartitionFilters: [isnotnull(municipality_id" in own._jdf.queryExecution().toString()
        assert tables.read_table(spark, target, "speaker_aliases").count() == 2
        kept = tables.read_table(spark, target, "speech_counts").collect()
        assert sorted((r.document_id, r.speaker_id is None, r.speeches) for r in kept) == [
            ("a", False, 1), ("a", True, 1), ("c", True, 1)]

    # the next run counts the documents it parses, and finds the others' counts in the snapshot
    again = str(tmp_path / "v2b")
    shutil.copytree(source, again)
    shutil.copytree(f"{target}/speech_counts", f"{again}/speech_counts")
    tables.write_table(tables.read_table(spark, target, "speeches").limit(0), again, "speeches")
    jobs.run_extract(spark, again, str(tmp_path / "v2c"))
    counts = tables.read_table(spark, str(tmp_path / "v2c"), "speech_counts")
    assert sorted((r.document_id, r.speeches) for r in counts.collect()) == [("a", 1), ("a", 1), ("c", 1)]

    # a speeches table that stays in place: the municipality of no new speech keeps its files
    place = tmp_path / "speeches"
    rows = [("a", "m", 9, "old"), ("c", "m", 0, "kept"), ("x", "other", 0, "apart"), ("y", None, 0, "nowhere")]
    old = spark.createDataFrame(rows, "document_id string, municipality_id string, sequence int, speech_text string")
    tables.write_table(old, str(tmp_path), "speeches")
    apart = sorted(place.glob("municipality_id=other/*/*.parquet"))
    for _ in range(2):
        jobs.run_extract(spark, source, str(tmp_path / "v3"), speeches_at=str(place))
        got = tables.read_table(spark, str(tmp_path), "speeches").collect()
        assert sorted((r.document_id, r.sequence, r.speech_text) for r in got) == [
            ("a", 0, "はい。"), ("a", 1, "いいえ。"), ("c", 0, "kept"), ("x", 0, "apart"), ("y", 0, "nowhere")]
    assert apart == sorted(place.glob("municipality_id=other/*/*.parquet")) and not (tmp_path / "v3" / "speeches").exists()

    seen = []
    for _ in range(2):
        query = parse_new_pages(spark, f"{source}/pages", str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
        query.awaitTermination()
    assert sum(seen) == 3


def test_documents_wait_for_their_last_page(spark, tmp_path):
    landing, seen = str(tmp_path / "pages"), []

    def arrive(*rows, **options):
        df = spark.createDataFrame(rows, "document_id string, page int, text string, page_count int")
        df.coalesce(1).write.mode("append").parquet(landing)
        got = []
        parse_whole_documents(
            spark, landing, str(tmp_path / "cp"),
            lambda df, n: got.extend((r.document_id, r.page, r.text, r.complete) for r in df.collect()), **options,
        ).awaitTermination()
        return sorted(got)

    # a document over two files, one that is whole, one without an id
    assert arrive(("a", 1, "a1", 3), ("a", 2, "a2", None), ("b", 1, "b1", 1), (None, 1, "x", 1), wait=3_600_000) == [("b", 1, "b1", True)]
    assert arrive(("c", 1, "c1", 2), wait=3_600_000) == []
    want = [("a", 1, "a1", True), ("a", 2, "new", True), ("a", 3, "a3", True)]
    assert arrive(("a", 3, "a3", 3), ("a", 2, "new", 3), wait=1) == want
    # the last page of c does not come; d, of unknown length, is handed on after the wait as well
    assert arrive(("d", 1, "d1", None), wait=1) == []
    time.sleep(1)
    assert arrive(("e", 1, "e1", 1), wait=1) == [("d", 1, "d1", False), ("e", 1, "e1", True)]
    assert arrive(("c", 2, "c2", 2), wait=1) == [("c", 1, "c1", True), ("c", 2, "c2", True)]


def store(spark, root, **data):
    for name, rows in data.items():
        schema = schemas.TABLES[name]
        full = [tuple(row.get(f) for f in schema.fieldNames()) for row in rows]
        tables.write_table(spark.createDataFrame(full, schema), root, name)


def test_import_job(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    for name, data in (("r6-new.pdf", b"new"), ("seen.pdf", b"seen"), ("open.pdf", b"open"), ("bad.pdf", b"b" * 99)):
        (files / name).write_bytes(data)
    source, target, last = (str(tmp_path / v) for v in ("v1", "v2", "v3"))
    store(
        spark, source, document_assets=[], ingestion_runs=[{"run_id": "r0", "status": "success"}],
        documents=[{"document_id": "s", "municipality_id": "m", "url": "local://seen.pdf", "status": "parsed"},
                   {"document_id": "o", "municipality_id": "m", "url": "local://open.pdf", "status": "discovered"}],
    )
    def opener(path):
        if path.endswith("bad.pdf"):
            raise OSError("broken")
        return tables.open_file(path)

    run = jobs.run_import(spark, source, target, str(files), "m", "r1", opener=opener).first()
    assert (run.total, run.done, run.skipped, run.failed, run.status) == (4, 2, 1, 1, "partial")
    assert json.loads(run.log)["errors"] == [{"url": "local://bad.pdf", "error": "OSError: broken"}]
    documents = {r.url: r for r in tables.read_table(spark, target, "documents").collect()}
    assert {u[8:]: r.status for u, r in documents.items()} == {
        "r6-new.pdf": "downloaded", "seen.pdf": "parsed", "open.pdf": "downloaded", "bad.pdf": "discovered"}
    assert documents["local://r6-new.pdf"].title == "r6 new"
    assets = {r.document_id: r.content_sha256 for r in tables.read_table(spark, target, "document_assets").collect()}
    assert assets == {documents["local://r6-new.pdf"].document_id: hashlib.sha256(b"new").hexdigest(),
                      "o": hashlib.sha256(b"open").hexdigest()}
    assert {r.run_id for r in tables.read_table(spark, target, "ingestion_runs").collect()} == {"r0", "r1"}
    # a later run reads only files that were not read or have changed since
    (files / "open.pdf").write_bytes(b"changed")
    log = tmp_path / "read"

    def noting(path):
        with log.open("a") as out:
            out.write(path.rsplit("/", 1)[-1] + "\n")
        return tables.open_file(path)

    run = jobs.run_import(spark, target, str(tmp_path / "v4"), str(files), "m", "r3", opener=noting).first()
    assert (run.total, run.done, run.skipped) == (4, 1, 3)
    assert sorted(log.read_text().split()) == ["bad.pdf", "open.pdf", "seen.pdf"]
    (tmp_path / "none").mkdir()
    run = jobs.run_import(spark, target, last, str(tmp_path / "none"), "m", "r2").first()
    assert (run.total, run.status) == (0, "success")


def test_merge_job(spark, tmp_path):
    source, target = str(tmp_path / "v1"), str(tmp_path / "v2")
    store(
        spark, source,
        speakers=[{"speaker_id": i, "municipality_id": "m", "name_ja": n, "role": "councilor"} for i, n in (("1", "東西南"), ("2", "東西南北"), ("3", "甲乙丙"))],
        speaker_aliases=[{"alias_id": "a", "municipality_id": "m", "speaker_id": "2", "alias_norm": "東西南北", "alias_type": "attendee_derived"}],
        speeches=[{"document_id": "d", "sequence": n, "speaker_id": s} for n, s in enumerate(("1", "2", "2", None, "3"))],
    )
    report = jobs.run_merge(spark, source, target).first()
    assert (report.duplicate_id, report.canonical_id, report.moved_speeches) == ("2", "1", 2)
    assert sorted(r.speaker_id for r in tables.read_table(spark, target, "speakers").collect()) == ["1", "3"]
    assert tables.read_table(spark, target, "speaker_aliases").first().speaker_id == "1"
    moved = tables.read_table(spark, target, "speeches").orderBy("sequence").collect()
    assert [r.speaker_id for r in moved] == ["1", "1", "1", None, "3"]


def test_keys_and_codes_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="repeated key"):
        store(spark, str(tmp_path / "a"), speeches=[{"document_id": "d", "sequence": 0}] * 2)
    with pytest.raises(Exception, match="documents.status: no such code: lost"):
        store(spark, str(tmp_path / "b"), documents=[{"document_id": "d", "status": "lost"}])
    store(spark, str(tmp_path / "c"), documents=[{"document_id": d} for d in "de"])


def test_words_job_goes_on_past_a_failing_text(spark, tmp_path):
    source, target = str(tmp_path / "v1"), str(tmp_path / "v2")
    store(
        spark, source, documents=[{"document_id": "d", "municipality_id": "m"}],
        speeches=[{"document_id": "d", "sequence": n, "speech_text": t} for n, t in enumerate(("財政", "bad", "財政"))],
    )

    def tokenizer(text):
        if text == "bad":
            raise ValueError("no words")
        return [(text, "ザイセイ", "名詞", "一般")]

    assert [tuple(r) for r in jobs.run_words(spark, source, target, tokenizer).collect()] == [("d", 1, "ValueError: no words")]
    assert [(r.word, r["count"]) for r in tables.read_table(spark, target, "word_frequencies").collect()] == [("財政", 2)]
    assert jobs.run_words(spark, source, str(tmp_path / "v3")).count() == 0


def test_documents_are_read_and_replaced_in_their_bucket(spark, tmp_path):
    rows = [(m, f"d{n}", f"{m}-{n}", s, f"text {s}") for m in ("m1", "m2") for n in range(40) for s in range(2)]
    df = spark.createDataFrame(rows, "municipality_id string, document_id string, speech_id string, sequence int, speech_text string")
    df = df.withColumn("document_id", F.concat("municipality_id", F.lit("/"), "document_id"))
    tables.write_table(df, str(tmp_path), "speeches")
    one = tables.read_table(spark, str(tmp_path), "speeches", "m1", "m1/d7")
    assert sorted(r.speech_text for r in one.collect()) == ["text 0", "text 1"]
    places = {r[0].rsplit("/", 1)[0] for r in one.select(F.input_file_name()).collect()}
    assert len(places) == 1
    assert tables.read_table(spark, str(tmp_path), "speeches", "m2", "m1/d7").count() == 0

    place = tmp_path / "speeches"
    before = {str(f) for f in place.rglob("*.parquet")}
    stored = tables.read_table(spark, str(tmp_path), "speeches")
    new = df.filter("document_id = 'm1/d7'").limit(1).withColumn("speech_text", F.lit("new"))
    jobs.replace_speeches(stored, new, str(place))
    after = {str(f) for f in place.rglob("*.parquet")}
    changed = {f.rsplit("/", 1)[0] for f in before ^ after}
    assert len(changed) == 1
    got = tables.read_table(spark, str(tmp_path), "speeches")
    assert got.count() == len(rows) - 1 and got.filter("speech_text = 'new'").count() == 1
    jobs.replace_speeches(got, df.limit(0), str(place))
    assert {str(f) for f in place.rglob("*.parquet")} == after
