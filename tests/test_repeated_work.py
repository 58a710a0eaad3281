"""Steps that once did the same work several times, or sorted what a hash can hold."""

from pyspark.sql import functions as F

from minutes_spark.functions.names import with_speaker_match
from minutes_spark.operators import attendees as A, lines as L, resolve, speakers as S, words as W
from minutes_spark.plans import jobs, marts as M
from minutes_spark.sources import adapters as V, tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_document_without_topics_has_an_empty_list(spark):
    tables = {
        "documents": ("document_id string, municipality_id string, session_id string, title string, status string, created_at string", ("d", "m", "s", "t", "parsed", "2020")),
        "sessions": ("municipality_id string, session_id string, fiscal_year int, session_type string, session_name string", ("m", "s", 2020, "regular", "n")),
        "summaries": ("document_id string, summary_text string, topics array<string>, key_points array<string>, created_at string", ("d", "x", None, ["k"], "2020")),
        "speeches": ("document_id string, municipality_id string, session_id string, sequence int, speaker_id string, speaker_name_raw string, speech_text string, page_start int, page_end int", ("d", "m", "s", 0, None, "a", "b", 1, 1)),
        "speakers": ("speaker_id string, municipality_id string, name_ja string, role string", ("p", "m", "a", "chair")),
    }
    t = V.Minutes(spark, "", **{name: spark.createDataFrame([row], schema) for name, (schema, row) in tables.items()})
    assert [r["topics"] for r in M.document_speeches(t, "m", "d").collect()] == [[]]


def test_a_role_at_the_start_is_no_end_of_a_name(spark):
    cases = {
        "○議員田中議員はい。": None, "○議員田中市長はい": "議員田中市長", "○ 田 中 副 市 長 はい": " 田 中 副 市 長",
        "○市長議員市長": "市長議員", "○田市長議員": "田市長",
    }
    df = with_speaker_match(spark.createDataFrame(list(enumerate(cases)), "n int, line string"))
    assert [r["speaker_name_raw"] for r in df.orderBy("n").collect()] == list(cases.values())
    assert "lambda" not in _plan(df)


def test_equal_lines_are_parsed_once(spark, monkeypatch):
    parsed, parse = [], A.line_entries
    monkeypatch.setattr(A, "line_entries", lambda lines, roles: parsed.append(lines.count()) or parse(lines, roles))
    rows = [(str(d), 1, n, "市長石丸伸二", "executive", False) for d in range(3) for n in range(2)]
    lines = spark.createDataFrame(rows, "document_id string, page int, line_no int, line string, category string, seated boolean")
    got = sorted((r["document_id"], r["line_no"], r["full_name"]) for r in A.parse_lines(lines).collect())
    assert got == [(str(d), n, "石丸伸二") for d in range(3) for n in range(2)] and parsed == [1]


def test_earliest_alias_rows_are_found_by_hash(spark, monkeypatch):
    plans, write = {}, S.durable

    def durable(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(S, "durable", durable)
    rows = [("m", "a", f"2020-01-0{d}", f"d{d}", 1, n, 0, f"s{d}{n}") for d in (2, 1, 3) for n in (1, 0)]
    rows += [(None, "b", None, "d9", 1, 0, 0, "s9"), (None, "b", "2020-01-01", "d1", 1, 0, 0, "s0")]
    incoming = spark.createDataFrame(
        rows, "municipality_id string, alias_norm string, at string, document_id string, page int, line_no int, pos int, speaker_id string"
    ).withColumns({
        "created_at": F.col("at").cast("timestamp"), "part": F.lit(0), "alias_raw": F.col("alias_norm"),
        "alias_type": F.lit("attendee_derived"), "confidence": F.lit(1.0),
    })
    got = {(r["municipality_id"], r["alias_norm"]): r["speaker_id"] for r in S.merge_aliases(None, incoming).collect()}
    assert got == {("m", "a"): "s10", (None, "b"): "s9"}
    assert "SortAggregate" not in plans["alias-times"]


def test_only_open_names_are_looked_up_by_prefix(spark, monkeypatch):
    asked, match = [], resolve.match_prefix
    monkeypatch.setattr(resolve, "match_prefix", lambda names, f: asked.extend(r["name_norm"] for r in names.collect()) or match(names, f))
    people = spark.createDataFrame(
        [("d", 1, 1, 0, "石丸伸二", "石丸", "p", "m")],
        "document_id string, page int, line_no int, pos int, full_name string, family_name string, speaker_id string, municipality_id string",
    ).withColumn("created_at", F.lit("2020-01-01").cast("timestamp")).withColumn("role", F.lit("市長"))
    names = people.select("document_id", F.explode(F.array(*map(F.lit, ("石丸", "石丸伸二", "石丸さん", "田中")))).alias("name_norm"), "municipality_id", "created_at")
    history = S.alias_history(None, S.derive_aliases(people))
    got = {r["name_norm"]: r["match_strategy"] for r in resolve.resolve_names(names, people, history).collect()}
    assert got == {"石丸": "exact_family", "石丸伸二": "exact_fullname", "石丸さん": "prefix", "田中": "unresolved"}
    assert sorted(asked) == ["田中", "石丸さん"]


def test_tokens_are_looked_for_once(spark):
    speeches = spark.createDataFrame([("m", "d", 0, "ab cd"), ("m", "e", 0, ""), ("m", "f", 0, None)], "municipality_id string, document_id string, sequence int, speech_text string")
    tokens = W.tokenize(speeches)
    assert sorted((r["token_no"], r["surface"]) for r in tokens.collect()) == [(0, "ab"), (1, "cd")]
    assert _plan(tokens).count("regexp_extract_all") == 1


def test_pages_are_written_once(spark):
    first, second = (V.page_texts(spark, "/root/testdata/sf0.001") for _ in range(2))
    assert first.inputFiles() == second.inputFiles() and "page-texts" in first.inputFiles()[0]


def test_words_of_all_documents_are_counted_without_a_row_per_document(spark):
    schema = "municipality_id string, document_id long, sequence int, token_no int, surface string, reading string, pos string, pos_detail_1 string"
    ids = (-(1 << 63), -7, 0, 5, (1 << 63) - 1)
    rows = [(("m", None)[d % 2], d, s, t, "abc"[(d + s + t) % 3], ("*", None)[(d + t) % 2], "n", None) for d in ids for s in (0, (1 << 31) - 1) for t in range(4)]
    removed, kept = [r for r in rows if r[1] < -6], [r for r in rows if r[1] >= -6]

    def content(df):
        return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)

    def frame(some):
        return spark.createDataFrame(some, schema)

    counted = W.token_totals(frame(rows))
    assert content(W.word_totals(counted)) == content(W.word_totals(W.document_words(frame(rows))))
    assert counted.count() == len({(r[0], *r[4:]) for r in rows})
    # a word of no municipality whose first document went is found again
    none = W.token_totals(frame([]))
    got = W.merged_totals(W.word_totals(counted), W.token_totals(frame(removed)), none, W.token_totals(frame(kept)))
    assert content(got) == content(W.word_totals(W.document_words(frame(kept))))
    assert None in {r["municipality_id"] for r in got.collect()}


def test_delta_counts_read_texts_once(spark, monkeypatch):
    from minutes_spark.plans import catalog

    asked, tokenize = [], W.tokenize
    monkeypatch.setattr(W, "tokenize", lambda texts: asked.append(1) or tokenize(texts))
    catalog.QUERIES["word_frequencies_by_delta"](spark, "/root/testdata/sf0.001")
    assert asked == [1]


def test_replaced_rows_are_moved_once_and_without_a_join_of_texts(spark, tmp_path, monkeypatch):
    plans, write = [], jobs.write_partitions
    monkeypatch.setattr(jobs, "write_partitions", lambda df, *a: plans.append(_plan(df)) or write(df, *a))
    schema = "municipality_id string, document_id string, sequence int, speech_text string"
    rows = [(m, d and m + d, n, "old") for m in ("m", "n") for d in ("a", "b", "c", None) for n in range(3) if d or n < 2]
    old = spark.createDataFrame(rows, schema)
    fresh = [("m", "ma", 0, "new"), ("m", "mb", 0, "new"), ("m", None, 7, "new")]
    new = spark.createDataFrame(fresh, schema)
    # rows without a document replace none
    want = sorted([r for r in rows if r[1] not in ("ma", "mb")] + fresh, key=str)
    for per_task in (jobs.ROWS_PER_TASK, 1):
        first, second = (str(tmp_path / f"{at}{per_task}") for at in "ab")
        tables.write_table(old, first, "speeches")
        stored = tables.read_table(spark, first, "speeches")
        jobs.replaced_snapshot(stored, new, f"{second}/speeches")
        jobs.replace_speeches(stored, new, f"{first}/speeches", per_task=per_task)
        for at in (first, second):
            got = spark.read.schema(stored.schema).parquet(f"{at}/speeches").select(*schema.replace(" string", "").replace(" int", "").split(", "))
            assert sorted(map(tuple, got.collect()), key=str) == want
    assert all("LeftAnti" not in plan and plan.count("Repartition") == 1 for plan in plans)


def test_repeated_numbers_are_found_by_bits(spark):
    def check(rows):
        df = spark.createDataFrame(rows, "document_id string, sequence int")
        try:
            tables.check_keys(df, "speeches")
        except ValueError as error:
            return str(error)

    rows = [("a", n) for n in range(-130, 130)] + [("b", 1), (None, 1), (None, 1), ("b", None), ("b", None)]
    assert check(rows) is None
    for repeated in (-128, -1, 0, 63, 64):
        assert str(repeated) in check(rows + [("a", repeated)])
    sent = spark.createDataFrame(rows, "document_id string, sequence int")
    assert not tables._numbers_repeat(sent, ["document_id"], "sequence")


def test_kept_counts_write_no_speeches(spark, monkeypatch):
    from minutes_spark.plans import catalog

    monkeypatch.setattr(catalog, "_stored_speeches", lambda *a: 1 / 0)
    assert catalog.QUERIES["speaker_ranking_from_kept_counts"](spark, "/root/testdata/sf0.001").count() > 0


def test_tasks_that_sort_lines_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    rows = [(f"d{d}", p, "１．出席議員\n田中\n○始め" if p == 2 else "前文") for d in range(9) for p in (1, 2, 3)]
    pages = spark.createDataFrame(rows, "document_id string, page int, text string")
    small, seen = sorted(map(tuple, A.attendee_sections(pages).collect()), key=str), []
    for size in (100, 10):
        monkeypatch.setattr(L, "TASK_BYTES", size)
        plan = A.attendee_sections(pages)
        assert sorted(map(tuple, plan.collect()), key=str) == small
        seen.append(plan.rdd.getNumPartitions())
    assert len(small) == 27 and seen[1] > 5 * seen[0]


def test_lists_and_names_meet_once(spark, tmp_path, monkeypatch):
    plans, write = [], resolve.durable
    monkeypatch.setattr(resolve, "durable", lambda df, name: plans.append(_plan(df)) or write(df, name))
    spark.createDataFrame(
        [("d", 1, 1, 0, "石丸伸二", "石丸", "p", "m"), ("d", 1, 2, 0, "山本数博", "山本", "q", "m"), ("d", 1, 2, 1, "山本優", "山本", "r", "m")],
        "document_id string, page int, line_no int, pos int, full_name string, family_name string, speaker_id string, municipality_id string",
    ).withColumn("created_at", F.lit("2020-01-01").cast("timestamp")).write.parquet(str(tmp_path / "people"))
    people = spark.read.parquet(str(tmp_path / "people"))
    said = ("石丸", "山本数博", "山本", "山本（優）", "石丸さん", "田中")
    names = spark.createDataFrame([("d", n, "m") for n in said], "document_id string, name_norm string, municipality_id string")
    names = names.withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    history = S.alias_history(None, S.derive_aliases(people))
    got = {r["name_norm"]: (r["match_strategy"], r["speaker_id"]) for r in resolve.resolve_names(names, people, history).collect()}
    assert got == {
        "石丸": ("exact_family", "p"), "山本数博": ("exact_fullname", "q"), "山本": ("alias_norm", "q"),
        "山本（優）": ("paren_hint", "r"), "石丸さん": ("prefix", "p"), "田中": ("unresolved", None),
    }
    assert len(plans) == 1 and plans[0].count("family_name#") and sum("Relation [" in x and "family_name" in x for x in plans[0].splitlines()) == 1
    # a document that is listed twice has its names twice, and each row meets the hits of both
    twice = [tuple(r)[1:] for r in resolve.resolve_names(names.unionByName(names), people, history).select("name_norm", "match_strategy").collect()]
    assert sorted(twice) == sorted([("exact_family",)] * 4 + [("exact_fullname",)] * 4 + [("alias_norm",)] * 4 + [("paren_hint",)] * 4 + [("unresolved",)] * 4)


def test_alias_taken_back_by_its_first_speaker(spark, monkeypatch):
    wrote, write = [], S.durable
    monkeypatch.setattr(S, "durable", lambda df, name: wrote.append(name) or write(df, name))
    rows = [("m", "a", f"2020-01-0{d}", f"d{d}", 1, 0, 0, 0, s, k) for d, s, k in (
        (1, "A", "speech_derived"), (2, "A", "manual"), (3, "B", "attendee_derived"), (4, "A", "manual"), (5, "A", "manual"))]
    incoming = spark.createDataFrame(
        rows, "municipality_id string, alias_norm string, at string, document_id string, page int, line_no int, pos int, part int, speaker_id string, alias_type string"
    ).withColumns({"created_at": F.col("at").cast("timestamp"), "alias_raw": F.col("alias_norm"), "confidence": F.lit(1.0)})
    history = S.alias_history(None, incoming).orderBy("valid_from")
    got = [(r["speaker_id"], r["valid_from"]["document_id"], r["valid_to"] and r["valid_to"]["document_id"]) for r in history.collect()]
    assert got == [("A", "d1", "d3"), ("B", "d3", "d4"), ("A", "d4", None)]
    assert "alias-rows" not in wrote


def test_counts_travel_with_their_names(spark):
    at = F.lit("2020-01-01").cast("timestamp")
    people = spark.createDataFrame(
        [("d", 1, 1, 0, "石丸伸二", "石丸", "p", "m")],
        "document_id string, page int, line_no int, pos int, full_name string, family_name string, speaker_id string, municipality_id string",
    ).withColumn("created_at", at)
    documents = spark.createDataFrame([("d", "m")], "document_id string, municipality_id string").withColumn("created_at", at)
    rows = [("d", "石丸", 3), ("d", "田中", 1), ("x", "石丸", 2), (None, "石丸", 1)]
    counts = spark.createDataFrame(rows, "document_id string, name_norm string, speeches long")
    history = S.alias_history(None, S.derive_aliases(people))
    resolved = resolve.resolve_names(resolve.counted_names(counts, documents), people, history)
    counted = resolve.count_resolved(counts, resolved)
    got = {tuple(r) for r in counted.select(*counts.columns, "speaker_id", "confidence", "match_strategy").collect()}
    # names of unknown documents are counted and not resolved
    assert got == {
        ("d", "石丸", 3, "p", "high", "exact_family"), ("d", "田中", 1, None, "low", "unresolved"),
        ("x", "石丸", 2, None, None, None), (None, "石丸", 1, None, None, None),
    }
    assert "Join" not in _plan(counted)


def test_packed_ids_come_back(spark):
    ids = ["p", "00ff", "00FF", "f", "", None, "\x01ab", "\x00", "石丸", "0123456789abcdef" * 2]
    df = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("packed", S.packed_id("id"))
    got = df.select("id", S.unpacked_id(F.col("packed")).alias("back"), "packed").collect()
    assert [r["back"] for r in got] == ids and len({bytes(r["packed"]) for r in got if r["packed"] is not None}) == len(ids) - 1
