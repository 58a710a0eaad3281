import random
from datetime import datetime

import pytest

from minutes_spark import config
from minutes_spark.operators import resolve as R, speakers as S

DOCS = "document_id string, municipality_id string, created_at timestamp"
PEOPLE = (
    "document_id string, page int, line_no int, pos int, full_name string, family_name string, "
    "role string, seat_number int, category string"
)


def attendees(spark, names, documents, speakers=None):
    rows = [(d, 1, n, 0, full, family, role, None, "councilor") for n, (d, full, family, role) in enumerate(names)]
    return S.with_speaker_ids(spark.createDataFrame(rows, PEOPLE), documents, speakers)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("d0", "m", datetime(2024, 1, 1)), ("d1", "m", datetime(2024, 2, 1)), ("d2", "m", datetime(2024, 3, 1))]
    return spark.createDataFrame(rows, DOCS)


def test_cascade(spark, documents):
    names = [
        ("d1", "南澤克彦", "南澤", "議員"), ("d1", "大下正幸", "大下", "議員"), ("d1", "山本数博", "山本", "議員"),
        ("d1", "山本優", "山本", "議員"), ("d1", "佐々木智之", "佐々木", "課長"),
        ("d0", "沖田伸二", "沖田", "課長"), ("d2", "後藤一郎", "後藤", "課長"),
    ]
    people = attendees(spark, names, documents)
    history = S.alias_history(None, S.derive_aliases(people))
    asked = [
        "南澤克彦", "南澤", "山本", "沖田伸二", "沖田", "山本(数)", "山本（優）", "山本(外)",
        "佐々木政策企画", "田中", "後藤", "南 澤",
    ]
    rows = [("d1", n, raw, raw, "はい", 1, 1) for n, raw in enumerate(asked)]
    speeches = spark.createDataFrame(
        rows, "document_id string, sequence int, speaker_name_raw string, speaker_name string, "
        "speech_text string, page_start int, page_end int"
    )
    got = R.resolve_speakers(speeches, documents, people, history).orderBy("sequence").collect()
    assert [(r.full_name, r.confidence, r.match_strategy) for r in got] == [
        ("南澤克彦", 1.0, "exact_fullname"), ("南澤克彦", 1.0, "exact_family"),
        ("山本数博", 1.0, "alias_norm"),  # the shared surname still belongs to its first holder
        (None, 1.0, "alias_norm"), (None, 1.0, "alias_norm"),
        ("山本数博", 1.0, "paren_hint"), ("山本優", 1.0, "paren_hint"), (None, 0.3, "unresolved"),
        ("佐々木智之", 0.7, "prefix"), (None, 0.3, "unresolved"),
        (None, 0.3, "unresolved"),  # registered by a later document
        ("南澤克彦", 1.0, "exact_family"),
    ]
    resolved = R.resolve_names(R.speech_names(speeches, documents), people, history)
    counted = R.count_resolved(R.count_names(speeches), resolved)
    rate = R.match_rate(counted).first()
    assert (rate.speeches, rate.matched, rate.unmatched, rate.rate) == (12, 9, 3, 75.0)
    empty = R.match_rate(counted.limit(0)).first()
    assert (empty.speeches, empty.matched, empty.rate) == (0, 0, None)
    assert {(r.name_norm, r.speeches, r.documents) for r in R.unresolved_names(counted).collect()} == {
        ("山本(外)", 1, 1), ("田中", 1, 1), ("後藤", 1, 1)}
    assert [(r.name_norm, r.bearers) for r in R.shared_surname_hits(resolved, people).collect()] == [("山本", 2)]


def test_upsert_speakers(spark, documents):
    stored = spark.createDataFrame(
        [("s1", "m", "南澤克彦", "unknown"), ("s2", "m", "大下正幸", "chair"), ("s3", "m", "古い人", "mayor")],
        "speaker_id string, municipality_id string, name_ja string, role string",
    )
    people = attendees(
        spark,
        [("d2", "南澤克彦", "南澤", "市長"), ("d1", "南澤克彦", "南澤", "書記"), ("d1", "南澤克彦", "南澤", "議員"),
         ("d1", "大下正幸", "大下", "議員"), ("d1", "新人", "新人", "書記")],
        documents, stored,
    )
    got = {r.name_ja: r for r in S.upsert_speakers(stored, S.incoming_speakers(people)).collect()}
    assert {n: (r.role, r.is_new) for n, r in got.items()} == {
        "南澤克彦": ("councilor", False), "大下正幸": ("chair", False), "古い人": ("mayor", False), "新人": ("unknown", True),
    }
    assert got["南澤克彦"].speaker_id == "s1"
    assert {r.speaker_id for r in people.filter("full_name = '南澤克彦'").collect()} == {"s1"}


def fold(rows):
    """The alias rule one row at a time."""
    owner = None
    for row in rows:
        rank = config.ALIAS_PRIORITY[row[1]]
        if owner is None or (row[0] != owner[0] and rank > config.ALIAS_PRIORITY[owner[1]]):
            owner = row
    return owner


def test_alias_merge_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    stored, incoming, expected = [], [], {}
    for alias in range(150):
        rows = [(rng.choice("xyz"), rng.choice(list(config.ALIAS_PRIORITY))) for _ in range(rng.randint(1, 6))]
        expected[f"n{alias}"] = fold(rows)
        first = rng.random() < 0.5
        if first:
            stored.append(("m", f"n{alias}", *rows[0], f"n{alias}", 0.1))
        for at, row in enumerate(rows[int(first):]):
            incoming.append(("m", f"n{alias}", *row, f"n{alias}", 0.2, datetime(2024, 1, 1 + at // 2), f"d{at // 2}", 1, at, 0, 0))
    base = "municipality_id string, alias_norm string, speaker_id string, alias_type string, alias_raw string, confidence double"
    rng.shuffle(incoming)
    merged = S.merge_aliases(
        spark.createDataFrame(stored, base),
        spark.createDataFrame(incoming + [("m", "", "x", "manual", "", 1.0, datetime(2024, 1, 1), "d", 1, 0, 0, 0)],
            base + ", created_at timestamp, document_id string, page int, line_no int, pos int, part int"),
    ).collect()
    assert {r.alias_norm: (r.speaker_id, r.alias_type) for r in merged} == expected
    assert len(merged) == len(expected)


def greedy(names):
    """Merge groups as nested loops over names by length."""
    out, merged = {}, set()
    by_length = sorted(names, key=len)
    for at, short in enumerate(by_length):
        if short in merged or len(short) < 3:
            continue
        for long in by_length[at + 1:]:
            if long not in merged and len(long) > len(short) and long.startswith(short):
                out[long] = short
                merged.add(long)
    return out


def test_merge_groups_equal_the_greedy_loop(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for muni in range(40):
        names = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(12)}
        rows += [(f"m{muni}", n, f"{muni}-{n}") for n in names]
        expected |= {(f"m{muni}", long): short for long, short in greedy(names).items()}
    speakers = spark.createDataFrame(rows, "municipality_id string, name_ja string, speaker_id string")
    groups = S.merge_groups(speakers)
    assert {(r.municipality_id, r.duplicate_name): r.canonical_name for r in groups.collect()} == expected
    assert S.drop_duplicates(speakers, groups).count() == len(rows) - len(expected)


def test_repoint_keeps_speeches_without_a_speaker(spark):
    groups = spark.createDataFrame([("b", "a")], "duplicate_id string, canonical_id string")
    speeches = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "n int, speaker_id string")
    moved = S.repoint_speeches(speeches, groups).select("n", "speaker_id").collect()
    assert {tuple(r) for r in moved} == {(1, "a"), (2, None), (3, "c")}


def test_repoint(spark):
    groups = spark.createDataFrame([("m", "dup", "長い名", "can", "長い")], "municipality_id string, duplicate_id string, duplicate_name string, canonical_id string, canonical_name string")
    speeches = spark.createDataFrame([("dup",), ("dup",), ("can",), (None,)], "speaker_id string")
    assert sorted(r.speaker_id or "" for r in S.repoint_speeches(speeches, groups).collect()) == ["", "can", "can", "can"]
    assert S.merge_report(speeches, groups).first().moved_speeches == 2
