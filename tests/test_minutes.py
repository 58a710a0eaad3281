import pytest
from pyspark.sql import functions as F

from minutes_spark.operators import attendees as A, lines as L, speeches as P

PLENARY = """市議会定例会会議録
２．出席議員は次のとおりである。（１５名）
１番　南 澤 克 彦　　　　　　　　　２番　田 邊 介 三
３番　石 飛 空
３．欠席議員
なし
５．地方自治法第１２１条により説明のため出席した者の職氏名（１６名）
市長石丸伸二副市長米村公男
総務部長高藤誠
○大 下 議 長
　ただいまの出席議員は15名であります。"""
COMMITTEE = """総務文教常任委員会会議録
２．出席委員は次のとおりである。（７名）
委員長芦田宏治副委員長山本数博
委員南澤克彦
５．委員会条例第２２条の規定により出席した者の職氏名（３４名）
市長石丸伸二
○芦 田 委 員 長
　開会します。"""
BLOCKS = [None, 1, 2]


def block(size):
    return None if size is None else F.floor(F.col("page") / size)


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id string, page int, text string")


def speeches(df, size=None):
    rows = P.parse_speeches(df, block=block(size)).orderBy("document_id", "sequence").collect()
    return [
        (r.document_id, r.sequence, r.speaker_name, r.speaker_role, r.speech_text, r.page_start, r.page_end)
        for r in rows
    ]


@pytest.mark.parametrize("size", BLOCKS)
def test_segmentation(spark, size):
    df = pages(
        spark,
        ("a", 3, "前文\n○大 下 議 長\n　発言開始\n3\n"),
        ("a", 4, "　発言続き\n\n～～○～～\n○第１号 議案です"),
        ("a", 5, "○宍 戸 議 員\n○田中委員\n○山本委員はい。"),
        ("a", 6, " ○字下げ\n続き"),
        ("b", 1, "前文のみ\n何も発言なし"),
        ("c", 1, "○大下議長そう。"),
    )
    assert speeches(df, size) == [
        ("a", 0, "大下", "議長", "発言開始\n　発言続き\n○第１号 議案です", 3, 4),
        ("a", 1, "山本", "委員", "はい。\n ○字下げ\n続き", 5, 6),
        ("c", 0, "大下", "議長", "そう。", 1, 1),
    ]


def test_blocks_do_not_change_a_long_document(spark):
    rows = [("long", n, f"○{'田山川'[n % 3]}本議員\n{n}番" if n % 4 == 0 else f"続き{n}") for n in range(60)]
    df = pages(spark, *rows, ("short", 1, "○田中議員\nはい"))
    expected = speeches(df)
    assert len(expected) == 16
    for size in (1, 3, 7, 30):
        assert speeches(df, size) == expected


def test_lines(spark):
    df = pages(spark, ("a", 1, "内容\n3\n次の内容 "), ("a", 2, "\n行"))
    got = [(r.page, r.line_no, r.line) for r in L.flatten_pages(df).orderBy("page", "line_no").collect()]
    assert got == [(1, 0, "内容"), (1, 2, "次の内容"), (2, 1, "行")]


@pytest.mark.parametrize("size", BLOCKS)
def test_attendees(spark, size):
    head, tail = PLENARY.split("３．欠席議員")
    df = pages(
        spark, ("p", 1, head), ("p", 2, "３．欠席議員" + tail), ("p", 3, "市長続き\n○別"), ("c", 1, COMMITTEE),
        ("none", 1, "２．出席議員\n１番　南 澤 克 彦"),
    )
    rows = A.parse_attendees(df, block=block(size)).orderBy("document_id", "page", "line_no", "pos").collect()
    assert [(r.document_id, r.full_name, r.family_name, r.role, r.seat_number, r.category) for r in rows] == [
        ("c", "芦田宏治", "芦田", "委員長", None, "councilor"),
        ("c", "山本数博", "山本", "副委員長", None, "councilor"),
        ("c", "南澤克彦", "南澤", "委員", None, "councilor"),
        ("c", "石丸伸二", "石丸", "市長", None, "executive"),
        ("p", "南澤克彦", "南澤", "議員", 1, "councilor"),
        ("p", "田邊介三", "田邊", "議員", 2, "councilor"),
        ("p", "石飛空", "石飛", "議員", 3, "councilor"),
        ("p", "石丸伸二", "石丸", "市長", None, "executive"),
        ("p", "米村公男", "米村", "副市長", None, "executive"),
        ("p", "高藤誠", "高藤", "総務部長", None, "executive"),
    ]


def official(spark, *lines):
    rows = [("d", 1, n, line, "executive", False) for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "document_id string, page int, line_no int, line string, category string, seated boolean")
    return [(r.role, r.full_name) for r in A.parse_lines(df).orderBy("line_no", "pos").collect()]


def test_official_lines(spark):
    assert official(spark, "財政課長沖田伸二政策企画課長黒田貢一") == [("財政課長", "沖田伸二"), ("課長", "黒田貢一")]
    assert official(spark, "事務局長田中太郎書記山田花子") == [("事務局長", "田中太郎"), ("書記", "山田花子")]
    assert official(spark, "福祉保健部長兼福祉事務所長井上和志") == [("福祉保健部長", "井上和志")]
    assert official(spark, "課長補佐小野光基") == [("課長", "小野光基")]
    assert official(spark, "教育次長柳川知昭危機管理監神田正広") == [("教育次長", "柳川知昭"), ("危機管理監", "神田正広")]
    assert official(spark, "役職なし") == []


def test_page_assembly(spark):
    items = [("d", 1, 0, "あ", 100.0), ("d", 1, 1, "い", 101.5), ("d", 1, 2, "う", 90.0), ("d", 2, 0, "え", 1.0)]
    df = spark.createDataFrame(items, "document_id string, page int, item int, str string, y double")
    got = {r.page: r.text for r in L.reconstruct_pages(df).collect()}
    assert got == {1: "あい\nう", 2: "え"}


def test_attendee_checks(spark):
    df = spark.createDataFrame(
        [("d", "南澤克彦", "南澤"), ("d", "山本数博", "山本"), ("d", "山本優", "山本"), ("d", "一二三四五六", "一二")],
        "document_id string, full_name string, family_name string",
    )
    assert {r.family_name for r in A.unique_families(df).collect()} == {"南澤", "一二"}
    assert tuple(A.suspicious_attendees(df).first()) == ("d", 4, 1)


def test_spoken_names_are_the_names_of_speeches(spark):
    texts = ["○大下議長\nはい。\n○南澤議員\n \n○大下議長ただいま。", "続き。\n○田中\n○南澤議員\n 3 \n　", "終わり。\n○大下議長"]
    pages = spark.createDataFrame([("d", n, t) for n, t in enumerate(texts)], "document_id string, page int, text string")
    names = sorted(r.speaker_name for r in P.parse_speeches(pages).collect())
    for size in (1, 2, 50):
        found = P.spoken_names(pages, block=F.floor(F.col("page") / size)).collect()
        assert sorted(r.speaker_name for r in found) == names


def test_preamble_beyond_the_broadcast_bound_is_the_same(spark, monkeypatch):
    df = pages(
        spark,
        ("a", 1, PLENARY), ("a", 2, "○山本議員\nはい"), ("b", 1, "前文\n\n 二行目"), ("b", 2, "三行目"),
        ("b", 3, "四行目\n　○田中委員\n五"), ("b", 4, "後の頁"), ("c", 1, "印なし"), ("d", 7, "○始め"),
    )
    read = lambda: sorted(map(tuple, L.preamble_lines(df).collect()))
    near = read()
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert read() == near
    assert [r[1:] for r in near if r[0] == "b"] == [(1, 0, "前文"), (1, 1, ""), (1, 2, " 二行目"), (2, 0, "三行目"), (3, 0, "四行目")]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_speeches_over_many_blocks_keep_text_pages_and_numbers(spark, size):
    rows, said = [], []
    for n in range(40):
        if n % 11 == 3:
            rows.append(("x", n, f"末尾{n}\n○山本議員 {n}番\n○田中委員"))
        elif n % 11 == 5:
            rows.append(("x", n, "\n  \n"))
        else:
            rows.append(("x", n, f"続き{n}"))
    rows.append(("y", 9, "○大下議長 はい"))
    df = pages(spark, *rows)
    whole = speeches(df)
    assert speeches(df, size) == whole
    assert [r[1] for r in whole if r[0] == "x"] == list(range(len(whole) - 1))
    names = P.spoken_names(df, block=block(size)).groupBy("document_id", "speaker_name").count()
    assert {tuple(r) for r in names.collect()} == {("x", "山本", 4), ("x", "田中", 4), ("y", "大下", 1)}
