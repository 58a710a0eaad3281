import pytest
from pyspark.sql import functions as F

from minutes_spark.functions import text as X, urls
from minutes_spark.functions.names import (
    family_from_compact,
    family_from_spaced,
    with_person_name,
    with_speaker_match,
    with_speaker_name,
)


def values(spark, inputs, build):
    df = spark.createDataFrame(list(enumerate(inputs)), "n int, v string")
    return [tuple(r)[2:] for r in build(df).orderBy("n").collect()]


def column(spark, inputs, expression):
    return [v[0] for v in values(spark, inputs, lambda df: df.withColumn("out", expression))]


def test_speaker_lines(spark):
    cases = {
        "○大 下 議 長": ("大 下 議 長", ""),
        "○大下議長ただいまの出席議員は17名であります。": ("大下議長", "ただいまの出席議員は17名であります。"),
        "○南澤産業厚生常任委員長まず1点目": ("南澤産業厚生常任委員長", "まず1点目"),
        "○沖田財政課長本案は、": ("沖田財政課長", "本案は、"),
        "○稲田農業委員会事務局長要点を": ("稲田農業委員", "会事務局長要点を"),
        "○山本(数)議員　はい": ("山本(数)議員", "はい"),
        "○田中 太郎": ("田中 太郎", ""),
        "○": (None, None),
        "○田中ー太郎議員": (None, None),
        "○一二三四五六七八九議員はい。": (None, None),
        " ○大下議長": (None, None),
        "○第12号 議案": (None, None),
    }
    got = values(spark, list(cases), lambda df: with_speaker_match(df, line="v"))
    assert got == list(cases.values())


def test_speaker_names(spark):
    cases = {
        "大 下 議 長": ("議長", "大下", "high"),
        "石飛予算決算常任委員長": ("予算決算常任委員長", "石飛", "high"),
        "猪掛副市長": ("副市長", "猪掛", "high"),
        "田中総務部長": ("総務部長", "田中", "high"),
        "田中太郎": ("", "田中太郎", "medium"),
        "議長": ("", "議長", "medium"),
        "山本副委員長": ("委員長", "山本副", "high"),
        "稲田事務局長": ("局長", "稲田事務", "high"),
        "": ("", "", "low"),
    }
    got = values(spark, list(cases), lambda df: with_speaker_name(df, raw="v"))
    assert got == list(cases.values())


def test_person_names(spark):
    cases = {
        "石丸伸二": "石丸伸二",
        "沖田伸二政策企画課長黒田貢一": "沖田伸二",
        "補佐小野光基社会環境課": "小野光基",
        "兼福祉事務所長井上和志": "井上和志",
        "兼給食センター所長内藤麻妃": "内藤麻妃",
        "田中太郎・次郎": "田中太郎",
        "田中太郎（代理）": "田中太郎",
        "（代理）田中": "（代理）田中",
        "一二三四五六七八": "一二三四五六",
        "総務太郎": "総務太郎",
        "兼": "",
    }
    got = values(spark, list(cases), lambda df: with_person_name(df, "v", "name"))
    assert [g[0] for g in got] == list(cases.values())


def test_family_names(spark):
    spaced = {"南 澤 克 彦": "南澤", "石 丸 伸": "石丸", "林 太": "林", "南澤克彦": "南澤克彦", "南澤　克彦": "南澤", " ": ""}
    assert column(spark, list(spaced), family_from_spaced("v")) == list(spaced.values())
    compact = {"南澤克彦": "南澤", "林太郎": "林", "南澤": "南澤", "林": "林"}
    assert column(spark, list(compact), family_from_compact("v")) == list(compact.values())


def test_whitespace_and_digits(spark):
    assert column(spark, ["南　澤 克﻿ 彦", ""], X.normalize_alias("v")) == ["南澤克彦", ""]
    assert column(spark, ["　a b　"], X.trim_ws("v")) == ["a b"]
    assert column(spark, ["　a b　"], X.rtrim_ws("v")) == ["　a b"]
    assert column(spark, ["１０番"], X.zen_to_han("v")) == ["10番"]
    lines = [" 3 ", "3", "　", "", "3 4", "a", "３"]
    assert column(spark, lines, X.is_blank_or_number("v")) == [True, True, True, True, False, False, False]
    assert column(spark, ["～～○～", "○", "○a", "◯ ~"], X.is_separator("v")) == [True, True, False, True]


def test_codes_and_labels(spark):
    roles = {
        "議員": "councilor", "市長": "mayor", "教育長": "executive", "副議長": "chair",
        "総務文教常任委員長": "chair", "総務部長": "staff", "監査委員": "staff",
        "委員": "unknown", "書記": "unknown", "消防長": "unknown",
    }
    assert column(spark, list(roles), X.speaker_role("v")) == list(roles.values())
    kinds = {"令和6年 定例会": "regular", "臨時議会": "extra", "総務委員会": "committee", "お知らせ": "other"}
    assert column(spark, list(kinds), X.section_kind("v")) == list(kinds.values())
    assert column(spark, ["regular", "committee", "x"], X.document_type("v")) == ["minutes", "committee_minutes", "other"]
    assert column(spark, ["extra", "zzz"], X.session_label("v")) == ["臨時会", "zzz"]
    assert column(spark, ["2024"], X.era_option(F.col("v").cast("int"))) == ["R6（2024）"]
    assert column(spark, ["a" * 11, "a" * 10], X.topic_label("v")) == ["a" * 10 + "...", "a" * 10]


@pytest.mark.parametrize("text, tokens", [("あいうえお", 3), ("", 0), ("a", 1), ("あ" * 1000, 500), ("𠮷", 1), ("𠮷a", 2)])
def test_token_estimate(spark, text, tokens):
    assert column(spark, [text], X.estimate_tokens("v")) == [tokens]


def test_urls(spark):
    import hashlib

    url = "https://example.com/a/test%20minutes+1.pdf?x=1"
    prefix = hashlib.sha256(url.encode()).hexdigest()[:12]
    assert column(spark, [url], urls.storage_name("v")) == [prefix + "_test minutes+1.pdf"]
    assert column(spark, ["/c/%E8%AD%B0.PDF", "/c/%zz.pdf", "/c/%ff.pdf"], urls.title_from_url("v")) == ["議", None, None]
    assert column(spark, ["/a", "a", "http://x/a"], urls.absolute_url("v", "https://h")) == ["https://h/a", "https://h/a", "http://x/a"]
    assert column(spark, ["r6-first_day.PDF"], urls.title_from_filename("v")) == ["r6 first day"]
