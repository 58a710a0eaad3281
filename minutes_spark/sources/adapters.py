"""The minutes model as views over the given order, text and page tables.

``Minutes`` shapes orders as documents and line items as speeches. ``page_texts`` writes
Japanese minutes from the same rows, so that the parsing rules have input that grows with
the tables. Its wording is plain SQL that other engines can run as well.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import config
from .tables import kept_result

ITEM_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
)

FISCAL_YEAR = "CAST(year(o_orderdate) + 24 AS INT)"
SESSION_TYPE = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'regular' WHEN '2' THEN 'extra'
    WHEN '3' THEN 'committee' WHEN '4' THEN 'budget_committee' ELSE 'other' END"""
STATUS = """CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'downloaded'
    ELSE 'discovered' END"""
SPEAKER_ROLE = """CASE s_suppkey % 6 WHEN 0 THEN 'councilor' WHEN 1 THEN 'mayor'
    WHEN 2 THEN 'executive' WHEN 3 THEN 'chair' WHEN 4 THEN 'staff' ELSE 'unknown' END"""


class Minutes:
    """The tables of the model, each set up when it is first asked for."""

    def __init__(self, spark: SparkSession, root: str, **given: DataFrame):
        self.spark, self.root, self.given = spark, root, given

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in self.given:
            raise AttributeError(name)
        if name not in self.given:
            self.given[name] = VIEWS[name](self.spark, self.root)
        return self.given[name]

    def with_tables(self, **given: DataFrame) -> "Minutes":
        return Minutes(self.spark, self.root, **{**self.given, **given})


_SCHEMAS = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file footer once."""
    path = f"{root}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def municipalities(spark, root) -> DataFrame:
    return (
        table(spark, root, "nation")
        .join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("n_nationkey").alias("municipality_id"),
            F.col("n_name").alias("name_ja"),
            F.lower("n_name").alias("name_en"),
            F.col("r_name").alias("prefecture_ja"),
        )
    )


def _orders(spark, root) -> DataFrame:
    return table(spark, root, "orders").join(
        table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    )


def documents(spark, root) -> DataFrame:
    return _orders(spark, root).select(
        F.col("o_orderkey").alias("document_id"),
        F.col("c_nationkey").alias("municipality_id"),
        F.concat_ws("-", "c_nationkey", F.expr(FISCAL_YEAR), F.expr(SESSION_TYPE)).alias("session_id"),
        F.concat(F.lit("Document "), F.col("o_orderkey")).alias("title"),
        F.expr(STATUS).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def sessions(spark, root) -> DataFrame:
    return (
        _orders(spark, root)
        .select(
            F.col("c_nationkey").alias("municipality_id"),
            F.expr(FISCAL_YEAR).alias("fiscal_year"),
            F.expr(SESSION_TYPE).alias("session_type"),
        )
        .distinct()
        .withColumn("session_id", F.concat_ws("-", "municipality_id", "fiscal_year", "session_type"))
        .withColumn("session_name", F.concat_ws(" ", "fiscal_year", "session_type"))
    )


def assets(spark, root) -> DataFrame:
    return (
        table(spark, root, "orders")
        .filter(F.col("o_orderpriority") != "4-NOT SPECIFIED")
        .select(
            F.col("o_orderkey").alias("document_id"),
            F.concat(F.lit("store/"), F.col("o_orderkey"), F.lit(".pdf")).alias("storage_path"),
            F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_sha256"),
            F.col("o_orderdate").alias("downloaded_at"),
        )
    )


def numbered_items(spark, root) -> DataFrame:
    """Line items with their number in the document, in the order of ``ITEM_ORDER``."""
    # the table has at most seven items for an order, so its window is short
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)) - 1
    items = table(spark, root, "lineitem").withColumn("sequence", number.cast("int"))
    return items.withColumn("document_id", F.col("l_orderkey"))


def speeches(spark, root) -> DataFrame:
    return numbered_items(spark, root).select(
        "document_id",
        "sequence",
        F.expr("CASE WHEN l_returnflag <> 'R' THEN l_suppkey END").alias("speaker_id"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("speaker_name_raw"),
        # every tenth part gives a speech that is longer than a preview
        F.repeat(
            F.concat_ws(" ", F.lit("part"), "l_partkey", "l_returnflag", "l_linestatus"),
            F.when(F.col("l_partkey") % 10 == 0, 60).otherwise(1),
        ).alias("speech_text"),
    )


def speakers(spark, root) -> DataFrame:
    return table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("speaker_id"),
        F.col("s_nationkey").alias("municipality_id"),
        F.col("s_name").alias("name_ja"),
        F.expr(SPEAKER_ROLE).alias("role"),
    )


def summaries(spark, root) -> DataFrame:
    """One summary per parsed document; the topics are words about the order itself."""
    topics = F.concat(
        F.array(
            F.col("c_mktsegment"),
            F.substring("o_orderpriority", 3, 20),
            F.concat(F.lit("month "), F.month("o_orderdate")),
            F.concat(F.lit("desk "), F.col("o_custkey") % 97),
        ),
        F.when(F.col("o_totalprice") > 300000, F.array("c_mktsegment")).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return (
        _orders(spark, root)
        .filter(F.col("o_orderstatus") == "F")
        .select(
            F.col("o_orderkey").alias("document_id"),
            F.concat(F.lit("Summary of "), F.col("o_orderkey")).alias("summary_text"),
            F.when(F.col("o_totalprice") < 50000, None)
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.array().cast("array<string>"))
            .otherwise(topics)
            .alias("topics"),
            F.col("o_orderdate").alias("created_at"),
        )
    )


VIEWS = {
    "municipalities": municipalities, "sessions": sessions, "documents": documents,
    "assets": assets, "speeches": speeches, "speakers": speakers, "summaries": summaries,
}


# --- Japanese minutes written from orders and line items ------------------------------

# Each stage names columns by SQL expressions over the columns before it.
_DIGITS, _FAMILY, _GIVEN = "0123456789", "田山川石中村林松竹梅", "太一二三郎子美花男香"


def _name(number):
    digits = f"lpad(CAST({number} AS STRING), 3, '0')"
    family = f"translate(substr({digits}, 1, 2), '{_DIGITS}', '{_FAMILY}')"
    given = f"translate(substr({digits}, 3, 1) || substr({digits}, 1, 1), '{_DIGITS}', '{_GIVEN}')"
    return f"{family} || {given}"


_PERSON = [f"(key * 3 + {37 * at}) % 1000" for at in range(4)] + ["(key * 3 + 1) % 1000"]


def _spaced(name):
    return " || ' ' || ".join(f"substr({name}, {at}, 1)" for at in range(1, 5))


PREAMBLE_STAGES = (
    {f"n{at}": _name(number) for at, number in enumerate(_PERSON)},
    {
        "members": f"""CASE WHEN status = 'P' THEN
            '２．出席委員は次のとおりである。（３名）' || chr(10) ||
            '委員長' || n0 || '副委員長' || n1 || chr(10) || '委員' || n4
        ELSE '２．出席議員は次のとおりである。（３名）' || chr(10) ||
            '１番　' || {_spaced('n0')} || '　　　　２番　' || {_spaced('n1')} || chr(10) ||
            '１５番　' || {_spaced('n4')} END""",
        "officials": """CASE substr(priority, 1, 1)
            WHEN '1' THEN '市長' || n2 || '副市長' || n3
            WHEN '2' THEN '総務課長' || n2 || '総務係長' || n3
            WHEN '3' THEN '福祉保健部長兼福祉事務所長' || n2
            WHEN '4' THEN '課長補佐' || n2 || '（代理）事務局次長' || n3
            ELSE '教育次長 ' || n2 || '　危機管理監' || n3 END""",
    },
    {
        "text": """'会議録　' || CAST(key AS STRING) || chr(10) || members || chr(10) ||
            '３．欠席議員' || chr(10) || 'なし' || chr(10) ||
            '５．条例の規定により出席した者の職氏名' || chr(10) || officials || chr(10) ||
            '議会事務局の職氏名' || chr(10) || '事務局長' || n3 || '　書記' || n1 || chr(10)""",
    },
)

SPEECH_STAGES = (
    {
        "number": f"""CASE part % 6 WHEN 0 THEN {_PERSON[0]} WHEN 1 THEN {_PERSON[1]}
            WHEN 2 THEN {_PERSON[2]} WHEN 3 THEN {_PERSON[3]} WHEN 4 THEN {_PERSON[4]}
            ELSE (key * 11 + part) % 1000 END""",
        "said": "'　本案の第' || CAST(part AS STRING) || '号について、' || flag || 'とする。 '",
    },
    {"who": _name("number")},
    {
        "text": """CASE supplier % 7
            WHEN 0 THEN '○' || substr(who, 1, 1) || ' ' || substr(who, 2, 1) || ' 議 員' || chr(10)
            WHEN 1 THEN '○' || who || '議員'
            WHEN 2 THEN '○' || substr(who, 1, 2) || '（' || substr(who, 3, 1) || '）委員'
            WHEN 3 THEN '○' || substr(who, 1, 2) || '政策企画課長' || chr(10)
            WHEN 4 THEN ''
            WHEN 5 THEN '○第'
            ELSE '○' || substr(who, 1, 2) || ' ' || substr(who, 3, 2) || chr(10) || chr(10) END
            || said || CASE supplier % 7 WHEN 5 THEN chr(10) || '～～○～～' ELSE '' END
            || chr(10) || ' ' || CAST(page AS STRING) || ' ' || chr(10)"""
    },
)


def _staged(df: DataFrame, stages) -> DataFrame:
    for stage in stages:
        df = df.withColumns({name: F.expr(sql) for name, sql in stage.items()})
    return df


def page_texts(spark: SparkSession, root: str) -> DataFrame:
    """``document_id, page, text``: the attendee list on page 1, then one page per item.

    The pages are written once for one state of the given tables, as most steps read them several times.
    """
    sources = [f"{root}/{name}.parquet" for name in ("orders", "lineitem")]
    return kept_result(spark, sources, "page-texts", lambda: _page_texts(spark, root))


def _page_texts(spark: SparkSession, root: str) -> DataFrame:
    first = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.lit(1).alias("page"),
    )
    items = numbered_items(spark, root).select(
        F.col("l_orderkey").alias("key"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.concat("l_returnflag", "l_linestatus").alias("flag"),
        (F.col("sequence") + 2).alias("page"),
    )
    columns = [F.col("key").alias("document_id"), "page", "text"]
    return (
        _staged(first, PREAMBLE_STAGES)
        .select(*columns)
        .unionByName(_staged(items, SPEECH_STAGES).select(*columns))
    )


# --- Text views ------------------------------------------------------------------------


def document_pages(spark, root) -> DataFrame:
    """Each text document as one page."""
    return table(spark, root, "documents").select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text"
    )


def conversation_speeches(spark, root) -> DataFrame:
    return table(spark, root, "conversations").select(
        F.col("conv_id").alias("document_id"),
        F.col("turn").cast("int").alias("sequence"),
        F.col("role").alias("speaker_name_raw"),
        F.col("text").alias("speech_text"),
    )


def text_speeches(spark, root) -> DataFrame:
    """Each text document as one speech of the municipality named by its language."""
    return table(spark, root, "documents").select(
        F.col("lang").alias("municipality_id"),
        F.col("doc_id").alias("document_id"),
        F.lit(0).alias("sequence"),
        F.col("text").alias("speech_text"),
    )
