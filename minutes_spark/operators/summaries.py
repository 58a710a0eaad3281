"""Preparation of summary requests and reading of the replies."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..functions.text import estimate_tokens, trim_ws
from ..sources.tables import durable
from .scan import blocks_of, long_keys, running


def _units(c) -> Column:
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def formatted(df: DataFrame) -> Column:
    return F.concat("speaker_name_raw", F.lit(": "), "speech_text")


def format_speeches(speeches: DataFrame, keys) -> DataFrame:
    """``name: text`` of each group in order, with blank lines between."""
    texts = F.array_sort(F.collect_list(F.struct("sequence", formatted(speeches).alias("t"))))
    return speeches.groupBy(*keys).agg(
        F.array_join(F.transform(texts, lambda s: s["t"]), "\n\n").alias("content"),
        F.count("*").alias("speeches"),
    )


def route_documents(speeches: DataFrame, limit=config.TOKEN_LIMIT) -> DataFrame:
    """Estimated tokens of each formatted document and whether it fits one request.

    The estimate is summed up from the speeches; no document text is put together for it.
    """
    return (
        speeches.groupBy("document_id")
        .agg(F.sum(_units(formatted(speeches))).alias("_units"), F.count("*").alias("speeches"))
        .withColumn("tokens", F.ceil((F.col("_units") + 2 * (F.col("speeches") - 1)) * 0.5))
        .withColumn("route", F.when(F.col("tokens") <= limit, "single").otherwise("chunked"))
        .drop("_units")
    )


def pack_chunks(
    speeches: DataFrame, limit=config.TOKEN_LIMIT, per_block=config.SPEECHES_PER_BLOCK
) -> DataFrame:
    """Chunk number of each speech: chunks fill in order up to ``limit`` tokens.

    A speech above the limit is a chunk of its own. Speeches are numbered without gaps from 0; a
    document's are folded in blocks of ``per_block``, whose starts are found by jumps from chunk
    to chunk where there are several. Only token counts travel, no text.
    """
    block = blocks_of("sequence", per_block)
    line = F.concat(formatted(speeches), F.lit("\n\n"))
    items = F.array_sort(F.collect_list(F.struct("sequence", "tokens")))
    counted = speeches.select(
        "document_id", "sequence", estimate_tokens(line).cast("int").alias("tokens"), block.cast("int").alias("block")
    )
    blocks = counted.groupBy("document_id", "block").agg(items.alias("items"))
    long = long_keys(speeches.select("document_id", "sequence"), block)
    if not long.isEmpty():
        starts = _block_starts(counted.join(long, "document_id", "left_semi"), limit)
        blocks = blocks.join(starts, ["document_id", "block"], "left").na.fill(0, ["carry", "chunk"])
    else:
        blocks = blocks.withColumns({"carry": F.lit(0), "chunk": F.lit(0)})

    def step(state, item):
        total = state["carry"] + item["tokens"]
        full = (state["carry"] > 0) & (total > limit)
        chunk = state["chunk"] + full.cast("int")
        return F.struct(
            F.when(full, item["tokens"]).otherwise(total).alias("carry"),
            chunk.alias("chunk"),
            F.concat(state["chunks"], F.array(chunk)).alias("chunks"),
        )

    start = F.struct(
        F.col("carry").cast("int").alias("carry"),
        F.col("chunk").cast("int").alias("chunk"),
        F.array().cast("array<int>").alias("chunks"),
    )
    chunks = F.aggregate("items", start, step, lambda state: state["chunks"])
    return (
        blocks.select("document_id", "items", chunks.alias("chunks"))
        .select("document_id", F.explode(F.arrays_zip("items", "chunks")).alias("s"))
        .select(
            "document_id",
            F.col("s.items.sequence").alias("sequence"),
            F.col("s.items.tokens").alias("tokens"),
            F.col("s.chunks").alias("chunk"),
        )
    )


#: Tokens of a bucket in which the next chunk's end is looked for, in requests.
_REQUESTS_PER_BUCKET = 64


def _chunk_jumps(counted: DataFrame, limit: int) -> DataFrame:
    """(document_id, at, to, upto): behind a chunk that ends with speech ``at`` the next one ends with ``to``.

    ``upto`` are the document's tokens up to ``at``. The next chunk ends with the last speech whose
    running sum is within ``limit`` of that, or holds one larger speech. Sums are looked for in
    buckets; the first ``limit`` tokens of a bucket are also known to the bucket before.
    """
    size = _REQUESTS_PER_BUCKET * limit
    summed = running(
        counted.withColumn("tokens", F.col("tokens").cast("long")), ["document_id"], ["sequence"], F.col("block"),
        sums={"upto": "tokens"},
    ).select("document_id", F.col("sequence").cast("long").alias("at"), "upto")
    last = summed.groupBy("document_id").agg(F.max("at").alias("_last"))
    start = last.select("document_id", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("upto"))
    bucket = F.floor(F.col("upto") / size)
    both = F.when(F.col("upto") % size <= limit, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    placed = summed.unionByName(start).select("*", F.posexplode(both).alias("_copy", "_bucket"))
    reach = Window.partitionBy("document_id", "_bucket").orderBy("upto").rangeBetween(1, limit)
    jumps = placed.withColumn("_to", F.max("at").over(reach)).filter("_copy = 0").join(last, "document_id")
    to = F.when(F.col("at") < F.col("_last"), F.coalesce("_to", F.col("at") + 1))
    return jumps.select("document_id", "at", to.alias("to"), "upto")


def _chunk_ends(jumps: DataFrame) -> DataFrame:
    """(document_id, at): the ends that the chain from the start meets, by doubling the jumps.

    After k rounds the first 2^k ends are known and a jump leads 2^k chunks on.
    """
    ends = jumps.filter("at = -1").select("document_id", "at")
    jumps = durable(jumps.select("document_id", "at", "to").filter(F.col("to").isNotNull()), "chunk-jumps")
    while not jumps.isEmpty():
        ahead = ends.join(jumps, ["document_id", "at"]).select("document_id", F.col("to").alias("at"))
        ends = durable(ends.unionByName(ahead), "chunk-ends")
        further = jumps.select("document_id", F.col("at").alias("to"), F.col("to").alias("_further"))
        jumps = durable(
            jumps.join(further, ["document_id", "to"]).select("document_id", "at", F.col("_further").alias("to")), "chunk-jumps"
        )
    return ends


def _block_starts(counted: DataFrame, limit: int) -> DataFrame:
    """(document_id, block, carry, chunk): tokens of the open chunk and its number where a block begins."""
    jumps = durable(_chunk_jumps(counted, limit), "chunk-jumps")
    ends = _chunk_ends(jumps).join(jumps, ["document_id", "at"]).select("document_id", "at", "upto")
    edges = counted.groupBy("document_id", "block").agg(F.min("sequence").cast("long").alias("_first"), F.sum("tokens").alias("_tokens"))
    bounds = Window.partitionBy("document_id").orderBy("block")
    edges = edges.withColumns(
        {
            "_before": F.coalesce(F.sum("_tokens").over(bounds.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_next": F.lead("_first").over(bounds),
        }
    )
    # the start counts as an end, so the chunk that is open, or begins here, is the number of ends before less one
    held = ends.join(edges.select("document_id", "block", "_first", "_next"), "document_id").filter(
        (F.col("at") >= F.col("_first") - F.when(F.col("block") == 0, 1).otherwise(0))
        & (F.col("_next").isNull() | (F.col("at") < F.col("_next")))
    )
    per_block = held.groupBy("document_id", "block").agg(F.count("*").alias("_n"), F.max("upto").alias("_upto"))
    earlier = bounds.rowsBetween(Window.unboundedPreceding, -1)
    found = edges.join(per_block, ["document_id", "block"], "left").withColumns(
        {"_ends": F.sum("_n").over(earlier), "_open": F.max("_upto").over(earlier)}
    )
    carry = F.col("_before") - F.col("_open")
    return found.filter("block > 0").select(
        "document_id", "block", carry.cast("int").alias("carry"),
        (F.col("_ends") - 1).cast("int").alias("chunk"),
    )


def request_table(speeches: DataFrame, limit=config.TOKEN_LIMIT, **options) -> DataFrame:
    """One row per request: a document that fits, or one chunk of a longer one."""
    routes = route_documents(speeches, limit).select("document_id", "route")
    chunks = pack_chunks(speeches, limit, **options).select("document_id", "sequence", "chunk")
    parts = (
        speeches.join(chunks, ["document_id", "sequence"])
        .join(routes, "document_id")
        .withColumn("part", F.when(F.col("route") == "single", 0).otherwise(F.col("chunk")))
    )
    return format_speeches(parts, ["document_id", "route", "part"]).withColumn(
        "tokens", estimate_tokens("content")
    )


def ask(requests: DataFrame, model: Callable) -> DataFrame:
    """Add ``reply`` and ``used_tokens``; ``model(kind, content)`` returns both.

    A call that raises gives a row with ``failure`` and no reply, so the others go on.
    """

    def answer(kind, text):
        try:
            reply, tokens = model(kind, text)
            return reply, int(tokens), None
        except Exception as error:  # noqa: BLE001 - whatever the given model raises
            return None, 0, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [answer(kind, text) for kind, text in zip(batch["route"], batch["content"])]
            reply, tokens, failure = map(list, zip(*answers)) if answers else ([], [], [])
            yield batch.assign(
                reply=pd.Series(reply, batch.index, "object"), used_tokens=tokens,
                failure=pd.Series(failure, batch.index, "object"),
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{fields}, reply string, used_tokens long, failure string")


def with_parsed_reply(df: DataFrame, reply="reply") -> DataFrame:
    """Add ``summary, topics, key_points``, or ``error`` where the reply is not JSON.

    A reply may stand in a code fence.
    """
    fence = r"(?s)^```(?:json)?\s*\n?(.*?)\n?\s*```\z"
    schema = "summary string, topics array<string>, key_points array<string>"
    text = F.col("_text")
    return (
        df.withColumn("_text", trim_ws(reply))
        .withColumn(
            "_text", F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
        )
        .withColumn(
            "_valid",
            F.try_parse_json(text).isNotNull()
            & (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1),
        )
        .withColumn("_json", F.when(F.coalesce("_valid", F.lit(False)), F.from_json(text, schema)))
        .select(
            *df.columns,
            "_json.summary",
            "_json.topics",
            "_json.key_points",
            F.when(F.col("_json").isNull(), "reply is not JSON").alias("error"),
        )
    )


def _quoted(c) -> Column:
    """A JSON string literal; NULL becomes ``null``."""
    return F.coalesce(
        F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", ""), F.lit("null")
    )


def _listed(c) -> Column:
    items = F.array_join(F.transform(c, lambda v: F.concat(F.lit("    "), _quoted(v))), ",\n")
    return (
        F.when(F.col(c).isNull(), "null")
        .when(F.size(c) == 0, "[]")
        .otherwise(F.concat(F.lit("[\n"), items, F.lit("\n  ]")))
    )


def merge_input(parts: DataFrame) -> DataFrame:
    """Numbered sections of pretty-printed part summaries, for documents of several parts."""
    before, after = config.PART_HEADING
    section = F.concat(
        F.lit(before), (F.col("part") + 1).cast("string"), F.lit(after),
        F.lit('{\n  "summary": '), _quoted("summary"),
        F.lit(',\n  "topics": '), _listed("topics"),
        F.lit(',\n  "key_points": '), _listed("key_points"), F.lit("\n}"),
    )
    sections = F.array_sort(F.collect_list(F.struct("part", section.alias("s"))))
    return (
        parts.groupBy("document_id")
        .agg(F.count("*").alias("parts"), sections.alias("_sections"))
        .filter("parts > 1")
        .select(
            "document_id", "parts",
            F.array_join(F.transform("_sections", lambda s: s["s"]), "\n\n").alias("content"),
        )
    )


def token_totals(parts: DataFrame, by=("document_id",)) -> DataFrame:
    return parts.groupBy(*by).agg(
        F.sum("used_tokens").alias("total_tokens"), F.count("*").alias("requests")
    )
