"""Segmentation of lines into speeches."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..functions.names import with_speaker_match, with_speaker_name
from ..functions.text import trim_ws
from .lines import content_lines
from .scan import BLOCK, kept, long_keys, page_blocks


def segment(lines: DataFrame, block: Column, long: DataFrame) -> DataFrame:
    """Join the lines from one marker to the next into ``speech_text``, numbered per document.

    ``lines`` has ``document_id, page, line_no, piece``, a boolean ``is_marker`` and, on marker
    lines, ``speaker_name_raw``. Lines before the first marker and segments without text are
    dropped. Lines are shuffled once, by document and ``block`` (see ``page_blocks``), and a block
    is cut at its markers in place. What runs over the end of a block, and how many speeches
    stand in earlier blocks, is looked up for the documents in ``long`` only (see ``long_keys``).
    """
    handed_on = _handed_on(_cut(lines.join(long, "document_id", "left_semi"), block))
    found = _cut(lines, block).join(handed_on, ["document_id", BLOCK], "left")
    continued = F.transform(
        "_segments",
        lambda s, at: F.when(
            F.col("_more").isNotNull() & (at == F.size("_segments") - 1),
            s.withField("page_end", F.greatest(s["page_end"], "_more_end")).withField(
                "speech_text", trim_ws(F.concat_ws("\n", F.nullif(s["speech_text"], F.lit("")), "_more"))
            ),
        ).otherwise(s),
    )
    spoken = F.filter(continued, lambda s: F.length(s["speech_text"]) > 0)
    numbers = found.select("document_id", "_earlier", F.posexplode(spoken).alias("_at", "_speech"))
    sequence = (F.coalesce("_earlier", F.lit(0)) + F.col("_at")).cast("int")
    return numbers.select("document_id", "_speech.*", sequence.alias("sequence"))


def _joined(lines) -> Column:
    return F.array_join(F.filter(F.transform(lines, lambda x: x["piece"]), lambda p: F.length(p) > 0), "\n")


def _cut(lines: DataFrame, block: Column) -> DataFrame:
    """A row for each (document, block): the lines before the first marker, and the segments."""
    parts = ("page", "line_no", "is_marker", "speaker_name_raw", "piece")
    blocks = lines.groupBy("document_id", block.alias(BLOCK)).agg(
        F.array_sort(F.collect_list(F.struct(*parts))).alias("_lines")
    )
    starts = F.filter(
        F.transform("_lines", lambda x, at: F.when(x["is_marker"], at)), lambda at: at.isNotNull()
    )
    held = F.transform(
        "_starts",
        lambda start, at: F.slice(
            "_lines", start + 1, F.coalesce(F.get("_starts", at + 1), F.size("_lines")) - start
        ),
    )
    segments = F.transform(
        "_held",
        lambda part: F.struct(
            part[0]["speaker_name_raw"].alias("speaker_name_raw"),
            part[0]["page"].alias("page_start"),
            F.element_at(part, -1)["page"].alias("page_end"),
            trim_ws(_joined(part)).alias("speech_text"),
        ),
    )
    return (
        blocks.withColumn("_starts", starts)
        .withColumn("_held", held)
        .withColumn("_head", F.slice("_lines", F.lit(1), F.coalesce(F.get("_starts", 0), F.size("_lines"))))
        .select("document_id", BLOCK, "_head", segments.alias("_segments"))
    )


def _handed_on(blocks: DataFrame) -> DataFrame:
    """Per block with a marker: text and last page that follow in later blocks, speeches before it.

    A head belongs to the last marker before it: both get the number of marked blocks up to that
    marker, so that one small aggregate brings them together.
    """
    has = F.transform("_segments", lambda s: F.length(s["speech_text"]) > 0)
    blocks = blocks.select(
        "document_id", BLOCK,
        _joined("_head").alias("_text"),
        F.get("_head", F.size("_head") - 1)["page"].alias("_page"),
        (F.size("_segments") > 0).alias("_marked"),
        F.get(has, F.size(has) - 1).alias("_open"),
        F.size(F.filter(F.slice(has, F.lit(1), F.greatest(F.size(has) - 1, F.lit(0))), lambda x: x)).alias("_inner"),
    )
    by_block = Window.partitionBy("document_id").orderBy(BLOCK)
    before = F.coalesce(
        F.sum(F.col("_marked").cast("int")).over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    head = F.struct(
        F.col("_before").alias("group"), F.lit(None).cast("long").alias("owner"),
        F.lit(None).cast("boolean").alias("open"), F.lit(None).cast("int").alias("inner"),
        F.when(F.length("_text") > 0, F.struct(BLOCK, "_text")).alias("head"), F.col("_page").alias("page"),
    )
    own = F.struct(
        (F.col("_before") + 1).alias("group"), F.col(BLOCK).alias("owner"),
        F.col("_open").alias("open"), F.col("_inner").alias("inner"),
        F.lit(None).cast(f"struct<{BLOCK}:long,_text:string>").alias("head"), F.lit(None).cast("int").alias("page"),
    )
    entries = F.when(F.col("_marked"), F.array(head, own)).otherwise(F.array(head))
    groups = (
        blocks.withColumn(BLOCK, F.col(BLOCK).cast("long"))
        .withColumn("_page", F.col("_page").cast("int"))
        .withColumn("_before", before)
        .select("document_id", F.inline(entries))
        .groupBy("document_id", "group")
        .agg(
            F.max("owner").alias(BLOCK),
            (F.max("inner") + (F.max("open") | (F.count("head") > 0)).cast("int")).alias("_speeches"),
            F.array_join(F.transform(F.array_sort(F.collect_list("head")), lambda h: h["_text"]), "\n").alias("_more"),
            F.max(F.when(F.col("head").isNotNull(), F.col("page"))).alias("_more_end"),
        )
        .filter(F.col(BLOCK).isNotNull())
    )
    earlier = Window.partitionBy("document_id").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    return groups.select(
        "document_id", BLOCK, F.nullif("_more", F.lit("")).alias("_more"), "_more_end",
        F.coalesce(F.sum("_speeches").over(earlier), F.lit(0)).alias("_earlier"),
    )


def speaker_lines(pages: DataFrame, roles=config.SPEECH_ROLES) -> DataFrame:
    """Content lines with ``is_marker`` set where a speaker is named."""
    lines = with_speaker_match(content_lines(pages), roles=roles)
    return lines.withColumn("is_marker", F.col("speaker_name_raw").isNotNull())


def named_lines(pages: DataFrame, roles=config.SPEECH_ROLES, marker=config.MARKER) -> DataFrame:
    """Only the lines that name a speaker, with the name split; nothing is shuffled."""
    marked = content_lines(pages, marker).filter(F.col("line").startswith(marker))
    named = with_speaker_match(marked, roles=roles, marker=marker)
    return with_speaker_name(
        kept(named, F.col("speaker_name_raw").isNotNull()), roles=roles
    )


def _pieces(lines: DataFrame) -> DataFrame:
    said = F.when(F.col("is_marker"), F.col("rest")).otherwise(F.col("line"))
    return lines.select("document_id", "page", "line_no", "is_marker", "speaker_name_raw", said.alias("piece"))


def spoken_names(pages: DataFrame, roles=config.SPEECH_ROLES, block=None) -> DataFrame:
    """The speeches of ``parse_speeches`` with their names but without text, numbers and pages.

    Lines are shuffled as flags: whether they start a speech, and whether they have text.
    """
    flags = _pieces(speaker_lines(pages, roles)).withColumn(
        "piece", F.when(F.length(trim_ws("piece")) > 0, "x").otherwise("")
    )
    block = page_blocks(block)
    spoken = segment(flags, block, long_keys(pages, block)).select("document_id", "speaker_name_raw")
    return with_speaker_name(spoken, roles=roles)


def parse_speeches(pages: DataFrame, roles=config.SPEECH_ROLES, block=None) -> DataFrame:
    """Speeches of all documents, numbered from 0 in each."""
    block = page_blocks(block)
    speeches = segment(_pieces(speaker_lines(pages, roles)), block, long_keys(pages, block))
    return with_speaker_name(speeches, roles=roles)


def segment_by_marker(pages: DataFrame, marker: str, block=None) -> DataFrame:
    """Segmentation by a regex instead of the speaker rules; a marker line is text as well."""
    block = page_blocks(block)
    marked = content_lines(pages).select(
        "document_id", "page", "line_no", F.col("line").rlike(marker).alias("is_marker"),
        F.lit("").alias("speaker_name_raw"), F.col("line").alias("piece"),
    )
    return segment(marked, block, long_keys(pages, block)).drop("speaker_name_raw")
