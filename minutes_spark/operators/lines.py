"""Pages to lines, preamble and page assembly."""

import re

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions.text import WS, is_blank_or_number, is_separator, rtrim_ws
from ..sources.tables import durable

#: Rows of two values that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000

#: Bytes of page text for one task that sorts pages and their lines: some hundred MB of memory.
TASK_BYTES = 32_000_000


def raw_lines(pages: DataFrame) -> DataFrame:
    """Every line of every page: the page's other columns, ``line_no`` and ``line``."""
    rest = [c for c in pages.columns if c != "text"]
    return pages.select(
        *rest, F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line")
    ).filter(F.col("line").isNotNull())


def flatten_pages(pages: DataFrame, start="") -> DataFrame:
    """Lines without page numbers and blank lines; trailing whitespace is cut.

    With ``start`` only lines that start so, seen before anything else of a line is looked at.
    """
    lines = raw_lines(pages)
    if start:
        lines = raw_lines(pages.filter(F.contains("text", F.lit(start)))).filter(F.col("line").startswith(start))
    return lines.filter(~is_blank_or_number("line")).withColumn("line", rtrim_ws("line"))


def content_lines(pages: DataFrame, start="") -> DataFrame:
    return flatten_pages(pages, start).filter(~is_separator("line"))


def first_marked_pages(pages: DataFrame, marker=config.MARKER) -> DataFrame:
    """(document_id, first_page, bytes): each document's first page with a marker line, written once.

    ``bytes`` are those of the text of all its pages. Pages travel as numbers; whether a page is marked
    is seen from its text where it lies.
    """
    starts = rf"(?:^|\n)[{WS}]*{re.escape(marker)}"
    marked = F.contains("text", F.lit(marker)) & F.col("text").rlike(starts)
    # a condition inside the aggregate; as a filter it would be pushed below what makes the text
    firsts = pages.groupBy("document_id").agg(
        F.min(F.when(marked, F.col("page"))).alias("first_page"), F.sum(F.octet_length("text")).alias("bytes")
    )
    return durable(firsts.filter(F.col("first_page").isNotNull()), "first-marked-pages")


def preamble_lines(pages: DataFrame, marker=config.MARKER, firsts: DataFrame | None = None) -> DataFrame:
    """Lines before a document's first marker line; documents without one give nothing.

    ``firsts`` are the ``first_marked_pages``, by default found here: a stored table of three values
    a document. A page that starts with the marker gives no line, whichever page it is, and is left out.
    Up to ``BROADCAST_ROWS`` documents, pages behind the first marked one are dropped
    where they lie and no text is moved. Beyond that, marked pages are cut to the lines before
    their marker, and the rest is joined by document, in as many tasks as ``TASK_BYTES`` ask for: lines
    are sorted where they come out of the join, and a fixed number of tasks would hold ever more of them.
    """
    if firsts is None:
        firsts = first_marked_pages(pages, marker)
    behind = rf"(?s)(^|\n)([{WS}]*{re.escape(marker)}).*\z"
    cut = F.regexp_replace("text", behind, "$1$2")
    rows, size = firsts.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    firsts = firsts.select(F.col("document_id").alias("_document"), F.col("first_page").alias("_first"))
    pages = pages.filter(~F.col("text").startswith(marker))
    if rows <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    else:
        pages = pages.withColumn("text", cut)
        pages = pages.repartition(size // TASK_BYTES + 1, "document_id")
    on = (F.col("document_id") == F.col("_document")) & (F.col("page") <= F.col("_first"))
    # a cut text ends with its marker line; a page that stands twice may have none
    marked = (F.col("page") == F.col("_first")) & F.col("text").rlike(behind)
    return (
        pages.join(firsts, on)
        .withColumn("_marked", marked)
        .withColumn("_lines", F.split(F.when(F.col("_marked"), cut).otherwise(F.col("text")), "\n", -1))
        .withColumn("_lines", F.when(F.col("_marked"), F.slice("_lines", F.lit(1), F.size("_lines") - 1)).otherwise(F.col("_lines")))
        .select(
            *[c for c in pages.columns if c != "text"],
            F.posexplode_outer("_lines").alias("line_no", "line"),
        )
        .filter(F.col("line").isNotNull())
    )


def reconstruct_pages(items: DataFrame, gap=2.0) -> DataFrame:
    """Page text from positioned items ``(document_id, page, item, str, y)``.

    An item whose ``y`` is more than ``gap`` away from the one before starts a line. The
    page's text is one cell of the result, so the group is no larger than that cell.
    """
    items = items.groupBy("document_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("item", "y", "str"))).alias("_items")
    )
    pieces = F.transform(
        "_items",
        lambda item, at: F.when(
            F.abs(item["y"] - F.get("_items", at - 1)["y"]) > gap,
            F.concat(F.lit("\n"), item["str"]),
        ).otherwise(item["str"]),
    )
    return items.select("document_id", "page", F.array_join(pieces, "").alias("text"))
