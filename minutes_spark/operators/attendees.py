"""Attendee list of the preamble."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import config
from ..functions.names import (
    family_from_compact,
    family_from_spaced,
    role_pattern,
    with_person_name,
)
from ..functions.text import CJK, WS, normalize_alias, trim_ws, zen_to_han
from ..sources.tables import durable
from .lines import first_marked_pages, preamble_lines
from .scan import BLOCK, MULTI, kept, page_blocks, running

NO_SECTION = "-"
COLUMNS = (
    "document_id", "page", "line_no", "pos",
    "full_name", "family_name", "role", "seat_number", "category",
)
#: What attendees may know of their document.
CARRIED = ("municipality_id", "created_at")


def with_section_event(lines: DataFrame, headers=config.SECTION_HEADERS) -> DataFrame:
    """Add ``section_event``: a section code, ``-`` where a numbered heading ends one, or NULL."""
    line = F.col("line")

    def holds(*letters):
        return reduce(Column.__and__, [F.contains(line, F.lit(letter)) for letter in letters], F.lit(True))

    event = F.when(holds("．") & line.rlike(r"^[０-９" + WS + r"]*[３-９]．"), F.lit(NO_SECTION))
    for text, code in reversed(headers):
        # most lines lack a letter of the header, which is seen before whitespace is taken out
        event = F.when(holds(*text) & F.contains(normalize_alias(line), F.lit(text)), F.lit(code)).otherwise(event)
    return lines.withColumn("section_event", event)


def attendee_sections(
    pages: DataFrame, headers=config.SECTION_HEADERS, block=None
) -> DataFrame:
    """Trimmed preamble lines with the ``section`` they stand in (NULL outside of any)."""
    block = page_blocks(block)
    firsts = first_marked_pages(pages)
    # only a preamble that ends behind block 0 hands its section on
    long = firsts.withColumnRenamed("first_page", "page").filter(block > 0).select("document_id")
    lines = (
        preamble_lines(pages, firsts=firsts)
        .withColumn("line", trim_ws("line"))
        .filter(F.length("line") > 0)
    )
    return (
        running(
            with_section_event(lines, headers),
            ["document_id"],
            ["page", "line_no"],
            block,
            lasts={"section": "section_event"},
            long=long,
        )
        .withColumn("section", F.nullif("section", F.lit(NO_SECTION)))
        .drop(BLOCK, MULTI)
    )


def parse_lines(lines: DataFrame, roles=config.ATTENDEE_ROLES) -> DataFrame:
    """Attendees of section lines with ``line``, ``category`` and a boolean ``seated``.

    Lists repeat from session to session, so each different line is parsed once. The lines and what
    they say are written, and joined by sizes that are known then.
    """
    said = ["line", "category", "seated"]
    carried = [c for c in CARRIED if c in lines.columns]
    lines = durable(lines.select("document_id", "page", "line_no", *carried, *said), "list-lines")
    entries = durable(line_entries(lines.select(*said).distinct(), roles), "line-entries")
    return lines.join(entries, said).select(*COLUMNS, *carried)


def line_entries(lines: DataFrame, roles=config.ATTENDEE_ROLES) -> DataFrame:
    """``lines`` with a row for each attendee they name.

    A seated line holds seat numbers and spaced names. Any other line alternates roles and
    names; the longest role at the leftmost position counts.
    """
    cut = rf"([{CJK}][{WS}]*)(?=[０-９])"
    seat = rf"(?s)^.*?([０-９{WS}]+)番(.*)\z"
    pattern = role_pattern(roles)

    # a post is its role and, behind a tab, the text up to the next one; without whitespace, no text has tabs
    seats = F.split(F.regexp_replace("line", cut, "$1\n"), "\n", -1)
    posts = F.split(F.regexp_replace(normalize_alias("line"), f"({pattern})", "\n$1\t"), "\n", -1)
    seated, entry = F.col("seated"), F.col("_entry")
    # outer: the filter on an array's size that goes with a plain one computes the array twice
    entries = (
        lines.withColumn("_entries", F.when(seated, seats).otherwise(posts))
        .select(*lines.columns, F.posexplode_outer("_entries").alias("_at", "_entry"))
        .withColumn("pos", F.when(seated, F.col("_at")).otherwise(F.col("_at") - 1))
        .filter(F.col("pos") >= 0)
        .withColumn("role", F.when(seated, config.COUNCILOR_ROLE).otherwise(F.substring_index(entry, "\t", 1)))
        .withColumn("_text", F.when(seated, trim_ws(entry)))
        .withColumn("_seat", F.regexp_extract("_text", seat, 1))
        .withColumn("_spaced", F.regexp_extract("_text", seat, 2))
        .withColumn("_raw", F.when(~seated, F.substring_index(entry, "\t", -1)))
    )
    # text without a seat has no name either
    return (
        kept(
            with_person_name(entries, "_raw", "_person", roles=roles).withColumn(
                "full_name", F.coalesce(normalize_alias("_spaced"), "_person")
            ),
            F.length("full_name") >= 2,
        )
        .withColumn(
            "family_name",
            F.when(seated, family_from_spaced("_spaced")).otherwise(family_from_compact("_person")),
        )
        .withColumn("seat_number", zen_to_han(normalize_alias("_seat")).try_cast("int"))
        .select(*lines.columns, "pos", "full_name", "family_name", "role", "seat_number")
    )


def parse_attendees(pages: DataFrame, documents: DataFrame | None = None, **options) -> DataFrame:
    """Attendees of each document; (page, line_no, pos) is their order in the list.

    With ``documents``, those of these documents, with ``CARRIED`` of their document: their lists' lines
    meet it, which are fewer and lie together by document.
    """
    numbered = F.col("line").rlike("[０-９]") & F.contains("line", F.lit("番"))
    lines = attendee_sections(pages, **options).filter(F.col("section").isNotNull() & F.col("section_event").isNull())
    if documents is not None:
        lines = lines.join(documents.select("document_id", *CARRIED), "document_id")
    return parse_lines(
        lines
        .withColumn("category", F.col("section"))
        .withColumn("seated", (F.col("section") == "councilor") & numbered)
    )


def suspicious_attendees(attendees: DataFrame, longest=5) -> DataFrame:
    """Attendees and names longer than ``longest`` characters, counted per document."""
    return attendees.groupBy("document_id").agg(
        F.count("*").alias("attendees"),
        F.count(F.when(F.length("full_name") > longest, 1)).alias("suspicious"),
    )


def unique_families(attendees: DataFrame) -> DataFrame:
    """Family names that stand once in a document's list; rows count, not people."""
    carried = [c for c in ("municipality_id", "speaker_id") if c in attendees.columns]
    return (
        attendees.groupBy("document_id", "family_name")
        .agg(
            F.count("*").alias("_n"),
            *[F.min(c).alias(c) for c in carried],
            F.min("full_name").alias("full_name"),
        )
        .filter("_n = 1")
        .drop("_n")
    )
