"""Reports over the minutes tables.

Every report covers all municipalities at once; ``municipality_id`` narrows it to one and is
pushed down to the scans. Counts are taken before joins, so that a hot document or speaker is
reduced on the map side. Ties are broken by a unique column. Where the tables hold
``speech_counts`` (``kept_counts`` of the speeches), the reports that only count speeches read
these and no speech.
"""

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, functions as F

from .. import config, schemas
from ..functions.text import (
    display_name,
    display_role,
    era_label,
    head_topics,
    in_preparation,
    session_label,
    speech_preview,
    topic_label,
)
from ..operators.scan import top_per_group

MUNICIPALITY = "municipality_id"


def _of(df: DataFrame, municipality_id) -> DataFrame:
    return df if municipality_id is None else df.filter(F.col(MUNICIPALITY) == municipality_id)


class Tables(SimpleNamespace):
    """Tables by name, as the reports read them."""

    def with_tables(self, **given: DataFrame) -> "Tables":
        return Tables(**{**vars(self), **given})


def _speeches(t, municipality_id) -> DataFrame:
    """Speeches; where they carry their municipality (as stored ones do), only its partition."""
    return _of(t.speeches, municipality_id if MUNICIPALITY in t.speeches.columns else None)


def kept_counts(speeches: DataFrame, *by) -> DataFrame:
    """Speeches per document and speaker (and ``by``), the state the counting reports go on from.

    Speeches without a speaker are a row of their document.
    """
    return speeches.groupBy(MUNICIPALITY, "document_id", "speaker_id", *by).agg(F.count("*").alias("speeches"))


def _counted(t, municipality_id) -> DataFrame:
    """Rows to be counted with the number of speeches they stand for: kept counts, else speeches."""
    kept = getattr(t, "speech_counts", None)
    if kept is not None:
        return _of(kept, municipality_id)
    return _speeches(t, municipality_id).withColumn("speeches", F.lit(1).cast("long"))


def speech_counts(counted: DataFrame) -> DataFrame:
    return counted.groupBy("document_id").agg(F.sum("speeches").alias("speech_count"))


def _count(column) -> Column:
    return F.coalesce(column, F.lit(0)).alias(column)


def dashboard_stats(t, municipality_id=None) -> DataFrame:
    """Documents, speeches, speakers and summaries per municipality, with coverage in %."""
    documents = _of(t.documents, municipality_id)
    per_document = (
        documents.select("document_id", MUNICIPALITY)
        .join(speech_counts(_counted(t, municipality_id)), "document_id", "left")
        .join(t.summaries.select("document_id", F.lit(1).alias("_summary")), "document_id", "left")
        .groupBy(MUNICIPALITY)
        .agg(
            F.count("*").alias("documents"),
            F.coalesce(F.sum("speech_count"), F.lit(0)).alias("speeches"),
            F.count("_summary").alias("summaries"),
        )
    )
    speakers = _of(t.speakers, municipality_id).groupBy(MUNICIPALITY).agg(
        F.count("*").alias("speakers")
    )
    return (
        _of(t.municipalities, municipality_id)
        .select(MUNICIPALITY)
        .join(per_document, MUNICIPALITY, "left")
        .join(speakers, MUNICIPALITY, "left")
        .select(
            MUNICIPALITY, _count("documents"), _count("speeches"), _count("speakers"), _count("summaries")
        )
    )


def summary_coverage(stats: DataFrame) -> DataFrame:
    share = F.round(F.lit(100) * F.col("summaries") / F.col("documents")).cast("int")
    return stats.select(
        MUNICIPALITY, F.when(F.col("documents") == 0, 0).otherwise(share).alias("coverage")
    )


def recent_documents(t, municipality_id=None, limit=10) -> DataFrame:
    """Newest documents with summary, all topics, the first ones and number of speeches."""
    newest = top_per_group(
        _of(t.documents, municipality_id), [MUNICIPALITY],
        [F.desc("created_at"), F.desc("document_id")], limit, rank="rank",
    )
    return (
        newest.join(t.summaries.select("document_id", "summary_text", "topics"), "document_id", "left")
        .join(
            # only the chosen documents' speeches are counted
            speech_counts(
                _counted(t, municipality_id).join(newest.select("document_id"), "document_id", "left_semi")
            ),
            "document_id", "left",
        )
        .select(
            MUNICIPALITY, "rank", "document_id", "title", "created_at", "summary_text",
            F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
            head_topics(F.coalesce("topics", F.array().cast("array<string>"))).alias("head_topics"),
            _count("speech_count"),
        )
    )


def _topics(t, municipality_id) -> DataFrame:
    return t.summaries.select("document_id", "topics").join(
        _of(t.documents, municipality_id).select("document_id", MUNICIPALITY, "session_id"), "document_id"
    )


def topic_frequencies(t, municipality_id=None, limit=15) -> DataFrame:
    counts = (
        _topics(t, municipality_id)
        .select(MUNICIPALITY, F.explode("topics").alias("topic"))
        .groupBy(MUNICIPALITY, "topic")
        .agg(F.count("*").alias("count"))
    )
    return top_per_group(
        counts, [MUNICIPALITY], [F.desc("count"), "topic"], limit, rank="rank"
    ).withColumn("label", topic_label("topic"))


def speaker_ranking(t, municipality_id=None, limit=15) -> DataFrame:
    """Speakers by number of speeches, those without any included."""
    counts = (
        _counted(t, municipality_id)
        .filter(F.col("speaker_id").isNotNull())
        .groupBy("speaker_id")
        .agg(F.sum("speeches").alias("count"))
    )
    ranked = (
        _of(t.speakers, municipality_id)
        .join(counts, "speaker_id", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
    )
    return top_per_group(
        ranked, [MUNICIPALITY], [F.desc("count"), "speaker_id"], limit, rank="rank"
    ).select(MUNICIPALITY, "rank", F.col("name_ja").alias("name"), "role", "count")


def speaker_stats(t, municipality_id=None, limit=30) -> DataFrame:
    return speaker_ranking(t, municipality_id, limit)


def _year_topics(t, municipality_id) -> DataFrame:
    """Topic counts per fiscal year; a year with summaries but no topics has one NULL topic."""
    years = t.sessions.select("session_id", "fiscal_year").filter(F.col("fiscal_year") != 0)
    return (
        _topics(t, municipality_id)
        .filter(F.col("topics").isNotNull())
        .join(years, "session_id")
        .select(MUNICIPALITY, "fiscal_year", F.explode_outer("topics").alias("topic"))
        .groupBy(MUNICIPALITY, "fiscal_year", "topic")
        .agg(F.count("topic").alias("count"))
    )


def _top_topics(counts: DataFrame, top) -> DataFrame:
    return top_per_group(
        counts.filter(F.col("topic").isNotNull())
        .groupBy(MUNICIPALITY, "topic")
        .agg(F.sum("count").alias("total")),
        [MUNICIPALITY], [F.desc("total"), "topic"], top, rank="rank",
    )


def topic_trends(t, municipality_id=None, top=8) -> DataFrame:
    """Counts of the overall top topics for every fiscal year, zeros included."""
    counts = _year_topics(t, municipality_id)
    grid = counts.select(MUNICIPALITY, "fiscal_year").distinct().join(
        _top_topics(counts, top).select(MUNICIPALITY, "rank", "topic"), MUNICIPALITY
    )
    return grid.join(
        counts.filter(F.col("topic").isNotNull()), [MUNICIPALITY, "fiscal_year", "topic"], "left"
    ).select(
        MUNICIPALITY, "fiscal_year", era_label("fiscal_year").alias("year"), "rank", "topic", _count("count")
    )


def topic_trends_pivot(t, municipality_id=None, top=8) -> DataFrame:
    """One row per fiscal year and one column per rank: ``topic_1`` is the most frequent."""
    counts = _year_topics(t, municipality_id)
    ranked = counts.join(
        _top_topics(counts, top).select(MUNICIPALITY, "rank", "topic"), [MUNICIPALITY, "topic"], "left"
    )
    columns = [
        F.coalesce(F.sum(F.when(F.col("rank") == at, F.col("count"))), F.lit(0)).alias(f"topic_{at}")
        for at in range(1, top + 1)
    ]
    return (
        ranked.groupBy(MUNICIPALITY, "fiscal_year")
        .agg(*columns)
        .withColumn("year", era_label("fiscal_year"))
    )


def document_list(t, municipality_id=None, fiscal_year=None, session_type=None) -> DataFrame:
    """Documents with session, summary and speech count, newest first.

    An unknown session type is ignored.
    """
    documents, sessions = _of(t.documents, municipality_id), t.sessions.drop(MUNICIPALITY)
    how = "left"
    if fiscal_year:
        sessions, how = sessions.filter(F.col("fiscal_year") == fiscal_year), "inner"
    if session_type in schemas.CODES["session_type"]:
        sessions, how = sessions.filter(F.col("session_type") == session_type), "inner"
    return (
        documents.join(sessions, "session_id", how)
        .join(t.summaries.select("document_id", "summary_text", "topics"), "document_id", "left")
        .join(speech_counts(_counted(t, municipality_id)), "document_id", "left")
        .select(
            MUNICIPALITY, "document_id", "title", "status", "created_at", "fiscal_year",
            "session_name", "session_type", session_label("session_type").alias("session_label"),
            "summary_text", "topics", _count("speech_count"),
        )
        .orderBy(F.desc("created_at"), F.desc("document_id"))
    )


def document_header(t, municipality_id, document_id) -> DataFrame:
    """Document, session and summary; empty if the document belongs to another municipality."""
    return (
        _of(t.documents, municipality_id)
        .filter(F.col("document_id") == document_id)
        .join(t.sessions.drop(MUNICIPALITY), "session_id", "left")
        .join(t.summaries.drop("created_at"), "document_id", "left")
    )


def document_speeches(t, municipality_id, document_id) -> DataFrame:
    """One document with session, summary and key points, and its speeches with their pages, in order.

    ``t.speeches`` should be read for the document alone (``read_table`` with its id). A document of
    another municipality gives nothing.
    """
    header = document_header(t, municipality_id, document_id).select(
        MUNICIPALITY, "document_id", "title", "status", "fiscal_year", "session_name", "session_type",
        "summary_text", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "key_points",
    )
    spoken, nobody = _by_speaker(t.speeches.drop(MUNICIPALITY, "session_id"), t.speakers)
    return (
        header.join(spoken.unionByName(nobody), "document_id", "left")
        .select(
            *header.columns, "sequence",
            display_name("name_ja", "speaker_name_raw").alias("name"), display_role("role").alias("role"),
            "speech_text", "page_start", "page_end",
        )
        .orderBy("sequence")
    )


def _by_speaker(rows: DataFrame, speakers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their speaker's name and role, and rows without a speaker, which need no join."""
    names = speakers.select("speaker_id", "name_ja", "role")
    known = rows.filter(F.col("speaker_id").isNotNull()).join(names, "speaker_id", "left")
    nobody = rows.filter(F.col("speaker_id").isNull()).withColumns(
        {c: F.lit(None).cast(names.schema[c].dataType) for c in ("name_ja", "role")}
    )
    return known, nobody


def document_detail(t, municipality_id=None, document_id=None) -> DataFrame:
    """Speeches with their whole text and speaker, below the document's title, session and summary.

    The speeches of one document come in order; of all documents they are not sorted.
    """
    documents = _of(t.documents, municipality_id)
    if document_id is not None:
        documents = documents.filter(F.col("document_id") == document_id)
    sessions = t.sessions.select("session_id", "fiscal_year", "session_type")
    spoken, nobody = _by_speaker(_speeches(t, municipality_id).drop(MUNICIPALITY, "session_id"), t.speakers)
    detail = (
        documents.select(MUNICIPALITY, "document_id", "session_id", "title", "status")
        .join(sessions, "session_id", "left")
        .join(t.summaries.select("document_id", "summary_text", "topics"), "document_id", "left")
        .join(spoken.unionByName(nobody), "document_id", "left")
        .select(
            MUNICIPALITY, "document_id", "title", "status", "fiscal_year", "session_type", "summary_text",
            F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "sequence",
            display_name("name_ja", "speaker_name_raw").alias("name"),
            display_role("role").alias("role"),
            "speech_text",
            speech_preview("speech_text").alias("preview"),
        )
    )
    return detail if document_id is None else detail.orderBy("sequence")


def speaker_breakdown(t, municipality_id=None, document_id=None) -> DataFrame:
    """Speeches per speaker of a document; an unknown speaker is a row of its own.

    The speakers of one document come in order; of all documents they are not sorted.
    """
    documents = _of(t.documents, municipality_id)
    if document_id is not None:
        documents = documents.filter(F.col("document_id") == document_id)
    counts = (
        _counted(t, municipality_id).groupBy("document_id", "speaker_id").agg(F.sum("speeches").alias("count"))
        .join(documents.select("document_id", MUNICIPALITY), "document_id")
    )
    known, nobody = _by_speaker(counts, t.speakers)
    breakdown = known.unionByName(nobody).select(
        MUNICIPALITY, "document_id", "speaker_id",
        F.coalesce("name_ja", F.lit(config.UNKNOWN_SPEAKER)).alias("name"),
        display_role("role").alias("role"), "count",
    )
    return breakdown if document_id is None else breakdown.orderBy(F.desc("count"), "speaker_id")


def fiscal_years(t, municipality_id=None) -> DataFrame:
    return (
        _of(t.sessions, municipality_id)
        .select(MUNICIPALITY, "fiscal_year")
        .distinct()
        .orderBy(MUNICIPALITY, F.desc("fiscal_year"))
    )


def session_types(t, municipality_id=None) -> DataFrame:
    return (
        _of(t.sessions, municipality_id)
        .select(MUNICIPALITY, "session_type", session_label("session_type").alias("label"))
        .distinct()
    )


def municipality_list(t) -> DataFrame:
    documents = t.documents.groupBy(MUNICIPALITY).agg(F.count("*").alias("document_count"))
    speakers = t.speakers.groupBy(MUNICIPALITY).agg(F.count("*").alias("speaker_count"))
    return (
        t.municipalities.join(documents, MUNICIPALITY, "left")
        .join(speakers, MUNICIPALITY, "left")
        .select(
            MUNICIPALITY, "name_ja", "name_en", "prefecture_ja",
            _count("document_count"), _count("speaker_count"),
            in_preparation(F.coalesce("document_count", F.lit(0))).alias("in_preparation"),
        )
        .orderBy("name_ja", MUNICIPALITY)
    )


def municipality_by_id(t, ids) -> DataFrame:
    """The municipalities named by one id, or by the ids of a DataFrame."""
    if not isinstance(ids, DataFrame):
        return _of(t.municipalities, ids)
    return t.municipalities.join(ids.select(MUNICIPALITY), MUNICIPALITY, "left_semi")


def pending_documents(t) -> DataFrame:
    """Downloaded documents; without an asset they are skipped."""
    return (
        t.documents.filter(F.col("status") == "downloaded")
        .join(t.assets.select("document_id", "storage_path", "content_sha256"), "document_id", "left")
        .withColumn("outcome", F.when(F.col("storage_path").isNull(), "skipped").otherwise("pending"))
    )


def parsed_documents(t, limit=None) -> DataFrame:
    """Parsed documents, oldest first; those without speeches have nothing to summarise."""
    documents = (
        t.documents.filter(F.col("status") == "parsed")
        .select(MUNICIPALITY, "document_id", "title", "created_at")
    )
    speeches = _counted(t, None)
    if limit:
        documents = documents.orderBy("created_at", "document_id").limit(limit)
        # only the chosen documents' speeches are counted
        speeches = speeches.join(documents.select("document_id"), "document_id", "left_semi")
    return (
        documents.join(speech_counts(speeches), "document_id", "left")
        .select(MUNICIPALITY, "document_id", "title", "created_at", _count("speech_count"))
        .orderBy("created_at", "document_id")
    )


def unsummarized_documents(t, limit=None) -> DataFrame:
    """Parsed documents that have no summary yet, oldest first."""
    left = t.documents.join(t.summaries.select("document_id"), "document_id", "left_anti")
    return parsed_documents(t.with_tables(documents=left), limit)


def speeches_to_summarize(t, documents: DataFrame) -> DataFrame:
    """The speeches of the chosen documents, each with its number in the document.

    ``summaries.request_table`` puts them into order.
    """
    return t.speeches.join(
        documents.select("document_id"), "document_id", "left_semi"
    ).select("document_id", "sequence", "speaker_name_raw", "speech_text")
