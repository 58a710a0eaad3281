"""Table schemas and allowed codes of the minutes model."""

from pyspark.sql import types as T


def _table(**columns):
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_ts, _day, _b = T.TimestampType(), T.DateType(), T.BooleanType()
_strings = T.ArrayType(_s)

TABLES = {
    "municipalities": _table(
        municipality_id=_s, name_ja=_s, name_en=_s, prefecture_ja=_s, code_jis=_s,
        created_at=_ts, updated_at=_ts),
    "sources": _table(
        source_id=_s, municipality_id=_s, source_type=_s, title=_s, url=_s, is_active=_b,
        created_at=_ts, updated_at=_ts),
    "sessions": _table(
        session_id=_s, municipality_id=_s, fiscal_year=_i, session_name=_s, session_type=_s,
        held_on=_day, start_on=_day, end_on=_day, created_at=_ts, updated_at=_ts),
    "documents": _table(
        document_id=_s, municipality_id=_s, source_id=_s, session_id=_s, document_type=_s,
        title=_s, url=_s, published_on=_day, document_version=_s, status=_s,
        created_at=_ts, updated_at=_ts),
    "document_assets": _table(
        document_id=_s, storage_provider=_s, storage_path=_s, content_sha256=_s,
        content_type=_s, bytes=_l, downloaded_at=_ts),
    "document_summaries": _table(
        document_id=_s, summary_text=_s, topics=_strings, key_points=_strings, model_id=_s,
        token_count=_i, created_at=_ts),
    "speakers": _table(
        speaker_id=_s, municipality_id=_s, name_ja=_s, role=_s, party=_s,
        term_start_on=_day, term_end_on=_day, created_at=_ts, updated_at=_ts),
    "speaker_aliases": _table(
        alias_id=_s, municipality_id=_s, speaker_id=_s, alias_raw=_s, alias_norm=_s,
        alias_type=_s, confidence=_d, created_at=_ts, updated_at=_ts),
    "speeches": _table(
        speech_id=_s, municipality_id=_s, document_id=_s, session_id=_s, speaker_id=_s, speaker_name_raw=_s,
        sequence=_i, speech_text=_s, speech_text_clean=_s, page_start=_i, page_end=_i,
        confidence=_d, created_at=_ts, document_bucket=_i),
    "speech_counts": _table(
        municipality_id=_s, document_id=_s, speaker_id=_s, speeches=_l, document_bucket=_i),
    "word_frequencies": _table(
        municipality_id=_s, word=_s, reading=_s, part_of_speech=_s, count=_l, created_at=_ts),
    "ingestion_runs": _table(
        run_id=_s, municipality_id=_s, started_at=_ts, finished_at=_ts, trigger=_s,
        status=_s, log=_s),
    "pages": _table(document_id=_s, page=_i, text=_s),
}

UNIQUE_KEYS = {
    "municipalities": ("prefecture_ja", "name_ja"),
    "documents": ("url",),
    "document_assets": ("document_id",),
    "document_summaries": ("document_id",),
    "speakers": ("municipality_id", "name_ja"),
    "speaker_aliases": ("municipality_id", "alias_norm"),
    "speeches": ("document_id", "sequence"),
    "word_frequencies": ("municipality_id", "word"),
}

PARTITIONED_BY = {
    "documents": ("municipality_id",),
    "speeches": ("municipality_id", "document_bucket"),
    "speech_counts": ("municipality_id", "document_bucket"),
    "word_frequencies": ("municipality_id",),
}

#: Tables with a bucket column by a hash of the document: column and number of buckets. One document is
#: read from, and replaced in, one bucket of its municipality.
BUCKETS = {"speeches": ("document_bucket", 16), "speech_counts": ("document_bucket", 16)}

CODES = {
    "source_type": ("assembly_minutes", "committee_minutes", "public_comment", "other"),
    "session_type": ("regular", "extra", "committee", "budget_committee", "other"),
    "document_type": ("minutes", "committee_minutes", "public_comment", "report", "other"),
    "document_status": ("discovered", "downloaded", "extracted", "parsed", "failed"),
    "storage_provider": ("supabase_storage", "s3", "local", "other"),
    "speaker_role": ("councilor", "mayor", "executive", "chair", "staff", "unknown"),
    "alias_type": ("attendee_derived", "speech_derived", "manual"),
    "trigger": ("manual", "schedule", "webhook"),
    "run_status": ("success", "partial", "failed"),
}

#: Columns whose values are codes.
CODED = {
    "sources": {"source_type": "source_type"},
    "sessions": {"session_type": "session_type"},
    "documents": {"document_type": "document_type", "status": "document_status"},
    "document_assets": {"storage_provider": "storage_provider"},
    "speakers": {"role": "speaker_role"},
    "speaker_aliases": {"alias_type": "alias_type"},
    "ingestion_runs": {"trigger": "trigger", "status": "run_status"},
}
