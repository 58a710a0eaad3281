"""Whole jobs: page text to stored speeches, word lists, and summaries.

A job reads one snapshot of the tables (``source``) and writes the changed tables to another
(``target``), so it can be run again after a failure at any point.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import config
from ..operators import attendees as A, resolve, speakers as S, speeches as P, state, summaries as G
from ..functions.urls import local_url, title_from_filename
from ..operators import words as W
from ..schemas import PARTITIONED_BY, TABLES
from ..sources.tables import (
    changed_files, check_keys, conform, durable, file_digests, list_files, open_file, read_table,
    replace_partitions, write_partitions, write_table,
)
from . import marts

#: Rows of a bucketed table, stored and new ones, for one task: some hundred MB.
ROWS_PER_TASK = 500_000


def extract(pages: DataFrame, documents: DataFrame, speakers: DataFrame, aliases: DataFrame, block=None):
    """New speakers, aliases, speeches and outcomes of the given documents' pages.

    Returns a dict of DataFrames. Attendees, alias spans and names are read by several steps
    and are small next to the text, so they are written once.
    """
    block = P.page_blocks(block)
    attendees = durable(
        S.with_speaker_ids(A.parse_attendees(pages, documents, block=block), documents, speakers), "attendees"
    )
    history = durable(S.alias_history(aliases, S.derive_aliases(attendees)), "aliases")
    names = durable(resolve.speech_names(P.named_lines(pages), documents), "names")
    speeches = resolve.resolve_speakers(
        P.parse_speeches(pages, block=block), documents, attendees, history, names
    )
    return {
        "speakers": S.upsert_speakers(speakers, S.incoming_speakers(attendees)),
        "speaker_aliases": S.alias_dictionary(history).withColumn(
            "alias_id", S.natural_id("municipality_id", "alias_norm")
        ),
        "speeches": speeches,
    }


def outcomes(documents: DataFrame, assets: DataFrame, speeches: DataFrame) -> DataFrame:
    """done, or skipped without an asset or without speeches."""
    stored = speeches.select("document_id").distinct().withColumn("_stored", F.lit(True))
    fetched = assets.select("document_id", F.lit(True).alias("_fetched"))
    return (
        documents.select("document_id", F.col("url"))
        .join(fetched, "document_id", "left")
        .join(stored, "document_id", "left")
        .select(
            "document_id", "url",
            F.coalesce("_fetched", F.lit(False)).alias("fetched"),
            F.coalesce("_stored", F.lit(False)).alias("stored"),
            F.when(F.col("_stored"), "done").otherwise("skipped").alias("outcome"),
        )
    )


def replace_speeches(stored: DataFrame, new: DataFrame, path: str, name="speeches", per_task=ROWS_PER_TASK) -> DataFrame:
    """Put the speeches of ``new``'s documents in the place of theirs in the table at ``path``.

    ``name`` may be another table in document buckets. Only the document buckets that occur in ``new``
    are read and rewritten; they are returned. Their municipalities and bucket numbers, at most as many as
    there are of each, prune the scan. Stored and new rows are shuffled once, by bucket and, where there are
    more than ``per_task`` rows for a task, by pieces of a bucket that hold whole documents; stored rows that meet
    new ones of their document are dropped there. A document stays in its municipality.
    """
    check_keys(new, name)
    place = list(PARTITIONED_BY[name])
    new = conform(new, name)
    touched = durable(new.select(*place).distinct(), "touched-buckets")
    buckets, *known = touched.agg(F.count("*"), *(F.collect_set(c) for c in place)).first()
    if not buckets:
        return touched
    near = F.col(place[0]).isin(known[0]) | F.col(place[0]).isNull()
    near &= F.col(place[1]).isin(known[1]) | F.col(place[1]).isNull()
    inside = conform(_of_buckets(stored.filter(near), touched, place, "left_semi"), name)
    tasks = (inside.count() + new.count()) // per_task + 1
    piece = F.pmod(F.hash("document_id"), F.lit(tasks // buckets + 1))
    rows = inside.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    rows = rows.withColumn("_piece", piece).repartition(tasks, *place, "_piece")
    # the table is large as text and small as keys, so no join moves it once more
    gone = F.max("_new").over(Window.partitionBy(*place, "_piece", "document_id")) & F.col("document_id").isNotNull()
    left = rows.withColumn("_gone", gone).filter("_new OR NOT _gone").drop("_new", "_gone", "_piece")
    write_partitions(left, path, place)
    return touched


def _of_buckets(df: DataFrame, touched: DataFrame, place, how: str) -> DataFrame:
    asked = touched.select(*(F.col(c).alias(f"_{c}") for c in place))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    return df.join(asked, same[0] & same[1], how)


def replaced_snapshot(stored: DataFrame, new: DataFrame, path: str, name="speeches") -> None:
    """``replace_speeches`` to another ``path``: buckets that do not change are copied, the others written once."""
    touched = replace_speeches(stored, new, path, name)
    place = list(PARTITIONED_BY[name])
    others = _of_buckets(stored, touched, place, "left_anti")
    if not others.isEmpty():
        replace_partitions(others, path, place)


def _kept_counts(spark: SparkSession, root: str, speeches: DataFrame) -> DataFrame:
    """The snapshot's speech counts; a snapshot that was written without them is counted."""
    try:
        return read_table(spark, root, "speech_counts").drop("document_bucket")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return marts.kept_counts(speeches)


def run_extract(spark: SparkSession, source: str, target: str, again=False, speeches_at=None) -> DataFrame:
    """Parse all downloaded documents; ``again`` puts parsed ones back first.

    ``speeches_at`` is a speeches table beside the snapshots: it stays where it is, and only
    the partitions that change are written; the snapshots then hold no speeches. Speech counts for
    the reports are kept in the snapshots: those of the parsed documents are counted and replaced,
    all are counted only where ``source`` has none yet. A run that
    failed half-way is repeated: its documents are still open in ``source``.
    Returns the counters of the run.
    """
    tables = {
        name: read_table(spark, source, name)
        for name in ("documents", "document_assets", "pages", "speakers", "speaker_aliases")
    }
    stored = spark.read.schema(TABLES["speeches"]).parquet(speeches_at or f"{source}/speeches")
    documents = state.reset_status(tables["documents"]) if again else tables["documents"]
    pending = documents.filter("status = 'downloaded'")
    with_asset = pending.join(tables["document_assets"], "document_id", "left_semi")
    pages = tables["pages"].join(with_asset, "document_id", "left_semi")
    new = extract(pages, with_asset, tables["speakers"], tables["speaker_aliases"])
    speeches = durable(new["speeches"].drop("name_norm"), "speeches")
    results = outcomes(pending, tables["document_assets"], speeches)

    write_table(new["speakers"], target, "speakers")
    write_table(new["speaker_aliases"], target, "speaker_aliases")
    counts = state.replace_rows(_kept_counts(spark, source, stored), marts.kept_counts(speeches), ["document_id"])
    write_table(counts, target, "speech_counts")
    if speeches_at:
        replace_speeches(stored, speeches, speeches_at)
    else:
        write_table(state.replace_rows(stored, speeches, ["document_id"]), target, "speeches")
    write_table(state.advance_status(documents, results), target, "documents")
    return state.step_counters(results)


def run_import(
    spark: SparkSession, source: str, target: str, files: str, municipality_id: str, run_id: str,
    source_id=None, opener=open_file,
) -> DataFrame:
    """Register the document files below ``files``: documents, assets and the run's record.

    A file whose document was fetched before is skipped. A file is read, as a stream of any length,
    unless its size and time say that it is the one whose hash is stored; one that cannot be read is
    a failure. Of several files of one name the one with the smallest hash counts. Returns the run.
    """
    started = spark.sql("SELECT current_timestamp() AS t").first().t
    stored = read_table(spark, source, "document_assets")
    known = stored.filter("storage_provider = 'local'").select(
        F.col("storage_path").alias("path"), "bytes", F.col("content_sha256").alias("sha256"),
        F.col("downloaded_at").alias("seen_at"),
    )
    known = state.last_per_key(known, ["path"], ["seen_at", "sha256"])
    listed = durable(changed_files(list_files(spark, files), known), "listed-files")
    same = listed.filter("sha256 IS NOT NULL").select(
        "path", "name", "sha256", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("error")
    )
    read = file_digests(listed.filter("sha256 IS NULL").drop("sha256"), opener).select(*same.columns)
    found = state.first_per_key(same.unionByName(read), ["name"], [F.col("sha256").isNull(), "sha256", "path"])
    found = durable(found.withColumn("url", local_url("name")), "files")

    new = found.select(
        S.natural_id("url").alias("document_id"), "url", title_from_filename("name").alias("title"),
        F.lit(municipality_id).alias("municipality_id"), F.lit(source_id).alias("source_id"),
        F.lit("other").alias("document_type"), F.lit("discovered").alias("status"),
        F.lit(started).alias("created_at"), F.lit(started).alias("updated_at"),
    )
    known = state.insert_if_absent(
        read_table(spark, source, "documents"), conform(new, "documents"), ["url"], ["document_id"]
    )
    known = durable(known.drop("is_new"), "documents")
    outcome = (
        F.when(F.col("status").isin(*state.FETCHED), "skipped").when(F.col("sha256").isNull(), "failed").otherwise("done")
    )
    results = durable(
        found.join(known.select("url", "document_id", "status"), "url").select(
            "document_id", "url", "path", "sha256", "bytes", outcome.alias("outcome"),
            (outcome == "done").alias("fetched"), F.lit(False).alias("stored"),
            F.when(outcome == "failed", F.col("error")).alias("error"),
        ),
        "imports",
    )
    assets = results.filter("fetched").select(
        "document_id", F.lit("local").alias("storage_provider"), F.col("path").alias("storage_path"),
        F.col("sha256").alias("content_sha256"), F.lit("application/pdf").alias("content_type"), "bytes",
        F.lit(started).alias("downloaded_at"),
    )
    write_table(state.upsert_latest(stored, assets, ["document_id"], ["downloaded_at"]), target, "document_assets")
    write_table(state.advance_status(known, results), target, "documents")
    run = state.run_records(results, by=()).withColumn("run_id", F.lit(run_id))
    errors = state.run_errors(results.withColumn("run_id", F.lit(run_id)))
    run = state.log_with_errors(run, errors).withColumns(
        {
            "municipality_id": F.lit(municipality_id), "trigger": F.lit("manual"),
            "started_at": F.lit(started), "finished_at": F.current_timestamp(),
        }
    )
    run = durable(run, "run")
    runs = read_table(spark, source, "ingestion_runs")
    write_table(state.replace_rows(runs, conform(run, "ingestion_runs"), ["run_id"]), target, "ingestion_runs")
    return run


def run_merge(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Merge speakers whose names go on from a shorter one's; speeches and aliases follow.

    Returns the merged speakers with the number of speeches that moved.
    """
    speakers, aliases, speeches = (
        read_table(spark, source, name) for name in ("speakers", "speaker_aliases", "speeches")
    )
    groups = durable(S.merge_groups(speakers), "merges")
    write_table(S.drop_duplicates(speakers, groups), target, "speakers")
    write_table(S.repoint_speeches(aliases, groups), target, "speaker_aliases")
    write_table(S.repoint_speeches(speeches, groups), target, "speeches")
    counts = S.repoint_speeches(_kept_counts(spark, source, speeches), groups)
    counts = counts.groupBy("municipality_id", "document_id", "speaker_id").agg(F.sum("speeches").alias("speeches"))
    write_table(counts, target, "speech_counts")
    return S.merge_report(speeches, groups)


def run_words(spark: SparkSession, source: str, target: str, tokenizer: Callable | None = None) -> DataFrame:
    """Word lists of every municipality that has speeches.

    Returns the speeches on which the tokenizer failed; the others are counted.
    """
    documents = read_table(spark, source, "documents").select("document_id", "municipality_id")
    speeches = read_table(spark, source, "speeches").select("document_id", "sequence", "speech_text")
    tokens = W.filter_tokens(W.tokenize(speeches.join(documents, "document_id"), tokenizer))
    if tokenizer is None:
        tokens = tokens.withColumn("error", F.lit(None).cast("string"))
    else:
        # two steps read the kept tokens, and a tokenizer is slow
        tokens = durable(tokens, "tokens")
    words = W.top_words(W.count_words(tokens))
    write_table(words.withColumn("created_at", F.current_timestamp()), target, "word_frequencies")
    return tokens.filter("error IS NOT NULL").select("document_id", "sequence", "error")


def summarize(speeches: DataFrame, model: Callable, limit=config.TOKEN_LIMIT) -> DataFrame:
    """Summary of each document; ``model(kind, content)`` gives (reply, tokens).

    ``kind`` is single, chunked or merge. Replies are written before they are used, so no
    request is repeated by a later step. Documents with a failed call or an unreadable reply
    have ``error``.
    """
    parts = durable(
        G.ask(G.request_table(speeches, limit).select("document_id", "route", "part", "content"), model),
        "replies",
    )
    parsed = G.with_parsed_reply(parts)
    usable = parsed.join(
        parsed.filter("error IS NOT NULL").select("document_id").distinct(), "document_id", "left_anti"
    )
    merges = G.merge_input(usable).withColumn("route", F.lit("merge"))
    merged = durable(G.ask(merges, model), "merges")
    tokens = G.token_totals(
        parts.select("document_id", "used_tokens").unionByName(merged.select("document_id", "used_tokens"))
    )
    # a failed call says why; its missing reply is no JSON either
    parsed = parsed.withColumn("error", F.coalesce("failure", "error"))
    columns = ["document_id", "summary", "topics", "key_points", "error"]
    alone = usable.join(merged.select("document_id"), "document_id", "left_anti").select(*columns)
    failed = parsed.filter("error IS NOT NULL").select(*columns).dropDuplicates(["document_id"])
    return (
        alone.unionByName(
            G.with_parsed_reply(merged).withColumn("error", F.coalesce("failure", "error")).select(*columns)
        )
        .unionByName(failed)
        .join(tokens.select("document_id", F.col("total_tokens").alias("token_count")), "document_id")
        .withColumnRenamed("summary", "summary_text")
    )


def summary_outcomes(summaries: DataFrame) -> DataFrame:
    """done, or failed with the error, of each summarised document."""
    return summaries.select(
        "document_id", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("outcome"), "error"
    )


def run_summarize(
    spark: SparkSession, source: str, target: str, model: Callable, model_id: str, limit=None
) -> DataFrame:
    """Summarise the parsed documents without a summary; ``limit`` takes the oldest.

    Good summaries are stored with the model's id; failed documents stay open for the next
    run. Returns the counters of the run.
    """
    t = marts.Tables(
        **{
            short: read_table(spark, source, name)
            for short, name in (
                ("documents", "documents"), ("speeches", "speeches"), ("summaries", "document_summaries")
            )
        }
    )
    open_ = marts.unsummarized_documents(t, limit).filter("speech_count > 0")
    new = durable(summarize(marts.speeches_to_summarize(t, open_), model), "summaries")
    good = new.filter("error IS NULL").withColumns(
        {"model_id": F.lit(model_id), "created_at": F.current_timestamp()}
    )
    stored = state.upsert_latest(t.summaries, conform(good, "document_summaries"), ["document_id"], ["created_at"])
    write_table(stored, target, "document_summaries")
    return state.step_counters(summary_outcomes(new))
