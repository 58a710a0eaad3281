"""Upserts, status changes and run bookkeeping on immutable tables."""

from pyspark.sql import Column, DataFrame, functions as F

FETCHED = ("downloaded", "extracted", "parsed")


def _one_per_key(df: DataFrame, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    return _one_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    return _one_per_key(df, keys, order, F.max_by)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys, order) -> DataFrame:
    """``existing`` plus the first new row of each absent key; ``is_new`` tells them apart."""
    added = first_per_key(new, keys, order).join(existing.select(*keys), list(keys), "left_anti")
    return existing.withColumn("is_new", F.lit(False)).unionByName(
        added.withColumn("is_new", F.lit(True)), allowMissingColumns=True
    )


def upsert_latest(existing: DataFrame, new: DataFrame, keys, order, keep=()) -> DataFrame:
    """The last new row of a key replaces the stored one, but for the ``keep`` columns."""
    latest = last_per_key(new, keys, order)
    values = [c for c in existing.columns if c not in keys]
    e, n = existing.alias("e"), latest.withColumn("_there", F.lit(True)).alias("n")
    joined = e.withColumn("_stored", F.lit(True)).alias("e").join(n, list(keys), "full_outer")

    def value(c) -> Column:
        if c not in latest.columns:
            return F.col(f"e.{c}")
        if c in keep:
            return F.when(F.col("_stored"), F.col(f"e.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(F.col("_there"), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}"))

    return joined.select(*keys, *[value(c).alias(c) for c in values])


def replace_rows(existing: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Delete every stored row whose key occurs in ``new``, then add ``new``."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def to_fetch(documents: DataFrame) -> DataFrame:
    """Documents that were not fetched yet."""
    return documents.filter(~F.col("status").isin(*FETCHED))


def advance_status(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """discovered -> downloaded when fetched, downloaded -> parsed when speeches were stored.

    ``outcomes`` has at most one row per document with booleans ``fetched`` and ``stored``.
    Documents without an outcome, or without speeches, keep their status.
    """
    status = F.col("status")
    return (
        documents.join(outcomes.select("document_id", "fetched", "stored"), "document_id", "left")
        .withColumn(
            "status",
            F.when(F.col("stored"), "parsed")
            .when(F.col("fetched") & ~status.isin(*FETCHED), "downloaded")
            .otherwise(status),
        )
        .drop("fetched", "stored")
    )


def reset_status(documents: DataFrame, from_="parsed", to="downloaded") -> DataFrame:
    status = F.col("status")
    return documents.withColumn("status", F.when(status == from_, to).otherwise(status))


def step_counters(outcomes: DataFrame, by=()) -> DataFrame:
    """Total and number of done, skipped and failed items."""
    outcome = F.col("outcome")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(outcome == "done").alias("done"),
        F.count_if(outcome == "skipped").alias("skipped"),
        F.count_if(outcome == "failed").alias("failed"),
    )


def run_status(done, failed) -> Column:
    return F.when(failed == 0, "success").when(done > 0, "partial").otherwise("failed")


def run_records(outcomes: DataFrame, by=("run_id",)) -> DataFrame:
    """Status and JSON log of counters per run; the failed items are rows of ``run_errors``."""
    counts = step_counters(outcomes, by)
    return counts.withColumn("status", run_status(F.col("done"), F.col("failed"))).withColumn(
        "log", F.to_json(F.struct("total", "done", "skipped", "failed"))
    )


def run_errors(outcomes: DataFrame, by=("run_id",)) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "failed").select(*by, "url", "error")


def log_with_errors(runs: DataFrame, errors: DataFrame, key="run_id") -> DataFrame:
    """Put a run's errors into its log value (for runs whose errors fit one value)."""
    lists = errors.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("url", "error"))).alias("_errors")
    )
    none = F.array().cast("array<struct<url:string,error:string>>")
    return (
        runs.join(lists, key, "left")
        .withColumn(
            "log",
            F.to_json(
                F.struct("total", "done", "skipped", "failed", F.coalesce("_errors", none).alias("errors"))
            ),
        )
        .drop("_errors")
    )


def recent_runs(runs: DataFrame, municipality_id=None) -> DataFrame:
    """Newest runs first."""
    if municipality_id is not None:
        runs = runs.filter(F.col("municipality_id") == municipality_id)
    return runs.orderBy("municipality_id", F.desc("started_at"), "run_id")
