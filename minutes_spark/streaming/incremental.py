"""Parse newly arrived page files with the batch operators."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import schemas
from ..operators.state import last_per_key
from ..sources.tables import durable


def parse_new_pages(
    spark: SparkSession, landing: str, checkpoint: str, handle: Callable[[DataFrame, int], None]
):
    """Hand every new batch of page rows to ``handle`` and stop when all are done.

    Files that were handled are remembered in ``checkpoint``. A batch may come twice after a
    failure, so ``handle`` should replace what it writes. All pages of a document have to
    arrive together; ``parse_whole_documents`` waits for them.
    """
    return (
        spark.readStream.schema(schemas.TABLES["pages"])
        .parquet(landing)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )


_ARRIVED = "document_id string, files array<string>, complete boolean"
_HELD = "pages array<int>, files array<string>, expected int"


def _hold(wait):
    """State function: the pages and files of a document until the last page is there or ``wait`` ms are over."""

    def ready(key, files, complete):
        return pd.DataFrame({"document_id": [key[0]], "files": [sorted(files)], "complete": [complete]})

    def hold(key, batches, state):
        pages, files, expected = state.get if state.exists else ([], [], None)
        if state.hasTimedOut:
            state.remove()
            yield ready(key, files, False)
            return
        pages, files, last = set(pages), set(files), 0
        for batch in batches:
            pages.update(batch["page"].dropna().astype(int))
            files.update(batch["file"])
            last = max(last, int(batch["arrived"].max()))
            counts = batch["page_count"].dropna()
            if len(counts):
                expected = max(int(counts.max()), expected or 0)
        if expected is not None and len(pages) >= expected:
            if state.exists:
                state.remove()
            yield ready(key, files, True)
            return
        state.update((sorted(pages), sorted(files), expected))
        if wait is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)

    return hold


def parse_whole_documents(
    spark: SparkSession, landing: str, checkpoint: str, handle: Callable[[DataFrame, int], None],
    wait: int | None = None,
):
    """Hand every document to ``handle`` as soon as all of its pages have arrived, in however many files.

    The landing files are ``pages`` with ``page_count``, the number of pages of the row's document, NULL
    in rows that do not know it. What is held of an unfinished document is its page numbers and files;
    texts stay in the landing files, and of these only the ones of finished documents are read again.
    With ``wait``, a document whose next page is not there after that many milliseconds is handed on as
    it is when the next files come. The rows have ``complete``. Of a page that came several times the
    one in the latest file counts; a document that comes anew is held and handed on anew. Pages
    without a document's id are never complete and not handed on. As in ``parse_new_pages`` a batch
    may come twice after a failure.
    """
    columns = StructType([*schemas.TABLES["pages"], StructField("page_count", IntegerType())])
    arrived = (
        spark.readStream.schema(columns).parquet(landing)
        .filter("document_id IS NOT NULL")
        .select(
            "document_id", "page", "page_count", F.col("_metadata.file_path").alias("file"),
            F.current_timestamp().alias("batch_time"), F.unix_millis(F.current_timestamp()).alias("arrived"),
        )
    )
    if wait is not None:
        # a batch's own time, so no row is ever late
        arrived = arrived.withWatermark("batch_time", "0 seconds")
    finished = arrived.groupBy("document_id").applyInPandasWithState(
        _hold(wait), _ARRIVED, _HELD, "append", "EventTimeTimeout" if wait is not None else "NoTimeout"
    )

    def hand_on(batch, number):
        documents = durable(batch, "finished-documents")
        # names of files, as the listing of the landing folder holds them too
        files = [r[0] for r in documents.select(F.explode("files")).distinct().collect()]
        if not files:
            return
        rows = batch.sparkSession.read.schema(columns).parquet(*files).select(
            *schemas.TABLES["pages"].fieldNames(),
            F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"),
        )
        rows = rows.join(documents.select("document_id", "complete"), "document_id")
        handle(last_per_key(rows, ["document_id", "page"], ["_time", "_file", "text"]).drop("_time", "_file"), number)

    return (
        finished.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(hand_on)
        .start()
    )
