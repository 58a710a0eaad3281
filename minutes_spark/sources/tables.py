"""Table reads and writes, document files."""

import hashlib
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.urls import local_url, title_from_filename


def bucket_of(document_id, buckets: int) -> Column:
    """The bucket of a document; for a literal id a constant, which prunes partitions."""
    return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(buckets).cast("long")).cast("int")


def read_table(spark: SparkSession, root: str, name: str, municipality_id=None, document_id=None) -> DataFrame:
    """A stored table with its declared schema.

    The municipality filter prunes partitions; of a bucketed table ``document_id`` reads one bucket.
    """
    table = spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")
    if municipality_id is not None:
        table = table.filter(F.col("municipality_id") == municipality_id)
    if document_id is not None:
        if name in schemas.BUCKETS:
            column, buckets = schemas.BUCKETS[name]
            table = table.filter(F.col(column) == bucket_of(F.lit(document_id), buckets))
        table = table.filter(F.col("document_id") == F.lit(document_id).cast("string"))
    return table


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns and types of the table, absent ones NULL; the bucket follows from the document."""
    fields = schemas.TABLES[name].fields
    if name in schemas.BUCKETS:
        column, buckets = schemas.BUCKETS[name]
        df = df.withColumn(column, bucket_of(F.col("document_id"), buckets))
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def _balanced(df: DataFrame, partitioned_by) -> DataFrame:
    """Rows of a partition together in few files; large partitions are split at runtime."""
    return df.hint("rebalance", *partitioned_by) if partitioned_by else df


def checked_codes(df: DataFrame, name: str) -> DataFrame:
    """``df``; a value that is none of its column's codes ends the job that computes it."""
    checked = {}
    for column, kind in schemas.CODED.get(name, {}).items():
        value = F.col(column)
        told = F.raise_error(F.concat(F.lit(f"{name}.{column}: no such code: "), value)).cast("string")
        checked[column] = F.when(value.isNull() | value.isin(*schemas.CODES[kind]), value).otherwise(told)
    return df.withColumns(checked) if checked else df


def repeated_keys(df: DataFrame, name: str) -> DataFrame:
    """Unique keys of the table that stand in several rows; a key with a NULL repeats none."""
    keys = schemas.UNIQUE_KEYS[name]
    return df.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def _numbers_repeat(df: DataFrame, keys, number) -> bool:
    """Whether a ``number`` repeats for the same ``keys``: 64 numbers are bits of one value.

    Tasks that hold the numbers of a key together send one row for 64 of them.
    """
    rows = df.select(*keys, F.col(number).cast("long").alias(number)).dropna()
    bit = F.expr(f"shiftleft(1L, CAST(pmod({number}, 64) AS INT))")
    groups = rows.groupBy(*keys, F.shiftright(number, 6).alias("_numbers")).agg(
        F.count("*").alias("rows"), F.bit_or(bit).alias("_bits")
    )
    return not groups.filter(F.col("rows") > F.bit_count("_bits")).isEmpty()


def check_keys(df: DataFrame, name: str) -> None:
    """Raise where a unique key repeats; only the key columns are read."""
    *keys, last = schemas.UNIQUE_KEYS.get(name, (None,))
    if keys and df.schema[last].dataType.typeName() in ("integer", "long") and not _numbers_repeat(df, keys, last):
        return
    found = repeated_keys(df, name).first() if last else None
    if found:
        raise ValueError(f"{name}: repeated key {found.asDict()}")


def write_table(df: DataFrame, root: str, name: str, mode="overwrite") -> None:
    """Write a table of a snapshot; codes are checked while it is written, unique keys afterwards."""
    columns = schemas.PARTITIONED_BY.get(name, ())
    writer = _balanced(checked_codes(conform(df, name), name), columns).write.mode(mode)
    if columns:
        writer = writer.partitionBy(*columns)
    writer.parquet(f"{root}/{name}")
    check_keys(read_table(df.sparkSession, root, name), name)


def write_partitions(df: DataFrame, path: str, partitioned_by) -> None:
    """Overwrite exactly the partitions that occur in ``df``; a re-run gives the same files."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitioned_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitioned_by) -> None:
    """``write_partitions`` with the rows of a partition put together in few files."""
    write_partitions(_balanced(df, partitioned_by), path, partitioned_by)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the cluster's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # a folder of one machine serves a local master only
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from the files.

    For results that several later steps read: they are computed once, survive lost
    executors, and come back with known sizes.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_versions(spark: SparkSession, paths, glob=None) -> DataFrame:
    """Path, size and time of the files below ``paths``; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(paths).select("path", "length", "modificationTime")


_KEPT = {}


def kept_result(spark: SparkSession, sources, name: str, build) -> DataFrame:
    """``build()`` written once for one state of the files in ``sources``; later calls read it.

    The state is the files' paths, sizes and times: a table that is written anew gives a new result.
    """
    version = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    state = tuple(file_versions(spark, list(sources)).agg(F.count("*"), F.sum(version)).first())
    key = (spark.sparkContext.applicationId, tuple(sources), name, state)
    if key not in _KEPT:
        # the place and the schema, so that no session hangs on the module
        df, path = build(), shared_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        _KEPT[key] = path, df.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


#: Bytes of the longest file that fits one value.
LONGEST_FILE = (1 << 31) - 64

#: Bytes that are read from a file at once, and bytes of files for one task.
_PIECE, _TASK_BYTES = 1 << 22, 1 << 30


def scan_files(spark: SparkSession, path: str, glob="*.[pP][dD][fF]", longest=LONGEST_FILE) -> DataFrame:
    """Files below ``path`` with name, content, size and time; longer ones are left to ``file_digests``."""
    return _files(spark, path, glob).filter(F.col("length") <= longest)


def _files(spark, path, glob):
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .withColumn("name", F.substring_index("path", "/", -1))
    )


def list_files(spark: SparkSession, path: str, glob="*.[pP][dD][fF]") -> DataFrame:
    """Path, name, size and time of the files below ``path``; their content is not read.

    Files without a byte are no documents; Spark does not list them.
    """
    return _files(spark, path, glob).select("path", "name", "length", "modificationTime")


def open_file(path: str):
    """A stream of the file's bytes, from a local disk or a file system that Arrow knows."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return system.open_input_stream(inside)


def file_digests(files: DataFrame, opener=open_file) -> DataFrame:
    """``files`` (path, length, others) with SHA-256, the bytes that were read, and ``error``.

    A file of any size is read as a stream by one task, a piece at a time, as the hash is
    sequential. Paths are spread over tasks by number, more of them where the files are large. A
    file that cannot be read gives its error and no hash.
    """
    files = durable(files, "files")
    spark = files.sparkSession
    count, total = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, total // _TASK_BYTES + 1)))

    def digest(path):
        found, read = hashlib.sha256(), 0
        try:
            with opener(path) as stream:
                while piece := stream.read(_PIECE):
                    found.update(piece)
                    read += len(piece)
        except Exception as error:  # noqa: BLE001 - whatever the file system raises
            return None, None, f"{type(error).__name__}: {error}"
        return found.hexdigest(), read, None

    def run(batches):
        for batch in batches:
            rows = [digest(path) for path in batch["path"]]
            for at, name in enumerate(("sha256", "bytes", "error")):
                batch[name] = [row[at] for row in rows]
            batch["bytes"] = batch["bytes"].astype("Int64")
            yield batch

    digests = files.select("path").distinct().repartition(tasks).mapInPandas(
        run, "path string, sha256 string, bytes long, error string"
    )
    return files.join(digests, "path")


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` with the hash that is ``known`` for them, NULL where they have to be read.

    ``known`` holds path, bytes, sha256 and the time ``seen_at`` of an earlier reading, one row a
    path. A file of the same size that was not touched since then is the same.
    """
    before = known.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"), "seen_at")
    same = (F.col("length") == F.col("_bytes")) & (F.col("modificationTime") < F.col("seen_at"))
    return files.join(before, "path", "left").withColumn("sha256", F.when(same, F.col("_sha256"))).drop(
        "_bytes", "_sha256", "seen_at"
    )


def fingerprint(df: DataFrame, content="content") -> DataFrame:
    """Replace ``content`` by its SHA-256 and size in bytes."""
    return df.withColumns(
        {"sha256": F.sha2(content, 256), "bytes": F.octet_length(content).cast("long")}
    ).drop(content)


def scan_documents(spark: SparkSession, path: str, glob="*.[pP][dD][fF]", longest=LONGEST_FILE) -> DataFrame:
    """Document files as they are registered: name, local URL, title, hash and size.

    Files that fit a value are hashed in the JVM, longer ones as streams; an unreadable one ends the scan.
    """
    short = fingerprint(scan_files(spark, path, glob, longest)).select("name", "sha256", "bytes")
    long = file_digests(list_files(spark, path, glob).filter(F.col("length") > longest))
    unread = F.raise_error(F.concat("path", F.lit(": "), "error")).cast("string")
    long = long.withColumn("sha256", F.when(F.col("error").isNull(), F.col("sha256")).otherwise(unread))
    return short.unionByName(long.select("name", "sha256", "bytes")).select(
        "name", local_url("name").alias("url"), title_from_filename("name").alias("title"),
        "sha256", "bytes",
    )


def content_diff(new: DataFrame, old: DataFrame, key="name") -> DataFrame:
    """``new``, ``changed`` or ``same`` for each row of ``new`` by the hash stored for its key."""
    before = old.select(key, F.col("sha256").alias("_sha256"))
    return (
        new.join(before, key, "left")
        .withColumn(
            "state",
            F.when(F.col("_sha256").isNull(), "new")
            .when(F.col("sha256") != F.col("_sha256"), "changed")
            .otherwise("same"),
        )
        .drop("_sha256")
    )


def shared_content(df: DataFrame, key="name") -> DataFrame:
    """Hashes that occur more than once."""
    return (
        df.groupBy("sha256")
        .agg(F.count("*").alias("copies"), F.min(key).alias("first"))
        .filter("copies > 1")
    )
