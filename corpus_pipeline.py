"""Documents through five stages: language ID, near-dedup, decontamination, secrets, pieces.

Each stage works on what its predecessor kept, and its result is written as Parquet and read
again. All but the last keep the columns of ``documents``. A stage's result lists the rows it
keeps: documents in a known language; one of each group of near copies; documents without a
benchmark passage; the same documents with secrets replaced in their texts; their pieces.
"""

from pyspark.sql import functions as F

from minutes_spark.llm import decontaminate, langid, pieces, secrets, simhash
from minutes_spark.llm.common import durable, table



def language_id(spark, docs, sf_dir):
    """Models are learned from the documents' own language labels; texts in no known language go."""
    model = langid.fit(docs)
    return langid.recognised(langid.predict(docs, model)).select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    return simhash.deduplicated(docs).select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_scan(spark, docs, sf_dir):
    """Secrets are replaced in the texts, and n_chars follows; every document stays."""
    safe = secrets.redacted(secrets.find_secrets(docs))
    return safe.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sentence_pieces(spark, docs, sf_dir):
    """Pieces of every text; each is decoded where it was encoded and must be the text again."""
    encoded = pieces.encode(docs.select("doc_id", "text", "lang", "source"))
    return encoded.select(
        "doc_id", "lang", "source", "ids", "score", "others",
        F.size("ids").cast("long").alias("n_pieces"),
        F.coalesce("exact", F.col("text").isNull()).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentence_pieces", sentence_pieces),
]

#: Byte context trees, fingerprints, alignment and lattices are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
