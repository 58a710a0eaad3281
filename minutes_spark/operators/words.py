"""Word frequencies."""

from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..sources.tables import durable
from .scan import top_per_group

TOKEN_SCHEMA = "surface string, reading string, pos string, pos_detail_1 string, token_no int"


def tokenize(speeches: DataFrame, tokenizer: Callable | None = None, text="speech_text") -> DataFrame:
    """One row per token with the speech's other columns.

    ``tokenizer`` maps a text to ``(surface, reading, pos, pos_detail_1)`` tuples and runs on
    Arrow batches. The default takes runs of letters as nouns and stays in the JVM. With a
    ``tokenizer`` there is a column ``error``: a text on which it raises gives one row that
    says why and has no surface, so the others go on.
    """
    keep = [c for c in speeches.columns if c != text]
    if tokenizer is None:
        # outer: the filter on an array's size that goes with a plain one looks for all tokens twice
        found = F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))
        return speeches.select(*keep, F.posexplode_outer(found).alias("token_no", "surface")).filter(
            F.col("surface").isNotNull()
        ).select(
            "*",
            F.lit(None).cast("string").alias("reading"),
            F.lit(config.NOUN).alias("pos"),
            F.lit("一般").alias("pos_detail_1"),
        )

    none = (None,) * 4

    def tokens_of(value):
        try:
            return [(*token, None) for token in map(tuple, tokenizer(value))]
        except Exception as error:  # noqa: BLE001 - whatever the given tokenizer raises
            return [(*none, f"{type(error).__name__}: {error}")]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            lists = [tokens_of(t) for t in batch[text].fillna("")]
            tokens = batch[keep].assign(_t=lists).explode("_t", ignore_index=True)
            tokens = tokens[tokens["_t"].notna()]
            for at, name in enumerate(("surface", "reading", "pos", "pos_detail_1", "error")):
                tokens[name] = [t[at] for t in tokens["_t"]]
            tokens["token_no"] = [n for ts in lists for n in range(len(ts))]
            yield tokens.drop(columns="_t")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in speeches.schema if f.name in keep)
    return speeches.mapInPandas(run, f"{fields}, {TOKEN_SCHEMA}, error string")


def filter_tokens(
    tokens: DataFrame,
    stop_words=config.STOP_WORDS,
    noun=config.NOUN,
    dropped=config.DROPPED_NOUN_KINDS,
    min_length=config.MIN_WORD_LENGTH,
) -> DataFrame:
    """Nouns that can stand alone, are long enough, and are neither stop words nor numbers.

    Rows with an ``error`` stay; they are no words.
    """
    kind = F.coalesce("pos_detail_1", F.lit(""))
    word = F.col("surface")
    kept = (F.col("pos") == noun) & ~kind.isin(*dropped) & (F.length(word) >= min_length)
    if stop_words:
        kept &= ~word.isin(*stop_words)
    kept &= ~word.rlike(r"^[0-9０-９]+\z")
    return tokens.filter(kept | F.col("error").isNotNull() if "error" in tokens.columns else kept)


def count_words(tokens: DataFrame, order=("document_id", "sequence", "token_no")) -> DataFrame:
    """Count per (municipality, word); reading and part of speech of the first occurrence.

    Tokens are first counted by hash per speech (all of ``order`` but its last column, a
    number); the first occurrence is looked for among these counts.
    """
    *speech, number = order
    kind = ("reading", "pos", "pos_detail_1")
    if "error" in tokens.columns:
        tokens = tokens.filter("error IS NULL")
    per_speech = tokens.groupBy("municipality_id", F.col("surface").alias("word"), *kind, *speech).agg(
        F.count("*").alias("_n"), F.min(number).alias(number)
    )
    first = F.min_by(F.struct(*kind), F.struct(*order))
    return (
        per_speech.groupBy("municipality_id", "word")
        .agg(F.sum("_n").alias("count"), first.alias("_first"))
        .select(
            "municipality_id", "word", "count",
            F.nullif("_first.reading", F.lit("*")).alias("reading"),
            F.concat("_first.pos", F.lit("/"), "_first.pos_detail_1").alias("part_of_speech"),
        )
    )


_WORD = ["municipality_id", "word"]


def document_words(tokens: DataFrame) -> DataFrame:
    """Per (municipality, document, word): count, and place and kind of the first occurrence.

    This is the state that ``word_totals`` can be brought up to date from. The place is one
    number, ``sequence * 2^32 + token_no``, so tokens are counted by hash on the map side and
    shuffled once; what is shuffled again has one row per word, kind and document.
    """
    if "error" in tokens.columns:
        tokens = tokens.filter("error IS NULL")
    place = F.shiftleft(F.col("sequence").cast("long"), 32) + F.col("token_no")
    kind = ["reading", "pos", "pos_detail_1"]
    kinds = tokens.groupBy("municipality_id", "document_id", F.col("surface").alias("word"), *kind).agg(
        F.count("*").alias("count"), F.min(place).alias("place")
    )
    first = F.min_by(F.struct(*kind), "place").alias("_kind")
    words = kinds.groupBy("municipality_id", "document_id", "word").agg(
        F.sum("count").alias("count"), F.min("place").alias("place"), first
    )
    return words.select("municipality_id", "document_id", "word", "count", "place", "_kind.*")


#: Places in one document, and so the step from one document's first place to the next one's.
_PLACES = Decimal(1 << 63)


def token_totals(tokens: DataFrame, by=()) -> DataFrame:
    """``document_words`` of all documents together: a row per (``by``, municipality, word, kind).

    Document and place of the first occurrence are one decimal while tokens are counted, so that
    they are counted by hash where they lie and only vocabularies are shuffled, no row per document.
    ``document_id`` is a whole number and ``sequence`` not negative. ``word_totals`` and
    ``merged_totals`` take these rows like those of ``document_words``.
    """
    if "error" in tokens.columns:
        tokens = tokens.filter("error IS NULL")
    place = F.shiftleft(F.col("sequence").cast("long"), 32) + F.col("token_no")
    at = F.col("document_id").cast("decimal(19,0)") * F.lit(_PLACES) + place
    keys = [*by, "municipality_id", "word", "reading", "pos", "pos_detail_1"]
    totals = tokens.withColumnRenamed("surface", "word").groupBy(*keys).agg(
        F.count("*").alias("count"), F.min(at).alias("_at")
    )
    return totals.withColumn("_place", F.pmod("_at", F.lit(_PLACES))).select(
        *by, "municipality_id", F.expr(f"(_at - _place) div {_PLACES}BD").alias("document_id"), "word", "count",
        F.col("_place").cast("long").alias("place"), "reading", "pos", "pos_detail_1",
    )


def _first_document() -> Column:
    """The first of several documents' rows for a word, with its kind."""
    return F.min_by(_row(), F.struct("document_id", "place"))


def word_totals(per_document: DataFrame) -> DataFrame:
    """``document_words`` added up per (municipality, word), with the first document's row."""
    return (
        per_document.groupBy(*_WORD)
        .agg(F.sum("count").alias("count"), _first_document().alias("_first"))
        .select(*_WORD, "count", "_first.*")
    )


def merged_totals(totals: DataFrame, removed: DataFrame, added: DataFrame, after: DataFrame) -> DataFrame:
    """``totals`` after some documents' words were ``removed`` and others ``added``.

    ``removed`` and ``added`` are ``document_words`` (or ``token_totals``) of the changed documents before
    and after the change, ``after`` those of all documents after it. Counts are added up; the first occurrence
    is the earlier of the stored and the added one. Only for words whose first document was
    removed is it looked for in ``after``. Equals ``word_totals(after)``.
    """
    changes = (
        removed.withColumn("_sign", F.lit(-1)).unionByName(added.withColumn("_sign", F.lit(1)))
        .withColumn("_new", F.col("_sign") == 1)
        .groupBy(*_WORD)
        .agg(
            F.sum(F.col("count") * F.col("_sign")).alias("_more"),
            F.min(F.when(~F.col("_new"), F.struct("document_id", "place"))).alias("_gone"),
            F.min(F.when(F.col("_new"), _row())).alias("_added"),
        )
    )
    t = totals.withColumn("_stored", _row()).select(*[F.col(c).alias(f"_{c}") for c in _WORD], "count", "_stored")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _WORD]
    lost = F.coalesce(F.struct("_stored.document_id", "_stored.place").eqNullSafe(F.col("_gone")), F.lit(False))
    merged = t.join(changes, same[0] & same[1], "full_outer").select(
        *[F.coalesce(c, f"_{c}").alias(c) for c in _WORD],
        (F.coalesce("count", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("count"),
        (F.col("_stored").isNotNull() & lost).alias("_lost"),
        F.least("_stored", "_added").alias("_first"),
    ).filter("count > 0")
    merged = durable(merged, "word-totals")
    asked = merged.filter("_lost").select(*[F.col(c).alias(f"_{c}") for c in _WORD])
    found = word_totals(after.join(asked, same[0] & same[1], "left_semi"))
    known = merged.filter("NOT _lost").select(*_WORD, "count", "_first.*")
    return known.unionByName(found)


def _row() -> Column:
    """A word's row as a value that is less the earlier it stands."""
    return F.struct("document_id", "place", "reading", "pos", "pos_detail_1")


def counts_of_totals(totals: DataFrame) -> DataFrame:
    """The columns of ``count_words``."""
    return totals.select(
        *_WORD, "count", F.nullif("reading", F.lit("*")).alias("reading"),
        F.concat("pos", F.lit("/"), "pos_detail_1").alias("part_of_speech"),
    )


def top_words(counts: DataFrame, n=config.WORDS_KEPT) -> DataFrame:
    return top_per_group(counts, ["municipality_id"], [F.desc("count"), "word"], n)


def word_list(words: DataFrame, municipality_id=None, limit=config.WORDS_SERVED) -> DataFrame:
    """The most frequent words of each (or one) municipality."""
    if municipality_id is not None:
        words = words.filter(F.col("municipality_id") == municipality_id)
    return top_words(words, limit)


def word_cloud(words: DataFrame, top=config.WORDS_SERVED, shown=config.WORDS_SHOWN) -> DataFrame:
    """Size, opacity and colour tier from the count's place between minimum and maximum."""
    group = Window.partitionBy("municipality_id")
    low, high = F.min("count").over(group), F.max("count").over(group)
    ratio = F.col("ratio")
    return (
        top_per_group(words, ["municipality_id"], [F.desc("count"), "word"], top, rank="rank")
        .withColumn(
            "ratio", (F.col("count") - low) / F.when(high > low, high - low).otherwise(1)
        )
        .filter(F.col("rank") <= shown)
        .withColumn("font_size", 10 + ratio * 28)
        .withColumn("opacity", 0.4 + ratio * 0.6)
        .withColumn(
            "tier", F.when(ratio > 0.7, "high").when(ratio > 0.4, "middle").otherwise("low")
        )
    )
