"""Speaker names of speeches to known speakers.

Each distinct name of a document is resolved once, next to the people of the document's list: lists
and names meet in one join by document. Of a list only those who may bear a name stay with it, and
the steps, in order of trust, look at them where they lie.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import confidence_value, normalize_alias
from ..sources.tables import durable
from .speakers import natural_id, packed_id, unpacked_id

STRATEGIES = ("exact_fullname", "exact_family", "alias_norm", "paren_hint", "prefix")
_NAME = ["document_id", "name_norm"]
_HINTED = r"(?s)^(.+)[（(](.+)[）)]\z"


def speech_names(speeches: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct normalised names per document, with what is needed to look up aliases.

    ``speeches`` may also be the ``named_lines`` of the pages. Names are shuffled once, by document.
    """
    return (
        speeches.select("document_id", normalize_alias("speaker_name").alias("name_norm"))
        .repartition("document_id")
        .distinct()
        .join(documents.select("document_id", "municipality_id", "created_at"), "document_id")
    )


def people_of(attendees: DataFrame) -> DataFrame:
    """``document_id, _people``: the rows of a document's attendee list, which is one cell; ids are packed."""
    person = F.struct(
        F.struct("page", "line_no", "pos").alias("at"), packed_id("speaker_id").alias("speaker_id"), "full_name", "family_name"
    )
    return attendees.groupBy("document_id").agg(F.collect_list(person).alias("_people"))


def with_owner(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``_owner``: the speaker who owns the name as an alias as of the document, or NULL."""
    now = F.struct("created_at", "document_id")

    def at(ordinal):
        return F.struct(f"{ordinal}.created_at", f"{ordinal}.document_id")

    aliases = aliases.select(
        F.col("municipality_id").alias("_municipality"), F.col("alias_norm").alias("_alias"),
        F.col("speaker_id").alias("_owner"), "valid_from", "valid_to",
    )
    held = (at("valid_from") <= now) & (F.col("valid_to").isNull() | (at("valid_to") > now))
    same = (F.col("municipality_id") == F.col("_municipality")) & (F.col("name_norm") == F.col("_alias"))
    return names.join(aliases, same & held, "left").drop("_municipality", "_alias", "valid_from", "valid_to")


def with_bearers(names: DataFrame, attendees: DataFrame) -> DataFrame:
    """Add ``_bearers``: people of the document's list by whom a step may know the name (with ``_owner``)."""
    name, base = F.col("name_norm"), F.col("_base")

    def may_bear(person):
        return (
            F.startswith(name, person["family_name"]) | (person["full_name"] == name)
            | (person["speaker_id"] == F.col("_packed")) | F.startswith(person["full_name"], base)
        )

    return (
        names.join(people_of(attendees), "document_id", "left")
        .withColumn("_base", F.nullif(F.regexp_extract(name, _HINTED, 1), F.lit("")))
        .withColumn("_packed", packed_id("_owner"))
        .withColumn("_bearers", F.filter(F.coalesce("_people", F.array()), may_bear))
        .withColumn("_bearers", F.transform("_bearers", lambda p: p.withField("speaker_id", unpacked_id(p["speaker_id"]))))
        .drop("_people", "_base", "_packed")
    )


def _hit(speaker_id, full_name) -> Column:
    return F.struct(speaker_id.alias("speaker_id"), full_name.alias("full_name"))


def match_fullname(bearers) -> Column:
    own = F.filter(bearers, lambda p: p["full_name"] == F.col("name_norm"))
    return F.when(F.size(own) > 0, _hit(F.array_min(F.transform(own, lambda p: p["speaker_id"])), F.col("name_norm")))


def match_family(bearers) -> Column:
    """The family name stands once in the document's list; rows count, not people."""
    own = F.filter(bearers, lambda p: p["family_name"] == F.col("name_norm"))
    return F.when(F.size(own) == 1, _hit(F.get(own, 0)["speaker_id"], F.get(own, 0)["full_name"]))


def match_alias(bearers) -> Column:
    """Alias owner as of the document; the full name is known if the owner attends."""
    present = F.transform(
        F.filter(bearers, lambda p: p["speaker_id"] == F.col("_owner")), lambda p: F.struct(p["at"], p["full_name"].alias("full_name"))
    )
    return F.when(F.col("_owner").isNotNull(), _hit(F.col("_owner"), F.array_min(present)["full_name"]))


def match_paren_hint(names: DataFrame, bearers="_bearers") -> DataFrame:
    """``base(hint)``: the first attendee whose name starts with base, is longer, and has hint."""

    def meant(person):
        name = person["full_name"]
        return (F.length(name) > F.length("_base")) & F.startswith(name, F.col("_base")) & F.contains(name, F.col("_hint"))

    first = F.array_min(
        F.transform(
            F.filter(bearers, meant),
            lambda p: F.struct(p["at"].alias("at"), p["speaker_id"].alias("speaker_id"), p["full_name"].alias("full_name")),
        )
    )
    return (
        names.withColumn("_base", F.nullif(F.regexp_extract("name_norm", _HINTED, 1), F.lit("")))
        .withColumn("_hint", F.nullif(F.regexp_extract("name_norm", _HINTED, 2), F.lit("")))
        .withColumn("_first", first)
        .withColumn("paren_hint", F.when(F.col("_first").isNotNull(), _hit(F.col("_first.speaker_id"), F.col("_first.full_name"))))
        .drop("_base", "_hint", "_first")
    )


def match_prefix(names: DataFrame, bearers="_bearers") -> DataFrame:
    """The only unique family name of two or more characters that starts the name."""
    starts = F.filter(
        bearers, lambda p: (F.length(p["family_name"]) >= 2) & F.startswith(F.col("name_norm"), p["family_name"])
    )
    once = F.filter(
        "_starts", lambda p: F.size(F.filter("_starts", lambda other: other["family_name"] == p["family_name"])) == 1
    )
    only = F.get("_once", 0)
    return (
        names.withColumn("_starts", starts)
        .withColumn("_once", once)
        .withColumn("prefix", F.when(F.size("_once") == 1, _hit(only["speaker_id"], only["full_name"])))
        .drop("_starts", "_once")
    )


def resolve_names(names: DataFrame, attendees: DataFrame, aliases: DataFrame) -> DataFrame:
    """``speaker_id, full_name, confidence, match_strategy`` for each (document, name).

    A document that is listed several times has each of its names as often, and each of these rows
    meets the hits of all of them; no prefix is the only one then.
    """
    found = with_bearers(with_owner(names, aliases), attendees)
    found = found.select(
        *names.columns, "_bearers",
        match_fullname("_bearers").alias("exact_fullname"), match_family("_bearers").alias("exact_family"),
        match_alias("_bearers").alias("_alias"),
    )
    rows = Window.partitionBy(*_NAME)
    found = (
        found.withColumns({"_aliases": F.collect_list("_alias").over(rows), "_rows": F.count("*").over(rows)})
        .select("*", F.explode_outer("_aliases").alias("alias_norm"))
        .withColumn("_hit", F.coalesce(*STRATEGIES[:3]))
        .withColumn("match_strategy", _strategy(STRATEGIES[:3]))
        # who may bear a name is kept for names that nothing else resolves
        .withColumn("_bearers", F.when(F.col("_hit").isNull(), F.col("_bearers")))
        .select(*names.columns, "_hit", "match_strategy", "_bearers", "_rows")
    )
    found = durable(found, "known-names")
    rest = found.filter(F.col("_hit").isNull()).drop("_hit", "match_strategy")
    rest = match_prefix(match_paren_hint(rest), "_bearers")
    hints = F.when(F.col("paren_hint").isNotNull(), F.array_repeat("paren_hint", F.col("_rows").cast("int")))
    rest = (
        rest.withColumn("prefix", F.when(F.col("_rows") == 1, F.col("prefix")))
        .select(*names.columns, "prefix", F.explode_outer(hints).alias("paren_hint"))
        .select(
            *names.columns, F.coalesce(*STRATEGIES[3:]).alias("_hit"),
            F.coalesce(_strategy(STRATEGIES[3:]), F.lit("unresolved")).alias("match_strategy"),
        )
    )
    return (
        found.filter(F.col("_hit").isNotNull()).select(*rest.columns).unionByName(rest)
        .select(
            *names.columns,
            F.col("_hit.speaker_id"),
            F.col("_hit.full_name"),
            F.when(F.col("match_strategy") == "unresolved", "low")
            .when(F.col("match_strategy") == "prefix", "medium")
            .otherwise("high")
            .alias("confidence"),
            "match_strategy",
        )
    )


def _strategy(steps) -> Column:
    return F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in steps])


def shared_surname_hits(resolved: DataFrame, attendees: DataFrame) -> DataFrame:
    """Names resolved by alias although several attendees of the document bear that surname.

    Only people whose surname is such a name are counted.
    """
    by_alias = resolved.filter(F.col("match_strategy") == "alias_norm").select(*_NAME, "speaker_id")
    people = attendees.select("document_id", F.col("family_name").alias("name_norm"), packed_id("speaker_id").alias("speaker_id"))
    shared = (
        people.join(by_alias.select(*_NAME), _NAME, "left_semi")
        .groupBy(*_NAME)
        .agg(F.countDistinct("speaker_id").alias("bearers"))
        .filter("bearers > 1")
    )
    return by_alias.join(shared, _NAME).select(*_NAME, "speaker_id", "bearers")


def resolve_speakers(
    speeches: DataFrame, documents: DataFrame, attendees: DataFrame, aliases: DataFrame, names=None
) -> DataFrame:
    """Speech rows with their speaker; ``confidence`` is the resolver's.

    ``names`` (from ``speech_names``) saves a second pass over derived speeches.
    """
    if names is None:
        names = speech_names(speeches, documents)
    resolved = resolve_names(names, attendees, aliases)
    return (
        speeches.withColumn("name_norm", normalize_alias("speaker_name"))
        .join(resolved.drop("created_at"), _NAME, "left")
        .withColumn("confidence", confidence_value("confidence"))
        .withColumn("speech_id", natural_id("document_id", "sequence"))
    )


def count_names(spoken: DataFrame) -> DataFrame:
    """Speeches per (document, name); ``spoken`` has a row for each speech (``spoken_names``)."""
    return (
        spoken.select("document_id", normalize_alias("speaker_name").alias("name_norm"))
        .repartition("document_id")
        .groupBy(*_NAME)
        .agg(F.count("*").alias("speeches"))
    )


def counted_names(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """Names to resolve that carry their ``speeches``; ``_listed`` is NULL where the document is not known."""
    known = documents.select("document_id", "municipality_id", "created_at", F.lit(True).alias("_listed"))
    return counts.join(known, "document_id", "left")


def count_resolved(counts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Speeches per (document, name) with the name's speaker: all that match rates need to keep.

    ``counts`` are ``count_names``; ``resolved`` has one row for each name. Where these are
    ``counted_names``, they are all there and nothing is joined.
    """
    if "_listed" in resolved.columns:
        found = [F.when(F.col("_listed"), F.col(c)).alias(c) for c in ("speaker_id", "full_name", "confidence", "match_strategy")]
        return resolved.select(*counts.columns, *found)
    return counts.join(resolved.drop("municipality_id", "created_at"), _NAME, "left")


def match_rate(counted: DataFrame, by=()) -> DataFrame:
    """Matched and unmatched speeches and the rate in percent (one decimal)."""
    return (
        counted.groupBy(*by)
        .agg(
            F.coalesce(F.sum("speeches"), F.lit(0)).alias("speeches"),
            F.coalesce(F.sum(F.when(F.col("speaker_id").isNotNull(), F.col("speeches"))), F.lit(0)).alias("matched"),
        )
        .withColumn("unmatched", F.col("speeches") - F.col("matched"))
        .withColumn("rate", F.round(F.try_divide(F.col("matched") * 100.0, F.col("speeches")), 1))
    )


def unresolved_names(counted: DataFrame) -> DataFrame:
    """Names without a speaker and how many speeches they cover."""
    return (
        counted.filter(F.col("speaker_id").isNull())
        .groupBy("name_norm")
        .agg(F.sum("speeches").alias("speeches"), F.count("*").alias("documents"))
    )
