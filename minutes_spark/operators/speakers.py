"""Speaker register, alias dictionary and merging of duplicate speakers."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..functions.text import normalize_alias, prefixes, speaker_role
from ..sources.tables import durable

LIST_ORDER = ("created_at", "document_id", "page", "line_no", "pos")


def natural_id(*parts) -> Column:
    """Id from a natural key, so that a second run gives the same rows."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def packed_id(c) -> Column:
    """An id as bytes that tell it exactly: half as many where it is a digest in hex digits."""
    c, digest = F.col(c), F.unhex(c)
    whole = F.concat(F.lit(b"\x00"), c.cast("binary"))
    return F.when(F.lower(F.hex(digest)) == c, F.concat(F.lit(b"\x01"), digest)).otherwise(whole)


def unpacked_id(c) -> Column:
    """The id that ``packed_id`` made ``c`` of."""
    content = F.substring(c, 2, 2**31 - 1)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(content))).otherwise(content.cast("string"))


def with_speaker_ids(
    attendees: DataFrame, documents: DataFrame, speakers: DataFrame | None = None
) -> DataFrame:
    """Add the document's municipality and time, and the speaker id behind each name.

    Known speakers keep their id, new ones get one from (municipality, name). Attendees that were parsed
    with their documents are not joined again.
    """
    named = attendees
    if "municipality_id" not in attendees.columns:
        named = attendees.join(documents.select("document_id", "municipality_id", "created_at"), "document_id")
    new_id = natural_id("municipality_id", "full_name")
    if speakers is None:
        return named.withColumn("speaker_id", new_id)
    known = speakers.select(
        "municipality_id", F.col("name_ja").alias("full_name"), F.col("speaker_id").alias("_known")
    )
    return (
        named.join(known, ["municipality_id", "full_name"], "left")
        .withColumn("speaker_id", F.coalesce("_known", new_id))
        .drop("_known")
    )


def incoming_speakers(attendees: DataFrame) -> DataFrame:
    """One row per (municipality, name) with its first known role in list order."""
    role = speaker_role("role")
    order = F.when(role != "unknown", F.struct(*LIST_ORDER))
    return attendees.groupBy("municipality_id", F.col("full_name").alias("name_ja")).agg(
        F.coalesce(F.min_by(role, order), F.lit("unknown")).alias("role")
    )


def upsert_speakers(speakers: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert absent speakers; a stored role changes only if it is ``unknown``."""
    key = ["municipality_id", "name_ja"]
    new = incoming.select(*key, F.col("role").alias("_role"))
    merged = speakers.join(new, key, "full_outer")
    return merged.withColumns(
        {
            "is_new": F.col("speaker_id").isNull(),
            "speaker_id": F.coalesce("speaker_id", natural_id(*key)),
            "role": F.when(F.col("role") != "unknown", F.col("role")).otherwise(
                F.coalesce("_role", "role", F.lit("unknown"))
            ),
        }
    ).drop("_role")


def derive_aliases(attendees: DataFrame) -> DataFrame:
    """Full name (1.0) and family name (0.8) of each attendee, in registration order."""
    aliases = F.array(
        F.struct(F.col("full_name").alias("alias_raw"), F.lit(1.0).alias("confidence"), F.lit(0).alias("part")),
        F.struct(F.col("family_name").alias("alias_raw"), F.lit(0.8).alias("confidence"), F.lit(1).alias("part")),
    )
    return (
        attendees.select("municipality_id", "speaker_id", *LIST_ORDER, F.inline(aliases))
        .withColumn("alias_norm", normalize_alias("alias_raw"))
        .withColumn("alias_type", F.lit("attendee_derived"))
    )


_ALIAS = ("speaker_id", "alias_raw", "alias_type", "confidence")
_ORDINAL = (*LIST_ORDER, "part")


def alias_history(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Who owns an alias from when to when.

    The first writer owns it; a different speaker takes over only with a higher alias type.
    Types rise with every takeover, so there are at most as many takeovers as types minus one,
    and each is found by a grouped minimum over what is still able to take over: rows of a higher
    type, for aliases that have such rows. One pass over all rows keeps the earliest time of each alias,
    speaker and type by hash; that is enough to know when an alias is taken, and only rows of such times
    are read again and sorted. ``incoming`` is derived anew for that, so it should come from written
    attendees. Where an able speaker's first time is not behind the owner's, the alias's rows are read.
    ``valid_from``/``valid_to`` are ordinals (see ``derive_aliases``); stored aliases come
    before all others.
    """
    key = ["municipality_id", "alias_norm"]
    levels = config.ALIAS_PRIORITY
    priority = reduce(
        lambda rest, item: F.when(F.col("alias_type") == item[0], item[1]).otherwise(rest),
        levels.items(),
        F.lit(0),
    )
    ordinal = F.struct(*_ORDINAL)
    rows = incoming.select(*key, *_ALIAS, ordinal.alias("ordinal"))
    if existing is not None:
        stored = F.lit(None).cast(rows.schema["ordinal"].dataType)
        empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema["ordinal"].dataType])
        existing = durable(existing.select(*key, *_ALIAS), "alias-rows")
        rows = existing.withColumn("ordinal", F.coalesce(stored, empty)).unionByName(rows)
    rows = rows.filter(F.length("alias_norm") > 0).withColumn("priority", priority)

    row = F.struct(*_ALIAS, "priority", "ordinal")
    at = F.col("ordinal.created_at")
    # no time comes before all times
    first_at = F.when(~F.max("_timeless"), F.min("_first")).alias("_at")

    groups = durable(
        rows.groupBy(*key, "speaker_id", "priority").agg(F.min(at).alias("_first"), F.max(at.isNull()).alias("_timeless")),
        "alias-times",
    )

    def earliest(candidates, times):
        """The first of each key's ``candidates``, whose earliest time is known; rows of other times are left early."""
        times = durable(times.withColumnsRenamed({"municipality_id": "_municipality", "alias_norm": "_alias"}), "alias-firsts")
        here = F.col("municipality_id").eqNullSafe(F.col("_municipality"))
        then = at.eqNullSafe(F.col("_at"))
        some = rows.join(times.select("_municipality", "_at").distinct(), here & then, "left_semi")
        found = candidates(some).join(times, here & then & (F.col("alias_norm") == F.col("_alias")))
        return durable(found.groupBy(*key).agg(F.min_by(row, "ordinal").alias("row"), F.max("_top").alias("_top")), "alias-owners")

    owners = [earliest(lambda some: some, groups.groupBy(*key).agg(first_at, F.max("priority").alias("_top")))]
    for beaten in sorted(levels.values())[:-1]:
        last = owners[-1].filter(F.col("row.priority") < F.col("_top"))
        if last.isEmpty():
            break
        may = (F.col("priority") > F.col("row.priority")) & (F.col("speaker_id") != F.col("row.speaker_id"))

        def able(some, last=last):
            owned = some.filter(F.col("priority") > beaten).join(last.drop("_top"), key)
            return owned.filter(may & (F.col("ordinal") > F.col("row.ordinal"))).drop("row")

        # a speaker whose first time lies behind the owner's is able from then on
        since = F.col("row.ordinal.created_at")
        behind = ~F.col("_timeless") & (since.isNull() | (F.col("_first") > since))
        times = groups.filter(F.col("priority") > beaten).join(last, key).filter(may).groupBy(*key).agg(
            first_at, F.max("_top").alias("_top"), F.min(behind).alias("_behind")
        )
        times = durable(times, "alias-takers")
        others = times.filter(~F.col("_behind"))
        times = times.filter("_behind").drop("_behind")
        if not others.isEmpty():
            # of the others, the rows behind the owner's are looked at
            later = able(rows.join(others.select(*key, "_top"), key))
            later = later.withColumns({"_first": at, "_timeless": at.isNull()})
            times = times.unionByName(later.groupBy(*key).agg(first_at, F.max("_top").alias("_top")))
        owners.append(earliest(able, times))
    taken = Window.partitionBy(*key).orderBy("row.ordinal")
    return (
        reduce(DataFrame.unionByName, owners)
        .withColumn("valid_to", F.lead("row.ordinal").over(taken))
        .select(
            *key, "row.speaker_id", "row.alias_raw", "row.alias_type", "row.confidence",
            F.col("row.ordinal").alias("valid_from"), "valid_to",
        )
    )


def merge_aliases(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """The alias table after all ``incoming`` rows were applied in order."""
    return alias_dictionary(alias_history(existing, incoming))


def alias_dictionary(aliases: DataFrame, municipality_id=None) -> DataFrame:
    """Current owner of each alias."""
    if "valid_to" in aliases.columns:
        aliases = aliases.filter(F.col("valid_to").isNull()).drop("valid_from", "valid_to")
    if municipality_id is not None:
        aliases = aliases.filter(F.col("municipality_id") == municipality_id)
    return aliases


def merge_groups(speakers: DataFrame, min_len=3) -> DataFrame:
    """Duplicate -> canonical: the shortest name that is a proper prefix, of ``min_len`` or more.

    Names are looked up by their prefixes, so no pairs of speakers are compared.
    """
    key = ["municipality_id", "prefix"]
    shorter = (
        speakers.filter(F.length("name_ja") >= min_len)
        .groupBy("municipality_id", F.col("name_ja").alias("prefix"))
        .agg(F.min("speaker_id").alias("canonical_id"))
    )
    return (
        speakers.select(
            "municipality_id",
            F.col("speaker_id").alias("duplicate_id"),
            F.col("name_ja").alias("duplicate_name"),
            F.explode(prefixes("name_ja", min_len, F.length("name_ja") - 1)).alias("prefix"),
        )
        .join(shorter, key)
        .groupBy("municipality_id", "duplicate_id", "duplicate_name")
        .agg(F.min(F.struct(F.length("prefix"), "prefix", "canonical_id")).alias("_best"))
        .select(
            "municipality_id", "duplicate_id", "duplicate_name",
            F.col("_best.canonical_id"), F.col("_best.prefix").alias("canonical_name"),
        )
    )


def repoint_speeches(speeches: DataFrame, groups: DataFrame) -> DataFrame:
    """Speeches of duplicates under their canonical speaker."""
    moves = groups.select(F.col("duplicate_id").alias("speaker_id"), "canonical_id")
    moved = (
        speeches.filter(F.col("speaker_id").isNotNull())
        .join(moves, "speaker_id", "left")
        .withColumn("speaker_id", F.coalesce("canonical_id", "speaker_id"))
        .drop("canonical_id")
    )
    # speeches without a speaker share no key and need no join
    return moved.unionByName(speeches.filter(F.col("speaker_id").isNull()))


def drop_duplicates(speakers: DataFrame, groups: DataFrame) -> DataFrame:
    return speakers.join(
        groups.select(F.col("duplicate_id").alias("speaker_id")), "speaker_id", "left_anti"
    )


def merge_report(speeches: DataFrame, groups: DataFrame) -> DataFrame:
    """Speeches that move, per duplicate; counted before the join."""
    counts = (
        speeches.filter(F.col("speaker_id").isNotNull())
        .groupBy(F.col("speaker_id").alias("duplicate_id"))
        .agg(F.count("*").alias("_n"))
    )
    return (
        groups.join(counts, "duplicate_id", "left")
        .withColumn("moved_speeches", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )
