"""Speaker lines and personal names.

Rules with several steps take a DataFrame and add one column per step, so that Catalyst
evaluates each step once instead of repeating it inside the next one.
"""

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import config
from .text import CJK, WS, col, ltrim_ws, normalize_alias, trim_ws


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _position(text, part) -> Column:
    """Zero-based position of the first occurrence, -1 without one."""
    return F.call_function("instr", col(text), part) - 1


def _longest_first(roles):
    return sorted(roles, key=len, reverse=True)


def _first_letters(roles) -> str:
    """Regex class of the letters that start a role."""
    letters = "".join(re.escape(first) for first in sorted({role[0] for role in roles if role}))
    return f"[{letters}]" if letters else ""


def marker_pattern(roles, longest_name, starts_with_role=True) -> str:
    """Regex for a name of up to ``longest_name`` letters and the role behind it, spaced or not.

    The earliest role wins, then the longest. A role that also starts the text is out: only its first
    occurrence counts, and that has no name before it. One empty group per role remembers this; a text
    of which it is known that no role starts it needs none (``starts_with_role``). Roles are tried only
    where one of their first letters stands.
    """
    gap = f"[{WS}]*+"
    spaced = {role: gap.join(map(re.escape, role)) for role in roles}
    first, starts, free = _first_letters(roles), "", dict.fromkeys(roles, "")
    if starts_with_role:
        starts = "".join(f"(?:(?={gap}{spaced[role]})())?+" for role in roles)
        free = {role: f"(?!\\{at})" for at, role in enumerate(roles, 1)}
    ends = "|".join(spaced[role] + free[role] for role in _longest_first(roles)) or "(?!)"
    return f"^{starts}(?:{gap}[{CJK}()（）]){{1,{longest_name}}}?{gap}(?={first})(?:{ends})"


def with_speaker_match(
    df: DataFrame,
    line="line",
    roles=config.SPEECH_ROLES,
    marker=config.MARKER,
    longest_name=config.MAX_MARKER_NAME,
) -> DataFrame:
    """Add ``speaker_name_raw`` and ``rest``; the former is NULL where no speaker is named.

    Only the first occurrence of each role counts. The earliest role wins, then the longest.
    Without a role, a short name that fills the line is taken as it stands.
    """
    letters = f"[{CJK}]"
    name_only = rf"^{re.escape(marker)}({letters}{{1,10}}(?:[{WS}]+{letters}{{1,5}})*)[{WS}]*\z"
    is_marked = col(line).startswith(marker) & (F.length(col(line)) > len(marker))
    df = (
        df.withColumn("_after", F.when(is_marked, F.substr(col(line), F.lit(len(marker) + 1))))
        .withColumn("_first", F.substring(ltrim_ws("_after"), 1, 1))
        .withColumn(
            "_named",
            F.when(
                F.col("_first").isin(sorted({role[0] for role in roles if role})),
                F.regexp_extract("_after", marker_pattern(roles, longest_name), 0),
            ).otherwise(F.regexp_extract("_after", marker_pattern(roles, longest_name, False), 0)),
        )
        .withColumn("_alone", F.when(F.col("_named") == "", trim_ws(F.regexp_extract(col(line), name_only, 1))))
        .withColumn(
            "speaker_name_raw",
            F.when(F.col("_named") != "", F.col("_named")).when(F.col("_alone") != "", F.col("_alone")),
        )
        .withColumn(
            "rest",
            F.when(F.col("_named") != "", trim_ws(F.substr("_after", F.length("_named") + 1))).when(
                F.col("speaker_name_raw").isNotNull(), F.lit("")
            ),
        )
    )
    return df.drop("_after", "_first", "_named", "_alone")


def with_speaker_name(
    df: DataFrame, raw="speaker_name_raw", roles=config.SPEECH_ROLES
) -> DataFrame:
    """Add ``speaker_name``, ``speaker_role`` and ``parse_confidence``.

    The first listed role that ends the text and leaves a name is split off.
    """
    hits = [
        F.when(F.col("_norm").endswith(role) & (F.length("_norm") > F.length(F.lit(role))), F.lit(role)) for role in roles
    ]
    df = (
        df.withColumn("_norm", normalize_alias(raw))
        .withColumn("speaker_role", F.coalesce(*hits, F.lit("")))
        .withColumn(
            "speaker_name",
            F.substr("_norm", F.lit(1), F.length("_norm") - F.length("speaker_role")),
        )
        .withColumn(
            "parse_confidence",
            F.when(F.length("speaker_role") > 0, "high")
            .when(F.length("_norm") > 0, "medium")
            .otherwise("low"),
        )
    )
    return df.drop("_norm")


def with_person_name(
    df: DataFrame,
    raw: str,
    out: str,
    roles=config.ATTENDEE_ROLES,
    bigrams=config.ORGANISATION_BIGRAMS,
    longest=config.MAX_PERSON_NAME,
) -> DataFrame:
    """Add ``out``: the personal name inside the text between two roles.

    A leading deputy word and a concurrent post are skipped; the name ends at a special
    character, before an organisation word, or after ``longest`` characters.
    """
    special = "・（(0-9０-９"
    ends = F.transform(
        _texts(roles),
        lambda role: F.when(
            _position("_post", role) >= 0, _position("_post", role) + F.length(role)
        ),
    )
    unknown_post = F.length(F.regexp_extract("_post", "^.*?[長監者]", 0))
    before_word = rf"(?s)^(.{{2,}}?)(?:{'|'.join(map(re.escape, bigrams))}).*\z"
    df = (
        df.withColumn("_name", F.regexp_replace(col(raw), "^補佐", ""))
        .withColumn("_post", F.when(F.col("_name").startswith("兼"), F.substr("_name", F.lit(2))))
        .withColumn("_post_end", F.when(F.col("_post").isNotNull(), F.coalesce(F.array_max(ends), unknown_post)))
        .withColumn(
            "_name",
            F.when(F.col("_post").isNull(), F.col("_name")).otherwise(
                F.substr("_post", F.col("_post_end") + 1)
            ),
        )
        .withColumn(
            "_name",
            F.when(F.col("_name").rlike(f"^[{special}]"), F.col("_name")).otherwise(
                F.regexp_extract("_name", f"(?s)^[^{special}]*", 0)
            ),
        )
        .withColumn(out, F.substring(F.regexp_replace("_name", before_word, "$1"), 1, longest))
    )
    return df.drop("_name", "_post", "_post_end")


def family_from_spaced(c) -> Column:
    """Family name of a name whose parts are separated by whitespace."""
    name = F.regexp_replace(trim_ws(c), f"[{WS}]+", " ")
    return F.when(
        name.rlike(r"^[^ ](?: [^ ]){2,}\z"),
        F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1)),
    ).otherwise(F.substring_index(name, " ", 1))


def family_from_compact(c, single=config.ONE_CHAR_FAMILY_NAMES) -> Column:
    """Family name of an unspaced name: two characters unless the first is a known surname."""
    c = col(c)
    first = F.substring(c, 1, 1)
    return (
        F.when(F.length(c) <= 2, c)
        .when(first.isin(*single), first)
        .otherwise(F.substring(c, 1, 2))
    )


def role_pattern(roles=config.ATTENDEE_ROLES) -> str:
    """Alternation that prefers the longest role at a position."""
    return f"(?={_first_letters(roles)})(?:{'|'.join(map(re.escape, _longest_first(roles)))})"
