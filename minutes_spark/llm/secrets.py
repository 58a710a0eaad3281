"""Secret scans over an inverted index of trigrams.

The trigrams that a rule's pattern demands are derived from the pattern: alternatives of sets,
one set for each way through its literal parts. The index holds a posting (trigram, text) for
each demanded trigram that a text contains; a rule's candidates are the texts whose postings
cover one of its alternatives. Only candidates are searched with the pattern. A rule without a
demanded trigram in some alternative is searched in every text. Texts are known by their MD5,
so equal texts are indexed once.

All work on texts is built-in column functions. Positions are code points, ends exclusive.

Cases: a null text counts as empty and has no spans; spans of several kinds may overlap; ties
at one start follow the order of the rules; repeated rows get equal spans; an empty table gives
an empty result; other columns stay unless they have a result's name.
"""

import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from .common import durable

GRAM = 3
#: Ways through a pattern that are told apart before its literal parts count as unknown.
_WAYS = 64
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters or more; ``look`` is found wherever a match is kept."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    look: str = ""


# The rules every result has, then those of this operator.
BASE_RULES = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
        "[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
MORE_RULES = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_password", "[a-z]+://[^\\x20\\x09-\\x0D/:@]+:[^\\x20\\x09-\\x0D/:@]{6,}@"),
)
RULES = BASE_RULES + MORE_RULES
PLACEHOLDER = "[SECRET]"


def demanded(pattern):
    """Alternatives of trigram sets (lower case), one of which every match contains; None if a match may contain none."""
    ways = _ways(re._parser.parse(pattern), [(frozenset(), "")])
    sets = {grams for grams, _ in ways}
    if not sets or frozenset() in sets:
        return None
    return sorted((sorted(s) for s in sets if not any(other < s for other in sets)))


def _append(ways, letter):
    out = set()
    for grams, tail in ways:
        tail += letter
        out.add((grams | {tail[-GRAM:]} if len(tail) >= GRAM else grams, tail[1 - GRAM :]))
    return list(out)


def _ways(nodes, ways):
    for kind, value in nodes:
        kind = str(kind)
        if kind == "LITERAL":
            ways = _append(ways, chr(value).lower())
        elif kind == "IN" and len(letters := _letters(value)) == 1:
            ways = _append(ways, letters.pop())
        elif kind == "SUBPATTERN":
            ways = _ways(value[-1], ways)
        elif kind == "BRANCH":
            ways = [w for branch in value[1] for w in _ways(branch, ways)]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            if most == 1:
                ways = list({*ways, *_ways(inner, ways)})
            else:
                for _ in range(min(least, GRAM)):
                    ways = _ways(inner, ways)
                if most != least or least > GRAM:
                    ways = [(grams, "") for grams, _ in ways]
        else:
            ways = [(grams, "") for grams, _ in ways]
        ways = list(dict.fromkeys(ways))
        if len(ways) > _WAYS:
            common = frozenset.intersection(*(grams for grams, _ in ways))
            ways = [(common, "")]
    return ways


def _letters(items):
    """The one letter of a class such as [Aa], else nothing or several."""
    if any(str(kind) != "LITERAL" for kind, _ in items):
        return set()
    return {chr(value).lower() for _, value in items}


def text_key(text="text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def trigram_index(docs, text="text", rules=RULES):
    """Postings (gram, text_key) of the trigrams that the rules demand, one for each text and gram."""
    grams = sorted({g for rule in rules for way in demanded(rule.pattern) or () for g in way})
    lower = docs.select(text_key(text).alias("text_key"), F.lower(F.col(text)).alias("_lower"))
    held = F.array_compact(F.array(*(F.when(F.contains("_lower", F.lit(g)), F.lit(g)) for g in grams)))
    return lower.select("text_key", F.explode(held).alias("gram")).distinct()


def candidates(index, rules=RULES):
    """(text_key, rules): numbers of the rules of which some alternative is covered by postings."""
    terms = [
        (number, way_no, gram, len(way))
        for number, rule in enumerate(rules)
        for way_no, way in enumerate(demanded(rule.pattern) or ())
        for gram in way
    ]
    terms = index.sparkSession.createDataFrame(terms, "rule int, way int, gram string, needed int")
    # the terms come from the rules alone: a few hundred rows at most
    met = index.join(F.broadcast(terms), "gram").groupBy("text_key", "rule", "way", "needed").agg(F.count("*").alias("n"))
    return (
        met.filter("n = needed").select("text_key", "rule").groupBy("text_key")
        .agg(F.collect_set("rule").alias("rules"))
    )


def _spans(text, rule, number):
    """Spans of one rule; lengths of the parts between matches give the positions."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    parts = F.split(text, rule.pattern, -1)
    pairs = F.zip_with(matches, tested, lambda m, t: F.struct(m.alias("m"), t.alias("t")))
    zipped = F.zip_with(
        pairs, F.slice(parts, F.lit(1), F.size(matches)),
        lambda x, p: F.struct(x["m"].alias("m"), x["t"].alias("t"), p.alias("p")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(state, x):
        low = state["at"] + F.length(x["p"])
        high = low + F.length(x["m"])
        span = F.struct(low.alias("start"), F.lit(number).alias("kind_no"), high.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(F.length(x["t"]) >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(high.alias("at"), found.alias("found"))

    found = F.aggregate(zipped, start, step, lambda state: state["found"])
    # most texts have no match: one look is cheaper than three
    return F.when(F.rlike(text, F.lit(rule.look or rule.pattern)), found).otherwise(F.array().cast(SPANS))


def find_secrets(docs, text="text", rules=RULES):
    """``docs`` with ``spans``, sorted by start and rule."""
    index = durable(trigram_index(docs, text, rules), "trigrams")
    found = durable(candidates(index, rules).withColumnRenamed("rules", "_rules"), "candidates")
    keyed = docs.drop("spans").withColumn("_key", text_key(text))
    joined = keyed.join(found.withColumnRenamed("text_key", "_key"), "_key", "left")
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPANS)
    parts = []
    for number, rule in enumerate(rules):
        spans = _spans(body, rule, number)
        if demanded(rule.pattern) is not None:
            spans = F.when(F.array_contains("_rules", number), spans).otherwise(none)
        parts.append(spans)
    return joined.withColumn("spans", F.array_sort(F.concat(*parts))).drop("_key", "_rules")


def redacted(found, text="text", placeholder=PLACEHOLDER):
    """``text`` with each span, or run of overlapping spans, replaced; ``spans`` is used up."""
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, x):
        fresh = x["start"] >= state["at"]
        kept = F.substring(whole, state["at"] + 1, x["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], kept, F.lit(placeholder))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    cut = F.aggregate(
        "spans", start, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole)))
    )
    return found.withColumn(text, F.when(F.size("spans") > 0, cut).otherwise(F.col(text))).drop("spans")


def digest(spans):
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
