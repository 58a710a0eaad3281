"""Quality rules as weak supervision.

Each rule votes on a text, good or bad, or abstains. Expectation maximisation over the counts
of the vote patterns of all texts estimates the share of good texts and the accuracy of each
rule's votes; a text is kept if the posterior probability of good is at least one half. Votes, features and posterior are column functions;
only pattern counts, at most 3 to the number of rules, reach the driver.

Cases: a null or empty text has zero features and fails the base rule; ties at one half are
kept; repeated rows get equal results; on an empty table the first accuracies stay; other
columns of the input stay unless they have a result's name. Windows of words are compared by
64-bit hashes.
"""

import math
from dataclasses import dataclass

from pyspark.sql import functions as F

from .common import WORD_SPACE, durable

# Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
#: First accuracy and first share of good texts; accuracies stay inside BOUNDS.
ACCURACY, GOOD_SHARE, BOUNDS, ROUNDS = 0.85, 0.8, (0.55, 0.999), 50
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains; both are SQL conditions."""

    name: str
    bad: str
    good: str = "false"


# Defects seldom come together, so a rule against one abstains on texts that lack it.
RULES = (
    Rule("length", "n_words < 50"),
    Rule("symbols_in_text", "n_symbols > 0.05 * word_chars"),
    Rule("symbols_per_word", "n_symbols > 0.25 * n_words"),
    Rule("repeated_words", "n_repeat_words > 0.25 * n_words"),
    Rule("few_kinds_of_words", "n_words >= 30 AND n_kinds < 0.25 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.25 * n_lines"),
    Rule("capitals", "n_upper > 0.3 * word_chars"),
    Rule("exclamations", "n_marks > 0.2 * n_words"),
    Rule("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words"),
    Rule(
        "prose",
        "false",
        "n_words >= 50 AND n_symbols < 0.005 * word_chars AND n_upper < 0.1 * word_chars AND n_marks < 0.02 * n_words",
    ),
    Rule(
        "fresh_words",
        "false",
        "n_words >= 50 AND n_repeat_words < 0.05 * n_words AND n_symbols < 0.1 * n_words AND n_marks < 0.1 * n_words",
    ),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(text, letters):
    return F.length(text) - F.length(F.translate(text, letters, ""))


def features(docs, text="text"):
    """``docs`` with the numbers that the rules use, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, f"[{WORD_SPACE}]+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    out = docs.withColumns({"_words": words, "_lines": lines})
    w = F.col("_words")
    windows = F.when(
        F.size(w) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_windows", windows)
    sorted_ = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(some, sorted_))
    s = F.col("_sorted")
    twice = F.transform(
        s,
        lambda x, i: F.when(
            F.get(s, i + 1)["h"].eqNullSafe(x["h"]) | F.get(s, i - 1)["h"].eqNullSafe(x["h"]),
            x["i"],
        ),
    )
    out = out.withColumn("_places", F.when(s.isNotNull(), F.array_sort(F.array_compact(twice))))
    p = F.col("_places")
    # each place covers its window up to the next place
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    found = {
        "n_words": F.size("_words"),
        "n_kinds": F.size(F.array_distinct("_words")),
        "word_chars": F.length(F.translate(body, _SPACES, "")),
        "n_symbols": _count(body, SYMBOLS),
        "n_upper": _count(body, _UPPER),
        "n_marks": _count(body, "!"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    out = out.withColumns({k: v.cast("long") for k, v in found.items()})
    return out.drop("_words", "_lines", "_windows", "_sorted", "_places")


def votes(rules=RULES):
    """Columns vote_<rule>: 1 good, 0 bad, null abstained."""
    return {f"vote_{r.name}": F.when(F.expr(r.bad), 0).when(F.expr(r.good), 1) for r in rules}


def learn(patterns, size, rounds=ROUNDS):
    """(share of good texts, accuracy of each rule) from [(votes, count)] by EM."""
    share, rates = GOOD_SHARE, [ACCURACY] * size
    patterns = sorted(patterns, key=lambda x: [-1 if v is None else v for v in x[0]])
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        weighted = [(v, n, posterior(v, share, rates)) for v, n in patterns]
        share = min(0.999, max(0.001, sum(n * g for _, n, g in weighted) / total))
        new = []
        for i in range(size):
            voted = [(n, g if v[i] else 1 - g) for v, n, g in weighted if v[i] is not None]
            # one more vote at the first accuracy keeps a silent rule defined
            rate = (sum(n * right for n, right in voted) + ACCURACY) / (sum(n for n, _ in voted) + 1)
            new.append(min(BOUNDS[1], max(BOUNDS[0], rate)))
        rates = new
    return share, rates


def _weight(rate):
    return math.log(rate / (1 - rate))


def posterior(vote, share, rates):
    """Probability of good from the votes of one text."""
    logit = _weight(share) + sum(_weight(r) * (1 if v else -1) for v, r in zip(vote, rates) if v is not None)
    return 1 / (1 + math.exp(-logit))


def judge(docs, text="text", rules=RULES, with_text=True):
    """``docs`` with features, base_failed, quality (posterior of good) and kept.

    The features are written once, with the texts unless ``with_text`` is false.
    """
    names = [f"vote_{r.name}" for r in rules]
    measured = features(docs, text).withColumns(votes(rules))
    measured = durable(measured if with_text else measured.drop(text), "quality-features")
    counts = measured.groupBy(*names).count().collect()
    share, rates = learn([(tuple(r[n] for n in names), r["count"]) for r in counts], len(rules))
    logit = F.lit(_weight(share))
    for name, rate in zip(names, rates):
        logit = logit + F.when(F.col(name) == 1, _weight(rate)).when(F.col(name) == 0, -_weight(rate)).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    judged = measured.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-logit))})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
