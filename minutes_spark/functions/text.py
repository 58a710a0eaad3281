"""Whitespace, digits and short labels.

The rules count U+3000, U+00A0 and U+FEFF as whitespace. Spark's ``trim`` and the regex
class ``\\s`` do not, so whitespace is always spelled out.
"""

from pyspark.sql import Column, functions as F

from .. import config

# Fixed set: the code points that count as whitespace.
_WS_CODES = (
    *range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
WS_CHARS = "".join(map(chr, _WS_CODES))
# The same set as the inside of a Java regex character class.
WS = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# The common letters stand first, as a range is seen faster than a script.
CJK = r"\u4E00-\u9FEF\u3041-\u3096\u30A1-\u30FA\p{IsHan}\p{IsKatakana}\p{IsHiragana}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def rtrim_ws(c) -> Column:
    return F.rtrim(col(c), F.lit(WS_CHARS))


def ltrim_ws(c) -> Column:
    return F.ltrim(col(c), F.lit(WS_CHARS))


def normalize_alias(c) -> Column:
    """The text without any whitespace."""
    return F.translate(col(c), WS_CHARS, "")


def zen_to_han(c) -> Column:
    """Full-width digits to ASCII digits."""
    return F.translate(col(c), "０１２３４５６７８９", "0123456789")


def _first_of(c, characters) -> Column:
    return F.substring(c, 1, 1).isin(*characters)


def is_blank_or_number(c) -> Column:
    """Lines that hold nothing, or a page number only."""
    c = col(c)
    # other lines are told by their first character
    return (c == "") | (_first_of(c, WS_CHARS + "0123456789") & c.rlike(rf"^[{WS}]*+[0-9]*+[{WS}]*+\z"))


def is_separator(c) -> Column:
    """Lines made of wave dashes, circles and spaces only."""
    return _first_of(col(c), WS_CHARS + "～~○◯") & col(c).rlike(rf"^[～~○◯{WS}]+\z")


def era_label(year) -> Column:
    """2024 -> R6."""
    return F.concat(F.lit("R"), (col(year) - 2018).cast("string"))


def era_option(year) -> Column:
    """2024 -> R6（2024）."""
    return F.concat(era_label(year), F.lit("（"), col(year).cast("string"), F.lit("）"))


def session_label(c) -> Column:
    c = col(c)
    label = F.lit(None).cast("string")
    for code, text in config.SESSION_LABELS.items():
        label = F.coalesce(label, F.when(c == code, F.lit(text)))
    return F.coalesce(label, c)


def shorten(c, n) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def speech_preview(c, n=500) -> Column:
    return shorten(c, n)


def topic_label(c, n=10) -> Column:
    return shorten(c, n)


def display_name(name, raw) -> Column:
    return F.coalesce(col(name), col(raw))


def display_role(role) -> Column:
    return F.coalesce(col(role), F.lit("unknown"))


def head_topics(c, n=3) -> Column:
    return F.slice(col(c), 1, n)


def in_preparation(n_documents) -> Column:
    return col(n_documents) == 0


def confidence_value(c) -> Column:
    c = col(c)
    value = F.lit(None).cast("double")
    for label, number in config.CONFIDENCE_VALUES.items():
        value = F.when(c == label, F.lit(number)).otherwise(value)
    return value


def speaker_role(c) -> Column:
    """Role text to role code; the first rule that applies wins."""
    c = col(c)

    def has(*parts):
        return c.rlike("|".join(parts))

    return (
        F.when(c == "議員", "councilor")
        .when(c == "市長", "mayor")
        .when(c.isin("副市長", "教育長"), "executive")
        .when(c.isin("議長", "副議長") | has("委員長"), "chair")
        .when(has("部長", "課長", "局長", "参事", "次長", "監査委員", "危機管理監"), "staff")
        .otherwise("unknown")
    )


def document_type(kind) -> Column:
    kind = col(kind)
    return (
        F.when(kind.isin("regular", "extra"), "minutes")
        .when(kind == "committee", "committee_minutes")
        .otherwise("other")
    )


def section_kind(text) -> Column:
    text = col(text)
    kind = F.lit("other")
    for pattern, code in reversed(config.SECTION_KINDS):
        kind = F.when(text.rlike(pattern), code).otherwise(kind)
    return kind


def estimate_tokens(c) -> Column:
    """Half a token per UTF-16 unit, rounded up."""
    units = F.octet_length(F.encode(col(c), "UTF-16BE")) / 2
    return F.ceil(units * 0.5).cast("long")


def prefixes(c, shortest, longest) -> Column:
    """Array of the prefixes of ``c`` from ``shortest`` to ``longest`` characters."""
    c, longest = col(c), col(longest)
    return F.when(
        longest >= shortest,
        F.transform(F.sequence(F.lit(shortest), longest), lambda n: F.substring(c, F.lit(1), n)),
    ).otherwise(F.array().cast("array<string>"))
