"""URL and file-name columns."""

from pyspark.sql import Column, functions as F

from .text import col, trim_ws


def url_decode(c) -> Column:
    """Percent-decoding that keeps ``+`` and gives NULL for broken escapes or bad UTF-8."""
    c = col(c)
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    replaced = decoded.contains("�") & ~F.upper(c).contains("%EF%BF%BD") & ~c.contains("�")
    return F.when(~replaced, decoded)


def url_basename(url) -> Column:
    """Last path segment, ignoring query, fragment and trailing slashes."""
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def storage_name(url) -> Column:
    """First 12 hex digits of the URL's hash, ``_`` and the decoded base name."""
    digest = F.substring(F.sha2(col(url), 256), 1, 12)
    return F.concat(digest, F.lit("_"), url_decode(url_basename(url)))


def title_from_filename(name) -> Column:
    return F.translate(F.regexp_replace(col(name), r"(?i)\.pdf\z", ""), "-_", "  ")


def local_url(name) -> Column:
    return F.concat(F.lit("local://"), col(name))


def absolute_url(href, base) -> Column:
    """Anything starting with ``http`` stays, the rest hangs below ``base``."""
    href, base = col(href), base if isinstance(base, Column) else F.lit(base)
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("/"), F.concat(base, href))
        .otherwise(F.concat(base, F.lit("/"), href))
    )


def title_from_url(url, extension=".pdf") -> Column:
    """Decoded last segment without the file extension."""
    name = F.substring_index(col(url), "/", -1)
    pattern = r"(?i)\Q" + extension + r"\E\z"
    return url_decode(F.regexp_replace(name, pattern, "") if extension else name)


def link_title(text, url, extension=".pdf") -> Column:
    trimmed = trim_ws(text)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(title_from_url(url, extension))
