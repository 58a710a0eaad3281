"""Document links of web pages."""

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import section_kind
from ..functions.urls import absolute_url, link_title

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class _Anchors(HTMLParser):
    """Anchors of one page in document order, each with the last heading before it."""

    def __init__(self, headings):
        super().__init__(convert_charrefs=True)
        self.headings = headings
        self.open = []  # (tag, its list of texts if it is a heading or an anchor)
        self.depth = Counter()  # open tags by name
        self.taken = []  # lists of texts of the open headings and anchors
        self.heading = None
        self.anchors = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        texts = [] if tag == "a" or tag in self.headings else None
        if tag in self.headings:
            self._close_to(self.headings)
            self.heading = texts
        elif tag == "a":
            self._close_to(("a",))
            self.anchors.append((dict(reversed(attrs)).get("href"), texts, self.heading))
        self.open.append((tag, texts))
        self.depth[tag] += 1
        if texts is not None:
            self.taken.append(texts)

    def handle_endtag(self, tag):
        self._close_to((tag,))

    def handle_data(self, data):
        for texts in self.taken:
            texts.append(data)

    def _close_to(self, tags):
        """Close the innermost of ``tags`` with all it holds; every tag is closed only once."""
        if not any(self.depth[tag] for tag in tags):
            return
        closed = None
        while closed not in tags:
            closed, texts = self.open.pop()
            self.depth[closed] -= 1
            if texts is not None:
                self.taken.pop()


def page_anchors(html: str, headings) -> list[tuple]:
    """``(position, href, text, text of the last heading)`` of each anchor with a target."""
    parser = _Anchors(headings)
    parser.feed(html)
    parser.close()
    found = [(href, text, heading) for href, text, heading in parser.anchors if href]
    return [
        (at, href, "".join(text), None if heading is None else "".join(heading))
        for at, (href, text, heading) in enumerate(found)
    ]


def extract_anchors(pages: DataFrame, headings=("h2", "h3", "h4"), html="html") -> DataFrame:
    """Anchors of all pages. A page is one row, so nothing is shuffled."""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [page_anchors(text, headings) for text in batch[html].fillna("")]
            rows = batch[keep].assign(_a=found).explode("_a", ignore_index=True)
            rows = rows[rows["_a"].notna()]
            for at, name in enumerate(("pos", "href", "text", "heading")):
                rows[name] = [a[at] for a in rows["_a"]]
            yield rows.drop(columns="_a")

    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep
    )
    return pages.mapInPandas(run, f"{fields}, pos int, href string, text string, heading string")


def extract_links(
    pages: DataFrame, base_url, path_filter="", extension=".pdf", headings=("h2", "h3", "h4"),
    html="html",
) -> DataFrame:
    """Links whose address has ``path_filter`` and ends in ``extension`` (any case)."""
    anchors = extract_anchors(pages, headings, html)
    return (
        anchors.filter(
            F.contains("href", F.lit(path_filter))
            & F.lower("href").endswith(extension.lower())
        )
        .withColumn("url", absolute_url("href", base_url))
        .withColumn("title", link_title("text", "href", extension))
        .withColumn("section_kind", section_kind(F.coalesce("heading", F.lit(""))))
        .drop("href", "text", "heading")
    )
