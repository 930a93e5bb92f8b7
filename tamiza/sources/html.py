"""Review pages as a table of HTML (S7 to S10). Pages are fetched elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "timestamp raw_text clean_text rating emotion intensity source product_id category marca modelo".split()])
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reviews(HTMLParser):
    """Collects articles of comments with their text, date and rating, the first of each."""

    def __init__(self) -> None:
        super().__init__()
        self.marked: list[dict] = []  # articles with the test id
        self.classed: list[dict] = []  # articles by class
        self.open: list[tuple[str, dict | None, str | None]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        row, part = None, None
        if tag == "article" and (a.get("data-testid") == "comment-component" or "comment" in a.get("class", "")):
            row = {}
            (self.marked if a.get("data-testid") == "comment-component" else self.classed).append(row)
        elif tag == "p" and "comment__content" in classes:
            part = "raw_text"
        elif tag == "span" and any(c in ("comment__date", "comment-date") for c in classes):
            part = "timestamp"
        elif tag == "p" and "andes-visually-hidden" in classes:
            part = "rating"
        inside = next((r for _, r, _ in reversed(self.open) if r is not None), None)
        if part and inside is not None and part in inside:
            part = None
        if part and inside is not None:
            inside[part] = ""
        self.open.append((tag, row, part))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        row = next((r for _, r, _ in reversed(self.open) if r is not None), None)
        part = next((p for _, _, p in reversed(self.open) if p), None)
        if row is not None and part:
            row[part] = row.get(part, "") + data

    def rows(self) -> list[dict]:
        return [r for r in (self.marked or self.classed) if r.get("raw_text", "").strip()]


def parse_reviews(pages: DataFrame, source: str = "", category: str = "laptop") -> DataFrame:
    """One row per review with text of pages (product_id, marca, modelo, html). A NULL page has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for page in p.itertuples(index=False):
                parser = _Reviews()
                parser.feed(page.html or "")
                for r in parser.rows():
                    out.append((r.get("timestamp", "").strip(), r["raw_text"].strip(), "", r.get("rating", "").strip(), "", "", source, page.product_id, category, page.marca, page.modelo))
            yield pd.DataFrame(out, columns=SCHEMA.names)

    return pages.select("product_id", "marca", "modelo", "html").mapInPandas(run, SCHEMA)


def review_link(html: Column, host: str) -> Column:
    """The first link to the review catalogue, with host; else the link of the review summary, with host only if relative; else NULL."""
    tag = r'(?is)<a\b(?=[^>]*\bdata-testid\s*=\s*"review-summary")[^>]*\bhref\s*=\s*"([^"]*)"'
    first = F.regexp_extract(html, r'(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*/noindex/catalog/reviews/[^"]*)"', 1)
    other = F.regexp_extract(html, tag, 1)
    return F.when(first != "", F.concat(F.lit(host), first)).when(other.startswith("/"), F.concat(F.lit(host), other)).when(other != "", other)


def dedupe_reviews(reviews: DataFrame, order: str) -> DataFrame:
    """Of equal texts of a product the first in order."""
    from tamiza.operators.analytics import keep_first

    return keep_first(reviews, ["product_id", "raw_text"], [F.col(order)])
