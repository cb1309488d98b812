"""Posts of saved HTML pages: text, stamp, counts and link of each article, and the link to the next page.

Pages are parsed in Arrow batches with the standard library's parser; a page that is no HTML has no posts.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.numbers import scraped_count

FIELDS = {"post-text": "text", "timestamp": "stamp", "reactions": "reactions", "comments": "comments", "shares": "shares"}


class _Articles(HTMLParser):
    """Collects the marked fields of each ``article`` (or ``div`` with role article)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.posts: list[dict[str, str]] = []
        self.next = None
        self.open: list[tuple[str, str | None]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "br":
            self.handle_data("\n")
            return
        if tag in ("img", "meta", "link", "input", "hr"):
            return
        if tag == "article" or a.get("role") == "article":
            self.posts.append({})
        field = next((FIELDS[c] for c in classes if c in FIELDS), None)
        self.open.append((tag, field))
        if tag == "a" and a.get("href"):
            if "next" in classes or a.get("rel") == "next":
                self.next = a["href"]
            elif self.posts and "permalink" in classes:
                self.posts[-1]["url"] = a["href"]
        if tag == "time" and a.get("datetime") and self.posts:
            self.posts[-1]["stamp"] = a["datetime"]

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        field = next((f for _, f in reversed(self.open) if f), None)
        if field and self.posts:
            self.posts[-1][field] = self.posts[-1].get(field, "") + data


def parse_pages(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """id, post_no, text, stamp, url, the three counts and next_page, one row per article."""
    names = ["text", "stamp", "url", "reactions", "comments", "shares"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, page in zip(b[id_col], b[html], strict=True):
                p = _Articles()
                if isinstance(page, str):
                    p.feed(page)
                    p.close()
                rows += [(i, n, *[x.get(k) for k in names], p.next) for n, x in enumerate(p.posts, 1)]
            if rows:
                yield pd.DataFrame(rows, columns=[id_col, "post_no", *names, "next_page"])

    kind = df.schema[id_col].dataType.simpleString()
    raw = df.select(id_col, html).mapInPandas(run, f"{id_col} {kind}, post_no int, " + ", ".join(f"{n} string" for n in [*names, "next_page"]))
    return raw.withColumns({n: scraped_count(F.col(n)) for n in ("reactions", "comments", "shares")})
