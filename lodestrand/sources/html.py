"""HTML parsing: links by pattern, and the text of elements that carry given classes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href) of quoted href attributes, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


class _Classes(HTMLParser):
    """Gathers, for each wanted class set, the text inside the elements that have it."""

    def __init__(self, wanted: list[str]):
        super().__init__(convert_charrefs=True)
        self.sets = [(w, frozenset(w.split())) for w in wanted]
        self.depth, self.open, self.found = 0, {}, {w: [] for w in wanted}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.depth += 1
        own = set((dict(attrs).get("class") or "").split())
        for name, need in self.sets:
            if name not in self.open and need <= own:
                self.open[name] = self.depth

    def handle_endtag(self, tag):
        if tag in VOID or not self.depth:
            return
        for name in [n for n, d in self.open.items() if d == self.depth]:
            del self.open[name]
        self.depth -= 1

    def handle_data(self, data):
        for name in self.open:
            self.found[name].append(data)


def class_text(html: str | None, wanted: list[str]) -> dict[str, str]:
    parser = _Classes(wanted)
    parser.feed(html or "")
    parser.close()
    return {k: " ".join(" ".join(v).split()) for k, v in parser.found.items()}


def result_row(block: str) -> dict | None:
    """id, title, authors, summary, categories and date of one result block; None without an id. The id goes without its
    version, the full abstract comes before the short one, and labels in front of texts are cut."""
    got = class_text(block, ["list-title", "title", "authors", "abstract-full", "abstract-short", "tag", "is-size-7"])
    found = re.search(r"(?:abs/|arXiv:)([^\s\"'<>]+?)(?:v\d+)?(?=[\s\"'<>]|$)", block)
    if not found:
        return None
    bare = lambda text, label: re.sub(rf"^{label}\s*", "", text, flags=re.IGNORECASE).strip()
    tags = [unescape(" ".join(re.sub("<[^>]*>", "", t).split())) for t in re.findall(r"<span[^>]*class=[\"'][^\"']*\btag\b[^\"']*[\"'][^>]*>(.*?)</span>", block, re.DOTALL)]
    return {"id": found[1], "title": got["title"], "authors": [a for x in bare(got["authors"], "Authors:").split(",") if (a := x.strip())], "summary": bare(got["abstract-full"] or got["abstract-short"], "abstract:"), "categories": ", ".join(tags)}


def results(pages: DataFrame, query: str = "", key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, query, id, title, authors, summary, categories): a row per list item of class arxiv-result that has an id."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            rows = []
            for k, page in zip(frame[key], frame[html], strict=True):
                blocks = re.findall(r"<li[^>]*class=[\"'][^\"']*\barxiv-result\b[^\"']*[\"'][^>]*>(.*?)</li>", page or "", re.DOTALL)
                rows += [{key: k, "pos": n, "query": query, **row} for n, row in enumerate(filter(None, map(result_row, blocks)))]
            yield pd.DataFrame(rows, columns=[key, "pos", "query", "id", "title", "authors", "summary", "categories"])

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, pos int, query string, id string, title string, authors array<string>, summary string, categories string")


def fields(pages: DataFrame, wanted: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, field, text): one row per page and class set, white space collapsed, entities resolved."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            rows = [(k, name, text) for k, page in zip(frame[key], frame[html], strict=True) for name, text in class_text(page, wanted).items()]
            yield pd.DataFrame(rows, columns=[key, "field", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, field string, text string")
