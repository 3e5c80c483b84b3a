"""HTML pages to blocks, text, sections, tables and links.

Pages aren't well-formed XML, so they are parsed with the standard library's tolerant parser in Arrow batches: one pass a page
makes an array of blocks, and everything after it is DataFrame functions over that array.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.arrays import let

# Elements that are never content; content roots in the order they are tried.
SKIP = {"nav", "header", "footer", "script", "style", "noscript", "template"}
SKIP_CLASSES = ("site-header", "site-footer", "site-nav", "menu", "breadcrumbs")
ROOTS = ("main", "article")
ROOT_IDS = ("content", "main-content", "page-content", "primary")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "dl", "dt", "dd", "body", "summary", "details"}

BLOCK_KIND = "struct<kind:string,level:int,root:int,anchor:string,text:string,cells:array<array<string>>,heads:int,links:array<string>>"
#: Elements whose id ends so hold a section's text; ``lo`` and ``hi`` are the places of the first block in it and behind it.
CONTAINER, CONTAINER_KIND = "container", "struct<id:string,lo:int,hi:int>"
#: Pages that are parsed and handed on together; the most rows or columns that one cell is spread over.
PAGES_AT_ONCE, MOST_SPAN = 32, 1000


def spread(rows: list[list[tuple[str, int, int, bool]]]) -> tuple[list[list[str]], int]:
    """A table's cells (text, rowspan, colspan, header) as a grid, each in every place it spans, and its leading header rows.

    A cell that spans below the last row adds no row; a row without cells of its own that no cell spans into is left out.
    """
    grid: list[list[str]] = []
    heads, leading = 0, True
    down: dict[int, tuple[str, int]] = {}
    for row in rows:
        out: list[str] = []
        cells = iter(row)
        cell = next(cells, None)
        while cell is not None or len(out) in down:
            if len(out) in down:
                text, left = down.pop(len(out))
                if left > 1:
                    down[len(out)] = (text, left - 1)
                out.append(text)
                continue
            text, rowspan, colspan, _ = cell
            for _ in range(colspan):
                if len(out) in down:
                    break  # cells that overlap: the one from above stays
                if rowspan > 1:
                    down[len(out)] = (text, rowspan - 1)
                out.append(text)
            cell = next(cells, None)
        for at in sorted(x for x in down if x > len(out)):
            out += [""] * (at - len(out))
            text, left = down.pop(at)
            if left > 1:
                down[at] = (text, left - 1)
            out.append(text)
        if out:
            leading = leading and bool(row) and all(th for *_, th in row)
            heads += leading
            grid.append(out)
    return grid, heads


def span(value: str | None) -> int:
    """A span attribute; what is no number or below 1 counts as 1."""
    return min(MOST_SPAN, max(1, int(value))) if value and value.strip().isdecimal() else 1


class _Parser(HTMLParser):
    """Blocks in document order: headings, paragraphs, list items, tables; each with the rank of the content root it is in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.title, self.in_title = "", False
        self.open: list[tuple[str, bool, int]] = []  # tag, skipped, root rank
        self.text: list[str] = []
        self.level, self.item, self.anchor = 0, False, None
        self.links: list[str] = []
        self.all_links: list[str] = []
        self.anchors: list[str] = []
        self.tables: list[list[list[tuple[str, int, int, bool]]]] = []
        self.cell: list[str] | None = None
        self.shape, self.heading_row = (1, 1, False), False
        self.containers: list[dict] = []
        self.inside: list[tuple[int, int]] = []  # depth of an open container, its place in the list

    @property
    def skipped(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    @property
    def root(self) -> int:
        return self.open[-1][2] if self.open else 9

    def flush(self) -> None:
        raw = "".join(self.text)
        text = "\n".join(" ".join(x.split()) for x in raw.split("\n")).strip()
        if text:
            kind = "heading" if self.level else "item" if self.item else "text"
            self.blocks.append({"kind": kind, "level": self.level, "root": self.root, "anchor": self.anchor, "text": text, "cells": None, "heads": 0, "links": self.links})
            self.anchor = None
        self.text, self.links = [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.all_links.append(a["href"])
            self.links.append(a["href"])
        if tag == "br":
            (self.cell if self.cell is not None else self.text).append("\n" if self.cell is None else " / ")
        if tag in VOID:
            return
        names = (a.get("class") or "").split()
        skip = self.skipped or tag in SKIP or any(n in SKIP_CLASSES for n in names)
        rank = self.root
        if tag in ROOTS:
            rank = min(rank, ROOTS.index(tag))
        elif a.get("id") in ROOT_IDS or "entry-content" in names:
            rank = min(rank, len(ROOTS))
        if tag in BLOCKS and not self.tables:
            self.flush()
        self.open.append((tag, skip, rank))
        if skip:
            return
        if (a.get("id") or "").lower().endswith(CONTAINER) and tag in BLOCKS and not self.tables:
            self.inside.append((len(self.open), len(self.containers)))
            self.containers.append({"id": a["id"], "lo": len(self.blocks), "hi": -1})
        if tag == "thead":
            self.heading_row = True
        if tag == "title":
            self.in_title = True
        elif a.get("id") and not self.tables:
            self.anchor = a["id"]
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
            self.shape = (span(a.get("rowspan")), span(a.get("colspan")), tag == "th" or self.heading_row)
        elif tag[0] == "h" and tag[1:].isdigit():
            self.level = int(tag[1:])
        elif tag == "li":
            self.item = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if not any(t == tag for t, _, _ in self.open):
            return
        if tag in ("td", "th") and self.cell is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1].append((" ".join("".join(self.cell).split()), *self.shape))
            self.cell = None
        elif tag == "table" and self.tables and not self.skipped:
            self.heading_row = False
            cells, heads = spread(self.tables.pop())
            if cells:
                self.blocks.append({"kind": "table", "level": 0, "root": self.root, "anchor": self.anchor, "text": "\n".join(" | ".join(r) for r in cells), "cells": cells, "heads": heads, "links": self.links})
                self.links = []
        elif tag in BLOCKS and not self.tables:
            self.flush()
        if tag[0] == "h" and tag[1:].isdigit():
            self.level = 0
        elif tag == "li":
            self.item = False
        elif tag == "thead":
            self.heading_row = False
        while self.open and self.open.pop()[0] != tag:
            pass
        while self.inside and self.inside[-1][0] > len(self.open):
            self.flush() if not self.tables else None
            self.containers[self.inside.pop()[1]]["hi"] = len(self.blocks)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skipped:
            (self.cell if self.cell is not None else self.text).append(data.replace("\r", " ") if self.cell is not None else data.replace("\r", " ").replace("\n", " "))


def parse_page(html: str | None) -> tuple[str, list[dict], list[str], list[dict]]:
    """Title, blocks, all link targets (navigation too), containers. Unclosed elements end with the page; null: nothing."""
    p = _Parser()
    p.feed(html or "")
    p.close()
    while p.tables:
        p.handle_endtag("table") if any(t == "table" for t, _, _ in p.open) else p.tables.pop()
    p.flush()
    for c in p.containers:
        c["hi"] = len(p.blocks) if c["hi"] < 0 else c["hi"]
    return " ".join(p.title.split()), p.blocks, p.all_links, p.containers


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The kept columns with title, blocks (array of structs), links and containers of each page; URL filters belong before this."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), PAGES_AT_ONCE):
                part = b.iloc[lo : lo + PAGES_AT_ONCE]
                got = [parse_page(h) for h in part["html"]]
                yield part[list(keep)].assign(title=[g[0] for g in got], blocks=[g[1] for g in got], links=[g[2] for g in got], containers=[g[3] for g in got])

    return pages.select(*keep, "html").mapInPandas(parse, f"{kinds}, title string, blocks array<{BLOCK_KIND}>, links array<string>, containers array<{CONTAINER_KIND}>")


def content(blocks: Column) -> Column:
    """The blocks of the best content root that has any (main, article, content elements, the whole body)."""
    best = F.array_min(F.transform(blocks, lambda b: b["root"]))
    return F.filter(blocks, lambda b: b["root"] == best)


def block_markdown(b: Column) -> Column:
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(b["cells"], F.lit(0)))))
    table = F.concat_ws("\n", row(F.get(b["cells"], F.lit(0))), rule, F.array_join(F.transform(F.slice(b["cells"], 2, F.greatest(F.size(b["cells"]) - 1, F.lit(0))), row), "\n"))
    return F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).when(b["kind"] == "item", F.concat(F.lit("- "), b["text"])).when(b["kind"] == "table", table).otherwise(b["text"])


def to_markdown(parsed: DataFrame) -> DataFrame:
    """Adds md: the page's content as markdown."""
    return parsed.withColumn("md", F.array_join(F.transform(content(F.col("blocks")), block_markdown), "\n\n"))


def page_title(parsed: DataFrame) -> Column:
    """The first h1, else the title element, else "Overview"."""
    h1 = F.get(F.filter("blocks", lambda b: (b["kind"] == "heading") & (b["level"] == 1)), F.lit(0))["text"]
    return F.coalesce(h1, F.nullif(F.col("title"), F.lit("")), F.lit("Overview"))


#: A section of a known anchor with fewer characters is taken from its container, where the page has one.
LEAST_SECTION = 500


def sections(parsed: DataFrame, known: tuple[str, ...] = X.ANCHORS, least: int = LEAST_SECTION) -> DataFrame:
    """Section rows (url, title, text, ordinal): an overview and one a known anchor; else one an h2 or h3; else the page.

    A section is a range of the page's blocks: from an anchor's first place (later ones go on with the section they stand in), or
    from each heading, to the next. An anchor's section of fewer than ``least`` characters is the text of its container ("<anchor>textcontainer", else
    "<anchor>container"), if the page has one. Pages that split into fewer than two sections give one row. Time is linear in the blocks.
    """
    d = parsed.select("url", page_title(parsed).alias("page_title"), content(F.col("blocks")).alias("blocks"), F.transform("blocks", lambda b: b["text"]).alias("all"), "containers").filter(F.size("blocks") > 0)
    d = d.withColumn("marks", F.transform("blocks", lambda b: X.canonical_anchor(b["anchor"], known)))
    d = d.withColumns({"by_anchor": F.exists("marks", lambda m: m.isNotNull()), "texts": F.transform("blocks", lambda b: b["text"])})
    by_heading = F.filter(F.transform("blocks", lambda b, i: F.when((b["kind"] == "heading") & b["level"].isin(2, 3), i)), lambda i: i.isNotNull())
    by_anchor = F.array_sort(F.transform(F.filter(F.array_distinct("marks"), lambda m: m.isNotNull()), lambda m: (F.array_position("marks", m) - 1).cast("int")))
    d = d.withColumn("starts", F.when(F.col("by_anchor"), by_anchor).otherwise(by_heading))
    # every section's first place and the one behind its last; what stands before the first start is the overview
    d = d.withColumn("bounds", F.concat(F.when(F.coalesce(F.get("starts", F.lit(0)), F.lit(1)) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), "starts", F.array(F.size("blocks"))))

    # bound once a page; a column named in a function over the sections could be worked out again for each of them
    page = F.struct("bounds", "starts", "texts", "marks", "blocks", "by_anchor", "all", "containers")

    def parts(t: Column) -> Column:
        def part(lo: Column, i: Column) -> Column:
            hi, b = F.get(t["bounds"], i + 1), F.get(t["blocks"], lo)
            is_head, begins = b["kind"] == "heading", (F.size(t["starts"]) > 0) & (lo >= F.get(t["starts"], F.lit(0)))
            head = F.when(begins, F.when(t["by_anchor"], F.get(t["marks"], lo)).otherwise(X.slugify(b["text"])))
            return F.struct(head.alias("h"), F.when(is_head, b["text"]).otherwise(head).alias("t"), F.slice(t["texts"], lo + 1, hi - lo).alias("lines"))

        def from_container(s: Column) -> Column:
            named = lambda end: F.get(F.filter(t["containers"], lambda c: F.lower(c["id"]) == F.concat(s["h"], F.lit(end))), F.lit(0))
            lines = let(F.coalesce(named("textcontainer"), named("container")), lambda c: F.when(c["hi"] > c["lo"], F.slice(t["all"], c["lo"] + 1, c["hi"] - c["lo"])))
            small = F.length(F.array_join(s["lines"], "\n")) < least
            return F.struct(s["h"].alias("h"), s["t"].alias("t"), F.when(small & s["h"].isNotNull(), F.coalesce(lines, s["lines"])).otherwise(s["lines"]).alias("lines"))

        whole = F.array(F.struct(F.lit(None).cast("string").alias("h"), F.lit("").alias("t"), t["texts"].alias("lines")))
        secs = F.transform(F.slice(t["bounds"], F.lit(1), F.size(t["bounds"]) - 1), part)
        return F.when(F.size(t["bounds"]) < 3, whole).when(t["by_anchor"], F.transform(secs, from_container)).otherwise(secs)

    out = d.select("url", "page_title", F.posexplode(let(page, parts)).alias("ordinal", "s"))
    at = F.when(F.col("s.h").isNull(), F.col("url")).otherwise(F.concat("url", F.lit("#"), F.col("s.h")))
    return out.select(at.alias("url"), F.when(F.col("s.h").isNull(), F.col("page_title")).otherwise(F.col("s.t")).alias("title"), F.array_join("s.lines", "\n").alias("text"), "ordinal")


def header_of(cells: Column, heads: Column) -> Column:
    """Column names of a grid: its one header row (without any, its first row); of several the levels as "('a', 'b')"."""
    levels = F.slice(cells, 1, F.greatest(heads, F.lit(1)))
    several = F.transform(F.get(levels, F.lit(0)), lambda x, i: F.concat(F.lit("('"), F.array_join(F.transform(levels, lambda r: F.coalesce(F.get(r, i), F.lit(""))), "', '"), F.lit("')")))
    return F.when(heads > 1, several).otherwise(F.get(levels, F.lit(0)))


def tables(parsed: DataFrame) -> DataFrame:
    """Table rows (url, table_no, heading, headers, rows): cells stand in every row and column they span; ``header_of`` names the columns.

    The heading is the nearest of the six h2 and h3 before it that names a term, else of the six after it, else the last one before it.
    """
    d = parsed.select("url", content(F.col("blocks")).alias("blocks")).select("url", "blocks", F.posexplode("blocks").alias("n", "b")).filter("b.kind = 'table'")
    heads = F.transform("blocks", lambda b, i: F.when((b["kind"] == "heading") & b["level"].isin(2, 3), F.struct(i.alias("i"), b["text"].alias("t"))))
    heads = F.filter(heads, lambda h: h.isNotNull())
    before = F.reverse(F.filter(heads, lambda h: h["i"] < F.col("n")))
    after = F.filter(heads, lambda h: h["i"] > F.col("n"))
    named = lambda hs: F.get(F.filter(F.slice(hs, 1, 6), lambda h: h["t"].rlike(X.TERM_WORD)), F.lit(0))["t"]
    heading = F.coalesce(named(before), named(after), F.lit(""))
    cells, top = F.col("b.cells"), F.greatest(F.col("b.heads"), F.lit(1))
    out = d.select("url", "n", heading.alias("heading"), header_of(cells, F.col("b.heads")).alias("headers"), F.slice(cells, top + 1, F.greatest(F.size(cells) - top, F.lit(0))).alias("rows"))
    return out.withColumnRenamed("n", "table_no")


def links(parsed: DataFrame) -> DataFrame:
    """Distinct link targets of each page, as written."""
    return parsed.select("url", F.explode("links").alias("href")).distinct()


def resolve(href: Column, base: Column) -> Column:
    """A link's absolute URL: absolute as it is, //host, /path and relative targets against the page's; others null."""
    origin = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(base, F.lit("HOST")))
    folder = F.regexp_replace(F.coalesce(F.try_parse_url(base, F.lit("PATH")), F.lit("/")), "[^/]*$", "")
    return (
        F.when(href.rlike("^https?://"), href)
        .when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") | href.startswith("#") | (href == ""), F.lit(None))
        .when(href.startswith("//"), F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )


def courses(parsed: DataFrame) -> DataFrame:
    """Course rows (url, code, title, credits) of blocks "CODE nnn Title (n credits)" or "CODE nnn. Title. n Credits"."""
    pattern = r"^([A-Z]{2,5})\s+(\d{3})\.?\s+(.*?)[.\s]*\(?(\d{1,2})\s+[Cc]redits?\)?"
    rows = parsed.select("url", F.explode(content(F.col("blocks"))).alias("b")).select("url", F.explode(F.split("b.text", "\n")).alias("line")).filter(F.col("line").rlike(pattern))
    x = lambda i: F.regexp_extract("line", pattern, i)
    return rows.select("url", F.concat_ws(" ", x(1), x(2)).alias("code"), F.trim(x(3)).alias("title"), x(4).cast("int").alias("credits")).distinct()
