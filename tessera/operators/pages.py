"""Extraction from stored HTML pages.

Titles and links are SQL expressions.  What needs the element structure (breadcrumbs, tabs, tables, galleries)
is read by a small tree over the standard library's parser, batch by batch, one row per page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens in links that are no species or plant pages.
JUNK = [".css", ".js", ".png", ".jpg", "?", "user", "about", "contact"]
PLANT_JUNK = [".css", ".js", "?", "#", "user", "about", "contact", "search", "species-list", "larval-host", "hostplant"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag that ends an open one of the second set.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "div": {"p"}, "ul": {"p"}, "table": {"p"}}
BREADCRUMB = "system-breadcrumb-listing"
IMAGE = "struct<url:string,caption:string,kind:string,position:int>"
HOST = "struct<scientific:string,common:string,slug:string,url:string>"
SCHEMA = (
    "page_id long, title string, taxonomy map<string,string>, common_names map<string,string>, early_text array<string>, distribution string, description array<string>, "
    f"sightings array<map<string,string>>, larval_host_plants string, images array<{IMAGE}>, hosts array<{HOST}>"
)


#: Pages, and characters of HTML, whose parts are held at once.
PAGES, CHARS = 256, 4 << 20


def title(html: Column) -> Column:
    """Text of the title element, 'Unknown Title' without one."""
    found = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("Unknown Title"))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def frontier(pages: DataFrame, base: str = "https://site.example", plants: bool = False) -> DataFrame:
    """(url, page_id, pos): links of index pages that lead to item pages, each where it occurs first.

    Items start with a capital and hold a dash; plants have one slash and don't start with a capital.
    """
    x = pages.select("page_id", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    h, second = F.col("href"), F.substring("href", 2, 1)
    capital = (second != F.lower(second)) & (second == F.upper(second))
    ok = F.startswith(h, F.lit("/")) & (F.length(h) > 2) & F.contains(h, F.lit("-"))
    ok = ok & (~capital & (F.length(h) - F.length(F.replace(h, F.lit("/"), F.lit(""))) == 1) if plants else capital)
    for t in PLANT_JUNK if plants else JUNK:
        ok = ok & ~F.contains(h, F.lit(t))
    x = x.filter(ok).select(F.concat(F.lit(base), h).alias("url"), F.struct("page_id", "pos").alias("_at"))
    return x.groupBy("url").agg(F.min("_at").alias("_at")).select("url", "_at.page_id", "_at.pos")


class Node:
    """An element with its children; children are nodes and strings."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def all(self, *tags: str, cls: str | None = None) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags and (cls is None or cls in n.attrs.get("class", "").split())]

    def by_id(self, id_: str) -> Node | None:
        return next((n for n in self.walk() if n.attrs.get("id") == id_), None)

    def text(self, sep: str = "") -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in ("script", "style"):
                todo += reversed(c.children)
        return " ".join((sep.join(x.strip() for x in out) if sep else "".join(out)).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while len(self.open) > 1 and self.open[-1].tag in CLOSES.get(tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _taxonomy(root: Node) -> tuple[dict[str, str], dict[str, str]]:
    ranks: dict[str, str] = {}
    common: dict[str, str] = {}
    bar = root.by_id(BREADCRUMB)
    for a in bar.all("a") if bar else ():
        spans = a.all("span")
        rank = spans[0].attrs.get("class", "").split(" ")[0].replace("style-", "") if spans else ""
        if rank and spans[0].text():
            ranks.setdefault(rank, spans[0].text())
            if len(spans) > 1:
                common[rank] = spans[1].text()
    return ranks, common


def _table(table: Node | None) -> list[dict[str, str]]:
    """Rows under the header cells; cells past the header are left out."""
    heads = [h.text() for h in table.all("th")] if table else []
    rows = [dict(zip(heads, [c.text() for c in tr.all("td", "th")], strict=False)) for tr in table.all("tr")[1:]] if table else []
    return [r for r in rows if r]


def _caption(a: Node) -> str:
    if img := next(iter(a.all("img")), None):
        return " ".join(img.attrs.get("alt", "").split())
    try:
        return " ".join(str(json.loads(a.attrs.get("data-cbox-img-attrs", "{}")).get("alt", "")).split())
    except (ValueError, AttributeError):
        return ""


def _images(root: Node, base: str, tabs: dict[str, str]) -> list[dict[str, Any]]:
    """Hero and gallery images, each url once, the first occurrence."""
    found: dict[str, dict[str, Any]] = {}

    def add(url: str, caption: str, kind: str) -> None:
        url = base + url if url.startswith("/") else url
        if url and url not in found:
            found[url] = {"url": url, "caption": caption or "Unknown", "kind": kind, "position": len(found) + 1}

    for hero in root.all("div", cls="ihgwraapper")[:1]:
        for img in hero.all("img")[:1]:
            add(img.attrs.get("src", ""), img.attrs.get("alt", ""), "hero")
    for tab, kind in tabs.items():
        for a in (root.by_id(tab) or Node("", {})).all("a", cls="colorbox"):
            add(a.attrs.get("href", ""), _caption(a), kind)
    for a in root.all("a", cls="colorbox"):
        add(a.attrs.get("href", ""), _caption(a), "gallery")
    return list(found.values())


def _hosts(root: Node, base: str, any_heading: bool) -> list[dict[str, str]]:
    out = []
    for div in root.all("div", cls="textContent"):
        head = next(iter(div.all("h4")), None)
        if head is None or not (any_heading or "Larval Host" in head.text() or "Nectar Plant" in head.text()):
            continue
        for a in div.all("a", cls="spe-a"):
            href, rest, em = a.attrs.get("href", ""), a.text(), next(iter(a.all("em")), None)
            out.append({
                "scientific": em.text() if em else rest.split("–")[0].strip(), "common": rest.split("–")[-1].strip() if "–" in rest else "",
                "slug": href.rstrip("/").split("/")[-1], "url": base + href if href.startswith("/") else href,
            })
    return out


def read_page(html: str | None, base: str = "https://site.example", any_heading: bool = False) -> dict[str, Any]:
    """All parts of one page; an empty page has empty parts."""
    root = tree(html)
    ranks, common = _taxonomy(root)
    early, dist, stat, larval = (root.by_id(x) for x in ("early", "dist", "stat", "laraval"))
    heading = next(iter(root.all("title")), None)
    return {
        "title": (heading.text() if heading else "") or "Unknown Title", "taxonomy": ranks, "common_names": common,
        "early_text": [t for p in (early.all("p") if early else ()) if (t := p.text()).replace(",", "").strip()],
        "distribution": dist.text(" ") if dist else None,
        "description": [t for c in (stat.children if stat else ()) if isinstance(c, Node) and c.tag == "p" and (t := c.text())],
        "sightings": _table(next(iter(stat.all("table")), None) if stat else None),
        "larval_host_plants": larval.text(" ") if larval else None,
        "images": _images(root, base, {"early": "early", "adult": "adult"}), "hosts": _hosts(root, base, any_heading),
    }


def read_pages(pages: DataFrame, base: str = "https://site.example", any_heading: bool = False) -> DataFrame:
    """One row per page with its parts (columns of SCHEMA), handed on for so many pages or characters at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for i, h in zip(b["page_id"], b["html"], strict=True):
                rows.append((i, *read_page(h, base, any_heading).values()))
                held += len(h or "")
                if len(rows) >= PAGES or held >= CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    names = pages.sparkSession.createDataFrame([], SCHEMA).columns
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(run, SCHEMA)


def host_edges(parts: DataFrame) -> DataFrame:
    """(page_id, scientific) once each."""
    return parts.select("page_id", F.explode("hosts").alias("h")).select("page_id", "h.scientific").distinct()
