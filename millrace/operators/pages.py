"""HTML pages into text, links and contacts; links resolved; bounded crawls over a table of links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.runtime import ship, stage

_CHROME = {"script", "style", "nav", "header", "footer", "aside", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Text outside the chrome; links, title and first headings of the whole page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.text: list[str] = []
        self.links: list[list[str]] = []
        self.title, self.h1, self.now = "", "", None

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.stack.append(tag)
        if tag == "a" and (href := dict(attrs).get("href")):
            self.now = [href, ""]
            self.links.append(self.now)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag == "a":
            self.now = None

    def handle_data(self, data):
        if self.now is not None:
            self.now[1] += data
        if "title" in self.stack:
            self.title += data
        elif not _CHROME.intersection(self.stack):
            if "h1" in self.stack and not self.h1:
                self.h1 = data.strip()
            if data.strip():
                self.text.append(data.strip())


def parse_html(html: str, base: str, most_chars: int = 20_000) -> dict:
    p = _Page()
    p.feed(html)
    p.close()
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}", " ", "\n".join(p.text)))
    links = []
    for href, anchor in p.links:
        try:
            url = urldefrag(urljoin(base, href.strip()))[0]
        except ValueError:
            continue
        if url.startswith("http"):
            links.append({"url": url, "link_text": " ".join(anchor.split())})
    return {"title": p.title.strip(), "h1": p.h1, "text": text if len(text) <= most_chars else text[:most_chars] + "\n[truncated]", "links": links}


_PARSED = "id long, title string, h1 string, text string, links array<struct<url:string,link_text:string>>"


def parse_pages(df: DataFrame, id_col: str, url_col: str, html_col: str, most_chars: int = 20_000) -> DataFrame:
    """id, name (first heading, else title), text, phones, emails, pdf_links (20 at most, in order), links. A null page
    has null text and no links."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.list_(pa.struct([("url", pa.string()), ("link_text", pa.string())]))
        for b in batches:
            out = [parse_html(h, u or "", most_chars) if h is not None else {"title": None, "h1": None, "text": None, "links": []} for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            col = lambda k, kind: pa.array([x[k] for x in out], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), col("title", pa.string()), col("h1", pa.string()), col("text", pa.string()), col("links", link)], ["id", "title", "h1", "text", "links"])

    parsed = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, _PARSED)
    urls = F.transform("links", lambda x: x["url"])
    pdfs = F.slice(F.array_distinct(F.filter(urls, lambda u: F.lower(u).rlike(r"\.pdf$|/pdf"))), 1, 20)
    return parsed.select("id", F.coalesce(F.nullif("h1", F.lit("")), F.nullif("title", F.lit("")), F.lit("Untitled")).alias("name"), "text", T.phones(F.col("text")).alias("phones"), T.emails(F.col("text")).alias("emails"), pdfs.alias("pdf_links"), "links")


def crawl(seeds: DataFrame, links: DataFrame, pages: DataFrame, depth: int = 2, most_pages: int = 30) -> DataFrame:
    """county, url, depth, rank: breadth-first over links (src, dst, pos) from seeds (county, url), at most `depth` hops
    and `most_pages` saved pages a county. pages (url, expands, saved) says which pages are followed and which kept.

    A step a hop: the frontier joined with the links, less what was visited; each step is written to the shared folder.
    The order is that of depth, of the parent, of the link's place."""
    frontier = stage(seeds.select("county", "url", F.lit(0).alias("depth"), F.lit("").alias("path")).distinct(), "frontier")
    visited = frontier
    for d in range(1, depth + 1):
        grown = frontier.join(pages.where("expands").select("url"), "url", "left_semi").join(links, F.col("url") == F.col("src"))
        nxt = grown.select("county", F.col("dst").alias("url"), F.lit(d).alias("depth"), F.concat_ws("/", "path", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("path"))
        nxt = nxt.groupBy("county", "url").agg(F.first("depth").alias("depth"), F.min("path").alias("path")).join(visited, ["county", "url"], "left_anti")
        frontier = stage(nxt, "frontier")
        visited = visited.unionByName(frontier)
    from millrace.operators.ordering import top_per_group

    kept = visited.join(pages.where("saved").select("url"), "url", "left_semi")
    return top_per_group(kept, ["county"], [F.col("depth"), F.col("path"), F.col("url")], most_pages).select("county", "url", "depth", "rank")
