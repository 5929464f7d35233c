"""Pages: main text from HTML, link frontiers, listings.  HTML is parsed with the standard library."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanlake.functions.urls import depth, link_score, page_key, same_host, skipped_link

# Element names by their part in a page.
CHROME = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg", "template", "button", "select"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "search", "dialog"}
TEXT = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "dd", "dt", "figcaption"}
BLOCK = TEXT | {"div", "section", "article", "main", "ul", "ol", "table", "tr", "body", "dl", "figure", "pre", "address"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
TAGGED = {"p", "li", "h2", "h3", "h4", "h5", "h6", "blockquote"}
# Opening words of blocks that are page furniture.
BOILERPLATE = (
    "home", "about", "menu", "skip to", "copyright", "©", "all rights reserved", "powered by", "authorized by", "privacy policy", "terms", "follow us", "follow me", "share this",
    "sign up", "subscribe", "donate", "volunteer", "contact", "back to top", "read more", "learn more",
)


def is_boilerplate(text: str, openings: tuple[str, ...] = BOILERPLATE) -> bool:
    """Does text open with one of the openings as whole words?"""
    low = text.lower()
    word = lambda c: c.isalnum() or c == "_"
    return any(low.startswith(o) and word(o[-1]) != (len(low) > len(o) and word(low[len(o)])) for o in openings)


class _Blocks(HTMLParser):
    """Collects the text of the innermost block elements outside page chrome, the title and the links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, bool, str]] = []  # inside the main element, of a text element, text
        self.links: list[tuple[str, str]] = []
        self.events: list[tuple[str, str, str]] = []  # in order: block element and text, or a, label and address
        self.title = ""
        self._open: list[tuple[str, bool]] = []  # tag, does it begin chrome
        self._hidden = 0
        self._main = 0
        self._mains: list[int] = []  # how deep each open main element lies
        self.has_main = False
        self._text: list[str] = []
        self._href: list[str] = []
        self._label: list[str] = []
        self._in_title = False

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            inner = next((t for t, _ in reversed(self._open) if t in BLOCK), "")
            self.blocks.append((self._main > 0, inner in TAGGED, text))
            self.events.append((inner, text, ""))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag == "title":
            self._in_title = True
        if tag == "a" and named.get("href"):
            self._href, self._label = [named["href"] or ""], []
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        chrome = tag in CHROME or (named.get("role") or "").lower() in CHROME_ROLES
        if tag in BLOCK or chrome:
            around = [t for t, _ in self._open if t in BLOCK or t in CHROME]
            if around and around[-1] == "p":  # a paragraph without its end tag ends here
                self._close("p")
            if tag == "li" and "li" in around and not {"ul", "ol"} & set(around[len(around) - around[::-1].index("li") :]):
                self._close("li")
        if tag in BLOCK or chrome:
            if not self._hidden:
                self._flush()
        self._open.append((tag, chrome))
        self._hidden += chrome
        if tag == "main" or (named.get("role") or "").lower() == "main":
            self._mains.append(len(self._open))
            self._main, self.has_main = len(self._mains), True

    def _close(self, tag: str) -> None:
        while self._open:
            name, chrome = self._open.pop()
            if name in BLOCK or chrome:
                if not self._hidden:
                    self._open.append((name, chrome))
                    self._flush()
                    self._open.pop()
                self._text = []
            self._hidden -= chrome
            while self._mains and self._mains[-1] > len(self._open):
                self._mains.pop()
                self._main = len(self._mains)
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._in_title = False
        if tag == "a" and self._href:
            self.links.append((self._href[0], " ".join("".join(self._label).split())))
            self.events.append(("a", self.links[-1][1], self._href[0]))
            self._href = []
        if any(t == tag for t, _ in self._open):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        if self._href:
            self._label.append(data)
        if not self._hidden and not self._in_title:
            self._text.append(data)

    def close(self) -> None:
        super().close()
        if not self._hidden:
            self._flush()


def parse_html(html: str, least_chars: int = 60) -> tuple[str, list[str], list[tuple[str, str]]]:
    """(title of at most 120 characters, distinct text blocks, links).

    Blocks of the main element if the page has one, else of all of it; those of text
    elements in order, then those of other innermost blocks.
    """
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    taken = sorted((b for b in parser.blocks if b[0] or not parser.has_main), key=lambda b: not b[1])
    blocks = [b for b in dict.fromkeys(text for _, _, text in taken) if len(b) >= least_chars and not is_boilerplate(b)]
    return " ".join(parser.title.split())[:120], blocks, parser.links


def statement_text(html: str, marker: str) -> list[str]:
    """Paragraphs and list items after the block that says marker (blanks and case aside), in order; blocks that are only a link are left out."""
    flat = lambda x: "".join(x.split()).lower()
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    texts = [text for _, _, text in parser.blocks]
    begin = next((i for i, t in enumerate(texts) if flat(t).rstrip(":") == flat(marker).rstrip(":")), None)
    labels = {label for _, label in parser.links}
    return [] if begin is None else [t for t in texts[begin + 1 :] if t not in labels]


def page_text(df: DataFrame, id_col: str, html_col: str, least_chars: int = 60) -> DataFrame:
    """(id_col, title, text, links): null or empty pages give empty results."""
    slim = df.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))
        for batch in batches:
            rows = [parse_html(h or "", least_chars) for h in batch.column(1).to_pylist()]
            links = [[{"href": a, "label": b} for a, b in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows]), pa.array(["\n\n".join(r[1]) for r in rows]), pa.array(links, link)], ["_id", "title", "text", "links"])

    kind = df.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, title string, text string, links array<struct<href:string,label:string>>").withColumnRenamed("_id", id_col)


def statements(df: DataFrame, id_col: str, html_col: str, marker: str) -> DataFrame:
    """(id_col, pos, block): what a page says after its marker; pages without it give no rows."""
    slim = df.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statement_text(h or "", marker) for h in batch.column(1).to_pylist()]
            rows = [(i, k, x) for i, blocks in enumerate(found) for k, x in enumerate(blocks)]
            at, pos, block = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(block, pa.string())], ["_id", "pos", "block"])

    kind = df.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, pos int, block string").withColumnRenamed("_id", id_col)


def page_events(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, pos, tag, text, href): blocks with their element, and links, in the order in which they end; null pages give no rows."""
    slim = df.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).where(F.col("_html").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, html in enumerate(batch.column(1).to_pylist()):
                parser = _Blocks()
                parser.feed(html)
                parser.close()
                rows += [(i, k, *e) for k, e in enumerate(parser.events)]
            at, pos, tag, text, href = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *(pa.array(c, pa.string()) for c in (tag, text, href))], ["_id", "pos", "tag", "text", "href"])

    kind = df.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, pos int, tag string, text string, href string").withColumnRenamed("_id", id_col)


def profiles(events: DataFrame, id_col: str, group_tag: str = "h2", person_tag: str = "h3", documents: tuple[str, ...] = (".pdf", ".docx")) -> DataFrame:
    """(id_col, person, group_name, name, email, phone, links, documents, statement): one row per person heading of a page.

    The group (an office) is carried forward from the last heading of its kind.  The
    statement is the person's blocks before the first link or further heading; links
    give contacts: mailto and tel addresses, documents by their ending, all others.
    """
    by = Window.partitionBy(id_col).orderBy("pos")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("group_name", F.last(F.when(F.col("tag") == group_tag, F.col("text")), ignorenulls=True).over(upto))
    head = F.col("tag").isin(person_tag, group_tag)
    rows = rows.withColumn("person", F.sum((F.col("tag") == person_tag).cast("int")).over(upto)).withColumn("section", F.sum(head.cast("int")).over(upto))
    mine = F.first(F.col("tag")).over(Window.partitionBy(id_col, "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) == person_tag
    rows = rows.withColumn("mine", mine).where("mine and person > 0")
    ended = F.max(((F.col("tag") == "a") | ((F.col("tag") != person_tag) & F.col("tag").startswith("h"))).cast("int")).over(Window.partitionBy(id_col, "person").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("said", (ended == 0) & (F.col("tag") != person_tag))
    low = F.lower("href")
    document = F.lit(False)
    for d in documents:
        document = document | low.endswith(d)
    link = F.col("tag") == "a"
    plain = link & ~low.startswith("mailto:") & ~low.startswith("tel:")
    listed = lambda c, x: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", x.alias("x"))))), lambda v: v["x"])
    after = lambda scheme: F.min(F.when(link & low.startswith(scheme), F.substring("href", F.lit(len(scheme) + 1), F.length("href"))))
    return rows.groupBy(id_col, "person").agg(
        F.first("group_name").alias("group_name"), F.max(F.when(F.col("tag") == person_tag, F.col("text"))).alias("name"), after("mailto:").alias("email"), after("tel:").alias("phone"),
        listed(plain & ~document, F.col("href")).alias("links"), listed(plain & document, F.col("href")).alias("documents"), F.array_join(listed(F.col("said"), F.col("text")), "\n\n").alias("statement"),
    )


def sitemap_pages(landed: DataFrame, site_col: str, url_col: str, xml_col: str) -> DataFrame:
    """(site_col, page, url, depth, rank) of a site's sitemaps: indexes are followed one level to sitemaps that were landed; shallow pages first, one address per page."""
    held = landed.select(site_col, F.col(url_col).alias("_at"), F.col(xml_col).alias("_xml")).where(F.col("_xml").isNotNull())
    found = held.select(site_col, "_at", F.contains("_xml", F.lit("<sitemapindex")).alias("_index"), F.explode(sitemap_urls(F.col("_xml"))).alias("url"))
    below = found.where("_index").select(site_col, F.col("url").alias("_at")).distinct()
    named = found.where("not _index").join(below, [site_col, "_at"], "left_semi").select(site_col, "url")
    top = found.where("not _index").join(found.where("_index").select(site_col).distinct(), site_col, "left_anti").select(site_col, "url")
    pages = named.unionByName(top).where(~skipped_link(F.col("url"))).withColumn("page", page_key(F.col("url"))).withColumn("depth", depth(F.col("url")))
    one = pages.groupBy(site_col, "page").agg(F.min(F.struct("depth", "url")).alias("b")).select(site_col, "page", "b.url", "b.depth")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(site_col).orderBy("depth", "url")))


def filled(best: DataFrame, more: DataFrame, site_col: str, page_col: str, rank_col: str, most: int = 12) -> DataFrame:
    """best, and where a site has slots left, more's pages that best lacks, in the order of rank_col; rank runs on."""
    rest = more.join(best.select(site_col, page_col), [site_col, page_col], "left_anti")
    both = best.withColumn("_more", F.lit(0)).unionByName(rest.select(*best.columns).withColumn("_more", F.lit(1)))
    order = Window.partitionBy(site_col).orderBy("_more", rank_col, page_col)
    return both.withColumn(rank_col, F.row_number().over(order)).drop("_more").where(F.col(rank_col) <= most)


def frontier(links: DataFrame, site_col: str, home_col: str, href_col: str, label_col: str, position: str, most: int = 12) -> DataFrame:
    """The best links of each site: same host, readable, one spelling per page, highest weight first."""
    fit = links.where(same_host(F.col(home_col), F.col(href_col)) & ~skipped_link(F.col(href_col)))
    scored = fit.withColumn("score", link_score(F.col(href_col), F.col(label_col))).withColumn("page", page_key(F.col(href_col)))
    one = Window.partitionBy(site_col, "page").orderBy(F.desc("score"), position)
    best = Window.partitionBy(site_col).orderBy(F.desc("score"), position)
    return scored.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def sitemap_urls(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), lambda u: F.trim(u))


def listing_rows(html: Column, pattern: str) -> Column:
    """All matches of a pattern's first group, tags taken out and blanks collapsed."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")))


def node_text(node) -> str:
    """The text of a tree of {type, text, content: [...]} nodes, at any depth."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            if x.get("type") == "text":
                out.append(x.get("text") or "")
            else:
                todo += reversed(x.get("content") or [])
    return "".join(out)


def marks_of(node, kind: str) -> list[tuple[str, dict]]:
    """(text, attributes) of the marks of a kind in a tree, in order, at any depth."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            out += [(x.get("text") or "", m.get("attrs") or {}) for m in x.get("marks") or [] if m.get("type") == kind]
            todo += reversed(x.get("content") or [])
    return out


def _parsed(tree: str):
    """A tree from JSON; one deeper than the parser's stack allows is read without recursion."""
    try:
        return json.loads(tree)
    except RecursionError:
        return _deep(tree)


def _deep(tree: str):
    """json.loads without recursion."""
    scan, at = json.JSONDecoder().raw_decode, 0
    root: list = []
    stack: list = [root]
    keys: list = [None]
    while at < len(tree):
        c = tree[at]
        if c in " \t\n\r,:":
            at += 1
            continue
        if c in "]}":
            stack.pop()
            keys.pop()
            at += 1
            continue
        if isinstance(stack[-1], dict) and keys[-1] is None:
            keys[-1], at = scan(tree, at)
            continue
        value, at = ([], at + 1) if c == "[" else ({}, at + 1) if c == "{" else scan(tree, at)
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = value
            keys[-1] = None
        else:
            stack[-1].append(value)
        if isinstance(value, (dict, list)) and c in "[{":
            stack.append(value)
            keys.append(None)
    return root[0]


def rich_text(nodes: Column) -> Column:
    """The text of a VARIANT tree of {type, text, content: [...]} nodes, at any depth; empty if null."""

    def flat(trees: pa.Array) -> pa.Array:
        return pa.array(["" if t is None else node_text(_parsed(t)) for t in trees.to_pylist()], pa.string())

    return F.arrow_udf(flat, "string")(F.to_json(nodes))


def tree_marks(nodes: Column, kind: str) -> Column:
    """The texts of all marks of a kind in a VARIANT tree, in order, at any depth."""

    def found(trees: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [text for text, _ in marks_of(_parsed(t), kind)] for t in trees.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(found, "array<string>")(F.to_json(nodes))
