"""Main text of web pages by wrapper induction.

Pages of a host are told apart by layout: the containers next to the body with their stable names (classes and ids
without those that hold digits, as these differ by page). Of every layout, and of the host as a whole, up to
``REFERENCES`` pages of different content (those with the smallest hashes of their wanted text) are parsed, and their trees
are aligned with the first one's by simple tree matching. Text that is aligned and equal on at least ``LEAST`` of them is a
candidate; candidates are confirmed by counts over all pages of different content: a block is template if ``SHARE`` of
those of its layout, or of its host, have it. All other places are slots.
Then every page of the host is parsed, and its blocks are kept if they are in a slot and not in a part that by its
element, role or class is a menu, header, footer, sidebar, notice, advert, form or comment section. Where a page has an
article or main element, only blocks in it are kept; elsewhere blocks that are mostly links are dropped too.

NULL and empty html, and pages without content, give an empty text. A NULL url, or one without ``://``, has the empty
host. Repeated rows stay. Broken markup is read leniently: a block start closes an open paragraph, stray end tags are
ignored, an unfinished tag at the end is no text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import sized, written
from tidemark.llm.url_rules import split_url

REFERENCES = 6
LEAST = 3
SHARE = 0.9
SALTS = 64
CONTAINERS = frozenset("div section main article aside header footer nav form center table".split())

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("head script style noscript template iframe object svg canvas form button select textarea nav footer aside dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies share sharing social related "
    "newsletter subscribe subscription widget toolbar pagination pager login signup search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "name", "words", "role", "children", "text")

    def __init__(self, tag: str, attrs=(), text: str = ""):
        attrs = dict(attrs)
        found = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        self.tag, self.children, self.text, self.role = tag, [], text, (attrs.get("role") or "").lower()
        self.words = frozenset(re.split(r"[^a-z]+", found)) if found.strip() else frozenset()
        stable = " ".join(w for w in found.split() if not any(map(str.isdigit, w)))
        self.name = f"{tag}.{stable}" if stable else tag


class Tree(HTMLParser):
    """Builds the tree of a page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.feed(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", html))
        self.close()

    def shut(self, tags: frozenset | set, until: frozenset | set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.shut({"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            self.shut(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "menu"})
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.shut({tag}, {"body", "html"} if tag not in ("body", "html") else set())

    def handle_data(self, data):
        self.open[-1].children.append(Node("#text", text=data))


def layout(root: Node) -> int:
    """A number for the body's name and the containers up to two levels below it, by their set of paths."""
    found, todo = set(), [(root, "", -1)]
    while todo:
        node, path, level = todo.pop()
        path = f"{path}/{node.name}"
        if node.tag == "body" or level >= 0:
            found.add(path)
        if node.tag in ("#root", "html"):
            todo += [(c, path, -1) for c in node.children if c.tag in ("html", "body") or c.tag in CONTAINERS]
        elif level < 2:
            todo += [(c, path, level + 1) for c in node.children if c.tag in CONTAINERS]
    return zlib.crc32("\n".join(sorted(found)).encode("utf-8", "surrogatepass"))


def squeeze(text: str) -> str:
    return " ".join(text.split())


def blocks(root: Node) -> list[tuple[str, str, bool, bool, float]]:
    """(path, text, unwanted, inside an article or main element, share of link text) of each block with text, in page order."""
    found: list = []
    parts: list[tuple[str, bool]] = []
    state = ["", False, False]

    def flush() -> None:
        text = squeeze("".join(t for t, _ in parts))
        if text:
            linked = len(squeeze("".join(t for t, a in parts if a)))
            found.append((state[0], text, state[1], state[2], linked / len(text)))
        parts.clear()

    # Without recursion, as broken pages nest deeply: (node, path, unwanted, inside, link) or a block's end.
    todo: list = [(root, "", False, False, False)]
    while todo:
        item = todo.pop()
        if item[0] is None:
            flush()
            state[:] = item[1]
            continue
        node, path, bad, inside, link = item
        if node.tag == "#text":
            parts.append((node.text, link))
            continue
        if node.tag == "br":
            parts.append((" ", link))
            continue
        here = f"{path}/{node.name}"
        if node.tag in ("article", "main") and not (node.words & WORDS):
            inside, bad = True, False
        bad = bad or node.tag in NEVER or node.role in ROLES or bool(node.words & WORDS) or (
            not inside and (node.tag == "header" or "header" in node.words))
        link = link or node.tag == "a"
        if node.tag in BLOCKS or node.tag in NEVER:
            flush()
            todo.append((None, list(state)))
            state[:] = [here, bad, inside]
        todo.extend((c, here, bad, inside, link) for c in reversed(node.children))
    flush()
    return found


def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Aligned nodes of two trees by simple tree matching: the largest order-keeping mapping of equal labels."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: Node, y: Node, depth: int) -> tuple[int, list]:
        if x.name != y.name:
            return 0, []
        key = (id(x), id(y))
        if key not in memo:
            n, m = len(x.children), len(y.children)
            if not n or not m or depth > 200:
                memo[key] = (1, [])
            else:
                best = [[0] * (m + 1) for _ in range(n + 1)]
                w = [[match(c, d, depth + 1)[0] + (c.tag == "#text" and c.text == d.text) if c.name == d.name else 0 for d in y.children] for c in x.children]
                for i in range(n):
                    for j in range(m):
                        best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
                pairs, i, j = [], n, m
                while i and j:
                    if best[i][j] == best[i - 1][j]:
                        i -= 1
                    elif best[i][j] == best[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        pairs.append((x.children[i], y.children[j]))
                memo[key] = (best[n][m] + 1, pairs)
        return memo[key]

    match(a, b, 0)
    found, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        found.append((x, y))
        todo += match(x, y, 0)[1]
    return found


def mark(path: str, text: str) -> int:
    return zlib.crc32(f"{path}\t{text}".encode("utf-8", "surrogatepass")) << 20 ^ len(text)


def digest(found: list) -> bytes:
    """Of the texts of all wanted blocks; empty without any."""
    texts = [b[1] for b in found if not b[2]]
    return hashlib.sha256("\n".join(texts).encode("utf-8", "surrogatepass")).digest() if texts else b""


def induce(pages: list[str]) -> list[int]:
    """Marks of the blocks that aligned reference pages have in common: on at least ``LEAST`` of them, the one with the block included."""
    trees = [Tree(html).root for html in pages]
    if len(trees) < LEAST:
        return []
    return sorted({m for i in range(len(trees) - LEAST + 1) for m in common(trees[i], trees[:i] + trees[i + 1:])})


def common(first: Node, others: list[Node]) -> list[int]:
    constant: dict[int, int] = {}
    for other in others:
        for x, y in matched(first, other):
            if x.tag == "#text" and squeeze(x.text) and squeeze(x.text) == squeeze(y.text):
                constant[id(x)] = constant.get(id(x), 0) + 1
    # A block is template if all its text nodes are.
    keep = {i for i, n in constant.items() if n >= LEAST - 1}
    blank, todo = [], [first]
    while todo:
        node = todo.pop()
        todo += node.children
        if id(node) in keep:
            blank.append(node)
    whole = blocks(first)
    texts = [n.text for n in blank]
    for n in blank:
        n.text = ""
    slots = {(b[0], b[1]) for b in blocks(first)}
    for n, t in zip(blank, texts):
        n.text = t
    return sorted({mark(b[0], b[1]) for b in whole if (b[0], b[1]) not in slots})


def main_text(html: str, template: frozenset | set) -> str:
    kept = [b for b in blocks(Tree(html).root) if not b[2] and mark(b[0], b[1]) not in template]
    if any(b[3] for b in kept):
        kept = [b for b in kept if b[3]]
    else:
        kept = [b for b in kept if b[4] <= 0.6]
    return "\n".join(b[1] for b in kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars."""
    host, _ = split_url("url")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", host)
    pick = F.xxhash64("html")

    def survey(batches):
        for batch in batches:
            out = []
            for h, p, page in zip(*(c.to_pylist() for c in batch.columns)):
                root = Tree(page or "").root
                found = blocks(root)
                content = digest(found)
                if content:
                    out.append((h, layout(root), int.from_bytes(content[:8], "little", signed=True), p, sorted({mark(b[0], b[1]) for b in found if not b[2]})))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["host", "layout", "content", "pick", "marks"])

    # One row for each content of a layout; the host as a whole counts as layout -1.
    seen = written(rows.select("host", pick.alias("pick"), "html").mapInArrow(survey, "host string, layout long, content long, pick long, marks array<long>").groupBy(
        "host", "layout", "content").agg(F.min(F.struct("pick", "marks")).alias("page")).select("host", "layout", "content", "page.*"), "contents")
    whole = seen.groupBy("host", "content").agg(F.min(F.struct("pick", "marks")).alias("page")).select("host", F.lit(-1).cast("long").alias("layout"), "content", "page.*")
    either = seen.unionByName(whole)
    place = F.row_number().over(Window.partitionBy("host", "layout").orderBy("content"))
    first = either.select("host", "layout", "content", "pick").withColumn("place", place).where(F.col("place") <= REFERENCES).drop("place")
    # A host of one layout needs no second look.
    kinds = seen.groupBy("host").agg((F.min("layout") == F.max("layout")).alias("one"))
    first = first.join(kinds, "host").where("layout >= 0 OR NOT one").select("host", "layout", "pick")
    picks = sized(written(first, "references"), 80)
    references = rows.select("host", pick.alias("pick"), "html").join(picks, ["host", "pick"]).dropDuplicates(["host", "layout", "pick"])

    def learn(table: pa.Table) -> pa.Table:
        found = induce([h or "" for h in table.sort_by("pick")["html"].to_pylist()])
        return pa.table({"host": table["host"][:1], "layout": table["layout"][:1], "known": pa.array([found], pa.list_(pa.int64()))})

    candidates = sized(written(references.groupBy("host", "layout").applyInArrow(learn, "host string, layout long, known array<long>").where("size(known) > 0"), "candidates"), 4_000)
    counts = either.join(candidates, ["host", "layout"]).select("host", "layout", F.explode(F.array_append(F.array_intersect("marks", "known"), F.lit(None).cast("long"))).alias("mark")).groupBy(
        "host", "layout", "mark").agg(F.count("*").alias("n"))
    # The count of no mark is that of the layout's pages.
    pages_of = counts.where("mark IS NULL").select("host", "layout", F.col("n").alias("all"))
    sure = counts.where("mark IS NOT NULL").join(pages_of, ["host", "layout"]).where((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("all")))
    wrappers = sized(written(sure.groupBy("host").agg(F.collect_set("mark").alias("template")), "wrappers"), 4_000)

    def apply(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "", frozenset(t.as_py() or ())) for h, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    schema = rows.select("key", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.join(wrappers, "host", "left").select("key", "url", "html", "template").mapInArrow(apply, schema).withColumnRenamed("key", key)
