"""HTML extraction by wrapper induction.

Pages become trees of what can be content: the marked article where there is one, else the page, without
parts that are never content by their tag, role or class (menus, footers, sidebars, notices, adverts, forms,
comments, scripts and styles). The pages of a host are grouped by layout (their kinds of sections); a layout
of at least PAGES distinct pages has a pivot page of its own, all others share the pivot of the host's most
frequent layout. Every page is aligned with its pivot by simple tree matching: two nodes of one tag pair up
with the best order-preserving pairing of their children, where equal classes and equal own texts weigh more.
A node's own text that holds a share of at least CONSTANT among the pages that aligned with the node, if
these are at least PAGES, is template. In a page, own texts of nodes aligned with template nodes of the same
text go, whether or not the nodes have children; slots that vary are content.

Copies of one article must not make it template. Pages of equal article text count once, and the articles
that hold the text must differ: by at least one of MARKS minimum hashes of three words each they must be
CONSTANT of the aligned articles apart. Near copies share these hashes, independent articles do not. Where
near copies are most of a layout, boilerplate in it stays too.

A block is the text between borders of block elements; references are decoded, white space runs become
one blank, blocks are joined by a line feed in page order. Null html is empty and gives an empty text.
Pivots are broadcast only while their html has at most PIVOT_BYTES in all; beyond that pages meet them in
a join on their keys and a salt. Repeated rows are extracted each on its own and count as one page; a null url has the
empty host; of layouts with equally many pages (a tie) that with the greater hash is the host's main one; an html of any
length is one tree; an empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import sys
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, scratch
from .url_filter import host_of

CONSTANT = 0.6
PAGES = 5
PIVOT_BYTES = 16 << 20
SALTS = 64
MEMORY = 200_000
MARKS = 4

#: Fixed values of HTML: elements without content, with raw text, and those that border blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag ends the open elements named, up to the nearest of the stops.
P_ENDERS = BLOCKS - frozenset("body head html title td th tr tbody thead tfoot caption option li dd dt legend summary".split())
CLOSES = {t: ({"p"}, frozenset("article aside body div section td th li main blockquote form figure".split())) for t in P_ENDERS}
CLOSES |= {
    "li": ({"li", "p"}, frozenset(["ul", "ol", "menu"])),
    "dt": ({"dt", "dd", "p"}, frozenset(["dl"])),
    "dd": ({"dt", "dd", "p"}, frozenset(["dl"])),
    "tr": ({"tr", "td", "th", "p"}, frozenset(["table"])),
    "td": ({"td", "th", "p"}, frozenset(["tr", "table"])),
    "th": ({"td", "th", "p"}, frozenset(["tr", "table"])),
    "option": ({"option"}, frozenset(["select", "datalist"])),
}
#: Parts that are never content.
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe svg canvas object dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent gdpr notice notices notification popup modal overlay comment comments disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup login paywall widget toolbar pagination pager skip".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_ORDERS = np.array([[j * 0x9E3779B9 & 0xFFFFFFFF] for j in range(MARKS)], np.uint64)
_DIGIT = re.compile(r"\d")
#: Tags that make a layout; Java patterns.
SECTIONS = r"(?i)<(?:div|section|main|article|header|footer|aside|nav)\b[^>]*"
CLASSES = r"(?i)\sclass\s*=\s*[\"']?([^\"'>]*)"


class Node:
    __slots__ = ("tag", "label", "never", "kids", "boughs", "mark", "shape", "size")

    def __init__(self, tag: str, label: str, never: bool):
        self.tag, self.label, self.never, self.kids = tag, label, never, []  # kids: nodes, and texts as strings


def _open(tag: str, attrs: str) -> Node:
    label, never = tag, tag in NEVER
    if attrs and ("=" in attrs or "hidden" in attrs):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), entities.unescape(a or b or c).lower()
            if name in ("class", "id"):
                label += "".join("." + x for x in value.split() if not _DIGIT.search(x))  # numbers vary per page
                never = never or (tag not in ("html", "body", "article", "main") and not WORDS.isdisjoint(_SPLIT.split(value)))
            elif name == "role":
                never = never or value in ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                never = True
    return Node(tag, label, never)


def parse(page: str) -> Node:
    """The tree of a page; unclosed, stray and misnested tags are mended as browsers do for block elements."""
    root = Node("#", "#", False)
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES:
            ended, stops = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                elif stack[i].tag in stops:
                    break
        node = _open(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            node.kids.append(page[at:stop])
            at = stop
            stack.append(node) if end else None
        elif tag not in VOID:
            stack.append(node)
    return root


def article_of(root: Node) -> list[Node] | None:
    """The outermost nodes that mark the article, if any; nothing in a part that is never content."""
    for wanted in (("article",), ("main",)):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if isinstance(x, Node) and not x.never:
                if x.tag in wanted:
                    found.append(x)
                else:
                    todo += reversed(x.kids)
        if found:
            return found
    return None


def blocks(nodes: list[Node], gone: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks in nodes, without parts that are never content and own texts of nodes (by id()) in gone."""
    out, now = [], []

    def border() -> None:
        if now:
            text = " ".join("".join(now).split())
            if text:
                out.append(text)
            now.clear()

    todo = [x for node in reversed(nodes) for x in (None, node)]
    while todo:
        x = todo.pop()
        if x is None:
            border()
        elif isinstance(x, str):
            now.append(entities.unescape(x))
        elif x.never:
            continue
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in BLOCKS:
                border()
                todo.append(None)
            todo += [y for y in reversed(x.kids) if isinstance(y, Node)] if id(x) in gone else reversed(x.kids)
    border()
    return out


def own_text(node: Node) -> str:
    """The text between a node's borders that no element below it holds."""
    return " ".join(" ".join(entities.unescape(x) for x in node.kids if isinstance(x, str)).split())


class Matcher:
    """Simple tree matching with a memory of subtree shapes."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.score: dict[tuple[int, int], float] = {}

    def shape(self, node: Node) -> int:
        """A number for the node's tree of labels and own texts; sets the checksums of the texts (-1: none)."""
        order, todo = [], [node]
        while todo:
            x = todo.pop()
            order.append(x)
            x.boughs = [y for y in x.kids if isinstance(y, Node) and not y.never]
            todo += x.boughs
        for x in reversed(order):
            text = own_text(x)
            x.mark = _hash(text) & (1 << 63) - 1 if text else -1
            x.size = 1 + (x.mark >= 0) + sum(y.size for y in x.boughs)
            x.shape = self.shapes.setdefault((x.label, x.mark, tuple(y.shape for y in x.boughs)), len(self.shapes))
        return node.shape

    def table(self, a: list[Node], b: list[Node]) -> list[list[float]]:
        rows = [[0] * (len(b) + 1)]
        for x in a:
            before, row, left = rows[-1], [0], 0
            for j, y in enumerate(b):
                best = before[j] + self.match(x, y) if x.tag == y.tag else before[j]
                if before[j + 1] > best:
                    best = before[j + 1]
                if left > best:
                    best = left
                row.append(best)
                left = best
            rows.append(row)
        return rows

    def match(self, x: Node, y: Node) -> float:
        """Weight of the best matching of two trees whose roots pair up; 0 if their tags differ.

        A pair weighs 1, or a half if labels differ, and 1 more if both have one own text.
        """
        if x.tag != y.tag:
            return 0
        if x.shape == y.shape:
            return x.size
        out = (1 if x.label == y.label else 0.5) + (x.mark == y.mark >= 0)
        if not (x.boughs and y.boughs):
            return out
        key = (x.shape, y.shape)
        if key not in self.score:
            self.score[key] = out + self.table(x.boughs, y.boughs)[-1][-1]
        return self.score[key]

    def pairs(self, x: Node, y: Node) -> list[tuple[Node, Node]]:
        """The pairs of a best matching."""
        out, todo = [], [(x, y)]
        while todo:
            x, y = todo.pop()
            if x.tag != y.tag:
                continue
            out.append((x, y))
            a, b = x.boughs, y.boughs
            if x.shape == y.shape:
                todo += zip(a, b, strict=True)
                continue
            if not (a and b):
                continue
            rows = self.table(a, b)
            i, j = len(a), len(b)
            while i and j:
                gain = rows[i][j] - rows[i - 1][j - 1]
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    if gain:
                        todo.append((a[i - 1], b[j - 1]))
                    i, j = i - 1, j - 1
        return out

    def trim(self) -> bool:
        """Forget scores, and shapes where there are many; whether shapes went."""
        self.score.clear()
        if len(self.shapes) <= MEMORY:
            return False
        self.shapes.clear()
        return True


def _parts(root: Node) -> tuple[Node, bool]:
    """What can be content under one root, and whether it is a marked article."""
    found = article_of(root)
    top = Node("#", "#", False)
    top.kids = found or [root]
    return top, found is not None


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def sketch(text: str) -> list[int]:
    """Minimum hashes of the text's runs of three words, by MARKS orders."""
    data = " ".join(text.split()).encode("utf-8", "replace")
    ends = [*accumulate(len(x) + 1 for x in data.split(b" "))]  # one more than where each word ends: where the next one starts
    crc = zlib.crc32
    grams = {crc(data[s : e - 1]) for s, e in zip([0, *ends], ends[2:] or ends[-1:])}
    g = np.fromiter(grams, np.uint64, len(grams))
    return (((g ^ _ORDERS) * np.uint64(0x85EBCA6B) + (g >> np.uint64(13)) * np.uint64(0xC2B2AE35)) & np.uint64(0xFFFFFFFF)).min(axis=1).tolist()


class Pivots:
    """Trees of pivot pages by group, parsed when first asked for; slots are numbered in page order."""

    def __init__(self):
        self.matcher, self.trees = Matcher(), {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # pages may be nested deeply

    def tree(self, group: int, page: str):
        if group not in self.trees:
            if len(self.trees) > 500:
                self.trees.clear()
            root, _ = _parts(parse(page))
            self.matcher.shape(root)
            number, todo = {}, [root]
            while todo:
                x = todo.pop()
                number[id(x)] = len(number)
                todo += reversed(x.boughs)
            self.trees[group] = (root, number)
        return self.trees[group]

    def slots(self, group: int, pivot: str, root: Node) -> list[tuple[int, int, Node]]:
        """(pivot's slot, text's checksum, node) of each aligned node with text; root: of _parts."""
        if self.matcher.trim():
            self.trees.clear()
        own, number = self.tree(group, pivot)
        self.matcher.shape(root)
        return [(number[id(x)], y.mark, y) for x, y in self.matcher.pairs(own, root) if y.mark >= 0]


def _meet(pages: DataFrame, other: DataFrame, keys: list[str], small: bool) -> DataFrame:
    if small:
        return pages.join(F.broadcast(other), keys, "left")
    dealt = pages.withColumn("__salt", F.pmod(F.xxhash64("__url", "__html"), F.lit(SALTS)))
    every = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
    return dealt.join(every, [*keys, "__salt"], "left").drop("__salt")


def _with_layout(pages: DataFrame) -> DataFrame:
    """pages with `__kind` (has an article, a main part or neither) and `__layout`, a hash of the kinds of sections."""
    tags = F.regexp_extract_all("__html", F.lit(SECTIONS), F.lit(0))
    classes = lambda x: F.filter(F.split(F.lower(F.regexp_extract(x, CLASSES, 1)), r"\s+"), lambda c: ~c.rlike(r"\d"))
    named = F.transform(tags, lambda x: F.concat_ws(".", F.lower(F.regexp_extract(x, "^<([a-zA-Z]+)", 1)), F.array_sort(classes(x))))
    kind = F.when(F.col("__html").rlike(r"(?i)<article\b"), 0).when(F.col("__html").rlike(r"(?i)<main\b"), 1).otherwise(2)
    return pages.withColumn("__kind", kind).withColumn("__layout", F.xxhash64(F.array_join(F.array_sort(F.array_distinct(named)), "|")))


def _with_pivots(pages: DataFrame, pivots: DataFrame, small: bool) -> DataFrame:
    """pages (of _with_layout) with their pivot's columns: the layout's own pivot, else the host's main one of the kind."""
    mine = [c for c in pivots.columns if c not in ("__host", "__kind", "__layout", "__size", "__main")]
    own = pivots.filter(F.col("__size") >= PAGES).select("__host", "__kind", "__layout", F.struct(*mine).alias("__own"))
    main = pivots.filter("__main").select("__host", "__kind", F.struct(*mine).alias("__shared"))
    both = _meet(_meet(pages, own, ["__host", "__kind", "__layout"], small), main, ["__host", "__kind"], small)
    return both.withColumn("__own", F.coalesce("__own", "__shared")).select(*pages.columns, *(F.col("__own")[c].alias(c) for c in mine))


def choose(pages: DataFrame) -> DataFrame:
    """(__host, __kind, __layout, __size, __main, __group, __pivot) of the layouts that have a pivot."""
    sizes = pages.filter("__html <> ''").groupBy("__host", "__kind", "__layout").agg(F.count_distinct(F.xxhash64("__html")).alias("__size"))
    sizes = scratch(sizes, "op3-layouts")
    best = sizes.groupBy("__host", "__kind").agg(F.max_by("__layout", F.struct("__size", "__layout")).alias("__best"))
    kept = sizes.join(best, ["__host", "__kind"]).withColumn("__main", F.col("__layout") == F.col("__best")).filter(F.col("__main") | (F.col("__size") >= PAGES)).drop("__best")
    first = pages.filter("__html <> ''").groupBy("__host", "__kind", "__layout").agg(F.min_by("__html", F.struct("__key", F.xxhash64("__key", "__url", "__html"))).alias("__pivot"))
    return kept.join(first, ["__host", "__kind", "__layout"]).withColumn("__group", F.xxhash64("__host", "__kind", "__layout"))


def induce(pages: DataFrame, small: bool, pivots: DataFrame, constant: float = CONSTANT, least: int = PAGES) -> DataFrame:
    """(__group, __template): array of (slot, checksum) that are template in a pivot's group."""
    names = ["__group", "__slot", "__check", "__one", "__marks"]

    def run(batches):
        all_ = Pivots()
        for batch in batches:
            found: set = set()
            for group, page, pivot in zip(*(column(batch, c).to_pylist() for c in ("__group", "__html", "__pivot")), strict=True):
                if page and pivot:
                    root, marked = _parts(parse(page))
                    text = "\n".join(blocks(root.kids)) if marked else page
                    one = _hash(text)
                    marks = tuple(sketch(text)) if marked else (one,)
                    found.update((group, slot, check, one, marks) for slot, check, _ in all_.slots(group, pivot, root))
            rows = list(found)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in rows], t) for i, t in enumerate(kinds)], names=names)

    # Only slots and hashes travel, never html; a page or article that occurs twice counts once.
    named = _with_pivots(pages, pivots, small).select("__group", "__html", "__pivot")
    seen = scratch(named.mapInArrow(run, "__group long, __slot long, __check long, __one long, __marks array<bigint>").distinct(), "op3-slots")
    total = seen.groupBy("__group", "__slot").agg(F.count_distinct("__one").alias("__pages")).filter(F.col("__pages") >= least)
    often = seen.groupBy("__group", "__slot", "__check").agg(F.count_distinct("__one").alias("__n")).filter(F.col("__n") >= least * constant)
    often = scratch(often.join(total, ["__group", "__slot"]).filter(F.col("__n") >= F.col("__pages") * constant).drop("__n"), "op3-often")
    # At most one text a slot: no more rows than the pivots have nodes.
    near = seen.join(F.broadcast(often) if small else often, ["__group", "__slot", "__check"])
    near = near.select("__group", "__slot", "__check", "__pages", F.posexplode("__marks").alias("__j", "__mark")).distinct()
    apart = near.groupBy("__group", "__slot", "__check", "__pages", "__j").agg(F.count("*").alias("__apart")).filter(F.col("__apart") >= F.col("__pages") * constant)
    return apart.select("__group", "__slot", "__check").distinct().groupBy("__group").agg(F.collect_list(F.struct("__slot", "__check")).alias("__template"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_template) for every row of pages; n_template: own texts taken away as template."""
    rows = _with_layout(pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.coalesce(host_of(F.coalesce(F.col(url), F.lit(""))), F.lit("")).alias("__host"), F.col(html).alias("__html")))
    pivots = scratch(choose(rows), "op3-pivots")
    small = (pivots.agg(F.sum(F.octet_length("__pivot"))).first()[0] or 0) <= PIVOT_BYTES
    template = scratch(induce(rows, small, pivots), "op3-template")
    known = pivots.join(template, "__group", "left")
    light = small and (template.agg(F.sum(F.size("__template"))).first()[0] or 0) * 16 <= PIVOT_BYTES
    kinds = T.StructType([pages.schema[key], T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])
    names = kinds.names

    def run(batches):
        all_ = Pivots()
        for batch in batches:
            texts, gone_ = [], []
            for group, page, pivot, fixed in zip(*(column(batch, c).to_pylist() for c in ("__group", "__html", "__pivot", "__template")), strict=True):
                (root, _), gone = _parts(parse(page or "")), set()
                if fixed and page:
                    fixed = {(x["__slot"], x["__check"]) for x in fixed}
                    gone = {id(node) for slot, check, node in all_.slots(group, pivot, root) if (slot, check) in fixed}
                texts.append("\n".join(blocks(root.kids, gone)))
                gone_.append(len(gone))
            yield pa.RecordBatch.from_arrays([column(batch, "__key"), column(batch, "__url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(gone_, pa.int64())], names=names)

    return _with_pivots(rows, known, light).select("__key", "__url", "__group", "__html", "__pivot", "__template").mapInArrow(run, kinds)


def op3_wrapper(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
