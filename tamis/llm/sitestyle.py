"""Main text of web pages with site style trees.

Pages are parsed leniently into branches (paths of ``tag.class`` from the root).  All
branches of a host's pages are merged, before anything is cut: a branch has presentations
(the sequence of its child tags) and contents (its text blocks).  With m pages on a branch,
presentation importance is the entropy of its styles to the base m, and content importance
is one less the mean, over its contents, of the entropy, to the same base, of the pages that
a content is on; the first weighs ``1 - GAMMA``, the second ``GAMMA``.  Evidence counts by the
number of pages: a branch's importance is averaged with ``PRIOR_PAGES`` pages of importance
1, and branches under ``min_importance`` are removed from all pages of the host.

Copies and near copies count as one page, so that an article that stands on a host many
times does not look like a template: pages are told apart by the smallest hash of the word
shingles in the host's main branch, whose distinct contents have the most text.  A page that
would be left empty keeps its branches.

What a host has too few pages to tell is left to the markup, after the tree: navigation,
footers, asides, forms, and parts whose whole class or id says advert, menu, sidebar or reader
comments go, but never one that holds the only article or, on pages without one, most of
the text; in an article only adverts and comments go by class.  What is outside article
(or else main) elements goes where they hold at least half of the text.

Scale: a page is parsed once, in time and memory linear in its length, and written as
blocks; pages are not shuffled.  What is aggregated are rows of five numbers,
deduplicated in each task first; a hot host's rows are spread over its contents.  The
removed branches are broadcast when they are few, joined by host otherwise.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm._common import arrow_map, table, written

GAMMA = 0.9
MIN_IMPORTANCE = 0.85
PRIOR_PAGES = 12
SHINGLE_WORDS = 3
#: Removed branches that are sent to all tasks, at most; beyond, they are joined.
BROADCAST_BRANCHES = 100_000

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)|<[!?/][^>]*>|[^<]+|<", re.S)
#: The end of a tag: quotes that hold no '>' are passed over here, others in ``_tag_end``.
PLAIN_END = re.compile(r"""(?:[^>"']|"[^">]*"|'[^'>]*')*+>""")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in "script style textarea title noscript template iframe svg select object xmp".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these tags.
ENDS = {
    **{t: ("p",) for t in BLOCK - {"br", "html", "body", "head", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "caption"}},
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",),
    "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tbody": ("p", "td", "th", "tr", "thead", "tbody"), "tfoot": ("p", "td", "th", "tr", "thead", "tbody"),
}
#: Open elements that such an end does not reach beyond.
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), **dict.fromkeys(("tr", "td", "th", "tbody", "tfoot"), ("table",))}
CUT_TAGS = frozenset("nav footer aside form button menu dialog search head fieldset datalist audio video canvas map".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Whole classes and ids of adverts and readers' comments, anywhere.
CUT_ANYWHERE = frozenset("ad ads advert adverts advertisement sponsored comment comments comment-list replies".split())
#: Whole classes and ids of what is around an article.
CUT_OUTSIDE = frozenset("menu nav navbar navigation breadcrumbs sidebar header masthead footer notice cookie-notice cookie-banner newsletter pagination".split())


NONE: set[str] = set()


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where a tag ends whose quotes hold a '>': after the first '>' outside quotes, or else after the first one.

    ``dead`` has the quotes from which no such '>' is reached; every one is tried once, so all calls together are linear.
    """
    tried, here = [], at
    while (m := STOP.search(page, here)) and m[0] != ">":
        tried.append(m.start())
        close = -1 if m.start() in dead else page.find(m[0], m.end())
        if close < 0:
            m = None
            break
        here = close + 1
    if m:
        return m.end()
    dead.update(tried)
    return page.find(">", at) + 1


class Block(NamedTuple):
    branch: int
    text: str
    level: int  # 2 in an article, 1 in main
    cut: int  # innermost named part


class Page(NamedTuple):
    blocks: list[Block]
    styles: dict[int, int]  # each branch's hash of its child tags in order
    inside: list[int]  # each named part's next named part outside; 0 is none
    articles: set[int]  # named parts with an article in them that is not named itself
    seen: int  # the highest level outside named parts


def _digest(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def step(branch: int, name: str) -> int:
    """The number of a branch's child, and the hash of a sequence with one more name."""
    return _digest(name, branch + (1 << 63))


def parsed(page: str | None) -> Page:
    """All text blocks of a page, in order, with the parts that the markup names as anything but article text."""
    page = page or ""
    tags, stack, opened, blocks = [""], [(0, 0, 0)], {}, []  # of each open element: tag; named part, branch, level; where each tag and all blocks are open
    found: list[Block] = []
    styles: dict[int, int] = {}
    pieces: dict[int, tuple[int, list[str]]] = {}
    inside, articles, dead = [0], set(), set()
    at, seen, last = 0, 0, page.rfind(">")

    def flush() -> None:
        level = stack[-1][2]
        for cut, (branch, texts) in pieces.items():
            text = " ".join("".join(texts).split())
            if text:
                found.append(Block(branch, text, level, cut))
        pieces.clear()

    def close(i: int) -> None:
        for t in tags[i:]:
            opened[t].pop()
        while blocks and blocks[-1] >= i:
            blocks.pop()
        del tags[i:], stack[i:]

    def text(told: str) -> None:
        pieces.setdefault(stack[-1][0], (stack[-1][1], []))[1].append(html.unescape(told) if "&" in told else told)

    while at < len(page):
        m = TOKEN.match(page, at)
        start, at, tag = at, m.end(), m["tag"]
        if tag is None:
            if page[start] != "<" or at == start + 1:
                text(m[0])
            continue
        if start > last:  # no tag ends any more
            text(page[start:])
            break
        plain = PLAIN_END.match(page, at)
        end = plain.end() if plain else _tag_end(page, at, dead)
        tag, rest = tag.lower(), page[at : end - 1]
        at = end
        if tag in BLOCK:
            flush()
        if m["end"]:
            if opened.get(tag):
                i = opened[tag][-1]
                if blocks and blocks[-1] > i:
                    flush()
                close(i)
            continue
        if tag in RAW and not rest.endswith("/"):
            over = RAW[tag].search(page, at)
            at = over.end() if over else len(page)
            continue
        ends = ENDS.get(tag, ())
        if tag in WALLS:
            wall = max((opened[w][-1] for w in WALLS[tag] if opened.get(w)), default=0)
            first = [opened[t][i] for t in ends if opened.get(t) and (i := bisect_right(opened[t], wall)) < len(opened[t])]
            if first:
                close(min(first))
        elif blocks and tags[blocks[-1]] in ends:
            close(blocks[-1])
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            if tag in BLOCK:
                styles[stack[-1][1]] = step(styles.get(stack[-1][1], 0), tag)
            continue
        cut, branch, level = stack[-1]
        role, classes, names, named = "", [], NONE, False
        if "=" in rest:
            marks = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(rest)}
            role, classes = marks.get("role", "").lower(), marks.get("class", "").split()
            names = {x.lower() for x in (*classes, *marks.get("id", "").split())}
            named = not names.isdisjoint(CUT_ANYWHERE)
        if tag == "article":
            outer = 0 if named else cut
            while outer and outer not in articles:
                articles.add(outer)
                outer = inside[outer]
        elif tag not in ("html", "body", "main"):
            named = named or tag in CUT_TAGS or role in CUT_ROLES or (level < 2 and not names.isdisjoint(CUT_OUTSIDE)) or (level == 0 and tag == "header")
        if named:
            inside.append(cut)
            cut = len(inside) - 1
        level = max(level, 2 if tag == "article" else 1 if tag == "main" or role == "main" else 0)
        if level and not cut:
            seen = max(seen, level)
        if tag in BLOCK or named:
            name = ".".join([tag, *sorted(classes)[:2]]) if classes else tag
            if tag in BLOCK:
                styles[branch] = step(styles.get(branch, 0), name)
            branch = step(branch, name)
        opened.setdefault(tag, []).append(len(tags))
        if tag in BLOCK:
            blocks.append(len(tags))
        tags.append(tag)
        stack.append((cut, branch, level))
    flush()
    return Page(found, styles, inside, articles, seen)


def checked(page: Page, low: set[int]) -> list[str]:
    """The texts of the blocks that stay: without the branches ``low``, then without named parts and what is around articles.

    The branches stay where nothing else is. A named part stays if it holds the
    only article, or, on a page without one outside such parts, most of the text; named parts
    in it are checked on their own.
    """
    left = [x for x in page.blocks if x.branch not in low] if low else page.blocks
    left = left or page.blocks
    parts = len(page.inside)
    if parts > 1:
        cuts = set(range(1, parts))
        if not page.seen:
            size = [0] * parts
            for x in left:
                size[x.cut] += len(x.text)
            for k in range(parts - 1, 0, -1):
                size[page.inside[k]] += size[k]
            cuts = {k for k in cuts if k not in page.articles and size[k] <= size[0] / 2}
        gone = [False] * parts
        for k in range(1, parts):
            gone[k] = k in cuts or gone[page.inside[k]]
        left = [x for x in left if not gone[x.cut]]
    size = sum(len(x.text) for x in left)
    for level in (2, 1):
        own = [x for x in left if x.level >= level]
        if own and 2 * sum(len(x.text) for x in own) >= size:
            left = own
            break
    return [x.text for x in left]


def shingle_hash(texts: list[str]) -> int:
    """The smallest hash of the shingles of ``SHINGLE_WORDS`` words (of all words, if fewer) of a branch's blocks."""
    words = " ".join(texts).encode("utf-8", "surrogatepass").split(b" ")
    shingles = set(zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)) or {tuple(words)}
    return min(xxhash.xxh64_intdigest(b" ".join(x)) for x in shingles) - (1 << 63)


BLOCKS = (
    "page_id long, url string, host long, branches array<long>, contents array<long>, lengths array<int>, texts array<string>, levels array<int>, cuts array<int>, "
    "styled array<long>, styles array<long>, shingled array<long>, inside array<int>, articles array<int>, seen int"
)


def parse(pages: DataFrame) -> DataFrame:
    """``BLOCKS`` of each row of ``pages``: its blocks, and what it shows of its host's tree. host is null where the url has none."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [longs, longs, ints, pa.list_(pa.string()), ints, ints, longs, longs, longs, ints, ints, pa.int32()]
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hosts = [_digest(h) if h else None for h in part.column(3).to_pylist()]
                rows = []
                for text in part.column(2):
                    p = parsed(text.as_py())
                    of: dict[int, list[str]] = {}
                    for x in p.blocks:
                        of.setdefault(x.branch, []).append(x.text)
                    rows.append((
                        [x.branch for x in p.blocks], [_digest(x.text) for x in p.blocks], [len(x.text) for x in p.blocks], [x.text for x in p.blocks], [x.level for x in p.blocks], [x.cut for x in p.blocks],
                        list(of), [p.styles.get(x, 0) for x in of], list(map(shingle_hash, of.values())), p.inside, sorted(p.articles), p.seen,
                    ))
                columns = list(zip(*rows, strict=True))
                made = [part.column(0), part.column(1), pa.array(hosts, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(made, names)

    return arrow_map(source, run, BLOCKS)


def main_branches(pages: DataFrame) -> DataFrame:
    """(host, main): of each host of ``parse`` the branch whose distinct contents have the most text."""
    blocks = pages.where("host is not null").select("host", F.explode(F.arrays_zip("branches", "contents", "lengths")).alias("x"))
    distinct = blocks.groupBy("host", F.col("x.branches").alias("branch"), F.col("x.contents").alias("content")).agg(F.max("x.lengths").alias("length"))
    return distinct.groupBy("host", "branch").agg(F.sum("length").alias("size")).groupBy("host").agg(F.max(F.struct("size", "branch"))["branch"].alias("main"))


def features(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, page): what each page of ``parse`` has on each of its host's branches, the style (0) and contents (1).

    Pages with the same shingle hash in their host's main branch are one; without that branch, those with the same smallest one.
    """
    at = F.array_position("styled", F.col("main")).cast("int")
    page = F.when(at > 0, F.get("shingled", at - 1)).otherwise(F.array_min("shingled"))
    hosted = pages.where("host is not null").join(written(main_branches(pages), "main"), "host").withColumn("page", page)
    of = lambda kind, nodes, found: hosted.select("host", "page", F.explode(F.arrays_zip(F.col(nodes).alias("node"), F.col(found).alias("feature"))).alias("x")).select("host", "x.node", F.lit(kind).alias("kind"), "x.feature", "page")
    return of(1, "branches", "contents").distinct().union(of(0, "styled", "styles").distinct())


def importance(found: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of the merged branches, without the prior; 1 where a branch has one page."""
    counts = found.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"))
    style = F.when(F.col("kind") == 0, F.col("n"))
    content = F.when(F.col("kind") == 1, F.col("n"))
    per = counts.groupBy("host", "node").agg(F.sum(style * F.log("n")).alias("style_log"), F.avg(F.log(content)).alias("content_log"))
    pages = found.where("kind = 0").groupBy("host", "node").agg(F.count_distinct("page").alias("pages"))
    m = F.col("pages").cast("double")
    by_style = (F.log(m) - F.coalesce("style_log", F.lit(0.0)) / m) / F.log(m)
    by_content = 1 - F.coalesce("content_log", F.lit(0.0)) / F.log(m)
    return per.join(pages, ["host", "node"]).select("host", "node", "pages", F.when(m > 1, (1 - GAMMA) * F.greatest(by_style, F.lit(0.0)) + GAMMA * by_content).otherwise(1.0).alias("importance"))


def low_branches(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, prior_pages: int = PRIOR_PAGES) -> DataFrame:
    """(host, node) of the branches that go."""
    m = F.col("pages")
    return importance(features(pages)).where((prior_pages + m * F.col("importance")) / (prior_pages + m) < min_importance).select("host", "node")


def extract(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, prior_pages: int = PRIOR_PAGES, broadcast_branches: int = BROADCAST_BRANCHES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    A null or empty html has an empty text. A page without a host (null or relative url) is
    not merged with others. Repeated rows stay and count as one page in the trees; other
    columns are ignored; an empty table gives no rows.
    """
    blocks = written(parse(pages), "blocks", "zstd")
    low = written(low_branches(blocks, min_importance, prior_pages), "branches")
    need = ["page_id", "url", "host", "branches", "texts", "levels", "cuts", "inside", "articles", "seen"]
    if low.count() <= broadcast_branches:
        fixed: dict[int, set[int]] = {}
        for r in low.limit(broadcast_branches).collect():
            fixed.setdefault(r.host, set()).add(r.node)
        rows = blocks.select(*need, F.lit(None).cast("array<bigint>").alias("low"))
    else:
        fixed = {}
        of_host = low.groupBy(F.col("host").alias("host_number")).agg(F.collect_set("node").alias("low"))
        rows = blocks.join(of_host, F.col("host") == F.col("host_number"), "left").select(*need, "low")
    sent = rows.sparkSession.sparkContext.broadcast(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for r in (x for at in range(0, b.num_rows, 256) for x in b.slice(at, 256).to_pylist()):
                p = Page(list(map(Block._make, zip(r["branches"], r["texts"], r["levels"], r["cuts"], strict=True))), {}, r["inside"], set(r["articles"]), r["seen"])
                texts.append(" ".join(checked(p, sent.value.get(r["host"], set()) if r["low"] is None else set(r["low"]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long")


def op8_site_style_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
