"""Operator 8: main text of web pages, by differencing pages with the nearest URLs.

Each page becomes text lines (blocks) with what their markup says: chrome, article, or nothing.
Pages are ordered by host and URL path over the whole table; each is paired with its nearest
neighbours of the same host, the lines are aligned by longest common subsequence, and shared
lines are deleted. Markup settles what differencing alone gets wrong: menus or adverts that differ from
page to page go by their element, class or id before lines are compared.

Inside an article one neighbour's word is not enough, as texts quote each other: a line goes there only
if it is a template of its host, one that aligns with both neighbours on ``host_share`` of the host's pages
and on ``host_pages`` at least; the article's main heading never goes.

A pair that shares most of its article text (of its text without chrome, where no element says
article) is a copy and not evidence of a template. A page without other evidence keeps what its
article element holds, or all but chrome. Null html gives
an empty text; null urls form a host of their own. Rows that repeat id, url and html get one and the
same text. Very long pages cost the product of two pages' differing lines. Other columns are left
out, whatever their names. An empty table gives an empty result. Unclosed elements end where their parent ends.
"""

from __future__ import annotations

import html as html_names
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: What markup says of a line; HEADING is the main heading of an article.
CHROME, ARTICLE, UNKNOWN, HEADING = 0, 1, 2, 3
#: Element names and the words of class, id and role that mark page chrome.
CHROME_TAGS = frozenset("nav header footer aside form head menu dialog button select option label fieldset".split())
RAW_TAGS = ("script", "style", "template", "textarea", "svg", "iframe", "title", "audio", "video")
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments disqus respond replies reply share sharing social follow newsletter subscribe subscription signup login related recommended pagination pager skip toolbar search complementary contentinfo".split()
)
#: Content of these stands in for what a browser shows elsewhere; it counts inside an article only.
FALLBACK_TAGS = frozenset("noscript object canvas".split())
_RAW = "|".join(RAW_TAGS)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:" + _RAW + r")(?:\s*/|(?![\w:-])(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?<=[\s\"']/))>|<(?P<raw>" + _RAW + r")(?![\w:-])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?</(?P=raw)\s*>)?|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)", re.I)


def _is_chrome(tag: str, attrs: str) -> bool:
    if tag in CHROME_TAGS:
        return True
    if not attrs.strip() or tag in ("html", "body"):
        return False
    words = {w for _, value in _NAMES.findall(attrs) for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())}
    return not words.isdisjoint(CHROME_WORDS) or bool(_HIDDEN.search(attrs))


def _wrappers(source: str) -> set[int]:
    """Places of the start tags of open elements that hold an article or main element of the page."""
    held: set[int] = set()
    stack: list[tuple[str, int]] = []
    for token in _TOKEN.finditer(source):
        tag = (token["tag"] or "").lower()
        if not tag or tag in VOID_TAGS or (token["attrs"].rstrip().endswith("/") and not token["end"]):
            continue
        if token["end"]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in ("article", "main"):
            held.update(at for _, at in stack)
            held.add(token.start())
        stack.append((tag, token.start()))
    return held


def page_blocks(html: str | None) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each with CHROME, ARTICLE, UNKNOWN or HEADING."""
    source = html or ""
    blocks: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements that change the verdict, or are blocks
    verdict, parts, at, article, heading = UNKNOWN, [], 0, False, False
    wrappers = _wrappers(source)

    def flush() -> None:
        text = " ".join(html_names.unescape("".join(parts)).split())
        if text:
            blocks.append((text, HEADING if heading and verdict == ARTICLE else verdict))
        parts.clear()

    for token in _TOKEN.finditer(source):
        parts.append(source[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if (token["raw"] or "").lower() in ("script", "style") and "</" not in token[0]:
                at = len(source)  # unclosed code runs to the end of the page
                break
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
            heading = tag == "h1" and not token["end"]
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in VOID_TAGS:
            continue
        attrs = token["attrs"]
        if token["end"]:
            if any(open_tag == tag for open_tag, _ in stack):
                while stack:
                    open_tag, before = stack.pop()
                    if verdict != before:
                        flush()
                    verdict = before
                    if open_tag == tag:
                        break
            continue
        # a word of class, id or role does not make chrome of an article or of what holds one
        chrome = tag in CHROME_TAGS or (tag in FALLBACK_TAGS and verdict != ARTICLE and token.start() not in wrappers) or (token.start() not in wrappers and _is_chrome(tag, attrs))
        if tag in ("article", "main") and not chrome and not article:
            if verdict == CHROME:  # an unclosed menu cannot hold the article
                flush()
                stack, verdict = [], UNKNOWN
            article = True
            new = ARTICLE
        else:
            new = CHROME if chrome or verdict == CHROME else ARTICLE if tag in ("article", "main") else verdict
        if new != verdict or chrome or tag in ("div", "section", "article", "main", "ul", "ol", "table"):
            if new != verdict:
                flush()
            if not attrs.rstrip().endswith("/"):
                stack.append((tag, verdict))
                verdict = new
    parts.append(source[at:])
    flush()
    return blocks


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of ``a`` on a longest common subsequence of two arrays of line hashes."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    back = a[head:][::-1][: n - head] == b[head:][::-1][: n - head]
    tail = len(back) if back.all() else int(back.argmin())
    ia = np.arange(head, len(a) - tail)
    ia = ia[np.isin(a[ia], b[head : len(b) - tail])]
    bb = b[head : len(b) - tail]
    bb = bb[np.isin(bb, a[ia])]
    found = [*range(head), *range(len(a) - tail, len(a))]
    if len(ia) and len(bb):
        table = np.zeros((len(ia) + 1, len(bb) + 1), dtype=np.int32)
        for i in range(len(ia) - 1, -1, -1):
            diagonal = np.where(bb == a[ia[i]], table[i + 1, 1:] + 1, table[i + 1, :-1])
            table[i, :-1] = np.maximum.accumulate(diagonal[::-1])[::-1]
        i = j = 0
        while i < len(ia) and j < len(bb):
            if a[ia[i]] == bb[j]:
                found.append(int(ia[i]))
                i, j = i + 1, j + 1
            elif table[i + 1, j] >= table[i, j + 1]:
                i += 1
            else:
                j += 1
    return np.array(sorted(found), dtype=np.int64)


def _parse(lines: bool):
    """``(key, page, url)`` of pages and their marks and texts with ``lines``, otherwise hashes, and sizes (times 4) plus marks.

    Chrome lines never stay and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            pages = [[(t, m) for t, m in page_blocks(page) if m != CHROME] for page in batch.column("html").to_pylist()]
            held = list(batch.columns[:-1])
            if lines:  # one string each: blocks hold no line feed, and marks are digits
                held.append(pa.array(["".join([str(m) for _, m in p]) for p in pages], pa.string()))
                held.append(pa.array(["\n".join([t for t, _ in p]) for p in pages], pa.string()))
            else:
                held.append(pa.array([[xxh64_intdigest(t.encode("utf-8", "replace")) - 2**63 for t, _ in p] for p in pages], pa.list_(pa.int64())))
                held.append(pa.array([[4 * len(t) + m for t, m in p] for p in pages], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(held, ["key", "page", "url", "marks", "texts"] if lines else ["key", "page", "url", "hashes", "sizes"])

    return run


def _difference(copy_share: float):
    """Lines outside articles that a neighbour shares, and those inside with their hashes and whether both neighbours do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone, decided, inner = [], [], []
            for own, sizes, *others in zip(batch["hashes"], batch["sizes"], batch["before"], batch["after"]):
                size, mark = sizes >> 2, sizes & 3
                votes = np.zeros(len(own), dtype=np.int64)
                differs = False
                # copies are judged by the article, or by the whole text where no element says article
                body = mark != UNKNOWN if (mark != UNKNOWN).any() else mark == UNKNOWN
                for other in others:
                    if other is None or not len(own):
                        continue
                    shared = shared_lines(own, other)
                    if size[shared][body[shared]].sum() <= copy_share * size[body].sum():
                        votes[shared] += 1
                        differs = True
                gone.append(np.flatnonzero((votes > 0) & (mark == UNKNOWN)).tolist())
                decided.append(differs)
                inner.append([{"line": i, "hash": own[i], "both": votes[i] == 2} for i in np.flatnonzero((votes > 0) & (mark == ARTICLE)).tolist()])
            yield pd.DataFrame({"key": batch["key"], "host": batch["host"], "gone": gone, "decided": decided, "inner": inner})

    return run


def _templates(found: DataFrame, hosts: DataFrame, host_share: float, host_pages: int) -> DataFrame:
    """``(key, more)``: lines inside articles that are templates of their host."""
    inner = found.select("key", "host", F.inline("inner"))
    votes = inner.where("both").groupBy("host", "hash").agg(F.count("*").alias("n"))
    known = votes.join(hosts, "host").where(F.col("n") >= F.greatest(F.lit(host_pages), F.col("pages") * host_share)).select("host", "hash")
    return inner.join(known, ["host", "hash"]).groupBy("key").agg(F.collect_set("line").alias("more"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", copy_share: float = 0.5, host_share: float = 0.5, host_pages: int = 3) -> DataFrame:
    """``(key, url, text)`` of every page; see the module for the rules."""
    scratch = Scratch(pages.sparkSession, "extraction")
    page_key = F.xxhash64(F.col(key), F.coalesce(F.col(url), F.lit("")), F.lit("\n"), F.coalesce(F.col(html), F.lit("")))
    source = pages.select(page_key.alias("key"), F.col(key).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    # only hashes of lines travel; the pages are read once more for their texts
    lined = scratch.save(source.mapInArrow(_parse(False), "key long, page long, url string, hashes array<long>, sizes array<int>"))
    # neighbours by (host, path, page): sort globally, number the rows from counts per partition
    where = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    order = lined.select("key", "page", "hashes", "sizes", F.lower(where).alias("host"), path.alias("path"))
    order = order.repartitionByRange("host", "path", "page", "key").sortWithinPartitions("host", "path", "page", "key")
    order = scratch.save(order.drop("path", "page").withColumn("at", F.monotonically_increasing_id()))
    scratch.free(lined)
    scratch.release()
    part = F.shiftright("at", 33)
    counts = order.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = order.withColumn("part", part).join(F.broadcast(starts), "part")
    numbered = numbered.select("key", "host", "hashes", "sizes", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    near = lambda step, name: numbered.select((F.col("rank") + step).alias("rank"), F.col("host").alias(f"{name}_host"), F.col("hashes").alias(name))
    pairs = numbered.join(near(1, "before"), "rank", "left").join(near(-1, "after"), "rank", "left")
    pairs = pairs.select("key", "host", "hashes", "sizes", *[F.when(F.col(f"{n}_host") == F.col("host"), F.col(n)).alias(n) for n in ("before", "after")])
    kind = "key long, host string, gone array<int>, decided boolean, inner array<struct<line:int,hash:long,both:boolean>>"
    found = scratch.save(pairs.mapInPandas(_difference(copy_share), kind).where("decided"))
    more = _templates(found, order.groupBy("host").agg(F.count("*").alias("pages")), host_share, host_pages)
    # repeated rows are one page here
    gone = found.groupBy("key").agg(F.min("gone").alias("gone")).join(more, "key", "left")
    gone = scratch.save(gone.select("key", F.concat("gone", F.coalesce("more", F.array().cast("array<int>"))).alias("gone")))
    scratch.free(order, found)
    scratch.release()
    parsed = source.mapInArrow(_parse(True), "key long, page long, url string, marks string, texts string")
    pages_gone = parsed.join(gone, "key", "left")
    # without evidence from another page, an article element alone says what is text
    held = F.contains("marks", F.lit(str(ARTICLE))) | F.contains("marks", F.lit(str(HEADING)))
    outside = F.col("gone").isNotNull() | ~held
    cut = F.coalesce("gone", F.array().cast("array<int>"))
    stays = lambda i: (F.substring("marks", i + 1, F.lit(1)) != str(UNKNOWN)) | outside
    lines = F.filter(F.split("texts", "\n"), lambda t, i: stays(i) & ~F.array_contains(cut, i))
    out = pages_gone.select("page", "url", lines.alias("lines"))
    return out.select(F.col("page").alias(key), F.col("url").alias(url), F.array_join("lines", "\n\n").alias("text"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
