"""Main text of web pages: page structure plus a suffix array per host.

A page is cut into blocks at block-level tags. Scripts, styles, menus, forms, sidebars, notices, adverts,
footers, comments, hidden parts and the like are left out by their tag or by the words of their class, id and
role. Blocks inside ``article`` or ``main`` are marked, the others are loose.

The token streams of the loose blocks of all pages of a host are concatenated, and a suffix array over them finds
what recurs: runs of ``least`` tokens or more that occur on several distinct pages are boilerplate, and only the
unique runs stay. Marked blocks stay whole, since articles of one host do quote the same passages (README). The text
is the marked blocks. Where the page marks none, or where the loose blocks that stay are over ``OUTWEIGH`` times as
long as the marked ones (a teaser is marked and the body is not), it is all blocks that stay, in page order.

Hosts are dealt into groups of at most about ``group_bytes`` of html, so a host with a third of all pages
is spread over many tasks. What recurs on such a host is counted over all its groups first, so the text does not
depend on the groups. Only parsed text and hashes are shuffled.

Cases: null or empty html gives an empty text; a null url counts as the host with the empty name; cut-off
tags and unknown character references stay as they are; equal pages are no distinct pages, so copies of a
page do not turn its text into boilerplate; repeated rows give repeated results; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import materialize, pieces

LEAST_TOKENS, OUTWEIGH, GROUP_BYTES = 5, 3, 1_000_000
_RAW = "script|style|textarea|title|noscript|iframe|template|svg|xmp|noembed|noframes"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = set("nav aside footer form button select option datalist dialog menu head object audio video canvas map fieldset".split())
_BLOCK = set(
    "address article blockquote body caption center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Words that name what is no main text. A class or id is judged word by word: see ``names_unwanted``.
_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist disqus replies responses related recommended share sharing social widget widgets toolbar "
    "pagination pager login search complementary contentinfo".split()
)
#: Words that say only what kind of box it is, so that what stands beside them decides.
_BOX = set("area bar block blocks box button buttons card cards center col column container content form group inner item items left link links list main module outer panel posts right row section site slot stories text thread threads top user wrap wrapper".split())
#: Words of ``_WORDS`` that name a box of their own behind any other word: ``forum-comments``.
_NOUNS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookies footer masthead menu nav navbar navigation newsletter overlay pager pagination popup replies responses sidebar toolbar widget widgets".split())
#: Words that name reader comments as the name of a box or list; a ``section`` of that name may be part of an article.
_TALK = set("discussion discussions".split())
_LAYOUT = set("has is no not with without".split())
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def names_unwanted(value: str, strict: bool = False, listed: set[str] = _WORDS) -> bool:
    """Whether a class, id or role names what is no main text: a ``listed`` word alone or among words for boxes and
    numbers, or as a noun behind any word, but not in ``share-price`` or ``has-sidebar``. ``strict``: the first two only."""
    for token in value.lower().split():
        words = [w for w in re.split(r"[_\-:]+", token) if w]
        if not words or words[0] in _LAYOUT or not listed & set(words):
            continue
        if all(w in listed or w in _BOX or w.isdigit() for w in words) or not strict and words[-1] in _NOUNS:
            return True
    return False


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in _SKIP or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body"):
        return False
    listed = _WORDS | _TALK if name in ("div", "ol", "ul") else _WORDS
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" and not value or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id", "role") and names_unwanted(value, name in ("article", "main"), listed):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool]]:
    """The blocks of a page in order, each with whether it lies inside a marked article."""
    found: list[tuple[str, bool]] = []
    text: list[str] = []
    depth, skip, nested = 0, None, 0

    def close():
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            found.append((line, depth > 0))
        text.clear()

    for m in _TOKEN.finditer(page):
        _, end, name, attributes, words = m.groups()
        if words is not None:
            if skip is None:
                text.append(words)
            continue
        if name is None:
            continue
        name = name.lower()
        if skip is not None:
            if name == skip:
                nested += -1 if end else 1
                if not nested:
                    skip = None
                continue
            # an open paragraph or item ends where its like, or the element around it, does
            if not (skip in ("p", "li") and (end and name in ("ul", "ol", "div", "article", "section", "body") or not end and skip == "p" and name in _BLOCK)):
                continue
            skip = None
        if name in _BLOCK:
            close()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if not end and name not in _VOID and not attributes.endswith("/") and _unwanted(name, attributes, depth > 0):
            close()
            skip, nested = name, 1
        elif name in ("article", "main"):
            depth = max(0, depth - 1) if end else depth + 1
    close()
    return found


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, h = len(rank), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - h] = rank[h:] if h < n else []
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank, h = new, 2 * h
        if not n or new.max(initial=0) == n - 1 or h >= n:
            return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix length of each suffix in order with the one before it."""
    n, t = len(tokens), tokens.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place, before = place.tolist(), order.tolist()
    out, k = [0] * n, 0
    for i in range(n):
        if place[i]:
            j = before[place[i] - 1]
            while i + k < n and j + k < n and t[i + k] == t[j + k]:
                k += 1
            out[place[i]] = k
            k -= k > 0
        else:
            k = 0
    return np.array(out, np.int64)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def windows(line: str, least: int) -> list[int]:
    """Hashes of the runs of ``least`` tokens of a block, by their start."""
    words = line.split(" ")
    return [_hash(" ".join(words[i : i + least])) for i in range(len(words) - least + 1)]


def unique_runs(pages: list[list[str]], least: int = LEAST_TOKENS, elsewhere: set[int] | None = None) -> list[list[str]]:
    """The blocks of each page without runs of ``least`` tokens or more that occur on distinct pages, or
    whose ``windows`` are among those known to from ``elsewhere``; a block of which nothing stays is empty."""
    index: dict[str, int] = {}
    same: dict[tuple, int] = {}
    tokens, page, where, known = [], [], [], []
    for p, lines in enumerate(pages):
        who = same.setdefault(tuple(lines), len(same))
        for b, line in enumerate(lines):
            if elsewhere:
                known += [len(tokens) + i for i, h in enumerate(windows(line, least)) if h in elsewhere]
            for w in line.split(" "):
                tokens.append(index.setdefault(w, len(index)))
                page.append(who)
                where.append((p, b, w))
            tokens.append(-len(tokens) - 1)  # a separator that equals nothing
            page.append(-1)
            where.append(None)
    if not tokens:
        return pages
    t, page = np.array(tokens), np.array(page)
    order = suffix_array(t)
    lcp = common_prefixes(t, order)
    group = np.cumsum(lcp < least)
    first, start = np.unique(group, return_index=True)
    lo, hi = np.minimum.reduceat(page[order], start), np.maximum.reduceat(page[order], start)
    shared = (lo != hi)[np.searchsorted(first, group)]
    starts = np.union1d(order[shared], np.array(known, np.int64))
    edge = np.zeros(len(t) + least + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    covered = np.cumsum(edge)[: len(t)] > 0
    out: list[list[list[str]]] = [[[] for _ in lines] for lines in pages]
    for x, c in zip(where, covered):
        if x and not c:
            out[x[0]][x[1]].append(x[2])
    return [[" ".join(ws) for ws in b] for b in out]


def main_blocks(pages: list[list[tuple[str, bool]]], least: int = LEAST_TOKENS, elsewhere: set[int] | None = None) -> list[list[str]]:
    """The main text of each page, by blocks, given the other pages of its host or the windows known to recur there."""
    size = lambda lines: sum(x.count(" ") + 1 for x in lines if x)
    out = []
    for lines, loose in zip(pages, unique_runs([[x for x, inside in lines if not inside] for lines in pages], least, elsewhere)):
        marked = [x for x, inside in lines if inside]
        whole_page = not marked or size(loose) > OUTWEIGH * size(marked)
        rest = iter(loose)
        out.append([x for x in (x if inside else next(rest) for x, inside in lines) if x] if whole_page else marked)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_TOKENS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``id_col, url, text, n_chars`` for every page; blocks are joined by one line feed."""
    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit(""))
    source = pages.select(id_col, F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sizes = source.groupBy("host").agg(F.sum(F.octet_length("html")).alias("n")).where(F.col("n") > group_bytes)
    sizes = materialize(sizes.select("host", F.expr(f"n div {group_bytes} + 1").alias("parts")), "hosts")
    lists = [T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("inside", T.ArrayType(T.BooleanType()))]
    parsed = T.StructType([source.schema[id_col], source.schema["url"], T.StructField("host", T.StringType()), *lists])

    def parse(batches):
        for b in pieces(batches, 3):
            got = [blocks(h) for h in b.column(3).to_pylist()]
            lines, inside = pa.array([[x for x, _ in g] for g in got], pa.list_(pa.string())), pa.array([[i for _, i in g] for g in got], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lines, inside], names=parsed.names)

    part = F.pmod(F.xxhash64(id_col, "url"), F.coalesce("parts", F.lit(1)))
    dealt = source.mapInArrow(parse, parsed).join(sizes, "host", "left")
    dealt = dealt.withColumn("part", part).select(id_col, "url", "host", "part", "lines", "inside")
    schema = T.StructType([source.schema[id_col], source.schema["url"], T.StructField("text", T.StringType())])

    def spread(batches):
        for b in pieces(batches, 2):
            host, number, page, found = [], [], [], []
            for h, k, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                lines = [line for line, inside in blocks(x) if not inside]
                own = {w for line in lines for w in windows(line, least)}
                host += [h] * len(own)
                number += [k] * len(own)
                page += [_hash("\n".join(lines))] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(number, pa.int64()), pa.array(page, pa.int64()), pa.array(found, pa.int64())], names=["host", "part", "page", "w"])

    hot = source.join(sizes, "host").select("host", part.alias("part"), "html")
    hot = materialize(hot.mapInArrow(spread, "host string, part long, page long, w long"), "hosts")
    several = hot.groupBy("host", "w").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo <> hi").select("host", "w")
    several = hot.join(several, ["host", "w"]).select("host", "part", "w").distinct()

    def choose(table: pa.Table, known: pa.Table) -> pa.Table:
        lines = [list(zip(x, i)) for x, i in zip(table.column("lines").to_pylist(), table.column("inside").to_pylist())]
        kept = main_blocks(lines, least, set(known.column("w").to_pylist()))
        return pa.table([table.column(id_col), table.column("url"), pa.array(["\n".join(x) for x in kept], pa.string())], names=schema.names)

    out = dealt.groupBy("host", "part").cogroup(several.groupBy("host", "part")).applyInArrow(choose, schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
