"""Main text of web pages: a host's suffix arrays find what its pages repeat, markup checks what of it may go.

A page is cut into blocks. Content is what stands in an article, or in main where there is no article or where main holds more text
outside its articles than inside. In content, blocks in menus, footers, adverts, forms, comments and the like are dropped: by their tag, or
by a class that has such a name for all it says (`ad`, `share-buttons`). A block whose class only has such a word among others
(`notice-period`, `related-work`) is doubtful, and so are all other blocks of a page without article and main. Text inside a line is never dropped by a class.

Every page goes through the suffix arrays of its host. The frame of a page (all blocks that aren't content, and the doubtful ones) is one
token stream. The pages are dealt into groups of bounded size; in each group a suffix array with LCP over the concatenated streams of a
host puts equal substrings side by side: suffixes with an LCP of RUN tokens or more between neighbours hold one run, and the number of
distinct frames among them is summed over the groups. A stretch of a block is boilerplate if runs that MIN_PAGES or more distinct frames of
the host share cover it (what any longer repeated substring covers is what its runs cover). All content of all pages is searched for such stretches: those of
doubtful blocks are cut (n_cut words). Then follows the check by markup: an article has to be returned whole, also where it cites what
frames say or where other pages' sidebars show its headline or teaser, so stretches of sure blocks stay, and are counted (n_repeated words).
Which pages may hold a shared run is told by a filter of fixed size; what it lets through is joined.

A null page is an empty one, with empty text. Copies of one frame count once, so that copied pages don't remove each other. Pages of any
length are taken whole. Repeated rows give repeated results; empty tables give empty ones; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import itertools
import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import BITMAP_BITS, FILTER_BITS, map_rows, materialise, ship, spread
from orrery.llm.url_filter import split_url

#: Tokens of the shortest run that can be boilerplate, and how many distinct frames of a host must share it.
RUN = 8
MIN_PAGES = 3
#: Frames of one group and their tokens, about; each host has its own suffix array in a group.
GROUP_PAGES = 2000
GROUP_TOKENS = 500_000

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|[^<]++|<",
    re.S,
)
RAW = {"script", "style", "noscript", "template", "title", "textarea", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
         "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements of other languages, which may close themselves.
FOREIGN = {"svg", "math"}
#: Elements that last to the end of the page if nothing closes them.
TO_THE_END = {"script", "style", "textarea", "title", "iframe"}
JUNK_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select"}
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
JUNK_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr",
              "banner", "notice", "notices", "popup", "modal", "overlay", "comment", "comments", "disqus", "reply", "replies", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "pagination", "pager", "widget", "toolbar", "skip"}
#: Parts of names that say where or what kind of box it is.
NEUTRAL_NAMES = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "global", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "page", "panel", "primary", "right", "secondary", "section", "site", "top", "wrap", "wrapper"}
NAMES = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
CLOSES_P = BLOCK - {"br", "html", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose id names a part of the page; ids of others are often slugs of what they say.
BOXES = {"div", "section", "ul", "ol", "table"}
WHOLE = {"article", "main", "body", "html"}
JUNK, DOUBTFUL = "junk", "?"


def _judged(tag: str, attributes: str, in_content: bool) -> str:
    """JUNK, DOUBTFUL or nothing for an element by its tag and attributes."""
    if tag in JUNK_TAGS or (tag == "header" and not in_content):
        return JUNK
    if not attributes or attributes.isspace():
        return ""
    if (m := ROLE.search(attributes)) and m[1].lower() in JUNK_ROLES or HIDDEN.search(attributes):
        return JUNK
    if tag not in BLOCK or tag in WHOLE:
        return ""
    out = ""
    for m in NAMES.finditer(attributes):
        if m[1].lower() == "id" and tag not in BOXES:
            continue
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = {x for x in re.split(r"[-_]+", name) if x}
            if parts & JUNK_NAMES:
                if parts <= JUNK_NAMES | NEUTRAL_NAMES and not (in_content and (tag in HEADINGS or "header" in parts)):
                    return JUNK
                out = DOUBTFUL
    return out


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of every block in page order; zones: article, main, open, each also with a DOUBTFUL mark behind it, and JUNK."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # tag, zone inside it
    zone, pieces = "open", []

    def flush():
        if pieces:
            text = " ".join(html_lib.unescape("".join(pieces)).split())
            if text:
                out.append((zone, text))
            pieces.clear()

    at, size = 0, len(page)
    while at < size:
        m = PIECE.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                pieces.append(m[0])
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if not closing and tag in RAW:
            if tag in FOREIGN and attributes.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag == "head" and end is None:
                end = re.compile(r"<body\b", re.I).search(page, at)
                at = end.start() if end else at
            elif end:
                at = end.end()
            elif tag in TO_THE_END:
                at = size
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][1] != (stack[i - 1][1] if i else "open"):
                        flush()
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main") and tag not in ("body", "html", "main", "article"):
                    break  # a stray end tag closes no article
            zone = stack[-1][1] if stack else "open"
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
            zone = stack[-1][1] if stack else "open"
        judged = JUNK if zone == JUNK else _judged(tag, attributes, not zone.startswith("open"))
        mark = DOUBTFUL if zone.endswith(DOUBTFUL) else ""
        if judged == JUNK:
            inner = JUNK
        elif tag == "article" or (tag == "main" and not zone.startswith("article")):
            inner = tag + mark
        elif judged == DOUBTFUL and not mark:
            inner = zone + DOUBTFUL
        else:
            inner = zone
        if inner != zone:
            flush()
        stack.append((tag, inner))
        zone = inner
    flush()
    return out


def page_parts(page: str | None) -> tuple[list[tuple[bool, str]], list[str]]:
    """Content blocks of a page, and whether each is sure by its markup; the frame's tokens (with a mark between blocks)."""
    found = blocks(page or "")
    size = {"article": 0, "main": 0, "open": 0, JUNK: 0}
    for z, t in found:
        size[z.rstrip(DOUBTFUL)] += len(t)
    content = {"article"} if size["article"] else {"main"} if size["main"] else set()
    if size["main"] > size["article"]:
        content.add("main")
    parts, frame = [], []
    for z, t in found:
        place, sure = z.rstrip(DOUBTFUL), not z.endswith(DOUBTFUL) and z != "open"
        if place in content or not content and place == "open":
            parts.append((sure, t))
        if not sure or place not in content:
            frame += [*t.split(" "), "\x00"]
    return parts, frame


def read_page(page: str | None) -> tuple[str, list[tuple[bool, str]], list[str]]:
    """What markup alone says of a page: its text if all blocks are sure, else its blocks; the frame's tokens. No result is made of this."""
    parts, frame = page_parts(page)
    if all(sure for sure, _ in parts):
        return " ".join(t for _, t in parts), [], frame
    return "", parts, frame


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the stream, and its LCP: how many tokens each suffix has in common with the one before it (0 for the first).

    Prefix doubling: classes of prefixes of length h pair up to those of length 2h, until no two suffixes are alike. The classes of all
    lengths then tell the LCP, from the longest to the shortest.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    levels = [rank.astype(np.int32)]
    while rank.max() < n - 1:
        h = 1 << (len(levels) - 1)
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + second, return_inverse=True)
        levels.append(rank.astype(np.int32))
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        same &= (a < n) & (b < n)
        a[same] += 1 << k
        b[same] += 1 << k
    lcp[1:] = a - order[:-1]
    return order, lcp


def window_key(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\x01".join(tokens).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, depth: int) -> np.ndarray:
    """A quick hash of the run of `depth` words at each place that has one, from hashes of the words; only the filter uses it."""
    n = max(len(hashes) - depth + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(depth if n else 0):
        out *= MULTIPLIER
        out += hashes[j : n + j]
    return out


def counted_runs(frames: list[list[str]], depth: int = RUN) -> list[tuple[int, int, int]]:
    """Key and quick hash of each run of `depth` tokens inside blocks, and the number of frames that hold it."""
    ids: dict[str, int] = {}
    stream, owner = [], []
    for p, frame in enumerate(frames):
        for w in [*frame, "\x00"]:
            # a mark between blocks equals no other token
            stream.append(-1 - len(stream) if w == "\x00" else ids.setdefault(w, len(ids)))
            owner.append(p)
    n = len(stream)
    if n < depth:
        return []
    tokens, owner = np.array(stream), np.array(owner)
    order, lcp = suffix_array(tokens)
    marks = np.concatenate(([0], np.cumsum(tokens < 0)))
    inside = np.zeros(n, bool)
    inside[: n - depth + 1] = marks[depth:] == marks[: n - depth + 1]
    alike = np.cumsum(lcp < depth)[inside[order]]  # one number for neighbours with so much in common
    order = order[inside[order]]
    if not len(order):
        return []
    held = np.unique(alike * len(frames) + owner[order]) // len(frames)  # one entry for a run and a frame that holds it
    _, counts = np.unique(held, return_counts=True)
    _, first = np.unique(alike, return_index=True)
    words, at = list(ids), order[first]
    hashes = np.append(word_hashes([w.encode("utf-8", "surrogatepass") for w in words]), np.uint64(0))
    quick = run_hashes(hashes[np.maximum(tokens, -1)], depth)[at].view(np.int64)
    runs = tokens[at[:, None] + np.arange(depth)]
    return [(window_key([words[t] for t in run.tolist()]), q, c) for run, q, c in zip(runs, quick.tolist(), counts.tolist())]


def shared_runs(frames: list[list[str]], depth: int = RUN) -> dict[int, int]:
    """Key of each run of `depth` tokens inside blocks: the number of frames that hold it."""
    return {run: n for run, _, n in counted_runs(frames, depth)}


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A key of the row, id, url, host, parts (sure, text) and frame tokens of every page, as page_parts gives them."""
    host, _ = split_url(F.col(url_col))
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), F.col(html_col).alias("_html"))

    def make():
        keys = itertools.count(TaskContext.get().partitionId() << 33)

        def read(i, u, h, page):
            parts, frame = page_parts(page)
            return [(next(keys), i, u, h, [{"sure": s, "text": t} for s, t in parts], frame)]

        return read

    return map_rows(spread(rows), make, f"_key bigint, {id_col} {kind}, {url_col} {url_kind}, host string, parts array<struct<sure:boolean,text:string>>, frame array<string>", chunk=200)


def boilerplate(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, run, quick: keys and quick hashes of the runs that so many distinct frames of the host share."""
    frames = parsed.where(F.size("frame") >= RUN).select("host", "frame", F.xxhash64("frame").alias("_f"))
    n, tokens = frames.agg(F.count("*"), F.coalesce(F.sum(F.size("frame").cast("long")), F.lit(0))).first()
    groups = max(1, n // GROUP_PAGES, tokens // GROUP_TOKENS)
    ship(parsed.sparkSession)
    dealt = frames.withColumn("_g", F.pmod(F.xxhash64("_f"), F.lit(groups)))

    def runs(pdf):
        import pandas as pd

        found = [(host, *x) for host, of in pdf.groupby("host", dropna=False)["frame"] for x in counted_runs(list({tuple(f): None for f in of}))]
        return pd.DataFrame(found, columns=["host", "run", "quick", "n"]).astype({"host": "object", "run": "int64", "quick": "int64", "n": "int64"})

    # copies of a frame meet in one group, where they count once, so that the sum over groups counts distinct frames
    once = dealt.groupBy("host", "_g", "_f").agg(F.first("frame").alias("frame"))
    counted = once.groupBy("_g").applyInPandas(runs, "host string, run bigint, quick bigint, n bigint")
    return counted.groupBy("host", "run").agg(F.first("quick").alias("quick"), F.sum("n").alias("n")).where(F.col("n") >= min_pages).drop("n")


#: Places in the filter for a shared run.
PROBES = 4
PLACE = FILTER_BITS - 1


def run_filter(shared: DataFrame) -> np.ndarray:
    """Bytes of a filter of FILTER_BITS bits that lets all shared runs of a host through, and few others."""
    x = F.col("quick").bitwiseXOR(F.xxhash64("host"))
    low, step = x.bitwiseAND(F.lit(PLACE)), F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(PLACE)).bitwiseOR(F.lit(1))
    slots = shared.select(F.explode(F.array(*[(low + step * i).bitwiseAND(F.lit(PLACE)) for i in range(PROBES)])).alias("h"))
    maps = slots.groupBy(F.floor(F.col("h") / BITMAP_BITS).cast("int").alias("m")).agg(F.bitmap_construct_agg(F.col("h") % BITMAP_BITS).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for m, bits in maps.collect():  # FILTER_BITS at most
        out[m * BITMAP_BITS // 8 : (m + 1) * BITMAP_BITS // 8] = np.frombuffer(bits, np.uint8)
    return out


def maybe_shared(texts: list[str], host_hash: int, bits: np.ndarray) -> list[tuple[int, int, int]]:
    """(block, position, key) of the runs of a page's blocks that the filter lets through."""
    blocks = [t.encode("utf-8", "surrogatepass").split(b" ") for t in texts]
    sizes = np.array([len(b) for b in blocks], np.int64)
    words = list(itertools.chain.from_iterable(blocks))
    if len(words) < RUN:
        return []
    x = run_hashes(word_hashes(words), RUN) ^ np.uint64(host_hash % (1 << 64))
    at = np.arange(len(x))
    for i in range(PROBES):
        slot = (x & np.uint64(PLACE)) + (x >> np.uint64(32) & np.uint64(PLACE) | np.uint64(1)) * np.uint64(i) if i else x
        slot = (slot & np.uint64(PLACE)).view(np.int64)
        on = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
        at, x = at[on], x[on]
        if not len(at):
            return []
    ends = np.cumsum(sizes)
    block = np.searchsorted(ends, at, side="right")
    inside = at + RUN <= ends[block]
    return [(b, i - start, window_key([w.decode("utf-8", "surrogatepass") for w in words[i : i + RUN]])) for b, i, start in zip(block[inside].tolist(), at[inside].tolist(), (ends - sizes)[block[inside]].tolist())]


def decided(parts: list[dict], hits: list[dict]) -> tuple[str, int, int]:
    """Text of a page whose runs at `hits` are boilerplate; words cut; words that markup keeps though they are repeated."""
    if not hits:
        return " ".join(p["text"] for p in parts), 0, 0
    covered = {(h["block"], h["at"] + k) for h in hits for k in range(RUN)}
    kept, n_cut, n_repeated = [], 0, 0
    for b, p in enumerate(parts):
        words = p["text"].split(" ")
        left = [w for k, w in enumerate(words) if (b, k) not in covered]
        if p["sure"]:
            n_repeated += len(words) - len(left)
            left = words
        n_cut += len(words) - len(left)
        kept += left
    return " ".join(kept), n_cut, n_repeated


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_cut, n_repeated of every page."""
    parsed = materialise(parse(pages, id_col, url_col, html_col), "pages")
    shared = materialise(boilerplate(parsed), "shared", narrow=True)
    bits = parsed.sparkSession.sparkContext.broadcast(run_filter(shared))
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    result = f"{id_col} {kind}, {url_col} {url_kind}, text string, n_cut bigint, n_repeated bigint"

    def searched(clear: bool):
        def make():
            filled = bits.value

            def f(key, i, u, host, hashed, parts):
                runs = maybe_shared([p["text"] for p in parts], hashed, filled)
                if clear:
                    return [] if runs else [(i, u, *decided(parts, []))]
                return [(key, i, u, host, parts, [{"block": b, "at": a, "run": r} for b, a, r in runs])] if runs else []

            return f

        return make

    rows = parsed.select("_key", id_col, url_col, "host", F.xxhash64("host").alias("_hash"), "parts")
    # pages without a shared run are done; only the others meet the shared runs
    clear = map_rows(rows, searched(True), result)
    maybe = f"_key bigint, {id_col} {kind}, {url_col} {url_kind}, host string, parts array<struct<sure:boolean,text:string>>, runs array<struct<block:int,at:int,run:bigint>>"
    met = materialise(map_rows(rows, searched(False), maybe, chunk=200), "met")
    places = met.select("_key", "host", F.explode("runs").alias("r")).select("_key", "host", "r.*")
    hits = places.join(shared, ["host", "run"]).groupBy("_key").agg(F.collect_list(F.struct("block", "at")).alias("hits"))
    told = map_rows(met.join(hits, "_key", "left").select(id_col, url_col, "parts", "hits"), lambda: lambda i, u, parts, hits: [(i, u, *decided(parts, hits or []))], result)
    return clear.unionByName(told).select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"), "n_cut", "n_repeated")
