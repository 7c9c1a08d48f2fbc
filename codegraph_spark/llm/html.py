"""Main text of web pages with a host suffix array (operator 5).

Each page is cut into blocks of text; the markup around a block is a hint: boilerplate, article, or neither. The blocks outside
articles are a page's token stream; a mark at the start of each block is a token too.

1. A host's pages are dealt into groups of a bounded number. A group's streams are concatenated and a suffix array, sorted by
   the first LEAST_RUN tokens, brings equal runs of that length together. Each run is named by a hash, with up to LEAST_PAGES
   distinct pages that hold it.
2. Names meet over all groups of the host: a run is boilerplate when it is on LEAST_PAGES distinct pages of the whole host or
   more (pages with equal blocks count once). The names go back to the groups that hold them.
3. Tokens covered by such runs are removed; unique runs stay unless the markup says that they are no part of the article.

So the groups only balance the work: the result does not depend on them, nor on how many other pages the host has. An article
is kept whole: a passage that many pages quote there is no boilerplate.
"""

from __future__ import annotations

import html as entities
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, rolling, shuffle_partitions

#: Shortest recurring run, in tokens, and distinct pages of the host that it has to be on.
LEAST_RUN, LEAST_PAGES = 12, 3
#: Pages (about) whose streams are in one suffix array; balances the work and changes no result.
GROUP_PAGES = 500
#: Hosts whose counts may be broadcast.
BROADCAST_HOSTS = 100_000
#: The token at the start of a block; no word of a text holds it.
_MARK = b"\n"

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^<]*\Z""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "title", "svg", "math", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SKIP = {"nav", "header", "footer", "aside", "form", "menu", "head", "select", "button", "dialog", "fieldset", "option", "datalist"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | _SKIP
#: Words of a class, id or role that mark what is no part of the article, and words that mark a page's frame: the header or
#: footer of an article, post or entry is no frame.
_OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|cookies?|notices?|consent|sidebar|comments?|repl(?:y|ies)|responses?|reviews|disqus|discussion|menu|nav|navbar|navigation"
    r"|promos?|related|share|social|subscribe|newsletter|popup|modal|complementary|contentinfo|breadcrumbs?)(?:$|[\s_-])",
    re.I,
)
_FRAME = re.compile(r"(?<!\S)(?:(?:[^\s]*[_-])?footer|(?!(?:article|post|entry|story|content)[_-])(?:[^\s]*[_-])?(?:banner|header|masthead))(?:$|[\s_-])", re.I)
#: Within an article only names that say nothing else count, and only to their end: a section on related work, a discussion or
#: responses to a treatment are text.
_INSIDE = re.compile(
    r"(?<!\S)(?:ads?|comment|cookie-notice|notice|menu|nav|navbar|navigation|breadcrumbs?|share|social|subscribe|promo|popup|modal|disqus|complementary|contentinfo|(?:site|page)[_-]header"
    r"|(?:[^\s]*[_-])?(?:adverts?|advertisement|banner|comments|cookies?|footer|newsletter|replies|reviews|sidebar))(?!\S)",
    re.I,
)
#: Elements of other vocabularies: a slash at the end of the tag closes them.
_FOREIGN = {"svg", "math"}
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
BOILERPLATE, NEUTRAL, ARTICLE = 0, 1, 2


def blocks(page: str) -> list[tuple[int, str]]:
    """(BOILERPLATE, NEUTRAL or ARTICLE, text) of every non-empty block in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []
    skip, article, text = 0, 0, []

    def flush() -> None:
        if text:
            s = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if s:
                out.append((BOILERPLATE if skip else ARTICLE if article else NEUTRAL, s))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _FOREIGN and m[3].endswith("/"):
            continue
        if tag in _RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for _, s, a in stack[i:]:
                        skip, article = skip - s, article - a
                    del stack[i:]
                    break
        elif tag not in _VOID and not m[3].endswith("/"):
            names = [x.strip("\"'") for x in _NAMED.findall(m[3])]
            if article:  # an article within one is a reader's comment where its names say so
                marked = any(_INSIDE.search(x) for x in names)
            else:
                marked = tag not in ("html", "body", "article", "main") and any(_OUTSIDE.search(x) or _FRAME.search(x) for x in names)
            hidden = tag in _SKIP or marked
            mark = tag in ("article", "main")
            stack.append((tag, hidden, mark))
            skip, article = skip + hidden, article + mark
    flush()
    return out


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of integers by prefix doubling; with depth, sorted by the first depth entries at least."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:] if step < n else rank[:0]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        fresh = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if n == 0 or fresh[-1] == n - 1 or step >= (depth or n):
            return order


class Streams:
    """The token streams of one host's pages, end to end; a separator of its own ends each, so no run goes across pages."""

    def __init__(self, host: str, pages: list[list[bytes]], hashes: WordHashes, least: int = LEAST_RUN):
        numbers: dict[bytes, int] = {}
        self.least = least
        self.text = np.fromiter(itertools.chain.from_iterable([*[numbers.setdefault(t, len(numbers)) for t in page], -1 - p] for p, page in enumerate(pages)), np.int64)
        self.sizes = np.array([len(page) for page in pages], np.int64)
        self.page = np.repeat(np.arange(len(pages)), self.sizes + 1)
        last = np.cumsum(self.sizes + 1) - 1
        words = np.zeros(len(self.text), np.uint64)
        words[self.text >= 0] = hashes.of(list(itertools.chain.from_iterable(pages)))
        # a whole run starts where its last token is still of the page
        self.whole = np.arange(len(self.text)) + least <= last[self.page]
        names = rolling(words, least, 0x9E3779B97F4A7C15 | 1)
        self.names = np.r_[names, np.zeros(len(self.text) - len(names), np.uint64)] ^ np.uint64(xxhash.xxh64_intdigest(host.encode()))

    def runs(self, digests: np.ndarray, pages: int = LEAST_PAGES) -> tuple[np.ndarray, np.ndarray]:
        """(names, digests): every run of `least` tokens, with up to `pages` distinct digests of pages that hold it."""
        order = suffix_array(self.text, self.least)
        order = order[self.whole[order]]
        if not len(order):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        differs = np.zeros(len(order) - 1, bool)
        for t in range(self.least):
            differs |= self.text[order[1:] + t] != self.text[order[:-1] + t]
        run = np.cumsum(np.r_[0, differs])
        digest = digests[self.page[order]]
        by = np.lexsort((digest, run))
        run, digest, name = run[by], digest[by], self.names[order[by]]
        new = np.r_[True, (run[1:] != run[:-1]) | (digest[1:] != digest[:-1])]
        run, digest, name = run[new], digest[new], name[new]
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        few = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)])) < pages
        return name[few], digest[few]

    def covered(self, known: np.ndarray) -> list[np.ndarray]:
        """For each page, which tokens lie in a run with a known name (sorted names)."""
        at = np.flatnonzero(self.whole)
        if len(known):
            at = at[known[np.minimum(np.searchsorted(known, self.names[at]), len(known) - 1)] == self.names[at]]
        edges = np.zeros(len(self.text) + 1, np.int64)
        if len(known):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + self.least, -1)
        inside, ends = np.cumsum(edges[:-1]) > 0, np.cumsum(self.sizes + 1)
        return [inside[e - n - 1 : e - 1] for n, e in zip(self.sizes, ends, strict=True)]


def main_text(states: list[int], texts: list[str], inside: np.ndarray) -> str:
    """The article's blocks; without any, the runs of neutral blocks that the host does not repeat (if none is left: all neutral
    blocks, for then the page as a whole recurs). inside: which tokens of the blocks outside the article recur.
    """
    if ARTICLE in states:
        return "\n".join(t for s, t in zip(states, texts, strict=True) if s == ARTICLE)
    at, keep, neutral = 0, [], []
    for s, t in zip(states, texts, strict=True):
        tokens = t.split(" ")
        if s == NEUTRAL:
            neutral.append(t)
            unique = " ".join(itertools.compress(tokens, (~inside[at + 1 : at + 1 + len(tokens)]).tolist()))
            if unique:
                keep.append(unique)
        at += 1 + len(tokens)
    return "\n".join(keep or neutral)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated), one row per row of pages: blocks in page order joined by a line feed.

    Null html is empty and gives an empty text. Pages without a readable host form hosts by their id's hash; null and
    repeated ids and urls pass through (rows that are equal count as one page of the host); an empty table gives no rows; other
    columns are ignored. n_repeated: tokens outside the article that the host repeats. Pages of any length are read whole.
    """
    schema = "page_id long, url string, host string, digest long, blocks binary"

    def make():
        codec = _codec()

        def one(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [_written(blocks(x or "")) for x in part.column(3).to_pylist()]
                digests = np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64).view(np.int64)
                packed = [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests), pa.array(packed, pa.binary())], ["page_id", "url", "host", "digest", "blocks"])

        return one

    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    raw = raw.select("page_id", "url", F.when(host == "", F.concat(F.lit("?"), F.pmod(F.xxhash64("page_id", "url"), F.lit(4096)))).otherwise(host).alias("host"), "html")
    sizes = raw.groupBy("host").agg(F.count("*").alias("n"))
    n_hosts, n_pages = raw.select(F.approx_count_distinct("host"), F.count("*")).first()
    sizes = sizes.select("host", F.ceil(F.col("n") / GROUP_PAGES).alias("parts"))
    sizes = F.broadcast(sizes) if n_hosts <= BROADCAST_HOSTS else sizes
    # small hosts share groups, large hosts have several
    groups = max(2 * shuffle_partitions(pages.sparkSession), n_pages // GROUP_PAGES)
    group = F.pmod(F.xxhash64("host", F.pmod(F.xxhash64("page_id", "url"), F.col("parts"))), F.lit(groups)).cast("int")
    cut = arrow_map(raw, make, schema).join(sizes, "host").select("page_id", "url", "host", "digest", "blocks", group.alias("group"))

    def names(table: pa.Table) -> pa.Table:
        out, hashes = [], WordHashes()
        for host, rows, _, streams in _hosts(table):
            digests = table["digest"].to_numpy()[rows].view(np.uint64)
            out.append(Streams(host, streams, hashes).runs(digests))
        name, digest = (np.concatenate(x) if out else np.zeros(0, np.uint64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) * 2
        bucket = (name % np.uint64(groups)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, name, digest = bucket[order], name[order], digest[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
        packed = [pa.array([c[i:j].tobytes() for i, j in itertools.pairwise(cuts)], pa.binary()) for c in (name, digest)]
        return pa.table({"bucket": pa.array(bucket[cuts[:-1]]), "group": pa.array(np.full(len(cuts) - 1, table["group"][0].as_py(), np.int32)), "names": packed[0], "digests": packed[1]})

    def meet(table: pa.Table) -> pa.Table:
        sizes = [len(x) // 8 for x in table["names"].to_pylist()]
        name, digest = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64) for c in ("names", "digests"))
        group = np.repeat(table["group"].to_numpy(), sizes)
        order = np.lexsort((digest, name))
        n, d = name[order], digest[order]
        new = np.r_[True, n[1:] != n[:-1]][: len(n)]
        distinct = np.add.reduceat((new | np.r_[True, d[1:] != d[:-1]][: len(d)]).astype(np.int64), np.flatnonzero(new)) if len(n) else np.zeros(0, int)
        many = n[np.flatnonzero(new)][distinct >= LEAST_PAGES]
        mine = np.isin(name, many)
        pairs = np.unique(np.stack([group[mine].astype(np.uint64), name[mine]], 1), axis=0)
        cuts = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0], True]) if len(pairs) else np.zeros(1, int)
        return pa.table({"group": pa.array(pairs[cuts[:-1], 0].astype(np.int32)), "names": pa.array([pairs[i:j, 1].tobytes() for i, j in itertools.pairwise(cuts)], pa.binary())})

    def finish(table: pa.Table, known: pa.Table) -> pa.Table:
        known = np.unique(np.frombuffer(b"".join(known["names"].to_pylist()), np.uint64))
        hashes, text, shared = WordHashes(), [""] * table.num_rows, [0] * table.num_rows
        for host, rows, found, streams in _hosts(table):
            for r, (states, texts), stream, inside in zip(rows, found, streams, Streams(host, streams, hashes).covered(known), strict=True):
                text[r] = main_text(states, texts, inside)
                shared[r] = sum(i and t != _MARK for i, t in zip(inside.tolist(), stream, strict=True))
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(text, pa.string()), "n_chars": pa.array([len(x) for x in text], pa.int64()), "n_repeated": pa.array(shared, pa.int64())})

    met = cut.groupBy("group").applyInArrow(names, "bucket int, group int, names binary, digests binary").groupBy("bucket").applyInArrow(meet, "group int, names binary")
    return cut.groupBy("group").cogroup(met.groupBy("group")).applyInArrow(finish, "page_id long, url string, text string, n_chars long, n_repeated long")


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _written(found: list[tuple[int, str]]) -> bytes:
    return b"\n".join(b"%d%b" % (s, t.encode("utf-8", "surrogatepass")) for s, t in found)


def _hosts(table: pa.Table):
    """(host, rows, (states, texts) of each row, stream of each row) for every host of a group."""
    rows_of: dict[str, list[int]] = {}
    for r, host in enumerate(table["host"].to_pylist()):
        rows_of.setdefault(host, []).append(r)
    packed, codec = table["blocks"].to_pylist(), _codec()
    for host, rows in rows_of.items():
        found, streams = [], []
        for r in rows:
            data = codec.decompress(packed[r][8:], int.from_bytes(packed[r][:8], "little"), asbytes=True) if packed[r] else b""
            states, texts = [], []
            stream: list[bytes] = []
            for line in data.split(b"\n") if data else ():
                state = line[0] - 48
                states.append(state)
                texts.append(line[1:].decode("utf-8", "surrogatepass"))
                if state != ARTICLE:
                    stream.append(_MARK)
                    stream += line[1:].split(b" ")
            found.append((states, texts))
            streams.append(stream)
        yield host, rows, found, streams
