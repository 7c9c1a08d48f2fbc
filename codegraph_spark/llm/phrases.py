"""Substring dedup by repeated-phrase automata (operator 10).

1. Candidates. Every window of 13 words is named by the smallest hash of its eight 6-word grams (its anchor), so equal
   windows have equal anchors and there are far fewer anchors than windows. Anchors meet by hash; those of two documents
   or more go back to the blocks of documents that hold them.
2. Confirmation. Windows whose anchor recurs are named by 96 bits and meet again: of each the smallest doc_id is known. A
   block gets back the place of one occurrence of its own of each window that some document of it has to lose.
3. Automata. Consecutive places are a passage. Passages are cut into pieces of 7 words, end to end, so that any 13 words of a
   passage hold a whole piece. The pieces are compiled into Aho-Corasick automata (shards of a bounded number of pieces) and
   all documents of the block are streamed through them: where a piece is found, the passage's words around it decide
   whether 13 or more agree. Nothing but the automata says where a passage is.

What meets is packed by hash bucket after each batch has merged its own repeats, so a passage that a third of all
documents hold costs one entry a batch and block, never a group of documents.
"""

from __future__ import annotations

import hashlib
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, rolling, shuffle_partitions, sliding_min

WINDOW, GRAM = 13, 6
#: Pieces in one automaton; a block's further pieces go to further automata.
SHARD_PIECES = 50_000
BLOCK_BYTES, LEAST_BLOCKS = 4 << 20, 768
_U = np.uint64
_B1, _B2 = 0x100000001B3, 0xD6E8FEB86659FD93


def _words(column) -> list[list[bytes]]:
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


def _windows(docs: list[list[bytes]], hashes: WordHashes, window: int, gram: int):
    """For all documents of a batch joined end to end: word hashes, anchors per window start, and which starts are whole."""
    sizes = np.array([len(d) for d in docs], np.int64)
    h = hashes.of(list(itertools.chain.from_iterable(docs)))
    anchors = sliding_min(rolling(h, gram, _B1), window - gram + 1)
    doc = np.repeat(np.arange(len(docs)), sizes)
    starts = np.arange(len(anchors))
    whole = doc[starts] == doc[starts + window - 1] if len(anchors) else np.zeros(0, bool)
    return h, anchors, doc[: len(anchors)], whole


def _pack(bucket: np.ndarray, *columns: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    return [pa.array(bucket[cuts[:-1]].astype(np.int32))] + [pa.array([c[i:j].tobytes() for i, j in itertools.pairwise(cuts)], pa.binary()) for c in columns]


def _join(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _blocked(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))


def _recurring_anchors(docs: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """(block, anchors): anchors found in two rows or more, for each block that holds them."""

    def make():
        hashes = WordHashes()

        def one(batch: pa.RecordBatch):
            texts = _words(batch.column(1))
            blocks = batch.column(2).to_numpy()
            at = 0
            while at < len(texts):  # bounded steps, whatever the batch holds
                end, words = at, 0
                while end < len(texts) and (end == at or words + len(texts[end]) <= 1_000_000):
                    words += len(texts[end])
                    end += 1
                _, anchors, doc, whole = _windows(texts[at:end], hashes, window, gram)
                a, d = anchors[whole], doc[whole]
                new = _first_of_runs(d, a) if len(a) else np.zeros(0, bool)
                a, d = a[new], d[new]
                order = np.lexsort((d, a))
                a, d = a[order], d[order]
                new = _first_of_runs(a, d) if len(a) else new[:0]
                a, d = a[new], d[new]
                b = blocks[at:end][d].astype(np.uint32)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = _first_of_runs(a, b) if len(a) else new[:0]
                starts = np.flatnonzero(new)
                many = np.diff(np.r_[starts, len(a)]) > 1
                a, b = a[starts], b[starts] | (many.astype(np.uint32) << np.uint32(31))
                if len(a):
                    yield pa.RecordBatch.from_arrays(_pack((a >> _U(20)) % _U(buckets), a, b), ["bucket", "keys", "tags"])
                at = end

        return one

    def meet(table: pa.Table) -> pa.Table:
        keys, tags = _join(table, "keys", np.uint64), _join(table, "tags", np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, tags = keys[order], tags[order]
        starts = np.flatnonzero(_first_of_runs(keys))
        sizes = np.diff(np.r_[starts, len(keys)])
        recurs = np.repeat((sizes > 1) | ((np.maximum.reduceat(tags, starts) >> np.uint32(31)) > 0), sizes)
        keys, blocks = keys[recurs], tags[recurs] & np.uint32(0x7FFFFFFF)
        order = np.lexsort((keys, blocks))
        keys, blocks = keys[order], blocks[order]
        new = _first_of_runs(blocks, keys) if len(keys) else np.zeros(0, bool)
        return pa.table(dict(zip(("block", "anchors"), _pack(blocks[new], keys[new]), strict=True)))

    return arrow_map(docs, make, "bucket int, keys binary, tags binary").groupBy("bucket").applyInArrow(meet, "block int, anchors binary")


def _digests(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return rolling(h, window, _B1), (rolling(h, window, _B2) >> _U(32)).astype(np.uint32)


def _in_order(docs: pa.Table) -> pa.Table:
    """A block's rows in an order of their own, so that a row's number means the same row whenever the block is read."""
    return docs.sort_by([("id", "ascending"), ("text", "ascending")])


def _confirmed_windows(docs: DataFrame, anchors: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """(block, places, least): for windows of two documents or more, one place in each block that has to lose it (row of the
    block << 32 | first word), and the smallest id.
    """

    def candidates(key, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        known = np.unique(_join(anchors, "anchors", np.uint64))
        out = [[], [], [], []]
        if len(known) and docs.num_rows:
            docs = _in_order(docs)
            hashes, texts, ids = WordHashes(), _words(docs["text"]), docs["id"].to_numpy()
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                h, a, doc, whole = _windows(part, hashes, window, gram)
                hit = np.flatnonzero(whole & (known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a))
                if len(hit):
                    one, two = _digests(h, window)
                    before = np.cumsum([0] + [len(d) for d in part])
                    place = (at + doc[hit]).astype(np.uint64) << _U(32) | (hit - before[doc[hit]]).astype(np.uint64)
                    for o, x in zip(out, (one[hit], two[hit], ids[at : at + 256][doc[hit]], place), strict=True):
                        o.append(x)
        one, two, who, place = (np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, (np.uint64, np.uint32, np.int64, np.uint64), strict=True))
        order = np.lexsort((place, two, one))  # rows are in the order of their ids
        one, two, who, place = one[order], two[order], who[order], place[order]
        starts = np.flatnonzero(_first_of_runs(one, two))
        last = np.r_[starts[1:], len(one)][: len(starts)] - 1
        several = who[last] != who[starts]
        one, two, who, place = one[starts], two[starts], who[starts], place[starts]
        block = np.full(len(one), key[0].as_py() if hasattr(key[0], "as_py") else key[0], np.int64)
        packed = _pack((one >> _U(20)) % _U(buckets), one, two, who, place, several.astype(np.uint8))
        columns = dict(zip(("first", "second", "who", "place", "several"), packed[1:], strict=True))
        return pa.table({"bucket": packed[0], "block": pa.array(block[: len(packed[0])].astype(np.int32)), **columns})

    def meet(table: pa.Table) -> pa.Table:
        kinds = (("first", np.uint64), ("second", np.uint32), ("who", np.int64), ("place", np.uint64), ("several", np.uint8))
        one, two, who, place, several = (_join(table, n, k) for n, k in kinds)
        block = np.repeat(table["block"].to_numpy(), [len(x) // 8 for x in table["first"].to_pylist()])
        order = np.lexsort((who, two, one))
        one, two, who, place, several, block = (x[order] for x in (one, two, who, place, several, block))
        starts = np.flatnonzero(_first_of_runs(one, two))
        sizes = np.diff(np.r_[starts, len(one)])
        last = starts + sizes - 1
        recurs = np.repeat((who[last] != who[starts]) | (np.maximum.reduceat(several, starts) > 0), sizes)
        least = np.repeat(who[starts], sizes)
        recurs &= (who > least) | (several > 0)  # a block in which only the first document holds it loses nothing
        packed = _pack(block[recurs], place[recurs], least[recurs])
        return pa.table(dict(zip(("block", "places", "least"), packed, strict=True)))

    found = docs.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(candidates, "bucket int, block int, first binary, second binary, who binary, place binary, several binary")
    return found.groupBy("bucket").applyInArrow(meet, "block int, places binary, least binary")


def passages(texts: list[list[bytes]], places: np.ndarray, least: np.ndarray, window: int) -> list[tuple[list[bytes], int]]:
    """(words, smallest id) of every stretch of consecutive places with one smallest id."""
    order = np.argsort(places, kind="stable")
    places, least = places[order], least[order]
    starts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1] + _U(1)) | (least[1:] != least[:-1])]) if len(places) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(places)][: len(starts)] - 1
    rows, firsts, lasts = (places[starts] >> _U(32)).tolist(), (places[starts] & _U(0xFFFFFFFF)).tolist(), (places[ends] & _U(0xFFFFFFFF)).tolist()
    return [(texts[r][i : j + window], n) for r, i, j, n in zip(rows, firsts, lasts, least[starts].tolist(), strict=True)]


def _agree(a: tuple, b: tuple) -> int:
    """How many entries agree, from the first on."""
    if a == b:
        return len(a)
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def cover_passages(docs: list[list[bytes]], ids: list[int], found: list[tuple[list[bytes], int]], window: int = WINDOW, shard: int = SHARD_PIECES) -> list[np.ndarray]:
    """For each document, which words are in `window` consecutive words of a passage whose smallest id is below its own."""
    size = (window + 1) // 2
    side = window - size
    numbers: dict[bytes, int] = {}  # words of passages; 0 stands for any other
    pieces: dict[tuple, dict[tuple, None]] = {}  # piece -> the words before it (nearest first), the words behind it, smallest id
    for words, least in found:
        s = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words])
        for at in range(0, len(s) - size + 1, size):
            around = s[max(0, at - side) : at][::-1], s[at + size : at + size + side], least
            pieces.setdefault(s[at : at + size], {})[around] = None
    streams = [tuple([numbers.get(w, 0) for w in d]) for d in docs]
    edges = [np.zeros(len(d) + 1, np.int32) for d in docs]
    items = iter(pieces.items())
    while part := list(itertools.islice(items, shard)):
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for piece, around in part:
            machine.add_word(piece, tuple(around))
        machine.make_automaton()
        for stream, doc, edge in zip(streams, ids, edges, strict=True):
            if len(stream) < window:
                continue
            for end, around in machine.iter(stream):
                start = end + 1 - size
                before, behind = stream[max(0, start - side) : start][::-1], stream[end + 1 : end + 1 + side]
                for left, right, least in around:
                    if least < doc:
                        i, j = _agree(left, before), _agree(right, behind)
                        if i + j + size >= window:
                            edge[start - i] += 1
                            edge[end + 1 + j] -= 1
    return [np.cumsum(e[:-1]) > 0 for e in edges]


def _clean(window: int, whole: bool):
    def clean(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        places, least = _join(confirmed, "places", np.uint64), _join(confirmed, "least", np.int64)
        ids, texts = docs["id"].to_pylist(), _words(docs["text"])
        covered = cover_passages(texts, ids, passages(texts, places, least, window), window) if len(places) else [None] * len(ids)
        return _rows(ids, texts, covered, whole)

    return clean


def _rows(ids: list, texts: list[list[bytes]], covered: list, whole: bool) -> pa.Table:
    kept = [words if gone is None or not gone.any() else list(itertools.compress(words, (~gone).tolist())) for words, gone in zip(texts, covered, strict=True)]
    joined = [b" ".join(k) for k in kept]
    columns = {
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(w) for w in texts], pa.int64()),
        "n_removed": pa.array([len(w) - len(k) for w, k in zip(texts, kept, strict=True)], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in joined], pa.string()),
    }
    return pa.table(columns | ({"kept_text": pa.array(joined, pa.binary()).cast(pa.string())} if whole else {}))


def remove_repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest_only: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per row of docs.

    Removes each word covered by a window of `window` consecutive words that also starts in a document with a smaller
    doc_id; windows are judged on the input. Words are runs of anything but ASCII white space. A null text has no words; a
    row with a null id keeps all its words and is no source for others. Rows that repeat an id are judged alike (rows of one
    id and one text lie in one block): one of them
    never removes words of the other. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    gram = min(GRAM, window)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, 2 * shuffle_partitions(spark), int(size / BLOCK_BYTES))
    rows = _blocked(docs, id_col, text_col, blocks)
    known = rows.where("id is not null")
    confirmed = _confirmed_windows(known, _recurring_anchors(known, window, gram, blocks), window, gram, blocks)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ("" if digest_only else ", kept_text string")

    def whole():
        def one(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = _words(part.column(1))
                yield from _rows(part.column(0).to_pylist(), texts, [None] * len(texts), not digest_only).to_batches()

        return one

    cleaned = known.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(_clean(window, not digest_only), schema)
    return cleaned.unionByName(arrow_map(rows.where("id is null").select("id", "text"), whole, schema))
