"""Alignment of two tokenizers' ids over a corpus, with an identity map as the fast path (operator 12).

Both tokenizers cut the same bytes. Where a token of A and a token of B end together, a group ends. A group of one A token and
the one B id that the identity map (A id -> B id of the same bytes) names is counted in a vector as long as A's vocabulary;
only links of other groups are counted as pairs, which are added up a task before they are shuffled.

1. Every row is encoded once; its row of the table in between holds its digest, its identity ids and its other pairs, each with
   its number of links.
2. Pairs are counted by documents: vectors and pre-added pairs of each task, summed by pair.
3. Every row looks up the counts of its own links: in a broadcast table while the counted pairs are few, by a join beyond.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, join_split

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast: 17 bytes each in every Python worker.
BROADCAST_PAIRS = 2_000_000
#: Chunks of text a task remembers, the longest one it remembers, and characters aligned at a time.
REMEMBERED, LONGEST, AT_ONCE = 250_000, 64, 2_000_000
#: Chunks that are encoded together when they are first seen.
TOGETHER = 2_000
#: Pairs a task adds up before it passes them on.
HELD_PAIRS = 1_000_000
_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens and the identity map."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task is one thread
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path or public_tokenizers.path(A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_FILE))
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            self.a_bytes[n] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace(_MARK, " ").encode() for n, p in enumerate(pieces)]
        first = {x: n for n, x in reversed(list(enumerate(self.b_bytes))) if not (self.b.is_control(n) or self.b.is_unknown(n))}
        self.same = np.array([first.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # no piece of B goes on after a space: what stands between single spaces is encoded by itself
        self.by_chunk = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.known_a: dict[str, bytes | None] = {}
        self.known_b: dict[str, bytes | None] = {}
        # ids as text with what follows them, padded with zero bytes
        written = lambda size, end: np.array([b"%d%b" % (n, end) for n in range(size)])
        self.a_text, self.a_last = (written(len(self.a_bytes), end) for end in (b",", b"|"))
        self.b_text, self.b_last = (written(len(self.b_bytes), end) for end in (b",", b";"))

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        """Little-endian 32-bit ids of space + text by both tokenizers; none where the tokens of one don't spell it."""
        a, b = (np.array(x, "<u4") for x in (self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)))
        want = b" " + text.encode()
        spelt = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want == b"".join(map(self.b_bytes.__getitem__, b.tolist()))
        return (a.tobytes(), b.tobytes()) if text and spelt else (b"", b"")

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks, encoded together; a chunk that isn't spelt as it stands is left to _whole()."""
        ids = [np.frombuffer(x, "<u4") for x in self._whole(" ".join(chunks))]
        if not len(ids[0]):
            if len(chunks) == 1:
                self.known_a[chunks[0]] = self.known_b[chunks[0]] = None
            else:
                half = len(chunks) // 2
                self._learn(chunks[:half])
                self._learn(chunks[half:])
            return
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        for known, x, lengths in ((self.known_a, ids[0], self.a_len), (self.known_b, ids[1], self.b_len)):
            data, at = x.tobytes(), 0
            for chunk, end in zip(chunks, (4 * np.searchsorted(np.cumsum(lengths[x]), ends) + 4).tolist(), strict=True):
                known[chunk] = data[at:end]
                at = end

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """By both tokenizers' rules a token never spans the space between two chunks, so chunks are remembered with their ids.
        Texts where white space follows a space, ends the text or begins it, or that hold B's space mark, are encoded whole."""
        if not self.by_chunk:
            return [self._whole(t) for t in texts]
        split = [t.split(" ") for t in texts]
        fresh = set().union(*split) - self.known_a.keys()
        if len(self.known_a) + len(fresh) > REMEMBERED:
            self.known_a.clear()
            self.known_b.clear()
            fresh = set().union(*split)
        odd = {c for c in fresh if not c or c[0].isspace() or _MARK in c}
        self.known_a.update(dict.fromkeys(odd))
        self.known_b.update(dict.fromkeys(odd))
        regular = list(fresh - odd)
        for at in range(0, len(regular), TOGETHER):
            self._learn(regular[at : at + TOGETHER])
        out = []
        for text, chunks in zip(texts, split, strict=True):
            try:
                out.append((b"".join(map(self.known_a.__getitem__, chunks)), b"".join(map(self.known_b.__getitem__, chunks))))
            except TypeError:  # an odd chunk
                out.append(self._whole(text))
        for c in fresh:
            if len(c) > LONGEST:
                del self.known_a[c], self.known_b[c]
        return out

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, identity ids and links, other pairs and links) of each text."""
        coded = self.encode(texts)
        a, b = (np.frombuffer(b"".join([x[k] for x in coded]), "<u4").astype(np.int64) for k in (0, 1))
        a_of, b_of = (np.cumsum([0, *[len(x[k]) // 4 for x in coded]]) for k in (0, 1))  # of each text's tokens
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_both, b_both = _among(a_end, b_end), _among(b_end, a_end)
        # where any token ends: as many links as stretches between
        every = np.sort(np.concatenate([a_end, b_end[~b_both]]), kind="stable")
        a_at, b_at = np.searchsorted(a_end, every), np.searchsorted(b_end, every)
        a_group, b_group = np.cumsum(a_both) - a_both, np.cumsum(b_both) - b_both
        n_groups = int(a_both.sum())
        a_in, b_in = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        of_a, of_b = a[a_at], b[b_at]
        exact = (a_in == 1)[a_group[a_at]] & (b_in == 1)[a_group[a_at]] & (self.same[of_a] == of_b) if len(every) else np.zeros(0, bool)

        written = np.empty(len(a) + len(b), max(self.a_text.dtype, self.b_text.dtype))
        written[np.arange(len(a)) + np.r_[0, np.cumsum(b_in)][a_group]] = np.where(a_both, self.a_last[a], self.a_text[a])
        written[np.arange(len(b)) + np.cumsum(a_in)[b_group]] = np.where(b_both, self.b_last[b], self.b_text[b])

        row = np.searchsorted(a_of, a_at, "right") - 1  # the text of each link
        same_ids, same_of, same_n = _tally(row[exact], of_a[exact], len(texts))
        pairs, pairs_of, pairs_n = _tally(row[~exact], of_a[~exact] * len(self.b_bytes) + of_b[~exact], len(texts))
        groups, links = np.r_[0, np.cumsum(a_both)][a_of], np.searchsorted(row, np.arange(len(texts) + 1))
        out = []
        for n in range(len(texts)):
            n_a, n_b = int(a_of[n + 1] - a_of[n]), int(b_of[n + 1] - b_of[n])
            sha = hashlib.sha256(written[a_of[n] + b_of[n] : a_of[n + 1] + b_of[n + 1]].tobytes().replace(b"\0", b"")[:-1]).hexdigest() if n_a else ""
            s, p = slice(same_of[n], same_of[n + 1]), slice(pairs_of[n], pairs_of[n + 1])
            out.append((n_a, n_b, int(groups[n + 1] - groups[n]), int(links[n + 1] - links[n]), sha, _pack(same_ids[s], same_n[s]), _pack(pairs[p], pairs_n[p])))
        return out


@cache
def pair(a_path: str | None, b_path: str | None) -> Pair:
    """Read once by a Python worker, which answers many tasks."""
    return Pair(a_path, b_path)


def _among(these: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array are in another."""
    if not len(those):
        return np.zeros(len(these), bool)
    return those[np.minimum(np.searchsorted(those, these), len(those) - 1)] == these


def _tally(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys of each row in order, where each row's begin and end, how often each occurs); keys are below 2^32."""
    found, n = np.unique((row << 32) | key, return_counts=True)
    return found & 0xFFFFFFFF, np.searchsorted(found >> 32, np.arange(rows + 1)), n


def _pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    return np.concatenate([keys, n]).astype("<u4").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, "<u4").astype(np.int64).reshape(2, -1)
    return both[0], both[1]


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, same binary, pairs binary), one row per row of docs.

    same: ids of A in identity groups, then their links; pairs: A id times B's vocabulary size plus B id, then their links; all
    little-endian 32-bit integers. Null and empty texts, and texts whose tokens don't spell space + text, have no tokens: zeros,
    an empty groups_sha256. Null and repeated ids pass through; other columns are ignored; an empty table gives no rows.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "pairs"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def make():
        both = pair(a_path, b_path)

        def one(batch: pa.RecordBatch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                    size, end = size + len(texts[end]), end + 1
                found = zip(*both.align(texts[at:end]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], names)
                at = end

        return one

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, pairs binary")


def pair_counts(aligned: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(a, b, n_docs): how many rows of aligned hold each id pair linked."""

    def run(batches):
        both = pair(a_path, b_path)
        width, vector = len(both.b_bytes), np.zeros(len(both.a_bytes), np.int64)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(key: np.ndarray, n: np.ndarray):
            for at in range(0, len(key), 100_000):
                part = key[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part // width), pa.array(part % width), pa.array(n[at : at + 100_000])], ["a", "b", "n_docs"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, found = batch.slice(at, 1000), []
                for same, pairs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids, key = _unpack(same)[0], _unpack(pairs)[0]
                    vector[ids] += 1
                    again = both.same[key // width] == key % width  # an identity pair that other groups link too
                    if again.any():
                        key = key[~(again & np.isin(key // width, ids))]
                    found.append(key)
                fresh, n = np.unique(np.concatenate(found), return_counts=True)
                keys, back = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > HELD_PAIRS:
                    yield from rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from rows(keys, counts)
        ids = np.flatnonzero(vector)
        yield from rows(ids * width + both.same[ids], vector[ids])

    partial = aligned.select("same", "pairs").mapInArrow(run, "a long, b long, n_docs long")
    return partial.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))


def _links(aligned: DataFrame, a_path: str | None, b_path: str | None) -> DataFrame:
    """(row, a, b, links) of every row's distinct pairs."""

    def make():
        both = pair(a_path, b_path)
        width = len(both.b_bytes)

        def one(batch: pa.RecordBatch):
            for row, same, pairs in zip(*[batch.column(n).to_pylist() for n in range(3)], strict=True):
                (ids, n), (key, m) = _unpack(same), _unpack(pairs)
                a, b = np.concatenate([ids, key // width]), np.concatenate([both.same[ids], key % width])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row)), pa.array(a), pa.array(b), pa.array(np.concatenate([n, m]))], ["row", "a", "b", "links"])

        return one

    return arrow_map(aligned.select("row", "same", "pairs"), make, "row long, a long, b long, links long")


def align_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """align_documents() with n_best and count_sum in place of the links: links whose pair is in as many rows as any pair of
    its A id (ties included), and the sum of those row counts over all links.

    Repeated rows are rows of their own and count as often. broadcast_pairs bounds what is broadcast and changes no result.
    """
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    aligned = cut(align_documents(docs, id_col, text_col, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(aligned, a_path, b_path))
    if counts.count() > broadcast_pairs:
        most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row an id of A: as many as its vocabulary
        rated = cut(counts.join(F.broadcast(most), "a").withColumn("best", F.col("n_docs") == F.col("most")).drop("most"))
        links = join_split(_links(aligned, a_path, b_path), rated, ["a", "b"])
        sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best"), F.sum(F.col("links") * F.col("n_docs")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        return aligned.join(sums, "row", "left").withColumns({x: F.coalesce(x, zero) for x in ("n_best", "count_sum")}).select(out)

    table = counts.toArrow()
    a, b, n = (table[c].to_numpy() for c in ("a", "b", "n_docs"))
    most = np.zeros(int(a.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, a, n)
    order = np.lexsort((b, a))
    known = docs.sparkSession.sparkContext.broadcast((a[order], b[order], n[order], (n == most[a])[order]))

    def make():
        both = pair(a_path, b_path)
        width = len(both.b_bytes)
        a, b, n, best = known.value
        keys = a * width + b

        def one(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n_best, total = [], []
                for same, pairs in zip(part.column("same").to_pylist(), part.column("pairs").to_pylist(), strict=True):
                    (ids, m), (key, k) = _unpack(same), _unpack(pairs)
                    place = np.searchsorted(keys, np.concatenate([ids * width + both.same[ids], key]))
                    links = np.concatenate([m, k])
                    n_best.append(int(links[best[place]].sum()))
                    total.append(int((links * n[place]).sum()))
                found = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
                yield pa.RecordBatch.from_arrays([found[c] if c in found else part.column(c) for c in out], out)

        return one

    return arrow_map(aligned.drop("row"), make, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
