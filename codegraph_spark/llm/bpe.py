"""Byte-level BPE with a segment tree over byte positions (operator 8).

The leaves hold, for each live token's first byte, the rank of the pair it forms with its right neighbour; every inner node
holds the smaller of its children's, so the root leads to the leftmost pair of least rank. A merge changes three leaves, each
in logarithmic time: a piece of n bytes takes n log n steps however long it is. Pieces repeat, so each task remembers them.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces a task remembers, and the longest piece it remembers.
REMEMBERED, LONGEST = 250_000, 64
_NONE = 1 << 62

def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always merge the leftmost pair of least rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length()  # n - 1 pairs
    tree = [_NONE] * (2 * size)
    tree[size : size + n - 1] = [get(piece[i : i + 2], _NONE) for i in range(n - 1)]
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    end = list(range(1, n + 1))  # of the token that begins at a byte
    back = list(range(-1, n - 1))  # first byte of the token before
    while (least := tree[1]) != _NONE:
        leaf = 1
        while leaf < size:
            leaf *= 2
            if tree[leaf] != least:
                leaf += 1
        i = leaf - size
        gone = end[i]
        stop = end[i] = end[gone]
        before = back[i]
        low = high = leaf  # the outermost leaves that change
        if stop < n:
            back[stop] = i
            tree[leaf] = get(piece[i : end[stop]], _NONE)
            high = size + gone
            tree[high] = _NONE
        else:
            tree[leaf] = _NONE
        if before >= 0:
            low = size + before
            tree[low] = get(piece[before:stop], _NONE)
        while low > 1:
            low, leaf, high = low >> 1, leaf >> 1, high >> 1
            a, b = tree[2 * low], tree[2 * low + 1]
            tree[low] = a if a < b else b
            if leaf != low:
                a, b = tree[2 * leaf], tree[2 * leaf + 1]
                tree[leaf] = a if a < b else b
            if high != leaf:
                a, b = tree[2 * high], tree[2 * high + 1]
                tree[high] = a if a < b else b
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Chunks(dict):
    """What follows a space, up to the next -> its ids.

    By the public pattern a piece begins at every space that something other than white space follows, so such chunks can be
    remembered whole. At any other space the text is read by the pattern alone.
    """

    class Open(Exception):
        """A space with white space, another space or the end behind it."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise Chunks.Open
        # most chunks are one piece
        ids = self.encoder[" " + chunk] if chunk.isalpha() else self.encoder.whole(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder(dict):
    """str piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.chunks = Chunks(self) if pattern == public_pattern() else None
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def __missing__(self, piece: str) -> bytes:
        found = merge_piece(piece.encode(), self.ranks)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.chunks is not None:
            first, *rest = text.split(" ")
            try:
                return self.whole(first) + b"".join(map(self.chunks.__getitem__, rest))
            except Chunks.Open:
                pass
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(ranks_path: str | None, pattern: str | None) -> Encoder:
    import public_tokenizers

    return Encoder(load_ranks(ranks_path or public_tokenizers.path(RANKS)), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids binary, decoded binary), one row per row of docs: little-endian 32-bit ids and what they decode to.

    Whole texts; null text like an empty one (no ids). Null and repeated ids pass through; an empty table gives no rows;
    other columns are ignored. ranks_path must name a file that every executor has.
    """
    return _map(docs, id_col, text_col, ranks_path, pattern, "doc_id long, ids binary, decoded binary", lambda ids, back: [pa.array(ids, pa.binary()), pa.array(back, pa.binary())])


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() with its buffers digested where they are made."""
    sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
    return _map(docs, id_col, text_col, ranks_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, back: [pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(back)])


def _map(docs, id_col, text_col, ranks_path, pattern, schema, finish):
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        coder = _encoder(ranks_path, pattern)

        def one(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [coder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *finish(ids, [coder.decode(x) for x in ids])], names)

        return one

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, schema)
