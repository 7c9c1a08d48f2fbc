"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 4).

Two fingerprints at most `radius` bits apart have a common value within half the radius of both. So a fingerprint emits
its whole ball of half the radius (2,081 values for two of 64 bits), the balls are shuffled on the value, and all that meet
on a value are within the radius of each other by construction.

1. Fingerprints that share an exact half are linked to the smallest one there if that is within the radius; components
   of these links are labels. A large group of near copies gets few labels.
2. Only fingerprints that can meet another label emit their ball. Of three parts of a linked pair one holds a third of the
   differing bits, so the two share a value within one bit of the other two parts (42 or 43 bits, 130 values a fingerprint).
   Chance meetings on so many bits stay rare: about 1 in 200 fingerprints at ten million of them.
3. Balls carry labels. A value on which several labels meet links one member of each, and a bucket returns each pair of
   labels once: the links grow with labels and buckets, not with the square of a group. A label is carried as 32 bits of
   its hash; two labels that meet are taken for one with a chance of 2^-32.

Values travel packed: a row holds the values of one bucket of one small batch. The number of buckets follows the counted
fingerprints, so that a bucket's size is about the same at any size of the table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, cut, join_hot, narrow, shuffle_partitions

SHINGLE, RADIUS = 4, 4
#: Values that a bucket holds (about), and fewest buckets.
BUCKET_VALUES, LEAST_BUCKETS = 1_000_000, 128
#: Rows of other tables that a fingerprint weighs as much as when its 130 values are emitted.
VARIANT_ROWS = 20
_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles, repeats included; no words: zero."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        grams = [b" ".join(words[i : i + shingle]) for i in range(at, min(n, at + (1 << 16)))]
        a = np.fromiter((h(g, 42) for g in grams), np.uint64, len(grams))
        votes += np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row: whole texts, null text like an empty one."""

    def make():
        def one(batch: pa.RecordBatch):
            fps = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

        return one

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of at most `radius` of `bits` bits, the empty mask first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)], np.uint64)


def _bucket(v: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (v ^ (v >> _U(32))) * _U(0x9E3779B97F4A7C15)
        v = (v ^ (v >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return ((v >> _U(33)) % _U(n)).astype(np.int32)


def _packed(values: np.ndarray, buckets: int, *more: np.ndarray):
    """Columns (bucket, values, *more) of a batch."""
    b = _bucket(values, buckets)
    order = np.argsort(b, kind="stable")
    b, columns = b[order], [c[order] for c in (values, *more)]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, int)
    return [pa.array(b[cuts[:-1]])] + [pa.array([c[i:j].tobytes() for i, j in itertools.pairwise(cuts)], pa.binary()) for c in columns]


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _mixed_runs(keys: np.ndarray, labels: np.ndarray):
    """Order that sorts by key and label, start of the run of each place, and whether its run has several labels."""
    order = np.lexsort((labels, keys))
    k, lab = keys[order], labels[order]
    new = np.r_[True, k[1:] != k[:-1]][: len(k)]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(k)])
    return order, np.repeat(starts, sizes), np.repeat(lab[starts] != lab[starts + sizes - 1], sizes)


def _label_hash(labels: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (labels ^ (labels >> _U(31))) * _U(0xD6E8FEB86659FD93)
        return ((v ^ (v >> _U(29))) * _U(0x9E3779B97F4A7C15) >> _U(32)).astype(np.uint32)


def half_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (src, dst) of fingerprints within the radius that share an exact half, each to the smallest with that half."""
    fp = F.col("fp")
    halves = F.array(*[F.struct(F.lit(n).alias("half"), v.alias("bits")) for n, v in ((0, fp.bitwiseAND(F.lit(0xFFFFFFFF))), (1, F.shiftrightunsigned(fp, 32)))])
    cutup = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.bits")
    least = cutup.groupBy("half", "bits").agg(F.min("fp").alias("src"), F.max("fp").alias("last")).where("src < last").drop("last")
    met = cutup.join(least, ["half", "bits"]).where("fp <> src").where(F.bit_count(fp.bitwiseXOR(F.col("src"))) <= radius)
    return met.select("src", F.col("fp").alias("dst")).distinct()


#: The three parts of a fingerprint: first bit and bits.
_PARTS = ((0, 21), (21, 21), (42, 22))


def _kept_masks(first: int, bits: int) -> np.ndarray:
    """Masks of at most one bit outside a part."""
    return np.array([0] + [1 << b for b in range(64) if not first <= b < first + bits], np.uint64)


def with_possible_partner(fps: DataFrame, buckets: int) -> DataFrame:
    """Rows of fps (fp, label) that meet another label within two bits on two of three parts; no other has one within four."""

    def make():
        def one(batch: pa.RecordBatch):
            fp, label = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                x, lab = fp[at : at + 4096], _label_hash(label[at : at + 4096])
                for n, (first, bits) in enumerate(_PARTS):
                    masks, inside = _kept_masks(first, bits), _U((1 << bits) - 1)
                    keys = (x & ~(inside << _U(first)))[:, None] ^ masks
                    # the part left out and the mask's number give the fingerprint back
                    rest = (((x >> _U(first)) & inside) << _U(6)).astype(np.uint32)[:, None] + np.arange(len(masks), dtype=np.uint32)
                    b, *packed = _packed(keys.ravel(), buckets, rest.ravel(), np.repeat(lab, len(masks)))
                    yield pa.RecordBatch.from_arrays([pa.array(b.to_numpy() * 3 + n, pa.int32()), *packed], ["bucket", "keys", "rest", "labels"])

        return one

    def meet(table: pa.Table) -> pa.Table:
        first, bits = _PARTS[table["bucket"][0].as_py() % 3] if table.num_rows else _PARTS[0]
        keys, rest, labels = _column(table, "keys", np.uint64), _column(table, "rest", np.uint32), _column(table, "labels", np.uint32)
        order, _, mixed = _mixed_runs(keys, labels)
        at = order[mixed]
        fp = (keys[at] ^ _kept_masks(first, bits)[rest[at] & np.uint32(63)]) | (rest[at] >> np.uint32(6)).astype(np.uint64) << _U(first)
        return pa.table({"fp": pa.array(np.unique(fp).view(np.int64))})

    packed = arrow_map(fps.select("fp", "label"), make, "bucket int, keys binary, rest binary, labels binary")
    return fps.join(packed.groupBy("bucket").applyInArrow(meet, "fp long").distinct(), "fp", "left_semi")


def label_links(fps: DataFrame, radius: int, buckets: int) -> DataFrame:
    """Links (src, dst) between labels of fps (fp, label) whose balls of half the radius meet."""
    masks = ball(64, radius // 2)

    def make():
        tags = np.arange(len(masks), dtype=np.uint16)

        def one(batch: pa.RecordBatch):
            fp, label = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 512):
                x, lab = fp[at : at + 512], _label_hash(label[at : at + 512])
                yield pa.RecordBatch.from_arrays(_packed((x[:, None] ^ masks).ravel(), buckets, np.tile(tags, len(x)), np.repeat(lab, len(masks))), ["bucket", "keys", "tags", "labels"])

        return one

    def meet(table: pa.Table) -> pa.Table:
        keys, labels = _column(table, "keys", np.uint64), _column(table, "labels", np.uint32)
        order, first, mixed = _mixed_runs(keys, labels)
        fp, labels = (keys ^ masks[_column(table, "tags", np.uint16)])[order], labels[order]
        src, dst, a, b = fp[first[mixed]], fp[mixed], labels[first[mixed]], labels[mixed]
        _, once = np.unique(a.astype(np.uint64) << _U(32) | b, return_index=True)
        once = once[a[once] != b[once]]
        return pa.table({"src": pa.array(src[once].view(np.int64)), "dst": pa.array(dst[once].view(np.int64))})

    packed = arrow_map(fps.select("fp", "label"), make, "bucket int, keys binary, tags binary, labels binary")
    return packed.groupBy("bucket").applyInArrow(meet, "src long, dst long").distinct()


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (src, dst) of distinct, non-null fingerprints (column fp): whatever is within the radius (2 or 4) is connected
    through them, and every link is within it. Null fingerprints and repeated rows are ignored; an empty table gives none.
    """
    if radius not in (2, 4):
        raise ValueError("a radius of 2 or 4 bits")
    parts = shuffle_partitions(fps.sparkSession)
    fps = cut(fps.where("fp is not null").select("fp").distinct().repartition(parts, "fp"))
    n = fps.count()
    links = cut(narrow(half_links(narrow(fps, n), radius), n))
    labels = connected_components(links).select(F.col("node").alias("fp"), "component")
    labelled = narrow(fps, n).join(narrow(labels, n), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))
    named = cut(narrow(labelled, n * VARIANT_ROWS))

    def buckets(rows: int, values: int) -> int:
        return max(LEAST_BUCKETS, rows * values // BUCKET_VALUES)

    open_ = cut(with_possible_partner(named, buckets(n, 44)).repartition(parts, "fp"))
    n_open = open_.count()
    # by number, so that the balls are emitted by as many tasks as they are worth
    return links.union(label_links(narrow(open_, n_open * 5 * VARIANT_ROWS), radius, buckets(n_open, 2081)))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    Documents link when their fingerprints differ in at most `radius` bits (2 or 4); component_id is the smallest
    doc_id reachable. Null or empty texts have fingerprint zero and link like any other. Rows with a null id keep their
    fingerprint and take the component of those that share it. Repeated rows give repeated results; an empty table gives
    none; other columns are ignored. Copies meet on their fingerprint before anything is compared.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(near_links(distinct.select("fp"), radius))
    named = cut(distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut(join_hot(named, smallest, "component").select("fp", "component_id"))
    return join_hot(prints, known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
