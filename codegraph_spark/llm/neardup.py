"""SimHash near copies at a Jaccard similarity of 0.8 of five-word shingles, for the pipeline's near-copy stage (operator 4).

A text's node is its set of shingle hashes; its SimHash is taken over that set, and the balls of operator 4 find what is
within 4 of 64 bits. That is not enough: at a similarity of 0.8 two SimHashes differ in 9.7 bits on average, within 4 bits are
3 in 100 pairs, and balls of half of 14 bits would hold 7e8 values. So 24 bands of 6 MinHash values add candidates: a pair
of similarity 0.8 shares no band with a chance of 0.07 %. Every candidate of either kind is verified on the whole sets. In a
bucket each node first meets the one that meets most nodes in all its buckets (what a group was copied from meets more of its
members than they each other); where a bucket still holds several components, each node meets its next
neighbours in an order of the bucket's own and the node with most verified links, until no more links appear. What a bucket
still holds in several components then is joined exactly, by what each set and that of the first node don't share (see
other_components): nodes that each differ from it in their own way make no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_DOC, ROW_HASH, WordHashes, arrow_map, connected_components, cut, join_hot, narrow, rolling
from .simhash import _LOWER, near_links

SHINGLE, BANDS, ROWS, NEIGHBOURS = 5, 24, 6, 4
#: Similarity of near copies, as numerator and denominator.
LEAST = (4, 5)
#: Rows of other tables that a set of shingles, and a row of sketches, weighs as much as.
SET_ROWS, SKETCH_ROWS = 50, 5
#: Counted nodes of at most this many are broadcast, more are shuffled.
BROADCAST_ROWS = 1_000_000
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(0, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased (A-Z) shingles; a text of fewer words is one shingle, without words none."""
    h = hashes.of((text or b"").translate(_LOWER).split())
    return np.unique(rolling(h, min(n, len(h)), 0x9E3779B97F4A7C15 | 1)) if len(h) else h


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash per band of MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            least = np.minimum(least, (shingles[at : at + 512, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
        key = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
        return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64)


def simhash(shingles: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes; of none: zero."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(shingles), bitorder="little").view(np.uint64)[0])


def sketches(rows: DataFrame, text_col: str) -> DataFrame:
    """The identity of each row, its node, SimHash and bands."""

    def make():
        hashes = WordHashes()

        def one(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t, hashes) for t in part.column(2).cast(pa.binary()).to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
                fps = np.array([simhash(x) for x in sets], np.uint64).view(np.int64)
                found = pa.array([bands(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(nodes), pa.array(fps), found], [ROW_DOC, ROW_HASH, "node", "fp", "bands"])

        return one

    return arrow_map(rows.select(ROW_DOC, ROW_HASH, F.col(text_col).cast("string")), make, f"{ROW_DOC} long, {ROW_HASH} long, node long, fp long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, s): the shingle sets of texts (node, text)."""

    def make():
        hashes = WordHashes()

        def one(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t, hashes).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

        return one

    return arrow_map(texts, make, "node long, s array<long>")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def other_components(met: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(src, dst): of all pairs of nodes of one group and different components those that may link; every pair that does is among them.

    met(first, node, component): the nodes of the buckets of one first, each compared with it before; sets(node, s); rows: those of met.
    Only what a set and first's don't share is compared, D(x): x and y link if 9 * (|D(x)| + |D(y)| - 2 * |D(x) & D(y)|) <= |x| + |y|.
    Of nodes of two components one, x, does not link to first. So they share (9 * |D(x)| - |x| - |first|) / 10 of
    D(x) or more, and more than none: x is looked up by its rarest shingles of D(x), all but that number less one. A shingle that one
    component alone holds can't be shared, so what x and y can share at most is known before they meet.
    """
    some = lambda df, each=SET_ROWS: narrow(df, rows * each)
    home = some(met.where("node = first").select("first", F.col("component").alias("home"))).join(sets.select(F.col("node").alias("first"), F.col("s").alias("sf")), "first")
    apart = join_hot(met.where("node <> first"), cut(narrow(home, rows)), "first").join(sets, "node")
    apart = apart.select("first", "node", "component", (F.col("component") != F.col("home")).alias("away"), F.size("s").alias("size"), F.size("sf").alias("size_first"), F.concat(F.array_except("s", "sf"), F.array_except("sf", "s")).alias("d"))
    apart = cut(some(apart))
    held = apart.select("first", "node", "component", F.explode("d").alias("t"))
    mixed = some(held.groupBy("first", "t").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a < b")).select("first", "t", "n")
    shared = some(some(held.select("first", "node", "t").join(mixed, ["first", "t"])).groupBy("first", "node").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x")))
    need, can = LEAST[0] + LEAST[1], F.size("x")
    least = F.greatest(F.lit(1), F.ceil((need * F.size("d") - F.col("size") - F.col("size_first")) / (need + 1)))
    known = some(apart.join(shared, ["first", "node"])).select(
        "first", "node", "component", "away", "x", least.cast("int").alias("least"),
        (need * F.size("d") - F.col("size")).alias("need"), (2 * need * can - need * F.size("d") + F.col("size")).alias("gain"),
    )
    known = cut(known)
    ends = lambda df, n, x: df.select("first", F.explode(x).alias("x"), *[F.col(c).alias(c + n) for c in ("node", "component", "need", "gain")]).withColumn("t", F.col("x.t")).drop("x")
    left = ends(known.where(F.col("away") & (can >= F.col("least"))), "1", F.slice("x", F.lit(1), can - F.col("least") + 1))
    found = left.join(ends(known, "2", F.col("x")), ["first", "t"]).where("node1 <> node2 and component1 <> component2 and need1 <= gain2 and need2 <= gain1")
    return some(found.select(F.least("node1", "node2").alias("src"), F.greatest("node1", "node2").alias("dst")).distinct())


def near_copy_components(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(ROW_DOC, ROW_HASH, component), one row per row of rows, which carries these two columns of row_identity.

    Texts link when the Jaccard similarity of their shingle sets is 0.8 or more; a component holds what links connect. Null
    texts and texts without words are one component.
    """
    prints = cut(sketches(rows, text_col))
    n = prints.count()
    prints = narrow(prints, n * SKETCH_ROWS)
    nodes = cut(narrow(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), n * SKETCH_ROWS))
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    shared = narrow(buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), n)
    buckets = cut(narrow(buckets.join(shared, "band"), n * SKETCH_ROWS))
    # what a group's members were copied from meets more of them than they each other: it is compared first
    n_buckets = buckets.count()
    some = lambda df: narrow(df, n_buckets)
    buckets = some(buckets)
    meets = some(buckets.groupBy("node").agg(F.sum("size").alias("meets")))
    first = some(some(buckets.join(meets, "node")).groupBy("band").agg(F.max(F.struct("meets", "node")).alias("x"))).select("band", F.col("x.node").alias("first"))
    buckets = cut(some(buckets.join(first, "band").select("band", "node", "first")))

    # SimHashes within four bits, each stood for by the smallest node that has it
    stands = cut(narrow(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), n))
    equal = join_hot(nodes.select("fp", "node"), stands.where("first < last"), "fp").where("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    near = narrow(near_links(stands.select("fp")), n)
    for end in ("src", "dst"):
        near = narrow(near, n).join(stands.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    balls = cut(equal.union(near.select(F.least("src_node", "dst_node"), F.greatest("src_node", "dst_node"))))

    met = cut(some(buckets.select("node").union(balls.select("src")).union(balls.select("dst")).distinct()))
    n_met = met.count()
    # equal nodes have equal sets: one text of each is read again
    one = prints.join(_small(met, n_met), "node").groupBy("node").agg(F.min(F.struct(ROW_DOC, ROW_HASH)).alias("row")).select("node", F.col(f"row.{ROW_DOC}").alias("doc"), F.col(f"row.{ROW_HASH}").alias("hash"))
    own = F.col(ROW_DOC).eqNullSafe(F.col("doc")) & (F.col(ROW_HASH) == F.col("hash"))
    texts = rows.select(ROW_DOC, ROW_HASH, F.col(text_col).cast("string").alias("text"))
    sets = shingle_sets(texts.join(_small(one, n_met), own).select("node", "text"))
    sets = cut(sets.groupBy("node").agg(F.first("s").alias("s")))

    def verified(pairs: DataFrame, n: int) -> DataFrame:
        a, b = sets.select(F.col("node").alias("src"), F.col("s").alias("sa")), sets.select(F.col("node").alias("dst"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        near = both * (LEAST[0] + LEAST[1]) >= (F.size("sa") + F.size("sb")) * LEAST[0]  # both / (a + b - both) >= 4 / 5
        return narrow(narrow(pairs.join(a, "src"), n).join(b, "dst").where(near).select("src", "dst"), n)

    sets = narrow(sets, n_met * SET_ROWS)
    pairs = cut(some(buckets.where("node <> first").select(F.least("first", "node").alias("src"), F.greatest("first", "node").alias("dst")).union(balls).distinct()))
    links = cut(verified(pairs, pairs.count() * SET_ROWS))
    groups = some(connected_components(links))
    tried = None
    while n_met:
        named = some(buckets.select("band", "node").join(groups, "node", "left")).withColumn("component", F.coalesce("component", "node"))
        mixed = some(named.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("band"))
        degrees = some(links.select(F.col("src").alias("node")).union(links.select("dst")).groupBy("node").agg(F.count("*").alias("degree")))
        open_ = cut(some(some(named.join(mixed, "band")).join(degrees, "node", "left")))
        best = some(open_.groupBy("band").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "node", "component")).alias("best")))
        order = Window.partitionBy("band").orderBy(F.xxhash64("band", "node"))
        near = open_.withColumn("next", F.array(*[F.lead(F.struct("node", "component"), k).over(order) for k in range(1, NEIGHBOURS + 1)])).select("node", "component", F.explode("next").alias("x"))
        near = some(near).union(some(open_.join(best, "band")).select("node", "component", F.struct("best.node", "best.component")))
        pairs = some(near.where("x.node is not null and component <> x.component").select(F.least("node", "x.node").alias("src"), F.greatest("node", "x.node").alias("dst")).distinct())
        pairs = cut(pairs if tried is None else some(pairs.join(tried, ["src", "dst"], "left_anti")))
        n_pairs = pairs.count()
        more = cut(verified(pairs, n_pairs * SET_ROWS)) if n_pairs else pairs
        if more.isEmpty():
            # chosen pairs link no more: the rest is joined exactly
            tried = pairs if tried is None else tried.union(pairs)
            met = cut(some(open_.join(buckets, ["band", "node"]).select("first", "node", "component").distinct()))
            rest = cut(other_components(met, sets, met.count()).join(tried, ["src", "dst"], "left_anti"))
            n_rest = rest.count()
            if n_rest:
                links = links.union(cut(verified(rest, n_rest * SET_ROWS)))
                groups = some(connected_components(links))
            break
        tried = pairs if tried is None else tried.union(pairs)
        links = links.union(more)
        groups = some(connected_components(links))
    named = narrow(narrow(nodes.select("node"), n).join(groups, "node", "left"), n).select("node", F.coalesce("component", "node").alias("component"))
    return join_hot(prints.select(ROW_DOC, ROW_HASH, "node"), cut(named), "node").select(ROW_DOC, ROW_HASH, "component")
