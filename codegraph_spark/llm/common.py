"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that carries the row's identity through an operator; never clashes with a user's column.
ROW_DOC, ROW_HASH = "__cg_doc", "__cg_row"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; a private one only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cg-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so a lost executor costs only its own tasks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a task of a small table takes at least.
TASK_ROWS = 50_000


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as its counted rows are worth; a table of many rows keeps its own. Loops over small tables
    then write few files a round, however many partitions shuffles have."""
    return df.coalesce(max(1, min(shuffle_partitions(df.sparkSession), -(-rows // TASK_ROWS))))


def row_identity(doc: Column, text: Column) -> list[Column]:
    """Two never-null columns that identify a document row, also when ids are null or repeated."""
    return [F.coalesce(doc.cast("long"), F.lit(-(2**63))).alias(ROW_DOC), F.xxhash64(doc, text).alias(ROW_HASH)]


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = 200_000, seed: int = 42):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every n consecutive entries, mixed so that its order is unlike the entries' own."""
    if len(h) < n:
        return h[:0]
    with np.errstate(over="ignore"):
        out, power = np.zeros(len(h) - n + 1, np.uint64), np.uint64(1)
        for j in range(n - 1, -1, -1):
            out += h[j : j + len(out)] * power
            power *= np.uint64(base)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries, by doubling."""
    if len(h) < w:
        return h[:0]
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def join_hot(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left join right on key (inner), where right has one row a key at most and left is cheap to read again.

    Keys that hold more than one in `share` rows of left can be no more than `share`: their rows of right are broadcast, so
    that a hot key needs no shuffle; all other keys are joined as usual.
    """
    hot = left.groupBy(key).agg(F.count("*").alias("__cg_n")).where(F.col("__cg_n") > left.count() / share).where(F.col(key).isNotNull())
    hot = [r[0] for r in hot.select(key).collect()]
    if not hot:
        return left.join(right, key)
    named = F.col(key).isin(hot)
    cold = left.where(F.coalesce(~named, F.lit(True))).join(right.where(F.coalesce(~named, F.lit(True))), key)
    return left.where(named).join(F.broadcast(right.where(named)), key).unionByName(cold)


def join_split(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """left join right on keys (inner or left), where right has one row a key at most and left is cheap to read again.

    Keys that hold more than one in `share` rows of left are at most `share`: these keys, and their rows of right, are
    broadcast, so a key of any number of rows is joined where its rows lie; all other keys are joined as usual.
    """
    total = left.count()
    hot = cut(left.groupBy(*keys).agg(F.count("*").alias("__cg_n")).where(F.col("__cg_n") * share > total).select(*keys))
    if not total or hot.isEmpty():
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return left.join(hot, keys, "left_semi").join(few, keys, how).unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: make() builds the batch function once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            yield from one(batch)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Alternates large-star and small-star: each step is a partial-aggregated minimum and one join, so a hub with
    millions of edges never has to fit one group. Each step is checkpointed; the driver sees one count and checksum.
    Null ends and self loops are ignored; no edges give no rows.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = mark(e)
    while before[0]:
        n = before[0]
        e = narrow(e, n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = narrow(both.groupBy("u").agg(F.min("v").alias("m")), n).select("u", F.least("u", "m").alias("m"))
        e = narrow(both.where("v > u").join(low, "u"), n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = narrow(e.distinct(), n)
        low = narrow(e.groupBy("u").agg(F.min("v").alias("m")), n)
        e = narrow(e.join(low, "u"), n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(narrow(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), n))
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
