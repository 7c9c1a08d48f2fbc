"""Exact top-k inner products by pivot-table elimination (operator 1).

The distances of every vector to many pivots are computed once and carried as a column. For a query q and a candidate x the
triangle inequality gives |q - x| >= max over pivots |d(q, p) - d(x, p)|, hence an upper bound of the inner product. Candidates
are evaluated in the order of that bound until the k-th best score found is above the next bound: the answer is exact.
Queries and candidates are dealt into blocks of bounded size; each pair of blocks is one group, answered by one task, and the
k best of every block are merged by query. Only the pivots go through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, shuffle_partitions

PIVOTS, QUERY_BLOCK, CANDIDATE_BLOCK, FIRST_STEP = 128, 4096, 32768, 64
#: Vector lengths that get pivots, the most frequent first; vectors of other lengths are compared without.
PIVOT_LENGTHS = 16
_LONG = np.iinfo(np.int64)


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null and free of null and non-finite components."""
    whole = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


class Best:
    """The k highest scores of one query, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if len(scores):
            scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]

    def full_at(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -math.inf


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector to every pivot."""
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products, exact whatever their size; what 64 bits can't hold is their largest or smallest value."""
    if exact:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    return np.array([min(_LONG.max, max(_LONG.min, sum(a * b for a, b in zip(row, q.tolist(), strict=True)))) for row in x.tolist()], np.int64)


def search_block(queries: np.ndarray, query_ids: np.ndarray, to_pivots: np.ndarray, x: np.ndarray, ids: np.ndarray, table: np.ndarray, best: list[Best]) -> int:
    """Offer a block of candidates to every query, in bound order, with exact stopping; returns how many were evaluated.

    to_pivots and table: distances of queries and candidates to the pivots.
    """
    norms, q_norms = (x.astype(float) ** 2).sum(1), (queries.astype(float) ** 2).sum(1)
    largest = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * x.shape[1]
    exact, evaluated = largest < 2**52, 0
    # distances are rounded to 24 bits, and differences of large squares lose as much
    slack = 4e-6 * (float(table.max(initial=0)) ** 2 + float(to_pivots.max(initial=0)) ** 2 + norms.max(initial=0))
    for n, q in enumerate(queries):
        gap = np.abs(table - to_pivots[n]).max(1).astype(float) if table.shape[1] else 0.0
        bound = (q_norms[n] + norms - gap**2) / 2 + slack + 4e-6 * q_norms[n] + 1
        order, at, step = np.argsort(-bound), 0, FIRST_STEP
        order = order[ids[order] != query_ids[n]]
        while at < len(order) and bound[order[at]] >= best[n].full_at():
            part = order[at : at + step]
            best[n].add(products(x[part], q, exact), ids[part])
            at, step, evaluated = at + step, step * 2, evaluated + len(part)
    return evaluated


def with_pivot_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, d, v, to): vectors (id, v, d) as 64-bit integers, and their distances to the pivots of their length."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors of PIVOT_LENGTHS lengths

    def make():
        def one(batch: pa.RecordBatch):
            length = batch.column(2).to_numpy()
            for d in np.unique(length):
                part = batch.filter(pa.array(length == d))
                for at in range(0, part.num_rows, CANDIDATE_BLOCK):
                    rows = part.slice(at, CANDIDATE_BLOCK)
                    x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
                    p = shared.value.get(int(d))
                    to = distances(x.astype(float), p) if p is not None else np.zeros((len(x), 0), np.float32)
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in to], pa.binary())], ["id", "d", "v", "to"])

        return one

    return arrow_map(vectors.select("id", "v", "d"), make, "id long, d int, v binary, to binary")


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all rows but its own id.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id; vectors of
    another length than the query's are no candidates for it. Ties go to the smaller id; a repeated candidate row counts as
    often as it occurs; a repeated query row (same id) is asked once, with its smallest vector. No rows: no result. Other
    columns are ignored. Scores are exact; beyond the range of 64-bit integers they are its largest or smallest value.
    """

    def ready(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", quantised(F.col("v"), scale).alias("v")).where("size(v) > 0")

    spark = vectors.sparkSession
    asked = ready(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    candidates = ready(vectors).withColumn("d", F.size("v"))
    table = {}
    for r in candidates.groupBy("d").count().orderBy(F.desc("count"), "d").limit(PIVOT_LENGTHS).collect() if pivots else ():
        chosen = candidates.where(F.col("d") == r["d"]).orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect()
        table[r["d"]] = np.array([x["v"] for x in chosen], float)
    asked, candidates = cut(with_pivot_distances(asked, table)), cut(with_pivot_distances(candidates, table))
    query_blocks = math.ceil(asked.count() / QUERY_BLOCK)
    blocks = max(shuffle_partitions(spark), math.ceil(candidates.count() / CANDIDATE_BLOCK))
    if not query_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("c", each(blocks))
    # repeated ids too are spread over all blocks
    candidates = candidates.withColumn("c", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).withColumn("q", each(query_blocks))

    def matrix(column: pa.ChunkedArray, kind, rows: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)

    def answer(q: pa.Table, c: pa.Table) -> pa.Table:
        got = []
        if q.num_rows and c.num_rows:
            q_ids, ids = q["id"].to_numpy(), c["id"].to_numpy()
            best = [Best(k) for _ in q_ids]
            search_block(matrix(q["v"], np.int64, len(q_ids)), q_ids, matrix(q["to"], np.float32, len(q_ids)), matrix(c["v"], np.int64, len(ids)), ids, matrix(c["to"], np.float32, len(ids)), best)
            got = [(np.full(len(b.ids), i), b.ids, b.scores) for i, b in zip(q_ids, best, strict=True)]
        columns = zip(*got, strict=True) if got else [()] * 3
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    found = asked.groupBy("d", "q", "c").cogroup(candidates.groupBy("d", "q", "c")).applyInArrow(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
