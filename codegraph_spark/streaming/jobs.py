"""Streams of files and of graph documents. Each micro-batch overwrites a folder of its own, so a batch that runs again after a
failure leaves the same rows; results equal those of the batch operators over all that has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import documents as D
from ..plans.jobs import FINDING, scan_sources
from ..sources.files import fragment_nodes


def _by_batch(df: DataFrame, path: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def stream_scan(files: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Scan new files (repo, path, lang, content) as they arrive; findings are in path/findings. Call start() on the result."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: _by_batch(scan_sources(df).select(FINDING), path, "findings", batch))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/findings").drop("batch")


def stream_merge_graph(docs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Fold graph documents (repo, seq, body text) into logs of nodes, edges and clears below path.

    A document {"clear": true} starts its repo anew; what doesn't parse is skipped.
    """

    def fold(df: DataFrame, batch: int) -> None:
        parsed = df.select("repo", "seq", F.try_parse_json("body").alias("doc")).where("doc is not null")
        _by_batch(fragment_nodes(parsed), path, "nodes", batch)
        _by_batch(D.edge_rows(parsed), path, "edges", batch)
        _by_batch(parsed.where(F.try_variant_get("doc", "$.clear", "boolean")).select("repo", "seq"), path, "clears", batch)

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)


def read_merged_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) merged from the logs, from each repo's last clear on."""
    last = spark.read.parquet(f"{path}/clears").groupBy("repo").agg(F.max("seq").alias("cleared"))
    current = lambda name: spark.read.parquet(f"{path}/{name}").drop("batch").join(last, "repo", "left").where("cleared is null or seq > cleared").drop("cleared")
    return D.merge_nodes(current("nodes")), D.first_edges(current("edges"))
