"""Joins of resolvers, as they are run."""

from codegraph_spark.operators import imports as I
from codegraph_spark.operators import resolve as X


def test_candidates_are_not_broadcast(spark):
    src = spark.range(100).selectExpr("'r' AS repo", "concat('src/p', id, '.rs') AS path", "concat('use crate::p', id + 1, '::T;') AS content")
    edges = X.resolve_rust(I.rust_imports(src), src, src.selectExpr("repo", "'serde' AS name").limit(1))
    assert edges.count() == 99
    executed = edges._jdf.queryExecution()
    executed.toRdd().count()
    final = executed.executedPlan().toString().split("Initial Plan")[0]
    assert "__cg_all" not in "".join(line for line in final.splitlines() if "BroadcastHashJoin" in line) and "SortMergeJoin" in final
