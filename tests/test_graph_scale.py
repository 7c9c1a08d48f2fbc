"""Walks of deep graphs, contraction against brute force, and what a hop moves."""

import random

import pytest
from pyspark.sql import functions as F

from codegraph_spark.operators import graph, relations

EDGE = "repo string, source string, target string, mask int"


def closure(edges, seeds):
    """(id -> bits) by walking one step at a time."""
    got = dict(seeds)
    todo = list(seeds)
    while todo:
        x = todo.pop()
        for a, b, m in edges:
            if a == x and (new := got[x] & m & ~got.get(b, 0)):
                got[b] = got.get(b, 0) | new
                todo.append(b)
    return got


@pytest.mark.parametrize("deep", (0, 1))
def test_contracted_walks_against_brute_force(spark, monkeypatch, deep):
    """Random graphs of chains, trees, rings and joins; seeds within them; six bits on every edge."""
    monkeypatch.setattr(graph, "DEEP", deep)
    monkeypatch.setattr(graph, "HOPS", 2)
    rng = random.Random(deep)
    edges, seeds, want = [], [], {}
    for repo in "pqrs":
        n = rng.choice([12, 40])
        own = [(str(i), str(i + 1), rng.choice([63, 63, 31, 5])) for i in range(n) if rng.random() < 0.8]
        own += [(str(rng.randrange(n)), str(rng.randrange(n)), rng.choice([63, 7, 48, 0])) for _ in range(n // 3)] + [("r1", "r2", 63), ("r2", "r1", 63)]
        start = {str(rng.randrange(n)): rng.choice([63, 3]) for _ in range(2)}
        edges += [(repo, *e) for e in own]
        seeds += [(repo, i, m) for i, m in start.items()]
        want |= {(repo, i): m for i, m in closure(own, start).items()}
    frame = spark.createDataFrame(edges + [("p", None, "x", 63), ("p", "x", None, 63)], EDGE)
    got = {(r["repo"], r["id"]): r["mask"] for r in graph.walk(frame, spark.createDataFrame(seeds, "repo string, id string, mask int"), mask=True).collect()}
    assert got == want


def test_long_chain_and_ring(spark, monkeypatch):
    """Ten thousand nodes in a row, and in a ring: rounds grow with the logarithm of the depth."""
    monkeypatch.setattr(graph, "DEEP", 1)
    n = 10_000
    chain = spark.range(n).select(F.lit("chain").alias("repo"), F.format_string("n%05d", "id").alias("source"), F.format_string("n%05d", F.col("id") + 1).alias("target"))
    ring = spark.range(n).select(F.lit("ring").alias("repo"), F.format_string("n%05d", "id").alias("source"), F.format_string("n%05d", (F.col("id") + 1) % n).alias("target"))
    lost = ring.withColumn("repo", F.lit("out of reach"))
    edges, entries = chain.union(ring).union(lost), spark.createDataFrame([("chain", "n00000"), ("ring", "n00007")], "repo string, id string")
    joins = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: joins.append(1) or real(df))
    near = graph.distances(edges, entries)
    assert {(r["repo"], r["n"], r["most"]) for r in near.groupBy("repo").agg(F.count("*").alias("n"), F.max("depth").alias("most")).collect()} == {("chain", n + 1, n), ("ring", n, n - 1)}
    assert len(joins) < 25


def test_paths_by_doubling(spark):
    edges = [(f"{i}", f"{i + 1}") for i in range(70)] + [("3", "x"), ("x", "5"), ("0", "y"), ("y", "z")]
    frame = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, source string, target string")
    entries = spark.createDataFrame([("r", "0")], "repo string, id string")
    targets = spark.createDataFrame([("r", t) for t in ("70", "5", "z", "0", "nowhere")], "repo string, id string")
    got = {r["target"]: r["path"] for r in graph.explain_path(frame, entries, targets).collect()}
    assert got == {"70": [f"{i}" for i in range(71)], "5": ["0", "1", "2", "3", "4", "5"], "z": ["0", "y", "z"], "0": ["0"]}


def test_a_hop_moves_no_edges(spark):
    """The join's one Exchange is the frontier's."""
    edges = spark.createDataFrame([("r", f"{n}", f"{n + 1}") for n in range(200)], "repo string, id string, `to` string")
    with graph.bucketed(["repo", "id"]) as store:
        out, _ = store(edges, True)
        frontier = spark.createDataFrame([("r", f"{n}") for n in range(5)], "repo string, id string")
        plan = frontier.hint("merge").join(out, ["repo", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_numbers_of_one_large_repo(spark):
    rng = random.Random(4)
    ids = [f"n{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [("big", i) for i in dict.fromkeys(ids)] + [("small", "n1"), ("small", "n0")]
    got = {(r["repo"], r["id"]): (r["i"], r["n"]) for r in relations.search_nodes(spark.createDataFrame(rows, "repo string, id string").repartition(3), "N").collect()}
    want = {}
    for repo in ("big", "small"):
        own = sorted(i for r, i in rows if r == repo)
        want |= {(repo, i): (n + 1, len(own)) for n, i in enumerate(own)}
    assert got == want
    assert relations.search_nodes(spark.createDataFrame([], "repo string, id string"), "n").count() == 0


def test_a_hub_is_cut_down_before_it_moves(spark):
    edges = spark.range(3000).select(F.lit("r").alias("repo"), F.lit("hub").alias("source"), F.col("id").cast("string").alias("target"))
    nodes = edges.select("repo", F.col("target").alias("id")).union(spark.createDataFrame([("r", "hub")], "repo string, id string"))
    top = relations.top_neighbors(edges, nodes, 3)
    assert "Partial" in (plan := top._jdf.queryExecution().executedPlan().toString()) and "WindowGroupLimit" in plan
    assert [r["neighbor"] for r in top.where("id = 'hub'").orderBy("rank").collect()] == ["0", "1", "10"]


def test_nodes_of_one_number_are_numbered_anew(spark, monkeypatch):
    """With the first salt all nodes have the same hash; two repos have nodes of the same ids."""
    real, salts = F.xxhash64, []

    def clash(salt, *rest):
        salts.append(salt)
        return F.lit(7).cast("long") if len(salts) < 2 else real(salt, *rest)

    monkeypatch.setattr(graph.F, "xxhash64", clash)
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("s", "c", "d"), ("s", "a", "c"), (None, "a", "z"), ("r", "c", None)], "repo string, source string, target string")
    seeds = spark.createDataFrame([("r", "a"), ("s", "c"), ("s", "lone"), ("r", None)], "repo string, id string")
    got = {tuple(x) for x in graph.walk(edges, seeds).collect()}
    assert got == {("r", "a"), ("r", "b"), ("r", "c"), ("s", "c"), ("s", "d"), ("s", "lone")} and len(salts) > 2


def test_graph_queries_derive_nodes_and_edges_once(spark, monkeypatch):
    from codegraph_spark.queries import graphs

    calls, real = [], graphs.frame
    monkeypatch.setattr(graphs, "frame", lambda *a: calls.append(1) or real(*a))
    for name in ("graph_totals", "hud_counts", "explain_path", "infer_usage_states"):
        calls.clear()
        out = graphs.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == 2, name
        assert "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString()
