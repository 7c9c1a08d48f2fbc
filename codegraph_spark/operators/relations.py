"""Order-dependent choice, set operations, joins and aggregates over nodes, edges and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

EXPORT_ITEM = "array<struct<seq:long,item:string>>"


# -- order-dependent choice


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__cg_n", F.row_number().over(w)).where("__cg_n = 1").drop("__cg_n")


def dedupe_imports(facts: DataFrame) -> DataFrame:
    names = F.concat_ws(",", F.coalesce("named_original", F.array().cast("array<string>")))
    keyed = facts.withColumn("__cg_k", F.concat_ws("\x01", F.coalesce("default_name", F.lit("")), F.coalesce("namespace_name", F.lit("")), names, F.col("is_type_only").cast("string")))
    return dedupe_first(keyed, ["repo", "path", "spec", "kind", "__cg_k"], ["ord"]).drop("__cg_k")


def last_wins_map(df: DataFrame, key: str, value: str, order) -> DataFrame:
    """(repo, key, value): the value of the last row in order."""
    return df.where(F.col(key).isNotNull()).groupBy("repo", key).agg(F.max_by(value, order).alias(value))


def first_hit(candidates: DataFrame, keys: list[str], target: str = "target", rank: str = "rank") -> DataFrame:
    """The target of the lowest-ranked candidate that resolved."""
    return candidates.where(F.col(target).isNotNull()).groupBy(*keys).agg(F.min_by(target, rank).alias(target))


def namespace_anchor(files: DataFrame) -> DataFrame:
    """(repo, namespace, anchor): the first file whose stem is the namespace's last segment, else the first file."""
    own = F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")) == F.lower(F.substring_index("namespace", ".", -1))
    return files.where("namespace is not null").groupBy("repo", "namespace").agg(F.min_by("path", F.struct(F.when(own, 0).otherwise(1), F.col("path"))).alias("anchor"))


def block_state(lines: DataFrame, start: Column, end: Column, keys=("repo", "path"), order: str = "line_no") -> DataFrame:
    """Adds in_block: does the line lie behind a start without an end since."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("in_block", F.coalesce(F.last(F.when(end, F.lit(0)).when(start, F.lit(1)), ignorenulls=True).over(w) == 1, F.lit(False)))


# -- joins


def externals(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, id, type, state): edge targets that are no file."""
    targets = edges.select("repo", F.col("target").alias("id")).distinct()
    return targets.join(files.select("repo", "id"), ["repo", "id"], "left_anti").withColumns({"type": F.lit("external"), "state": F.lit("used")})


def all_nodes(files: DataFrame, externals: DataFrame) -> DataFrame:
    return files.unionByName(externals, allowMissingColumns=True).dropDuplicates(["repo", "id"])


def unresolved_imports(imports: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports of a file without an internal target; edges are a resolver's, which keep what names their import."""
    keys = ["repo", *[c for c in ("ord", "line", "spec", "module", "name") if c in imports.columns and c in edges.columns]]
    inside = edges.where("internal").select(F.col("source").alias("__cg_path"), *[F.col(c).alias(f"__cg_{c}") for c in keys]).distinct()
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__cg_{c}")), keys, F.col("path") == F.col("__cg_path"))
    return imports.join(inside, same, "left_anti")


def namespace_peers(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges between each file and its namespace's anchor, both ways: a star, no clique."""
    pairs = files.join(anchors, ["repo", "namespace"]).where("path <> anchor")
    both = F.explode(F.array(F.struct(F.col("path").alias("source"), F.col("anchor").alias("target")), F.struct(F.col("anchor").alias("source"), F.col("path").alias("target"))))
    return pairs.select("repo", both.alias("e")).select("repo", "e.source", "e.target", F.lit("namespace_peer").alias("kind"), F.lit("heuristic").alias("certainty")).distinct()


def attach_by_candidates(nodes: DataFrame, candidates: Column, lookup: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """nodes plus value: of the first of a node's candidate ids (array<string>) that the lookup has."""
    tried = nodes.select("repo", "id", F.posexplode(candidates).alias("rank", key)).where(F.col(key).isNotNull())
    hit = tried.join(lookup.select("repo", key, value), ["repo", key]).groupBy("repo", "id").agg(F.min_by(value, "rank").alias(value))
    return nodes.join(hit, ["repo", "id"], "left")


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, id, neighbor, degree): nodes one hop away, either way."""
    both = edges.select("repo", F.col("source").alias("id"), F.col("target").alias("neighbor")).union(edges.select("repo", "target", "source")).distinct()
    known = degrees(nodes, edges).select("repo", F.col("id").alias("neighbor"), (F.col("inDeg") + F.col("outDeg")).alias("degree"))
    return both.join(known, ["repo", "neighbor"])


# -- aggregates


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes plus inDeg and outDeg, parallel edges counted; ends that are no node are ignored."""
    out = edges.groupBy("repo", F.col("source").alias("id")).agg(F.count("*").alias("outDeg"))
    into = edges.groupBy("repo", F.col("target").alias("id")).agg(F.count("*").alias("inDeg"))
    plain = nodes.drop("inDeg", "outDeg")
    return plain.join(into, ["repo", "id"], "left").join(out, ["repo", "id"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("inDeg", "outDeg")})


def graph_stats(nodes: DataFrame, edges: DataFrame, used_states=("used",)) -> DataFrame:
    """One row per repo: nodes, edges, used, unused, externals, max_degree. nodes carry state, type, inDeg and outDeg."""
    n = nodes.groupBy("repo").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("state").isin(*used_states)).alias("used"),
        F.count_if(F.col("state") == "unused").alias("unused"),
        F.count_if(F.col("type") == "external").alias("externals"),
        F.max(F.col("inDeg") + F.col("outDeg")).alias("max_degree"),
    )
    return n.join(edges.groupBy("repo").agg(F.count("*").alias("edges")), "repo", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))


def graph_totals(stats: DataFrame) -> DataFrame:
    """One row over all repos of graph_stats(): their number, sums of the counts, and the largest degree; no repos: zeros."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return stats.agg(F.count("*").alias("repos"), *map(total, ("nodes", "edges", "used", "unused", "externals")), F.coalesce(F.max("max_degree"), F.lit(0).cast("long")).alias("max_degree"))


def security_summary(findings: DataFrame, severity: str = "severityNormalized") -> DataFrame:
    """One row per repo: totals, and the counts of each severity as a map."""
    by = findings.groupBy("repo", severity).agg(F.count("*").alias("n"))
    counts = by.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(severity, "n")))).alias("by_severity"))
    return findings.groupBy("repo").agg(F.count("*").alias("total_findings"), F.count_distinct("path").alias("affected_nodes")).join(counts, "repo")


def findings_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "path", "id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))


def reachable_profiles(reach: DataFrame) -> DataFrame:
    """(repo, id, profiles): the sorted names of the profiles that reach a node."""
    return reach.groupBy("repo", "id").agg(F.array_sort(F.collect_set("profile")).alias("profiles"))


def group_counts(nodes: DataFrame, by: str) -> DataFrame:
    return nodes.groupBy("repo", by).agg(F.count("*").alias("n"), F.sum("sizeLOC").alias("loc"))


def append_exports(direct: Column, referenced: Column) -> Column:
    """Two map<string, array<string>>: the referenced items behind the direct ones, nothing dropped."""
    none = lambda m: F.coalesce(m, F.create_map().cast("map<string,array<string>>"))
    empty = F.array().cast("array<string>")
    return F.map_zip_with(none(direct), none(referenced), lambda k, a, b: F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


# -- sorts, limits, viewer queries


def top_neighbors(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Each node's k neighbours of highest degree, ties by id. Every task keeps the k best of a node before rows are moved (the
    planner does so up to spark.sql.window.group.limit.threshold), so a hub's neighbours are never in one task."""
    w = Window.partitionBy("repo", "id").orderBy(F.desc("degree"), "neighbor")
    return neighbors(edges, nodes).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def max_degree_nodes(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select("repo", "id", (F.col("inDeg") + F.col("outDeg")).alias("degree")).orderBy(F.desc("degree"), "repo", "id").limit(k)


def sorted_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("repo", "id")


def unused_sample(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The first k unused ids of each repo, sorted."""
    w = Window.partitionBy("repo").orderBy("id")
    return nodes.where("state = 'unused'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("repo", "id", "rank")


def unreachable(files: DataFrame, reach: DataFrame) -> DataFrame:
    return files.select("repo", "id").join(reach.select("repo", "id"), ["repo", "id"], "left_anti")


def filter_graph(nodes: DataFrame, edges: DataFrame, disconnected_only=False, dynamic_only=False, deferred_only=False, hide_externals=False, hide_dynamic=False, min_degree=0) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass, and edges with both ends among them. nodes: statuses array, type, degrees; edges: is_dynamic."""
    for wanted, status in ((disconnected_only, "disconnected_all_profiles"), (dynamic_only, "dynamic_only"), (deferred_only, "deferred_only")):
        if wanted:
            nodes = nodes.where(F.array_contains("statuses", status))
    if hide_externals:
        nodes = nodes.where("type <> 'external'")
    nodes = nodes.where(F.col("inDeg") + F.col("outDeg") >= min_degree)
    if hide_dynamic:
        edges = edges.where("not is_dynamic")
    for end in ("source", "target"):
        edges = edges.join(nodes.select("repo", F.col("id").alias(end)), ["repo", end], "left_semi")
    return nodes, edges


def hud_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("repo").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.array_contains("statuses", "reachable_current")).alias("reachable"),
        F.count_if(F.array_contains("statuses", "disconnected_all_profiles")).alias("disconnected"),
        F.count_if(F.array_contains("statuses", "dynamic_only")).alias("dynamic_only"),
    )
    return n.join(edges.groupBy("repo").agg(F.count("*").alias("edges")), "repo", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))


def insights(nodes: DataFrame) -> DataFrame:
    degree = F.col("inDeg") + F.col("outDeg")
    return nodes.groupBy("repo").agg(
        F.count_if(degree == 1).alias("pure_leaves"),
        F.count_if(F.coalesce("hasSideEffects", F.lit(False))).alias("side_effect_files"),
        F.count_if(F.array_contains("statuses", "disconnected_all_profiles") & (degree > 0)).alias("unused_attached"),
        F.max(degree).alias("max_degree"),
    )


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with i, a row's number among the rows of its keys in this order (from one), and n, how many they are.

    Rows are dealt into ranges of (keys, order) of about equal size; each range numbers its own rows, and a running sum over the
    ranges' counts, a row a range, tells what stands before it. So a key of any number of rows takes no task of its own.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(ranges, *keys, *order).withColumn("__cg_part", F.spark_partition_id()))
    part = [*keys, "__cg_part"]
    counts = dealt.groupBy(*part).agg(F.count("*").alias("__cg_n"))
    w = Window.partitionBy(*keys)
    before = F.sum("__cg_n").over(w.orderBy("__cg_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*part, F.coalesce(before, F.lit(0).cast("long")).alias("__cg_before"), F.sum("__cg_n").over(w).alias("n"))
    own = dealt.withColumn("__cg_i", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return own.join(counts, part).select(*df.columns, (F.col("__cg_before") + F.col("__cg_i")).cast("int").alias("i"), "n")


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Matches of a substring in the id, in order: match i of n."""
    return numbered(nodes.where(F.lower("id").contains(text.lower())).select("repo", "id"), ["repo"], ["id"])
