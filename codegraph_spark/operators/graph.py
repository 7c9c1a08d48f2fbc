"""Reachability, usage states, profiles and paths: loops over DataFrames, all repos in one loop."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.findings import EDGE_MASKS, kept

#: First that applies is a node's primary status; disconnected_all_profiles comes before them all.
STATUS_ORDER = ("reachable_current", "deferred_only", "dynamic_only", "test_only", "build_time_only", "reachable_other_profile")


#: Steps of a walk in one job.
HOPS = 6
#: Rounds after which what is left of a graph is contracted: few graphs are that deep.
DEEP = 6
#: A graph is contracted again as long as the last time took away more than one in CONTRACTED of its nodes.
CONTRACTED = 3


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; a private one only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cg-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written once into the shared folder as plain files: whoever reads it takes the columns that it needs. VARIANT values
    are written whole: shredded, they take longer to write and to read."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cg_{uuid.uuid4().hex}"
    shred, was = "spark.sql.variant.writeShredding.enabled", spark.conf.get("spark.sql.variant.writeShredding.enabled", None)
    spark.conf.set(shred, "false")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(shred) if was is None else spark.conf.set(shred, was)
    return spark.read.schema(df.schema).parquet(folder)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


@contextmanager
def bucketed(by: list[str]) -> Iterator:
    """A function that writes a DataFrame into the shared folder, bucketed and sorted by these columns, and returns the table, and
    the same rows as plain files. Joins on the columns move only the other side of the table; unions take the plain files (a
    union of tables is taken for bucketed where it is not). deal: rows aren't dealt by the columns yet. The tables' names end with
    the block; their files stay in the shared folder, as those of checkpoints do."""
    names: list[tuple[SparkSession, str]] = []

    def store(df: DataFrame, deal: bool = False) -> tuple[DataFrame, DataFrame]:
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        name = f"cg_{uuid.uuid4().hex}"
        n, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{spark.sparkContext.getCheckpointDir()}/{name}"
        names.append((spark, name))
        dealt = df.repartition(n, *by) if deal else df
        dealt.write.bucketBy(n, *by).sortBy(*by).option("path", folder).saveAsTable(name)
        return spark.table(name), spark.read.schema(df.schema).parquet(folder)

    try:
        yield store
    finally:
        for spark, name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def contract(out: DataFrame, seeds: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Edges of a smaller graph, and what was taken out of it, to be put back last to first by expand().

    out(*keys, id, to, edge_mask, len) are distinct edges, seeds(*keys, id). A node that one edge leads to, and that is no seed,
    is reached from that edge's source only: it is taken out, and hangs on the nearest ancestor that stays, by the AND of the masks
    and the sum of the lengths on the way. Ancestors are found by pointer doubling, in as many rounds as the logarithm of
    the depth, so chains, trees and rings take few rounds. Edges that then have the same ends become one (masks are joined by OR,
    the shortest length stays), which may leave new nodes with one edge: the graph is contracted again while that pays.
    Nodes that nothing leads to, and rings that nothing leads into, are out of reach and fall away.
    """
    by, hung = [*keys, "id"], []
    while True:
        into = out.groupBy(*keys, F.col("to").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("up"), F.min("edge_mask").alias("m"), F.min("len").alias("way"))
        into = cut(into.join(seeds.withColumn("seed", F.lit(True)), by, "left"))
        total, one = into.agg(F.count("*"), F.count_if(F.expr("n = 1 AND seed IS NULL"))).first()
        if one * CONTRACTED <= total:
            return out, hung
        tree = into.where("n = 1 AND seed IS NULL").select(*by, "up", "m", "way")
        inner = tree.select(*keys, F.col("id").alias("up")).withColumn("todo", F.lit(True))
        tree = cut(tree.join(inner, [*keys, "up"], "left").select(*by, "up", "m", "way", F.coalesce("todo", F.lit(False)).alias("todo")))
        left = tree.where("todo").count()
        while left:
            above = tree.select(*keys, F.col("id").alias("up"), F.col("up").alias("up2"), F.col("m").alias("m2"), F.col("way").alias("way2"), F.col("todo").alias("todo2"))
            nearer = tree.where("todo").join(above, [*keys, "up"]).select(*by, F.col("up2").alias("up"), F.col("m").bitwiseAND(F.col("m2")).alias("m"), (F.col("way") + F.col("way2")).alias("way"), F.col("todo2").alias("todo"))
            tree = cut(tree.where("NOT todo").unionByName(nearer))
            before, left = left, tree.where("todo").count()
            if left == before:  # rings only
                tree = tree.where("NOT todo")
                break
        hung.append(tree.drop("todo"))
        # what is left leads from nodes that stay to nodes that stay
        stays = out.join(tree.select(*keys, F.col("id").alias("to")), [*keys, "to"], "left_anti")
        moved = stays.join(tree, by, "left")
        source, through = F.coalesce("up", "id").alias("id"), F.coalesce("m", "edge_mask").bitwiseAND(F.col("edge_mask")).alias("edge_mask")
        length = (F.coalesce("way", F.lit(0)) + F.col("len")).alias("len")
        moved = moved.select(*keys, source, "to", through, length).groupBy(*by, "to").agg(F.bit_or("edge_mask").alias("edge_mask"), F.min("len").alias("len"))
        ends = into.where("n > 1 OR seed").select(*by).unionByName(seeds.select(*by)).distinct()
        out = cut(moved.join(ends, by, "left_semi"))


def expand(found: DataFrame, hung: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """found(*keys, id, mask or depth) with the nodes that contract() took out, reached as the nodes they hang on are."""
    through = {"mask": F.col("mask").bitwiseAND(F.col("m")), "depth": F.col("depth") + F.col("way")}[value].alias(value)
    for tree in reversed(hung):
        below = tree.join(found.withColumnRenamed("id", "up"), [*keys, "up"]).select(*keys, "id", through)
        found = cut(found.unionByName(below.where("mask <> 0") if value == "mask" else below))
    return found


def numbered(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct edges (id, to, edge_mask, len) and seeds(id, ...) with a number for each node of edges(*keys, source, target, mask)
    and seeds(*keys, id, ...), and names(id, *keys, name) to read them back: loops then join on one number, not on texts.

    A number is a hash of keys and id. Where two nodes have the same one, all are hashed anew with another salt. Edges with a null end or
    key lead nowhere.
    """
    edges, salt = edges.where(" and ".join(f"{c} is not null" for c in (*keys, "source", "target"))), 0
    while True:
        number = lambda c: F.xxhash64(F.lit(salt), *keys, c)  # noqa: B023, E731
        nodes = edges.select(*keys, F.explode(F.array("source", "target")).alias("name")).union(seeds.select(*keys, "id"))
        names = stored(nodes.select(number("name").alias("id"), *keys, "name").distinct())
        if names.groupBy("id").count().where("count > 1").isEmpty():
            break
        salt += 1
    ends = edges.select(number("source").alias("id"), number("target").alias("to"), "mask").groupBy("id", "to").agg(F.bit_or("mask").alias("edge_mask"))
    return ends.withColumn("len", F.lit(1).cast("long")), seeds.withColumn("id", number("id")).drop(*keys), names


def _named(found: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    return found.join(names, "id").drop("id").withColumnRenamed("name", "id").select(*keys, "id", *[c for c in found.columns if c != "id"])


def walk(edges: DataFrame, seeds: DataFrame, keys=("repo",), mask: bool = False) -> DataFrame:
    """Closure. edges(*keys, source, target[, mask]), seeds(*keys, id[, mask]) -> (*keys, id[, mask]).

    With masks, a bit walks only edges that have it, and each node keeps the bits that reached it. The walk is breadth first over
    edges bucketed by their source, so a hop moves its frontier only. A round takes HOPS steps in one job, and writes the visited
    nodes, bucketed alike, with the bits that its last step alone found, which are the next frontier. After DEEP rounds all that isn't visited yet is contracted, once, so long chains
    and rings take few rounds more. Null ids are ignored.
    """
    keys, by, bits, none = list(keys), ["id"], F.col("mask") if mask else F.lit(1), F.lit(0)
    seeds = seeds.where("id is not null").select(*keys, "id", bits.alias("mask"))
    ends, seeds, names = numbered(edges.select(*keys, "source", "target", bits.alias("mask")), seeds, keys)
    first = seeds.groupBy(*by).agg(F.bit_or("mask").alias("mask"))
    with bucketed(by) as store:
        (out, whole), (known, plain), hung, rounds = store(ends, True), store(first.withColumn("last", F.col("mask"))), [], 0
        while True:
            frontier = plain.where("last <> 0").select(*by, F.col("last").alias("mask"))
            if frontier.isEmpty():
                break
            if rounds == DEEP:
                out, hung = contract(whole, plain.select(*by), [])
                out, _ = store(out, True)
            steps, at = [], frontier
            for hop in range(1, HOPS + 1):
                step = at.join(out, by).select(F.col("to").alias("id"), F.col("mask").bitwiseAND(F.col("edge_mask")).alias("mask")).where("mask <> 0")
                at = step.groupBy(*by).agg(F.bit_or("mask").alias("mask"))
                steps.append(at.select(*by, "mask", (F.col("mask") if hop < HOPS else none).alias("early")))
            found = _union(steps).groupBy(*by).agg(F.bit_or("mask").alias("found"), F.bit_or("early").alias("early"))
            had, got = F.coalesce("mask", none), F.coalesce("found", none)
            last = got.bitwiseAND(F.bitwise_not(had)).bitwiseAND(F.bitwise_not(F.coalesce("early", none)))
            known, plain = store(known.drop("last").join(found, by, "full").select(*by, had.bitwiseOR(got).alias("mask"), last.alias("last")))
            rounds += 1
        done = plain.drop("last")
    done = _named(expand(done, hung, [], "mask"), names, keys)
    return done if mask else done.drop("mask")


def reach(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(repo, id): everything reachable from the entries, they and ids that are no node included."""
    return walk(edges, entries)


def node_states(nodes: DataFrame, reached: DataFrame, side_effects: DataFrame | None = None, any_degree: bool = False) -> DataFrame:
    """nodes plus state: externals and reached nodes are used; JS: reached targets of side-effect imports side_effect_only."""
    marked = nodes.drop("state").join(reached.select("repo", "id").distinct().withColumn("__cg_r", F.lit(True)), ["repo", "id"], "left")
    state = F.when(F.col("type") == "external", F.lit("used"))
    if side_effects is not None:
        marked = marked.join(side_effects.select("repo", "id").distinct().withColumn("__cg_s", F.lit(True)), ["repo", "id"], "left")
        state = state.when(F.col("__cg_r") & F.col("__cg_s"), F.lit("side_effect_only"))
    state = state.when(F.col("__cg_r"), F.lit("used"))
    if any_degree:
        state = state.when(F.col("inDeg") + F.col("outDeg") > 0, F.lit("used"))
    return marked.withColumn("state", state.otherwise(F.lit("unused"))).drop("__cg_r", "__cg_s")


def by_priority(options: list[DataFrame]) -> DataFrame:
    """(repo, id) of each repo's first option that has rows."""
    ranked = _union([o.select("repo", "id", F.lit(n).alias("rank")) for n, o in enumerate(options)])
    least = ranked.groupBy("repo").agg(F.min("rank").alias("rank"))
    return ranked.join(least, ["repo", "rank"], "left_semi").select("repo", "id").distinct()


def entries_with_fallback(named: DataFrame, files: DataFrame) -> DataFrame:
    """Named entries that are files; else files nothing points to; else all files. files: id, inDeg."""
    return by_priority([named.join(files, ["repo", "id"], "left_semi"), files.where("inDeg = 0"), files])


def normalize_entrypoints(listed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Listed ids; else flagged nodes; else file roots with edges; else the first node."""
    first = nodes.groupBy("repo").agg(F.min("id").alias("id"))
    roots = nodes.where((F.col("type") == "file") & (F.col("inDeg") == 0) & (F.col("outDeg") > 0))
    return by_priority([listed.where("id is not null"), nodes.where(F.coalesce("is_entry", F.lit(False))), roots, first])


def normalize_profiles(raw: DataFrame, use_id: bool = False) -> DataFrame:
    """raw(repo, doc variant) -> (repo, pos, name, flags): text, list of texts or objects, map of name to flags; none: default."""
    doc = F.col("doc")
    kind = F.schema_of_variant(doc)
    flags = lambda v: F.coalesce(*[F.try_variant_get(v, p, "map<string,string>") for p in ("$.flags", "$.gates")])
    single = raw.where(kind == "STRING").select("repo", F.lit(0).alias("pos"), F.try_variant_get(doc, "$", "string").alias("name"), F.lit(None).cast("map<string,string>").alias("flags"))
    items = raw.sparkSession.sql("SELECT repo, e.pos, e.key, e.value FROM {raw}, LATERAL variant_explode(doc) e WHERE schema_of_variant(doc) <> 'STRING'", raw=raw)
    v = F.col("value")
    own = F.coalesce(*([F.try_variant_get(v, "$.id", "string")] if use_id else []), F.try_variant_get(v, "$.name", "string"))
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    name = F.coalesce(F.col("key"), plain, own, F.concat(F.lit("profile-"), F.col("pos") + 1))
    whole = F.when(F.col("key").isNotNull(), F.try_variant_get(v, "$", "map<string,string>"))
    many = items.select("repo", "pos", name.alias("name"), F.coalesce(flags(v), whole).alias("flags"))
    found = single.unionByName(many)
    default = raw.select("repo").distinct().join(found.select("repo").distinct(), "repo", "left_anti").select("repo", F.lit(0).alias("pos"), F.lit("default").alias("name"), F.lit(None).cast("map<string,string>").alias("flags"))
    return found.unionByName(default)


def profile_reachability(edges: DataFrame, entries: DataFrame, profiles: DataFrame) -> DataFrame:
    """(repo, profile, id, mask): six closures per profile in one loop. edges(repo, profile, source, target, mask) are the active ones."""
    seeds = entries.join(profiles.select("repo", F.col("name").alias("profile")), "repo").withColumn("mask", F.lit(sum(EDGE_MASKS.values())))
    return walk(edges, seeds, ("repo", "profile"), mask=True)


def classify(nodes: DataFrame, reached: DataFrame, profiles: DataFrame, keep_rules=()) -> DataFrame:
    """(repo, id, profile, statuses) for every node and profile. nodes: id, dynamic_evidence, phase where known."""
    phase = F.lower(F.coalesce(F.col("phase"), F.lit(""))) if "phase" in nodes.columns else F.lit("")
    grid = nodes.select("repo", "id", F.coalesce("dynamic_evidence", F.lit(False)).alias("dynamic_evidence"), phase.alias("phase")).join(profiles.select("repo", F.col("name").alias("profile")), "repo")
    anywhere = reached.select("repo", "id").distinct().withColumn("anywhere", F.lit(True))
    grid = grid.join(reached, ["repo", "profile", "id"], "left").join(anywhere, ["repo", "id"], "left")
    bit = lambda name: F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.lit(EDGE_MASKS[name])) != 0
    here, other = bit("all"), F.col("anywhere") & ~bit("all")
    one = lambda c, name: F.when(c, F.lit(name))
    late = here & ~bit("runtime")
    found = F.array_compact(F.array(
        one(here, "reachable_current"),
        one(here & ~bit("no_deferred"), "deferred_only"),
        one(other, "reachable_other_profile"),
        one(here & ~bit("no_dynamic") | other & (kept(F.col("id"), keep_rules) | F.col("dynamic_evidence")), "dynamic_only"),
        one(late & bit("no_build") | other & F.col("phase").contains("test"), "test_only"),
        one(late & bit("no_test") | other & F.col("phase").contains("build"), "build_time_only"),
    ))
    return grid.select("repo", "id", "profile", F.when(F.coalesce("anywhere", F.lit(False)), found).otherwise(F.array(F.lit("disconnected_all_profiles"))).alias("statuses"))


def primary_status(statuses: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(statuses, s), F.lit(s)) for s in ("disconnected_all_profiles", *STATUS_ORDER)])


def infer_usage_states(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with state filled, for repos in which no file has a state other than unused.

    Seeds are side-effect files and targets of side-effect edges, else file roots with edges; the walk goes over files only.
    """
    told = nodes.where("type = 'file' and state is not null and state <> 'unused'").select("repo").distinct()
    open_, known = nodes.join(told, "repo", "left_anti"), nodes.join(told, "repo", "left_semi")
    files = open_.where("type = 'file'")
    ends = files.select("repo", "id")
    inner = edges.select("repo", "source", "target").join(ends.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi").join(ends.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi")
    effects = edges.where("kind = 'side_effect'").select("repo", F.col("target").alias("id")).join(ends, ["repo", "id"], "left_semi")
    side = files.where(F.coalesce("hasSideEffects", F.lit(False))).select("repo", "id").union(effects).distinct()
    seeds = by_priority([side, files.where("inDeg = 0 and outDeg > 0")])
    return known.unionByName(node_states(open_, walk(stored(inner), stored(seeds)), effects), allowMissingColumns=True)


def distances(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(repo, id, depth): least number of edges from an entry to every node in reach.

    As walk(), over edges with lengths, since a contracted graph's have: nodes are relaxed until none comes nearer, and what was
    taken out hangs on one node by a known length.
    """
    by = ["id"]
    ends, seeds, names = numbered(edges.select("repo", "source", "target", F.lit(1).alias("mask")), entries.select("repo", "id").where("id is not null"), ["repo"])
    first = seeds.distinct().select("id", F.lit(0).cast("long").alias("depth"), F.lit(True).alias("fresh"))
    with bucketed(by) as store:
        (out, whole), (known, plain), hung, rounds = store(ends, True), store(first, True), [], 0
        while True:
            frontier = plain.where("fresh").select(*by, "depth")
            if frontier.isEmpty():
                break
            if rounds == DEEP:
                out, hung = contract(whole, plain.select(*by), [])
                out, _ = store(out, True)
            steps, at = [], frontier
            for _ in range(HOPS):
                at = at.join(out, by).select(F.col("to").alias("id"), (F.col("depth") + F.col("len")).alias("depth")).groupBy(*by).agg(F.min("depth").alias("depth"))
                steps.append(at)
            best = _union(steps).groupBy(*by).agg(F.min("depth").alias("near"))
            fresh = F.coalesce(F.col("near") < F.col("depth"), F.col("depth").isNull()).alias("fresh")
            known, plain = store(known.drop("fresh").join(best, by, "full").select(*by, F.least("depth", "near").alias("depth"), fresh))
            rounds += 1
        done = plain.drop("fresh")
    return _named(expand(done, hung, [], "depth"), names, ["repo"])


def explain_path(edges: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo, target, path): a shortest path from an entry to each target, ties to the smaller parent; targets out of reach give none.

    The way back takes twice as many rounds as the logarithm of the depth: ancestors at 1, 2, 4, ... steps are tables, made from each
    other; a target's rows are then doubled from the largest step down, each ancestor once, and put in order at the end.
    """
    by = ["repo", "id"]
    near = stored(distances(edges, entries))
    ends = edges.select("repo", F.col("source").alias("id"), F.col("target").alias("to")).where("id is not null and `to` is not null").distinct()
    there = near.select("repo", F.col("id").alias("to"), F.col("depth").alias("there"))
    parents = ends.join(near, by).join(there, ["repo", "to"]).where("there = depth + 1").groupBy("repo", F.col("to").alias("id")).agg(F.min("id").alias("up"))
    rows = cut(targets.select(*by).distinct().join(near, by).select("repo", F.col("id").alias("target"), "id", F.lit(0).cast("long").alias("back"), "depth"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    levels = [cut(parents)] if deepest else []
    while 2 ** len(levels) <= deepest:
        last = levels[-1]
        levels.append(cut(last.join(last.select("repo", F.col("id").alias("up"), F.col("up").alias("up2")), ["repo", "up"]).select(*by, F.col("up2").alias("up"))))
    for n in reversed(range(len(levels))):
        up = rows.join(levels[n], by).select("repo", "target", F.col("up").alias("id"), (F.col("back") + 2**n).alias("back"), "depth")
        rows = cut(rows.unionByName(up))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((F.col("depth") - F.col("back")).alias("at"), "id"))), lambda x: x["id"])
    return rows.groupBy("repo", "target").agg(ordered.alias("path"))
