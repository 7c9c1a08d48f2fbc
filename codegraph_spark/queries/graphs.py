"""Graph queries. A graph is derived from the order lines: in each order, the part of one line leads to the part of the next
line of the same repo (eight repos, by supplier). The same SQL text makes the inputs in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.findings import edge_active, edge_flags, edge_mask
from ..operators import graph as G
from ..operators import relations as R

TABLES = ("part", "lineitem", "events", "supplier", "customer", "pages", "documents")

NODES = """SELECT DISTINCT 'repo' || CAST(l_suppkey % 8 AS STRING) AS repo, 'src/p' || CAST(l_partkey AS STRING) || '.js' AS id, 'file' AS type,
    p_size AS sizeLOC, p_brand AS package, p_type AS namespace, p_size = 1 AS is_entry, p_size = 2 AS "hasSideEffects"
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
HOPS = """SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey, l_suppkey % 8
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_quantity, l_discount, l_tax, l_shipdate) AS nxt FROM lineitem"""
EDGES = f"""SELECT 'repo' || CAST(l_suppkey % 8 AS STRING) AS repo, 'src/p' || CAST(l_partkey AS STRING) || '.js' AS source,
    'src/p' || CAST(nxt AS STRING) || '.js' AS target, CASE l_returnflag WHEN 'R' THEN 'dynamic-import' WHEN 'A' THEN 'import' ELSE 'require' END AS kind,
    CASE WHEN l_quantity < 8 THEN 'test' WHEN l_quantity > 43 THEN 'codegen' ELSE 'runtime' END AS phase, l_discount > 0.08 AS deferred,
    CASE WHEN l_linestatus = 'O' AND l_tax > 0.06 THEN 'prod' END AS profile
    FROM ({HOPS}) h WHERE nxt IS NOT NULL AND nxt <> l_partkey"""
OUTSIDE = """SELECT 'repo' || CAST(l_suppkey % 8 AS STRING) AS repo, 'src/p' || CAST(l_partkey AS STRING) || '.js' AS source,
    'pip:s' || CAST(l_suppkey AS STRING) AS target, 'import' AS kind, l_orderkey * 1000 + l_linenumber AS ord FROM lineitem"""
ENTRIES = "SELECT repo, id FROM nodes WHERE is_entry"
PROFILES = "SELECT DISTINCT repo, 0 AS pos, 'dev' AS name FROM nodes UNION ALL SELECT DISTINCT repo, 1, 'prod' FROM nodes"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql.replace('"hasSideEffects"', "hasSideEffects"))


def sources(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """frame() of source files (repo, path, content), which are dealt over all tasks: a small table is read in one task, which
    would take apart all texts that are made of it."""
    return frame(spark, sf_dir, sql).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "repo", "path")


def spread(spark: SparkSession, sf_dir: str, sql: str, columns: list[str]) -> DataFrame:
    """frame() of lineitem's rows, which are dealt over all tasks first: a file that is read in few tasks makes many documents."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.table("lineitem").select(columns).repartition(n, "l_orderkey", "l_linenumber").createOrReplaceTempView("lineitem")
    return spark.sql(sql)


def nodes(spark, d):
    return frame(spark, d, NODES)


def edges(spark, d):
    return frame(spark, d, EDGES)


def drawn(spark, d):
    """Nodes and edges, derived from the tables once, however often a query reads them."""
    return G.stored(nodes(spark, d)), G.stored(edges(spark, d))


def entries(n):
    return n.where("is_entry").select("repo", "id")


def profiles(n):
    return n.select("repo").distinct().select("repo", F.posexplode(F.array(F.lit("dev"), F.lit("prod"))).alias("pos", "name"))


def flagged(e):
    e = e.withColumns(edge_flags(F.col("kind"), F.col("phase"), F.col("deferred"), F.lit(None).cast("boolean")))
    return e.withColumn("mask", edge_mask(F.col("is_deferred"), F.col("is_dynamic"), F.col("edge_phase")))


def active(n, e):
    none = F.lit(None).cast("map<string,string>")
    grid = flagged(e).join(profiles(n), "repo")
    ok = edge_active(F.lit(None).cast("array<string>"), F.col("profile"), F.lit(None).cast("string"), none, F.col("name"), none)
    return grid.where(ok).select("repo", F.col("name").alias("profile"), "source", "target", "mask")


QUERIES, ORACLES = {}, {}
_WITH = f"""WITH RECURSIVE nodes AS ({NODES}), edges AS ({EDGES}), outside AS ({OUTSIDE}), entries AS ({ENTRIES}), profiles AS ({PROFILES}),
    ins AS (SELECT repo, target AS id, count(*) AS n FROM edges GROUP BY ALL), outs AS (SELECT repo, source AS id, count(*) AS n FROM edges GROUP BY ALL),
    deg AS (SELECT nodes.*, coalesce(ins.n, 0) AS inDeg, coalesce(outs.n, 0) AS outDeg FROM nodes LEFT JOIN ins USING (repo, id) LEFT JOIN outs USING (repo, id)),
    reached AS (SELECT repo, id FROM entries UNION SELECT e.repo, e.target FROM reached r JOIN edges e ON e.repo = r.repo AND e.source = r.id),
    st AS (SELECT deg.*, CASE WHEN r.id IS NULL THEN 'unused' ELSE 'used' END AS state FROM deg LEFT JOIN (SELECT DISTINCT * FROM reached) r USING (repo, id)),
    """


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            head, _, tail = oracle.rpartition("=>")
            ORACLES[f.__name__] = _WITH + (head + ", " if head else "") + "one AS (SELECT 1) " + tail
        return f

    return add


def states(n, e):
    return G.node_states(R.degrees(n, e), G.reach(e, entries(n)))


@query("SELECT repo, count(*) AS nodes, count(*) FILTER (state = 'used') AS used, count(*) FILTER (state = 'unused') AS unused, CAST(0 AS BIGINT) AS externals, max(inDeg + outDeg) AS max_degree, any_value(e.n) AS edges FROM st JOIN (SELECT repo, count(*) AS n FROM edges GROUP BY repo) e USING (repo) GROUP BY repo")
def graph_stats(spark, d):
    n, e = drawn(spark, d)
    return R.graph_stats(states(n, e), e)


@query("SELECT count(DISTINCT repo) AS repos, count(*) AS nodes, CAST((SELECT count(*) FROM edges) AS BIGINT) AS edges, count(*) FILTER (state = 'used') AS used, count(*) FILTER (state = 'unused') AS unused, CAST(0 AS BIGINT) AS externals, max(inDeg + outDeg) AS max_degree FROM st")
def graph_totals(spark, d):
    n, e = drawn(spark, d)
    return R.graph_totals(R.graph_stats(states(n, e), e))


@query("SELECT repo, id, inDeg, outDeg FROM deg")
def degrees(spark, d):
    return R.degrees(nodes(spark, d), edges(spark, d)).select("repo", "id", "inDeg", "outDeg")


@query("SELECT DISTINCT repo, id FROM reached")
def reach(spark, d):
    n, e = drawn(spark, d)
    return G.reach(e, entries(n))


@query("SELECT repo, id, state FROM st")
def node_states(spark, d):
    return states(*drawn(spark, d)).select("repo", "id", "state")


@query("SELECT repo, id FROM st WHERE state = 'unused'")
def unreachable(spark, d):
    n, e = drawn(spark, d)
    return R.unreachable(n, G.reach(e, entries(n)))


@query("SELECT repo, id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS r FROM st WHERE state = 'unused') WHERE r <= 10")
def unused_sample(spark, d):
    return R.unused_sample(states(*drawn(spark, d)))


@query("SELECT DISTINCT repo, target AS id, 'external' AS type, 'used' AS state FROM outside")
def externals(spark, d):
    return R.externals(frame(spark, d, OUTSIDE).unionByName(edges(spark, d), allowMissingColumns=True), nodes(spark, d))


@query("SELECT repo, id, type FROM nodes UNION SELECT repo, target, 'external' FROM outside")
def all_nodes(spark, d):
    outside = frame(spark, d, OUTSIDE)
    return R.all_nodes(nodes(spark, d), R.externals(outside, nodes(spark, d))).select("repo", "id", "type")


@query("SELECT repo, source, target, kind, ord FROM (SELECT *, row_number() OVER (PARTITION BY repo, source, target, kind ORDER BY ord) AS r FROM outside) WHERE r = 1")
def dedupe_first(spark, d):
    return R.dedupe_first(frame(spark, d, OUTSIDE), ["repo", "source", "target", "kind"], ["ord"])


@query("SELECT repo, source, arg_max(target, {a: ord, b: target}) AS target FROM outside GROUP BY repo, source")
def last_wins_map(spark, d):
    return R.last_wins_map(frame(spark, d, OUTSIDE), "source", "target", F.struct("ord", "target"))


@query("SELECT repo, source, arg_min(target, ord * 100000 + CAST(substr(target, 6) AS BIGINT)) AS target FROM outside GROUP BY repo, source")
def first_hit(spark, d):
    return R.first_hit(frame(spark, d, OUTSIDE).withColumn("rank", F.expr("ord * 100000 + CAST(substr(target, 6) AS BIGINT)")), ["repo", "source"])


_ANCHOR = """files AS (SELECT repo, id AS path, CAST(regexp_extract(id, 'p([0-9]+)', 1) AS BIGINT) AS k, 'Shop.P' || CAST(k - k % 10 AS VARCHAR) AS namespace FROM nodes),
    a AS (SELECT repo, namespace, coalesce(min(path) FILTER (k % 10 = 0), min(path)) AS anchor FROM files GROUP BY ALL)"""


def _anchored(spark, d):
    """Ten files a namespace, which is named after the first of them."""
    k = F.regexp_extract("id", r"p(\d+)", 1).cast("long")
    return nodes(spark, d).select("repo", F.col("id").alias("path"), F.concat(F.lit("Shop.P"), k - k % 10).alias("namespace"))


@query(_ANCHOR + "=>SELECT * FROM a")
def namespace_anchor(spark, d):
    return R.namespace_anchor(_anchored(spark, d))


@query(_ANCHOR + ", p AS (SELECT f.repo, f.path, a.anchor FROM files f JOIN a USING (repo, namespace) WHERE f.path <> a.anchor)=>SELECT repo, path AS source, anchor AS target, 'namespace_peer' AS kind, 'heuristic' AS certainty FROM p UNION SELECT repo, anchor, path, 'namespace_peer', 'heuristic' FROM p")
def namespace_peers(spark, d):
    return R.namespace_peers(_anchored(spark, d), R.namespace_anchor(_anchored(spark, d)))


_NEAR = "b AS (SELECT repo, source AS id, target AS neighbor FROM edges UNION SELECT repo, target, source FROM edges), near AS (SELECT b.*, inDeg + outDeg AS degree FROM b JOIN deg ON deg.repo = b.repo AND deg.id = b.neighbor)"


@query(_NEAR + "=>SELECT * FROM near")
def neighbors(spark, d):
    return R.neighbors(edges(spark, d), nodes(spark, d))


@query(_NEAR + "=>SELECT repo, id, neighbor, degree, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY degree DESC, neighbor) AS r FROM near) WHERE r <= 5")
def top_neighbors(spark, d):
    return R.top_neighbors(edges(spark, d), nodes(spark, d), 5)


@query("SELECT repo, id, inDeg + outDeg AS degree FROM deg ORDER BY degree DESC, repo, id LIMIT 20")
def max_degree_nodes(spark, d):
    return R.max_degree_nodes(R.degrees(nodes(spark, d), edges(spark, d)), 20)


@query("SELECT repo, id, sizeLOC FROM nodes")
def sorted_nodes(spark, d):
    return R.sorted_nodes(nodes(spark, d).select("repo", "id", "sizeLOC"))


@query("SELECT repo, package, count(*) AS n, CAST(sum(sizeLOC) AS BIGINT) AS loc FROM nodes GROUP BY ALL")
def group_counts(spark, d):
    return R.group_counts(nodes(spark, d), "package")


@query("SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY id)::INTEGER AS i, count(*) OVER (PARTITION BY repo) AS n FROM nodes WHERE contains(lower(id), 'p1')")
def search_nodes(spark, d):
    return R.search_nodes(nodes(spark, d), "P1")


#: Repos 0 to 2 name entries, 3 to 5 only have files that nothing points to, 6 and 7 have neither.
_SOME = ("repo < 'repo3'", "repo >= 'repo6'")


@query(f"""d AS (SELECT * FROM deg WHERE repo < 'repo6' OR inDeg > 0)=>SELECT DISTINCT repo, id FROM entries WHERE {_SOME[0]}
    UNION SELECT repo, id FROM d WHERE NOT {_SOME[0]} AND repo < 'repo6' AND inDeg = 0 UNION SELECT repo, id FROM d WHERE repo >= 'repo6'""")
def entries_with_fallback(spark, d):
    """Each of the three ways: named entries, files nothing points to, all files."""
    files = R.degrees(nodes(spark, d), edges(spark, d)).where("repo < 'repo6' or inDeg > 0")
    return G.entries_with_fallback(entries(nodes(spark, d)).where(_SOME[0]), files)


@query("""n AS (SELECT *, repo IN ('repo2', 'repo3') AND is_entry AS flag FROM deg WHERE repo < 'repo6' OR outDeg = 0)=>SELECT repo, id FROM deg WHERE repo < 'repo2' AND sizeLOC = 3
    UNION SELECT repo, id FROM n WHERE flag UNION SELECT repo, id FROM n WHERE repo IN ('repo4', 'repo5') AND inDeg = 0 AND outDeg > 0
    UNION SELECT repo, min(id) FROM n WHERE repo >= 'repo6' GROUP BY repo""")
def normalize_entrypoints(spark, d):
    """Each of the four ways: listed ids, flagged nodes, roots with edges, the first node."""
    all_nodes = R.degrees(nodes(spark, d), edges(spark, d))
    n = all_nodes.where("repo < 'repo6' or outDeg = 0").withColumn("is_entry", F.col("is_entry") & F.col("repo").isin("repo2", "repo3"))
    return G.normalize_entrypoints(all_nodes.where("repo < 'repo2' and sizeLOC = 3").select("repo", "id"), n)


_DYN, _PH = "contains(lower(kind), 'dynamic')", "CASE WHEN phase = 'codegen' THEN 'build' ELSE phase END"


@query(f"SELECT repo, source, target, kind, phase, deferred AS is_deferred, {_DYN} AS is_dynamic, {_PH} AS edge_phase, CAST(1 + CASE WHEN NOT deferred THEN 2 ELSE 0 END + CASE WHEN NOT {_DYN} THEN 4 ELSE 0 END + CASE {_PH} WHEN 'runtime' THEN 56 WHEN 'test' THEN 16 ELSE 32 END AS INTEGER) AS mask FROM edges")
def edge_flags_and_masks(spark, d):
    return flagged(edges(spark, d)).select("repo", "source", "target", "kind", "phase", "is_deferred", "is_dynamic", "edge_phase", "mask")


@query("SELECT repo, name AS profile, source, target FROM edges JOIN profiles USING (repo) WHERE edges.profile IS NULL OR edges.profile = name")
def edges_by_profile(spark, d):
    return active(*drawn(spark, d)).drop("mask")


def _reached(n, e):
    return G.profile_reachability(active(n, e), entries(n), profiles(n))


_BITS = {1: "true", 2: "NOT deferred", 4: f"NOT {_DYN}", 8: f"{_PH} = 'runtime'", 16: f"{_PH} <> 'build'", 32: f"{_PH} <> 'test'"}
_ACT = "act AS (SELECT edges.*, name FROM edges JOIN profiles USING (repo) WHERE edges.profile IS NULL OR edges.profile = name)"
_SEED = "SELECT repo, name, id FROM entries JOIN profiles USING (repo)"
_WALKS = _ACT + "".join(f", w{b} AS ({_SEED} UNION SELECT a.repo, a.name, a.target FROM w{b} w JOIN act a ON a.repo = w.repo AND a.name = w.name AND a.source = w.id WHERE {c})" for b, c in _BITS.items())
_WALKS += ", masks AS (SELECT repo, name AS profile, id, CAST(sum(b) AS INTEGER) AS mask FROM (" + " UNION ALL ".join(f"SELECT DISTINCT *, {b} AS b FROM w{b}" for b in _BITS) + ") GROUP BY ALL)"


@query(_WALKS + "=>SELECT repo, profile, id, mask FROM masks")
def profile_reachability(spark, d):
    return _reached(*drawn(spark, d))


@query(_WALKS + "=>SELECT repo, id, list_sort(list(DISTINCT profile)) AS profiles FROM masks GROUP BY repo, id")
def reachable_profiles(spark, d):
    return R.reachable_profiles(_reached(*drawn(spark, d)))


def _classified(n, e):
    reached = G.stored(_reached(n, e))
    return G.classify(n.withColumn("dynamic_evidence", F.col("hasSideEffects")), reached, profiles(n), [r"p1\d*\.js$"])


_CLASS = _WALKS + """, any_ AS (SELECT DISTINCT repo, id FROM masks), grid AS (
    SELECT n.repo, n.id, p.name AS profile, coalesce(m.mask, 0) AS m, a.id IS NOT NULL AS anywhere, n."hasSideEffects" AS dyn
    FROM nodes n JOIN profiles p USING (repo) LEFT JOIN masks m ON m.repo = n.repo AND m.profile = p.name AND m.id = n.id LEFT JOIN any_ a ON a.repo = n.repo AND a.id = n.id),
    classes AS (SELECT repo, id, profile, CASE WHEN NOT anywhere THEN ['disconnected_all_profiles'] ELSE list_filter([
        CASE WHEN m & 1 > 0 THEN 'reachable_current' END, CASE WHEN m & 1 > 0 AND m & 2 = 0 THEN 'deferred_only' END,
        CASE WHEN m = 0 THEN 'reachable_other_profile' END,
        CASE WHEN (m & 1 > 0 AND m & 4 = 0) OR (m = 0 AND (dyn OR regexp_matches(id, 'p1[0-9]*[.]js$'))) THEN 'dynamic_only' END,
        CASE WHEN m & 1 > 0 AND m & 8 = 0 AND m & 16 > 0 THEN 'test_only' END, CASE WHEN m & 1 > 0 AND m & 8 = 0 AND m & 32 > 0 THEN 'build_time_only' END], lambda x: x IS NOT NULL) END AS statuses FROM grid)"""


@query(_CLASS + "=>SELECT * FROM classes")
def classify(spark, d):
    return _classified(*drawn(spark, d))


@query(_CLASS + "=>SELECT repo, id, profile, CASE WHEN list_contains(statuses, 'disconnected_all_profiles') THEN 'disconnected_all_profiles' WHEN list_contains(statuses, 'reachable_current') THEN 'reachable_current' WHEN list_contains(statuses, 'dynamic_only') THEN 'dynamic_only' ELSE 'reachable_other_profile' END AS status FROM classes")
def primary_status(spark, d):
    return _classified(*drawn(spark, d)).select("repo", "id", "profile", G.primary_status(F.col("statuses")).alias("status"))


def _viewed(n, e):
    return R.degrees(n, e).join(_classified(n, e).where("profile = 'dev'"), ["repo", "id"])


_VIEW = _CLASS + ", v AS (SELECT deg.*, statuses FROM deg JOIN classes c ON c.repo = deg.repo AND c.id = deg.id AND c.profile = 'dev'), fn AS (SELECT * FROM v WHERE inDeg + outDeg >= 2), fe AS (SELECT e.* FROM edges e JOIN fn a ON a.repo = e.repo AND a.id = e.source JOIN fn b ON b.repo = e.repo AND b.id = e.target WHERE NOT contains(lower(kind), 'dynamic'))"


def _filtered(n, e):
    return R.filter_graph(G.stored(_viewed(n, e)), flagged(e), hide_externals=True, hide_dynamic=True, min_degree=2)


@query(_VIEW + "=>SELECT repo, source, target, kind, phase FROM fe")
def filter_graph(spark, d):
    return _filtered(*drawn(spark, d))[1].select("repo", "source", "target", "kind", "phase")


@query(_VIEW + "=>SELECT repo, count(*) AS nodes, count(*) FILTER (list_contains(statuses, 'reachable_current')) AS reachable, count(*) FILTER (list_contains(statuses, 'disconnected_all_profiles')) AS disconnected, count(*) FILTER (list_contains(statuses, 'dynamic_only')) AS dynamic_only, coalesce(any_value(e.n), 0) AS edges FROM fn LEFT JOIN (SELECT repo, count(*) AS n FROM fe GROUP BY repo) e USING (repo) GROUP BY repo")
def hud_counts(spark, d):
    return R.hud_counts(*_filtered(*drawn(spark, d)))


@query(_VIEW + """=>SELECT repo, count(*) FILTER (inDeg + outDeg = 1) AS pure_leaves, count(*) FILTER ("hasSideEffects") AS side_effect_files, count(*) FILTER (list_contains(statuses, 'disconnected_all_profiles') AND inDeg + outDeg > 0) AS unused_attached, max(inDeg + outDeg) AS max_degree FROM v GROUP BY repo""")
def insights(spark, d):
    return R.insights(_viewed(*drawn(spark, d)))


@query("""seeds AS (SELECT repo, id FROM nodes WHERE "hasSideEffects"), w AS (SELECT * FROM seeds UNION SELECT e.repo, e.target FROM w JOIN edges e ON e.repo = w.repo AND e.source = w.id)=>SELECT n.repo, n.id, CASE WHEN w.id IS NULL THEN 'unused' ELSE 'used' END AS state FROM nodes n LEFT JOIN (SELECT DISTINCT * FROM w) w USING (repo, id)""")
def infer_usage_states(spark, d):
    n, e = drawn(spark, d)
    n = G.stored(R.degrees(n, e).withColumn("state", F.lit(None).cast("string")))
    return G.infer_usage_states(n, e).select("repo", "id", "state")


@query("""lv AS (SELECT DISTINCT repo, id, 0 AS d FROM entries UNION SELECT e.repo, e.target, l.d + 1 FROM lv l JOIN edges e ON e.repo = l.repo AND e.source = l.id WHERE l.d < 100),
    dist AS (SELECT repo, id, min(d) AS d FROM lv GROUP BY ALL),
    par AS (SELECT e.repo, e.target AS id, min(e.source) AS parent FROM edges e JOIN dist a ON a.repo = e.repo AND a.id = e.source JOIN dist b ON b.repo = e.repo AND b.id = e.target WHERE b.d = a.d + 1 GROUP BY ALL),
    up AS (SELECT repo, id AS target, id AS head, id AS path FROM dist SEMI JOIN nodes USING (repo, id) UNION ALL SELECT u.repo, u.target, p.parent, p.parent || '>' || u.path FROM up u JOIN par p ON p.repo = u.repo AND p.id = u.head)
    =>SELECT up.repo, target, path FROM up JOIN dist ON dist.repo = up.repo AND dist.id = up.head WHERE dist.d = 0""")
def explain_path(spark, d):
    """The whole path to every node that can be reached, ties by the smaller parent."""
    n, e = drawn(spark, d)
    return G.explain_path(e, entries(n), n).select("repo", "target", F.array_join("path", ">").alias("path"))
