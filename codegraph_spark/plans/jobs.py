"""From files to a graph, from graph documents to statuses, from files to findings: only chains of operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.findings import edge_active, edge_flags, edge_mask
from ..operators import calls as C
from ..operators import documents as D
from ..operators import graph as G
from ..operators import imports as I
from ..operators import manifests as M
from ..operators import modules as N
from ..operators import relations as R
from ..operators import resolve as X
from ..operators import scan as S

LANGUAGES = ("js", "py", "go", "rs", "java", "kt", "cs", "dart")
FINDING = ["repo", "path", "id", "severity", "severityNormalized", "line", "code"]


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    entries: DataFrame


def _named(ids: DataFrame, column: str = "path") -> DataFrame:
    return ids.select("repo", F.col(column).alias("id")).where("id is not null")


def _with_degrees(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    return nodes.join(degrees, ["repo", "id"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("inDeg", "outDeg")})


def crawl_edges(files: DataFrame, repo_paths: DataFrame, lang: str, manifests: DataFrame, packages: bool = False) -> DataFrame:
    """Edges of the language's imports; see the resolvers. Each (source, target, kind) once. packages: imports of whole packages
    lead through one node a package."""
    if lang == "js":
        edges = X.resolve_js(R.dedupe_imports(I.js_imports(files)), repo_paths)
    elif lang == "py":
        edges = X.resolve_python(I.py_imports(files), repo_paths)
    elif lang == "go":
        edges = X.resolve_go(I.go_imports(files), files, I.manifest_names(manifests), packages)
    elif lang == "rs":
        edges = X.resolve_rust(I.rust_imports(files), repo_paths, M.cargo_dependencies(manifests))
    elif lang in ("java", "kt"):
        names, imports = G.stored(N.jvm_names(files, lang)), G.stored(I.jvm_imports(files))
        edges = X.resolve_fqn(imports, names, lang, repo_paths).unionByName(X.resolve_wildcard(imports, names, lang, packages), allowMissingColumns=True)
    elif lang == "cs":
        spaces = files.select("repo", "path", I.declared_package("cs").alias("namespace")).where("namespace is not null")
        spaces, imports = G.stored(spaces), G.stored(I.csharp_imports(files))
        anchors = R.namespace_anchor(spaces)
        peers = R.namespace_peers(spaces, anchors.select("repo", "namespace", "anchor")).withColumn("internal", F.lit(True))
        edges = X.resolve_csharp(imports, anchors, repo_paths).unionByName(peers, allowMissingColumns=True)
    else:
        package = manifests.where(F.substring_index("path", "/", -1) == "pubspec.yaml").select("repo", F.nullif(F.regexp_extract("content", r"(?m)^name:\s*(\w+)", 1), F.lit("")).alias("package"))
        edges = X.resolve_dart(I.dart_imports(files), repo_paths, package.where("package is not null"))
    return edges.dropDuplicates(["repo", "source", "target", "kind"])


def crawl_entries(files: DataFrame, repo_paths: DataFrame, lang: str, manifests: DataFrame) -> DataFrame:
    """(repo, id): where programs start, by the files' own main, by manifests and by well-known paths; ids may be no files."""
    listed = M.manifest_entries(manifests)
    if lang == "js":
        fixed = repo_paths.where(F.col("path").isin(*N.JS_ENTRY_PATHS))
        return _named(listed.where("kind = 'file' and path like '%package.json'"), "entry").union(_named(fixed)).distinct()
    mains = _named(files.where(I.has_main(lang)))
    if lang == "py":
        scripts = listed.where("kind = 'module'").select("repo", F.col("entry").alias("module"))
        return mains.union(X.entry_files(scripts, N.python_modules(repo_paths))).distinct()
    if lang == "rs":
        bins = _named(listed.where("kind = 'file' and path like '%Cargo.toml'"), "entry")
        return mains.union(bins).union(_named(files.where("path = 'src/main.rs'"))).distinct()
    if lang == "cs":
        program = _named(files.where(F.lower(F.substring_index("path", "/", -1)) == "program.cs"))
        first = files.groupBy("repo").agg(F.min("path").alias("id"))
        return G.by_priority([mains.union(program), first])
    if lang == "dart":
        own = _named(listed.where("kind = 'file' and path like '%pubspec.yaml'"), "entry")
        return mains.union(own).union(_named(files.where(F.col("path").isin(*N.DART_ENTRY_PATHS)))).distinct()
    return mains


def crawl_graph(files: DataFrame, repo_paths: DataFrame, lang: str, entries: DataFrame | None = None, manifests: DataFrame | None = None) -> Graph:
    """The dependency graph of source files (repo, path, content) of a language (js, py, go, rs, java, kt, cs or dart): nodes with
    size, degrees and state.

    repo_paths(repo, path) has all files, also those that are no sources; a target among them that is no source is external.
    entries(repo, id) may name entries beside those that mains, manifests(repo, path, content) and well-known paths tell. Only
    in JS, where none is told, files that nothing points to are taken, else all; in C# the first file. In Dart a file with any
    edge is used. Empty inputs give empty graphs; rows with null content are files without imports.
    """
    if lang not in LANGUAGES:
        raise ValueError(f"no crawl for {lang!r}; there are {', '.join(LANGUAGES)}")
    if manifests is None:
        manifests = files.select("repo", "path", F.lit(None).cast("string").alias("content")).limit(0)
    # an import of a package leads through one node: imports and files, not their product
    edges = G.cut(crawl_edges(files, repo_paths, lang, manifests, packages=True))
    packed = lang in ("go", "java", "kt")
    if packed:
        edges = X.disjoint_packages(edges)
    own = files.select("repo", F.col("path").alias("id"), F.lit("file").alias("type"), F.lit(lang).alias("lang"), T.loc(F.col("content")).alias("sizeLOC"))
    active = edges.where("kind = 'side_effect'").select("repo", F.col("source").alias("id"), F.lit(True).alias("hasSideEffects")).distinct()
    own = own.join(active, ["repo", "id"], "left").withColumn("hasSideEffects", F.coalesce("hasSideEffects", F.lit(False)))
    nodes = R.all_nodes(own, R.externals(edges.where(~F.col("target").startswith(X.PACKAGE)) if packed else edges, own))
    nodes = _with_degrees(nodes, X.package_degrees(edges)) if packed else R.degrees(nodes, edges)
    named = crawl_entries(files, repo_paths, lang, manifests)
    if entries is not None:
        named = named.union(entries.select("repo", "id")).distinct()
    sources = nodes.where("type = 'file'")
    start = G.entries_with_fallback(named, sources) if lang == "js" else named.join(sources, ["repo", "id"], "left_semi")
    start = G.stored(start.select("repo", "id"))
    effects = edges.where("kind = 'side_effect'").select("repo", F.col("target").alias("id"))
    return Graph(G.node_states(nodes, G.reach(edges, start), effects if lang == "js" else None, any_degree=lang == "dart"), X.without_packages(edges) if packed else edges, start)


def merge_and_classify(docs: DataFrame, keep_rules=()) -> DataFrame:
    """(repo, id, profile, statuses, status, state, inDeg, outDeg, n_findings, exports) of all nodes in graph documents
    (repo, seq, doc), for every profile of the documents (`profiles`, `profile` or `targets`; none: `default`).

    An edge counts in a profile as its profiles, profile, when and flags say. States that no document tells are inferred. n_findings
    and exports: a node's own and those that the documents hold under one of its places.
    """
    docs = G.stored(docs)  # made once, however often the job walks them
    edges = G.cut(D.collect_edges(docs))
    nodes = G.cut(R.degrees(D.merge_nodes(D.node_rows(docs)), edges))
    nodes = G.cut(G.infer_usage_states(nodes, edges))
    given = F.coalesce(*[F.try_variant_get("doc", f"$.{k}", "variant") for k in ("profiles", "profile", "targets")], F.parse_json(F.lit("[]")))
    texts = docs.select("repo", F.to_json(given).alias("text")).distinct()  # many documents say the same
    profiles = G.normalize_profiles(G.stored(texts.select("repo", F.parse_json("text").alias("doc"))))
    told = profiles.where("name <> 'default'").select("repo", F.lit(True).alias("told")).distinct()
    profiles = profiles.join(told, "repo", "left").where("told or name = 'default'").select("repo", "name", F.coalesce("flags", F.create_map().cast("map<string,string>")).alias("gates")).dropDuplicates(["repo", "name"])
    profiles = G.cut(profiles)
    flags = edge_flags(F.col("kind"), F.col("phase"), F.col("deferred"), F.col("dynamic"))
    grid = edges.withColumns(flags).join(profiles, "repo")
    grid = grid.where(edge_active(F.col("profiles"), F.col("profile"), F.col("when"), F.col("flags"), F.col("name"), F.col("gates")))
    walked = grid.select("repo", F.col("name").alias("profile"), "source", "target", edge_mask(F.col("is_deferred"), F.col("is_dynamic"), F.col("edge_phase")).alias("mask"))
    entries = G.cut(G.normalize_entrypoints(G.cut(D.merge_entrypoints(docs)), nodes))
    classes = G.classify(nodes, G.cut(G.profile_reachability(G.stored(walked), entries, profiles)), profiles, keep_rules)
    found = D.node_findings(docs, nodes).groupBy("repo", F.col("path").alias("id")).agg(F.count("*").alias("n_findings"))
    exported = D.node_exports(docs, nodes).withColumnRenamed("path", "id")
    out = classes.join(nodes.select("repo", "id", "state", "inDeg", "outDeg"), ["repo", "id"]).join(found, ["repo", "id"], "left").join(exported, ["repo", "id"], "left")
    return out.withColumns({"status": G.primary_status(F.col("statuses")), "n_findings": F.coalesce("n_findings", F.lit(0).cast("long"))})


def scan_sources(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Findings of source files (repo, path, lang, content): the language's rules, and the secret rules on every file. With
    manifests(repo, path, content), each package risk is a finding of its manifest too (id `package.` and the kind of risk)."""
    js, py, dart = (files.where(F.col("lang") == x) for x in ("js", "py", "dart"))
    found = [S.scan_js_patterns(js), S.scan_js_lines(js), C.scan_js_calls(js), S.xhr_without_csrf(S.js_lines(js)), S.scan_python(py), S.scan_dart_api(dart), S.scan_secrets(files)]
    if manifests is not None:
        told = F.concat_ws(" ", "scope", "name", "detail")
        found.append(M.package_risks(manifests).select("repo", F.lit("package.json").alias("path"), F.concat(F.lit("package."), "risk").alias("id"), F.lit("med").alias("severity"), F.lit("med").alias("severityNormalized"), F.lit(None).cast("int").alias("line"), told.alias("code")))
    out = found[0].select(FINDING)
    for f in found[1:]:
        out = out.unionByName(f.select(FINDING))
    return out
