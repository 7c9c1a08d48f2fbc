import json

from pyspark.sql import functions as F

from codegraph_spark.operators import documents as D
from codegraph_spark.operators import exports as E
from codegraph_spark.operators import manifests as M


def docs(spark, *bodies):
    rows = [("r", n, b if isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "repo string, seq long, body string").select("repo", "seq", F.try_parse_json("body").alias("doc"))


def files(spark, path, content):
    return spark.createDataFrame([("r", path, content), ("r", "null", None), ("r", "empty", "")], "repo string, path string, content string")


def test_edges_of_any_shape(spark):
    one = {"graph": {"edges": [{"source": {"path": "a"}, "target": "b", "kind": "import"}, {"source": "a"}], "relationships": {"list": [{"from": "b", "to": {"id": 3}, "type": "x"}]}}}
    two = {"deep": [[{"u": "c:\\p\\a.js", "v": ["", "b"]}]], "edges": [{"source": "a", "target": "b", "kind": "import"}], "n": [1, 2]}
    got = {(r["source"], r["target"], r["kind"]) for r in D.collect_edges(docs(spark, one, two, "[]", "not json", "7")).collect()}
    assert got == {("a", "b", "import"), ("b", "3", "x"), ("C:/p/a.js", "b", None)}
    assert D.collect_edges(docs(spark, one).limit(0)).count() == 0


def test_findings_of_any_shape(spark):
    f = {"id": "rule.eval", "message": "m", "severity": "High"}
    by_path = {"securityFindings": {"c:\\app\\a.js": [f, f]}}
    nodes = {"nodes": [{"id": "n", "security": {"findings": [f]}, "meta": {"securityFindings": [dict(f, id="other")]}}]}
    records = {"securityFindings": [{"path": "p", "findings": [f]}, {"source": "q", "id": "direct", "severity": "low", "line": 4}]}
    got = {(r["path"], r["id"], r["severityNormalized"], r["line"]) for r in D.ingest_findings(docs(spark, by_path, nodes, records)).collect()}
    assert got == {("C:/app/a.js", "rule.eval", "high", None), ("n", "rule.eval", "high", None), ("n", "other", "high", None), ("p", "rule.eval", "high", None), ("q", "direct", "low", 4)}
    report = docs(spark, {"findings": [dict(f, file="z.dart")]}).withColumn("doc", D.adapt_report(F.col("doc")))
    assert [r["path"] for r in D.ingest_findings(report).collect()] == ["z.dart"]


def test_entrypoints_exports_and_nodes(spark):
    d = docs(spark, {"entrypoints": ["a", {"id": "b"}], "entries": {"list": [{"path": "c:/x"}, 5]}}, {"entries": ["a"], "exports": {"lib\\f.js": {"named": ["x", {"name": "y"}]}}}, {"exports": {"lib/f.js": {"named": ["z", "x"]}}})
    assert {r["id"] for r in D.merge_entrypoints(d).collect()} == {"a", "b", "C:/x"}
    assert [(r["path"], r["grp"], r["items"]) for r in D.ingest_exports(d).collect()] == [("lib/f.js", "named", ["x", '{"name":"y"}', "z"])]
    n = spark.createDataFrame([("r", 1, "a", "unused", None, 3), ("r", 2, "a", "used", "js", 2), ("r", 3, "a", "unused", "py", None)], "repo string, seq long, id string, state string, lang string, sizeLOC int")
    assert [tuple(r) for r in D.merge_nodes(n).select("id", "state", "sizeLOC", "lang").collect()] == [("a", "used", 3, "js")]


def test_js_exports(spark):
    code = """export function f() {}
export default class K extends B {}
export const a = g(1, 2), b = {c: 1};
export { x, y as z } from './m';
export * from "./n"; // export class Gone {}
export type T = string;
exports.q = 1;
module.exports = { r, 's': 2 };
export const { h, i: j } = o;
"""
    got = {(r["grp"], r["name"]) for r in E.js_exports(files(spark, "a.js", code)).collect()}
    named = {("named", n) for n in ("f", "a", "b", "x", "z", "q", "r", "s", "h", "j")}
    assert got == named | {("functions", "f"), ("classes", "K"), ("default", "class K"), ("variables", "a"), ("variables", "b"), ("variables", "h"), ("variables", "j"), ("types", "T"), ("reexports", "./m"), ("reexports", "./n"), ("starReexports", "./n")}
    assert dict(E.exports_map(E.js_exports(files(spark, "a.js", code))).first()["exports"])["variables"] == ["a", "b", "h", "j"]


def test_py_exports(spark):
    code = "import os.path\nfrom .m import x as y, *\ndef f(a):\n    z = 1\nclass C:\n    pass\nv: int = 2\n_p = 3\ns = '''\ndef no(): pass\n'''\n__all__ = ['f', \"C\"]\n__all__ += names\n__all__.append('v')\n"
    src = files(spark, "a.py", code)
    got = {(r["grp"], r["name"], r["kind"], r["line"]) for r in E.py_exports(src).collect()}
    assert got == {("exports", "f", "function", 3), ("exports", "C", "class", 5), ("exports", "v", "variable", 7), ("exports", "s", "variable", 9), ("reexports", "os", "os.path", 1), ("reexports", "y", ".m", 2), ("starImports", ".m", None, 2), ("all", "f", None, None), ("all", "C", None, None), ("all", "v", None, None)}
    assert {(r["path"], r["has_all"], r["uncertain"]) for r in E.py_export_certainty(src).collect()} == {("a.py", True, True), ("null", False, False), ("empty", False, False)}


def test_manifests(spark):
    pkg = {"main": "./m.js", "exports": {".": {"import": "i.mjs", "n": 1}, "x": "x.js"}, "dependencies": {"a": "^1", "b": "1.0", "c": 3}, "scripts": {"postinstall": "curl http://x", "t": "echo hi"}}
    lock = {"packages": {"node_modules/old": {"deprecated": "gone"}}, "dependencies": {"old": {"deprecated": "later"}}}
    audit = {"vulnerabilities": {"v": {"severity": "high", "via": ["p", {"q": 1}, "r", "s"]}}, "advisories": {"1": {"module_name": "v", "severity": "low"}, "2": {"module_name": "w", "severity": "low"}}}
    rows = [("r", "package.json", json.dumps(pkg)), ("r", "package-lock.json", json.dumps(lock)), ("r", "npm-audit.json", json.dumps(audit)), ("r", "p/package.json", "broken {"), ("r", "pyproject.toml", '[project.scripts]\nrun = "a.b:main"\n[other]\nz = "c:d"\n'), ("r", "setup.cfg", "[options.entry_points]\nconsole_scripts =\n    x = s.t:go\n\n[next]\n"), ("r", "Cargo.toml", '[[bin]]\nname = "z"\npath = "src/z.rs"\n[dependencies]\n'), ("r", "a.csproj", "<OutputType>Exe</OutputType>"), ("r", "pubspec.yaml", "name: app\n"), ("r", "package.json", None)]
    m = spark.createDataFrame(rows, "repo string, path string, content string")
    got = {(r["kind"], r["entry"]) for r in M.manifest_entries(m).collect()}
    assert got == {("file", "m.js"), ("file", "i.mjs"), ("file", "x.js"), ("file", "src/z.rs"), ("file", "lib/app.dart"), ("module", "a.b"), ("module", "s.t"), ("project", "a.csproj")}
    risks = {(r["risk"], r["name"], r["detail"]): r["via"] for r in M.package_risks(m).collect()}
    assert set(risks) == {("looseVersions", "a", "^1"), ("riskyScripts", "postinstall", "curl http://x"), ("installScripts", "postinstall", "curl http://x"), ("deprecatedPackages", "old", "later"), ("knownVulnerabilities", "v", "high"), ("knownVulnerabilities", "w", "low")}
    assert risks["knownVulnerabilities", "v", "high"] == ["p", '{"q":1}', "r"]


def test_nested_exports_merge(spark):
    """Lists join, maps merge key by key, other kinds and scalars are replaced by the newest, nulls change nothing."""
    rounds = (
        {"exports": {"lib\\f.js": {"a": ["x", {"n": 1}], "m": {"k": {"deep": ["p"], "one": 1}, "gone": [1]}, "s": "old", "l": ["first"], "e": {}}}},
        {"exports": {"lib/f.js": {"a": [{"n": 1}, "y", "x"], "m": {"k": {"deep": ["q", "p"], "two": None}, "gone": 5}, "s": None, "l": "text"}}},
        {"exports": {"lib/f.js": {"m": {"k": {"one": 2}}, "s": "new", "l": ["again"], " ": [1]}, "lib/g.js": {"only": None, "q\"": [[1, 2], [1, 2]]}}},
        {"exports": [1]}, {"nodes": []}, "broken",
    )
    got = {(r["path"], r["grp"]): json.loads(r["value"]) for r in D.merge_export_groups(docs(spark, *rounds)).collect()}
    assert got == {
        ("lib/f.js", "a"): ["x", {"n": 1}, "y"], ("lib/f.js", "m"): {"gone": 5, "k": {"deep": ["p", "q"], "one": 2}}, ("lib/f.js", "s"): "new", ("lib/f.js", "l"): ["again"],
        ("lib/f.js", "e"): {}, ("lib/g.js", 'q"'): [[1, 2]],
    }
    assert D.merge_export_groups(docs(spark, rounds[0]).limit(0)).count() == 0


def test_documents_are_dealt_over_all_tasks_before_they_are_made(spark):
    """One file of order lines is read in one task; its documents are made in as many as a shuffle has."""
    from codegraph_spark.queries import documents

    docs = documents.graph_documents(spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert docs.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
