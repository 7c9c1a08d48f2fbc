"""A mini repository of each language: what is found, what is external, what is reached."""

import json

import pytest
from pyspark.sql import functions as F

from codegraph_spark.operators import documents as D
from codegraph_spark.operators import exports as E
from codegraph_spark.operators import imports as I
from codegraph_spark.operators import manifests as M
from codegraph_spark.operators import modules as N
from codegraph_spark.operators import relations as R
from codegraph_spark.operators import resolve as X
from codegraph_spark.plans import jobs
from codegraph_spark.sources import files as S

REPOS = {
    "py": (
        {
            "src/pkg/__init__.py": "", "src/pkg/m.py": "from . import other\nimport pkg.sub.deep\nimport requests", "src/pkg/other.py": "from .sub.deep import x", "src/pkg/sub/__init__.py": "",
            "src/pkg/sub/deep.py": "import top\nfrom pkg import *", "top.py": "", "run.py": "import pkg.m\nif __name__ == '__main__':\n    pass", "lost.py": "from .gone import y",
        },
        {"pyproject.toml": '[project.scripts]\ntool = "top:main"\n'},
        {
            ("src/pkg/m.py", "src/pkg/other.py"), ("src/pkg/m.py", "src/pkg/sub/deep.py"), ("src/pkg/m.py", "pip:requests"), ("src/pkg/other.py", "src/pkg/sub/deep.py"),
            ("src/pkg/sub/deep.py", "top.py"), ("src/pkg/sub/deep.py", "src/pkg/__init__.py"), ("run.py", "src/pkg/m.py"), ("lost.py", "pip:lost"),
        },
        {"run.py", "top.py", "src/pkg/m.py", "src/pkg/other.py", "src/pkg/sub/deep.py", "src/pkg/__init__.py"},
    ),
    "go": (
        {"main.go": 'package main\nimport (\n "shop/a"\n "fmt"\n)\nfunc main() {}', "a/a.go": "package a", "a/a_test.go": "package a", "b/b.go": "package b"},
        {"go.mod": "module shop\n"},
        {("main.go", "a/a.go"), ("main.go", "std:fmt")},
        {"main.go", "a/a.go"},
    ),
    "rs": (
        {"src/main.rs": "mod a;\nuse crate::b::{c::{D, self}, e};\nuse serde::Serialize;\nuse unknown::X;", "src/a.rs": "", "src/b/c.rs": "", "src/b/e.rs": "", "tool.rs": "extern crate log;", "src/dead.rs": ""},
        {"Cargo.toml": '[package]\nname = "shop"\n[[bin]]\npath = "tool.rs"\n[dependencies]\nserde = "1"\n[dev-dependencies]\nrand = "1"\n[dependencies.log]\nversion = "1"\n'},
        {("src/main.rs", "src/a.rs"), ("src/main.rs", "src/b/c.rs"), ("src/main.rs", "src/b/e.rs"), ("src/main.rs", "crate:serde"), ("tool.rs", "crate:log")},
        {"src/main.rs", "src/a.rs", "src/b/c.rs", "src/b/e.rs", "tool.rs"},
    ),
    "java": (
        {
            "A.java": "package p;\nimport p.q.B;\nimport static p.q.B.run;\nimport p.w.*;\nimport java.util.List;\npublic class A { public static void main(String[] a) {} }", "B.java": "package p.q;\nclass First {}\n// public class No {}\npublic class B {}",
            "C.java": "package p.w;\npublic enum C { X }", "D.java": "class D {}",
        },
        {},
        {("A.java", "B.java"), ("A.java", "C.java"), ("A.java", "java:java.util")},
        {"A.java", "B.java", "C.java"},
    ),
    "kt": (
        {
            "Main.kt": "package p\nimport p.q.Thing\nimport p.tools.*\nimport x.y.Loose\nimport kotlin.io.println\nfun main() {}", "a/Thing.kt": "package p.q\ndata class Thing(val a: Int)", "b/Tools.kt": "package p.tools\nfun tool() = 1",
            "src/main/kotlin/x/y/Loose.kt": "fun loose() = 1", "Dead.kt": "package p.dead\nobject Dead",
        },
        {},
        {("Main.kt", "a/Thing.kt"), ("Main.kt", "b/Tools.kt"), ("Main.kt", "src/main/kotlin/x/y/Loose.kt"), ("Main.kt", "kotlin:kotlin.io")},
        {"Main.kt", "a/Thing.kt", "b/Tools.kt", "src/main/kotlin/x/y/Loose.kt"},
    ),
    "cs": (
        {"Program.cs": "using Shop.Core;\nusing System.Text;\nusing static Shop.Core.Util;", "src/Shop/Core/Util.cs": "namespace Shop.Core;", "Core.cs": "namespace Shop.Core { class C {} }", "Other.cs": "namespace Other;"},
        {},
        {("Program.cs", "Core.cs"), ("Program.cs", "dotnet:System"), ("Program.cs", "src/Shop/Core/Util.cs"), ("src/Shop/Core/Util.cs", "Core.cs"), ("Core.cs", "src/Shop/Core/Util.cs")},
        {"Program.cs", "Core.cs", "src/Shop/Core/Util.cs"},
    ),
    "dart": (
        {"bin/main.dart": "import 'package:shop/a.dart' show A, B hide C;\nimport 'dart:io';\nvoid main() {}", "lib/a.dart": "part 'b.dart';", "lib/b.dart": "part of 'a.dart';", "lib/dead.dart": ""},
        {"pubspec.yaml": "name: shop\n"},
        {("bin/main.dart", "lib/a.dart"), ("bin/main.dart", "dart:io"), ("lib/a.dart", "lib/b.dart"), ("lib/b.dart", "lib/a.dart")},
        {"bin/main.dart", "lib/a.dart", "lib/b.dart"},
    ),
    "js": (
        {"src/index.ts": "import { a } from './a';", "src/a.js": "export { x as default } from './b';", "src/b.js": "", "dead.js": "", "cli.js": ""},
        {"package.json": '{"main": "./cli.js"}'},
        {("src/index.ts", "src/a.js"), ("src/a.js", "src/b.js")},
        {"src/index.ts", "src/a.js", "src/b.js", "cli.js"},
    ),
}


def table(spark, texts):
    return spark.createDataFrame([("r", p, t) for p, t in texts.items()] or [], "repo string, path string, content string")


@pytest.mark.parametrize("lang", REPOS)
def test_crawl(spark, lang):
    files, manifests, edges, used = REPOS[lang]
    src = table(spark, files)
    graph = jobs.crawl_graph(src, src.select("repo", "path"), lang, manifests=table(spark, manifests))
    assert {(r["source"], r["target"]) for r in graph.edges.collect()} == edges
    nodes = {r["id"]: (r["type"], r["state"]) for r in graph.nodes.collect()}
    assert {i for i, (kind, state) in nodes.items() if kind == "file" and state == "used"} == used
    assert {i for i, (kind, _) in nodes.items() if kind == "external"} == {t for _, t in edges if t not in files}
    assert set(files) <= set(nodes)


def test_empty_crawls(spark):
    none = table(spark, {})
    for lang in jobs.LANGUAGES:
        assert jobs.crawl_graph(none, none.select("repo", "path"), lang).nodes.isEmpty()


def test_python_modules(spark):
    paths = ["a/__init__.py", "a/b/__init__.py", "a/b/c.py", "a/x/y.py", "z.py", "s/t.py", "a/b/no.txt"]
    got = {r["path"]: r["module"] for r in N.python_modules(table(spark, dict.fromkeys(paths, ""))).collect()}
    assert got == {"a/__init__.py": "a", "a/b/__init__.py": "a.b", "a/b/c.py": "a.b.c", "a/x/y.py": "a.x.y", "z.py": "z", "s/t.py": "t"}


def test_unresolved_imports(spark):
    src = table(spark, {"src/index.ts": "import { a } from './a';\nimport z from 'zod';\nimport q from './gone';", "src/a.js": ""})
    imports = I.js_imports(src)
    edges = X.resolve_js(imports, src)
    assert {r["spec"] for r in R.unresolved_imports(imports, edges).collect()} == {"zod", "./gone"}
    py = table(spark, {"a.py": "import b, c\nfrom b import x", "b.py": ""})
    found = I.py_imports(py)
    assert {r["module"] for r in R.unresolved_imports(found, X.resolve_python(found, py)).collect()} == {"c"}


def test_rust_groups_cargo_names_and_dart_names(spark):
    got = I.rust_imports(table(spark, {"a.rs": "use a::{b, c::{d as e, self}, f};\npub use x;\nuse m::*;"})).collect()
    assert sorted(r["spec"] for r in got) == ["a::b", "a::c", "a::c::d", "a::f", "m::*", "x"]
    cargo = table(spark, {"Cargo.toml": REPOS["rs"][1]["Cargo.toml"]})
    assert {r["name"] for r in M.cargo_dependencies(cargo).collect()} == {"serde", "rand", "log"}
    row = I.dart_imports(table(spark, {"m.dart": "import 'a.dart' as a show A, B hide C;"})).first()
    assert (row["alias"], row["show"], row["hide"]) == ("a", ["A", "B"], ["C"])


def test_js_export_lists(spark):
    text = "export type { T } from './t';\nexport { x as default } from './x';\nexport * as ns from './n';\nexport { a, type U, b as c };\nexport { type V as W } from './v';"
    got = {(r["grp"], r["name"]) for r in E.js_exports(table(spark, {"m.ts": text})).collect()}
    assert {("types", "T"), ("default", "x"), ("named", "ns"), ("named", "a"), ("types", "U"), ("named", "c"), ("types", "W"), ("starReexports", "./n")} <= got
    assert not {("named", "T"), ("named", "default"), ("named", "U"), ("named", "b"), ("named", "W")} & got


def test_paths_with_blanks_and_plus(spark, tmp_path):
    folder = tmp_path / "a b" / "c+d%41"
    folder.mkdir(parents=True)
    (folder / "x.js").write_text("eval(a)")
    assert [r["path"] for r in S.read_sources(spark, str(tmp_path), "js").collect()] == ["a b/c+d%41/x.js"]


def documents(spark, *docs):
    rows = [("r", n, json.dumps(x)) for n, x in enumerate(docs)]
    return spark.createDataFrame(rows, "repo string, seq long, body string").select("repo", "seq", F.try_parse_json("body").alias("doc"))


def test_classify_by_profiles_evidence_and_places(spark):
    nodes = [{"id": i, "type": "file"} for i in "abcdefg"]
    nodes[0]["isEntrypoint"] = True
    nodes[1] |= {"meta": {"realPath": "C:\\app\\b.js"}, "securityFindings": [{"id": "own"}], "exports": {"named": ["one"]}}
    nodes[4]["events"] = [{"type": "lazyload"}]
    edges = [
        {"source": "a", "target": "b", "profiles": ["dev"]}, {"source": "a", "target": "c", "when": "prod, stage"}, {"source": "a", "target": "d", "flags": {"beta": True}},
        {"source": "a", "target": "e", "profile": "prod"}, {"source": "a", "target": "f", "profiles": []}, {"source": "a", "target": "f", "profiles": ["none"]},
    ]
    doc = {"nodes": nodes, "edges": edges, "profiles": [{"name": "dev", "flags": {"beta": "yes"}}, "prod"], "securityFindings": {"c:/app/b.js": [{"id": "x"}, {"id": "own"}]}, "exports": {"C:/app/b.js": {"named": ["one", "two"]}}}
    rows = jobs.merge_and_classify(documents(spark, doc)).collect()
    got = {(r["id"], r["profile"]): r["status"] for r in rows}
    assert [got[i, "dev"] for i in "abcdefg"] == ["reachable_current", "reachable_current", "reachable_other_profile", "reachable_current", "dynamic_only", "reachable_current", "disconnected_all_profiles"]
    assert [got[i, "prod"] for i in "abcdefg"] == ["reachable_current", "reachable_other_profile", "reachable_current", "reachable_other_profile", "reachable_current", "reachable_current", "disconnected_all_profiles"]
    b = next(r for r in rows if r["id"] == "b")
    assert (b["n_findings"], b["exports"]) == (2, {"named": ["one", "one", "two"]})
    assert {r["id"]: r["state"] for r in rows} == {**dict.fromkeys("abcdef", "used"), "g": "unused"}
    extra = D.collect_edges(documents(spark, {"edges": [{"source": "a", "target": "b", "weight": 2, "note": "n"}]})).first()["extra"]
    assert json.loads(extra) == {"note": "n", "weight": 2}


def test_graph_documents_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("r", f"n{i}", "file", "used", i) for i in range(25)] + [("s", "m", "file", "unused", 1)], "repo string, id string, type string, state string, sizeLOC int")
    edges = spark.createDataFrame([("r", "n1", "n2", "import")], "repo string, source string, target string, kind string")
    findings = spark.createDataFrame([("r", "n1", "x", "high"), ("r", "n1", "y", "low")], "repo string, path string, id string, severity string")
    exports = spark.createDataFrame([("r", "n2", "named", "b"), ("r", "n2", "named", "a"), ("r", "n2", "types", "T")], "repo string, path string, grp string, name string")
    sections = {"nodes": nodes, "edges": edges, "securityFindings": findings, "exports": exports, "entrypoints": nodes.where("id = 'm'").select("repo", "id"), "packageRisks": nodes.limit(0)}
    assert S.graph_documents(sections, rows=10).where("repo = 'r'").count() >= 5
    S.write_graph_documents(sections, str(tmp_path / "out"))
    docs = S.read_graph_documents(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in D.merge_nodes(D.node_rows(docs)).select("repo", "id", "type", "state", "sizeLOC").collect()} == {tuple(r) for r in nodes.collect()}
    assert [(r["source"], r["target"], r["kind"]) for r in D.collect_edges(docs).collect()] == [("n1", "n2", "import")]
    assert {(r["path"], r["id"], r["severityNormalized"]) for r in D.ingest_findings(docs).collect()} == {("n1", "x", "high"), ("n1", "y", "low")}
    assert {(r["grp"], tuple(r["items"])) for r in D.ingest_exports(docs).collect()} == {("named", ("a", "b")), ("types", ("T",))}
    assert [tuple(r) for r in D.merge_entrypoints(docs).collect()] == [("s", "m")]


def test_reports_are_graph_documents(spark, tmp_path):
    (tmp_path / "dartSecurity.json").write_text(json.dumps({"findings": [{"file": "a.dart", "id": "x"}], "summary": {"total": 1}}))
    (tmp_path / "dartExports.json").write_text(json.dumps({"a.dart": {"classes": ["W"]}}))
    docs = S.read_graph_fragments(spark, str(tmp_path))
    assert [(r["path"], r["id"]) for r in D.ingest_findings(docs).collect()] == [("a.dart", "x")]
    assert [(r["path"], r["grp"], r["items"]) for r in D.ingest_exports(docs).collect()] == [("a.dart", "classes", ["W"])]
