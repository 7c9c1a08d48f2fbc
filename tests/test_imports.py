from codegraph_spark.operators import imports as I
from codegraph_spark.operators import resolve as X
from codegraph_spark.sources import files as S


def _src(spark, *files):
    return spark.createDataFrame([("r", p, t) for p, t in files], "repo string, path string, content string")


def _pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_js(spark):
    text = "import './a';\nimport D, { x as y, type T } from '../lib';\nexport { q } from './b.js';\nexport * from 'pkg';\nconst f = require('./d'), g = import('./e');\n// import './no'\n"
    got = I.js_imports(_src(spark, ("src/m.js", text), ("src/n.js", None)))
    assert _pairs(got, "line", "kind", "spec") == [(1, "side_effect", "./a"), (2, "import", "../lib"), (3, "reexport", "./b.js"), (4, "reexport", "pkg"), (5, "dynamic", "./e"), (5, "require", "./d")]
    two = got.where("line = 2").first()
    assert (two.default_name, two.named, two.named_original, two.type_only) == ("D", ["y", "T"], ["x", "T"], ["T"])
    have = spark.createDataFrame([("r", p) for p in ("src/a.ts", "src/a.js", "lib/index.js", "src/b.js", "src/m.js")], "repo string, path string")
    assert _pairs(X.resolve_js(got, have), "target") == [("./d",), ("./e",), ("lib/index.js",), ("pkg",), ("src/a.ts",), ("src/b.js",)]


def test_python(spark):
    text = "import os, a.b as c\nfrom .m import (x as y,\n  z)\nfrom ..up import *\n'''\nimport no\n'''\n"
    got = I.py_imports(_src(spark, ("p/q/f.py", text)))
    assert _pairs(got, "line", "kind", "module") == [(1, "import", "a.b"), (1, "import", "os"), (2, "from_relative", "m"), (2, "from_relative", "m"), (4, "import_star", "up")]
    have = spark.createDataFrame([("r", p) for p in ("a/b.py", "p/__init__.py", "p/q/__init__.py", "p/q/f.py", "p/q/m.py", "p/q/m/z.py", "p/up/__init__.py")], "repo string, path string")
    assert _pairs(X.resolve_python(got, have), "target", "certainty") == [("a/b.py", "static"), ("p/q/m.py", "static"), ("p/q/m/z.py", "static"), ("p/up/__init__.py", "static"), ("pip:os", "heuristic")]


def test_go_and_jvm(spark):
    src = _src(spark, ("main.go", 'package main\nimport (\n  "fmt"\n  u "ex.com/m/util"\n)\nfunc main() {}\n'), ("util/a.go", "package util\n"), ("util/a_test.go", "package util\n"))
    mods = I.manifest_names(_src(spark, ("go.mod", "module ex.com/m\n")))
    assert _pairs(X.resolve_go(I.go_imports(src), src, mods), "target") == [("std:fmt",), ("util/a.go",)]
    assert _pairs(src.where(I.has_main("go")), "path") == [("main.go",)]
    java = I.jvm_imports(_src(spark, ("A.java", "import a.b.C;\nimport static a.b.C.f;\nimport a.b.*;\nimport org.x.Y;\n")))
    names = spark.createDataFrame([("r", "a.b.C", "a/b/C.java"), ("r", "a.b.D", "a/b/D.java")], "repo string, fqn string, path string")
    assert _pairs(X.resolve_fqn(java, names), "target") == [("a/b/C.java",), ("a/b/C.java",), ("mvn:org.x",)]
    assert _pairs(X.resolve_wildcard(java, names), "target") == [("a/b/C.java",), ("a/b/D.java",)]


def test_rust_csharp_dart(spark):
    got = I.rust_imports(_src(spark, ("m.rs", "mod a;\npub use crate::x::{b, c as d, self};\nextern crate serde;\n")))
    assert _pairs(got, "kind", "spec") == [("extern", "serde"), ("mod", "a"), ("use", "crate::x"), ("use", "crate::x::b"), ("use", "crate::x::c")]
    got = I.csharp_imports(_src(spark, ("m.cs", "using System.IO;\nglobal using static A.B;\nusing Z = Q.R;\n")))
    assert _pairs(got, "kind", "spec") == [("using", "Q.R"), ("using", "System.IO"), ("using_static", "A.B")]
    got = I.dart_imports(_src(spark, ("lib/m.dart", "import 'package:own/x.dart' deferred as x;\npart 'y.dart';\nimport 'dart:io';\n")))
    have = spark.createDataFrame([("r", "lib/x.dart"), ("r", "lib/y.dart")], "repo string, path string")
    assert _pairs(X.resolve_dart(got, have, "own"), "target") == [("dart:io",), ("lib/m.dart",), ("lib/x.dart",), ("lib/y.dart",)]


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.js").write_text("let a\nlet b")
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "src" / "node_modules" / "c.js").write_text("no")
    assert _pairs(S.read_sources(spark, str(tmp_path), "js"), "path", "content") == [("src/a.js", "let a\nlet b")]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1.json").write_text('{"nodes": [{"id": "c:\\\\u\\\\a", "state": "used", "sizeLOC": 3}, {"state": "lost"}]}')
    (docs / "2.json").write_text("{broken")
    assert _pairs(S.fragment_nodes(S.read_graph_fragments(spark, str(docs))), "id", "state", "sizeLOC") == [("C:/u/a", "used", 3)]


def test_rust_and_static_usings(spark):
    from codegraph_spark.operators import imports, resolve

    rows = [("r", "src/main.rs", "mod a;\nmod gone;\nuse crate::a::b::Thing;\nuse serde_json::Value;\nuse std::fmt;\nextern crate libc;"), ("r", "src/a.rs", "mod b;\nuse super::c::{D, E as F};"), ("r", "src/a/b.rs", "use self::nothing;"), ("r", "src/c/mod.rs", None)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    deps = spark.createDataFrame([("r", "serde-json")], "repo string, name string")
    got = {(r["source"], r["target"], r["kind"]) for r in resolve.resolve_rust(imports.rust_imports(files), files, deps).collect()}
    assert {("src/main.rs", "src/a.rs", "mod"), ("src/main.rs", "src/a/b.rs", "use"), ("src/main.rs", "crate:serde_json", "use"), ("src/main.rs", "crate:libc", "extern"), ("src/a.rs", "src/a/b.rs", "mod"), ("src/a.rs", "src/c/mod.rs", "use"), ("src/main.rs", "crate:gone", "mod")} == got
    cs = spark.createDataFrame([("r", "p.cs", "using static A.B.C;\nusing static System.Math;\nusing X;")], "repo string, path string, content string")
    paths = spark.createDataFrame([("r", "src/A/B/C.cs")], "repo string, path string")
    anchors = spark.createDataFrame([("r", "X", "x.cs")], "repo string, namespace string, anchor string")
    got = {(r["target"], r["kind"]) for r in resolve.resolve_csharp(imports.csharp_imports(cs), anchors, paths).collect()}
    assert got == {("src/A/B/C.cs", "using_static"), ("dotnet:System", "using_static"), ("x.cs", "using")}


def test_statements_over_several_lines(spark):
    text = "export {\n  a,\n  b as c\n} from './x';\nimport D, {\n  type T, // a comment\n  u as v\n} from '../y';\nexport { q } from './one';\nexport {\n  local\n};\nimport('z')\n"
    got = I.js_imports(_src(spark, ("m.js", text), ("n.js", None), ("o.js", "export {\n" * 3)))
    assert _pairs(got, "line", "kind", "spec") == [(1, "reexport", "./x"), (5, "import", "../y"), (9, "reexport", "./one"), (13, "dynamic", "z")]
    two = got.where("line = 5").first()
    assert (two.default_name, two.named, two.named_original, two.type_only) == ("D", ["T", "v"], ["T", "u"], ["T"])
    text = "import 'a.dart'\n    if (dart.library.io) 'b.dart'\n    as p show X,\n    Y hide Z;\r\nexport 'c.dart'\nimport 'd.dart' deferred as q;\npart of 'e.dart';\nvar s = 1;\n"
    got = I.dart_imports(_src(spark, ("m.dart", text), ("n.dart", None)))
    assert [tuple(r) for r in got.orderBy("line").select("line", "kind", "spec", "alias", "deferred", "show", "hide").collect()] == [
        (1, "import", "a.dart", "p", False, ["X", "Y"], ["Z"]), (5, "export", "c.dart", None, False, [], []), (6, "import", "d.dart", "q", True, [], []), (7, "part_of", "e.dart", None, False, [], []),
    ]
    long = "export {\n" * 30_000 + "import 'x'\n" * 30_000
    assert I.js_imports(_src(spark, ("m.js", long))).count() == 30_000 and I.dart_imports(_src(spark, ("m.dart", long))).count() == 30_000


def test_kotlin_modifiers(spark):
    from codegraph_spark.operators import modules

    src = _src(spark, *[(f"{n}.kt", f"package p\n{code}\n") for n, code in enumerate(("sealed class A", "abstract class B {", "public open class C", "internal sealed interface D", "data object E", "enum class F", "fun interface G", "val x = 1"))])
    assert [r["fqn"] for r in modules.jvm_names(src, "kt").orderBy("path").collect()] == [f"p.{x}" for x in "ABCDEFG"] + ["p"]


def test_packages_stand_for_their_files(spark):
    """Through packages: fewer edges, and the degrees and the reach of the graph in which every import leads to every file."""
    from pyspark.sql import functions as F

    from codegraph_spark.operators import graph

    files = _src(spark, *[(f"util/f{n}.go", "package util\n" + ('import "ex.com/m/deep"\n' if n == 3 else "")) for n in range(6)], *[(f"deep/d{n}.go", "package deep\n") for n in range(4)],
                 *[(f"main{n}.go", 'package main\nimport (\n  "fmt"\n  "ex.com/m/util"\n)\n') for n in range(5)])
    mods = I.manifest_names(_src(spark, ("go.mod", "module ex.com/m\n")))
    wide, narrow = (X.resolve_go(I.go_imports(files), files, mods, packages=p) for p in (False, True))
    assert wide.count() == 5 * (1 + 6) + 4 and narrow.count() == 5 * (1 + 1) + 1 + 6 + 4
    ends = wide.select("repo", F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(wide.select("repo", "target", F.lit(0), F.lit(1)))
    want = sorted(map(tuple, ends.groupBy("repo", "id").agg(F.sum("i"), F.sum("o")).collect()))
    assert sorted(map(tuple, X.package_degrees(narrow).collect())) == want
    entry = spark.createDataFrame([("r", "main0.go")], "repo string, id string")
    assert _pairs(graph.reach(narrow, entry).where(~F.col("id").startswith(X.PACKAGE)), "id") == _pairs(graph.reach(wide, entry), "id")
    java = I.jvm_imports(_src(spark, ("A.java", "import a.*;\nimport a.b.*;\nimport z.*;\n")))
    names = spark.createDataFrame([("r", "a.b.C", "a/b/C.java"), ("r", "a.b.D", "a/b/D.java"), ("r", "a.E", "a/E.java")], "repo string, fqn string, path string")
    assert _pairs(X.resolve_wildcard(java, names, packages=True), "source", "target") == [
        ("A.java", "mvn:z"), ("A.java", "package:a"), ("A.java", "package:a.b"), ("package:a", "a/E.java"), ("package:a", "a/b/C.java"), ("package:a", "a/b/D.java"), ("package:a.b", "a/b/C.java"), ("package:a.b", "a/b/D.java"),
    ]
