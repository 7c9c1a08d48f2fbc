"""Imports of whole packages: crawls through one node a package, and what packages share."""

from collections import Counter

import pytest

from codegraph_spark.plans import jobs

FILES = {
    "java": {
        "A.java": "package p;\nimport a.*;\nimport a.b.*;\nimport a.b.*;\nimport z.*;\nclass A { public static void main(String[] x) {} }",
        "B.java": "package p;\nimport a.b.*;\nclass B {}", "C.java": "package a.b;\nimport a.*;\nclass C {}", "D.java": "package a.b;\nclass D {}", "E.java": "package a;\nimport p.A;\nclass E {}",
    },
    "kt": {
        "A.kt": "package p\nimport a.*\nimport a.b.*\nimport x.y.*\nimport z.*\nfun main() {}", "B.kt": "package a.b\nclass B", "C.kt": "package a.b\nfun c() = 1", "D.kt": "package a\nimport a.b.*\nclass D",
        "src/x/y/E.kt": "package a.b\nclass E", "src/x/y/F.kt": "fun f() = 1",
    },
    "go": {"main.go": 'package main\nimport "shop/a"\nimport "shop/b"\nimport "fmt"\nfunc main() {}', "a/x.go": 'package a\nimport "shop/b"\nimport "shop/a"', "a/y.go": "package a", "b/z.go": "package b", "c/w.go": "package c"},
}


@pytest.mark.parametrize("lang", FILES)
def test_crawl_through_packages_is_the_plain_crawl(spark, lang):
    """Packages within packages, and packages that share some files only, count each file once."""
    src = spark.createDataFrame([("r", p, t) for p, t in FILES[lang].items()], "repo string, path string, content string")
    manifests = spark.createDataFrame([("r", "go.mod", "module shop\n")], "repo string, path string, content string")
    graph = jobs.crawl_graph(src, src.select("repo", "path"), lang, manifests=manifests)
    plain = [(r["source"], r["target"]) for r in jobs.crawl_edges(src, src.select("repo", "path"), lang, manifests).collect()]
    assert Counter((r["source"], r["target"]) for r in graph.edges.collect()) == Counter(plain)
    into, out = Counter(t for _, t in plain), Counter(s for s, _ in plain)
    nodes = {r["id"]: (r["inDeg"], r["outDeg"]) for r in graph.nodes.collect()}
    assert nodes == {i: (into[i], out[i]) for i in {*FILES[lang], *into}}
    # no import leads to a file of its own
    assert "package" not in {r["type"] for r in graph.nodes.collect()}


def test_crawl_makes_no_product(spark):
    """2,000 imports of a package of 2,000 files: 4,000 edges in the crawl, not four million."""
    src = spark.range(2000).selectExpr("'r' AS repo", "concat('a/f', id, '.go') AS path", "'package a\nimport \"shop/a\"' AS content")
    manifests = spark.createDataFrame([("r", "go.mod", "module shop\n")], "repo string, path string, content string")
    assert jobs.crawl_edges(src, src.select("repo", "path"), "go", manifests, packages=True).count() == 4000
    degrees = jobs.crawl_graph(src, src.select("repo", "path"), "go", manifests=manifests).nodes.select("inDeg", "outDeg").distinct().collect()
    assert [tuple(r) for r in degrees] == [(2000, 2000)]
