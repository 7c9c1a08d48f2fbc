"""Crawls of many files: texts are taken apart once, by all tasks."""

from codegraph_spark.functions import text as T
from codegraph_spark.operators import imports as I
from codegraph_spark.operators import resolve as X
from codegraph_spark.queries import crawls, imports

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sources(spark, n, ext, content):
    return spark.range(n).selectExpr("'r' AS repo", f"concat('src/p', id, '.{ext}') AS path", f"{content} AS content")


def test_resolved_rust_reads_no_text_again(spark):
    """Before, the join of hits made all imports, and their candidates, a second time."""
    src = sources(spark, 50, "rs", "concat('use crate::p', id + 1, '::{A, b::{C, p1 as D}};')")
    edges = X.resolve_rust(I.rust_imports(src), src.select("repo", "path"), src.selectExpr("repo", "'serde' AS name").limit(1))
    assert "content" not in plan(edges)
    assert edges.groupBy("source", "target").count().where("count = 3 and source <> target").count() == 49


def test_query_sources_are_dealt_over_all_tasks(spark):
    """Before, one task took apart all texts that are made of a table that is read in one."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() < n
    assert imports.QUERIES["py_imports"](spark, SF).where("kind = 'from_relative'").rdd.getNumPartitions() % n == 0
    assert crawls.sources(spark, SF, crawls.FILES["rs"]).rdd.getNumPartitions() == n


def test_resolver_tells_lists_of_candidates_apart(spark):
    """Lists that read alike when joined; a null repo finds nothing; repeated imports all stay."""
    rows = [("r", "a.js", ["x", "y"]), ("r", "b.js", ["x,y"]), ("r", "b.js", ["x,y"]), ("r", "c.js", []), ("r", "d.js", None), (None, "e.js", ["x"]), ("s", "f.js", ["x"])]
    asked = spark.createDataFrame(rows, "repo string, path string, tries array<string>")
    there = spark.createDataFrame([("r", "y"), ("r", "x,y"), (None, "x"), ("s", "x"), ("s", "x")], "repo string, path string")
    found = X._resolve(asked, asked["tries"], there)
    assert "__cg" not in "".join(found.columns)
    assert sorted((r["path"], r["hit"] or "") for r in found.collect()) == [("a.js", "y"), ("b.js", "x,y"), ("b.js", "x,y"), ("c.js", ""), ("d.js", ""), ("e.js", ""), ("f.js", "x")]


def test_js_texts_are_read_once(spark):
    """Before, single lines and lists over several lines were two readings of each text, and comments were taken out in both."""
    src = sources(spark, 3, "js", "concat('import D from \"./p', id, '\"; // x')")
    assert plan(I.js_imports(src)).count("Range (") == 1


def test_texts_without_comments_stay(spark):
    """What is no comment stays as it is, and a comment that arises when another goes is none the less taken out."""
    texts = ["", "a / b", "a\r\nb", "x // y", "'//' // z", "/* a\nb */c", "/" + "/* */" + "/ d", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = [r["x"] for r in rows.orderBy("i").select(T.js_strip_comments(rows["content"]).alias("x")).collect()]
    assert got == ["", "a / b", "a\r\nb", "x ", "'//' ", "\nc", "", None]


def test_js_imports_of_all_forms(spark):
    """Lines that end in a carriage return, lists over several lines, several calls a line, and texts without any."""
    text = 'import "./a";\r\nconst b = require("./b"), c = require("./c");\nimport {\n  d,\n  e as f\n} from "./d";\nno import\n'
    src = spark.createDataFrame([("r", "m.js", text), ("r", "n.js", ""), ("r", "o.js", None)], "repo string, path string, content string")
    got = I.js_imports(src).orderBy("ord").collect()
    assert [(r["path"], r["line"], r["kind"], r["spec"]) for r in got] == [("m.js", 1, "side_effect", "./a"), ("m.js", 2, "require", "./b"), ("m.js", 2, "require", "./c"), ("m.js", 3, "import", "./d")]
    assert got[-1]["named"] == ["d", "f"]
