import json

from pyspark.sql import functions as F

from codegraph_spark.plans import jobs
from codegraph_spark.streaming import jobs as streams


def test_crawl(spark):
    rows = [("r", "src/main.js", "import './side';\nimport { a } from './a';\nimport z from 'zod';"), ("r", "src/a.js", "require('./data.json')"), ("r", "src/side.js", ""), ("r", "src/dead.js", None)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    paths = files.select("repo", "path").union(spark.createDataFrame([("r", "src/data.json")], "repo string, path string"))
    entry = spark.createDataFrame([("r", "src/main.js")], "repo string, id string")
    graph = jobs.crawl_graph(files, paths, "js", entry)
    got = {r["id"]: (r["type"], r["state"], r["inDeg"], r["outDeg"]) for r in graph.nodes.collect()}
    assert got == {"src/main.js": ("file", "used", 0, 3), "src/a.js": ("file", "used", 1, 1), "src/side.js": ("file", "side_effect_only", 1, 0), "src/dead.js": ("file", "unused", 0, 0), "zod": ("external", "used", 1, 0), "src/data.json": ("external", "used", 1, 0)}
    assert jobs.crawl_graph(files.limit(0), paths, "py").nodes.count() == 0


def test_merge_and_classify(spark):
    one = {"nodes": [{"id": "a", "type": "file"}, {"id": "b", "type": "file"}, {"id": "c", "type": "file"}], "edges": [{"source": "a", "target": "b", "kind": "dynamic-import"}], "entrypoints": ["a"], "securityFindings": {"b": [{"id": "x"}]}}
    two = {"profiles": ["dev"], "nodes": [{"id": "b", "state": "used"}]}
    docs = spark.createDataFrame([("r", n, json.dumps(x)) for n, x in enumerate((one, two))], "repo string, seq long, body string").select("repo", "seq", F.try_parse_json("body").alias("doc"))
    got = {(r["id"], r["profile"]): (r["status"], r["n_findings"]) for r in jobs.merge_and_classify(docs).collect()}
    assert got == {("a", "dev"): ("reachable_current", 0), ("b", "dev"): ("reachable_current", 1), ("c", "dev"): ("disconnected_all_profiles", 0)}


def test_streams_equal_batches(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "repo string, seq long, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    edge = lambda a, b, **x: json.dumps({"nodes": [{"id": a, **x}, {"id": b}], "edges": [{"source": a, "target": b}]})
    put(0, [("r", 1, edge("old", "x")), ("s", 1, edge("a", "b", state="unused"))])
    put(1, [("r", 2, '{"clear": true}'), ("r", 3, edge("n", "m")), ("s", 2, edge("a", "b", state="used")), ("s", 3, "broken")])
    docs = spark.readStream.schema("repo string, seq long, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.stream_merge_graph(docs, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    nodes, edges = streams.read_merged_graph(spark, out)
    assert {(r["repo"], r["id"], r["state"]) for r in nodes.collect()} == {("r", "n", None), ("r", "m", None), ("s", "a", "used"), ("s", "b", None)}
    assert {(r["repo"], r["source"], r["target"]) for r in edges.collect()} == {("r", "n", "m"), ("s", "a", "b")}


def test_stream_scan(spark, tmp_path):
    rows = [("r", "a.js", "js", "eval(x);"), ("r", "b.py", "py", "eval(x)"), ("r", "c.dart", "dart", "var r = Random();"), ("r", "d.js", "js", None)]
    spark.createDataFrame(rows, "repo string, path string, lang string, content string").write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("repo string, path string, lang string, content string").parquet(str(tmp_path / "in"))
    streams.stream_scan(files, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["path"], r["id"]) for r in streams.read_findings(spark, str(tmp_path / "out")).collect()}
    assert {("a.js", "eval.call"), ("b.py", "py.eval.call"), ("c.dart", "dart.random.insecure")} <= got
