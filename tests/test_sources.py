"""Folders and extensions by language, and tables written and read back."""

import pytest
from pyspark.sql import functions as F

from codegraph_spark.sources import files as S

#: One path that is a source, and one that is not, for every folder that only some languages leave out.
KEPT = {"js": ["target/a.js", "vendor/b.ts", "bin/c.mjs"], "py": ["vendor/a.py", "bin/b.py", "obj/c.pyi"], "go": ["bin/a.go", "obj/b.go", ".mvn/c.go"], "rs": ["src/bin/tool.rs", "vendor/a.rs"],
        "java": ["src/obj/A.java", "bin/B.java", "vendor/C.java"], "kt": ["bin/A.kt", "vendor/B.kt"], "cs": ["target/A.cs", "build/B.cs", "vendor/C.cs"], "dart": ["bin/main.dart", "target/a.dart", "vendor/b.dart"]}


@pytest.mark.parametrize("lang", sorted(S.IGNORED_FOLDERS))
def test_folders_of_a_language(spark, lang):
    end = S.P.SOURCE_EXTENSIONS[lang][0]
    gone = [f"{folder}/x{end}" for folder in S.IGNORED_FOLDERS[lang]] + [f"a/{folder}/b/x{end}" for folder in S.IGNORED_FOLDERS[lang]] + ["README.md", f"x{end}/y.txt"]
    kept = KEPT[lang] + [f"x{end}", f"src/{S.IGNORED_FOLDERS[lang][0]}{end}"]
    rows = spark.createDataFrame([("r", p) for p in [*gone, *kept, None]], "repo string, path string")
    assert sorted(r["path"] for r in S.filter_sources(rows, lang).collect()) == sorted(kept)


def test_sources_below_a_folder(spark, tmp_path):
    for path in ("bin/main.dart", "lib/a b+c.dart", "ios/x.dart", "lib/readme.md"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(f"// {path}\n")
    got = {(r["path"], r["lang"], r["content"]) for r in S.read_sources(spark, str(tmp_path), "dart", "r").collect()}
    assert got == {(p, "dart", f"// {p}\n") for p in ("bin/main.dart", "lib/a b+c.dart")}


def test_graph_and_table_of_nodes_read_back(spark, tmp_path):
    nodes = spark.createDataFrame([("r", "a", "used", "file", "p", 3, 1, 2), ("s", "b,\"c", None, "external", None, None, None, None)], "repo string, id string, state string, type string, package string, sizeLOC int, inDeg long, outDeg long")
    edges = spark.createDataFrame([("r", "a", "b")], "repo string, source string, target string")
    S.write_graph(nodes, edges, str(tmp_path / "g"))
    back = spark.read.parquet(str(tmp_path / "g/nodes")).drop("bucket").select(nodes.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, nodes.collect())) and spark.read.parquet(str(tmp_path / "g/edges")).drop("bucket").collect() == edges.collect()
    S.write_sbom_csv(nodes.where(F.col("repo").isNotNull()), str(tmp_path / "sbom"))
    rows = spark.read.option("header", True).option("escape", '\\').csv(str(tmp_path / "sbom")).orderBy("repo").collect()
    assert [r.asDict() for r in rows] == [{"repo": "r", "id": "a", "state": "used", "type": "file", "package": "p", "loc": "3", "degree": "3"}, {"repo": "s", "id": 'b,"c', "state": None, "type": "external", "package": None, "loc": None, "degree": "0"}]
