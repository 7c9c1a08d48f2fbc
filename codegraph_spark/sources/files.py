"""Sources and sinks: files of a language, graph documents, graphs and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.documents import adapt_report

#: Folders of a language's projects that hold no sources.
IGNORED_FOLDERS = {
    "js": "node_modules dist build .git coverage .next out .turbo .vite .parcel-cache".split(),
    "py": "node_modules dist build target out .git .idea .venv venv __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox".split(),
    "go": "vendor node_modules dist build target out .git .idea .vscode .cache .turbo .parcel-cache".split(),
    "rs": "target node_modules dist build out .git .idea .vscode .cache".split(),
    "java": "node_modules dist build target out .git .idea .gradle .mvn .turbo .vite .parcel-cache".split(),
    "kt": ".git .svn .hg .idea .gradle .vscode .cache .turbo .parcel-cache build dist out target node_modules".split(),
    "cs": "bin obj .git .svn .hg .vs .idea .vscode .cache packages node_modules dist out artifacts TestResults".split(),
    "dart": ".dart_tool .git .idea .vscode .cache build dist node_modules out android ios macos linux windows".split(),
}


def wanted(path: Column, lang: str) -> Column:
    """Has an extension of the language and lies in no ignored folder."""
    ignored = F.array(*map(F.lit, IGNORED_FOLDERS[lang]))
    parts = F.split(path, "/")
    return P.is_source(path, lang) & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ignored)


def filter_sources(files: DataFrame, lang: str) -> DataFrame:
    """The rows of (repo, path, ...) that are sources of the language; null paths go."""
    return files.where(wanted(F.col("path"), lang)).withColumn("lang", F.lit(lang))


def _file_path() -> Column:
    """The file's path as it is named; the metadata column has it percent-encoded, in which a plus stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_sources(spark: SparkSession, root: str, lang: str, repo: str = "repo") -> DataFrame:
    """(repo, path, lang, content) of every source below root, found recursively; paths are relative to root."""
    path = F.regexp_replace(_file_path(), "^file:/+", "/")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{{{','.join(P.SOURCE_EXTENSIONS[lang])}}}").text(root, wholetext=True)
    below = "/" + root.removeprefix("file:").strip("/") + "/"
    rows = raw.select(F.lit(repo).alias("repo"), F.when(path.startswith(below), F.substring(path, len(below) + 1, 1 << 30)).otherwise(path).alias("path"), F.col("value").alias("content"))
    return filter_sources(rows, lang).select("repo", "path", "lang", "content")


def read_graph_fragments(spark: SparkSession, path: str, repo: str = "repo") -> DataFrame:
    """(repo, seq, doc): one row per JSON document in the order of file names; documents that don't parse are skipped, reports of
    findings and exports are read as graph documents.

    seq is a hash-free order key (the file's name), so reading needs no global sort.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = raw.select(F.lit(repo).alias("repo"), _file_path().alias("seq"), F.try_parse_json("value").alias("doc"))
    name = F.substring_index("seq", "/", -1)
    return rows.where("doc is not null").withColumn("doc", adapt_report(F.col("doc"), name))


def fragment_nodes(fragments: DataFrame) -> DataFrame:
    """(repo, seq, id, type, state, sizeLOC) of the nodes in graph documents; ids are canonical, nodes without one go."""
    rows = fragments.sparkSession.sql("SELECT repo, seq, n.value AS node FROM {docs}, LATERAL variant_explode(try_variant_get(doc, '$.nodes', 'variant')) AS n", docs=fragments)
    get = lambda k, t: F.try_variant_get("node", f"$.{k}", t)
    out = rows.select("repo", "seq", P.canonical_path(F.coalesce(get("id", "string"), get("path", "string"))).alias("id"), get("type", "string").alias("type"), get("state", "string").alias("state"), get("sizeLOC", "int").alias("sizeLOC"))
    return out.where("id is not null")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 64) -> None:
    """Nodes and edges as Parquet below path, dealt by a hash of the repo into a bounded number of folders."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("bucket", F.pmod(F.xxhash64("repo"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def graph_documents(sections: dict[str, DataFrame], rows: int = 10_000) -> DataFrame:
    """(repo, body): graph documents as JSON texts, each with a part of one section; together they are the repo's graph.

    Sections are lists of rows (repo, ...), but securityFindings (repo, path, ...) lists them by path, and exports (repo, path, grp,
    name) by path and group. A document holds about `rows` rows, so a large repo has many and none is collected whole. Empty
    sections give no document.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c != "repo"]
        if name == "exports":
            groups = df.groupBy("repo", "path", "grp").agg(F.array_sort(F.collect_set("name")).alias("names"))
            df = groups.groupBy("repo", "path").agg(F.map_from_entries(F.collect_list(F.struct("grp", "names"))).alias("x"))
        elif name == "securityFindings":
            df = df.groupBy("repo", "path").agg(F.collect_list(F.struct(*[c for c in cols if c != "path"])).alias("x"))
        else:
            df = df.select("repo", F.struct(*cols).alias("x"))
        mapped = "path" in df.columns
        parts = df.groupBy("repo").agg(F.ceil(F.count("*") / rows).alias("parts"))
        dealt = df.join(parts, "repo").withColumn("part", F.pmod(F.xxhash64("path") if mapped else F.xxhash64(F.to_json("x")), F.col("parts")))
        held = F.map_from_entries(F.collect_list(F.struct("path", "x"))) if mapped else F.collect_list("x")
        return dealt.groupBy("repo", "part").agg(held.alias(name)).select("repo", F.to_json(F.struct("repo", name)).alias("body"))

    return reduce(DataFrame.union, [one(name, df) for name, df in sections.items()])


def write_graph_documents(sections: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """graph_documents below path, one to a line, in folders by a hash of the repo."""
    docs = graph_documents(sections).withColumn("bucket", F.pmod(F.xxhash64("repo"), F.lit(buckets)))
    docs.select("body", "bucket").write.mode("overwrite").partitionBy("bucket").text(path)


def read_graph_documents(spark: SparkSession, path: str) -> DataFrame:
    """(repo, seq, doc) of what write_graph_documents wrote; the order of parts means nothing."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("doc"), F.xxhash64("value").alias("seq")).where("doc is not null")
    return rows.select(F.try_variant_get("doc", "$.repo", "string").alias("repo"), "seq", "doc")


def write_sbom_csv(nodes: DataFrame, path: str) -> None:
    """id, state, type, package, LOC and degree of every node given (filter beforehand) as CSV with a header."""
    degree = F.coalesce("inDeg", F.lit(0)) + F.coalesce("outDeg", F.lit(0))
    nodes.select("repo", "id", "state", "type", "package", F.col("sizeLOC").alias("loc"), degree.alias("degree")).write.mode("overwrite").option("header", True).csv(path)
