"""Import queries. Sources are derived from documents (whole texts with an import of a neighbouring file behind them), names
and wildcard imports from parts and suppliers."""

from __future__ import annotations

from ..operators import graph as G
from ..operators import imports as I
from ..operators import relations as R
from ..operators import resolve as X
from .graphs import frame, sources

QUERIES, ORACLES = {}, {}

_LINE = "CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 2 AS INT)"


def _sources(imported: str, ext: str) -> str:
    return f"SELECT source AS repo, 'src/f' || CAST(doc_id AS STRING) || '{ext}' AS path, coalesce(text, '') || chr(10) || {imported} AS content FROM documents"


JS = _sources("'import D, { x as y } from \"./f' || CAST(doc_id + 1 AS STRING) || '\";'", ".js")
PY = _sources("'from .f' || CAST(doc_id + 1 AS STRING) || ' import a as b'", ".py")
NAMES = "SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, 'shop.' || p_brand || '.P' || CAST(p_partkey AS STRING) AS fqn, 'src/P' || CAST(p_partkey AS STRING) || '.java' AS path FROM part"
WILD = "SELECT 'repo' || CAST(s_suppkey % 4 AS STRING) AS repo, 'src/S' || CAST(s_suppkey AS STRING) || '.java' AS path, 'import_wildcard' AS kind, 'shop.Brand#' || CAST(s_suppkey % 7 AS STRING) || CAST(s_suppkey % 6 AS STRING) AS spec FROM supplier"
EXACT = "SELECT 'repo' || CAST(l_suppkey % 4 AS STRING) AS repo, 'src/L' || CAST(l_orderkey AS STRING) || '.java' AS path, 'import' AS kind, false AS is_static, 'shop.' || p_brand || '.P' || CAST(p_partkey AS STRING) AS spec FROM lineitem JOIN part ON l_partkey = p_partkey"


def query(oracle=None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"SELECT source AS repo, 'src/f' || CAST(doc_id AS STRING) || '.js' AS path, {_LINE} AS line, 'import' AS kind, './f' || CAST(doc_id + 1 AS STRING) AS spec, 'D' AS default_name, 'y' AS named FROM documents")
def js_imports(spark, d):
    found = I.js_imports(sources(spark, d, JS))
    return found.selectExpr("repo", "path", "line", "kind", "spec", "default_name", "array_join(named, ',') AS named")


REEXPORTS = _sources("'export {' || chr(10) || '  a as b, // first' || chr(10) || '  type T' || chr(10) || '} from \"./f' || CAST(doc_id + 1 AS STRING) || '\";'", ".js")
DIRECTIVES = _sources(
    "'import \"f' || CAST(doc_id + 1 AS STRING) || '.dart\"' || chr(10) || '    if (dart.library.io) \"io.dart\"' || chr(10) || '    deferred as g show X,' || chr(10) || '    Y;' || chr(10) || 'part \"p.dart\";'", ".dart"
)


@query(f"SELECT source AS repo, 'src/f' || CAST(doc_id AS STRING) || '.js' AS path, {_LINE} AS line, 'reexport' AS kind, './f' || CAST(doc_id + 1 AS STRING) AS spec FROM documents")
def js_reexports(spark, d):
    """Re-exports over several lines, on their first line."""
    return I.js_imports(sources(spark, d, REEXPORTS)).select("repo", "path", "line", "kind", "spec")


@query(
    f"""SELECT source AS repo, 'src/f' || CAST(doc_id AS STRING) || '.dart' AS path, CAST({_LINE} + x.n AS INT) AS line, x.kind, CASE x.n WHEN 0 THEN 'f' || CAST(doc_id + 1 AS STRING) || '.dart' ELSE 'p.dart' END AS spec,
    CASE x.n WHEN 0 THEN 'g' END AS alias, x.n = 0 AS deferred, CASE x.n WHEN 0 THEN 'X,Y' ELSE '' END AS shown FROM documents, (VALUES (0, 'import'), (4, 'part')) x(n, kind)"""
)
def dart_directives(spark, d):
    """Directives over several lines and conditional imports, with their prefix and names."""
    return I.dart_imports(sources(spark, d, DIRECTIVES)).selectExpr("repo", "path", "line", "kind", "spec", "alias", "deferred", "array_join(show, ',') AS shown")


@query(f"SELECT source AS repo, 'src/f' || CAST(doc_id AS STRING) || '.py' AS path, {_LINE} AS line, 'from_relative' AS kind, 'f' || CAST(doc_id + 1 AS STRING) AS module, 'a' AS name, 'b' AS alias, 1 AS rel_dots, false AS star FROM documents")
def py_imports(spark, d):
    return I.py_imports(sources(spark, d, PY))


def _resolved(ext: str, hit: str, miss: str, certainty: str) -> str:
    return f"""SELECT d.source AS repo, 'src/f' || CAST(d.doc_id AS STRING) || '{ext}' AS source,
        CASE WHEN n.doc_id IS NULL THEN {miss} ELSE '{hit}' || CAST(n.doc_id AS STRING) || '{ext}' END AS target,
        {certainty} AS certainty FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1 AND n.source IS NOT DISTINCT FROM d.source"""


@query(_resolved(".js", "src/f", "'./f' || CAST(d.doc_id + 1 AS STRING)", "'static'"))
def resolve_js(spark, d):
    src = sources(spark, d, JS)
    return X.resolve_js(I.js_imports(src), src).select("repo", "source", "target", "certainty")


@query(_resolved(".py", "src/f", "'pip:src'", "CASE WHEN n.doc_id IS NULL THEN 'heuristic' ELSE 'static' END"))
def resolve_python(spark, d):
    src = sources(spark, d, PY)
    packages = src.select("repo").distinct().selectExpr("repo", "'src/__init__.py' AS path")
    return X.resolve_python(I.py_imports(src), src.select("repo", "path").union(packages)).select("repo", "source", "target", "certainty")


@query("SELECT d.source AS repo, 'src/f' || CAST(d.doc_id AS STRING) || '.js' AS path, './f' || CAST(d.doc_id + 1 AS STRING) AS spec FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents n WHERE n.doc_id = d.doc_id + 1 AND n.source IS NOT DISTINCT FROM d.source)")
def unresolved_imports(spark, d):
    src = sources(spark, d, JS)
    imports = G.stored(I.js_imports(src))
    return R.unresolved_imports(imports, X.resolve_js(imports, src)).select("repo", "path", "spec")


@query(f"SELECT i.repo, i.path AS source, coalesce(n.path, 'mvn:' || regexp_extract(i.spec, '^[^.]*[.][^.]*')) AS target, i.kind FROM ({EXACT}) i LEFT JOIN ({NAMES}) n ON i.repo = n.repo AND i.spec = n.fqn")
def resolve_fqn(spark, d):
    return X.resolve_fqn(frame(spark, d, EXACT), frame(spark, d, NAMES)).select("repo", "source", "target", "kind")


@query(f"SELECT i.repo, i.path AS source, coalesce(n.path, 'mvn:' || i.spec) AS target, i.kind FROM ({WILD}) i LEFT JOIN ({NAMES}) n ON i.repo = n.repo AND starts_with(n.fqn, i.spec || '.')")
def resolve_wildcard(spark, d):
    return X.resolve_wildcard(frame(spark, d, WILD), frame(spark, d, NAMES)).select("repo", "source", "target", "kind")


@query(f"SELECT DISTINCT i.repo, 'mvn:' || i.spec AS id, 'external' AS type, 'used' AS state FROM ({WILD}) i WHERE NOT EXISTS (SELECT 1 FROM ({NAMES}) n WHERE i.repo = n.repo AND starts_with(n.fqn, i.spec || '.'))")
def external_packages(spark, d):
    names = frame(spark, d, NAMES)
    # through packages: one edge an import, whatever it leads to
    edges = X.resolve_wildcard(frame(spark, d, WILD), names, packages=True).where("not internal")
    return R.externals(edges, names.selectExpr("repo", "path AS id")).select("repo", "id", "type", "state")


_GO_FILE = "'d' || CAST(p_size AS STRING) || '/p' || CAST(p_partkey AS STRING) || '.go'"
GO = f"SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, {_GO_FILE} AS path, 'import \"shop/d' || CAST(p_partkey % 60 AS STRING) || '\"' AS content FROM part"


@query(f"SELECT i.repo, i.path AS source, coalesce(t.path, 'std:shop/d' || CAST(i.k AS STRING)) AS target, 'import' AS kind FROM (SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, {_GO_FILE} AS path, p_partkey % 60 AS k FROM part) i LEFT JOIN (SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, {_GO_FILE} AS path, p_size FROM part) t ON i.repo = t.repo AND i.k = t.p_size")
def resolve_go(spark, d):
    src = sources(spark, d, GO)
    modules = src.selectExpr("repo", "'shop' AS module").distinct()
    return X.resolve_go(I.go_imports(src), src, modules).select("repo", "source", "target", "kind")


_DART = "'lib/p' || CAST(p_partkey AS STRING) || '.dart'"
DART = f"SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, {_DART} AS path, 'import ''package:shop/p' || CAST(p_partkey + p_size AS STRING) || '.dart'';' AS content FROM part"


@query(f"SELECT 'repo' || CAST(i.p_partkey % 4 AS STRING) AS repo, 'lib/p' || CAST(i.p_partkey AS STRING) || '.dart' AS source, CASE WHEN t.p_partkey IS NULL THEN 'pub:shop' ELSE 'lib/p' || CAST(t.p_partkey AS STRING) || '.dart' END AS target, 'import' AS kind FROM part i LEFT JOIN part t ON t.p_partkey = i.p_partkey + i.p_size AND t.p_partkey % 4 = i.p_partkey % 4")
def resolve_dart(spark, d):
    src = sources(spark, d, DART)
    return X.resolve_dart(I.dart_imports(src), src, "shop").select("repo", "source", "target", "kind")


RUST = "SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, 'src/p' || CAST(p_partkey AS STRING) || '.rs' AS path, 'use crate::p' || CAST(p_partkey + p_size AS STRING) || '::Thing;' AS content FROM part"


@query("SELECT 'repo' || CAST(i.p_partkey % 4 AS STRING) AS repo, 'src/p' || CAST(i.p_partkey AS STRING) || '.rs' AS source, 'src/p' || CAST(t.p_partkey AS STRING) || '.rs' AS target, 'use' AS kind FROM part i JOIN part t ON t.p_partkey = i.p_partkey + i.p_size AND t.p_partkey % 4 = i.p_partkey % 4")
def resolve_rust(spark, d):
    src = sources(spark, d, RUST)
    none = src.selectExpr("repo", "'serde' AS name").distinct()
    return X.resolve_rust(I.rust_imports(src), src, none).select("repo", "source", "target", "kind")


CSHARP = "SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, 'src/P' || CAST(p_partkey AS STRING) || '.cs' AS path, 'using Shop.N' || CAST(p_size AS STRING) || ';' AS content FROM part"
ANCHORED = "SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, 'src/P' || CAST(p_partkey AS STRING) || '.cs' AS path, 'Shop.N' || CAST(p_size + 10 AS STRING) AS namespace FROM part"


@query(f"SELECT i.repo, i.path AS source, coalesce(a.anchor, 'nuget:' || i.spec) AS target, 'using' AS kind FROM (SELECT 'repo' || CAST(p_partkey % 4 AS STRING) AS repo, 'src/P' || CAST(p_partkey AS STRING) || '.cs' AS path, 'Shop.N' || CAST(p_size AS STRING) AS spec FROM part) i LEFT JOIN (SELECT repo, namespace, min(path) AS anchor FROM ({ANCHORED}) GROUP BY ALL) a ON a.repo = i.repo AND a.namespace = i.spec")
def resolve_csharp(spark, d):
    anchors = R.namespace_anchor(frame(spark, d, ANCHORED))
    return X.resolve_csharp(I.csharp_imports(sources(spark, d, CSHARP)), anchors).select("repo", "source", "target", "kind")
