"""Exports of JS and Python files: long tables (repo, path, grp, name, ...), extracted from whole texts without a shuffle but the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .imports import lines, py_imports, some

_ID = r"[A-Za-z_$][\w$]*"
_Q = r"""["']"""
#: Groups that a form adds to, and the expression whose first group is the name.
JS_NAMED = (
    (("functions", "named"), rf"\bexport\s+(?:async\s+)?function\s*\*?\s*({_ID})"),
    (("classes", "named"), rf"\bexport\s+(?:abstract\s+)?class\s+({_ID})"),
    (("types",), rf"\bexport\s+(?:declare\s+)?type\s+({_ID})\s*[=<]"),
    (("interfaces",), rf"\bexport\s+(?:declare\s+)?interface\s+({_ID})"),
    (("enums",), rf"\bexport\s+(?:declare\s+)?(?:const\s+)?enum\s+({_ID})"),
    (("functions",), rf"\bexport\s+default\s+(?:async\s+)?function\s*\*?\s*({_ID})"),
    (("classes",), rf"\bexport\s+default\s+(?:abstract\s+)?class\s+(?!extends\b)({_ID})"),
    (("named",), rf"(?m)^\s*(?:module\.)?exports\.({_ID})\s*=(?!=)"),
    (("named",), rf"(?m)^\s*(?:module\.)?exports\[\s*{_Q}([^\"']+){_Q}\s*\]\s*=(?!=)"),
    (("reexports",), rf"\bexport\s+(?:type\s+)?\{{[^}}]*\}}\s*from\s*{_Q}([^\"']+){_Q}"),
    (("reexports", "starReexports"), rf"\bexport\s+\*(?:\s+as\s+{_ID})?\s+from\s*{_Q}([^\"']+){_Q}"),
)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _names(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def declared_names(declaration: Column) -> Column:
    """Names that `a = f(1, 2), b: T` or a destructuring pattern declares."""
    d = F.trim(declaration)
    inside = F.regexp_replace(F.regexp_extract(d, r"^[{\[]([^}\]]*)[}\]]", 1), r"\.\.\.", "")
    picked = F.transform(F.split(inside, ","), lambda x: F.regexp_extract(F.regexp_replace(F.trim(x), rf"^{_ID}\s*:\s*", ""), rf"^({_ID})", 1))
    flat = d
    for _ in range(3):  # brackets within brackets, from the inside
        flat = F.regexp_replace(flat, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|\"[^\"]*\"|'[^']*'", "0")
    plain = F.transform(F.split(flat, ","), lambda x: F.regexp_extract(F.trim(x), rf"^({_ID})\s*(?:[=:!]|$)", 1))
    return _names(F.when(d.rlike(r"^[{\[]"), picked).otherwise(plain))


def default_exports(text: Column) -> Column:
    """What `export default` and `module.exports =` give: function f, class C, a name, or the shape of an expression."""

    def told(x: Column) -> Column:
        e = F.trim(x)
        f = F.regexp_extract(e, rf"^(?:async\s+)?function\s*\*?\s*({_ID})", 1)
        c = F.regexp_extract(e, rf"^(?:abstract\s+)?class\s+(?!extends\b)({_ID})", 1)
        other = F.when(e.rlike(r"^abstract\s+class\b"), F.lit("class")).otherwise(T.default_export_summary(e))
        return F.when(f != "", F.concat(F.lit("function "), f)).when(c != "", F.concat(F.lit("class "), c)).otherwise(other)

    own = F.transform(_all(text, r"\bexport\s+default\s+([^;\n]+)"), told)
    common = F.transform(F.filter(_all(text, r"\bmodule\.exports\s*=(?!=)\s*([^;\n]+)"), lambda x: ~x.startswith("{")), told)
    return F.concat(own, common)


def listed_exports(text: Column) -> Column:
    """array of (grp, name) of `export { a, b as c }`, with or without `from`: types where the list or the item is marked so; of a
    re-export, `x as default` is group default with the name x."""
    blocks = _all(text, r"\bexport\s+(?:type\s+)?\{[^}]*\}(?:\s*from\b)?", 0)

    def items(b: Column) -> Column:
        typed, again = b.rlike(r"^export\s+type\b"), b.rlike(r"from$")
        parts = F.filter(F.transform(F.split(F.regexp_extract(b, r"\{([^}]*)\}", 1), ","), lambda x: F.trim(x)), lambda x: x != "")

        def one(x: Column) -> Column:
            mark = x.rlike(rf"^type\s+(?!as\b){_ID}")
            plain = F.when(mark, F.regexp_replace(x, r"^type\s+", "")).otherwise(x)
            name, alias = F.regexp_extract(plain, rf"^({_ID})", 1), F.regexp_extract(plain, rf"\sas\s+({_ID})", 1)
            local = F.when(alias != "", alias).otherwise(name)
            default = again & (local == "default")
            kind = F.when(typed | mark, F.array(F.lit("types"))).otherwise(F.array(F.lit("named")))
            groups = F.when(default, F.when(typed | mark, F.array(F.lit("default"), F.lit("types"))).otherwise(F.array(F.lit("default")))).otherwise(kind)
            shown = F.when(default, name).otherwise(local)
            return F.transform(groups, lambda g: F.struct(g.alias("grp"), shown.alias("name")))

        return F.flatten(F.transform(parts, one))

    return F.filter(F.flatten(F.transform(blocks, items)), lambda x: x["name"] != "")


def js_exports(src: DataFrame) -> DataFrame:
    """(repo, path, grp, name), each once. Groups: named, default, functions, classes, types, interfaces, enums, variables,
    reexports, starReexports. Comments are not read; null contents export nothing."""
    t = F.col("text")
    pair = lambda grp: lambda n: F.struct(F.lit(grp).alias("grp"), n.alias("name"))
    found = [F.transform(_all(t, p), pair(g)) for groups, p in JS_NAMED for g in groups]
    found.append(F.transform(listed_exports(t), lambda x: F.struct(x["grp"].alias("grp"), x["name"].alias("name"))))
    found.append(F.transform(_all(t, rf"\bexport\s+\*\s+as\s+({_ID})"), pair("named")))
    declared = F.flatten(F.transform(_all(t, r"\bexport\s+(?:const|let|var)\s+(?!enum\b)(\{[^}]*\}[^;\n]*|\[[^\]]*\][^;\n]*|[^;\n]+)"), declared_names))
    found += [F.transform(declared, pair("variables")), F.transform(declared, pair("named"))]
    keys = F.flatten(F.transform(_all(t, r"\bmodule\.exports\s*=\s*\{([^}]*)\}"), lambda b: F.split(b, "[,;]")))
    found.append(F.transform(_names(F.transform(keys, lambda x: F.regexp_extract(x, rf"^\s*{_Q}?({_ID})", 1))), pair("named")))
    found.append(F.transform(default_exports(t), pair("default")))
    rows = src.select("repo", "path", T.js_strip_comments(F.col("content")).alias("text"))
    return rows.select("repo", "path", F.explode(F.array_distinct(F.concat(*found))).alias("x")).select("repo", "path", "x.*").distinct()


def exports_map(exports: DataFrame) -> DataFrame:
    """(repo, path, exports map<grp, sorted names>): one row per file that exports something."""
    groups = exports.groupBy("repo", "path", "grp").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return groups.groupBy("repo", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "names")))).alias("exports"))


def py_exports(src: DataFrame) -> DataFrame:
    """(repo, path, grp, name, kind, line). Groups: exports (functions, classes and variables at column 0), reexports (imported
    names; kind is the module), starImports (name is the module) and all (names in __all__). Names that begin with `_` are private."""
    blanked = src.withColumn("content", T.py_blank_strings_comments("content"))
    get = lambda p: some(F.regexp_extract("code", p, 1))
    f, c, v = get(r"^(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("), get(r"^class\s+([A-Za-z_]\w*)\s*[:(]"), get(r"^([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)")
    kind = F.when(f.isNotNull(), F.lit("function")).when(c.isNotNull(), F.lit("class")).otherwise(F.lit("variable"))
    own = lines(blanked).select("repo", "path", F.lit("exports").alias("grp"), F.coalesce(f, c, v).alias("name"), kind.alias("kind"), F.col("line_no").alias("line"))
    imports = py_imports(src).withColumn("from", F.concat(F.repeat(F.lit("."), F.col("rel_dots")), "module"))
    local = F.coalesce("alias", F.when(F.col("kind") == "import", F.substring_index("module", ".", 1)).otherwise(F.col("name")))
    again = imports.where("not star").select("repo", "path", F.lit("reexports").alias("grp"), local.alias("name"), F.col("from").alias("kind"), "line")
    stars = imports.where("star").select("repo", "path", F.lit("starImports").alias("grp"), F.col("from").alias("name"), F.lit(None).cast("string").alias("kind"), "line")
    public = own.unionByName(again).where(F.col("name").isNotNull() & ~F.col("name").startswith("_"))
    names = src.select("repo", "path", F.explode(F.array_distinct(F.flatten(F.transform(_dunder_all(T.strip_triple_quoted(F.col("content"))), lambda b: _all(b, rf"{_Q}([^\"']+){_Q}"))))).alias("name"))
    return public.unionByName(stars).unionByName(names.select("repo", "path", F.lit("all").alias("grp"), "name", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("line")))


def _dunder_all(content: Column) -> Column:
    """What stands in the brackets of each statement about __all__."""
    return F.concat(_all(content, r"(?m)^\s*__all__\s*\+?=\s*[\[(]([^\])]*)[\])]"), _all(content, r"__all__\s*\.\s*(?:append|extend)\s*\(([^)]*)\)"))


def py_export_certainty(src: DataFrame) -> DataFrame:
    """(repo, path, has_all, uncertain): uncertain where __all__ has a statement without literal names, or a star import is there."""
    said = F.coalesce(_dunder_all(T.strip_triple_quoted(F.col("content"))), F.array().cast("array<string>"))
    flags = src.select("repo", "path", (F.size(said) > 0).alias("has_all"), F.exists(said, lambda b: ~b.rlike(_Q)).alias("vague"))
    stars = py_imports(src).where("star").select("repo", "path", F.lit(True).alias("starred")).distinct()
    return flags.join(stars, ["repo", "path"], "left").select("repo", "path", "has_all", (F.col("vague") | F.coalesce("starred", F.lit(False))).alias("uncertain"))
