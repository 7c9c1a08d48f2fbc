"""Imports and facts of source files: rows (repo, path, ord, line, kind, spec, ...) from whole texts, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .relations import block_state

_Q = r"""["'`]([^"'`]+)["'`]"""
#: The forms of a JS line in the order they are tried: kind, expression (the last group is the specifier).
JS_FORMS = (
    ("side_effect", rf"^\s*import\s+{_Q}"),
    ("import", rf"^\s*import\s+(?:[^\"'`;]+?)\s+from\s+{_Q}"),
    ("reexport", rf"^\s*export\s+(?:type\s+)?\{{[^}}]*\}}\s*from\s+{_Q}"),
    ("reexport", rf"^\s*export\s+\*(?:\s+as\s+[\w$]+)?\s+from\s+{_Q}"),
)
JS_CALLS = (("require", rf"\brequire\s*\(\s*{_Q}\s*\)"), ("dynamic", rf"\bimport\s*\(\s*{_Q}\s*\)"))
#: Imports and re-exports of a list of names, which may go over several lines; and what is passed over where no such list follows.
JS_LISTS = r"""(?m)^[ \t]*(?:export|import)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{[^}"'`;]*\}\s*from\s*["'`][^"'`\n]+["'`]"""
JS_NO_LIST = r"""(?m)^[ \t]*(?:export|import)\s[^}"'`;]*+"""
#: A directive up to its semicolon, which may be on a later line, but not behind the next directive; else its line.
DART_DIRECTIVES = (
    r"""(?m)^[ \t]*(?:import|export|part\s+of|part)\s+["'][^"'\n]+["']"""
    r"""(?:(?:[^;"'{}\n]++|\n(?!\s*(?:import|export|part|library)\b)|"[^"\n]*+"|'[^'\n]*+')*+;|[^\n]*)"""
)
#: One line that says where a program starts.
MAIN = {
    "py": r"""(?m)^if\s+__name__\s*==\s*["']__main__["']""",
    "go": r"(?m)^func\s+main\s*\(",
    "rs": r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+main\s*\(",
    "java": r"\bpublic\s+static\s+void\s+main\s*\(",
    "kt": r"(?m)^\s*(?:suspend\s+)?fun\s+main\s*\(",
    "cs": r"\bstatic\s+(?:async\s+)?(?:void|int|Task(?:<int>)?)\s+Main\s*\(",
    "dart": r"(?m)^\s*(?:void\s+|Future<void>\s+)?main\s*\(",
}


def some(x: Column) -> Column:
    """Null in place of an empty text."""
    return F.when(x != "", x)


def lines(src: DataFrame, content: Column | None = None) -> DataFrame:
    """(repo, path, line_no, code): every line of every file, counted from one; null content has none."""
    text = F.col("content") if content is None else content
    # outer: the planner would else make each list once more, to ask whether it is empty
    return src.select("repo", "path", F.posexplode_outer(F.split(text, "\n")).alias("n", "code")).where("n is not null").select("repo", "path", (F.col("n") + 1).alias("line_no"), F.regexp_replace("code", "\r$", "").alias("code"))


def statements(src: DataFrame, content: Column, pattern: str, over: str = "") -> DataFrame:
    """(repo, path, line_no, code, spans): every match of a statement, from its first line on, written on one line; spans tells
    whether it went over several."""
    found = src.select("repo", "path", F.explode(T.matches(content, pattern, over)).alias("m"))
    return found.select("repo", "path", F.col("m.line").alias("line_no"), F.trim(F.regexp_replace("m.text", r"\s+", " ")).alias("code"), F.trim("m.text").contains("\n").alias("spans"))


def _group(pattern: str, n: int = 1) -> Column:
    return some(F.regexp_extract("code", pattern, n))


def js_import_clause(clause: Column) -> Column:
    """struct<default_name, namespace_name, named, named_original, type_only, is_type_only> of what stands before `from`."""
    c = F.regexp_replace(F.trim(clause), r"^type\s+(?=[\w${*])", "")
    items = F.filter(F.transform(F.split(F.regexp_extract(c, r"\{([^}]*)\}", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.transform(items, lambda x: F.regexp_replace(x, r"^type\s+", ""))
    local = lambda x: F.regexp_replace(x, r"^.*\s+as\s+", "")
    return F.struct(
        some(F.regexp_extract(c, r"^([A-Za-z_$][\w$]*)", 1)).alias("default_name"),
        some(F.regexp_extract(c, r"\*\s*as\s+([\w$]+)", 1)).alias("namespace_name"),
        F.transform(plain, local).alias("named"),
        F.transform(plain, lambda x: F.regexp_replace(x, r"\s+as\s+.*$", "")).alias("named_original"),
        F.transform(F.filter(items, lambda x: x.rlike(r"^type\s")), lambda x: local(F.regexp_replace(x, r"^type\s+", ""))).alias("type_only"),
        F.trim(clause).rlike(r"^type\s+[\w${*]").alias("is_type_only"),
    )


def _calls(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("spec")))


def js_imports(src: DataFrame) -> DataFrame:
    """(repo, path, line, ord, kind, spec) and the clause's names. The first import or re-export form ends its line; only
    where none fits do all require() and import() calls of the line count. Imports and re-exports of a list of names that goes over
    several lines count on their first line."""
    # each text is read once, for single lines and for lists over several
    plain = src.select("repo", "path", T.js_strip_comments(F.col("content")).alias("plain"))
    at = F.transform(F.split("plain", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    single = F.filter(at, lambda x: x["text"].rlike(r"\b(?:import|export|require)\b"))
    single = F.transform(single, lambda x: F.struct(x["line"].alias("line"), F.regexp_replace(x["text"], "\r$", "").alias("code")))
    several = F.filter(T.matches(F.col("plain"), JS_LISTS, JS_NO_LIST), lambda m: F.trim(m["text"]).contains("\n"))
    several = F.transform(several, lambda m: F.struct(m["line"].alias("line"), F.trim(F.regexp_replace(m["text"], r"\s+", " ")).alias("code")))
    rows = plain.select("repo", "path", F.explode_outer(F.concat(single, several)).alias("row")).where("row is not null").select("repo", "path", "row.*")
    form = F.coalesce(*[F.when(F.col("code").rlike(p), F.array(F.struct(F.lit(k).alias("kind"), F.regexp_extract("code", p, 1).alias("spec")))) for k, p in JS_FORMS])
    calls = F.concat(*[_calls(kind, pattern) for kind, pattern in JS_CALLS])
    clause = F.regexp_extract("code", r"^\s*import\s+([^\"'`;]+?)\s+from\s", 1)
    named = rows.select("repo", "path", "line", js_import_clause(clause).alias("c"), F.coalesce(form, calls).alias("found"))
    found = named.select("repo", "path", "line", "c", F.posexplode_outer("found").alias("n", "x")).where("x is not null")
    return found.select("repo", "path", "line", (F.col("line").cast("long") * 100_000 + F.col("n")).alias("ord"), "x.kind", "x.spec", "c.*")


def py_imports(src: DataFrame) -> DataFrame:
    """(repo, path, line, kind, module, name, alias, rel_dots, star): one row per imported module or name.

    Triple-quoted blocks are blanked first; a parenthesised list may go over several lines.
    """
    text = F.regexp_replace(T.strip_triple_quoted(F.col("content")), r"(?m)#[^\n]*$", "")
    flat = F.regexp_replace(text, r"\\\n", "  ")
    whole = src.withColumn("content", flat)
    listed = whole.select("repo", "path", F.explode(T.matches(F.col("content"), r"(?m)^[ \t]*from[ \t]+[.\w]+[ \t]+import[ \t]*(?:\([^)]*\)|[^\n(]+)")).alias("m"))
    listed = listed.select("repo", "path", F.col("m.line").alias("line"), F.regexp_extract("m.text", r"from[ \t]+(\.*)", 1).alias("dots"), F.regexp_extract("m.text", r"from[ \t]+\.*([\w.]*)", 1).alias("module"), F.regexp_extract("m.text", r"(?s)import[ \t]*(.*)$", 1).alias("names"))
    single = lines(whole).select("repo", "path", F.col("line_no").alias("line"), F.lit("").alias("dots"), F.lit("").alias("module"), _group(r"^\s*import\s+([\w.][^;]*)").alias("names")).where("names is not null")

    def split(df: DataFrame) -> DataFrame:
        part = F.filter(F.transform(F.split(F.regexp_replace("names", r"[()\n;]", " "), ","), lambda x: F.trim(x)), lambda x: x != "")
        return df.select("repo", "path", "line", "dots", "module", F.explode(part).alias("item")).withColumns({"name": F.regexp_extract("item", r"^([\w.*]+)", 1), "alias": some(F.regexp_extract("item", r"\sas\s+(\w+)", 1))})

    froms = split(listed).withColumns({"rel_dots": F.length("dots"), "star": F.col("name") == "*"})
    froms = froms.withColumn("kind", F.when(F.col("star"), "import_star").when(F.col("rel_dots") > 0, "from_relative").otherwise("from"))
    plain = split(single).withColumn("module", F.col("name")).withColumns({"name": F.lit(None).cast("string"), "rel_dots": F.lit(0), "star": F.lit(False), "kind": F.lit("import")})
    keep = ["repo", "path", "line", "kind", "module", "name", "alias", "rel_dots", "star"]
    return plain.select(keep).unionByName(froms.select(keep))


def go_imports(src: DataFrame) -> DataFrame:
    """(repo, path, line, kind, spec) of single imports and of `import ( ... )` blocks."""
    rows = block_state(lines(src), F.col("code").rlike(r"^\s*import\s*\("), F.col("code").rlike(r"^\s*\)"))
    spec = F.coalesce(_group(r"""^\s*import\s+(?:[\w.]+\s+)?["`]([^"`]+)["`]"""), F.when(F.col("in_block"), _group(r"""^\s*(?:import\s*\(\s*)?(?:[\w.]+\s+)?["`]([^"`]+)["`]""")))
    return rows.select("repo", "path", F.col("line_no").alias("line"), F.lit("import").alias("kind"), spec.alias("spec")).where("spec is not null")


def _ungrouped(use: Column) -> Column:
    """`a::{b, c::{d, e}}` as `a::b, a::c::d, a::c::e`: groups are written out from the inside, one a round."""
    pattern = r"([\w:]*)\{([^{}]*)\}"

    def step(x: Column, _: Column) -> Column:
        def written_out(whole: Column) -> Column:
            head, inner = F.substring_index(whole, "{", 1), F.substring_index(F.substring_index(whole, "{", -1), "}", 1)
            items = F.array_join(F.transform(F.filter(F.split(inner, ","), lambda i: F.trim(i) != ""), lambda i: F.concat(head, F.trim(i))), ", ")
            at = F.instr(x, whole)
            return F.when(whole != "", F.concat(F.substring(x, F.lit(1), at - 1), items, F.substring(x, at + F.length(whole), F.length(x)))).otherwise(x)

        return T.bind(F.regexp_extract(x, pattern, 0), written_out)

    opened = F.length(use) - F.length(F.replace(use, F.lit("{"), F.lit("")))
    return F.when(opened > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), use, step)).otherwise(use)


def rust_imports(src: DataFrame) -> DataFrame:
    """(repo, path, line, kind, spec): mod, extern crate and use; groups in braces, also within each other, give a row a name."""
    mod, crate = _group(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"), _group(r"^\s*(?:pub\s+)?extern\s+crate\s+(\w+)")
    use = _group(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+)")
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+as\s+\w+$", ""), r"::self$", "")
    names = F.filter(F.transform(F.split(_ungrouped(F.col("use")), ","), plain), lambda x: x != "")
    one = lambda kind, x: F.when(x.isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), x.alias("spec"))))
    found = F.coalesce(one("mod", F.col("mod")), one("extern", F.col("crate")), F.transform(names, lambda x: F.struct(F.lit("use").alias("kind"), x.alias("spec"))))
    told = lines(src).where(F.col("code").rlike(r"\b(?:mod|extern|use)\b")).select("repo", "path", F.col("line_no").alias("line"), mod.alias("mod"), crate.alias("crate"), use.alias("use"))
    return told.select("repo", "path", "line", F.explode_outer(found).alias("x")).where("x is not null").select("repo", "path", "line", "x.*")


def jvm_imports(src: DataFrame) -> DataFrame:
    """(repo, path, line, kind, spec, is_static) of Java and Kotlin; `a.b.*` is kind import_wildcard with spec a.b."""
    rows = lines(src).withColumns({"spec": _group(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*(?:;|\sas\s|//|$)"), "is_static": F.col("code").rlike(r"^\s*import\s+static\s"), "kind": F.when(F.col("code").rlike(r"^\s*import\s+(?:static\s+)?[\w.]+\.\*"), F.lit("import_wildcard")).when(F.col("code").rlike(r"^\s*import\s+static\s"), F.lit("import_static")).otherwise(F.lit("import"))})
    return rows.where("spec is not null").select("repo", "path", F.col("line_no").alias("line"), "kind", "spec", "is_static")


def csharp_imports(src: DataFrame) -> DataFrame:
    """(repo, path, line, kind, spec, alias): using, global using, aliases and using static."""
    pattern = r"^\s*(?:global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?([A-Za-z_][\w.]*)\s*;"
    rows = lines(src).where(F.col("code").rlike(pattern))
    return rows.select("repo", "path", F.col("line_no").alias("line"), F.when(_group(pattern).isNotNull(), F.lit("using_static")).otherwise(F.lit("using")).alias("kind"), _group(pattern, 3).alias("spec"), _group(pattern, 2).alias("alias"))


def dart_imports(src: DataFrame) -> DataFrame:
    """(repo, path, line, kind, spec, alias, deferred, show, hide): import, export and part directives (`part of`: part_of).

    A directive goes on to its semicolon, over as many lines as it takes; a conditional import counts by its first name.
    """
    pattern = r"""^\s*(import|export|part\s+of|part)\s+["']([^"']+)["']"""
    rows = statements(src, F.regexp_replace("content", "\r\n", "\n"), DART_DIRECTIVES)
    kind = F.regexp_replace(_group(pattern), r"\s+", "_")
    names = lambda word: F.flatten(F.transform(F.regexp_extract_all("code", F.lit(rf"\s{word}\s+([\w\s,]+?)(?=\s+(?:show|hide)\s|\s*;|$)"), F.lit(1)), lambda x: F.split(F.trim(x), r"\s*,\s*")))
    return rows.select(
        "repo", "path", F.col("line_no").alias("line"), kind.alias("kind"), _group(pattern, 2).alias("spec"), _group(r"\sas\s+(\w+)").alias("alias"),
        F.col("code").rlike(r"\sdeferred\s+as\s").alias("deferred"), names("show").alias("show"), names("hide").alias("hide"),
    )


def declared_package(lang: str) -> Column:
    """Package or namespace that a file's content declares; null where none."""
    pattern = {"go": r"(?m)^\s*package\s+(\w+)", "cs": r"(?m)^\s*namespace\s+([\w.]+)"}.get(lang, r"(?m)^\s*package\s+([\w.]+)")
    return some(F.regexp_extract("content", pattern, 1))


def has_main(lang: str) -> Column:
    """Does the file hold the language's entry; Go also asks for package main, C# takes Program.cs too."""
    found = F.coalesce(F.col("content").rlike(MAIN[lang]), F.lit(False))
    if lang == "go":
        return found & (F.coalesce(declared_package("go"), F.lit("")) == "main")
    return found | (F.substring_index("path", "/", -1) == "Program.cs") if lang == "cs" else found


def manifest_names(manifests: DataFrame) -> DataFrame:
    """(repo, path, module): the module of go.mod and the package of Cargo.toml."""
    base = F.substring_index("path", "/", -1)
    name = F.when(base == "go.mod", F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1)).when(base == "Cargo.toml", F.regexp_extract("content", r"""(?ms)^\[package\][^\[]*?^\s*name\s*=\s*["']([^"']+)["']""", 1))
    return manifests.select("repo", "path", some(name).alias("module")).where("module is not null")
