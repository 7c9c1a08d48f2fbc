"""Path, package and module names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

SOURCE_EXTENSIONS = {
    "js": (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx"),
    "py": (".py", ".pyw", ".pyi"),
    "go": (".go",),
    "rs": (".rs",),
    "java": (".java",),
    "kt": (".kt",),
    "cs": (".cs",),
    "dart": (".dart",),
}


def canonical_path(path: Column) -> Column:
    """Trimmed, forward slashes, no `\\\\?\\` prefix, single slashes (a leading pair stays), upper-case drive letter; empty: null."""
    p = F.replace(F.regexp_replace(F.trim(path), r"^\\\\\?\\", ""), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, "^(//)/*|(/)/+", "$1$2")
    # bound, since the planner would make path anew wherever it is named
    return bind(p, lambda p: F.when(p != "", F.concat(F.upper(F.regexp_extract(p, "^(?:[a-z]:)?", 0)), F.regexp_replace(p, "^[a-z]:", ""))))


def normalize_path(path: Column) -> Column:
    """`.` and `..` segments resolved; a `..` that leads out of a relative path stays."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))

    def push(done: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((s == "..") & absolute, done).otherwise(F.concat(done, F.array(s)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), push), "/")
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), joined)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext(path: Column) -> Column:
    """Extension with its dot; empty where the name has no dot beyond its first character."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def npm_package(spec: Column) -> Column:
    """`@scope/name` or the first segment."""
    s = F.replace(spec, F.lit("\\"), F.lit("/"))
    return F.when(s.startswith("@"), F.regexp_extract(s, "^(@[^/]*(?:/[^/]*)?)", 1)).otherwise(F.substring_index(s, "/", 1))


def _segments(name: Column, n: int) -> Column:
    return F.substring_index(name, ".", n)


def external_id(lang: str, spec: Column, is_type: bool = False) -> Column:
    """Id of the external package that an import names."""
    if lang == "py":
        return F.concat(F.lit("pip:"), _segments(spec, 1))
    if lang == "go":
        return F.concat(F.when(F.substring_index(spec, "/", 1).contains("."), F.lit("go:")).otherwise(F.lit("std:")), spec)
    if lang == "rs":
        return F.concat(F.lit("crate:"), F.substring_index(spec, "::", 1))
    if lang in ("java", "kt"):
        java = F.when(spec.rlike(r"^javax?(\.|$)"), F.concat(F.lit("java:"), _segments(spec, 2)))
        return java.when(spec.rlike(r"^kotlinx?(\.|$)"), F.concat(F.lit("kotlin:"), _segments(spec, 2))).otherwise(F.concat(F.lit("mvn:"), _segments(spec, 2)))
    if lang == "cs":
        name = F.regexp_replace(spec, r"\.[^.]*$", "") if is_type else spec
        return F.when(name.rlike(r"^System(\.|$)"), F.lit("dotnet:System")).otherwise(F.concat(F.lit("nuget:"), _segments(name, 2)))
    if lang == "dart":
        pub = F.when(spec.startswith("package:"), F.concat(F.lit("pub:"), F.regexp_extract(spec, "^package:([^/]*)", 1)))
        return F.when(spec.startswith("dart:"), spec).otherwise(pub.otherwise(F.concat(F.lit("external:"), spec)))
    return spec


def java_fqn(package: Column, declared: Column, path: Column) -> Column:
    """package.class; without a class the file's stem."""
    name = F.coalesce(declared, stem(path))
    return F.when(F.coalesce(package, F.lit("")) != "", F.concat_ws(".", package, name)).otherwise(name)


def kotlin_fqn(package: Column, declared: Column) -> Column:
    """package.declaration, else the declaration, else the package."""
    return F.when(package.isNotNull() & declared.isNotNull(), F.concat_ws(".", package, declared)).otherwise(F.coalesce(declared, package))


def is_source(path: Column, lang: str) -> Column:
    return F.exists(F.array(*map(F.lit, SOURCE_EXTENSIONS[lang])), lambda e: F.endswith(path, e))
