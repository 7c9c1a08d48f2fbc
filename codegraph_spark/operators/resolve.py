"""Imports to files: ordered candidates are exploded and joined by equality, the lowest rank that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .graph import cut, stored
from .imports import some
from .modules import KOTLIN_ROOTS, module_lookup, python_modules

#: Endings in the order they are tried.
JS_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")


#: What tells an import of a file from its others, where the imports carry it.
ASKED = ("ord", "line", "spec", "module", "name")


def _resolve(imports: DataFrame, candidates: Column, existing: DataFrame) -> DataFrame:
    """imports plus `hit`: what the first candidate that exists leads to (itself, or the column `hit` of existing); null where
    none. Repeated import rows are asked once, but all stay. Imports are made and their candidates named once, into the shared
    folder, and read twice. The joins are never broadcast: how large candidates become when they are exploded is not seen by the
    planner."""
    known = existing if "hit" in existing.columns else existing.select("repo", "path", F.col("path").alias("hit"))
    # 128 bits tell what is asked: repeating a list of candidates beside each of them would be its square
    named = imports.withColumn("__cg_all", candidates)
    named = stored(named.withColumn("__cg_asked", F.unhex(F.md5(F.to_json(F.struct("repo", "__cg_all"))))))
    asked = named.select("repo", "__cg_asked", "__cg_all").dropDuplicates(["__cg_asked"])
    exploded = asked.select("repo", "__cg_asked", F.posexplode("__cg_all").alias("rank", "path"))
    hits = exploded.hint("merge").join(known.select("repo", "path", "hit").distinct(), ["repo", "path"]).groupBy("__cg_asked").agg(F.min_by("hit", "rank").alias("hit"))
    return named.drop("__cg_all").join(hits.hint("merge"), "__cg_asked", "left").drop("__cg_asked")


def _edges(found: DataFrame, outside: Column, unknown: str = "static") -> DataFrame:
    """Edges of resolved imports; `internal` tells those that lead to a file, and what names the import is kept."""
    there = F.col("hit").isNotNull()
    certainty = F.when(there, F.lit("static")).otherwise(F.lit(unknown)).alias("certainty")
    return found.select("repo", F.col("path").alias("source"), F.coalesce("hit", outside).alias("target"), "kind", certainty, there.alias("internal"), *[c for c in ASKED if c in found.columns])


def resolve_js(imports: DataFrame, repo_paths: DataFrame) -> DataFrame:
    """Edges of JS imports: `./` and `../` by thirteen candidates; all else, and what no file answers, is external (raw)."""
    base = P.normalize_path(F.concat_ws("/", some(P.dirname(F.col("path"))), "spec"))
    local = F.col("spec").startswith("./") | F.col("spec").startswith("../")
    tries = F.when(local, F.array(*[F.concat("base", F.lit(e)) for e in JS_ENDINGS])).otherwise(F.array().cast("array<string>"))
    return _edges(_resolve(imports.withColumn("base", base), tries, repo_paths), F.col("spec"))


def resolve_python(imports: DataFrame, repo_paths: DataFrame) -> DataFrame:
    """Edges of Python imports. Absolute ones: the module of that name, else a name below a package folder or the repo's root;
    `from a import b` tries a.b, then a. Relative ones start at the file's own module name, less one part a dot. What nothing
    answers is the external package (of relative imports the own one), which is only a guess."""
    empty, imports = F.array().cast("array<string>"), stored(imports)
    own = python_modules(repo_paths.select("repo", "path").unionByName(imports.select("repo", "path"))).withColumnRenamed("module", "own")
    imports = imports.join(own, ["repo", "path"], "left").withColumn("own", F.coalesce("own", P.stem(F.col("path"))))
    parts, relative = F.split("own", r"\."), F.col("rel_dots") > 0
    up = F.size(parts) - F.col("rel_dots")
    base = F.when(relative & (up > 0), F.array_join(F.slice(parts, 1, F.greatest(up, F.lit(1))), ".")).when(~relative, F.lit(""))
    module = F.concat_ws(".", some(base), some(F.col("module")))
    full = F.when(F.col("name").isNotNull() & ~F.col("star"), F.concat_ws(".", some(module), "name"))
    keys = F.array_compact(F.array(
        F.when(~relative & ~F.col("star"), F.concat(F.lit("map:"), F.coalesce(full, module))),
        F.concat(F.lit("mod:"), full), F.when(module != "", F.concat(F.lit("mod:"), module)),
    ))
    outside = F.concat(F.lit("pip:"), F.substring_index(F.when(relative, F.col("own")).otherwise(F.coalesce(some(F.col("module")), F.col("name"))), ".", 1))
    return _edges(_resolve(imports, F.when(base.isNull(), empty).otherwise(keys), module_lookup(repo_paths)), outside, "heuristic")


#: Cells a task that products are cut into, see _spread().
CELLS = 4


def _spread(asked: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """asked LEFT JOIN members(*keys, hit), where a key may have many rows on both sides. All products together are cut into about
    CELLS cells a task, a key's share by the size of its product: rows of imports by columns of files, as square as its product. So no task makes
    a whole product, and a row is moved as often as the root of its key's cells, however many rows the key has."""
    n, by = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "__cg_row", "__cg_share"]
    asked = stored(asked)  # counted, led and kept where nothing is found
    sizes = asked.groupBy(*keys).agg(F.count("*").alias("a")).join(members.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    whole = sizes.agg(F.sum(F.col("a").cast("double") * F.col("m")).alias("whole"))
    cells = F.ceil(F.lit(n * CELLS) * F.col("a") * F.col("m") / F.col("whole"))
    sizes = sizes.crossJoin(F.broadcast(whole)).withColumn("cells", cells).withColumn("__cg_rows", F.greatest(F.lit(1), F.least("a", F.round(F.sqrt(F.col("cells") * F.col("a") / F.col("m"))))).cast("int"))
    grid = sizes.select(*keys, "__cg_rows", F.least("m", F.ceil(F.col("cells") / F.col("__cg_rows"))).cast("int").alias("__cg_shares"))
    dealt = asked.join(grid, keys, "left")
    own = lambda df, parts: F.pmod(F.xxhash64(*df.columns), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    led = dealt.where("__cg_rows is not null").withColumn("__cg_row", own(asked, "__cg_rows")).withColumn("__cg_share", each("__cg_shares"))
    held = members.join(grid, keys).withColumn("__cg_share", own(members, "__cg_shares")).withColumn("__cg_row", each("__cg_rows"))
    led, held = (df.drop("__cg_rows", "__cg_shares").repartition(n, *by) for df in (led, held))
    nowhere = dealt.where("__cg_rows is null").select(*asked.columns, F.lit(None).cast("string").alias("hit"))
    return led.join(held, by).select(nowhere.columns).unionByName(nowhere)


#: Begins the ids of nodes that stand for all files of a package; no path does.
PACKAGE = "package:"


def _through_packages(wanted: DataFrame, members: DataFrame, keys: list[str], name: Column, outside: Column) -> DataFrame:
    """Edges from imports to packages and, once a package, from these to its files: as many as imports and files, where leading
    every import to every file would make their product. members(*keys, hit) are the files of packages; name is a package's."""
    wanted, members = stored(wanted), stored(members)
    inside = members.select(*keys).distinct().withColumn("hit", F.concat(F.lit(PACKAGE), name))
    ends = _edges(wanted.join(inside, keys, "left"), outside)
    asked = members.join(wanted.select(*keys).distinct(), keys, "left_semi")
    held = asked.select("repo", F.concat(F.lit(PACKAGE), name).alias("source"), F.col("hit").alias("target"), F.lit("package").alias("kind"), F.lit("static").alias("certainty"), F.lit(True).alias("internal")).distinct()
    return ends.unionByName(held, allowMissingColumns=True)


def _packages(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that lead to packages, and (repo, package, file) of what these hold."""
    held = edges.where("kind = 'package'").select("repo", F.col("source").alias("package"), F.col("target").alias("file"))
    return edges.where((F.col("kind") != "package") & F.col("target").startswith(PACKAGE)), held


def without_packages(edges: DataFrame) -> DataFrame:
    """Edges through packages as edges to their files, each (source, target, kind) once."""
    heads, held = _packages(edges)
    led = heads.withColumnRenamed("target", "package").join(held, ["repo", "package"]).withColumnRenamed("file", "target").select(edges.columns)
    direct = edges.where((F.col("kind") != "package") & ~F.col("target").startswith(PACKAGE))
    return direct.unionByName(led).dropDuplicates(["repo", "source", "target", "kind"])


def disjoint_packages(edges: DataFrame) -> DataFrame:
    """Edges through packages, so that no (source, target, kind) is led through two packages: what package_degrees() then counts
    is without_packages(). Of packages that one file imports, one that another holds whole goes; those that share only some files
    lead to these directly."""
    by = ["repo", "source", "kind"]
    heads, held = _packages(edges)
    several = heads.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        return edges
    mine = cut(heads.join(several.select(*by), by, "left_semi").select(*by, F.col("target").alias("package")))
    held = held.join(mine.select("repo", "package").distinct(), ["repo", "package"], "left_semi")
    sizes = held.groupBy("repo", "package").agg(F.count("*").alias("size"))
    other = lambda df: df.withColumnRenamed("package", "other")
    shared = held.join(other(held), ["repo", "file"]).where("package <> other").groupBy("repo", "package", "other").agg(F.count("*").alias("both"))
    shared = shared.join(sizes, ["repo", "package"]).join(other(sizes).withColumnRenamed("size", "other_size"), ["repo", "other"])
    meets = cut(mine.join(other(mine), by).join(shared, ["repo", "package", "other"]))
    within = meets.where("both = size and (size < other_size or other < package)").select(*by, "package").distinct()
    left = meets.join(within, [*by, "package"], "left_anti").join(other(within), [*by, "other"], "left_anti")
    loose = cut(left.select(*by, "package").distinct())
    as_target = lambda df: df.withColumnRenamed("package", "target")
    taken = as_target(heads.withColumnRenamed("target", "package").join(loose, [*by, "package"], "left_semi")).select(edges.columns)
    direct = taken.withColumnRenamed("target", "package").join(held, ["repo", "package"]).withColumnRenamed("file", "target").select(edges.columns)
    kept = edges.join(as_target(within.union(loose)), [*by, "target"], "left_anti").select(edges.columns)
    return kept.unionByName(direct.dropDuplicates([*by, "target"]))


def package_degrees(edges: DataFrame) -> DataFrame:
    """(repo, id, inDeg, outDeg) of files and externals, from edges through packages: those that the graph without packages has,
    in which every import of a package leads to each of its files."""
    held = edges.where("kind = 'package'").select("repo", F.col("source").alias("package"), "target")
    direct = edges.where("kind <> 'package'")
    sizes = held.groupBy("repo", "package").agg(F.count("*").alias("size"))
    sent = direct.join(sizes.withColumnRenamed("package", "target"), ["repo", "target"], "left").groupBy("repo", F.col("source").alias("id")).agg(F.sum(F.coalesce("size", F.lit(1))).cast("long").alias("outDeg"))
    asked = direct.groupBy("repo", "target").agg(F.count("*").alias("n"))
    got = held.join(asked.withColumnRenamed("target", "package"), ["repo", "package"]).select("repo", F.col("target").alias("id"), "n")
    got = got.unionByName(asked.where(~F.col("target").startswith(PACKAGE)).select("repo", F.col("target").alias("id"), "n")).groupBy("repo", "id").agg(F.sum("n").alias("inDeg"))
    zero = F.lit(0).cast("long")
    return got.join(sent, ["repo", "id"], "full").select("repo", "id", F.coalesce("inDeg", zero).alias("inDeg"), F.coalesce("outDeg", zero).alias("outDeg"))


def resolve_go(imports: DataFrame, files: DataFrame, modules: DataFrame, packages: bool = False) -> DataFrame:
    """Edges of Go imports: a path below the repo's module leads to all files of that folder but its tests; else external.
    packages: through one node a package, see _through_packages()."""
    known = imports.join(modules.groupBy("repo").agg(F.min("module").alias("module")), "repo", "left")
    inside = (F.col("spec") == F.col("module")) | F.col("spec").startswith(F.concat("module", F.lit("/")))
    known = known.withColumn("dir", F.when(inside, F.expr("ltrim('/', substring(spec, length(module) + 1))")))
    there = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select("repo", P.dirname(F.col("path")).alias("dir"), F.col("path").alias("hit"))
    if packages:
        return _through_packages(known, there, ["repo", "dir"], F.col("dir"), P.external_id("go", F.col("spec")))
    return _edges(_spread(known, there, ["repo", "dir"]), P.external_id("go", F.col("spec")))


def resolve_fqn(imports: DataFrame, names: DataFrame, lang: str = "java", repo_paths: DataFrame | None = None) -> DataFrame:
    """Edges of exact Java or Kotlin imports by the map names(repo, fqn, path), of several paths the last; a static import drops
    its member. Kotlin's, where repo_paths are given, also try the file of that name below the usual folders."""
    exact = imports.where("kind <> 'import_wildcard'").withColumn("fqn", F.when(F.col("is_static"), F.regexp_replace("spec", r"\.[^.]*$", "")).otherwise(F.col("spec")))
    last = names.where("fqn is not null").groupBy("repo", "fqn").agg(F.max("path").alias("hit"))
    found = exact.join(last, ["repo", "fqn"], "left")
    if lang == "kt" and repo_paths is not None:
        file = F.concat(F.replace("fqn", F.lit("."), F.lit("/")), F.lit(".kt"))
        tries = F.array(*[F.concat(F.lit(f"{root}/" if root else ""), file) for root in KOTLIN_ROOTS])
        beside = _resolve(found.withColumnRenamed("hit", "named"), F.when(F.col("named").isNull(), tries).otherwise(F.array().cast("array<string>")), repo_paths)
        found = beside.withColumn("hit", F.coalesce("named", "hit")).drop("named")
    return _edges(found, P.external_id(lang, F.col("fqn")))


def resolve_wildcard(imports: DataFrame, names: DataFrame, lang: str = "java", packages: bool = False) -> DataFrame:
    """Edges of `a.b.*`: every name below the prefix. Each name's own prefixes are exploded, so the join is by equality. Kotlin's
    also lead to what has exactly that name or package and, where none of these is there, to the files of the package's folder.
    packages: through one node a prefix, see _through_packages().
    """
    parts = F.split("fqn", r"\.")
    lengths = F.sequence(F.lit(1), F.greatest(F.size(parts) - (0 if lang == "kt" else 1), F.lit(1)))
    prefixes = F.transform(lengths, lambda n: F.array_join(F.slice(parts, 1, n), "."))
    below = names.where("fqn is not null").select("repo", F.explode(prefixes).alias("spec"), F.col("path").alias("hit"))
    wild = imports.where("kind = 'import_wildcard'")

    def lead(members: DataFrame) -> DataFrame:
        outside = P.external_id(lang, F.col("spec"))
        return _through_packages(wild, members, ["repo", "spec"], F.col("spec"), outside) if packages else _edges(_spread(wild, members, ["repo", "spec"]), outside)

    if lang != "kt":
        return lead(below)
    if "package" in names.columns:
        below = below.unionByName(names.where("package is not null").select("repo", F.col("package").alias("spec"), F.col("path").alias("hit"))).distinct()
    folders = names.select("repo", P.dirname(F.col("path")).alias("path")).distinct()
    file = F.replace("spec", F.lit("."), F.lit("/"))
    missed = wild.select("repo", "spec").distinct().join(below.select("repo", "spec").distinct(), ["repo", "spec"], "left_anti").select("repo", "spec")
    there = _resolve(missed, F.array(*[F.concat(F.lit(f"{root}/" if root else ""), file) for root in KOTLIN_ROOTS]), folders).where("hit is not null")
    inside = there.join(names.select("repo", P.dirname(F.col("path")).alias("hit"), "path"), ["repo", "hit"]).select("repo", "spec", F.col("path").alias("hit"))
    return lead(below.unionByName(inside))


def resolve_rust(imports: DataFrame, repo_paths: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges of Rust facts: `mod x` leads to x.rs or x/mod.rs beside the file (below its own folder unless it is main, lib or mod);
    `use` to the longest path below crate, self or super that is a file; else the external crate if dependencies(repo, name) has
    it. extern crate is always external; a `use` of neither a file nor a dependency gives no edge."""
    path, spec = F.col("path"), F.col("spec")
    folder, own = P.dirname(path), P.stem(path)
    module = F.when(own.isin("main", "lib", "mod"), folder).otherwise(F.concat_ws("/", some(folder), own))
    # parts, and what is made of them, are columns: each is then made once a row
    imports = imports.withColumn("parts", F.filter(F.split(F.regexp_replace(spec, r"\s+as\s+\w+$", ""), "::"), lambda x: ~x.isin("", "*")))
    imports = imports.withColumn("crate", F.coalesce(F.get("parts", F.lit(0)), F.lit("")))
    parts, first = F.col("parts"), F.col("crate")
    head = F.when(first == "crate", F.regexp_extract(path, r"^(.*?\bsrc)/", 1)).when(first == "super", P.dirname(module)).otherwise(module)
    imports = imports.withColumns({"head": head, "inner": F.when(first.isin("crate", "self", "super"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)})
    inner = F.col("inner")
    lengths = F.filter(F.reverse(F.sequence(F.lit(0), F.size(inner))), lambda n: n > 0)
    bases = F.transform(F.when(F.size(inner) > 0, lengths).otherwise(F.array().cast("array<int>")), lambda n: F.concat_ws("/", some(F.col("head")), F.array_join(F.slice(inner, 1, n), "/")))
    tries = F.when(F.col("kind") == "extern", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(bases, lambda x: F.array(F.concat(x, F.lit(".rs")), F.concat(x, F.lit("/mod.rs"))))))
    crates = dependencies.select("repo", F.replace("name", F.lit("-"), F.lit("_")).alias("crate"), F.lit(True).alias("known")).distinct()
    found = _resolve(imports, tries, repo_paths).join(crates, ["repo", "crate"], "left")
    return _edges(found.where("hit is not null or known or kind <> 'use'"), P.external_id("rs", spec))


def resolve_csharp(imports: DataFrame, anchors: DataFrame, repo_paths: DataFrame | None = None) -> DataFrame:
    """Edges of `using`: the namespace's anchor file, else the external package; of `using static A.B.C`, where repo_paths are
    given: A/B/C.cs below src, Source or the root, else the type's external package."""
    found = imports.where("kind = 'using'").join(anchors.select("repo", F.col("namespace").alias("spec"), F.col("anchor").alias("hit")), ["repo", "spec"], "left")
    plain = _edges(found, P.external_id("cs", F.col("spec")))
    if repo_paths is None:
        return plain
    file = F.concat(F.replace("spec", F.lit("."), F.lit("/")), F.lit(".cs"))
    tries = F.array(*[F.concat(F.lit(root), file) for root in ("src/", "Source/", "")])
    static = _resolve(imports.where("kind = 'using_static'"), tries, repo_paths)
    return plain.unionByName(_edges(static, P.external_id("cs", F.col("spec"), is_type=True)))


def resolve_dart(imports: DataFrame, repo_paths: DataFrame, package: str | DataFrame) -> DataFrame:
    """Edges of Dart directives: relative, or `package:` of the repo's own package, to files; else external. package is one name
    or packages(repo, package). `part` also gives an edge back, `part-of`; `part of` directives give none of their own."""
    imports = imports.where("kind <> 'part_of'")
    named = imports.withColumn("package", F.lit(package)) if isinstance(package, str) else imports.join(package.groupBy("repo").agg(F.min("package").alias("package")), "repo", "left")
    own = F.coalesce(F.col("spec").startswith(F.concat(F.lit("package:"), "package", F.lit("/"))), F.lit(False))
    relative = ~F.col("spec").contains(":")
    base = P.normalize_path(F.concat_ws("/", some(P.dirname(F.col("path"))), "spec"))
    tries = F.when(own, F.array(F.concat(F.lit("lib/"), F.regexp_extract("spec", "^package:[^/]*/(.*)$", 1)))).when(relative, F.array(base)).otherwise(F.array().cast("array<string>"))
    edges = _edges(_resolve(named, tries, repo_paths), P.external_id("dart", F.col("spec")))
    back = edges.where("kind = 'part' and internal").withColumns({"source": F.col("target"), "target": F.col("source"), "kind": F.lit("part-of")})
    return edges.unionByName(back.select(edges.columns))


def entry_files(entries: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, id): the files of entry modules; modules without a file are dropped."""
    return entries.join(modules.select("repo", "module", F.col("path").alias("id")), ["repo", "module"]).select("repo", "id").distinct()
