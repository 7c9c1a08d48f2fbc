"""Benchmark decontamination by winnowing, in DataFrame functions only (operator 7).

A fingerprint is the smallest k-gram hash in every 9 consecutive 5-grams of words, so any 13 consecutive words that a
document shares with an item leave a shared fingerprint. Documents that share one with an item are then extended: the
document's windows of 13 words around the hit are compared, word for word, with the item's. An item of fewer words than the
window is one fingerprint of its own length. The benchmark's side is broadcast only when its counted rows are below a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_DOC, ROW_HASH, cut, row_identity

WINDOW, GRAM = 13, 5
#: A benchmark of at most this many fingerprints or items is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anything ASCII but letters and digits, in texts that are not yet lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and anything beyond ASCII. Null text has none."""
    return F.transform(_raw_words(text), lowered)


def lowered(word: Column) -> Column:
    """Most words are in lower case already."""
    return F.when(F.lower(word) != word, F.translate(word, UPPER, LOWER)).otherwise(word)


def _raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN_WORDS), "")


def gram_hashes(hashes: Column, n: int) -> Column:
    """Hash of every n consecutive word hashes; hashes is a column or a bound value."""
    last = F.size(hashes) - n
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def winnow(grams: Column, span: int) -> Column:
    """Distinct smallest hashes of every `span` consecutive k-grams."""

    def least(g: Column) -> Column:
        last = F.size(g) - span
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.least(*[F.get(g, i + j) for j in range(span)]))
        return F.when(last >= 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return bind(grams, least)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, identity: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items), one row per row of docs.

    A document word is hit inside any occurrence of `window` consecutive words of an item, or of a whole shorter item. items
    holds the item ids with occurring windows, sorted as strings; null and repeated ids of items are kept once. contaminated:
    any word hit, and a twentieth of the words or more. Null and empty texts have no words and hit nothing; equal item texts
    are compared once; repeated document rows each get their row; an empty benchmark hits nothing. identity: the columns of
    row_identity come first, to join the result back to rows whose ids are null or repeated.
    """
    grams = window - gram + 1
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where("size(w) > 0").withColumn("seq", F.xxhash64("w"))
    sequences = cut(items.groupBy("seq", "w").agg(F.min("item").alias("_")).select("seq", "w", F.least(F.size("w"), F.lit(window)).alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h")))
    stat = sequences.agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0)), F.collect_set(F.when(F.col("n") < window, F.col("n")))).first()
    n_items, n_prints, short = stat[0], stat[1], sorted(stat[2])
    marks = sequences.where(F.col("n") == window).select("seq", F.explode(winnow(gram_hashes(F.col("h"), gram), grams)).alias("mark"))
    for n in short:
        marks = marks.union(sequences.where(F.col("n") == n).select("seq", F.explode(gram_hashes(F.col("h"), n))))

    base = docs.select(*row_identity(F.col(id_col), F.col(text_col)), F.col(id_col).cast("long").alias("doc_id"), _raw_words(F.col(text_col)).alias("w"))
    prints = lambda h: F.concat(winnow(gram_hashes(h, gram), grams), *[F.array_distinct(gram_hashes(h, n)) for n in short])
    both = bind(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), bind(F.transform(w, lambda x: F.xxhash64(lowered(x))), prints).alias("prints")))
    counted = cut(base.select(ROW_DOC, ROW_HASH, "doc_id", both.alias("x")).select(ROW_DOC, ROW_HASH, "doc_id", "x.n_words", "x.prints"))

    met = counted.select(ROW_DOC, ROW_HASH, F.explode("prints").alias("mark")).join(_small(marks, n_prints), "mark")
    met = cut(met.groupBy(ROW_DOC, ROW_HASH).agg(F.collect_set("seq").alias("seqs"), F.collect_set("mark").alias("marks")))
    n_met = met.count()

    # windows of the candidate documents around their hits, as (start, text)
    texts_of = docs.select(*row_identity(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text")).join(_small(met, n_met * 20), [ROW_DOC, ROW_HASH])
    candidates = texts_of.dropDuplicates([ROW_DOC, ROW_HASH]).withColumn("w", words(F.col("text"))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))

    def around(n: int, k: int) -> Column:
        """Starts of windows of n words that hold a hit k-gram."""
        hits = F.filter(F.transform(gram_hashes(F.col("h"), k), lambda g, i: F.when(F.array_contains("marks", g), i)), lambda i: i.isNotNull())
        last = F.size("w") - n
        starts = F.flatten(F.transform(hits, lambda p: F.sequence(F.least(F.greatest(p - (n - k), F.lit(0)), last), F.least(p, last))))
        return F.when(last >= 0, F.array_distinct(starts)).otherwise(F.array().cast("array<int>"))

    def texts(starts: Column, n: int) -> Column:
        return F.transform(starts, lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), F.array_join(F.slice("w", s + 1, n), " ").alias("t")))

    around_hits = F.concat(texts(around(window, gram), window), *[texts(around(n, n), n) for n in short])
    candidates = candidates.select(ROW_DOC, ROW_HASH, "seqs", around_hits.alias("windows"))
    own = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda s: F.array_join(F.slice("w", s + 1, F.col("n")), " "))
    known = sequences.select("seq", "n", own.alias("own"))
    pairs = candidates.select(ROW_DOC, ROW_HASH, "windows", F.explode("seqs").alias("seq")).join(_small(known, n_items + n_prints // 20), "seq")
    hit = F.filter("windows", lambda x: (x["n"] == F.col("n")) & F.array_contains("own", x["t"]))
    hits = pairs.select(ROW_DOC, ROW_HASH, "seq", F.transform(hit, lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["n"]).alias("e"))).alias("spans")).where("size(spans) > 0")

    # words under the union of the spans: walk them in order, counting what lies behind the furthest end
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e"))
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans"))))
    per_doc = hits.groupBy(ROW_DOC, ROW_HASH).agg(spans.alias("spans"), F.collect_list("seq").alias("seqs")).select(ROW_DOC, ROW_HASH, F.aggregate("spans", zero, step)["n"].alias("n_hit"), "seqs")
    ids = items.select("seq", "item").where("item is not null").groupBy("seq").agg(F.collect_set("item").alias("ids"))
    named = per_doc.select(ROW_DOC, ROW_HASH, F.explode("seqs").alias("seq")).join(_small(ids, n_items), "seq").groupBy(ROW_DOC, ROW_HASH).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    result = per_doc.select(ROW_DOC, ROW_HASH, "n_hit").join(named, [ROW_DOC, ROW_HASH], "left")
    out = counted.select(ROW_DOC, ROW_HASH, "doc_id", "n_words").join(result, [ROW_DOC, ROW_HASH], "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*([ROW_DOC, ROW_HASH] if identity else []), "doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), found.alias("items"))
