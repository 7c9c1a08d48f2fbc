"""Quality rules by the frequency of lines across documents, in DataFrame functions only (operator 11).

Every document's lines are normalised and hashed. How many distinct documents of a host hold a line is counted over the whole
table; lines above the limits are removed, and documents that lose too much of their words are rejected. Counts of a text's own
words, symbols, repeated lines and repeated three-word windows come first and reject by themselves.

Rows move as hashes: one narrow row per distinct line of a distinct text of a host. Exact copies of a text on a host count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_split
from .decontaminate import bind

#: A line is above the limits when more distinct documents of its host than this hold it, and more than one in SHARE of them.
LEAST_DOCS, SHARE = 10, 20
#: Fewest words of a document; most percent of its words in repeated windows; least percent of its words in lines that stay.
MIN_WORDS, MOST_REPEATED, LEAST_LEFT = 50, 50, 50
#: Lines above the limits of at most this many counted rows are broadcast.
BROADCAST_LINES = 200_000
SPACE = r"[\x20\x09-\x0D]+"
TEXT_KEY = ["__cg_host", "__cg_text1", "__cg_text2"]
LINE_KEY = ["__cg_host", "line"]


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that are found twice or more. Windows are compared by 64-bit hashes, sorted with
    their places: n log n steps however long or repetitive the text is."""

    def covered(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), step)["n"]

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(pairs, covered)).otherwise(F.lit(0).cast("long"))

    def of(w: Column) -> Column:
        last = F.size(w) - 3
        windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(last >= 1, bind(windows, count)).otherwise(F.lit(0).cast("long"))

    return bind(words, of)


def normalised_lines(text: Column) -> Column:
    """Lines in lower case, every number written as 0, white space as single spaces, trimmed."""
    even = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(even, "\n"), lambda x: F.trim(x))


def _counts(text: Column) -> Column:
    """The base rules' counts as one struct."""
    words = F.array_remove(F.split(text, SPACE), "")
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    again = bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return F.struct(bind(words, of_words).alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), again.alias("n_dup_lines"))


def frequent_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(seen, above) of docs(TEXT_KEY, lines array<struct<line, words>>): seen has one row per distinct line of a distinct text of
    a host with the words it takes there; above has the lines over the limits, with their number of distinct documents."""
    texts = docs.groupBy(*TEXT_KEY).agg(F.first("lines").alias("lines"))
    seen = cut(texts.select(*TEXT_KEY, F.inline("lines")).groupBy(*TEXT_KEY, "line").agg(F.sum("words").alias("words")))
    often = cut(seen.groupBy(*LINE_KEY).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > least_docs))
    hosts = docs.select(*TEXT_KEY).distinct().groupBy("__cg_host").agg(F.count("*").alias("n_host"))
    return seen, cut(join_split(often, hosts, ["__cg_host"]).where(F.col("n_docs") * share > F.col("n_host")).select(*LINE_KEY, "n_docs"))


def _lost(seen: DataFrame, above: DataFrame) -> DataFrame:
    """Rows of seen whose line is above the limits. Lines that hold more than a thousandth of all rows are a thousand at most and
    broadcast; the others are broadcast as long as they are few, and joined by a shuffle beyond."""
    lines = above.drop("n_docs")
    if above.count() <= BROADCAST_LINES:
        return seen.join(F.broadcast(lines), LINE_KEY)
    total = seen.count()
    hot = F.broadcast(above.where(F.col("n_docs") * 1000 > total).select(*LINE_KEY))
    rest = above.where(F.col("n_docs") * 1000 <= total).select(*LINE_KEY)
    return seen.join(hot, LINE_KEY).unionByName(seen.join(hot, LINE_KEY, "left_anti").join(rest, LINE_KEY))


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, share: int = SHARE, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words), one row per row
    of docs; with_text adds kept_text, the text without its lines above the limits.

    base_failed: fewer than MIN_WORDS words, or more than MOST_REPEATED percent of them in repeated windows. kept: not
    base_failed, and at least LEAST_LEFT percent of the words are in lines that stay. Null and empty texts have no words; null
    and empty hosts are one host; lines without a word are neither counted nor removed. Null and repeated ids pass through; equal
    rows get equal results and count as one document of their host; an empty table gives no rows; other columns are ignored.
    Texts and lines are told apart by hashes of 128 and 64 bits (lines within a host).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit(""))).alias(TEXT_KEY[0]), *[F.xxhash64(F.lit(n), text).alias(TEXT_KEY[n]) for n in (1, 2)]]
    worded = F.filter(normalised_lines(text), lambda x: x != "")
    lines = F.transform(worded, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words")))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, _counts(text).alias("x"), lines.alias("lines"), *([text.alias("text")] if with_text else []))
    base = cut(base.select("doc_id", *TEXT_KEY, "x.w.*", "x.n_symbols", "x.n_dup_lines", "lines", *(["text"] if with_text else [])))
    lost = _lost(*frequent_lines(base, least_docs, share)).groupBy(*TEXT_KEY).agg(F.sum("words").alias("lost"), *([F.collect_list("line").alias("gone")] if with_text else []))
    out = join_split(base.drop("lines"), lost, TEXT_KEY, "left").withColumn("lost", F.coalesce("lost", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~failed & (100 * (F.col("n_words") - F.col("lost")) >= LEAST_LEFT * F.col("n_words"))
    stays = lambda x: ~F.coalesce(F.array_contains("gone", F.xxhash64(F.get(normalised_lines(x), F.lit(0)))), F.lit(False))
    cleaned = [F.array_join(F.filter(F.split("text", "\n"), stays), "\n").alias("kept_text")] if with_text else []
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), F.col("lost").alias("n_lost_words"), *cleaned)
