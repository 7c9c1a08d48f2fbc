"""One query per operator, each over its whole tables, and oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontaminate, html, langid, phrases, pii, quality, secrets, simhash, topk, trie

#: Key of the pseudonyms in op3's query; a user passes a key of their own.
DEMO_KEY = b"codegraph-spark demonstration key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ours = turns.sparkSession.createDataFrame([(-7, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(ours)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(_table(spark, sf_dir, "documents"), DEMO_KEY)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated_phrases(_table(spark, sf_dir, "documents"), digest_only=True)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_corpus(_table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = trie.turn_steps(_table(spark, sf_dir, "conversations"))
    return trie.trie_nodes(*trie.with_shared_openings(*steps))


QUERIES = {f.__name__: f for f in (op1_topk, op2_chat, op3_pii, op4_simhash, op5_html, op6_secrets, op7_decontaminate, op8_bpe, op9_langid, op10_phrases, op11_quality, op12_align, op13_trie)}

ORACLES = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op2_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        x AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS written FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(role) + written + 10) AS BIGINT) AS formatted_chars
        FROM x GROUP BY conv_id""",
    "op7_decontaminate": r"""
        WITH low AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        d AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM low),
        lowi AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
        i AS (SELECT item_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM lowi),
        iw AS (
            SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), 13) AS n FROM i WHERE len(w) > 0))),
        lens AS (SELECT DISTINCT n FROM iw),
        dw AS (
            SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
        h AS (SELECT dw.doc_id, dw.n, dw.s, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_phrases": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        g AS (
            SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
        f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM g JOIN f USING (g) WHERE least < doc_id),
        k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
        kept AS (
            SELECT k.doc_id, count(gone.p) AS n_removed, string_agg(k.w[k.p], ' ' ORDER BY k.p) FILTER (gone.p IS NULL) AS t
            FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.p = gone.p GROUP BY k.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_quality": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
        d AS (
            SELECT doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
        g AS (SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
        r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM g JOIN r USING (doc_id, g)) GROUP BY doc_id),
        n AS (
            SELECT doc_id, host, text, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))), ' ') AS line FROM d),
        f AS (SELECT host, line, count(DISTINCT text) AS n_docs FROM n WHERE line <> '' GROUP BY host, line),
        h AS (SELECT host, count(DISTINCT text) AS n_host FROM d GROUP BY host),
        above AS (SELECT host, line FROM f JOIN h USING (host) WHERE n_docs > 10 AND n_docs * 20 > n_host),
        lost AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM n JOIN above USING (host, line) GROUP BY doc_id),
        c AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost_words
            FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_lost_words) >= 50 * n_words AS kept
        FROM c""",
    "op13_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (
            SELECT DISTINCT c, c - c % 100 AS first, xor(list_reduce(
                list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 6 AS h FROM t),
        b AS (
            SELECT ids.c, 0 AS part, t.pos, role, text FROM ids JOIN t ON t.c = ids.first AND t.pos <= h
            UNION ALL SELECT ids.c, 1, t.pos, role, text FROM ids JOIN t ON t.c = ids.c AND t.pos > h),
        s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, sha256(role || chr(0) || text) AS x, length(text) AS k FROM b),
        l AS (SELECT ids.c, count(d) AS n, coalesce(list(x ORDER BY d) FILTER (d IS NOT NULL), []) AS xs, coalesce(list(k ORDER BY d) FILTER (d IS NOT NULL), []) AS ks
            FROM ids LEFT JOIN s USING (c) GROUP BY ids.c),
        m AS (SELECT c, n, d, array_to_string(xs[1:d], ',') AS node, CASE WHEN d > 0 THEN array_to_string(xs[1:d - 1], ',') END AS parent, CASE WHEN d > 0 THEN ks[d] ELSE 0 END AS k
            FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM l)),
        nodes AS (
            SELECT d, node, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(k) AS worth,
                coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends, max(n) = d AS leaf FROM m GROUP BY d, node),
        kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
        below AS (
            SELECT v.d, v.node, sum(u.worth) AS saved, count(*) FILTER (u.leaf) AS leaves
            FROM nodes v JOIN nodes u ON u.d >= v.d AND (v.d = 0 OR u.node = v.node OR starts_with(u.node, v.node || ',')) GROUP BY v.d, v.node)
        SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children,
            CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM nodes v LEFT JOIN nodes p ON p.d = v.d - 1 AND p.node = v.parent LEFT JOIN kids ON kids.d = v.d AND kids.node = v.node
            JOIN below ON below.d = v.d AND below.node = v.node""",
}
