import hashlib

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codegraph_spark.llm import bpe, chat, decontaminate, html, langid, phrases, pii, secrets, simhash, topk

random.seed(7)
WORDS = [f"w{i}" for i in range(60)]


def table(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(1, len(texts) + 1), texts, strict=True)), "doc_id long, text string")


def prose(n):
    return [random.choice(WORDS) for _ in range(n)]


def test_simhash_matches_brute_force(spark):
    base = prose(80)
    texts = [None, "", "one", " ".join(base), " ".join(base), " ".join(base[:-1] + ["x"])] + [" ".join(prose(80)) for _ in range(20)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(table(spark, texts)).collect()}

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        g = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == {i + 1: (f"{f:016x}", c + 1) for i, (f, c) in enumerate(zip(fps, comp, strict=True))}


def as_long(fp):
    return int(np.uint64(fp).astype(np.int64))


def components_of(fps, links):
    comp = {f: f for f in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        comp[max(a, b)] = min(a, b)
    return {f: root(f) for f in fps}


def all_near_pairs(fps, radius=4):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]


def links_of(spark, fps):
    return [(r["src"], r["dst"]) for r in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]


def test_simhash_links_at_four_bits(spark):
    x = 0x123456789ABCDEF0
    near = [as_long(v) for v in (x, x ^ 0b1111, x ^ (0b11111 << 40), x ^ 0b1111 ^ (0b1111 << 50), x ^ (1 << 63) ^ (1 << 2))]
    links = links_of(spark, near)
    assert links and all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    assert components_of(near, links) == components_of(near, all_near_pairs(near))
    assert len(set(components_of(near, links).values())) == 2


def test_simhash_links_against_all_pairs(spark):
    """A table's own fingerprints, and groups of near copies around one fingerprint: same components, and few links."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = sorted({r["fp"] for r in simhash.fingerprints(docs).collect()})
    assert components_of(fps, links_of(spark, fps)) == components_of(fps, all_near_pairs(fps))
    group = set()
    for base in (random.getrandbits(64), 0, 2**64 - 1):
        for n in range(300):
            v = base
            for _ in range(n % 5):
                v ^= 1 << random.randrange(64)
            group.add(as_long(v))
    group = sorted(group | {as_long(random.getrandbits(64)) for _ in range(200)})
    links = links_of(spark, group)
    assert components_of(group, links) == components_of(group, all_near_pairs(group))
    assert len(links) < 20 * len(group)
    assert links_of(spark, []) == []


def test_simhash_null_and_repeated_ids_long_texts(spark):
    long = " ".join(prose(60_000))
    rows = simhash.simhash_components(table(spark, ["a b", "a b", "a b", long, None], [None, 9, 9, 4, None]).withColumn("least", F.lit(1))).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == sorted([(None, 9), (9, 9), (9, 9), (4, 4), (None, None)], key=str)


def test_phrases_brute_force(spark):
    common = prose(30)
    texts = [None, "", " ".join(common), "a b " + " ".join(common[3:25]) + " c", " ".join(prose(12)), " ".join(common[:12]), " ".join(common + common)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in phrases.remove_repeated_phrases(table(spark, texts)).collect()}
    docs = [(t or "").split() for t in texts]
    first = {}
    for i, d in enumerate(docs):
        for s in range(len(d) - 12):
            first.setdefault(tuple(d[s : s + 13]), i)
    for i, d in enumerate(docs):
        gone = {p for s in range(len(d) - 12) if first[tuple(d[s : s + 13])] < i for p in range(s, s + 13)}
        assert got[i + 1] == (len(d), len(gone), " ".join(w for p, w in enumerate(d) if p not in gone))


def brute_phrases(rows, window):
    """(id, words, removed, kept) of rows (id, text), by comparing all windows."""
    docs = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, d in docs:
        for s in range(len(d) - window + 1) if i is not None else ():
            w = tuple(d[s : s + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, d in docs:
        gone = {p for s in range(len(d) - window + 1) if i is not None and first[tuple(d[s : s + window])] < i for p in range(s, s + window)}
        out.append((i, len(d), len(gone), " ".join(w for p, w in enumerate(d) if p not in gone)))
    return sorted(out, key=str)


def test_phrases_few_words_null_and_repeated_ids(spark):
    """Two words only, so passages overlap, repeat within a document and in each other; null and repeated ids."""
    for window, letters in ((13, "ab"), (5, "abc"), (4, "ab"), (1, "abc")):
        rows = [(random.choice([None, *range(30)]), " ".join(random.choice(letters) for _ in range(random.randint(0, 60)))) for _ in range(80)]
        rows += [(40, "a " * 400), (41, "a " * 300), (42, None), (43, " ".join(prose(20_000))), (44, "a b " * 50), (44, "a b " * 50)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1))
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in phrases.remove_repeated_phrases(docs, window=window).collect()]
        assert sorted(got, key=str) == brute_phrases(rows, window)


def test_phrases_of_several_shards():
    docs = [prose(300) for _ in range(6)]
    found = [(docs[0][i : i + 20], 0) for i in range(0, 280, 20)]
    one = phrases.cover_passages([*docs, docs[0]], list(range(7)), found)
    many = phrases.cover_passages([*docs, docs[0]], list(range(7)), found, shard=3)
    assert all((a == b).all() for a, b in zip(one, many)) and one[6][:280].all() and not one[0].any()


def test_decontamination(spark):
    item = prose(40)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short one"), (3, None), (4, " ".join(item))], "item_id long, text string")
    texts = [None, "", "A short, ONE here", " ".join(prose(50) + item[5:25] + prose(50)), " ".join(item[:12]), " ".join(item).upper()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(table(spark, texts), bench).collect()}
    assert got[1] == (0, 0, [], False) and got[2] == (0, 0, [], False)
    assert got[3] == (4, 2, ["2"], True) and got[5] == (12, 0, [], False)
    assert got[4][0] == 120 and 20 <= got[4][1] <= 24 and got[4][2] == ["1", "4"]
    assert got[6] == (40, 40, ["1", "4"], True)
    none = decontaminate.contamination(table(spark, texts), bench.limit(0))
    assert none.agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_against_brute_force(spark):
    """Few words, so items overlap and hit in many places; null, short and repeated items; null, empty, repeated and long documents."""
    bench = [(n, " ".join(random.choice("abc") for _ in range(random.choice([3, 14, 15, 20])))) for n in range(12)] + [(30, None), (31, "a b"), (31, "a b"), (None, "c c c"), (32, "")]
    docs = [(n, " ".join(random.choice("abc,") for _ in range(random.randint(0, 40)))) for n in range(25)] + [(None, "a a b"), (3, "a b"), (3, "a b"), (50, None), (51, " ".join(prose(20_000) + ["a", "b"]))]
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    windows = {}
    for i, t in bench:
        w = words(t)
        for s in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[s : s + 13]), set()).add(i)
    want = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    items |= {str(x) for x in found if x is not None}
        want.append((i, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"w": F.lit(1), "seqs": F.lit("x"), "item": F.lit(2)})
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("seq", F.lit(1))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(frame, items).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.contamination(frame.limit(0), items).count() == 0


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_against_regex(spark):
    scan = secrets.scanner()
    bits = ["password", "passwd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abcdef", "AKIA", "ABCDEFGH", "0123456789abcdef", "deadbeef", ".", "é", "\n", "secretoken", "-"]
    for _ in range(3000):
        t = "".join(random.choice(bits) for _ in range(random.randint(0, 25)))
        data = t.encode()
        assert [(s, n, e) for n, s, e in secrets.in_code_points(data, scan.spans(data)) if n < 3] == brute_secrets(t), t
    rows = secrets.digests(secrets.scan_secrets(table(spark, [None, "é password=abcdefg1 x"]))).collect()
    assert [(r["n_assign"], r["spans"]) for r in rows] == [(0, ""), (1, "assign:2:19")]
    assert secrets.redact_secrets(table(spark, ["é password=abcdefg1 x", None])).collect()[0]["text"] == "é [assign] x"


def test_secret_rule_expressions():
    rules = ("a{2}b?|[c-e]+x", r"(?:ab|c){1,3}\x20*d", r"\.[a-c.\]-]*")
    table, accept = secrets.compile_rules(rules, restart=False)
    for _ in range(3000):
        t = "".join(random.choice("abcdex .]-") for _ in range(random.randint(0, 7)))
        state = 0
        for c in t.encode():
            state = table[state][c] if state >= 0 else -1
        found = int(accept[state]) if state >= 0 else 0
        assert found == sum(1 << n for n, r in enumerate(rules) if re.fullmatch(r, t)), t
    for bad in ("a.b", "[^a]", "a*?", r"\d", "(a", "a)", "é", "*a"):
        with pytest.raises((ValueError, IndexError)):
            secrets.parse(bad)


def test_secrets_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    names = ("assign", "access", "hex")
    for r in secrets.digests(secrets.scan_secrets(docs)).collect():
        spans = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{names[n]}:{s}:{e}" for s, n, e in spans).encode()).hexdigest()


def test_bpe_is_tiktoken(spark):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    coder = bpe._encoder(None, None)
    real = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    letters = "abcde 'stlLdé\n\t\x1c\x85\xa0  ²½1290中日😀ñß_-./<|endoftext|>\r "
    for k in range(3000):
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(t), repr(t)
        assert coder.decode(ids) == t.encode()
    long = "ab" * 3000
    assert np.frombuffer(coder.encode(long), "<u4").tolist() == real.encode_ordinary(long)
    rows = bpe.encode_digests(table(spark, [None, "a b"])).collect()
    assert rows[0]["n_tokens"] == 0 and rows[1]["decoded_sha256"] == hashlib.sha256(b"a b").hexdigest()


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.learn(docs)).where(langid.is_held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right, all_ = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / all_ > 0.95
    und = langid.identify(table(spark, [None, "", "123 !"]), langid.learn(docs)).collect()
    assert {(r["lang_pred"], r["score"]) for r in und} == {("und", 0.0)}
    assert langid.learn(docs.limit(0)).languages == []


def test_language_kernel_is_exact_with_all_rows_as_landmarks():
    """Nyström features over all rows are those of the whole kernel: the scores are kernel ridge regression's."""
    texts = ["der hund läuft", "die katze und der hund", "ein haus am see", "the dog runs", "a cat and the dog", "house by the lake", "le chien court"]
    names = ["de", "de", "de", "en", "en", "en", "fr"]

    def brute(t):
        t = " " + re.sub(r"[^a-zäöüß]+", " ", t.lower()).strip() + " "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    sets, ask = [brute(t) for t in texts], ["the hund", "le chat", "see lake"]
    kernel = lambda xs: np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in xs])
    goal = np.array([[float(n == g) for g in ("de", "en", "fr")] for n in names])
    weight = np.array([7 / (3 * names.count(n)) for n in names])
    want = kernel([brute(t) for t in ask]) @ np.linalg.solve(kernel(sets) + 7e-3 * np.diag(1 / weight), goal)
    model = langid.fit(texts, names, landmarks=21)
    assert np.allclose(model.kernel([langid.ngrams(t) for t in ask]) @ model.weights, want, atol=1e-3)


def test_language_many_languages_and_scripts(spark):
    """More than 200 languages, each of three letters beyond the most frequent of the sample."""
    rng = random.Random(3)
    alphabets = {f"l{n:03d}": [chr(0x4E00 + 3 * n + k) for k in range(3)] for n in range(260)}
    rows = [(g, "".join(rng.choice([*a, " "]) for _ in range(60))) for g, a in alphabets.items() for _ in range(4)]
    model = langid.fit([t for _, t in rows], [g for g, _ in rows])
    assert len(model.languages) == 260
    assert [model.predict(["".join(a)])[0][0] for a in alphabets.values()] == list(alphabets)
    docs = spark.createDataFrame([(n, g, t) for n, (g, t) in enumerate(rows)], "doc_id long, lang string, text string")
    assert 200 < len(langid.learn(docs).languages) and len(langid.learn(docs, most_rows=20).languages) <= 20
    clash = langid.identify(docs.limit(3).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)}), model)
    assert clash.columns == ["doc_id", "lang", "text", "lang_pred", "score"] and clash.schema["score"].dataType.typeName() == "double"
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(["xy", "xy"], ["b", "a"]).predict(["xy"])[0] == ["a"]


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", r"a\l<|x|>[INST] \e é"), (1, 0, "user", "</s>[INST] ok"), (None, 0, "user", None), (2, 0, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert chat.read_back(out[1]["formatted"]) == [("user", "</s>[INST] ok"), ("assistant", r"a\l<|x|>[INST] \e é")]
    raw = out[1]["formatted"].encode()
    assert [chat.unescape(raw[x["start"] : x["end"]].decode()) for x in out[1]["loss"]] == [r"a\l<|x|>[INST] \e é"]
    assert chat.read_back(out[None]["formatted"]) == [("user", "")] and chat.read_back(out[2]["formatted"]) == [("", "")]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_repeated_rows_and_long_conversations(spark):
    rows = [(1, 0, "user", "a<b"), (1, 0, "user", "a<b")] + [(2, n, ("user", "assistant")[n % 2], f"turn [{n}]") for n in range(9000)] + [(3, 0, "user", "x\\\\" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"loss": F.lit("x"), "id": F.lit(1)})
    out = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert chat.read_back(out[1]["formatted"]) == [("user", "a<b")] * 2
    assert chat.read_back(out[2]["formatted"]) == [(r, t) for c, _, r, t in rows if c == 2] and len(out[2]["loss"]) == 4500
    assert chat.read_back(out[3]["formatted"]) == [("user", rows[-1][3])]


def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (400, [0.5] * 8), (401, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    for q, v in [x for x in good if x[0] % 100 == 0]:
        best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_topk_lengths_repeats_ties_and_large_components(spark):
    big = 2.0**28
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 0.0]), (3, [1.0]), (100, [2.0]), (200, [big, big]), (5, [big, -big]), (6, [big, big]), (7, []), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("d", F.lit("x"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    int_rows = [(i, [int(1024 * x) for x in v]) for i, v in rows if i is not None and v]
    for q, v in [x for x in int_rows if x[0] % 100 == 0]:
        best = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(v, w)))), i) for i, w in int_rows if i != q and len(w) == len(v))[:3]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_topk_eliminates_and_counts_blocks(spark, monkeypatch):
    """Clustered vectors: most candidates are never evaluated; small blocks give the same answer."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 40_000
    x = np.concatenate([c + rng.normal(size=(40, 16)) * 300 for c in centres]).astype(np.int64)
    ids = np.arange(len(x))
    table = topk.distances(x.astype(float), x[::16].astype(float))
    best = [topk.Best(10) for _ in range(8)]
    assert topk.search_block(x[:320:40], ids[:320:40], table[:320:40], x, ids, table, best) < 8 * len(x) / 4
    df = spark.createDataFrame([(int(i), [float(c) / 1024 for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect())) == want and len(want) == 160


def test_html(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><li>menu</li></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>x\n  y<br><p>Z</article><footer>f</footer>'
    pages = spark.createDataFrame([(1, "http://h/1", page), (2, "http://h/2", None), (3, None, "<p>plain words only here</p><di")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()} == {1: "A & B\nx y\nZ", 2: "", 3: "plain words only here"}
    s = [random.randint(0, 3) for _ in range(200)]
    assert html.suffix_array(np.array(s)).tolist() == sorted(range(200), key=lambda i: s[i:])
    short = html.suffix_array(np.array(s), 5)
    assert [s[i : i + 5] for i in short] == sorted(s[i : i + 5] for i in range(200))


def test_html_markup():
    def text(page):
        return [t for s, t in html.blocks(page) if s == html.ARTICLE]

    assert text("<article><p title=don't>one</p><p>two &lt;b&gt;</p></article>") == ["one", "two <b>"]
    assert text("""<article><p data-x='a>b' title="c>d">one</p></article>""") == ["one"]
    for mark in ("id='replies'", 'class="user-reviews"', 'class="comments"', "class=post-comments", "id=respond-replies", 'class="site-header"', 'class="page-footer top"', 'class="cookie-banner"'):
        assert text(f"<article><p>one</p><section {mark}><p>two</p></section><p>three</p></article>") == ["one", "three"], mark
    assert text('<article><div class="article-header"><p>lead</p></div><div class="entry-footer">end</div></article>') == ["lead"]


def brute_covered(pages, least, on):
    """Which tokens lie in a run of `least` tokens that is on `on` distinct pages or more."""
    holders = {}
    for page in pages:
        for i in range(len(page) - least + 1):
            holders.setdefault(tuple(page[i : i + least]), set()).add(tuple(page))
    out = []
    for page in pages:
        hit = [False] * len(page)
        for i in range(len(page) - least + 1):
            if len(holders[tuple(page[i : i + least])]) >= on:
                hit[i : i + least] = [True] * least
        out.append(hit)
    return out


def test_html_host_repeats_against_brute_force(spark, monkeypatch):
    """Pages that mark no article: whatever the groups, what the host repeats goes and all else stays."""
    words = [f"w{i}" for i in range(12)]
    shared = [[random.choice(words) for _ in range(14)] for _ in range(4)]
    rows, want = [], {}
    for host, n in (("a.example", 60), ("b.example", 9), ("c.example", 1)):
        streams = []
        for k in range(n):
            blocks = [shared[random.randrange(4)] if random.random() < 0.4 else [random.choice(words) for _ in range(random.randint(1, 25))] for _ in range(4)]
            streams.append([("b", *blocks)])
            rows.append((len(rows), f"https://{host}/{k}", "".join(f"<p>{' '.join(b)}</p>" for b in blocks)))
        flat = [[t for b in s[0][1:] for t in ("\n", *b)] for s in streams]
        for r, s, hit in zip(rows[-n:], streams, brute_covered(flat, html.LEAST_RUN, html.LEAST_PAGES), strict=True):
            at, kept = 0, []
            for b in s[0][1:]:
                kept.append(" ".join(w for w, h in zip(b, hit[at + 1 : at + 1 + len(b)], strict=True) if not h))
                at += 1 + len(b)
            want[r[0]] = "\n".join(k for k in kept if k) or "\n".join(" ".join(b) for b in s[0][1:])
    assert sum(len(t) for t in want.values()) < sum(len(re.sub("<[^>]*>", " ", h)) for _, _, h in rows) * 0.9
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    for pages_a_group in (7, 500):
        monkeypatch.setattr(html, "GROUP_PAGES", pages_a_group)
        assert {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()} == want
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_html_copies_of_an_unmarked_page_keep_their_text(spark):
    page = "<p>" + " ".join(f"x{i}" for i in range(40)) + "</p>"
    rows = [(n, "http://h.example/p", page) for n in (1, 2, 3, 3, None)] + [(9, "http://h.example/q", None)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and {r["n_repeated"] for r in got} == {0}
    assert {r["text"] for r in got if r["page_id"] != 9} == {" ".join(f"x{i}" for i in range(40))}


def test_pii_keeps_formats_and_links(spark):
    f = pii.Feistel(b"k")
    text = "card 4111 1111 1111 1111, 4111111111111111 mail a.b1@mail8.example.com ip 10.2.3.4 on 2020-02-29, 29.02.2020 ssn 123-45-6789 tel +1 (988) 555-2485 no 1234567890123456 2021-02-30"
    new, counts = pii.pseudonymise(text, f)
    assert pii.pseudonymise(new, f, back=True)[0] == text
    assert counts == {"card": 2, "email": 1, "ip": 1, "date": 2, "ssn": 1, "phone": 1}
    cards = re.findall(r"card ([\d ]+), (\d+)", new)[0]
    assert cards[0].replace(" ", "") == cards[1] and pii.luhn(cards[1]) == 0 and "4111" not in new
    assert "1234567890123456 2021-02-30" in new and re.sub(r"[a-z]", "a", re.sub(r"\d", "9", new.split(" ip")[0])) == re.sub(r"[a-z]", "a", re.sub(r"\d", "9", text.split(" ip")[0]))
    assert sorted(f.number("t", i, 50) for i in range(50)) == list(range(50))
    rows = pii.pseudonymise_documents(table(spark, [None, "clean"]), b"k").collect()
    assert [(r["text"], r["n_pii"]) for r in rows] == [(None, 0), ("clean", 0)]


def test_pii_links_dates_in_all_spellings_and_whole_addresses():
    import datetime

    f = pii.Feistel(b"k")
    for n in range(0, 70_000, 37):
        day = datetime.date(1900, 1, 1) + datetime.timedelta(n)
        new = datetime.date.fromisoformat(pii.pseudonymise(day.isoformat(), f)[0])
        for form in ("%d.%m.%Y", "%m/%d/%Y") + (("%d/%m/%Y",) if day.day > 12 else ()):
            changed = pii.pseudonymise(day.strftime(form), f)[0]
            assert changed == new.strftime(form)
            assert pii.pseudonymise(changed, f, back=True)[0] == day.strftime(form)
    for local in ("x" * 70, "ab.1" * 500):
        new, counts = pii.pseudonymise(f"to {local}@host.example now", f)
        moved = new[3 : 3 + len(local)]
        assert counts == {"email": 1} and not moved.startswith(local[:6]) and sum(a == b for a, b in zip(moved, local)) < len(local) // 2
        assert pii.pseudonymise(new, f, back=True)[0] == f"to {local}@host.example now"


def test_empty_tables_and_extra_columns(spark):
    docs = table(spark, ["a"]).withColumns({"block": F.lit(1), "fp": F.lit(2), "id": F.lit(3), "spans": F.lit(4)})
    none = docs.limit(0)
    for op in (simhash.simhash_components, phrases.remove_repeated_phrases, secrets.scan_secrets, bpe.encode, lambda d: pii.pseudonymise_documents(d, b"k")):
        assert op(none).count() == 0 and op(docs).count() == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    last = docs
    for name, stage in p.STAGES:
        out = stage(spark, last, "/root/testdata/sf0.001")
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert 0 < out.count() <= last.count()
        last = out


def jaccard_groups(texts):
    """Components of five-word Jaccard similarity 0.8 or more, by brute force."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = comp[i], comp[j]
                comp = [min(old, new) if c in (old, new) else c for c in comp]
    return comp


def test_pipeline_near_copies_brute_force(spark):
    import corpus_pipeline as p

    texts = ["one two", "One two", "three"]
    for n in range(12):
        base = [f"{n}x{random.randint(0, 10**6)}" for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in random.sample(range(200), edits):
                copy[at] = f"edit{random.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    docs = table(spark, texts)
    left = {r["doc_id"] for r in p.near_copies(spark, docs, "").collect()}
    assert left == {c + 1 for c in jaccard_groups(texts)}
    assert len(left) < 60


def test_pipeline_near_copies_on_a_table(spark):
    """Recall of the stage on a given table, against all pairs: of pairs at 0.8 or more nine in ten have one component; none is made below."""
    from codegraph_spark.llm import neardup

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("__cg_doc"), F.xxhash64("doc_id").alias("__cg_row"), "text")
    got = {r["__cg_doc"]: r["component"] for r in neardup.near_copy_components(rows).collect()}
    hashes = neardup.WordHashes()
    sets = [(r["doc_id"], set(neardup.shingle_set((r["text"] or "").encode(), hashes).tolist())) for r in docs.collect()]
    pairs = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)]
    assert len(pairs) > 20 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    linked = components_of([i for i, _ in sets], pairs)
    assert all(linked[i] == linked[j] for i in got for j in got if i < j and got[i] == got[j])


def test_pipeline_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as p

    item = prose(40)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    bad = " ".join(item)

    def rows(found):
        return sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)

    docs = table(spark, [bad, c, bad, a, a, bad], [None, None, 3, 3, 4, 4])
    assert rows(p.benchmark_free(spark, docs, str(tmp_path))) == sorted([(None, c), (3, a), (4, a)], key=str)
    docs = table(spark, [a, a, a + " x", b, b, b, c, c, bad], [None, None, 3, 3, 5, 5, 6, 6, None])
    assert rows(p.near_copies(spark, docs, "")) == sorted([(3, a + " x"), (3, b), (6, c), (None, bad)], key=str)
    assert p.near_copies(spark, docs.limit(0), "").count() == 0
    full = table(spark, [a + " password=abcdefg1", None], [None, None]).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")})
    full = full.union(full.withColumn("doc_id", F.lit(7).cast("long"))).union(full)
    assert [r["doc_id"] for r in p.secret_free(spark, full, "").collect()].count(7) == 2 and p.tokens(spark, full, "").count() == 6
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    kept = p.language(spark, docs, "")
    assert kept.where("doc_id is null").count() * 2 == kept.count() > 0


def test_pii_beside_other_digits_and_words():
    f = pii.Feistel(b"k")
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    for text, kind, value in (
        (f"card {card} 12/27", "card", card), ("order 12 4111111111111111 paid", "card", "4111111111111111"), ("4111111111111111 123", "card", "4111111111111111"),
        (f"{iban} EUR", "iban", iban), (f"{iban}, EUR", "iban", iban), (f"AB12 {iban}", "iban", iban), ("at 2024-01-02T10:00:00Z", "date", "2024-01-02"),
    ):
        new, counts = pii.pseudonymise(text, f)
        assert counts == {kind: 1} and value not in new and len(new) == len(text)
        assert [new.startswith(text[: text.index(value)]), new.endswith(text[text.index(value) + len(value) :])] == [True, True]


def test_pii_is_found_again_as_the_same_kind():
    """Values of every kind: the pseudonym has the form, is valid, is found as that kind, and turns back."""
    f, rng = pii.Feistel(b"k"), random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = rng.choice("3456") + digits(14)
        return body + next(c for c in "0123456789" if not pii.luhn(body + c))

    def iban():
        body = rng.choice(("ES", "DE", "GB")), digits(18)
        return f"{body[0]}{98 - pii.iban_rest(body[0] + '00' + body[1]):02d}{body[1]}"

    make = {
        "phone": lambda: rng.choice((f"({rng.randint(200, 999)}) {digits(3)}-{digits(4)}", f"{rng.randint(200, 999)}-{digits(3)}-{digits(4)}", f"+{rng.choice(('1', '44', '353', '971', '49'))} {digits(9)}")),
        "card": card, "iban": iban, "ssn": lambda: f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "date": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "email": lambda: f"{rng.choice('abc')}{digits(3)}.x@host{digits(2)}.example.com",
    }
    for kind, one in make.items():
        for _ in range(300):
            value = one()
            new, counts = pii.pseudonymise(f"at {value} now", f)
            assert counts == {kind: 1}, value
            back, again = pii.pseudonymise(new, f, back=True)
            assert again == {kind: 1} and back == f"at {value} now", (value, new)
            if value.startswith("+"):
                assert new[3:].split(" ")[0] == value.split(" ")[0]
    for other in ("٤١١١١١١١١١١١١١١١", "٢٠٢٤-٠١-٠٢", "１２３-４５-６７８９"):
        assert pii.pseudonymise(f"no {other}", f) == (f"no {other}", {})


def test_html_inside_articles():
    """Sections keep their text whatever they are called; comments, footers and adverts go; an empty svg hides nothing."""
    page = """<body><nav>menu</nav><article><p>one<svg/>two <math/>three</p><section id="discussion"><p>four</p></section><div class="related-work">five</div>
        <div class="responses">six</div><svg><text>hidden</text></svg><div class="ad">buy</div><article class="comment"><p>me too</p></article>
        <div class="post-footer">by x</div><div class="post-header"><h1>seven</h1></div><div id="comments">hello</div><p>eight</p></article><div class="comments">out</div></body>"""
    assert [t for s, t in html.blocks(page) if s == html.ARTICLE] == ["onetwo three", "four", "five", "six", "seven", "eight"]
