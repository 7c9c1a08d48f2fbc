import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codegraph_spark.llm import align, common, quality, trie

WORDS = [f"w{i}" for i in range(40)]
DOC = "doc_id long, text string, source string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def covered_twice(words):
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({p for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)})


def rated(rows, least_docs, share):
    """(id, counts, base_failed, kept, lost, kept text) of rows (id, text, source), by the definitions."""
    norm = lambda x: re.sub(r"[ \t\x0b-\r]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    texts = {(h or "", t or "") for _, t, h in rows}
    held, of_host = defaultdict(set), Counter(h for h, _ in texts)
    for h, t in texts:
        for x in t.split("\n"):
            held[h, norm(x)].add(t)
    above = {k for k, v in held.items() if k[1] and len(v) > least_docs and len(v) * share > of_host[k[0]]}
    out = []
    for i, t, h in rows:
        t, h = t or "", h or ""
        w = re.findall(r"[^ \t-\r]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        gone = [x for x in t.split("\n") if (h, norm(x)) in above]
        lost = sum(len(re.findall(r"[^ \t-\r]+", x)) for x in gone)
        twice = covered_twice(w)
        failed = len(w) < 50 or 100 * twice > 50 * len(w)
        text = "\n".join(x for x in t.split("\n") if (h, norm(x)) not in above)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), twice, failed, not failed and 2 * (len(w) - lost) >= len(w), lost, text))
    return sorted(out, key=str)


def test_quality_against_brute_force(spark):
    rng = random.Random(3)
    menu = ["Home | About  us", "home | about us", "Page 12 of 90", "All rights reserved"]
    rows = [(n, "\n".join([prose(rng, rng.choice([3, 30, 60])), *rng.choices(menu, k=rng.randint(0, 6)), "", " \t"]), rng.choice(["a", "b", None, ""])) for n in range(80)]
    rows += [(200, None, "a"), (201, "", None), (None, prose(rng, 60), "a"), (7, prose(rng, 60), "b"), (7, "x " * 70, "b"), (202, "ä 😀 # " * 30, "c"), (203, "\n".join(menu * 30), "a")]
    rows += [(300, rows[0][1], rows[0][2])] * 40  # copies count once
    docs = spark.createDataFrame(rows, DOC).withColumns({"lines": F.lit(1), "n_words": F.lit("x"), "words": F.lit(2), "lost": F.lit(0)})
    got = sorted((tuple(r) for r in quality.rate(docs, least_docs=3, share=5, with_text=True).collect()), key=str)
    assert got == rated(rows, 3, 5)
    assert any(r[-2] for r in got) and any(not r[6] and not r[7] for r in got)
    assert quality.rate(docs.limit(0)).count() == 0


def test_quality_lines_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(n, "\n".join([prose(rng, 55), rng.choice(["top", "more text here"]), f"part {rng.randint(0, 1)} x"]), "h") for n in range(60)]
    docs = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert sorted((tuple(r) for r in quality.rate(docs, least_docs=3, share=9, with_text=True).collect()), key=str) == rated(rows, 3, 9)


def test_repeated_words_of_long_and_repetitive_texts(spark):
    rng = random.Random(5)
    texts = ["a a", "a a a", "a a a a", "a b a b a b", "", "x", " ".join(rng.choice("ab") for _ in range(50)), "q " * 60_000, prose(rng, 30_000), "a b c d a b c e b c d"]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, text string")
    got = frame.select("n", quality.repeated_words(F.array_remove(F.split("text", quality.SPACE), ""))).collect()
    assert dict(map(tuple, got)) == {n: covered_twice(t.split()) for n, t in enumerate(texts)}


def test_quality_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c", "h")], DOC)
    assert "Python" not in (plan := quality.rate(docs)._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" not in plan


def test_split_join_of_hot_keys(spark):
    left = spark.range(5000).select((F.col("id") % 10 * (F.col("id") % 3)).alias("k"), "id")
    right = spark.range(0, 12).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, common.join_split(left, right, ["k"], how, share=20).collect())) == want
    assert common.join_split(left.limit(0), right, ["k"], "left").count() == 0


def aligned(both, rows):
    """The contract's columns of rows (id, text), by walking both token lists."""
    docs, held = [], Counter()
    for i, t in rows:
        a, b = (both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)) if t else ([], [])
        if any(b"".join(names[x] for x in ids) != (" " + (t or "")).encode() for names, ids in ((both.a_bytes, a), (both.b_bytes, b))):
            a = b = []
        links, groups, x, y, p, q = [], [([], [])], 0, 0, 0, 0
        while x < len(a):
            end_a, end_b = p + len(both.a_bytes[a[x]]), q + len(both.b_bytes[b[y]])
            links.append((a[x], b[y]))
            if end_a <= end_b:
                groups[-1][0].append(a[x])
                x, p = x + 1, end_a
            if end_b <= end_a:
                groups[-1][1].append(b[y])
                y, q = y + 1, end_b
            if end_a == end_b:
                groups.append(([], []))
        held.update(set(links))
        docs.append((i, a, b, groups[:-1], links))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    text = lambda groups: ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return sorted([(i, len(a), len(b), len(g), len(ls), sum(held[x] == most[x[0]] for x in ls), sum(held[x] for x in ls), hashlib.sha256(text(g).encode()).hexdigest() if a else "") for i, a, b, g, ls in docs], key=str)


def test_alignment_against_brute_force(spark):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    letters = ["a", "b", "th", "ing", "é", "中", "😀", " ", " ", "  ", "\n", "\t", "'s", "12", "▁", "<|endoftext|>", "<s>", "<0x41>", "\x00", "ﬁ", ".", "\xa0"]
    rows = [(n, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for n in range(150)]
    rows += [(None, "the thing"), (3, "the thing"), (3, "the thing"), (500, None), (501, ""), (502, "the ▁ mark"), (503, "x" * 30_000), (504, prose(rng, 20_000)), (505, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "same": F.lit("s"), "a": F.lit(2)})
    want = aligned(align.Pair(), rows)
    assert any(r[1] == 0 for r in want) and any(r[1] for r in want)
    for bound in (align.BROADCAST_PAIRS, 0):
        assert sorted((tuple(r) for r in align.align_corpus(docs, broadcast_pairs=bound).collect()), key=str) == want
        assert align.align_corpus(docs.limit(0), broadcast_pairs=bound).count() == 0


def test_identity_map_and_remembered_chunks():
    pytest.importorskip("public_tokenizers")
    both = align.Pair()
    known = [n for n in range(len(both.same)) if both.same[n] >= 0]
    assert len(known) > 10_000 and all(both.a_bytes[n] == both.b_bytes[both.same[n]] for n in known)
    texts = ["one two", "two one", "", " x", "x ", "a  b", "one\ntwo three", "the ▁ mark", "ｆ x"]
    plain = [both._whole(t) for t in texts]
    assert both.encode(texts) == plain and both.encode(texts) == plain


def nodes_of(rows, group=None, most=6):
    """Trie nodes of rows (conversation, turn, role, text), by the definitions; group: with shared openings."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = dict(own)
    if group:
        for c in own:
            h = zlib.crc32(str(c).encode()) % most
            built[c] = own.get(c - (abs(c) % group) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved, out = defaultdict(list), {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        if k:
            kids[k[:-1]].append(k)
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURN = "conv_id long, turn long, role string, text string"


def conversations(rng):
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "", None, "äöü 😀"])) for c in [*range(-5, 60), 100, 101, 103, 205, 10**12] for t in range(rng.randint(1, 7))]
    rows += [(None, 1, "user", "lost"), (7, None, "user", "first"), (900, 1, "user", "x"), (900, 1, "user", "x")]
    rows += [(c, t, "user", "long" if t != 30 else str(c % 2)) for c in (400, 401, 402) for t in range(45)]
    return rows


def test_trie_against_brute_force(spark):
    rng = random.Random(8)
    rows = conversations(rng)
    turns = spark.createDataFrame(rows, TURN).repartition(3).withColumns({"c": F.lit(1), "pos": F.lit(2), "block": F.lit("x")})
    for block in (3, 8):
        assert sorted((tuple(r) for r in trie.prefix_trie(turns, block).collect()), key=str) == nodes_of(rows)
    rebuilt = trie.trie_nodes(*trie.with_shared_openings(*trie.turn_steps(turns)))
    assert sorted((tuple(r) for r in rebuilt.collect()), key=str) == nodes_of(rows, 100)
    assert trie.prefix_trie(turns.limit(0)).count() == 0


def test_trie_of_equal_conversations(spark):
    """Many conversations end in one node: their ids are digested in order, in rows of a bounded number."""
    rows = [(c, 0, "user", "same") for c in range(-700, 2500)] + [(c, 1, "user", "more") for c in range(0, 2500, 2)]
    assert sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, TURN)).collect()), key=str) == nodes_of(rows)


def test_one_very_long_conversation(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(2900)]
    got = trie.prefix_trie(spark.createDataFrame(rows, TURN))
    assert got.count() == 3001
    top = got.where("depth = 0").first()
    assert (top["n_convs"], top["n_leaves"], top["saved_tokens"]) == (2, 1, sum(len(f"t{t}") for t in range(2900)))
