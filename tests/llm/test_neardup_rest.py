"""The pipeline's near copies: buckets whose nodes don't link are compared whole."""

import numpy as np

from codegraph_spark.llm import neardup
from codegraph_spark.llm.common import ROW_DOC, ROW_HASH


def test_no_link_is_lost_in_a_large_bucket(spark, monkeypatch):
    """All texts share one bucket; seven have a copy at a similarity of 0.84, anywhere among forty others."""
    monkeypatch.setattr(neardup, "bands", lambda s: np.arange(1, dtype=np.uint64))
    random = np.random.default_rng(3)
    texts = [[f"w{x}" for x in random.integers(0, 5000, 120)] for _ in range(47)]
    for i in range(7):
        copy = list(texts[i])
        copy[40 + i], copy[80 + i] = "new", "newer"
        texts.append(copy)
    rows = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], f"{ROW_DOC} long, {ROW_HASH} long, text string")
    got = {r[ROW_DOC]: r["component"] for r in neardup.near_copy_components(rows).collect()}
    assert len(set(got.values())) == 47 and all(got[i] == got[47 + i] for i in range(7))


def _sets(random, n, size, change):
    """A set and copies of it, each with `change(i)` shingles of its own for as many of the first's."""
    first = random.choice(2**40, size, replace=False)
    out = [first]
    for i in range(1, n):
        k = change(i)
        out.append(np.r_[random.permutation(first)[k:], random.choice(2**40, k, replace=False) + 2**41])
    return out


def _links(sets):
    both = lambda a, b: len(np.intersect1d(a, b))
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 9 * (o := both(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j])) and o}


def _candidates(spark, sets, component):
    met = spark.createDataFrame([(0, i, c) for i, c in enumerate(component)], "first long, node long, component long")
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, s array<long>")
    return {(r["src"], r["dst"]) for r in neardup.other_components(met, frame, len(sets)).collect()}


def test_nodes_that_differ_in_their_own_way_make_no_pairs(spark):
    """400 sets, 200 of which the first links to; every one of the 200 others would meet each of them (60,000 pairs)."""
    sets = _sets(np.random.default_rng(1), 400, 120, lambda i: 5 + i % 8 if i < 200 else 16 + i % 20)
    component = [0 if i < 200 else i for i in range(400)]
    assert not [x for x in _links(sets) if component[x[0]] != component[x[1]]]
    assert len(_candidates(spark, sets, component)) < 400


def test_candidates_hold_every_link(spark):
    """Sets of all sizes around the first, copies of copies, parts and unions of others: no link of two components is missing."""
    for seed in range(4):
        random = np.random.default_rng(seed)
        sets = _sets(random, 30, int(random.integers(8, 60)), lambda i: int(random.integers(0, 12)))
        for _ in range(50):
            a, b = (sets[random.integers(len(sets))] for _ in range(2))
            some = np.union1d(a, b) if random.random() < 0.3 else a
            sets.append(np.unique(np.r_[random.permutation(some)[int(random.integers(0, 7)) :], random.choice(2**40, int(random.integers(0, 5)))]))
        # the first's links are known; others are components of their own, or of a few
        known = {j for i, j in _links(sets) if i == 0}
        component = [0 if i == 0 or i in known else int(random.choice([i, 1000 + i % 3])) for i in range(len(sets))]
        want = {x for x in _links(sets) if component[x[0]] != component[x[1]]}
        assert want and want <= _candidates(spark, sets, component)
