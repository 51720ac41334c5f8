from collections import Counter

import numpy as np
import pyarrow as pa

from graphloom.llm import substring_dedup as m


def brute(docs, size):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[k : k + size]) for _, w in words for k in range(len(w) - size + 1))
    out = []
    for i, w in words:
        hit = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                hit.update(range(k, k + size))
        out.append((i, len(w), len(hit), b" ".join(x for k, x in enumerate(w) if k not in hit).decode()))
    return sorted(out, key=str)


def cases(seed):
    r = np.random.default_rng(seed)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 5000, n))
    shared = [text(int(r.integers(30, 70))) for _ in range(8)]
    docs = []
    for k in range(80):
        parts = [text(int(r.integers(0, 60)))]
        for _ in range(int(r.integers(0, 3))):
            s = shared[int(r.integers(0, 8))].split()
            a = int(r.integers(0, 10))
            parts += [" ".join(s[a : len(s) - int(r.integers(0, 10))]), text(int(r.integers(0, 40)))]
        docs.append((k, "\n ".join(parts)))
    long = text(3000)
    return docs + [(200, None), (201, ""), (202, long), (203, long), (204, "a b " * 300), (205, "é" * 300 + " " + text(40)), (206, text(34))]


def test_cover_has_every_pair():
    for a in range(m.PERIOD):
        for b in range(m.PERIOD):
            assert any((a + d) % m.PERIOD in m.COVER and (b + d) % m.PERIOD in m.COVER for d in range(m.PERIOD))


def test_equals_brute_force(spark):
    for seed, extra in ((1, []), (2, [(5, "again " * 50), (5, "again " * 50), (None, "x y")])):
        docs = cases(seed) + extra
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "'s' as spans").repartition(5)
        got = sorted(((x.doc_id, x.n_words, x.n_removed, x.text) for x in m.remove_repeats(d).collect()), key=str)
        assert got == brute(docs, 35)


def test_groups_across_batches():
    rows = [(1, 10, (3 << 1)), (2, 11, (4 << 1)), (2, 12, (5 << 1)), (2, 13, (6 << 1)), (3, 14, (7 << 1) | 1), (4, 15, 8 << 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([k], pa.int64()), pa.array([a], pa.int64())], ["h", "key", "at"]) for h, k, a in rows]
    out = [tuple(x.values()) for b in m._shared_batches(0)(iter(batches)) for x in b.to_pylist()]
    assert sorted((k, s >> 32, s & 0xFFFFFFFF) for k, s in out) == [(11, 4, 5), (12, 5, 6), (13, 6, 7), (14, 7, 8)]


def test_empty(spark):
    assert m.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
