import hashlib
import re
import time

import numpy as np
import xxhash

from graphloom.llm import fingerprints as m


def units(t):
    out = [""]
    for w in re.findall(rf"\S{{1,{m.RUN}}}\s*|\s+", t or "", re.A):
        out[-1] += w
        if "\n" in w or xxhash.xxh64_intdigest(w.encode(), 42) % m.CUT == 0:
            out.append("")
    return set(out) - {""}


def like(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs):
    docs = sorted(docs)
    out = {}
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), like(t, e), like(t, nxt))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    r = np.random.default_rng(3)
    line = lambda: "".join(r.choice(list("abcdé😀 "), int(r.integers(0, 400))))
    docs = [(int(k * 3 - 20), "\n".join(line() for _ in range(int(r.integers(0, 12))))) for k in range(40)]
    docs += [(500, None), (501, ""), (502, "\n".join(line() for _ in range(300))), (503, docs[3][1]), (504, docs[3][1]), (505, "\n\n\nabc\n\n")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as keys", "2 as n").write.parquet(f"{tmp_path}/documents.parquet")
    rows = m.query(spark, str(tmp_path)).collect()
    got = {x.doc_id: (x.n_chars, x.edited_sha256, x.near_edited, x.near_next) for x in rows}
    want = brute(docs)
    assert len(rows) == len(docs) and got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:2] == w[:2]
        assert np.allclose(got[i][2:], w[2:])
    prints = {x.doc_id: x.fingerprint for x in rows}
    assert prints[503] == prints[504] == prints[docs[3][0]] and prints[500] == prints[501] != prints[502]


def test_peeling_recovers_differences(spark):
    a, b = list(range(100, 130)), list(range(112, 135))
    df = spark.createDataFrame([(a, b), ([], []), (a, a), ([], b[:5])], "a array<long>, b array<long>").selectExpr("transform(a, x -> xxhash64(x)) as a", "transform(b, x -> xxhash64(x)) as b")
    df = df.selectExpr("a", "b", f"{m.sketch('a')} as ca", f"{m.sketch('b')} as cb")
    for x in df.selectExpr("a", "b", f"{m.peel(m.subtract('ca', 'cb'))} as d").collect():
        if x.d.ok:
            assert sorted(x.d.got) == sorted(set(x.a) ^ set(x.b))
        else:
            assert len(set(x.a) ^ set(x.b)) > 10


def test_one_and_no_document(spark, tmp_path):
    spark.createDataFrame([(7, "one\ntwo")], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    x = m.query(spark, f"{tmp_path}/a").first()
    assert x.near_next == 1.0 and x.n_chars == 7
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert m.query(spark, f"{tmp_path}/b").count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "gone"), (1, "b b b b"), (1, "a a a a"), (2, "c c c c c c c c"), (2, None)]
    got = sorted((x.doc_id, x.n_chars, x.edited) for x in m.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # rows of one id see the least head of the next id; the last id's next is the first one
    assert got == [(1, 7, "a a a "), (1, 7, "b b b "), (2, 0, ""), (2, 15, "c c c c c c a a")]


def likeness(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, ta string, tb string")
    df = df.select("k", m.digests(df.ta).alias("a"), m.digests(df.tb).alias("b"))
    df = df.selectExpr("*", f"{m.sketch('a')} as ca", f"{m.sketch('b')} as cb")
    return [x.out for x in m.compare(df, "a", "b", "ca", "cb", "out").orderBy("k").collect()]


def test_control_characters_count(spark):
    pairs = [("x\n\x01y", "x\ny"), ("x\x01\nq\n\x01y\x01", "x\x01\nq\n\x01y\x01"), ("a\nb\x01\x01", "a\nb\x01"), ("a\n\x01", "a\n\x02"), ("a\nb\n\x01", "a\nb\n")]
    assert np.allclose(likeness(spark, pairs), [like(a, b) for a, b in pairs])


def test_an_insertion_costs_one_piece(spark):
    r = np.random.default_rng(5)
    line = " ".join("".join(r.choice(list("abcdefgh"), int(r.integers(2, 9)))) for _ in range(2000))
    got = likeness(spark, [(line, "X" + line), (line, "one more " + line), (line, line.replace(" ", "  ", 1))])
    assert min(got) > 0.9


def test_large_texts_are_compared_exactly_and_soon(spark):
    lines = lambda seed, n: [f"line {seed} {k}" for k in range(n)]
    a, b = lines(1, 20000), lines(2, 20000)
    pairs = [(a, b), (a, a[:-1]), (a, a[:10000] + b[:10000]), (a, []), (a[:3], b)]
    pairs = [("\n".join(x), "\n".join(y)) for x, y in pairs]
    likeness(spark, [("a", "b")])
    began = time.time()
    got = likeness(spark, pairs)
    assert time.time() - began < 30
    assert np.allclose(got, [like(x, y) for x, y in pairs])
