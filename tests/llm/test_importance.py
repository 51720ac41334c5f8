import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import importance as m

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(low)
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, bench, percent=5, least=20):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(zlib.crc32(f) % 10000 for _, _, fs in own for f in fs), Counter(zlib.crc32(f) % 10000 for x in bench for f in features(x)[1])
    big, small = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + 10000) / ((s[b] + 1) * (small + 10000)))) for b in s}
    rows = []
    for i, n, fs in own:
        weight = sum(gain[zlib.crc32(f) % 10000] for f in fs)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def same(got, want):
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == want


@pytest.mark.parametrize("unit,shard", [(8 << 20, 16 << 20), (500, 700)])
def test_equals_brute_force(spark, monkeypatch, unit, shard):
    monkeypatch.setattr(m, "UNIT_BYTES", unit)
    monkeypatch.setattr(m, "SHARD_BYTES", shard)
    r = np.random.default_rng(3)
    words = ["Alpha", "beta!", "it's", "x9", "é", "日本", "THE", "of", "z" * 90]
    docs = [(k, " ".join(r.choice(words, int(r.integers(0, 60))))) for k in range(200)]
    docs += [(300, None), (301, ""), (302, " ?! "), (303, "one"), (304, "one two"), (305, "the of " * 2000), (7, docs[7][1]), (None, "the of " * 30), (None, None)]
    bench = [(k, " ".join(r.choice(words[:4], 30))) for k in range(20)] + [(99, None), (98, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as unit", "2 as `a.b`", "3 as score", "4 as shard").repartition(5)
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as unit")
    same(m.resample(d, b, 50).collect(), brute(docs, [t for _, t in bench], 50))


def test_ties_go_to_smaller_ids_and_repeated_rows_are_ranked_each(spark):
    docs = [(k % 3, "same words " * 20) for k in range(30)]
    same(m.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "words")], "item_id long, text string"), 50).collect(), brute(docs, ["words"], 50))


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert m.resample(none, some).collect() == []
    same(m.resample(some, none).collect(), brute([(1, "a b c d")], []))


def test_query(spark):
    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.001/"
    docs = [(x["doc_id"], x["text"]) for x in pq.read_table(at + "documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    bench = pq.read_table(at + "benchmark.parquet", columns=["text"])["text"].to_pylist()
    same(m.query(spark, at).collect(), brute(docs, bench))


def test_dealt_ngrams_are_whole_and_small():
    r = np.random.default_rng(5)
    vocabulary = [b"w%d" % x for x in r.integers(0, 10**6, 3000)]
    texts = [b" ".join(vocabulary[min(2999, int(x))] for x in r.pareto(0.8, 2000) * 10) for _ in range(30)]
    want = Counter(f for t in texts for f in features(t.decode())[1])
    got, size, shards = Counter(), 0, 8
    for turn in range(m.ROUNDS):
        g = m.Grams(texts, [0] * len(texts), (shards, turn))
        order, first = g.by_shard(shards)
        counts, seen = np.bincount(g.gram, minlength=g.at[-1]), np.zeros(len(g.words), bool)
        for k in range(turn, shards, m.ROUNDS):
            picked = order[first[k] : first[k + 1]]
            blob = g.packed(picked, counts[picked], seen)
            assert not seen.any()
            size += len(blob)
            u = m.Unpacked(blob)
            w = u.words.to_pylist()
            pairs = [(a, w[b]) for a, b in zip(u.heads[0].tolist(), u.tails[0].tolist())]
            strings = [w[x] for x in u.single] + [w[a] + b" " + b for a, b in pairs]
            strings += [w[pairs[h][0]] + b" " + pairs[h][1] + b" " + w[c] for h, c in zip(u.heads[1].tolist(), u.tails[1].tolist())]
            assert not got.keys() & set(strings)
            got.update(dict(zip(strings, u.counts.tolist(), strict=True)))
    assert got == want
    assert size < 4 * len(want)  # bytes; compressed strings take over six


def test_a_strings_hash_comes_from_its_words():
    a, b = [b"", b"x", b"some words", b"\xff" * 5], [b" y", b" a longer one", b" " + b"z" * 300, b" \xc3\xa9"]
    left = m._followed(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([len(x) for x in b]))
    assert (left ^ np.array([zlib.crc32(x) for x in b], np.uint32)).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_exchanges_go_as_soon_as_a_table_is_written(spark, monkeypatch):
    seen, write = [], m.cut_and_free
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr("graphloom.plans.shared.cut", lambda d, name: seen.append((name, spark.conf.get(key))))
    before = spark.conf.get(key, None)
    write(spark.range(3), "x")
    assert seen == [("x", "true")] and spark.conf.get(key, None) == before
