import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import katz as m


def good_turing(n, k=5):
    """Katz's discounts from the formula: r* over r, less the share of what is kept above k, over the rest."""
    out = []
    for r in range(1, k + 1):
        turing = (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0.0
        above = (k + 1) * n[k] / n[0] if n[0] else 1.0
        ratio = (turing / r - above) / (1 - above) if above < 1 and n[r - 1] else 0.0
        out.append(r * ratio if 0 < ratio < 1 else r - 0.5)
    return out


def brute(docs, others=()):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    toks = [[*(t or "").encode().lower().split(), None] for _, t in docs]
    uni, big, ctx, follow = Counter(), Counter(), Counter(), defaultdict(set)
    for h, t in zip(held, toks):
        if not h:
            uni.update(t)
            for a, b in zip(["<s>", *t], t):
                big[a, b] += 1
                ctx[a] += 1
                follow[a].add(b)
    n, z = sum(uni.values()), sum(uni.values()) + 0.1 * (len(uni) + 1)
    cc = Counter(big.values())
    star = good_turing([cc[r] for r in range(1, m.K + 2)])
    disc = lambda c: star[c - 1] if c <= m.K else c - m.LARGE_LOSS
    p1 = lambda w: (uni[w] + 0.1) / z

    def prob(a, b):
        if not ctx[a]:
            return p1(b)
        if big[a, b]:
            return disc(big[a, b]) / ctx[a]
        left = 1 - sum(disc(big[a, x]) for x in follow[a]) / ctx[a]
        return left / (1 - sum(p1(x) for x in follow[a])) * p1(b)

    for a in list(ctx)[:20] + ["nowhere"]:
        assert math.isclose(sum(prob(a, b) for b in [*uni, "unknown"]), 1, rel_tol=1e-9)
    out = []
    for (i, _), h, t in zip(docs, held, toks):
        out.append((i, h, len(t), sum(uni[x] > 0 for x in t), n, sum(math.log10(p1(x)) for x in t), sum(math.log10(prob(a, b)) for a, b in zip(["<s>", *t], t))))
    if others:
        return [(i, len(t), sum(math.log10(prob(a, b)) for a, b in zip(["<s>", *t], t))) for i, t in ((i, [*(t or "").encode().lower().split(), None]) for i, t in others)]
    return out


def cases(seed, n=150):
    r = np.random.default_rng(seed)
    vocab = np.array([f"W{x}é" for x in range(300)])
    p = 1 / np.arange(1, 301)
    docs = [(k, " ".join(r.choice(vocab, int(r.integers(0, 80)), p=p / p.sum())) + " the end") for k in range(n)]
    return docs + [(1000, None), (1001, ""), (1002, "x " * 4000), (7, "again again"), (7, "again again"), (None, "no id")]


def test_scores_equal_brute_force(spark, monkeypatch):
    for seed, bucket, split in ((1, 2000, 5), (2, 40 << 20, 4096)):
        monkeypatch.setattr(m, "BUCKET_BYTES", bucket)
        monkeypatch.setattr(m, "SPLIT_WORDS", split)
        monkeypatch.setattr(m, "UNIT_BYTES", bucket // 2)
        docs = cases(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as batch", "'x' as word").repartition(3)
        got = sorted((tuple(x) for x in m.score(d).collect()), key=str)
        want = sorted(brute(docs), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_empty(spark):
    assert m.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stored_tables_score_other_texts(spark, monkeypatch):
    """A second table, with known and unknown words and pairs; and the first one, as in its own scores."""
    monkeypatch.setattr(m, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(m, "SPLIT_WORDS", 7)
    docs, others = cases(4), [(k, f"{t} brand new words {k}") for k, t in cases(5, 40) if k is not None] + [(5000, None), (5001, "w1É W1é"), (None, "the end")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = m.Katz(d, F.expr("crc32(cast(doc_id as string)) % 10 = 0"))
    got = sorted((tuple(x) for x in model.of(spark.createDataFrame(others, "doc_id long, text string").repartition(2)).collect()), key=str)
    want = sorted(brute(docs, others), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)
    own = sorted((str(x.doc_id), x.n_tokens, round(x.score, 6)) for x in model.of(d).collect())
    assert own == sorted((str(x.doc_id), x.n_tokens, round(x.score, 6)) for x in model.scores.collect())
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    pairs = Counter()
    for h, (_, t) in zip(held, docs):
        t = ["<s>", *(t or "").encode().lower().split(), None]
        pairs.update(zip(t, t[1:]) if not h else ())
    assert sorted(x.n for x in model.pairs.collect()) == sorted(pairs.values())


def test_query_on_the_documents(spark):
    """Counts of the query's contract, and that the model beats the base on texts that it hasn't seen."""
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    rows = m.query(spark, "/root/testdata/sf0.001").collect()
    train = Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10 for w in [*t, None])
    n, z = sum(train.values()), sum(train.values()) + 0.1 * (len(train) + 1)
    assert {x.doc_id for x in rows} == docs.keys()
    for x in rows:
        t = [*docs[x.doc_id], None]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (zlib.crc32(str(x.doc_id).encode()) % 10 == 0, len(t), sum(train[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((train[w] + 0.1) / z) for w in t), rel_tol=1e-9)
    held = [x for x in rows if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
