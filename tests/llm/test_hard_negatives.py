import math

import numpy as np
import pytest

from graphloom.llm import hard_negatives as m

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    ok = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, v in {(i, lab, tuple(v)) for i, lab, v in ok if is_anchor(i)}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in ok if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            good = [(-n, i) for n, i, other in scored if other != lab and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, r, i, -s, n) for r, (n, i) in enumerate(good[:negatives], 1)]
    return sorted(out)


def rows_of(n, dims, labels, seed, spread=0.4):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(labels, dims))
    return [(k, int(k % labels), [float(np.float32(x)) for x in (centers[k % labels] * (1 if r.random() < 0.7 else -0.2) + spread * r.normal(size=dims)) / dims**0.5]) for k in range(n)]


@pytest.mark.parametrize("n,dims,segment,tile,probe", [(700, 8, 2048, 128, 1024), (700, 8, 20, 7, 16), (90, 3, 2048, 128, 1024), (12, 2, 5, 2, 4)])
def test_equals_brute_force(spark, monkeypatch, n, dims, segment, tile, probe):
    monkeypatch.setattr(m, "SEGMENT", segment)
    monkeypatch.setattr(m, "TILE", tile)
    monkeypatch.setattr(m, "PROBE", probe)
    rows = rows_of(n, dims, 4, n + dims)
    got = m.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), "vec_id % 10 = 0").collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == want and want


def test_odd_rows_ties_and_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, k % 2, [1.0, 0.0]) for k in range(40)] + [(k, k % 2, [0.5, 0.5]) for k in range(40, 80)]  # ties at every place
    rows += [(5, 1, [1.0, 0.0])] * 2 + [(10, 0, [1.0, 0.0])]  # repeated rows, one an anchor
    rows += [(None, 1, [1.0, 1.0]), (90, None, [1.0, 1.0]), (91, 0, None), (92, 0, [nan, 1.0]), (93, 1, [None, 1.0]), (94, 1, [inf, 0.0]), (96, 0, [0.0, 0.0]), (100, 1, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as anchor", "2 as `a.b`", "3 as tile", "4 as y", "5 as score")
    assert sorted(map(tuple, m.mine(df, "vec_id % 10 = 0").collect())) == brute(rows, lambda i: i % 10 == 0)


def test_short_vectors_are_filled_with_zeros(spark):
    rows = [(0, 0, [1.0, 0.5]), (1, 0, [1.0]), (2, 1, [0.5, 0.1]), (3, 1, []), (4, 1, [0.6])]
    full = [(i, lab, v + [0.0] * (2 - len(v))) for i, lab, v in rows]
    assert sorted(map(tuple, m.mine(spark.createDataFrame(rows, SCHEMA), "vec_id = 0").collect())) == brute(full, lambda i: i == 0)


def test_empty(spark):
    assert m.mine(spark.createDataFrame([], SCHEMA), "true").collect() == []
    assert m.mine(spark.createDataFrame([(1, 1, [0.0, 0.0]), (2, 2, [0.0, 0.0])], SCHEMA), "true").collect() == []


def test_large_components(spark):
    rows = [(i, lab, [x * 3000 for x in v]) for i, lab, v in rows_of(60, 4, 3, 5)]
    assert sorted(map(tuple, m.mine(spark.createDataFrame(rows, SCHEMA), "vec_id % 10 = 0").collect())) == brute(rows, lambda i: i % 10 == 0)
