import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from graphloom.llm import histogram_packing as m

PATHS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def check(rows, docs, window, end=1):
    """Every id in one piece, right checksums, gapless sequences of at most a window; returns ids and padding."""
    lib, want = Tokenizer.from_file(PATHS[0]), defaultdict(list)
    for i, t in docs:
        want[i].append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, end], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_seq[x.sequence_id].append((x.offset, x.length))
    assert by_doc.keys() == want.keys()
    for i, own in by_doc.items():
        assert sum(x.length for x in own) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            at = 0
            for x in sorted(own, key=lambda x: x.start):
                assert x.start == at and x.doc_tokens == len(want[i][0])
                assert x.ids_crc32 == zlib.crc32(want[i][0][at : at + x.length].tobytes())
                at += x.length
    padding = 0
    for own in by_seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return sum(x.length for x in rows), padding


def test_combinations_are_all_that_fill_a_window():
    got = {tuple(sorted(int(v) for v in r if v)) for r in m.combinations(np.arange(1, 13), 12)}
    want = {(12,)} | {(a, 12 - a) for a in range(1, 7)} | {tuple(sorted((a, b, 12 - a - b))) for a in range(1, 11) for b in range(1, 12 - a)}
    assert got == want and len(m.combinations(np.array([5, 9]), 12)) == 0


def test_repeats_never_use_more_than_there_is_and_fill_what_can_be():
    r = np.random.default_rng(0)
    h = np.zeros(65, np.int64)
    h[1:64] = r.integers(0, 200, 63)
    combos = m.combinations(np.flatnonzero(h), 64)
    k = m.repeats(combos, h)
    used = np.bincount(combos.ravel(), np.repeat(k, 3), 65)
    used[0] = 0
    assert (used <= h).all() and (k >= 0).all()
    pairs = sum(64 * min(h[a], h[64 - a]) for a in range(1, 32)) + 64 * (h[32] // 2)  # what two pieces alone can fill
    assert (used * np.arange(65)).sum() >= 0.9 * pairs
    exact = np.zeros(65, np.int64)
    exact[[40, 24]] = 7  # one combination alone fits, wholly
    assert m.repeats(m.combinations(np.array([24, 40]), 64), exact).tolist() == [7]


@pytest.mark.parametrize("items", [100_000, 40])
def test_every_id_is_placed_once(spark, monkeypatch, items):
    monkeypatch.setattr(m, "TASK_ITEMS", items)
    r = np.random.default_rng(1)
    docs = [(k, " ".join(r.choice(["alpha", "be", "ga\nmma", "é!"], int(r.integers(0, 90))))) for k in range(300)]
    docs += [(400 + k, "b " * 40) for k in range(200)]  # copies of one length that nothing completes
    docs += [(1000, None), (1001, ""), (1002, "long " * 700), (5000, "again"), (5000, "again"), (None, "no id"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as part", "2 as `a.b`", "3 as length").repartition(9)
    ids, padding = check(m.pack(d, *PATHS, window=64).collect(), docs, 64)
    assert padding <= 0.03 * ids


def test_copies_of_a_length_alone_need_no_padding(spark):
    docs = [(k, "b " * 40) for k in range(101)]
    rows = m.pack(spark.createDataFrame(docs, "doc_id long, text string"), *PATHS, window=64).collect()
    assert check(rows, docs, 64)[1] == 0 and len({x.sequence_id for x in rows}) <= 101 * 42 / 64 + 12


def test_empty(spark):
    assert m.pack(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_query(spark):
    import pyarrow.parquet as pq

    docs = [(x["doc_id"], x["text"]) for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    ids, padding = check(m.query(spark, "/root/testdata/sf0.001").collect(), docs, 2048)
    assert padding <= 0.005 * ids
