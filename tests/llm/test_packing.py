import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from graphloom.llm import packing as m

PATHS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_encoder_equals_library():
    lib = Tokenizer.from_file(PATHS[0])
    e = m.Encoder(*PATHS)
    texts = ["", " ", "a  b", " a", "a ", "a\n b", "x\n\n y", "foo\n \tbar", "don't  stop", "é<|endoftext|>x y", "日本 語　 test", "a\x00 b² Ⅷ", "x   y", "hello, world! it's 12 o'clock"]
    for t in texts * 2:
        assert e.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_best_fit_is_tight():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 100, 3000)
    bins = m.best_fit(sizes, 128)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sizes[b].sum() <= 128 for b in bins)
    assert len(bins) <= 1.02 * sizes.sum() / 128 + 1


def test_pack_places_every_piece_once(spark, monkeypatch):
    r = np.random.default_rng(1)
    docs = [(k, " ".join(r.choice(["alpha", "be", "ga\nmma", "é!"], int(r.integers(0, 90))))) for k in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "long " * 700), (5, "again"), (5, "again"), (None, "no id"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as bin", "2 as fill").repartition(9)
    rows = m.pack(d, *PATHS, capacity=64).collect()
    lib, want = Tokenizer.from_file(PATHS[0]), []
    for i, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for x in rows:
        by[x.sequence_id].append((x.offset, x.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= 1.03 * sum(x.length for x in rows) / 64 + 2


def test_empty(spark):
    assert m.pack(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_rounds_end_where_bins_stay_more_than_a_task_takes(spark, monkeypatch):
    """Bins over half full can't be combined; and those that can still meet in later rounds."""
    monkeypatch.setattr(m, "BINS_PER_TASK", 10)
    for words, fewest in ((40, 90), (20, 45)):
        d = spark.createDataFrame([(k, "a " * words) for k in range(90)], "doc_id long, text string").repartition(30)
        rows = m.pack(d, *PATHS, capacity=64).collect()
        assert len(rows) == 90 and len({x.sequence_id for x in rows}) <= fewest + 4 * (words == 20)


def test_query_places_every_token(spark):
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = m.query(spark, "/root/testdata/sf0.001").collect()
    lib, want = Tokenizer.from_file(PATHS[0]), defaultdict(int)
    for x in docs:
        want[x["doc_id"]] += len(lib.encode(x["text"] or "", add_special_tokens=False).ids) + 1
    got, fill = defaultdict(int), defaultdict(int)
    for x in rows:
        got[x.doc_id] += x.length
        fill[x.sequence_id] += x.length
    assert got == want and max(fill.values()) <= 1024
    assert len(fill) <= 1.01 * sum(want.values()) / 1024 + 2
