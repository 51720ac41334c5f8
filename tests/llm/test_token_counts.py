import numpy as np
import pyarrow.parquet as pq
import public_tokenizers as P
import sentencepiece

from graphloom.llm import token_counts as m

MODEL = P.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a  b ", "<s> hi </s> <unk>", "▁x ▁", "a\x00b", "ﬁ x² 日本 語", "aaaaaaa aaaa aaaaaaaaaaaaaaa", "x\n\n y\t", "don't  stop!!!  now...", "x" * 500]


def test_every_prefix_equals_library():
    sp, c = sentencepiece.SentencePieceProcessor(model_file=MODEL), m.PrefixCounter(MODEL)
    more = [t[:250] for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:40]]
    for t in TEXTS + more:
        assert m.counts_of(c.prefixes(t)).tolist() == [len(sp.encode(t[:k])) for k in range(len(t) + 1)], t


def test_counts_from_stored_prefixes(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    long = "long text " * 5000
    docs = [*enumerate(TEXTS), (50, None), (3, "again"), (3, "again"), (60, long), (None, "no id")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as steps")
    table = m.prefix_table(d, MODEL)
    got = sorted((tuple(x) for x in m.within(table, 100).collect()), key=str)
    want = []
    for i, t in docs:
        t = t or ""
        n = len(sp.encode(t))
        k = len(t) if n <= 100 else max(k for k in range(600) if len(sp.encode(t[:k])) <= 100)
        want.append((i, len(t.encode()), n, n > 100, k))
    assert got == sorted(want, key=str)
    steps = next(x.steps for x in table.collect() if x.doc_id == 60)
    assert m.counts_of(steps)[5000] == len(sp.encode(long[:5000]))
    assert m.within(m.prefix_table(d.limit(0), MODEL), 100).count() == 0


def test_query_equals_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in m.query(spark, "/root/testdata/sf0.001").collect()}
    n = {d["doc_id"]: (len((d["text"] or "").encode()), len(sp.encode(d["text"] or ""))) for d in docs}
    assert got == {i: (b, t, t > 4096) for i, (b, t) in n.items()}
