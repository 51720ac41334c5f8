import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers as P
import test_near_copies as near
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import decontaminate, secrets

DIR = "/root/testdata/sf0.001"


def brute():
    rows = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = sorted(((r["doc_id"], r["text"]) for r in rows if r["text"] and any(c.isalpha() for c in r["text"])))
    rows = [r for r, g in zip(rows, near.classes(rows), strict=True) if r[0] == g]
    wins = {w for b in pq.read_table(f"{DIR}/benchmark.parquet").to_pylist() for w in decontaminate.windows_of(decontaminate.words_of(b["text"].encode()))}
    sizes = {len(w) for w in wins}
    out = []
    for i, t in rows:
        raw = t.encode()
        folded = raw.translate(decontaminate.FOLD)
        where = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
        words = tuple(folded[a:b] for a, b in where)
        hit = {k + d for n in sizes for k in range(len(words) - n + 1) if words[k : k + n] in wins for d in range(n)}
        if hit and len(hit) == len(words):
            continue
        keep, last = b"", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                keep += raw[last : where[k][0]]
            last = where[k][1]
        t = (keep + raw[last:]).decode()
        spans = sorted((m.start(), m.end()) for r in secrets.BASE_RULES + secrets.MORE_RULES for m in re.finditer(r.regex, t, (re.I | re.A) if r.ignore_case else re.A) if len(m.group(r.group)) >= r.least)
        text, at = "", 0
        for a, b in spans:
            if b > at:
                text += t[at:a] + "[SECRET]" if a >= at else ""
                at = b
        out.append((i, text + t[at:]))
    return out


def test_run_equals_brute_force(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in brute():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == sorted(want)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars != length(text)").count() == 0


def test_stages_take_columns_of_any_name(spark):
    """Names that the operators use for columns of their own, nulls, repeated rows and ids, empty texts."""
    odd = ["mask", "spans", "_id", "_n", "_spans", "_lang_pred", "_lang_score", "_lang_text", "_text", "row", "key", "maybe", "masked", "node", "keys", "hub", "N", "Label", "a", "b", "component_id", "lang", "source", "a.b", "c0", "n_chars"]
    bench = pq.read_table(f"{DIR}/benchmark.parquet").to_pylist()[0]["text"]
    texts = ["plain words of a text here", "plain words of a text here", None, "", "x " + bench + " y password=abcdefgh1", "1 2 3"]
    rows = [(k if k < 4 else None, t, *[f"{c}{k}" for c in odd[:-1]], len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in odd[:-1]) + ", n_chars int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}{k}" for k in [int(r["mask"][4:])] for c in odd[:-1]), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0
