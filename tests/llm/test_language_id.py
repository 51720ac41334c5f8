import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from graphloom.llm import language_id as m


def rows(n=120):
    words = {"en": "the and of with thing", "de": "der und nicht schön ein", "fr": "le que être dans où", "es": "el niño que está los"}
    out = []
    for k in range(n):
        lang = list(words)[k % 4]
        w = words[lang].split()
        out.append((k, " ".join(w[(k * 7 + j * j) % 5] for j in range(30)), lang if k % 9 else None, 1))
    return out + [(1000, None, "en", 1), (1001, "12 ²³ !!", None, 1), (1002, "", "xx", 1), (3, "der und ein " * 9000, "de", 1)]


def test_predictions(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.lang_pred): x for x in m.query(spark, str(tmp_path)).collect()}
    truth = {i: list("en de fr es".split())[i % 4] for i in range(120)}
    assert sum((i, lang) in got for i, lang in truth.items()) >= 118
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (3, "de")} <= set(got)
    kept = m.keep_identified(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(data) - 3


def test_labels_of_predicted_rows_do_not_matter(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score int")
    model = m.learn(d)
    a = m.identify(d, model).collect()
    b = m.identify(d.selectExpr("doc_id + 5 as doc_id", "text", "'xx' as lang"), model).collect()
    assert sorted((x.doc_id + 5, x.lang_pred) for x in a) == sorted((x.doc_id, x.lang_pred) for x in b)


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert m.learn(d) is None and m.identify(d, None).first().lang_pred == "und"
    assert m.identify(d.limit(0), m.learn(d.limit(0))).count() == 0


def test_letters():
    assert m.has_letter("é".encode()) and not m.has_letter("½ ² 5_".encode()) and not m.has_letter(None)


def test_without_a_model_the_stage_keeps_texts_with_a_letter(spark):
    d = spark.createDataFrame([(1, "abc", None), (2, None, None), (3, "12 !", None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in m.keep_identified(d).collect()) == [1, 4]


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(m, "MAX_DOCS", 150)
    langs = [f"l{a}{b}" for a in "abcdefgh" for b in "abcdefghij"]
    d = spark.createDataFrame([(k, f"{langs[k % 80][1:] * 4} " * 20, langs[k % 80]) for k in range(800)], "doc_id long, text string, lang string")
    model = m.learn(d)
    assert model.langs == langs
    got = m.identify(d, model).collect()
    assert sum(x.lang_pred == langs[x.doc_id % 80] for x in got) >= 780


def brute(model, text):
    """The prediction from the learned weights alone, gram by gram and pair by pair."""
    if not any(c.isalpha() for c in text or ""):
        return "und"
    raw = re.sub(rb"[^a-z\x80-\xff]", b" ", b" " + text.encode().lower() + b" ")
    x = np.zeros(m.DIMS)
    for i in range(len(raw) - 2):
        key = raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16
        x[(key * 2654435761 % 2**32) >> 19] += 1
    x = np.sqrt(x / x.sum())
    margin = [float(x @ model.w[:, k] + model.b[k]) for k in range(model.w.shape[1])]
    family = max(range(len(model.families)), key=lambda f: margin[f])
    votes = {a: (0, 0.0) for a in model.members[family]}
    for k, (a, b) in enumerate(model.pairs):
        if a in votes:
            share = 1 / (1 + np.exp(-4 * margin[len(model.families) + k]))
            votes[a] = (votes[a][0] + (share >= 0.5), votes[a][1] + share)
            votes[b] = (votes[b][0] + (share < 0.5), votes[b][1] + 1 - share)
    return model.langs[max(votes, key=lambda a: votes[a])]


def test_query_on_the_documents_equals_brute_force_and_is_right_on_held_out_ones(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()}
    model = m.learn(spark.read.parquet(f"{d}/documents.parquet"))
    got = m.query(spark, d).collect()
    assert len(got) == len(docs)
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    for x in got[::4]:
        assert x.lang_pred == brute(model, docs[x.doc_id]["text"])
    known = [x for x in held if docs[x.doc_id]["lang"] and x.lang_pred != "und"]
    right = sum(x.lang_pred == docs[x.doc_id]["lang"] for x in known)
    assert len(known) > 200 and right / len(known) >= 0.99
