import numpy as np

from graphloom.llm import decontaminate as m

SCHEMA = "doc_id long, text string, lang string, item long"


def brute(docs, items, size):
    out = {}
    wins = [(i, w) for i, t in items for w in m.windows_of(m.words_of(t.encode() if t else None), size)]
    for d, t in docs:
        words = tuple(m.words_of(t.encode() if t else None))
        hit, found = set(), set()
        for i, w in wins:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    found.add(i)
        out[d] = (len(words), len(hit), sorted(found))
    return out


def cases(seed):
    r = np.random.default_rng(seed)
    vocab = ["a", "b", "C", "d1", "é", "of"]
    text = lambda n: " ".join(r.choice(vocab, n))
    items = [(k, text(int(r.integers(0, 14)))) for k in range(12)] + [(50, None), (51, "b, C. d1!"), (3, "zz yy")]
    docs = [(k, text(int(r.integers(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, items[4][1]), (103, "x " * 3000), (104, ("a b " * 2000))]
    return docs, items


def test_hits_equal_brute_force(spark, monkeypatch):
    for seed, shard, block in ((1, 100, 8 << 20), (2, 10**6, 60)):
        monkeypatch.setattr(m, "SHARD_WORDS", shard)
        monkeypatch.setattr(m, "BLOCK_BYTES", block)
        docs, items = cases(seed)
        d = spark.createDataFrame([(a, b, "en", 1) for a, b in docs], SCHEMA)
        b = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in m.hits(d, b, 4).collect()}
        assert got == brute(docs, items, 4)


def test_removal_keeps_clean_documents(spark):
    d = spark.createDataFrame([(1, "Clean text here.", "en", 1), (2, "Oh one Two, three four! five", "en", 2), (3, "two three", None, 3), (4, None, "en", 4)], SCHEMA)
    b = spark.createDataFrame([(9, "two three")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.item) for r in m.remove_hits(d, b).collect()}
    assert got == {1: ("Clean text here.", 1), 2: ("Oh one  four! five", 2), 4: (None, 4)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    b = spark.createDataFrame([], "item_id long, text string")
    assert m.hits(d, b).count() == 0
    one = spark.createDataFrame([(1, "x", "en", 1)], SCHEMA)
    assert m.hits(one, b).first().n_words == 1


def test_rows_with_null_and_repeated_ids_keep_their_own_hits(spark, monkeypatch):
    texts = ["one two three four x", "two three", "x y two three four", "clean words", "clean words", None, "a b c d e f g eight nine"]
    rows = [(i, t, "en", k) for k, (i, t) in enumerate([*((None, t) for t in texts), *((7, t) for t in texts), (7, texts[0])])]
    d = spark.createDataFrame(rows, SCHEMA)
    b = spark.createDataFrame([(9, "two three"), (8, "three four"), (7, "eight nine")], "item_id long, text string")
    want = {"one two three four x": ("one  x", 3), "two three": (None, 2), "x y two three four": ("x y ", 3), "clean words": ("clean words", 0), None: (None, 0), texts[-1]: ("a b c d e f g ", 2)}
    for block in (8 << 20, 12):  # one block, several blocks
        monkeypatch.setattr(m, "BLOCK_BYTES", block)
        got = sorted((x.doc_id or 0, x.n_words, sum(s.end - s.start for s in x.spans)) for x in m.hits(d, b).collect())
        assert got == sorted((i or 0, len((t or "").split()), want[t][1]) for i, t, _, _ in rows)
        left = {x.item: (x.doc_id, x.text) for x in m.remove_hits(d, b).collect()}
        assert left == {k: (i, want[t][0]) for i, t, _, k in rows if t != "two three"}
