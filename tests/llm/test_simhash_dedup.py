import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import simhash_dedup as m
from graphloom.llm.components import components


def classes(ids, fps, radius=2):
    label = list(range(len(ids)))
    fps = np.array(fps, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min(label[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius))
            changed |= low != label[i]
            label[i] = low
    first = {}
    for i, a in sorted(zip(ids, label)):
        first.setdefault(a, i)
    return [first[a] for a in label]


def test_fingerprint_equals_sql_shingles(spark):
    text = "One two  THREE four\tfive one Two three é"
    h = spark.range(1).select(F.expr("transform(sequence(0, 6), i -> xxhash64(array_join(slice(array('one','two','three','four','five','one','two','three','é'), i + 1, 3), ' ')))").alias("h")).first().h
    bits = sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in h) * 2 > len(h))
    assert m.simhash(text.encode()) == bits
    assert m.simhash(None) == m.simhash(b" \n") == 0


def test_gray_tree_finds_all_pairs():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    v = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), r.integers(0, 64, 60).astype(np.uint64)]))
    v = v[np.argsort(m.gray_rank(v))]
    got = sorted((int(a), int(b)) for i, j in m.GrayTree(v).pairs(2, 50) for a, b in zip(i, j))
    assert got == [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if np.bitwise_count(v[i] ^ v[j]) <= 2]


def test_links_with_split_groups(spark, monkeypatch):
    monkeypatch.setattr(m, "GROUP_LIMIT", 20)
    monkeypatch.setattr(m, "CHUNK", 32)
    r = np.random.default_rng(4)
    v = [int(x) for x in r.integers(0, 2**12, 300)] + [int(x) for x in r.integers(0, 2**63, 100)]
    v = sorted(set(v + [x ^ (1 << 63) for x in v[:50]]))
    reps = spark.createDataFrame([(k, x - 2**64 if x >= 2**63 else x) for k, x in enumerate(v)], "rep long, fp long")
    got = {x.node: x.component for x in components(m.links(reps)).collect()}
    want = classes(list(range(len(v))), v)
    assert [got.get(k, k) for k in range(len(v))] == want


def test_near_duplicates(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from all of us " * 4
    docs = [(5, text), (3, text.upper()), (9, "other words entirely here"), (1, None), (2, ""), (7, "  \n"), (9, "other words entirely here"), (None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as rep")
    got = sorted((x.doc_id, x.component_id) for x in m.near_duplicates(d).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (5, 3), (7, 1), (9, 9), (9, 9)]
    assert sorted(x.doc_id for x in m.keep_one(d).collect()) == [1, 3, 9]
    assert m.near_duplicates(d.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(300, 300), (None, 4)], "a long, b long")
    assert {x.component for x in components(edges).collect()} == {0}


def test_query_equals_brute_force_from_the_contract(spark):
    """Fingerprints bit by bit and classes pair by pair, with nothing of the module."""
    import re

    import pyarrow.parquet as pq
    import xxhash

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    prints = {}
    for d in docs:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), d["text"] or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            least = min(group[j] for j, b in prints.items() if (a ^ b).bit_count() <= 2)
            changed |= least != group[i]
            group[i] = least
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in m.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{p:016x}", group[i]) for i, p in prints.items()}
