import numpy as np

from graphloom.llm import simhash_dedup as m


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(docs):
    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: len(a & b) * 5 >= len(a | b) * 4
    group = [i for i, _ in docs]
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(i):
                if group[i] != group[j] and near(sets[i], sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return group


def brute(docs):
    return {d for (d, _), g in zip(docs, classes(docs)) if d == g}


def test_keep_one_equals_brute_force_similarity(spark):
    r = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in r.integers(0, 4000, n)]
    docs, line = [], " ".join(word(30))
    for _ in range(25):  # near copies with one to eight changed words, inserted words, a cut tail
        w = word(int(r.integers(40, 220)))
        docs.append(w)
        for changes in (1, 2, 4, 8):
            v = list(w)
            for k in r.integers(0, len(v), changes):
                v[k] = f"x{r.integers(10**6)}"
            docs.append(v)
        docs.append([*w[:20], "new", *w[20:]])
        docs.append(w[: int(len(w) * r.uniform(0.7, 0.95))])
    docs = [" ".join(w) for w in docs] + [f"{line} {' '.join(word(60))}" for _ in range(20)]
    docs += [f"{(line + ' ') * 8}{' '.join(word(40))}" for _ in range(20)] + ["a b", "A  b", "a c", None, "", " "]  # one line dominates
    ids = r.permutation(len(docs)).tolist()
    docs = list(zip(ids, docs, strict=True))
    want = brute(docs)
    assert len(docs) * 0.3 < len(want) < len(docs) * 0.8
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(x.doc_id for x in m.keep_one(d).collect()) == sorted(want)


def test_one_changed_word_in_200_is_a_copy_and_a_shared_line_is_not(spark):
    w = [f"w{k}" for k in range(200)]
    line = "this line is repeated on each page of the site "
    docs = [(k, " ".join([*w[: 9 * k], "other", *w[9 * k + 1 :]])) for k in range(12)]
    docs += [(100 + k, line * 30 + " ".join(f"y{k}_{j}" for j in range(40))) for k in range(5)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(x.doc_id for x in m.keep_one(d).collect()) == [0, 100, 101, 102, 103, 104]


def test_a_large_group_whose_members_are_partly_unlike(spark, monkeypatch):
    """Each member is a few changes from one text, so two of them may be far apart; blocks hold few of them."""
    monkeypatch.setattr(m, "BLOCK_VALUES", 3000)
    r = np.random.default_rng(7)
    base = [f"w{x}" for x in r.integers(0, 4000, 100)]
    docs = []
    for k in range(150):
        v = list(base)
        for at in r.integers(0, len(v), int(r.integers(1, 8))):
            v[at] = f"x{r.integers(10**6)}"
        docs.append((k, " ".join(v)))
    docs += [(1000 + k, t) for k, (_, t) in enumerate(docs[:40])] + [(None, docs[0][1])]
    got = {x.doc_id: x.component_id for x in m.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    docs = [x for x in docs if x[0] is not None]
    want = dict(zip((i for i, _ in docs), classes(docs), strict=True))
    assert got == want and 5 < len(set(want.values())) < 120


def test_unlike_texts_stay_whatever_their_ids(spark):
    a, b, c = ("one two three four five six seven", "quite another text that shares no words", "a third one of no relation at all")
    rows = [(1, a), (1, b), (None, c), (None, c), (2, a), (None, a), (3, c), (5, None), (4, ""), (1, b)]
    got = m.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (1, b), (3, c), (4, "")], key=str)
    only_null = [(None, a), (None, b), (None, a)]
    assert sorted(r.text for r in m.keep_one(spark.createDataFrame(only_null, "doc_id long, text string")).collect()) == [a, b]


def test_copies_are_found_by_simhash_fingerprints(spark, monkeypatch):
    """Fingerprints bit by bit; where the Gray-order index finds nothing, no near copy is found, and a full group loses none."""
    sets = m.shingle_set(" ".join(f"w{k}" for k in range(2500)).encode())
    h = (sets[:, None] ^ m._SALTS[0, :3]) * (m._SALTS[1, :3] | np.uint64(1))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    want = [sum(1 << b for b in range(64) if 2 * int((h[:, t] >> np.uint64(b) & np.uint64(1)).sum()) > len(sets)) for t in range(3)]
    assert m.near_prints(sets, 3).tolist() == want
    w = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join([*w[: 9 * k], "other", *w[9 * k + 1 :]])) for k in range(12)] + [(50 + k, f"text {k} of no relation at {k} all {k}") for k in range(9)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(m, "GROUP_LIMIT", 2)
    assert m.keep_one(d).count() == 10
    monkeypatch.undo()
    monkeypatch.setattr(m.GrayTree, "pairs", lambda *_, **__: iter([]))
    got = list(m._class_batches(4)(iter([])))
    assert got == [] and m.near_plan(235_000)[0] == 10 and m.near_plan(15_000_000)[1] > m.near_plan(235_000)[1]
    v = np.sort(np.arange(3, dtype=np.int64) << 40)
    batch = m.pa.RecordBatch.from_arrays([m.pa.array([0, 0, 0], m.pa.int32()), m.pa.array(v), m.pa.array([7, 8, 9])], ["place", "v", "node"])
    assert [b.num_rows for b in m._class_batches(4)(iter([batch]))] == [0]
    monkeypatch.undo()
    assert [b.num_rows for b in m._class_batches(4)(iter([batch]))] == [3]
