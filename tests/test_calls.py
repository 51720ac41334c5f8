import random

import pytest

from graphloom.operators import calls as C


def frame(spark, edges):
    return spark.createDataFrame(edges, "caller long, callee long")


@pytest.mark.parametrize("few", [0, 2, 500_000])
def test_components_and_cycles(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_CALLS", few)
    g = frame(spark, [(1, 2), (2, 1), (2, 3), (3, 3), (3, 4), (5, 4)])
    comp = C.strong_components(g)
    assert {(r.id, r.component) for r in comp.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    assert {(r.component, r.cycle_type, r["size"]) for r in C.call_cycles(g, comp).collect()} == {(1, "MutualRecursion", 2), (3, "SelfLoop", 1)}
    assert {(r.src, r.dst) for r in C.condensation(g, comp).collect()} == {(1, 3), (3, 4), (5, 4)}
    start = spark.createDataFrame([(1,)], "start long")
    assert {r.id: r.reason for r in C.dead_symbols(spark.createDataFrame([(k,) for k in range(1, 7)], "id long"), g, start).collect()} == {5: "never called", 6: "never called"}
    assert {tuple(r.path) for r in C.call_paths(g, start).collect()} == {(1, 2, 3, 4)}


@pytest.mark.parametrize("few", [0, 20, 500_000])
def test_random_components(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_CALLS", few)
    r = random.Random(1)
    edges = sorted({(r.randrange(25), r.randrange(25)) for _ in range(45)})

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [d for s, d in edges if s == x]
        return seen

    ids = {x for e in edges for x in e}
    to = {a: reach(a) for a in ids}
    want = {a: min(b for b in ids if b in to[a] and a in to[b]) for a in ids}
    assert {x.id: x.component for x in C.strong_components(frame(spark, edges)).collect()} == want


def test_call_paths_with_limits_and_ends(spark):
    r = random.Random(2)
    edges = sorted({(r.randrange(12), r.randrange(12)) for _ in range(30)})
    to = {a: sorted({d for s, d in edges if s == a and d != a}) for a in range(12)}

    def walk(path, depth, end):
        nxt = [x for x in to[path[-1]] if x not in path] if len(path) < depth else []
        if path[-1] == end if end is not None else not nxt:
            yield path
        for x in nxt:
            yield from walk([*path, x], depth, end)

    calls, start = frame(spark, edges), spark.createDataFrame([(edges[0][0],)], "start long")
    for depth, end, most in ((50, None, None), (5, None, None), (50, None, 7), (4, None, 3), (6, 5, None), (6, 5, 4), (1, None, None)):
        want = sorted(walk([edges[0][0]], depth, end))[:most]
        goal = None if end is None else spark.createDataFrame([(end,)], "start long")
        got = C.call_paths(calls, start, depth, goal, most)
        assert sorted(list(x.path) for x in got.collect()) == want, (depth, end, most)
    figures = C.call_path_statistics(C.call_paths(calls, start, 50, max_paths=8), 7).first()
    want = sorted(walk([edges[0][0]], 50, None))
    assert (figures.paths, figures.truncated) == (min(7, len(want)), len(want) > 7)


def first_to(edges, start, ends, depth, most):
    """Depth-first in order, with a search from each symbol for whether an end can still be reached."""
    to = {}
    for a, b in edges:
        if a != b:
            to.setdefault(a, set()).add(b)

    def leads_on(path):
        ring, seen = [path[-1]], set(path)
        for _ in range(depth - len(path) + 1):
            if any(x in ends for x in ring):
                return True
            ring = sorted({y for x in ring for y in to.get(x, ()) if y not in seen})
            seen |= set(ring)
        return False

    out = []

    def walk(path):
        if path[-1] in ends:
            out.append(path)
        for x in sorted(to.get(path[-1], ())):
            if len(out) >= most:
                return
            if x not in path and len(path) < depth:
                p = [*path, x]
                if x in ends or leads_on(p):
                    walk(p)

    walk([start])
    return sorted(out)[:most]


def test_first_paths_to_ends(spark):
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "start long")
    r = random.Random(4)
    for n, m, depth, most, ends in ((30, 60, 12, 20, {7}), (25, 60, 50, 10, {3, 4, 5}), (40, 60, 8, 100, {0, 39})):
        edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
        got = C.call_paths(frame(spark, edges), one(edges[0][0]), depth, one(*ends), most)
        assert sorted(list(x.path) for x in got.collect()) == first_to(edges, edges[0][0], ends, depth, most), (n, m)


def test_beginnings_that_lead_back_are_not_followed(spark):
    """Of 2**14 ways each only comes back to 1, and the end lies behind that."""
    edges = [(0, 1), (1, 2), (1, 100), (100, 101)] + [e for k in range(2, 44, 3) for e in ((k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3))] + [(44, 1)]
    one = lambda i: spark.createDataFrame([(i,)], "start long")
    assert [list(x.path) for x in C.call_paths(frame(spark, edges), one(0), 50, one(101), 5).collect()] == [[0, 1, 100, 101]]
    assert C.call_paths(frame(spark, edges), one(0), 50, one(77), 5).collect() == []


def test_reachability_by_labels(spark, monkeypatch):
    monkeypatch.setattr(C, "HUBS", 3)
    monkeypatch.setattr(C, "MORE_HUBS", 3)
    r = random.Random(8)
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(55)})
    calls, ids = frame(spark, edges), sorted({x for e in edges for x in e})

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [d for s, d in edges if s == x]
        return seen

    components = C.cut(C.strong_components(calls), "components")
    labels = C.reachability_labels(calls, components)
    want = {(a, b) for a in ids for b in reach(a)}
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids] + [(1000, 1)], "a long, b long")
    assert {(x.a, x.b) for x in C.reaches(pairs, components, labels).collect()} == want
    some = {i for i in ids if i % 3 == 0}
    got = C.reached_among(spark.createDataFrame([(i,) for i in some], "id long"), components, labels).collect()
    assert sorted((x.a, x.b) for x in got) == sorted((a, b) for a, b in want if a in some and b in some)
    assert labels[0].count() + labels[1].count() < 2 * len(want)


def test_no_table_of_all_hubs_and_nodes_that_meet(spark, monkeypatch):
    """40 symbols call one, which calls 40: later hubs are many, and each meets all on the other side by the first one."""
    edges = [(k, 1000) for k in range(40)] + [(1000, 2000 + k) for k in range(40)]
    rows, cut = [], C.cut
    monkeypatch.setattr(C, "FEW_CALLS", 10)
    monkeypatch.setattr(C, "HUBS", 1)
    calls = frame(spark, edges)
    components = cut(C.strong_components(calls), "components")

    def counted(df, name="step"):
        out = cut(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(C, "cut", counted)
    labels = C.reachability_labels(calls, components)
    assert max(rows) < 300
    got = C.reached_among(spark.createDataFrame([(0,), (1,), (1000,), (2000,)], "id long"), components, labels).collect()
    assert sorted((x.a, x.b) for x in got) == [(0, 0), (0, 1000), (0, 2000), (1, 1), (1, 1000), (1, 2000), (1000, 1000), (1000, 2000), (2000, 2000)]


@pytest.mark.parametrize("deal, few", [(1, 500_000), (12, 5)])
def test_reachable_among_some(spark, monkeypatch, deal, few):
    monkeypatch.setattr(C, "DEAL", deal)
    monkeypatch.setattr(C, "FEW_CALLS", few)
    r = random.Random(deal + few)
    edges = sorted({(r.randrange(60), r.randrange(60)) for _ in range(70)})

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [d for s, d in edges if s == x]
        return seen

    some = {i for i in range(70) if i % 9 == 0}
    asked = spark.createDataFrame([(i,) for i in [*some, 0]], "id long")
    got = [(x.a, x.b) for x in C.reachable_among(frame(spark, [*edges, (None, 1), (2, None)]), asked).collect()]
    assert sorted(got) == sorted((a, b) for a in some for b in reach(a) & some)


def test_calls_between_some_symbols_are_few(spark, monkeypatch):
    """A chain of 300, a tree below it and one above: three symbols are asked for, and a call on a loop between two of them."""
    monkeypatch.setattr(C, "DEAL", 3)
    chain = [(k, k + 1) for k in range(300)]
    trees = [(150, 1001)] + [(1000 + k, 1000 + 2 * k + j) for k in range(1, 64) for j in (0, 1)] + [(2000 + 2 * k + j, 2000 + k) for k in range(1, 64) for j in (0, 1)] + [(2001, 150)]
    written, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, name="step": written.append(name) or cut(df, name))
    asked = spark.createDataFrame([(100,), (200,), (1100,)], "id long")
    got = C.between(frame(spark, [*chain, *trees, (200, 5000), (5000, 100)]), asked)
    assert len(written) < 80 and got.count() <= 4
    assert sorted((x.a, x.b) for x in C.reachable_among(got, asked).collect()) == [(a, b) for a in (100, 200, 1100) for b in (100, 200, 1100) if a != 1100 or a == b]


def test_reachable_pairs_of_one_large_graph_take_few_tables(spark, monkeypatch):
    """One graph of more calls than a task gets: what isn't asked for is taken out before labels are made."""
    from graphloom import queries as Q

    r = random.Random(5)
    edges = sorted({(r.randrange(1, 2000), r.randrange(1, 2000)) for _ in range(2200)})
    monkeypatch.setattr(C, "FEW_CALLS", 200)
    monkeypatch.setattr(C, "DEAL", 100)
    monkeypatch.setattr(Q, "_part_calls", lambda s, d: frame(s, edges))
    written, cut = [], C.cut
    for module in (C, Q):
        monkeypatch.setattr(module, "cut", lambda df, name="step": written.append(name) or cut(df, name))
    succ = {}
    for a, b in edges:
        succ.setdefault(a, []).append(b)
    want, ids = [], {x for e in edges for x in e if x % 100 == 0}
    for a in ids:
        seen, todo = set(), [a]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += succ.get(x, [])
        want += [(a, b) for b in seen & ids]
    got = Q.QUERIES["reachable_pairs"](spark, "")
    assert len(written) < 60
    assert sorted((x.a, x.b) for x in got.collect()) == sorted(want)


def test_small_weak_components_take_no_rounds(spark, monkeypatch):
    """Chains of 60 symbols: labels of a chain need no round for each symbol, in one task or in several."""
    edges = [(100 * c + k, 100 * c + k + 1) for c in range(3) for k in range(60)] + [(0, 50), (160, 160)]
    calls, written, cut = frame(spark, edges), [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, name="step": written.append(name) or cut(df, name))
    for few in (500_000, 70):
        monkeypatch.setattr(C, "FEW_CALLS", few)
        monkeypatch.setattr(C, "DEAL", 70)
        components = cut(C.strong_components(calls), "components")
        written.clear()
        labels = C.reachability_labels(calls, components)
        assert len(written) < 10
        got = C.reached_among(spark.createDataFrame([(0,), (30,), (60,), (110,), (130,), (150,)], "id long"), components, labels).collect()
        assert sorted((x.a, x.b) for x in got) == sorted((a, b) for g in ((0, 30, 60), (110, 130, 150)) for a in g for b in g if a <= b)


@pytest.mark.parametrize("name", ["blast_zone", "blast_zone_of_paths"])
def test_blast_zones_fold_only_what_is_asked_for(spark, monkeypatch, name):
    from graphloom import queries as Q

    folded, fold = [], Q.O.fold_stored
    monkeypatch.setattr(Q.O, "fold_stored", lambda blocks: folded.append(blocks) or fold(blocks))
    Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    ids = {r.function_id for b in folded for r in b.select("function_id").distinct().collect()}
    assert len(ids) == 1 if name == "blast_zone" else ids and all(i % 100 == 0 for i in ids)


def test_what_several_seeds_reach_is_found_once(spark, monkeypatch):
    calls = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(9, 3), (7, 90), (90, 7), (50, 51)], "caller long, callee long")
    monkeypatch.setattr(C, "FEW_HOPS", 3)
    assert sorted(r.id for r in C.reached(calls, spark.createDataFrame([(5,), (8,)], "start long")).collect()) == [*range(3, 10), 90]
    near = {r.node: r.depth for r in C.closure(calls, spark.createDataFrame([(5,)], "start long")).collect()}
    assert near == {5: 0, 6: 1, 7: 2, 8: 3, 90: 3, 9: 4, 3: 5, 4: 6}


def test_ancestors_need_no_other_components(spark):
    # 1 and 2 call each other, 3 is called by them and calls 4 and 5, which calls 3
    calls = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (3, 5), (5, 3), (6, 6), (6, 1), (7, 8), (4, 4)], "caller long, callee long")
    of = lambda x: sorted(r.id for r in C.component_ancestors(calls, spark.createDataFrame([(x,)], "start long")).collect())
    assert of(3) == [1, 2, 6] and of(4) == [1, 2, 3, 5, 6] and of(6) == []


def test_first_paths_are_found_from_few_entries(spark, monkeypatch):
    monkeypatch.setattr(C, "STARTS", 1)
    monkeypatch.setattr(C, "MORE_STARTS", 8)
    # entries below 20 lead nowhere; the others have two ways each
    edges = [(k, 1000 + k) for k in range(20)] + [(1000 + k, k) for k in range(20)] + [(k, x) for k in range(20, 60) for x in (2000, 2001)]
    calls = spark.createDataFrame(edges, "caller long, callee long")
    entry, end = spark.createDataFrame([(k,) for k in range(60)], "start long"), spark.createDataFrame([(2000,), (2001,)], "start long")
    tried, real = [], C._paths_among
    monkeypatch.setattr(C, "_paths_among", lambda steps, starts, *a: tried.append(starts.count()) or real(steps, starts, *a))
    got = [r.path for r in C.call_paths(calls, entry, 4, end, 3).collect()]
    assert sorted(got) == [[20, 2000], [20, 2001], [21, 2000]] and tried == [3, 24]
