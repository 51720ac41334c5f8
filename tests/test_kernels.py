import random
import time

import pytest

from graphloom.functions import kernels as K
from graphloom.operators import flow
from graphloom.plans.limits import Limits

from test_flow import graph


def adjacency(n, edges):
    return [sorted({b for a, b in edges if a == k}) for k in range(n)], [sorted({a for a, b in edges if b == k}) for k in range(n)]


def every_walk(succ, exits, headers, limits, dead_ends):
    ends = set(exits) | ({b for b in range(len(succ)) if not succ[b]} if dead_ends else set())
    found, todo = [], [[0]] if exits else []
    while todo:
        p = todo.pop()
        if len(p) > limits.max_length:
            continue
        if p[-1] in ends:
            found.append(p)
            continue
        todo += [[*p, x] for x in succ[p[-1]] if p.count(x) < (limits.loop_unroll if x in headers else 1)]
    return sorted(found)[: limits.max_paths]


def test_walks_are_the_first_in_order():
    r = random.Random(1)
    for _ in range(3000):
        n = r.randint(1, 7)
        succ = [sorted({r.randrange(n) for _ in range(r.randint(0, 3))}) for _ in range(n)]
        exits, headers = ([x for x in range(n) if r.random() < 0.3] for _ in range(2))
        limits, dead_ends = Limits(r.choice([0, 1, 3, 5, 1000]), r.choice([0, 1, 3, 10000]), r.choice([1, 2])), r.random() < 0.5
        assert list(K.walks(succ, exits, headers, limits, dead_ends)) == every_walk(succ, exits, headers, limits, dead_ends)


def test_dominators_by_taking_blocks_out():
    r = random.Random(2)

    def reach(succ, gone=None):
        seen, todo = set(), [0] if gone != 0 else []
        while todo:
            if (x := todo.pop()) not in seen and x != gone:
                seen.add(x)
                todo += succ[x]
        return seen

    for _ in range(2000):
        n = r.randint(1, 9)
        succ, pred = adjacency(n, [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 16))])
        t, live = K.dominator_tree(n, 0, succ, pred), reach(succ)
        want = {(a, b) for a in live for b in live if b not in reach(succ, a)}
        got = {(a, b) for a in t["order"] for b in t["order"][t["enter"][a] - 1 : t["enter"][a] - 1 + t["size"][a]]}
        assert got == want and sorted(t["order"]) == sorted(live)
        for b in range(n):
            above = {a for a, x in want if x == b}
            assert t["depth"][b] == len(above) - 1
            assert t["idom"][b] == next((a for a in above if t["depth"][a] == t["depth"][b] - 1), -1)


def diamonds(first, count):
    return [e for k in range(first, first + 3 * count, 3) for e in ((k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3))]


@pytest.mark.parametrize("last", [[(121, 122), (122, 121)], [(121, 0)], [(121, 1)]])
def test_walks_that_lead_nowhere_cost_nothing(last):
    """2**40 walks end in an endless loop, or come back to where they were; one leads out."""
    succ, _ = adjacency(203, [(0, 1), *diamonds(1, 40), *last, (0, 200), (200, 201)])
    began = time.time()
    assert list(K.walks(succ, [201], [0, 121], Limits(max_paths=10, loop_unroll=1), dead_ends=False)) == [[0, 200, 201]]
    assert time.time() - began < 1


def test_large_functions(spark):
    """A chain, and one of loops, of 5000 blocks: the tree and the headers in seconds."""
    n = 5000
    for edges in ([(k, k + 1) for k in range(n - 1)], [(k, k + 1) for k in range(n - 1)] + [(k + 1, k) for k in range(0, n - 2, 2)]):
        flows = flow.fold(*graph(spark, edges, {n - 1}, n)).persist()
        flows.count()
        began = time.time()
        rows = flow.immediate_dominators(flow.with_headers(flows)).where("idom = block_id - 1 and depth = block_id").count()
        assert rows == n - 1 and time.time() - began < 10
        # back at a header nothing is left to go to, as its tail was visited
        assert flow.enumerate_paths(flow.with_headers(flows), Limits(10**6, 3, 2)).count() == 1
        flows.unpersist()


def test_walks_of_a_function_span_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 7)
    edges = diamonds(0, 5)
    headed = flow.with_headers(flow.fold(*graph(spark, edges, {15}, 16)))
    assert flow.enumerate_paths(headed).count() == 32


def test_loop_forest_by_bodies():
    r = random.Random(3)
    for _ in range(2000):
        n = r.randint(1, 9)
        succ, pred = adjacency(n, [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 18))])
        t = K.dominator_tree(n, 0, succ, pred)
        over = lambda a, b: t["enter"][b] and 0 <= t["enter"][b] - t["enter"][a] < t["size"][a]
        back = [{"tail": a, "header": b} for a in range(n) for b in succ[a] if t["depth"][a] >= 0 and over(b, a)]
        bodies = {}
        for e in back:
            own, todo = bodies.setdefault(e["header"], {e["header"]}), [e["tail"]]
            while todo:
                if (x := todo.pop()) not in own:
                    own.add(x)
                    todo += [p for p in pred[x] if t["depth"][p] >= 0]
        f = K.loop_forest(n, succ, pred, t["depth"], back)
        for h, own in bodies.items():
            around = [g for g in bodies if g != h and h in bodies[g]]
            assert f["outer"][h] == min(around, key=lambda g: len(bodies[g]), default=-1)
            assert f["level"][h] == len(around) and f["size"][h] == len(own)
        for b in range(n):
            assert f["inner"][b] == min((h for h in bodies if b in bodies[h]), key=lambda h: len(bodies[h]), default=-1)
        rest = {(a, b) for a in range(n) if t["depth"][a] >= 0 for b in succ[a]} - {(e["tail"], e["header"]) for e in back}
        live = {x for x in range(n) if t["depth"][x] >= 0}
        while gone := {x for x in live if not any(b == x and a in live for a, b in rest)}:
            live -= gone
        assert f["irreducible"] == bool(live)


def test_forest_of_many_loops():
    """500 loops in each other: each block is met once, not once for each loop around it."""
    n = 1001
    edges = [(k, k + 1) for k in range(n - 1)] + [(n - 1 - k, k) for k in range(500)]
    succ, pred = adjacency(n, edges)
    t = K.dominator_tree(n, 0, succ, pred)
    began = time.time()
    f = K.loop_forest(n, succ, pred, t["depth"], [{"tail": n - 1 - k, "header": k} for k in range(500)])
    assert time.time() - began < 1 and f["level"][:500] == list(range(500)) and f["size"][499] == 3 and f["size"][0] == n and not f["irreducible"]
