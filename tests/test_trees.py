"""Trees against an interpreter that runs them: the graph must give the same statements for the same decisions."""

import random

from graphloom.sources import trees as T

SCHEMA = "function_id long, node_id long, parent_id long, slot string, place int, kind string"
KINDS = ["expression_statement"] * 5 + ["if_statement", "elif", "while_statement", "for_statement", "break_statement", "continue_statement", "return_statement", "block"]


def tree(r, size):
    """Rows (node, parent, slot, place, kind) of a random tree."""
    rows = []
    for node in range(r.randint(0, size)):
        inner = [x for x in rows if x[4] not in T.LEAVES]
        parent = r.choice(inner)[0] if inner and r.random() < 0.7 else None
        rows.append((node, parent, r.choice(["then", "else", None]), r.randint(0, 5), r.choice(KINDS)))
    return rows


class Left(Exception):
    pass


class Enough(Exception):
    pass


def interpreted(rows, decide, most):
    """Statements in the order they run, at most so many."""
    ran = []

    def inside(parent, keep=lambda x: True):
        return sorted((x for x in rows if x[1] == parent and keep(x)), key=lambda x: (x[3], x[0]))

    def run(part):
        for node, _, _, _, kind in part:
            def begin(node=node):
                ran.append(node)
                if len(ran) >= most:
                    raise Enough

            begin()
            if kind in T.BRANCHES:
                taken = decide(node, len(ran))
                run(inside(node, lambda x: (x[2] != "else") == taken))
            elif kind in T.LOOPS:
                while decide(node, len(ran)):
                    try:
                        run(inside(node))
                    except Left as left:
                        if left.args[0] == "break_statement":
                            break
                        if left.args[0] == "return_statement":
                            raise
                    begin()
            elif kind in T.LEAVES:
                raise Left(kind)
            else:
                run(inside(node))

    try:
        run(inside(None))
    except (Left, Enough):
        pass
    return ran


def walked(rows, blocks, edges, decide, most):
    kind_of, ran, at = {x[0]: x[4] for x in rows}, [], 0 if blocks else None
    while at is not None:
        for node in blocks[at]["statements"]:
            ran.append(node)
            if len(ran) >= most:
                return ran
        out = [(e["edge_type"], e["dst"]) for e in edges if e["src"] == at]
        last = kind_of[blocks[at]["statements"][-1]] if blocks[at]["statements"] else None
        if last in T.BRANCHES + T.LOOPS:
            assert len(out) == 2
            (yes,) = [d for t, d in out if t in ("TrueBranch", "LoopBack")]
            (no,) = [d for t, d in out if t in ("FalseBranch", "LoopExit")]
            at = yes if decide(node, len(ran)) else no
        else:
            assert len(out) <= 1
            at = out[0][1] if out else None
    return ran


def as_nodes(rows):
    return [{"place": p, "node": n, "parent": q, "slot": s, "kind": k} for n, q, s, p, k in sorted(rows, key=lambda x: (x[3], x[0]))]


def test_blocks_run_as_the_tree_does():
    r = random.Random(5)
    steps = 0
    for _ in range(1500):
        rows = tree(r, 14)
        blocks, edges = T.tree_flow(as_nodes(rows))
        assert sorted(x for b in blocks for x in b["statements"]) == [x[0] for x in rows]
        for seed in range(6):
            decide = lambda node, k: random.Random(f"{seed} {node} {k}").random() < 0.6
            want = interpreted(rows, decide, 60)
            assert walked(rows, blocks, edges, decide, 60) == want
            steps += len(want)
    assert steps > 20000


def test_a_loop_with_a_break_and_a_return(spark):
    rows = [(7, 0, None, None, 0, "expression_statement"), (7, 1, None, None, 1, "while_statement"), (7, 2, 1, "body", 0, "if_statement"), (7, 3, 2, "then", 0, "break_statement"), (7, 4, 2, "else", 0, "return_statement"), (7, 5, 1, "body", 1, "expression_statement"), (7, 6, None, None, 2, "comment"), (7, 7, None, None, None, None)]
    rows += [(8, 1, None, None, 0, "comment"), (9, 4, 4, None, 0, "block"), (9, 5, 99, None, 1, "block"), (9, 5, 99, None, 1, "block"), (9, None, None, None, 1, "block")]
    blocks, edges = T.flows_of_trees(spark.createDataFrame(rows, SCHEMA))
    got = {(b.function_id, b.block_id): (b.kind, b.tag, b.statements) for b in blocks.collect()}
    assert got == {(7, 0): ("Entry", "Goto", [0]), (7, 1): ("Normal", "SwitchInt", [1]), (7, 2): ("Normal", "SwitchInt", [2]), (7, 3): ("Normal", "Goto", [3]), (7, 4): ("Exit", "Return", [4]), (7, 5): ("Normal", "Goto", [5]), (7, 6): ("Exit", "Return", []), (9, 0): ("Entry", "Return", [5])}
    assert sorted(tuple(e)[1:] for e in edges.collect()) == [(0, 1, "Fallthrough"), (1, 2, "TrueBranch"), (1, 6, "LoopExit"), (2, 3, "TrueBranch"), (2, 4, "FalseBranch"), (3, 6, "LoopExit"), (5, 1, "LoopBack")]


def test_empty_and_deep_trees(spark):
    empty = T.flows_of_trees(spark.createDataFrame([], SCHEMA))
    assert empty[0].count() == 0 and empty[1].count() == 0
    deep = [{"place": 0, "node": k, "parent": k - 1 if k else None, "slot": None, "kind": "while_statement"} for k in range(20000)]
    blocks, edges = T.tree_flow(deep)
    assert len(blocks) == 20001 and len(edges) == 40000
