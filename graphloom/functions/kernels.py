"""Arrow kernels over functions' rows, for what needs arrays that change in place: dominator trees and ordered walks.

Spark deals the rows; a kernel sees one function at a time and passes all other columns on as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.limits import Limits

Adjacency = list[list[int]]
#: ``idom`` and ``depth`` by block (-1: none, unreached), ``enter`` (place in ``order`` from 1, 0: unreached) and ``size`` of
#: the block's subtree. What block b dominates is ``slice(order, enter[b], size[b])``.
TREE = "struct<idom:array<int>,depth:array<int>,enter:array<int>,size:array<int>,order:array<int>>"
_INTS = pa.list_(pa.int32())
_TREE = pa.struct([(f, _INTS) for f in ("idom", "depth", "enter", "size", "order")])
#: Blocks of paths in one row that the walks' kernel hands on.
CHUNK = 100_000
#: Functions that a kernel has as Python objects at once, however many come in a batch.
ROWS = 500


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def reverse_postorder(root: int, succ: Adjacency) -> list[int]:
    """Blocks reached from ``root``, each before what it leads to but for edges that close a cycle."""
    seen, out, stack = {root}, [], [(root, iter(succ[root]))]
    while stack:
        block, rest = stack[-1]
        for x in rest:
            if x not in seen:
                seen.add(x)
                stack.append((x, iter(succ[x])))
                break
        else:
            out.append(block)
            stack.pop()
    return out[::-1]


def dominator_tree(n: int, root: int, succ: Adjacency, pred: Adjacency) -> dict[str, list[int]]:
    """The tree of immediate dominators, as in ``TREE``.

    Blocks are numbered in reverse postorder, so that a dominator's number is less than the block's. A block's immediate
    dominator is where its predecessors' chains meet; passes over all blocks end with the first that changes nothing.
    """
    order = reverse_postorder(root, succ)
    place = dict(zip(order, range(len(order))))
    up = [0] + [-1] * (len(order) - 1)
    incoming = [sorted(place[p] for p in pred[b] if p in place) for b in order]
    changed = True
    while changed:
        changed = False
        for i in range(1, len(order)):
            meet = -1
            for p in incoming[i]:
                if up[p] < 0:
                    continue
                if meet < 0:
                    meet = p
                while meet != p:
                    if meet > p:
                        meet = up[meet]
                    else:
                        p = up[p]
            if meet != up[i]:
                up[i], changed = meet, True
    depth, size = [0] * len(order), [1] * len(order)
    for i in range(1, len(order)):
        depth[i] = depth[up[i]] + 1
    for i in range(len(order) - 1, 0, -1):
        size[up[i]] += size[i]
    enter, free = [1] * len(order), [2] * len(order)
    for i in range(1, len(order)):  # a parent's subtree is laid out child by child
        enter[i], free[i] = free[up[i]], free[up[i]] + 1
        free[up[i]] += size[i]
    out = {"idom": [-1] * n, "depth": [-1] * n, "enter": [0] * n, "size": [0] * n, "order": [0] * len(order)}
    for i, b in enumerate(order):
        out["idom"][b] = order[up[i]] if i else -1
        out["depth"][b], out["enter"][b], out["size"][b], out["order"][enter[i] - 1] = depth[i], enter[i], size[i], b
    return out


#: By block: ``inner``, the header of the innermost loop it is in (its own for a header, -1: none); of headers ``outer``, the
#: header of the next loop around (-1: none), ``level`` (0: outermost) and ``size`` (blocks, those of inner loops too); whether
#: the function has cycles that no header dominates.
FOREST = "struct<inner:array<int>,outer:array<int>,level:array<int>,size:array<int>,irreducible:boolean>"
_FOREST = pa.struct([(f, _INTS) for f in ("inner", "outer", "level", "size")] + [("irreducible", pa.bool_())])


def loop_forest(n: int, succ: Adjacency, pred: Adjacency, depth: list[int], back: list[dict[str, int]]) -> dict[str, object]:
    """How natural loops lie in each other, as in ``FOREST``; loops of one header are one.

    Deeper headers in the dominator tree come first: their loops are collapsed to the header, so that no block is walked
    over more than once for each loop that it is directly in.
    """
    tails: dict[int, list[int]] = {}
    for e in back:
        tails.setdefault(e["header"], []).append(e["tail"])
    link, inner, outer, size = list(range(n)), [-1] * n, [-1] * n, [0] * n

    def find(x: int) -> int:
        top = x
        while link[top] != top:
            top = link[top]
        while link[x] != top:
            link[x], x = top, link[x]
        return top

    heads = sorted(tails, key=lambda h: -depth[h])
    for h in heads:
        inner[h], size[h], todo = h, 1, list(tails[h])
        while todo:
            x = find(todo.pop())
            if x == h:
                continue
            if x in tails:
                outer[x] = h
                size[h] += size[x]
            else:
                inner[x] = h
                size[h] += 1
            link[x] = h
            todo += [p for p in pred[x] if depth[p] >= 0]
    level = [-1] * n
    for h in reversed(heads):  # outer headers dominate inner ones
        level[h] = 0 if outer[h] < 0 else level[outer[h]] + 1
    closing = {(e["tail"], e["header"]) for e in back}
    waits = [sum((p, b) not in closing for p in pred[b] if depth[p] >= 0) for b in range(n)]
    ready, left = [b for b in range(n) if depth[b] >= 0 and not waits[b]], sum(d >= 0 for d in depth)
    while ready:
        b = ready.pop()
        left -= 1
        for x in succ[b]:
            if (b, x) not in closing:
                waits[x] -= 1
                if not waits[x]:
                    ready.append(x)
    return {"inner": inner, "outer": outer, "level": level, "size": size, "irreducible": left > 0}


def with_column(df: DataFrame, name: str, ddl: str, kind: pa.DataType, inputs: list[str], value: Callable) -> DataFrame:
    """``df`` and a column ``name`` with ``value`` of the ``inputs`` columns, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            own = [value(*row) for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, kind)], [*b.schema.names, name])

    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{name} {ddl}"]))


def with_tree(df: DataFrame, name: str, root: str | None, succ: str, pred: str) -> DataFrame:
    """``df`` and the dominator tree from block 0, or from the block in column ``root``, over the given adjacency."""
    if root is None:
        return with_column(df, name, TREE, _TREE, ["n", succ, pred], lambda n, s, p: dominator_tree(n, 0, s, p))
    return with_column(df, name, TREE, _TREE, ["n", root, succ, pred], dominator_tree)


def walks(succ: Adjacency, exits: list[int], headers: list[int], limits: Limits, dead_ends: bool = True) -> Iterator[list[int]]:
    """Bounded walks from block 0 that end at the first exit (or where nothing follows), in order, block by block.

    Loop headers occur up to the unroll limit, other blocks once; a function without an exit has none. A depth-first walk
    only enters blocks from which some end can still be reached within max_length, over blocks that may be visited again,
    so that every step leads to a walk: time is in proportion to the walks asked for, however many lead nowhere.
    """
    n, ends = len(succ), set(exits)
    if not ends or limits.max_length < 1 or limits.max_paths < 1:
        return
    if dead_ends:
        ends |= {b for b in range(n) if not succ[b]}
    back: Adjacency = [[] for _ in range(n)]
    for b in range(n):
        if b not in ends:
            for x in succ[b]:
                back[x].append(b)
    far = 1 << 40  # more than any max_length
    away, ahead, ring = [far] * n, [-1] * n, list(ends)  # blocks to the nearest end, and the next of them
    for b in ring:
        away[b] = 0
    while ring:
        wider = []
        for x in ring:
            for b in back[x]:
                if away[b] == far:
                    away[b], ahead[b] = away[x] + 1, x
                    wider.append(b)
        ring = wider
    left = [1] * n
    for h in headers:
        left[h] = limits.loop_unroll
    if left[0] < 1 or away[0] >= limits.max_length:
        return
    order = {b: i for i, b in enumerate(reverse_postorder(0, succ))}
    cyclic = any(order[x] <= i for b, i in order.items() if b not in ends for x in succ[b])

    def leads_on(b: int, room: int) -> bool:
        """Whether an end is at most ``room`` blocks away from ``b``, over blocks that may still be visited."""
        if away[b] > room:
            return False
        x = b
        while x not in ends:
            x = ahead[x]
            if not left[x]:
                break
        else:
            return True
        seen, ring = {b}, [b]
        for _ in range(room):
            wider = []
            for y in ring:
                for x in succ[y]:
                    if left[x] and x not in seen and away[x] < far:
                        if x in ends:
                            return True
                        seen.add(x)
                        wider.append(x)
            if not wider:
                return False
            ring = wider
        return False

    path, count = [0], 0
    left[0] -= 1
    if 0 in ends:
        yield [0]
        return
    stack = [iter(succ[0])]
    while stack:
        for x in stack[-1]:
            room = limits.max_length - len(path) - 1
            if not left[x] or room < 0 or away[x] > room:
                continue
            if x in ends:
                yield [*path, x]
                count += 1
                if count == limits.max_paths:
                    return
                continue
            left[x] -= 1
            # along the nearest way of a block that leads on, nothing was visited
            if cyclic and not leads_on(x, room):
                left[x] += 1
                continue
            path.append(x)
            stack.append(iter(succ[x]))
            break
        else:
            stack.pop()
            left[path.pop()] += 1


def all_walks(df: DataFrame, limits: Limits, dead_ends: bool, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``paths`` (arrays of blocks), some of a function's walks to a row, from ``succ, exits, headers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            kept = pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep], keep)
            at, found, blocks = [], [], 0

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*kept.take(pa.array(at, pa.int64())).columns, pa.array(found, pa.list_(_INTS))], [*keep, "paths"])

            inputs = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("succ", "exits", "headers")))
            for i, (succ, exits, headers) in enumerate(inputs):
                own: list[list[int]] = []
                for p in walks(succ, exits, headers, limits, dead_ends):
                    own.append(p)
                    blocks += len(p)
                    if blocks >= CHUNK:
                        at.append(i)
                        found.append(own)
                        yield rows()
                        at, found, own, blocks = [], [], [], 0
                if own:
                    at.append(i)
                    found.append(own)
            if at:
                yield rows()

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["paths array<array<int>>"]))


def with_forest(headed: DataFrame) -> DataFrame:
    """``headed`` (with ``dom`` and ``back``) and ``forest``."""
    return with_column(headed.withColumn("depth", F.col("dom.depth")), "forest", FOREST, _FOREST, ["n", "succ", "pred", "depth", "back"], loop_forest)


def components(succ: dict) -> Iterator[list]:
    """Strong components of a graph given by what each node leads to, by one depth-first search."""
    number: dict = {}
    low: dict = {}
    open_, waiting = [], set()
    for root in succ:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        open_.append(root)
        waiting.add(root)
        stack = [(root, iter(succ[root]))]
        while stack:
            node, rest = stack[-1]
            for x in rest:
                if x not in number:
                    number[x] = low[x] = len(number)
                    open_.append(x)
                    waiting.add(x)
                    stack.append((x, iter(succ.get(x, ()))))
                    break
                if x in waiting:
                    low[node] = min(low[node], number[x])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == number[node]:
                    found = [open_.pop()]
                    while found[-1] != node:
                        found.append(open_.pop())
                    waiting.difference_update(found)
                    yield found


def strong_components(arcs: DataFrame) -> DataFrame:
    """``id, member`` for the ends of ``arcs`` (``src, dst``): the least member of the component, in whatever order they come.

    A task holds all arcs of its partition; the caller has counted them, and no component is in two partitions.
    """
    kind = arcs.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        succ: dict = {}
        arrow = pa.int64()
        for b in batches:
            arrow = b.column(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                succ.setdefault(x, []).append(y)
        for x in [y for to in succ.values() for y in to]:
            succ.setdefault(x, [])
        rows = [(x, least) for found in components(succ) for least in [min(found)] for x in found]
        for at in range(0, len(rows), CHUNK):
            ids, members = zip(*rows[at : at + CHUNK])
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(members, arrow)], ["id", "member"])

    return arcs.select("src", "dst").mapInArrow(run, f"id {kind}, member {kind}")


def hub_labels(succ: dict, pred: dict) -> tuple[dict, dict]:
    """For each node of an acyclic graph the hubs that it reaches, and those that reach it; each node is a hub, those with
    most arcs first, and spreads both ways as far as no earlier hub tells the same."""
    out: dict = {x: set() for x in succ}
    into: dict = {x: set() for x in succ}
    for hub in sorted(succ, key=lambda x: (-len(succ[x]) - len(pred[x]), x)):
        for step, own, far in ((succ, out[hub], into), (pred, into[hub], out)):
            seen, todo = {hub}, [hub]
            while todo:
                x = todo.pop()
                if x != hub and not own.isdisjoint(far[x]):
                    continue
                far[x].add(hub)
                new = [y for y in step[x] if y not in seen]
                seen.update(new)
                todo += new
    return out, into


def reach_labels(arcs: DataFrame) -> DataFrame:
    """``component, hub, way`` (0: reaches the hub, 1: the hub reaches it) for the ends of acyclic ``arcs`` (``src, dst``).

    A task holds all arcs of its partition; no two partitions have arcs of one weak component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        succ: dict = {}
        pred: dict = {}
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for node in (x, y):
                    succ.setdefault(node, [])
                    pred.setdefault(node, [])
                succ[x].append(y)
                pred[y].append(x)
        for way, labels in enumerate(hub_labels(succ, pred)):
            rows = [(x, h) for x, hubs in labels.items() for h in hubs]
            for at in range(0, len(rows), CHUNK):
                own, hubs = zip(*rows[at : at + CHUNK])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(hubs, pa.int64()), pa.array([way] * len(own), pa.int32())], ["component", "hub", "way"])

    return arcs.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(run, "component long, hub long, way int")
