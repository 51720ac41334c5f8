"""Flow graphs of statement trees: the blocks and edges of all functions, from a table of their statements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.sources.flows import BLOCK_FIELDS, read

#: Kinds of statements that branch, repeat and leave, and of nodes that are no statements.
BRANCHES = ("if_statement", "elif")
LOOPS = ("while_statement", "for_statement", "loop_statement")
LEAVES = ("return_statement", "break_statement", "continue_statement")
NO_STATEMENTS = ("", "comment", "line_comment", "block_comment", ";")

_NODES = "array<struct<place:int,node:bigint,parent:bigint,slot:string,kind:string>>"
_ROW = "function_id long, blocks array<struct<kind:string,terminator:string,tag:string,statements:array<bigint>,targets:array<int>,otherwise:int>>, edges array<struct<src:int,dst:int,edge_type:string>>"
_BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("terminator", pa.string()), ("tag", pa.string()), ("statements", pa.list_(pa.int64())), ("targets", pa.list_(pa.int32())), ("otherwise", pa.int32())]))
_EDGES = pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("edge_type", pa.string())]))
END = None
Step = tuple[int | None, str]


def _steps(nodes: list[dict]) -> tuple[list[int], list[dict], list[list[Step]]]:
    """Statements in the order they are written, and for each where control goes from it (None: the function's end)."""
    known = {x["node"] for x in nodes}
    within: dict[int | None, list[dict]] = {}
    for x in nodes:
        within.setdefault(x["parent"] if x["parent"] in known else None, []).append(x)
    ids, rows, steps = [], [], []
    # a statement, what follows it, the loop around it and what follows that
    todo = [(x, nxt, END, END) for x, nxt in _followed(within.get(None, []), END)][::-1]
    while todo:
        x, after, loop, after_loop = todo.pop()
        node, kind, inner = x["node"], x["kind"], within.pop(x["node"], [])
        ids.append(node)
        rows.append(x)
        if kind in BRANCHES:
            yes, no = ([y for y in inner if (y["slot"] == "else") == other] for other in (False, True))
            steps.append([(yes[0]["node"] if yes else after, "TrueBranch"), (no[0]["node"] if no else after, "FalseBranch")])
            below = [(y, nxt, loop, after_loop) for part in (yes, no) for y, nxt in _followed(part, after)]
        elif kind in LOOPS:
            steps.append([(inner[0]["node"], "TrueBranch") if inner else (node, "LoopBack"), (after, "LoopExit")])
            below = [(y, nxt, node, after) for y, nxt in _followed(inner, node)]
        elif kind in LEAVES:
            stray = kind == "return_statement" or loop is None
            steps.append([] if stray else [(after_loop, "LoopExit") if kind == "break_statement" else (loop, "LoopBack")])
            below = []
        else:
            to = inner[0]["node"] if inner else after
            steps.append([(to, "LoopBack" if to is not None and to == loop else "Fallthrough")])
            below = [(y, nxt, loop, after_loop) for y, nxt in _followed(inner, after)]
        todo += below[::-1]
    return ids, rows, steps


def _followed(row: list[dict], after: int | None) -> list[tuple[dict, int | None]]:
    return list(zip(row, [*(y["node"] for y in row[1:]), after]))


def tree_flow(nodes: list[dict]) -> tuple[list[dict], list[dict]]:
    """Blocks and edges of one function from its sorted statements; see ``flows_of_trees``."""
    ids, rows, steps = _steps(nodes)
    turns = [r["kind"] in BRANCHES + LOOPS + LEAVES for r in rows]
    heads = {r["node"] for r in rows if r["kind"] in LOOPS} | set(ids[:1])
    for i, (node_steps, turn) in enumerate(zip(steps, turns)):
        following = ids[i + 1] if i + 1 < len(ids) else END
        heads |= {to for to, _ in node_steps if turn or to != following}
        if turn:
            heads.add(following)
    ends = any(turn and to is None for node_steps, turn in zip(steps, turns) for to, _ in node_steps)
    block_of, blocks, last = {}, [], []
    for i, node in enumerate(ids):
        if node in heads:
            block_of[node] = len(blocks)
            blocks.append({"statements": []})
            last.append(i)
        blocks[-1]["statements"].append(node)
        last[-1] = i
    if ends:
        block_of[END] = len(blocks)
        blocks.append({"statements": []})
    edges = []
    for k, block in enumerate(blocks):
        out = [(block_of[to], kind) for to, kind in steps[last[k]] if to in block_of] if k < len(last) else []
        edges += [{"src": k, "dst": dst, "edge_type": kind} for dst, kind in out]
        tag = "SwitchInt" if len(out) > 1 else "Goto" if out else "Return"
        block.update(
            kind="Entry" if k == 0 else "Normal" if out else "Exit", tag=tag, terminator={"SwitchInt": "conditional", "Goto": "goto", "Return": "return"}[tag],
            targets=[dst for dst, _ in out[:1]], otherwise=out[1][0] if len(out) > 1 else None,
        )
    return blocks, edges


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            blocks, edges = tree_flow(b.column("nodes")[k].as_py())
            yield pa.RecordBatch.from_arrays([b.column("function_id").slice(k, 1), pa.array([blocks], _BLOCKS), pa.array([edges], _EDGES)], ["function_id", "blocks", "edges"])


def flows_of_trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements (``function_id, node_id, parent_id, slot, place, kind``) -> blocks and edges of their functions.

    ``parent_id`` is the statement around it, null (or none of the function's) in the function's body; ``slot`` is ``else``
    in the second part of a branch; statements around the same one follow each other by ``place``, then ``node_id``. A
    block starts at the function's first statement, at every loop, at each place that a branch, a loop, a break or a
    continue leads to, and after each of these and after a return. Of a branch one edge goes to each part, or past it where
    that is empty; of a loop one into the body and one (LoopExit) past it; the body's end and ``continue`` go back to it
    (LoopBack), ``break`` past it (LoopExit). Statements inside a plain one follow it; those inside one that leaves are
    none. What leaves outside of any loop ends the function. Where a branch, a loop or a break goes past the function's last
    statement, a last block without statements stands for its end. What can't run has a block without edges that lead to it.

    Blocks have ``statements`` (their nodes) besides the usual fields. Null kinds, comments and marks are left out before
    statements follow each other; null places come first; rows of a repeated node_id count once (the first); statements
    that lie around each other in a circle are left out. A function without statements has no block.
    """
    rows = nodes.select("function_id", "node_id", F.struct(F.coalesce(F.col("place").cast("int"), F.lit(-(2**31))).alias("place"), F.col("node_id").cast("long").alias("node"), F.col("parent_id").cast("long").alias("parent"), F.col("slot").cast("string").alias("slot"), F.col("kind").cast("string").alias("kind")).alias("s"))
    rows = rows.where(F.col("s.kind").isNotNull() & ~F.col("s.kind").isin(*NO_STATEMENTS) & F.col("node_id").isNotNull())
    once = rows.groupBy("function_id", "node_id").agg(F.min("s").alias("s"))
    trees = once.groupBy("function_id").agg(F.sort_array(F.collect_list("s")).cast(_NODES).alias("nodes"))
    flows = trees.mapInArrow(_flows, _ROW)
    blocks = flows.select("function_id", F.posexplode("blocks").alias("block_id", "b")).select("function_id", "block_id", "b.*", F.lit(False).alias("has_target"), F.lit(False).alias("has_unwind"))
    names = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]
    return blocks.select(*names, "statements"), flows.select("function_id", F.inline("edges"))


#: Events of one function, and what they are in its tree: with statements inside, and without.
TREE_EVENTS = 24
_INNER = {"click": "if_statement", "signup": "while_statement", "purchase": "for_statement"}
_LEAF = {"click": "if_statement", "signup": "while_statement", "purchase": "return_statement"}


def event_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events as statement trees: event k lies in event k // 2 - 1 (the first two in none)."""
    ev = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    ev = ev.withColumn("rn", rn).select((F.col("user_id") * 100000 + F.floor(F.col("rn") / TREE_EVENTS)).cast("long").alias("function_id"), (F.col("rn") % TREE_EVENTS).cast("long").alias("node_id"), "event_id", "event_type")
    ev = ev.withColumn("n", F.count("*").over(W.partitionBy("function_id")))
    kind = lambda kinds: F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    left = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 1, "continue_statement").otherwise("break_statement"))
    full = F.col("node_id") * 2 + 2 < F.col("n")
    return ev.select(
        "function_id", "node_id", F.when(F.col("node_id") >= 2, F.floor(F.col("node_id") / 2) - 1).cast("long").alias("parent_id"), F.when(F.col("node_id") % 2 == 1, "else").otherwise("then").alias("slot"),
        F.col("node_id").cast("int").alias("place"), F.coalesce(F.when(full, kind(_INNER)).otherwise(F.coalesce(kind(_LEAF), left)), F.lit("expression_statement")).alias("kind"),
    )
