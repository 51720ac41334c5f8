"""Operators over control-flow graphs: every function is one row of arrays after a single exchange by function_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.functions import kernels as K
from graphloom.operators.calls import closure, reversed_calls
from graphloom.plans.limits import DEFAULT, Limits

KEY = "function_id"


# --- degrees and marks ------------------------------------------------------------------------------------------


def degrees(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, block_id, in_degree, out_degree; parallel edges count."""
    ends = edges.select(KEY, F.col("dst").alias("block_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(KEY, "src", F.lit(0), F.lit(1))).unionAll(blocks.select(KEY, "block_id", F.lit(0), F.lit(0)))
    return ends.groupBy(KEY, "block_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def exit_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("tag").isin("Return", "Unreachable", "Abort")).select(KEY, "block_id", "tag")


# --- one row per function ---------------------------------------------------------------------------------------


def held(df: DataFrame) -> DataFrame:
    """The same rows, with computed columns made once.

    Catalyst writes a column's expression wherever it is named once, also inside lambdas, which run it for every element;
    it doesn't look through a generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


_BLOCK = ("block_id", "kind", "tag", "has_unwind", "has_target")
_FIELDS = ("transform(b, x -> x.tag) as tags", "transform(b, x -> x.kind) as kinds", "transform(b, x -> x.has_unwind) as unwinds", "transform(b, x -> x.has_target) as calls")


def fold(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per function: n, tags, kinds, unwinds, calls, succ, pred, exits, reach. Parallel edges collapse.

    Blocks and edges are both dealt by function_id once; all that follows stays in the row.
    """
    b = blocks.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(*_BLOCK))).alias("b"))
    e = edges.groupBy(KEY).agg(F.collect_set(F.struct("src", "dst")).alias("e"))
    flow = b.join(e, KEY, "left").selectExpr(KEY, "b", "coalesce(e, cast(array() as array<struct<src:int,dst:int>>)) as e", "size(b) as n")
    flow = flow.selectExpr(KEY, "n", *_FIELDS, f"{X.adjacency('e', 'src', 'dst')} as succ", f"{X.adjacency('e', 'dst', 'src')} as pred")
    return _reached(flow)


def fold_stored(blocks: DataFrame) -> DataFrame:
    """As ``fold`` with the edges that stored terminators stand for: to the next block, from a conditional to two."""
    return fold_arrays(blocks.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(*_BLOCK, "terminator"))).alias("b")))


def fold_arrays(flow: DataFrame, walks_only: bool = False) -> DataFrame:
    """As ``fold_stored`` where each function's blocks are one array ``b`` already; ``walks_only``: without pred and reach."""
    flow = flow.selectExpr(KEY, "b", "size(b) as n")
    steps = "case when b[{0}].terminator = 'conditional' then 2 when b[{0}].terminator in ('fallthrough', 'goto', 'call') then 1 else 0 end"
    succ = f"transform(b, (x, i) -> filter(array(i + 1, i + 2), j -> j < n and j - i <= {steps.format('i')}))"
    pred = f"transform(b, (x, i) -> filter(array(i - 2, i - 1), j -> j >= 0 and i - j <= {steps.format('j')}))"
    if walks_only:
        return held(held(flow.selectExpr(KEY, "n", *_FIELDS, f"{succ} as succ")).withColumn("exits", F.expr(X.EXITS)))
    return _reached(flow.selectExpr(KEY, "n", *_FIELDS, f"{succ} as succ", f"{pred} as pred"))


def _reached(flow: DataFrame) -> DataFrame:
    return held(held(flow).withColumn("exits", F.expr(X.EXITS)).withColumn("reach", F.expr(X.REACH)))


def with_dominators(flow: DataFrame) -> DataFrame:
    """Adds dom: the dominator tree from block 0 (``kernels.TREE``)."""
    return K.with_tree(flow, "dom", None, "succ", "pred")


def with_post_dominators(flow: DataFrame) -> DataFrame:
    """Adds root (the first exit; functions without one go) and pdom, the tree from there over turned edges."""
    return K.with_tree(flow.where("size(exits) > 0").withColumn("root", F.expr("exits[0]")), "pdom", "root", "pred", "succ")


def with_headers(flow: DataFrame) -> DataFrame:
    """Adds back (edges to a dominator) and headers."""
    return held(held(with_dominators(flow).withColumn("back", F.expr(X.BACK_EDGES))).withColumn("headers", F.expr("array_sort(array_distinct(transform(back, e -> e.header)))")))


# --- reachability -----------------------------------------------------------------------------------------------


def reachable(flow: DataFrame) -> DataFrame:
    return flow.select(KEY, F.explode("reach").alias("block_id"))


def unreachable(flow: DataFrame) -> DataFrame:
    return flow.select(KEY, F.explode(F.expr("array_except(sequence(0, n - 1), reach)")).alias("block_id"))


def reach_pairs(flow: DataFrame) -> DataFrame:
    """function_id, src, dst for every block that another (or itself) can reach, reflexively."""
    each = flow.select(KEY, "n", "succ", F.explode(F.expr("sequence(0, n - 1)")).alias("src"))
    return each.select(KEY, "src", F.explode(F.expr(X.closure("succ", "array(src)", "array(src)"))).alias("dst"))


def block_impact(flow: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Per block: reached others, deepest level visited, and whether flow reconverges (an edge met a seen block)."""
    each = flow.select(KEY, "n", "succ", F.explode(F.expr("sequence(0, n - 1)")).alias("block_id"))
    limit = f"i <= {max_depth}" if max_depth is not None else "true"
    found = "array_except(array_distinct(flatten(transform(s.new, x -> succ[x]))), s.seen)"
    step = X.let("f", found, "named_struct('seen', concat(s.seen, f), 'new', f, 'depth', if(size(f) > 0, i, s.depth), 'walked', s.walked + aggregate(s.new, 0, (a, x) -> a + size(succ[x])))")
    bfs = f"aggregate(sequence(1, n + 1), named_struct('seen', array(block_id), 'new', array(block_id), 'depth', 0, 'walked', 0), (s, i) -> if(size(s.new) = 0 or not ({limit}), s, {step}))"
    return held(each.withColumn("s", F.expr(bfs))).selectExpr(KEY, "block_id", "array_sort(array_except(s.seen, array(block_id))) as reached", "s.depth as depth", "s.walked > size(s.seen) - 1 as reconverges")


def path_impact(paths: DataFrame, flow: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Per path: blocks that its blocks can reach (within ``max_depth`` steps) and that aren't on it, sorted.

    Blocks of a stored path that the function no longer has lead nowhere.
    """
    both = held(paths.select(KEY, "path_id", "blocks").join(flow.select(KEY, "n", "succ"), KEY).withColumn("own", F.expr("filter(blocks, x -> x < n)")))
    return both.withColumn("affected", F.expr(f"array_except({X.closure('succ', 'own', 'own', max_depth)}, blocks)")).select(KEY, "path_id", "blocks", "affected")


def blast_zone(flow: DataFrame, calls: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``function_id, block_id, affected`` (blocks, sorted), ``depth, callees, callers`` for each target block.

    ``calls`` are (caller, callee) function ids; callees and callers count the functions reached and reaching, without
    the target itself. Targets that no function has are left out.
    """
    own = block_impact(flow.join(targets.select(KEY).distinct(), KEY, "left_semi"), max_depth).join(targets.select(KEY, "block_id").distinct(), [KEY, "block_id"], "left_semi")
    rows = _with_call_counts(own, calls)
    return rows.select(KEY, "block_id", F.col("reached").alias("affected"), "depth", "callees", "callers")


def blast_zone_of_paths(paths: DataFrame, flow: DataFrame, calls: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``function_id, path_id, blocks, affected, callees, callers`` for each path: as ``path_impact`` and ``blast_zone``."""
    return _with_call_counts(path_impact(paths, flow, max_depth), calls)


def _with_call_counts(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Adds ``callees`` and ``callers``: how many other functions the row's function reaches by calls, and is reached by."""
    seeds = rows.select(F.col(KEY).alias("start")).distinct()
    for c, name in ((calls, "callees"), (reversed_calls(calls), "callers")):
        counts = closure(c, seeds).where("node != start").groupBy(F.col("start").alias(KEY)).agg(F.count("*").alias(name))
        rows = rows.join(counts, KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


# --- dominance --------------------------------------------------------------------------------------------------


def dominator_pairs(dominated: DataFrame, column: str = "dom") -> DataFrame:
    """function_id, dominator, block_id, depth (of the block) for reached blocks, reflexive pairs included."""
    rows = dominated.select(KEY, F.col(column).alias("t"), F.explode(f"{column}.order").alias("dominator"))
    rows = rows.select(KEY, "t.depth", "dominator", F.explode(F.expr("slice(t.order, t.enter[dominator], t.size[dominator])")).alias("block_id"))
    return rows.select(KEY, "dominator", "block_id", F.expr("depth[block_id]").alias("depth"))


def immediate_dominators(dominated: DataFrame, column: str = "dom") -> DataFrame:
    """function_id, block_id, idom (null for the root and for unreached blocks), depth (null for these)."""
    rows = dominated.select(KEY, F.posexplode(F.arrays_zip(f"{column}.idom", f"{column}.depth")).alias("block_id", "x"))
    return rows.select(KEY, "block_id", F.expr("nullif(x.idom, -1)").alias("idom"), F.expr("nullif(x.depth, -1)").alias("depth"))


def dominator_chains(dominated: DataFrame, column: str = "dom") -> DataFrame:
    """function_id, block_id, chain: the block, its immediate dominator, and so on to the root, for reached blocks."""
    rows = dominated.select(KEY, F.col(column).alias("t"), F.explode(f"{column}.order").alias("block_id"))
    return rows.select(KEY, "block_id", F.expr(f"reverse({X.ancestors('t', 'block_id')})").alias("chain"))


def dominates(dominated: DataFrame, column: str = "dom") -> DataFrame:
    """function_id, dominator, block_id: the relation, reflexive also on blocks that aren't reached."""
    rows = dominated.select(KEY, F.col(column).alias("t"), F.posexplode(f"{column}.enter").alias("dominator", "enter"))
    return rows.select(KEY, "dominator", F.explode(F.expr("if(enter = 0, array(dominator), slice(t.order, greatest(enter, 1), t.size[dominator]))")).alias("block_id"))


def common_dominators(dominated: DataFrame, column: str = "dom") -> DataFrame:
    """function_id, a, b (a < b, both reached) and their nearest common dominator (post-dominator)."""
    rows = dominated.select(KEY, F.col(column).alias("t"), F.explode(f"{column}.order").alias("a")).withColumn("above", F.expr(X.ancestors("t", "a")))
    pairs = rows.select(KEY, "t", "a", "above", F.explode(F.expr("filter(t.order, x -> x > a)")).alias("b"))
    return pairs.select(KEY, "a", "b", F.expr(f"aggregate(above, -1, (m, x) -> if({X.dominated('t', 'x', 'b')}, x, m))").alias("common"))


def frontiers(dominated: DataFrame, column: str = "dom", before: str = "pred") -> DataFrame:
    """function_id, node, frontier: v such that node dominates one of v's predecessors (``before``) but not strictly v."""
    each = dominated.select(KEY, F.col(before).alias("pred"), F.col(column).alias("t"), F.posexplode(f"{column}.idom").alias("frontier", "idom"))
    each = each.select(KEY, "t", "frontier", "idom", F.explode(F.expr("pred[frontier]")).alias("p")).where("p != idom")
    # below v's immediate dominator; an unreachable block only dominates itself
    nodes = f"if(t.enter[p] = 0, array(p), filter({X.ancestors('t', 'p')}, x -> t.depth[x] > if(idom < 0, -1, t.depth[idom])))"
    return each.select(KEY, F.explode(F.expr(nodes)).alias("node"), "frontier").distinct()


def control_dependences(post: DataFrame) -> DataFrame:
    """function_id, block_id, controls: the branching blocks that decide whether a block is run (``with_post_dominators``).

    From such a block one way leads to the exit by the block for sure, another need not. A block may control itself.
    """
    return frontiers(post, "pdom", "succ").select(KEY, F.col("node").alias("block_id"), F.col("frontier").alias("controls"))


def control_slices(post: DataFrame) -> DataFrame:
    """function_id, block_id, n_direct, n_all: how many blocks decide, directly and by way of others, whether a block is run."""
    sets = control_dependences(post).groupBy(KEY).agg(F.collect_list(F.struct("block_id", "controls")).alias("f"))
    rows = held(post.select(KEY, "n").join(sets, KEY).withColumn("up", F.expr(X.adjacency("f", "block_id", "controls"))))
    each = rows.select(KEY, "n", "up", F.explode(F.expr("sequence(0, n - 1)")).alias("block_id")).where("size(up[block_id]) > 0")
    return each.select(KEY, "block_id", F.expr("size(up[block_id])").alias("n_direct"), F.size(F.expr(X.closure("up", "up[block_id]", "up[block_id]"))).alias("n_all"))


def _frontier_rows(dominated: DataFrame) -> DataFrame:
    sets = frontiers(dominated).groupBy(KEY).agg(F.collect_list(F.struct("node", "frontier")).alias("f"))
    return held(dominated.select(KEY, "n").join(sets, KEY).withColumn("succ", F.expr(X.adjacency("f", "node", "frontier"))))


def iterated_frontier_of(dominated: DataFrame, nodes: DataFrame) -> DataFrame:
    """function_id, frontier: the closure of the frontier relation from a set of ``nodes`` (function_id, block_id)."""
    sets = nodes.groupBy(KEY).agg(F.sort_array(F.collect_set("block_id")).alias("s"))
    rows = held(_frontier_rows(dominated).join(sets, KEY).withColumn("first", F.expr("array_distinct(flatten(transform(filter(s, x -> x between 0 and n - 1), x -> succ[x])))")))
    return rows.select(KEY, F.explode(F.expr(X.closure("succ", "first", "first"))).alias("frontier"))


def iterated_frontiers(dominated: DataFrame) -> DataFrame:
    """function_id, node, frontier: the closure of the frontier relation from each single node."""
    rows = _frontier_rows(dominated)
    each = rows.select(KEY, "n", "succ", F.explode(F.expr("sequence(0, n - 1)")).alias("node"))
    return each.select(KEY, "node", F.explode(F.expr(X.closure("succ", "succ[node]", "succ[node]"))).alias("frontier"))


# --- loops ------------------------------------------------------------------------------------------------------


_BODY = X.closure("pred", "if(e.tail = e.header, array(e.header), array(e.header, e.tail))", f"if(e.tail = e.header, {X.EMPTY}, array(e.tail))")


def with_bodies(headed: DataFrame) -> DataFrame:
    """Adds bodies: the blocks of each natural loop, in the order of ``back``."""
    return headed.withColumn("bodies", F.expr(f"transform(back, e -> {_BODY})"))


def natural_loops(headed: DataFrame) -> DataFrame:
    """function_id, header, tail, body, nesting_level: a loop per back edge; level 0 is outermost."""
    loops = headed.where("size(back) > 0").withColumn("loops", F.expr(f"transform(back, e -> named_struct('header', e.header, 'tail', e.tail, 'body', {_BODY}))"))
    outer = "filter(sequence(0, size(loops) - 1), j -> loops[j].header != l.header and array_contains(loops[j].body, l.header))"
    level = f"aggregate(sequence(1, size(loops)), transform(loops, l -> 0), (v, r) -> transform(loops, l -> coalesce(array_max(transform({outer}, j -> v[j])) + 1, 0)))"
    rows = held(held(loops.select(KEY, "loops")).withColumn("levels", F.expr(level))).select(KEY, "levels", F.posexplode("loops").alias("k", "l"))
    return rows.selectExpr(KEY, "l.header as header", "l.tail as tail", "l.body as body", "levels[k] as nesting_level")


def loops_of_blocks(loops: DataFrame) -> DataFrame:
    """function_id, block_id, header, tail: every loop that contains a block."""
    return loops.select(KEY, F.explode("body").alias("block_id"), "header", "tail")


def loop_forest(headed: DataFrame) -> DataFrame:
    """function_id, header, parent (null: outermost), nesting_level, blocks, irreducible: how a function's loops lie in each
    other, loops of one header as one, without unreached blocks; irreducible: there are cycles with several entries, which are no loops."""
    rows = K.with_forest(headed.where("size(back) > 0")).select(KEY, F.col("forest").alias("t"), F.explode("headers").alias("header"))
    return rows.select(KEY, "header", F.expr("nullif(t.outer[header], -1)").alias("parent"), F.expr("t.level[header]").alias("nesting_level"), F.expr("t.size[header]").alias("blocks"), "t.irreducible")


def nested_loops(loops: DataFrame) -> DataFrame:
    """Pairs of loops of which the first's body has the second's header; loops are ordered by tail, then header."""
    a = loops.select(KEY, F.col("header").alias("outer_header"), F.col("tail").alias("outer_tail"), "body")
    b = loops.select(KEY, F.col("header").alias("inner_header"), F.col("tail").alias("inner_tail"))
    later = "struct(outer_tail, outer_header) < struct(inner_tail, inner_header) and array_contains(body, inner_header)"
    return a.join(b, KEY).where(later).drop("body")


# --- paths ------------------------------------------------------------------------------------------------------


def enumerate_paths(headed: DataFrame, limits: Limits = DEFAULT, dead_ends: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """function_id, path_id, path_kind, blocks: bounded paths of all functions; past max_paths the first in block order.

    Walks are found in order and handed on in rows of a bounded size (``kernels.walks``). Each path takes along the columns of
    its function that are named in ``also``, so that what follows needn't fold the functions again.
    """
    keep = list(dict.fromkeys([KEY, "tags", "kinds", "unwinds", *also]))
    rows = K.all_walks(headed.select(*keep, "succ", "exits", "headers"), limits, dead_ends, keep).select(*keep, F.explode("paths").alias("blocks"))
    return rows.selectExpr(KEY, f"{X.PATH_ID} as path_id", f"{X.WALK_KIND} as path_kind", "blocks", *also)


#: What the paths must have taken along where no flow is given to ``feasible_paths``.
FEASIBLE_BY = ("tags", "kinds", "unwinds", "calls", "reach")


def feasible_paths(paths: DataFrame, flow: DataFrame | None) -> DataFrame:
    """function_id, path_id, blocks, feasible: whether a path can be run to its end (statically, by what its blocks are)."""
    both = paths if flow is None else paths.select(KEY, "path_id", "blocks").join(flow.select(KEY, *FEASIBLE_BY), KEY)
    return both.withColumn("feasible", F.expr(X.FEASIBLE)).select(KEY, "path_id", "blocks", "feasible")


def classify_paths(paths: DataFrame, flow: DataFrame) -> DataFrame:
    """function_id, path_id, blocks, path_kind of *given* paths, such as stored ones, by what their functions are now.

    The first block that says so decides: one that isn't there (Degenerate) or isn't reached (Unreachable), an abort or a
    call that may unwind (Error), an unreachable end (Degenerate). Else a path that ends in a return is Normal, others, and
    empty ones, are Degenerate. Paths of functions that are gone are Degenerate too.
    """
    both = paths.select(KEY, "path_id", "blocks").join(flow.select(KEY, "n", "tags", "unwinds", "reach"), KEY, "left")
    return both.select(KEY, "path_id", "blocks", F.expr(X.GIVEN_KIND).alias("path_kind"))


def path_ranges(paths: DataFrame, blocks: DataFrame) -> DataFrame:
    """function_id, path_id, start_line, end_line: from the first block's first line to the last block's last."""
    lines = blocks.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("block_id", "start_line", "end_line"))).alias("b"))
    return paths.select(KEY, "path_id", "blocks").join(lines, KEY).selectExpr(KEY, "path_id", "b[blocks[0]].start_line as start_line", "b[element_at(blocks, -1)].end_line as end_line")


def without_loops(flow: DataFrame) -> DataFrame:
    """For graphs known to be acyclic: no headers, without looking for them."""
    return flow.withColumn("headers", F.expr(X.EMPTY))


def estimate_paths(headed: DataFrame, unroll: int = 3) -> DataFrame:
    """function_id, branches, loops, estimate: 2**branches * (unroll+1)**loops, capped at half of the largest long."""
    b = "aggregate(filter(sequence(0, n - 1), x -> size(succ[x]) > 1 and not array_contains(headers, x)), 0, (a, x) -> a + size(succ[x]) - 1)"
    rows = headed.selectExpr(KEY, f"{b} as branches", "size(headers) as loops")
    cap = 2**62
    # exact while both powers are small; past that the product only says that it is too much
    value = f"case when branches >= 31 or loops >= 31 or branches * log2(2D) + loops * log2({unroll + 1}D) >= 62 then {cap}L else cast(round(pow(2D, branches)) as long) * cast(round(pow({unroll + 1}D, loops)) as long) end"
    return rows.withColumn("estimate", F.expr(value))


def explosion(headed: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return estimate_paths(headed, limits.loop_unroll).where(F.col("estimate") > limits.max_paths).select(KEY, "estimate")


def verify_paths(cached: DataFrame, current: DataFrame) -> DataFrame:
    """function_id, path_id, valid: whether a stored path is still among the current ones."""
    now = current.select(KEY, "path_id").distinct().withColumn("valid", F.lit(True))
    return cached.select(KEY, "path_id").join(now, [KEY, "path_id"], "left").select(KEY, "path_id", F.coalesce("valid", F.lit(False)).alias("valid"))


# --- patterns ---------------------------------------------------------------------------------------------------


def merge_points(edges: DataFrame) -> DataFrame:
    """function_id, a, b, merge: largest common direct successor of a block's two successors, neither of them itself."""
    step = edges.select(KEY, "src", "dst").distinct()
    two = step.groupBy(KEY, "src").agg(F.sort_array(F.collect_list("dst")).alias("to")).where("size(to) = 2").selectExpr(KEY, "src as block_id", "to[0] as a", "to[1] as b")
    sa, sb = step.select(KEY, F.col("src").alias("a"), F.col("dst").alias("merge")), step.select(KEY, F.col("src").alias("b"), F.col("dst").alias("merge"))
    met = two.join(sa, [KEY, "a"]).join(sb, [KEY, "b", "merge"]).where("merge != a and merge != b").groupBy(KEY, "block_id").agg(F.max("merge").alias("merge"))
    return two.join(met, [KEY, "block_id"], "left")


def if_else_patterns(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, condition, true_branch, false_branch, merge_point, has_else for blocks of exactly two successors."""
    arms = edges.groupBy(KEY, F.col("src").alias("block_id")).agg(F.max(F.when(F.col("edge_type") == "TrueBranch", F.col("dst"))).alias("t"), F.max(F.when(F.col("edge_type") == "FalseBranch", F.col("dst"))).alias("f"))
    switch = blocks.where("not (tag = 'SwitchInt' and size(targets) > 1)").select(KEY, "block_id")
    rows = merge_points(edges).join(switch, [KEY, "block_id"], "left_semi").join(arms, [KEY, "block_id"])
    return rows.select(KEY, F.col("block_id").alias("condition"), F.coalesce("t", "a").alias("true_branch"), F.coalesce("f", "b").alias("false_branch"), F.col("merge").alias("merge_point"), F.col("merge").isNotNull().alias("has_else"))


def match_patterns(blocks: DataFrame) -> DataFrame:
    """function_id, switch, targets, otherwise, branch_count for switches of two targets or more."""
    return blocks.where("tag = 'SwitchInt' and size(targets) >= 2 and otherwise is not null").select(KEY, F.col("block_id").alias("switch"), "targets", "otherwise", (F.size("targets") + 1).alias("branch_count"))


def branch_patterns(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, block_id, pattern, branches: if/else and match patterns together."""
    either = if_else_patterns(blocks, edges).select(KEY, F.col("condition").alias("block_id"), F.lit("IfElse").alias("pattern"), F.lit(2).alias("branches"))
    return either.unionByName(match_patterns(blocks).select(KEY, F.col("switch").alias("block_id"), F.lit("Match").alias("pattern"), F.col("branch_count").alias("branches")))


def branch_types(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.select(KEY, F.col("src").alias("block_id"), "dst").distinct().groupBy(KEY, "block_id").agg(F.count("*").alias("o"))
    rows = blocks.select(KEY, "block_id", "tag").join(out, [KEY, "block_id"], "left").join(merge_points(edges).select(KEY, "block_id", "merge"), [KEY, "block_id"], "left")
    kind = F.when(F.coalesce("o", F.lit(0)) <= 1, "Linear").when(F.col("o") == 2, F.when(F.col("merge").isNotNull(), "Conditional").otherwise("Unknown")).when(F.col("tag") == "SwitchInt", "MultiWay").otherwise("Unknown")
    return rows.select(KEY, "block_id", kind.alias("branch_type"))


# --- ranking, summaries, exports --------------------------------------------------------------------------------


def hot_paths(paths: DataFrame, headed: DataFrame | None, loops: DataFrame | None, top: int = 10, min_score: float | None = None) -> DataFrame:
    """function_id, rank, path_id, blocks, score, reasons: loop depth doubles, the entry's visits add half each, early
    returns halve; each that counts is among the reasons. Without ``headed`` the paths must have taken ``tags`` along, and
    for loops, without ``loops``, ``bodies``."""
    rows = (paths if headed is None else paths.join(headed.select(KEY, "tags"), KEY)).withColumn("mean", F.floor(F.avg(F.size("blocks")).over(W.partitionBy(KEY))))
    if loops is not None:
        rows = rows.join(loops.groupBy(KEY).agg(F.collect_list("body").alias("bodies")), KEY, "left")
    if "bodies" not in rows.columns:
        rows = rows.withColumn("depth", F.lit(0))
    else:
        rows = rows.withColumn("depth", F.expr("coalesce(array_max(transform(blocks, b -> size(filter(bodies, y -> array_contains(y, b))))), 0)"))
    early = "tags[element_at(blocks, -1)] = 'Return' and size(blocks) < mean and size(blocks) > 1"
    score = F.expr(f"pow(2D, depth) * (1 + 0.5D * size(filter(blocks, b -> b = 0))) * if({early}, 0.5D, 1D)")
    reasons = F.expr(f"array_compact(array(if(depth > 0, concat('in ', depth, ' loops'), null), concat('entry ', size(filter(blocks, b -> b = 0)), ' times'), if({early}, 'returns early', null)))")
    ranked = rows.withColumn("score", score).withColumn("reasons", reasons).withColumn("rank", F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("score"), "blocks")))
    out = ranked.where(F.col("rank") <= top).select(KEY, "rank", "path_id", "blocks", "score", "reasons")
    return out if min_score is None else out.where(F.col("score") >= min_score)


def hotspots(paths: DataFrame, flow: DataFrame, top: int = 20, min_paths: int = 1) -> DataFrame:
    """The riskiest functions: half a point per path, a tenth per block."""
    counts = paths.groupBy(KEY).agg(F.count("*").alias("path_count"))
    return _riskiest(flow.select(KEY, F.col("n").alias("complexity")).join(counts, KEY), top, min_paths)


def hotspots_of_flow(flow: DataFrame, limits: Limits, top: int = 20, min_paths: int = 1) -> DataFrame:
    """As ``hotspots`` of the paths that end in exits, which are counted where they are found."""
    found = K.all_walks(flow.select(KEY, "n", "succ", "exits", "headers"), limits, False, [KEY, "n"])
    counts = found.groupBy(KEY, F.col("n").alias("complexity")).agg(F.sum(F.size("paths")).alias("path_count"))
    return _riskiest(counts, top, min_paths)


def _riskiest(rows: DataFrame, top: int, min_paths: int) -> DataFrame:
    rows = rows.where(F.col("path_count") >= min_paths)
    risk = F.round(F.col("path_count") * 0.5 + F.col("complexity") * 0.1, 6)
    return rows.select(KEY, "path_count", "complexity", risk.alias("risk")).orderBy(F.desc("risk"), KEY).limit(top)


def summaries(paths: DataFrame) -> DataFrame:
    """Paths as arrows; over five blocks, the first and last two around how many lie between."""
    short = f"if(size(blocks) <= 5, {X.ARROWS}, concat(blocks[0], '->', blocks[1], '->...(', size(blocks) - 4, ')...->', element_at(blocks, -2), '->', element_at(blocks, -1)))"
    return paths.selectExpr(KEY, "path_id", f"{short} as summary", "size(blocks) as length")


def tell_paths(paths: DataFrame, described: DataFrame) -> DataFrame:
    """function_id, path_id, story: what the path's blocks do (``describe_blocks``), past five the first and last, and how it ends."""
    texts = described.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("block_id", "description"))).alias("t"))
    rows = paths.select(KEY, "path_id", "path_kind", "blocks").join(texts, KEY)
    short = "if(size(blocks) <= 5, array_join(transform(blocks, b -> t[b].description), ', then '), concat(t[blocks[0]].description, ', then ', size(blocks) - 2, ' more, then ', t[element_at(blocks, -1)].description))"
    end = "case path_kind when 'Normal' then '' when 'Error' then ', an error' when 'Degenerate' then ', a dead end' else ', never reached' end"
    return rows.selectExpr(KEY, "path_id", f"concat({short}, {end}) as story")


def report_functions(headed: DataFrame) -> DataFrame:
    """function_id, blocks, entry, exits, loops."""
    return headed.selectExpr(KEY, "n as blocks", "0 as entry", "size(exits) as exits", "size(back) as loops")


def describe_blocks(blocks: DataFrame) -> DataFrame:
    """function_id, block_id, description: what each block does when it ends."""
    text = (
        F.when(F.col("tag") == "Goto", F.concat(F.lit("continues"), F.when(F.size("targets") > 0, F.concat(F.lit(" at "), F.col("targets")[0].cast("string"))).otherwise(F.lit(""))))
        .when(F.col("tag") == "SwitchInt", F.concat(F.lit("chooses among "), (F.size("targets") + 1).cast("string")))
        .when(F.col("tag") == "Call", F.lit("calls"))
        .when(F.col("tag") == "Return", F.lit("returns"))
        .when(F.col("tag") == "Abort", F.concat(F.lit("aborts: "), F.coalesce("terminator", F.lit("?"))))
        .otherwise(F.lit("is never left"))
    )
    return blocks.select(KEY, "block_id", F.concat(F.lower("kind"), F.lit(" block "), text).alias("description"))


def describe_functions(flow: DataFrame) -> DataFrame:
    """function_id, description: a line per function."""
    return flow.selectExpr(KEY, "concat('function ', function_id, ': ', n, ' blocks, ', size(exits), ' exits, ', aggregate(succ, 0, (a, x) -> a + size(x)), ' edges, ', n - size(reach), ' unreachable') as description")


def export_dot(blocks: DataFrame, edges: DataFrame, colours: bool = False) -> DataFrame:
    """function_id, dot: a Graphviz graph per function, with ``colours`` by kinds of blocks and edges."""
    nodes = blocks.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("block_id", "kind", "tag"))).alias("b"))
    lines = edges.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "edge_type"))).alias("e"))
    fill = "case x.kind when 'Entry' then ' style=filled fillcolor=lightgreen' when 'Exit' then ' style=filled fillcolor=lightcoral' else '' end" if colours else "''"
    dashed = "if(x.edge_type = 'Fallthrough', ' style=dashed', '')"
    line = f"concat({dashed}, ' color=', coalesce(element_at({X.EDGE_COLOURS}, x.edge_type), 'black'))" if colours else dashed
    text = f"concat('digraph {{', array_join(transform(b, x -> concat(' n', x.block_id, ' [label=\"', x.kind, ' ', x.tag, '\"', {fill}, '];')), ''), coalesce(array_join(transform(e, x -> concat(' n', x.src, ' -> n', x.dst, ' [label=\"', x.edge_type, '\"', {line}, '];')), ''), ''), ' }}')"
    return nodes.join(lines, KEY, "left").selectExpr(KEY, f"{text} as dot")


def export_json(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, json: entry, exits, blocks and edges of each function."""
    nodes = blocks.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("block_id", "kind", "tag"))).alias("blocks"))
    lines = edges.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "edge_type"))).alias("edges"))
    rows = nodes.join(lines, KEY, "left").withColumn("exits", F.expr("transform(filter(blocks, x -> x.tag in ('Return', 'Unreachable', 'Abort')), x -> x.block_id)"))
    return rows.select(KEY, F.to_json(F.struct(F.lit(0).alias("entry"), "exits", "blocks", "edges")).alias("json"))
