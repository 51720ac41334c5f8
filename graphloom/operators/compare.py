"""Snapshots side by side: block and edge differences, path caches, and the supergraph over calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import cut

KEY = "function_id"


def diff_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """``function_id, block_id, change``: Added, Deleted or Terminator; a changed kind alone is none."""
    a = before.select(KEY, "block_id", F.coalesce("terminator", F.lit("")).alias("t1"))
    b = after.select(KEY, "block_id", F.coalesce("terminator", F.lit("")).alias("t2"))
    both = a.join(b, [KEY, "block_id"], "full_outer")
    return both.select(KEY, "block_id", F.when(F.col("t1").isNull(), "Added").when(F.col("t2").isNull(), "Deleted").when(F.col("t1") != F.col("t2"), "Terminator").alias("change")).where("change is not null")


def diff_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """As ``diff_blocks`` for blocks with lines: also Location where these alone changed, Both where the terminator did too."""
    a = before.select(KEY, "block_id", F.coalesce("terminator", F.lit("")).alias("t1"), F.struct("start_line", "end_line").alias("l1"))
    b = after.select(KEY, "block_id", F.coalesce("terminator", F.lit("")).alias("t2"), F.struct("start_line", "end_line").alias("l2"))
    both = a.join(b, [KEY, "block_id"], "full_outer")
    term, place = F.col("t1") != F.col("t2"), ~F.col("l1").eqNullSafe(F.col("l2"))
    change = F.when(F.col("t1").isNull(), "Added").when(F.col("t2").isNull(), "Deleted").when(term & place, "Both").when(term, "Terminator").when(place, "Location")
    return both.select(KEY, "block_id", change.alias("change")).where("change is not null")


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """``function_id, src, dst, edge_type, change``: edges as sets, both ways."""
    cols = [KEY, "src", "dst", "edge_type"]
    a, b = before.select(*cols).distinct(), after.select(*cols).distinct()
    return b.join(a, cols, "left_anti").withColumn("change", F.lit("Added")).unionByName(a.join(b, cols, "left_anti").withColumn("change", F.lit("Deleted")))


def similarity(before: DataFrame, after: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``function_id, changes, similarity``: 1 without changes, else what twice the old blocks leave of them."""
    changes = blocks.select(KEY).unionAll(edges.select(KEY)).groupBy(KEY).agg(F.count("*").alias("changes"))
    sizes = before.groupBy(KEY).agg(F.count("*").alias("old"))
    ids = before.select(KEY).union(after.select(KEY)).distinct()
    rows = ids.join(changes, KEY, "left").join(sizes, KEY, "left").select(KEY, F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("old", F.lit(0)).alias("old"))
    value = F.when(F.col("changes") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("changes") / (2.0 * F.greatest(F.lit(1), F.col("old")))))
    return rows.select(KEY, F.col("changes").cast("long").alias("changes"), F.round(value, 6).alias("similarity"))


def content_hashes(blocks: DataFrame) -> DataFrame:
    """``function_id, content_hash`` over kinds and terminators in block order: the key of the path cache."""
    rows = blocks.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("block_id", "kind", "tag", F.coalesce("terminator", F.lit("")).alias("t")))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["block_id"].cast("string"), x["kind"], x["tag"], x["t"])), ",")
    return rows.select(KEY, F.sha2(text, 256).alias("content_hash"))


def changed_functions(old_hashes: DataFrame, new_hashes: DataFrame) -> DataFrame:
    """``function_id`` of functions that are new or whose content differs from the cached one."""
    return new_hashes.join(old_hashes, [KEY, "content_hash"], "left_anti").select(KEY)


def path_elements(paths: DataFrame) -> DataFrame:
    """The cache's element rows: ``function_id, path_id, path_kind, sequence_order, block_id``."""
    return paths.select(KEY, "path_id", "path_kind", F.posexplode("blocks").alias("sequence_order", "block_id"))


def cached_paths(elements: DataFrame) -> DataFrame:
    """Element rows -> ``function_id, path_id, path_kind, entry, exit, blocks`` in order."""
    rows = elements.groupBy(KEY, "path_id", "path_kind").agg(F.sort_array(F.collect_list(F.struct("sequence_order", "block_id"))).alias("e"))
    rows = rows.select(KEY, "path_id", "path_kind", F.transform("e", lambda x: x["block_id"]).alias("blocks"))
    return rows.select(KEY, "path_id", "path_kind", F.col("blocks")[0].alias("entry"), F.element_at("blocks", -1).alias("exit"), "blocks")


def called_within(calls: DataFrame, entries: DataFrame, depth: int = 3) -> DataFrame:
    """``function_id`` of all functions within ``depth`` calls of the entries, written."""
    found = entries.select(KEY).distinct()
    for _ in range(depth):
        step = calls.join(found.withColumnRenamed(KEY, "caller"), "caller").select(F.col("callee").alias(KEY))
        found = found.union(step).distinct()
    return cut(found, "found")


def icfg(blocks: DataFrame, edges: DataFrame, calls: DataFrame, entries: DataFrame, depth: int = 3, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the supergraph of all functions within ``depth`` calls of the entries (``function_id``).

    Every function gets an entry (-1) and an exit (-2) node. Each call block leads to every callee inside the depth, and
    those callees' exits back to the block after it. Where ``found`` (``called_within``) is given, blocks and edges are those of
    these functions alone.
    """
    if whole := found is None:
        found = called_within(calls, entries, depth)
    own = blocks.join(found, KEY, "left_semi") if whole else blocks
    marks = own.select(KEY).distinct().select(KEY, F.inline(F.array(F.struct(F.lit(-1).alias("block_id"), F.lit("Entry").alias("node_type")), F.struct(F.lit(-2).alias("block_id"), F.lit("Exit").alias("node_type")))))
    nodes = own.select(KEY, "block_id", F.when(F.col("tag") == "Call", "CallSite").otherwise("Block").alias("node_type")).unionByName(marks)

    def edge(df, a, b, c, d, kind):
        return df.select(F.expr(a).alias("src_function"), F.expr(b).cast("int").alias("src_block"), F.expr(c).alias("dst_function"), F.expr(d).cast("int").alias("dst_block"), F.lit(kind).alias("edge_kind"))

    intra = edges.join(found, KEY, "left_semi") if whole else edges
    pairs = calls.join(found.withColumnRenamed(KEY, "caller"), "caller", "left_semi").join(found.withColumnRenamed(KEY, "callee"), "callee", "left_semi")
    sites = own.where("tag = 'Call'").select(F.col(KEY).alias("caller"), "block_id").join(pairs, "caller")
    callees = own.select(F.col(KEY).alias("callee")).distinct()
    sites = sites.join(callees, "callee", "left_semi")
    back = sites.join(intra.select(F.col(KEY).alias("caller"), F.col("src").alias("block_id"), "dst"), ["caller", "block_id"])
    all_ = (
        edge(own.where("block_id = 0"), KEY, "-1", KEY, "0", "Enter")
        .unionByName(edge(intra, KEY, "src", KEY, "dst", "Intra"))
        .unionByName(edge(own.where("tag in ('Return', 'Unreachable', 'Abort')"), KEY, "block_id", KEY, "-2", "Leave"))
        .unionByName(edge(sites, "caller", "block_id", "callee", "-1", "Call"))
        .unionByName(edge(back, "callee", "-2", "caller", "dst", "Return"))
    )
    return nodes, all_


def icfg_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``item, n``: nodes and edges of each kind, and functions."""
    kinds = nodes.groupBy(F.concat(F.lit("node "), "node_type").alias("item")).agg(F.count("*").alias("n"))
    links = edges.groupBy(F.concat(F.lit("edge "), "edge_kind").alias("item")).agg(F.count("*").alias("n"))
    functions = nodes.agg(F.countDistinct(KEY).alias("n")).select(F.lit("functions").alias("item"), "n")
    return kinds.unionByName(links).unionByName(functions)


def export_icfg(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``dot, json``: a line of each for every node and edge of the supergraph, which is too large for one row.

    The lines between ``digraph {`` and ``}``, in any order, are the graph.
    """
    name = lambda f, b: F.concat(F.lit('"'), F.col(f).cast("string"), F.lit(":"), F.col(b).cast("string"), F.lit('"'))
    node = nodes.select(F.concat(name(KEY, "block_id"), F.lit(' [label="'), "node_type", F.lit('"];')).alias("dot"), F.to_json(F.struct(F.col(KEY).alias("function"), F.col("block_id").alias("block"), F.col("node_type").alias("type"))).alias("json"))
    link = edges.select(
        F.concat(name("src_function", "src_block"), F.lit(" -> "), name("dst_function", "dst_block"), F.lit(' [label="'), "edge_kind", F.lit('"];')).alias("dot"),
        F.to_json(F.struct("src_function", "src_block", "dst_function", "dst_block", F.col("edge_kind").alias("type"))).alias("json"),
    )
    return node.unionByName(link)
