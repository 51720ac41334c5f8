"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests, compared by subtracting and peeling.

All in SQL expressions. A sketch has three rows of WIDTH cells; a cell holds how many digests fell into it, the
exclusive or of the digests and of their check values. The difference of two sketches only holds what one of two texts
has; a cell with one digest gives it away, and taking it out of its other cells opens more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import cut, doc_view

#: Cells of one row of a sketch; peeling rounds; retries, each with sketches four times larger where the last one failed.
WIDTH, ROUNDS, RETRIES = 12, 16, 12
#: A long line is cut after words whose hash is 0 modulo CUT; a run without white space every RUN characters.
CUT, RUN = 32, 32
#: Digests that a sketch of 3 * WIDTH cells gives back almost always.
EASY = 16
_CELLS = "array<struct<n:int,key:bigint,chk:bigint>>"
_CHECK = "(xxhash64({k}, 7) & 4294967295L)"
_MARK = "\x01"


def _row(k: str, j: int) -> str:
    """SQL of the cell of digest ``k`` in row j."""
    return f"cast(pmod(shiftrightunsigned({k}, {16 * j}), {WIDTH}) as int)"


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs; empty and null: none.

    A paragraph ends with its line, and a long line is cut where its own words say, so that an insertion changes the
    piece it is in and no other.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\S{{1,{RUN}}}\s*|\s+"), F.lit(0))
    last = lambda w: F.contains(w, F.lit("\n")) | (F.pmod(F.xxhash64(w), F.lit(CUT)) == 0)
    # a text that has the mark itself gets one with its own digest in it, which it can't contain
    mark = F.when(F.contains(text, F.lit(_MARK)), F.concat(F.lit(_MARK), F.sha2(text, 256))).otherwise(F.lit(_MARK))
    cut_by = lambda k: F.split(F.array_join(F.transform(words, lambda w: F.when(last(w), F.concat(w, k)).otherwise(w)), ""), k)
    pieces = F.transform(F.array(mark), cut_by)[0]  # as a variable it is made once, not for every word
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p)))


def sketch(keys: str) -> str:
    """SQL: the cells of an array of digests."""
    rows = []
    for j in range(3):
        own = f"filter({keys}, k{j} -> {_row(f'k{j}', j)} = c{j})"
        cell = f"named_struct('n', size(o{j}), 'key', aggregate(o{j}, 0L, (a, x) -> a ^ x), 'chk', aggregate(o{j}, 0L, (a, x) -> a ^ {_CHECK.format(k='x')}))"
        rows.append(f"transform(sequence(0, {WIDTH - 1}), c{j} -> transform(array({own}), o{j} -> {cell})[0])")
    return f"concat({', '.join(rows)})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'key', p.key ^ q.key, 'chk', p.chk ^ q.chk))"


def peel(cells: str) -> str:
    """SQL: struct(ok, got) of a difference; got are the digests that one side only has, complete if ok.

    Rounds end with the first that finds none.
    """
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and {_CHECK.format(k='c.key')} = c.chk), c -> named_struct('n', c.n, 'key', c.key)))"
    at = f"(case when i < {WIDTH} then {_row('p.key', 0)} when i < {2 * WIDTH} then {WIDTH} + {_row('p.key', 1)} else {2 * WIDTH} + {_row('p.key', 2)} end)"
    less = f"named_struct('n', c.n - aggregate(o, 0, (a, p) -> a + p.n), 'key', c.key ^ aggregate(o, 0L, (a, p) -> a ^ p.key), 'chk', c.chk ^ aggregate(o, 0L, (a, p) -> a ^ {_CHECK.format(k='p.key')}))"
    taken = f"transform(s.cells, (c, i) -> transform(array(filter(found, p -> {at} = i)), o -> if(size(o) = 0, c, {less}))[0])"
    stop = "named_struct('cells', s.cells, 'got', s.got, 'open', false)"
    step = f"if(s.open, transform(array({pure}), found -> if(size(found) = 0, {stop}, named_struct('cells', {taken}, 'got', concat(s.got, transform(found, f -> f.key)), 'open', true)))[0], s)"
    start = f"named_struct('cells', cast({cells} as {_CELLS}), 'got', cast(array() as array<bigint>), 'open', true)"
    end = "named_struct('ok', forall(s.cells, c -> c.n = 0 and c.key = 0 and c.chk = 0), 'got', s.got)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> {end})"


def _halves(a: str, b: str, depth: str) -> str:
    """SQL: two arrays of digests as four pairs of arrays, by two bits from the top at a depth."""
    own = "filter({0}, k -> (shiftrightunsigned(k, 62 - 2 * ({1})) & 3) = g)"
    return f"transform(sequence(0, 3), g -> named_struct('a', {own.format(a, depth)}, 'b', {own.format(b, depth)}))"


def differing(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """SQL: how many digests one of two arrays has alone, from peeling the difference of their sketches.

    Where peeling stops early, the digests are dealt into four parts of a sketch each, and parts that stop again into
    four more. The counts of the first difference tell how many retries can't succeed: their squares add up to about the
    number of differing digests; those sizes are passed over. Parts that stop after RETRIES are compared as they are.
    """
    none = "cast(array() as array<struct<a:array<bigint>,b:array<bigint>>>)"
    spread = f"greatest(0D, (aggregate(cells, 0D, (x, c) -> x + c.n * c.n) / 3 - pow(size({a}) - size({b}), 2) / {WIDTH}) * {WIDTH / (WIDTH - 1)})"
    skip = f"cast(greatest(0, least({RETRIES - 1}, floor(log(4D, greatest(1D, ({spread}) / {EASY}))))) as int)"
    start = (
        f"transform(array({subtract(sketch_a, sketch_b)}), cells -> transform(array({peel('cells')}), f -> if(f.ok, named_struct('todo', {none}, 'd', size(f.got), 'skip', 0), "
        f"named_struct('todo', {_halves(a, b, '0')}, 'd', 0, 'skip', {skip})))[0])[0]"
    )
    tried = f"transform(s.todo, t -> named_struct('t', t, 'p', {peel(subtract(sketch('t.a'), sketch('t.b')))}))"
    left = f"flatten(transform(filter(tried, x -> not x.p.ok), x -> {_halves('x.t.a', 'x.t.b', 'r')}))"
    retry = f"transform(array({tried}), tried -> named_struct('todo', {left}, 'd', s.d + aggregate(filter(tried, x -> x.p.ok), 0, (n, x) -> n + size(x.p.got)), 'skip', 0))[0]"
    deal = f"named_struct('todo', flatten(transform(s.todo, t -> {_halves('t.a', 't.b', 'r')})), 'd', s.d, 'skip', s.skip)"
    rest = "s.d + aggregate(s.todo, 0, (n, t) -> n + size(array_except(t.a, t.b)) + size(array_except(t.b, t.a)))"
    return f"aggregate(sequence(1, {RETRIES}), {start}, (s, r) -> if(size(s.todo) = 0, s, if(r <= s.skip, {deal}, {retry})), s -> {rest})"


def compare(df: DataFrame, a: str, b: str, sketch_a: str, sketch_b: str, out: str) -> DataFrame:
    """Adds ``out``: share of common digests, 0 to 1 (``differing``). Two texts without any paragraph are alike (1)."""
    total = f"(size({a}) + size({b}))"
    df = df.withColumn("_d", F.expr(differing(a, b, sketch_a, sketch_b)))
    return df.withColumn(out, F.expr(f"case when {total} = 0 then 1.0D else cast({total} - _d as double) / ({total} + _d) end")).drop("_d")


def shown(cells: str) -> Column:
    """A sketch as text: counts, digests and checks of its cells in hexadecimal digits."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.hex(c["n"].cast("long")), F.lit("."), F.hex(c["key"]), F.lit("."), F.hex(c["chk"]))), " ")


def successors(ids: DataFrame) -> DataFrame:
    """``doc_id`` -> ``doc_id, next_id``: the next larger id, after the last the first. No global sort in one task."""
    dealt = cut(ids.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))  # a row per partition
    seam = firsts.select("part", F.coalesce(F.lead("first").over(W.orderBy("part")), F.min("first").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("seam"))
    inner = dealt.withColumn("next", F.lead("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    return inner.join(seam, "part").select("doc_id", F.coalesce("next", "seam").alias("next_id"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, keys, cells``: paragraph digests and sketch of every text; null is empty, repeated rows stay repeated."""
    return doc_view(docs).select("doc_id", digests(F.col("text")).alias("keys")).withColumn("cells", F.expr(sketch("keys")))


def edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, keys, edited, next_keys``: every text's digests, its edited version, the next document's digests.

    The last floor(n/4) characters give way to the first as many (or all) of the next document's, by ascending doc_id.
    Rows with a null doc_id are dropped; rows that share a doc_id see the same next document, the least text of its id.
    """
    view = doc_view(docs).where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    sizes = view.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    wanted = successors(view).join(sizes, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), F.expr("cast(floor(n / 4) as int)").alias("k"))
    keyed = view.withColumn("keys", digests(F.col("text")))  # once for each text, before it is dealt
    heads = keyed.join(wanted, "doc_id").select(F.col("for_id").alias("doc_id"), F.struct(F.expr("left(text, k)").alias("head"), F.col("keys").alias("next_keys")).alias("h"))
    heads = heads.groupBy("doc_id").agg(F.min("h").alias("h"))
    both = keyed.join(heads, "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(left(text, cast(n_chars - floor(n_chars / 4) as int)), left(h.head, cast(floor(n_chars / 4) as int)))")
    return both.select("doc_id", "n_chars", "keys", edited.alias("edited"), F.col("h.next_keys").alias("next_keys"))


def query(spark, sf_dir: str) -> DataFrame:
    df = edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", digests(F.col("edited")).alias("edited_keys"), "next_keys")
    for name in ("", "edited_", "next_"):
        df = df.withColumn(f"{name}cells", F.expr(sketch(f"{name}keys")))
    df = compare(df, "keys", "edited_keys", "cells", "edited_cells", "near_edited")
    df = compare(df, "keys", "next_keys", "cells", "next_cells", "near_next")
    return df.select("doc_id", "n_chars", "edited_sha256", shown("cells").alias("fingerprint"), shown("edited_cells").alias("edited_fingerprint"), "near_edited", "near_next")
