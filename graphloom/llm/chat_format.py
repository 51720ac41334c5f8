"""Chat formatting in budgeted windows: turn-aligned spans from prefix sums, repeated history, masks over repeats.

All in DataFrame functions. A window's text is a row of turns, ``<turn>role\\ntext</turn>\\n`` each. In roles and texts
``&`` and ``<`` (in roles line feeds too) are written as entities, so a marker can't come from a text, and reading is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import cut

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens of a window; turns and tokens of its history at most; tokens that a turn's frame takes.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, FRAME_TOKENS = 512, 2, 128, 4
#: Turns of one part of a conversation. Parts are laid out apart from each other, so that none is one task's alone.
PART_TURNS = 1024
#: Characters of a text by which turns of the same number and role are dealt.
HEAD_CHARS = 64


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def turn_tokens(text: Column) -> Column:
    """Words and single signs, a tokenizer-free measure of a turn, plus its frame."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]")) + FRAME_TOKENS


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """``conv_id, window, formatted, n_repeated, loss_spans, n_tokens``; one row per window.

    Every window has the conversation's system turn (a first turn of that role), history and new turns, together at most
    ``budget`` tokens. Half of what the system turn leaves is the stride: turns that start between two multiples of it, by
    the prefix sums of their tokens, are new in one window. Only the last of them can reach past the next multiple; where it
    makes them too large, it is a window of its own. History is up to ``history_turns`` turns before the new ones, as far
    as they fit ``history_tokens`` and what the budget leaves. So only a turn that is too large alone, or with the system
    turn, passes the budget; it stays whole, without history. ``loss_spans`` are [start, end) in code points of
    ``formatted``: the escaped texts of new assistant turns only, each in one window.

    A conversation is laid out part by part: after each PART_TURNS turns, counted in their order whatever their numbers
    are, a new window begins, with the system turn and without history. So one conversation, however long, is no task's alone.

    Null role and text are empty; turns sort by turn (null first), role, text; repeated rows are turns of their own; rows
    with a null conv_id are one conversation; an empty table gives none.
    """
    rows = _in_parts(conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = rows.withColumn("tok", turn_tokens(F.col("text")))
    w = W.partitionBy("conv_id", "part").orderBy(F.desc("head"), "turn", "role", "text")
    rows = rows.select("conv_id", "part", "turn", "role", "text", "head", "tok", F.row_number().over(w).alias("place"), F.first("head").over(w).alias("headed"), (F.first("role").over(w) == "system").alias("opens"), F.first("text").over(w).alias("text1"), F.first("tok").over(w).alias("tok1"))
    rows = rows.withColumn("seq", F.col("place") - F.col("headed").cast("int")).withColumn("home", (F.col("part") == 0) & F.col("opens")).withColumn("has_system", F.col("headed") | F.col("home"))
    system = F.col("home") & (F.col("seq") == 1)
    # its tokens are taken off the room of every window, and so count nowhere in the sums that place the others
    rows = rows.withColumn("room", F.lit(budget) - F.when(F.col("has_system"), F.col("tok1")).otherwise(0)).withColumn("own", F.when(F.col("head") | system, 0).otherwise(F.col("tok")))
    rows = rows.withColumn("pre", F.coalesce(F.sum("own").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("room") / 2))).where("not head")
    rows = rows.withColumn("cell", F.floor(F.col("pre") / F.col("stride")))
    too_large = F.sum("own").over(W.partitionBy("conv_id", "part", "cell")) > F.col("room")
    past = F.col("pre") + F.col("own") > (F.col("cell") + 1) * F.col("stride")
    rows = rows.withColumn("win", 2 * F.col("cell") + F.when(too_large & past, 1).otherwise(0))
    rows = rows.withColumn("spare", F.least(F.lit(history_tokens), F.col("room") - F.sum("own").over(W.partitionBy("conv_id", "part", "win"))))
    at = W.partitionBy("conv_id", "part").orderBy("seq")
    later = []
    for j in range(1, history_turns + 1):
        opens = F.lead("win", j).over(at) != (F.lead("win", j - 1).over(at) if j > 1 else F.col("win"))
        fits = F.lead("pre", j).over(at) - F.col("pre") <= F.lead("spare", j).over(at)
        later.append(F.when(opens & fits & ~system, F.struct(F.lead("win", j).over(at).alias("win"), F.lit(False).alias("new"))))
    own = F.struct(F.col("win").alias("win"), F.lit(True).alias("new"))
    placed = rows.withColumn("places", F.filter(F.array(own, *later), lambda x: x.isNotNull())).select("conv_id", "part", "seq", "role", "text", "tok", "has_system", "home", "text1", "tok1", F.inline("places").alias("window", "new"))
    turn = F.struct("seq", "new", "role", "text", "tok")
    grouped = placed.groupBy("conv_id", "part", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"), *[F.first(c).alias(c) for c in ("has_system", "home", "text1", "tok1")])
    head = F.struct(F.lit(0).alias("seq"), F.lit(False).alias("new"), F.lit("system").alias("role"), F.col("text1").alias("text"), F.col("tok1").alias("tok"))
    there = F.col("home") & (F.col("turns")[0]["seq"] == 1)  # the system turn itself
    full = grouped.withColumn("turns", F.when(F.col("has_system") & ~there, F.concat(F.array(head), F.col("turns"))).otherwise(F.col("turns")))

    def piece(t: Column) -> Column:
        front = F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
        return F.struct(front.alias("front"), escape(t["text"]).alias("body"), (t["new"] & (t["role"] == "assistant")).alias("loss"))

    full = full.withColumn("pieces", F.transform("turns", piece))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def lay(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["front"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(p["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return full.select(
        "conv_id",
        (F.shiftleft("part", 32) + F.col("window")).alias("window"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["front"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_repeated"),
        F.aggregate("pieces", start, lay, lambda s: s["spans"]).alias("loss_spans"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tok"]).alias("n_tokens"),
    )


def _in_parts(base: DataFrame) -> DataFrame:
    """The same turns with ``part``, and for each later part of a conversation its system turn once more, as a ``head``.

    Only conversations of over PART_TURNS turns have later parts. Their turns are dealt by ranges of their order, so that a
    turn's position is its place in a range plus what the ranges before it hold of its conversation.
    """
    long = base.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > PART_TURNS).select(F.col("conv_id").alias("c"))
    long = cut(long, "long")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    head = F.lit(False).alias("head")
    if long.isEmpty():
        return base.select("*", F.lit(0).cast("long").alias("part"), head)
    order = ["conv_id", "turn", "role", F.left("text", F.lit(HEAD_CHARS))]
    ranged = cut(base.join(long, same, "left_semi").repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "turns")
    held = ranged.groupBy("conv_id", "p").agg(F.count("*").alias("n"))
    before = held.select(F.col("conv_id").alias("c"), F.col("p").alias("q"), F.sum("n").over(W.partitionBy("conv_id").orderBy("p").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    before = F.broadcast(before.where("before > 0"))  # of one conversation at most in each range
    place = F.row_number().over(W.partitionBy("conv_id", "p").orderBy("turn", "role", "text")) - 1
    placed = ranged.withColumn("place", place).join(before, same & (F.col("p") == F.col("q")), "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    placed = cut(placed.select("conv_id", "turn", "role", "text", F.floor(F.col("place") / PART_TURNS).cast("long").alias("part"), (F.col("place") == 0).alias("first")), "placed")
    systems = placed.where("first and role = 'system'").select(F.col("conv_id").alias("c"), "text")
    heads = placed.select("conv_id", "part").where("part > 0").distinct().join(systems, same)
    heads = heads.select("conv_id", F.lit(None).cast(base.schema["turn"].dataType).alias("turn"), F.lit("system").alias("role"), "text", "part", F.lit(True).alias("head"))
    short = base.join(long, same, "left_anti").select("*", F.lit(0).cast("long").alias("part"), head)
    return short.unionByName(placed.select("conv_id", "turn", "role", "text", "part", head)).unionByName(heads)


def read_back(formatted: Column, n_repeated: Column) -> Column:
    """The new turns of a window's text as structs (role, text)."""
    parts = F.split(formatted, CLOSE)
    new = F.slice(parts, n_repeated + 1, F.size(parts) - 1 - n_repeated)
    cut = F.transform(new, lambda p: F.substring(p, len(OPEN) + 1, F.length(p)))
    return F.transform(cut, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p))).alias("text")))


def query(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = windows(talk.unionByName(probe))
    turns = read_back(F.col("formatted"), F.col("n_repeated"))
    parts = out.select(
        "conv_id",
        F.struct("window", F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "").alias("loss")).alias("part"),
        F.size(turns).cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    said_, loss = F.array_join(F.transform("parts", lambda p: p["said"]), ""), F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(said_, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
