"""Columns over source text and source ranges: byte offsets to lines and columns, display, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based byte offset; offsets past the end count as the end."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), offset)
    return (F.length(F.regexp_replace(F.decode(head, "UTF-8"), "[^\n]", "")) + 1).cast("long")


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a byte offset, in characters."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset), "UTF-8")
    return (F.length(F.substring_index(head, "\n", -1)) + 1).cast("long")


def display(file: Column, line: Column, column: Column) -> Column:
    """file:line:column, file:line without a column, the file alone without a line (0 or null: not known)."""
    known = lambda c: F.coalesce(c, F.lit(0)) > 0
    return F.when(known(line) & known(column), F.concat_ws(":", file, line.cast("string"), column.cast("string"))).when(known(line), F.concat_ws(":", file, line.cast("string"))).otherwise(file)


def overlaps(a_file: Column, a_start: Column, a_end: Column, b_file: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open byte ranges of one file share a byte."""
    return (a_file == b_file) & (a_start < b_end) & (b_start < a_end)


def holding(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """``text, part``: each ``text`` of ``whole`` with each ``text`` of ``parts`` that it has in it, once each.

    An equi-join on the substrings of the lengths that parts have, which are no more than the longest part is long.
    """
    lengths = sorted(r[0] for r in parts.select(F.length("text").alias("k")).where("k is not null").distinct().collect())
    if not lengths:
        return whole.where("false").select("text", F.col("text").alias("part"))
    cut = "flatten(transform(array({0}), k -> if(length(text) < k, array(), transform(sequence(1, length(text) - k + 1), i -> substring(text, i, k)))))".format(", ".join(map(str, lengths)))
    each = whole.select("text", F.explode(F.expr(cut)).alias("part")).distinct()
    return each.join(parts.select(F.col("text").alias("part")).distinct(), "part", "left_semi").select("text", "part")


def touched(symbols: DataFrame, changed_files: DataFrame) -> DataFrame:
    """``id`` of symbols whose file names a changed one or is named by it (``path``), sorted and once each."""
    files, paths = symbols.select(F.col("file").alias("text")).distinct(), changed_files.select(F.col("path").alias("text")).distinct()
    named = holding(files, paths).select("text").union(holding(paths, files).select("part")).distinct()
    return symbols.join(named.withColumnRenamed("text", "file"), "file", "left_semi").select("id").distinct()


def touched_by_path(symbols: DataFrame, changed_files: DataFrame) -> DataFrame:
    """``id`` of symbols whose file is a changed one (``path``, relative, a leading / is left out) or ends with it.

    Every end of each distinct file meets the changed paths by an equi-join. Null and empty paths name none.
    """
    files = symbols.select("file").where("file is not null").distinct()
    ends = files.select("file", F.explode(F.expr("transform(sequence(1, length(file)), i -> substring(file, i))")).alias("path")).where("path != ''")
    named = ends.join(changed_files.select(F.regexp_replace("path", "^/+", "").alias("path")).distinct(), "path", "left_semi")
    return symbols.join(named.select("file").distinct(), "file", "left_semi").select("id").distinct()


def overlapping(ranges: DataFrame, cell: int | None = None) -> DataFrame:
    """``file, a, b`` (a < b): ranges (``file, id, start, end``, half-open) of one file that share a place.

    Each file is dealt in cells of ``cell`` places (the mean length where none is given, so that ranges lie in about two);
    two ranges meet in the cells they have in common, and count in the one where the later of them starts. So a file of
    many ranges is no single task, and only near ones are compared.
    """
    if cell is None:
        cell = ranges.agg(F.ceil(F.avg(F.greatest(F.col("end") - F.col("start"), F.lit(1))))).first()[0] or 1
    at = lambda c: F.floor(F.col(c) / F.lit(cell))
    last = F.floor((F.greatest("start", F.col("end") - 1)) / F.lit(cell))
    dealt = ranges.select("file", "id", "start", "end").where("start is not null and end is not null").withColumn("cell", F.explode(F.sequence(at("start"), last)))
    a, b = dealt.toDF("file", "a", "s1", "e1", "cell"), dealt.toDF("file", "b", "s2", "e2", "cell")
    met = a.join(b, ["file", "cell"]).where("a < b and s1 < e2 and s2 < e1")
    return met.where(F.floor(F.greatest("s1", "s2") / F.lit(cell)) == F.col("cell")).select("file", "a", "b")


def resolve(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """``name, id``: a number is an id as it stands; another name its function's, the smallest where names repeat."""
    functions = symbols.where(F.get_json_object("data", "$.kind") == "Function").groupBy("name").agg(F.min("id").alias("found"))
    rows = names.select("name").distinct().join(functions, "name", "left")
    return rows.select("name", F.coalesce(F.when(F.col("name").rlike("^[0-9]{1,18}$"), F.col("name").cast("long")), F.col("found")).alias("id")).where("id is not null")


def details(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, name, file, known`` of each asked id; name and file null where there is no such symbol."""
    rows = ids.select("id").distinct().join(symbols.select("id", "name", "file", F.lit(True).alias("known")), "id", "left")
    return rows.select("id", "name", "file", F.coalesce("known", F.lit(False)).alias("known"))
