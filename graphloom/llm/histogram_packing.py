"""Packing by a histogram of lengths: combinations that fill a window, how often by non-negative least squares."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import cut, doc_view
from graphloom.llm.packing import _encoder, best_fit

#: Pieces of a combination, rounds of the least squares, pieces that one task packs greedily, tokens that its bins may lack.
DEPTH, ROUNDS, TASK_ITEMS, SLACK = 3, 200, 100_000, 4
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("part", pa.int64()), ("serial", pa.int64())])
PIECE = "doc_id long, start long, length int, crc long, doc_tokens long, crcs array<long>, part long, serial long"
PLACED = "doc_id long, start long, length int, crc long, doc_tokens long, sequence_id long, offset long, part long, serial long"


def powers(n: int) -> list[int]:
    """The powers of two that ``n`` is the sum of, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of one to DEPTH (three) of ``lengths``, descending, that sum to ``window``; 0 where a row has fewer."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a = np.flatnonzero(there)
    rows = [np.array([[window, 0, 0]])] if there[window] else []
    two = a[(a < window) & (2 * a >= window)]
    two = two[there[window - two]]
    rows.append(np.stack([two, window - two, 0 * two], 1))
    for big in a[(a < window) & (3 * a >= window)]:
        rest = window - big
        mid = a[(2 * a >= rest) & (a <= big) & (a < rest)]
        mid = mid[there[rest - mid]]
        rows.append(np.stack([0 * mid + big, mid, rest - mid], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def repeats(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often each combination is used: least squares against the histogram over non-negative counts, then rounded.

    Multiplicative updates keep counts non-negative. Counts are rounded up, largest first, as far as pieces are left.
    """
    if not len(combos):
        return np.zeros(0, np.int64)
    h = histogram.astype(float)
    h[0] = 0
    n, flat = len(h), combos.ravel()
    up = h[combos].sum(1)
    x = np.full(len(combos), h.sum() / max(1, 3 * len(combos)))
    for _ in range(ROUNDS):
        used = np.bincount(flat, np.repeat(x, combos.shape[1]), n)
        used[0] = 0
        x *= up / np.maximum(used[combos].sum(1), 1e-12)
    left = histogram.tolist()
    out = np.zeros(len(combos), np.int64)
    want = np.ceil(x).astype(np.int64)
    for i in np.argsort(-x, kind="stable").tolist():
        own = [int(v) for v in combos[i] if v]
        k = min(int(want[i]), *(left[v] // own.count(v) for v in own))
        if k > 0:
            out[i] = k
            for v in own:
                left[v] -= k
    return out


class Plan:
    """Slots by length: which ranks of a length's pieces go to which sequences, at which offset."""

    def __init__(self, histogram: np.ndarray, window: int):
        combos = combinations(np.flatnonzero(histogram), window)
        counts = repeats(combos, histogram)
        slots, taken, self.sequences = [], defaultdict(int), 0
        for i in np.flatnonzero(counts).tolist():
            k, offset = int(counts[i]), 0
            for v in (int(v) for v in combos[i] if v):
                slots.append((v, taken[v], taken[v] + k, self.sequences, offset))
                taken[v] += k
                offset += v
            self.sequences += k
        s = np.array(sorted(slots), np.int64).reshape(-1, 5)
        self.key, self.first, self.last, self.base, self.offset = (s[:, 0] << 44) + s[:, 1], s[:, 1], s[:, 2], s[:, 3], s[:, 4]
        self.length = s[:, 0]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a piece has a slot, its sequence's number, its offset."""
        if not len(self.key):
            none = np.zeros(len(length), np.int64)
            return none > 0, none, none
        at = np.maximum(np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, "right") - 1, 0)
        has = (self.length[at] == length) & (rank < self.last[at]) & (rank >= self.first[at])
        return has, self.base[at] + rank - self.first[at], self.offset[at]


def _cut_texts(path: str, ranks: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, serial = _encoder(path, ranks), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    length = min(window, n - at)
                    own, crcs, p = memoryview(ids)[4 * at : 4 * (at + length)], [], 0
                    for s in powers(length) if length < window else ():
                        crcs.append(zlib.crc32(own[4 * p : 4 * (p + s)]))
                        p += s
                    rows.append((doc, at, length, zlib.crc32(own), n, crcs, part, serial[length]))
                    serial[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, _PIECE)], schema=_PIECE)

    return run


def _residuals(window: int):
    """Best-fit over a task's pieces; those in bins that stay underfull are cut into powers of two, still without a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, part, serial = [b for b in batches if b.num_rows], TaskContext.get().partitionId(), defaultdict(int)
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("length", "descending"), ("crc", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        doc, start, size, crc, tokens, crcs = (t[c].to_pylist() for c in ("doc_id", "start", "length", "crc", "doc_tokens", "crcs"))
        rows, k = [], 0
        for own in best_fit(np.array(size), window):
            fill = sum(size[i] for i in own)
            if window - fill <= SLACK or fill & (fill - 1) == 0:
                at = 0
                for i in own:
                    rows.append((doc[i], start[i], size[i], crc[i], tokens[i], 4 * ((part << 31) + k) + 2, at, part, None))
                    at += size[i]
                k += 1
                continue
            for i in own:
                at = start[i]
                for s, c in zip(powers(size[i]), crcs[i], strict=True):
                    rows.append((doc[i], at, s, c, tokens[i], None, None, part, serial[s]))
                    serial[s] += 1
                    at += s
        names = [f.split(" ")[0] for f in PLACED.split(", ")]
        types = [pa.int32() if n == "length" else pa.int64() for n in names]
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows[at : at + 20_000]), types)], names)

    return run


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of a piece among all of its length, by ``part`` (that wrote it) and ``serial`` (within it)."""
    counts = pieces.groupBy("length", "part").agg((F.max("serial") + 1).alias("n"))
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return pieces.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("serial")).drop("first")


def pack(docs: DataFrame, tokenizer: str, ranks: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the library's file, ``ranks`` the same vocabulary as ranks. A document is its ids and ``end_id``; null
    and empty texts are one id; repeated rows are packed as often as they occur; an empty table gives none.

    Documents are cut every ``window`` ids; whole windows are sequences. Of the rests the histogram of lengths (``window``
    numbers, all that the driver sees) is matched with combinations of up to three lengths that fill a window: repeat
    counts by non-negative least squares, rounded. A rest's rank among those of its length says which slot it has, so
    that nothing is sorted or grouped, however frequent a length. What has no slot is packed greedily, TASK_ITEMS to a task,
    and what lies in bins that stay underfull is cut into powers of two, of which equal ones fill windows to the end;
    the last ones of each power make sequences whose size is a power of two, which need no padding.
    """
    spark = docs.sparkSession
    pieces = cut(doc_view(docs).mapInArrow(_cut_texts(tokenizer, ranks, window, end_id), PIECE), "pieces")
    full = pieces.where(F.col("length") == window).withColumn("sequence_id", (F.shiftleft("part", 31) + F.col("serial")) * 4).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where(F.col("length") < window)
    histogram = np.zeros(window + 1, np.int64)
    for length, n in rests.groupBy("length").agg(F.count("*")).collect():
        histogram[length] = n
    plan = spark.sparkContext.broadcast(Plan(histogram, window))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has, sequence, offset = plan.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length", "crc", "doc_tokens", "crcs")), pa.array(4 * sequence + 1, mask=~has), pa.array(offset, mask=~has)], ["doc_id", "start", "length", "crc", "doc_tokens", "crcs", "sequence_id", "offset"])

    slotted = ranked(rests).mapInArrow(place, "doc_id long, start long, length int, crc long, doc_tokens long, crcs array<long>, sequence_id long, offset long")
    over = cut(slotted.where("sequence_id is null"), "over")
    tasks = -(-over.count() // TASK_ITEMS) or 1
    greedy = cut(over.repartition(tasks, F.xxhash64("crc", "doc_id", "start", "length")).mapInArrow(_residuals(window), PLACED), "greedy")
    return _named(full).unionByName(_named(slotted.where("sequence_id is not null"))).unionByName(_named(greedy.where("sequence_id is not null"))).unionByName(_named(_by_powers(greedy.where("sequence_id is null"), window)))


def _by_powers(pieces: DataFrame, window: int) -> DataFrame:
    """Pieces of equal power fill windows in the order of their ranks; a last window of k pieces is split by the powers in k."""
    rows = ranked(pieces.drop("sequence_id", "offset"))
    n = pieces.groupBy("length").agg(F.count("*").alias("n"))
    per = f"({window} div length)"
    rows = rows.join(F.broadcast(n), "length").withColumn("w", F.expr(f"rank div {per}")).withColumn("k", F.expr(f"rank % {per}"))
    # of the last window's m pieces, the first bits of m above k's place name the sequence: sizes m has, largest first
    m = f"if(w = n div {per}, n % {per}, {per})"
    ends = f"filter(transform(sequence(0, 11), i -> cast(shiftright({m}, i) as long) << i), e -> e > k)"
    begins = f"coalesce(array_max(filter(transform(sequence(0, 12), i -> cast(shiftright({m}, i) as long) << i), e -> e <= k)), 0)"
    rows = rows.withColumn("begin", F.expr(begins)).withColumn("end", F.expr(f"array_min({ends})"))
    number = F.expr(f"((w * {per} + begin) * 16 + cast(log2(length) as long)) * 4 + 3")
    return rows.withColumn("sequence_id", number).withColumn("offset", F.expr("(k - begin) * length"))


def _named(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
