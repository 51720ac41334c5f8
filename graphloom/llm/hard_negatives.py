"""Hard negatives by inner product: vectors stored by (pivot, distance), and searched in intervals of that one key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import cut

#: Pivots and the rows they are chosen from; cells of a pivot's distances; rows of a segment; anchors of a tile; rows that
#: a first interval has at least.
PIVOTS, SAMPLE, CELLS, SEGMENT, TILE, PROBE = 16, 2048, 32, 2048, 128, 1024
#: Tiles whose best rows a task holds at once.
HELD = 32


class Space:
    """Vectors with one more component, so that all have the same norm: the largest inner product is the least distance."""

    def __init__(self, norm2: float, dims: int, peak: float, sample: np.ndarray):
        self.norm2, self.dims, self.dtype = norm2, dims, np.dtype("<i2" if peak < 2**15 else "<f8")
        self.width = 2 * math.sqrt(norm2) / CELLS or 1.0
        x = np.hstack([sample, np.sqrt(np.maximum(norm2 - (sample**2).sum(1), 0))[:, None]])
        chosen = x[:1]
        while len(chosen) < min(PIVOTS, len(x)):  # farthest first, then means of what is nearest
            chosen = np.vstack([chosen, x[((x[:, None] - chosen[None]) ** 2).sum(2).min(1).argmax()]])
        for _ in range(5):
            near = ((x[:, None] - chosen[None]) ** 2).sum(2).argmin(1)
            chosen = np.stack([x[near == k].mean(0) if (near == k).any() else chosen[k] for k in range(len(chosen))])
        self.pivots = chosen

    def read(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.dtype).reshape(-1, self.dims).astype(float)

    def distances(self, y: np.ndarray, last: np.ndarray | float) -> np.ndarray:
        """From vectors with the ``last`` component to every pivot."""
        own = (y**2).sum(1)[:, None] + np.square(last if isinstance(last, np.ndarray) else np.full(len(y), last))[:, None]
        dots = y @ self.pivots[:, :-1].T + np.outer(last if isinstance(last, np.ndarray) else np.full(len(y), last), self.pivots[:, -1])
        return np.sqrt(np.maximum(own + (self.pivots**2).sum(1)[None] - 2 * dots, 0))

    def cell(self, distance: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(distance / self.width), 0, CELLS).astype(np.int64)


_ROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("y", pa.binary()), ("pivot", pa.int32()), ("cell", pa.int32()), ("dist", pa.float64())])
_FOUND = pa.schema([("anchor", pa.int64()), ("t", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _keyed(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, space.dims)
            d = space.distances(flat, np.sqrt(np.maximum(space.norm2 - (flat**2).sum(1), 0)))
            near = d.argmin(1)
            own = d[np.arange(len(d)), near]
            y = pa.array([r.tobytes() for r in flat.astype(space.dtype)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), y, pa.array(near.astype(np.int32)), pa.array(space.cell(own).astype(np.int32)), pa.array(own)], schema=_ROW)

    return run


class Tile:
    """Some anchors, and for each its targets: scores from ``lo`` to ``hi``, of which ``bound`` and better are wanted."""

    def __init__(self, space: Space, rows: pa.Array):
        self.space = space
        part = rows.field
        self.key, self.id, self.label = (part(c).to_numpy(zero_copy_only=False) for c in ("anchor", "vec_id", "label"))
        self.y = space.read(part("y"))
        targets = part("targets")
        counts = np.array(targets.value_lengths().to_pylist(), np.int64)
        self.of = np.repeat(np.arange(len(counts)), counts)
        t = targets.flatten()
        self.t, self.lo, self.hi, self.bound = (t.field(c).to_numpy(zero_copy_only=False) for c in ("t", "lo", "hi", "bound"))
        self.to_pivot = space.distances(self.y, 0.0)
        self.best = np.zeros((0, 3), np.int64)  # target, score, vec_id

    def radius(self, score: np.ndarray) -> np.ndarray:
        """The distance at which a row has that score."""
        y2 = (self.y**2).sum(1)[self.of]
        return np.sqrt(np.maximum(self.space.norm2 + y2 - 2 * score, 0))

    def first_cells(self, counts: np.ndarray) -> np.ndarray:
        """Cells of each anchor's nearest pivot around the anchor's own distance, until they hold PROBE rows."""
        want = np.zeros(counts.shape, bool)
        for p, d in zip(self.to_pivot.argmin(1), self.to_pivot.min(1)):
            at = int(self.space.cell(np.array(d)))
            a = b = at
            while counts[p, a : b + 1].sum() < PROBE and (a > 0 or b < CELLS):
                a, b = max(0, a - 1), min(CELLS, b + 1)
            want[p, a : b + 1] = True
        return want & (counts > 0)

    def needed_cells(self, counts: np.ndarray) -> np.ndarray:
        """Cells that can hold a row between the distances of ``hi`` and ``bound``, by the triangle inequality."""
        slack = 1e-6 * (1 + math.sqrt(self.space.norm2))
        with np.errstate(invalid="ignore"):
            near, far = self.radius(self.hi), self.radius(self.bound)
        d = self.to_pivot[self.of]
        low = np.maximum(np.maximum(near[:, None] - d, d - far[:, None]), 0) - slack
        high = d + np.minimum(far, 1e300)[:, None] + slack
        low, high = self.space.cell(np.maximum(low, 0)), self.space.cell(high)
        want = np.zeros(counts.shape, bool)
        for c in range(CELLS + 1):
            want[:, c] = ((low <= c) & (c <= high)).any(0)
        return want & (counts > 0)

    def meet(self, rows: pa.Array, k: int, same_label: bool) -> None:
        ids, labels = rows.field("vec_id").to_numpy(), rows.field("label").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, labels, y = ids[order], labels[order], self.space.read(rows.field("y"))[order]
        scores = self.y @ y.T
        fits = self.label[:, None] == labels[None] if same_label else self.label[:, None] != labels[None]
        scores[~(fits & (self.id[:, None] != ids[None]))] = -np.inf
        each = scores[self.of]
        each[(each > self.hi[:, None]) | (each < self.bound[:, None])] = -np.inf
        if each.shape[1] > k:
            least = np.partition(each, each.shape[1] - k, axis=1)[:, -k]
            t, r = np.nonzero((each >= least[:, None]) & (each > -np.inf))
        else:
            t, r = np.nonzero(each > -np.inf)
        if len(t):
            self.keep(np.stack([t, each[t, r].astype(np.int64), ids[r]], 1), k)

    def keep(self, more: np.ndarray, k: int) -> None:
        """The first k of each target, by score, then id."""
        x = np.vstack([self.best, more])
        x = x[np.lexsort((x[:, 2], -x[:, 1], x[:, 0]))]
        start = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]])
        place = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
        self.best = x[place < k]
        n = np.bincount(self.best[:, 0], minlength=len(self.t))
        last = np.cumsum(n) - 1
        full = n >= k
        self.bound = np.where(full, np.maximum(self.bound, self.best[np.maximum(last, 0), 1]), self.bound)

    def found(self) -> pa.RecordBatch:
        t = self.best[:, 0]
        return pa.RecordBatch.from_arrays([pa.array(self.key[self.of[t]]), pa.array(self.t[t].astype(np.int32)), pa.array(self.best[:, 1]), pa.array(self.best[:, 2])], schema=_FOUND)


def _scan(anchors: DataFrame, index: DataFrame, space: Space, counts: np.ndarray, k: int, same_label: bool, first: bool) -> DataFrame:
    """``anchor, t, score, vec_id``: each task's best rows from the first intervals, or from all others that can matter."""
    tiles = anchors.groupBy("tile").agg(F.collect_list(F.struct("anchor", "vec_id", "label", "y", "targets")).alias("a"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tile = Tile(space, b.column("a")[i].values)
                probe = tile.first_cells(counts)
                pivot, cell = np.nonzero(probe if first else tile.needed_cells(counts) & ~probe)
                for at in range(0, len(pivot), 64):
                    own = pivot[at : at + 64]
                    again = pa.array(np.full(len(own), i))
                    yield pa.RecordBatch.from_arrays([b.column("tile").take(again), b.column("a").take(again), pa.array(own.astype(np.int32)), pa.array(cell[at : at + 64].astype(np.int32))], ["tile", "a", "pivot", "cell"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Tile] = {}
        for b in batches:
            for i, tile in enumerate(b.column("tile").to_pylist()):
                if tile not in held:
                    if len(held) >= HELD:
                        yield from (t.found() for t in held.values())
                        held.clear()
                    held[tile] = Tile(space, b.column("a")[i].values)
                held[tile].meet(b.column("rows")[i].values, k, same_label)
        yield from (t.found() for t in held.values())

    asked = tiles.mapInArrow(ask, f"tile long, a {tiles.schema['a'].dataType.simpleString()}, pivot int, cell int")
    return asked.join(index, ["pivot", "cell"]).select("tile", "a", "rows").mapInArrow(meet, "anchor long, t int, score long, vec_id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("anchor", "t").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _search(anchors: DataFrame, index: DataFrame, space: Space, counts: np.ndarray, k: int, same_label: bool) -> DataFrame:
    """``anchor, t, score, vec_id, rank``: the first k rows of every target.

    The first intervals give each target some rows; the distance of its k-th is a bound. All intervals within it are
    searched then, and nothing outside can be among the first k.
    """
    some = cut(_best(_scan(anchors, index, space, counts, k, same_label, True), k), "some")
    bounds = some.where(F.col("rank") == k).select("anchor", F.struct("t", "score").alias("x")).groupBy("anchor").agg(F.collect_list("x").alias("x"))
    known = "aggregate(filter(x, z -> z.t = y.t), y.bound, (m, z) -> greatest(m, double(z.score)))"
    nearer = F.expr(f"if(x is null, targets, transform(targets, y -> named_struct('t', y.t, 'lo', y.lo, 'hi', y.hi, 'bound', {known})))")
    rest = _scan(anchors.join(bounds, "anchor", "left").withColumn("targets", nearer).drop("x"), index, space, counts, k, same_label, False)
    return cut(_best(some.drop("rank").unionByName(rest), k), "best")


def mine(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, label, embedding``.

    An anchor (SQL condition ``is_anchor``) has the ``positives`` best rows of its own label, and for each of these the
    ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's (none where
    that is negative). Scores are inner products of floor(``scale`` * x), exact below 2**53; ties go to smaller ids.

    Rows without an id or a label, or whose vector is null or has a null, NaN or infinite component take no part; shorter
    vectors are filled up with zeros, empty ones are zero. No row is its own positive, nor others of its id; a repeated
    anchor counts once, other repeated rows each. An empty table gives none. Other columns are left alone.
    """
    ok = "vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)
    base = base.select("vec_id", "label", F.expr(f"transform(embedding, x -> floor({scale}D * x) * 1D)").alias("y"))
    norm2, dims, peak = base.agg(F.max(F.expr("aggregate(y, 0D, (a, x) -> a + x * x)")), F.max(F.size("y")), F.max(F.expr("coalesce(array_max(transform(y, x -> abs(x))), 0D)"))).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dims:
        return base.sparkSession.createDataFrame([], empty)
    base = base.withColumn("y", F.expr(f"concat(y, array_repeat(0D, {dims} - size(y)))"))
    sample = np.array([r.y for r in base.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()])
    space = Space(norm2, dims, peak, sample)
    keyed = base.mapInArrow(_keyed(space), "vec_id long, label long, y binary, pivot int, cell int, dist double")

    counts = np.zeros((len(space.pivots), CELLS + 1), np.int64)
    for p, c, n in keyed.groupBy("pivot", "cell").agg(F.count("*")).collect():  # at most PIVOTS * (CELLS + 1) rows
        counts[p, c] = n
    parts = F.element_at(F.array(*[F.lit(-(-int(n) // SEGMENT) or 1) for n in counts.ravel()]), F.col("pivot") * (CELLS + 1) + F.col("cell") + 1)
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts))
    index = dealt.groupBy("pivot", "cell", "part").agg(F.sort_array(F.collect_list(F.struct("dist", "vec_id", "label", "y"))).alias("rows")).drop("part")
    index = cut(index.sortWithinPartitions("pivot", "cell"), "index")

    picked = keyed.where(is_anchor).withColumn("anchor", F.xxhash64("vec_id", "label", "y")).dropDuplicates(["anchor"])
    many = {p: n for p, n in picked.groupBy("pivot").agg(F.count("*")).collect()}
    tiles = F.element_at(F.array(*[F.lit(-(-many.get(p, 0) // TILE) or 1) for p in range(len(space.pivots))]), F.col("pivot") + 1)
    picked = cut(picked.select("anchor", "vec_id", "label", "y", (F.col("pivot").cast("long") + len(space.pivots) * F.pmod("anchor", tiles)).alias("tile")), "anchors")
    endless = "array(named_struct('t', 0, 'lo', double('-Infinity'), 'hi', double('Infinity'), 'bound', double('-Infinity')))"
    near = _search(picked.withColumn("targets", F.expr(endless)), index, space, counts, positives, True)

    pairs = near.select("anchor", F.col("rank").alias("t"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.withColumn("hi", F.expr(f"double((positive_score * {high} - pmod(positive_score * {high}, 100)) div 100)")).withColumn("lo", F.expr(f"double((positive_score * {low} + pmod(-positive_score * {low}, 100)) div 100)"))
    wanted = pairs.where("lo <= hi").groupBy("anchor").agg(F.collect_list(F.struct("t", "lo", "hi", F.col("lo").alias("bound"))).alias("targets"))
    far = _search(picked.join(wanted, "anchor"), index, space, counts, negatives, False)
    out = far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs.drop("lo", "hi"), ["anchor", "t"]).join(picked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")), "vec_id % 100 = 0")
