"""Katz backoff language model: discounted word pairs over smoothed words, counted and scored where the words meet."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WHITE, cut, doc_view, mix, utf8, word_hashes, word_spans

#: Smoothing of single words; pair counts up to K follow Good-Turing, others (and where it fails) lose a fixed part.
PRIOR, K, LARGE_LOSS, SMALL_LOSS = 0.1, 5, 0.05, 0.5
#: Words so frequent that their pairs are dealt by both words; text bytes that one bucket gathers;
#: text bytes whose events are sorted at once.
SPLIT_WORDS, BUCKET_BYTES, UNIT_BYTES = 4096, 12 << 20, 8 << 20
#: Word numbers: 56 bits of a hash; the end of a text and its start have fixed ones.
MASK, END, START = (1 << 56) - 1, 1, 2
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN = "bucket int, batch long, data binary"
_MID = "kind int, batch long, idx int, word long, total long, seen long, mass long, n1 long, n2 long, n3 long, n4 long, n5 long, data binary"
DOC, CONTEXT, UNSEEN, COUNTS, NAMES, PAIRS = range(6)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind their lengths and kinds, compressed; columns of bytes are kept apart."""
    import zstandard

    head = struct.pack("<i", len(arrays)) + b"".join(struct.pack("<q4s", len(a), a.dtype.str.encode().ljust(4)) for a in arrays)
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<i", raw), 4, []
    kinds = [struct.unpack_from("<q4s", raw, at + 12 * k) for k in range(n)]
    at += 12 * n
    for size, kind in kinds:
        t = np.dtype(kind.decode().strip())
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * t.itemsize, at).reshape(t.itemsize, size).T).view(t).ravel())
        at += size * t.itemsize
    return out


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by END, and the text each belongs to."""
    words, owner = [], []
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t or b"")
        if n < 4 << 20 and i + 1 < len(texts):
            continue
        part = texts[lo : i + 1]
        raw = _LOWER[np.frombuffer(b" ".join(t or b"" for t in part), np.uint8)]
        starts, ends = word_spans(raw, WHITE)
        bounds = np.searchsorted(starts, np.cumsum(np.fromiter((len(t or b"") + 1 for t in part), np.int64, len(part))))
        h = word_hashes(raw, starts, ends, 3).astype(np.int64) & MASK
        h[h <= START] += 3
        words.append(np.insert(h, bounds, END))
        own = np.repeat(np.arange(len(part)), np.diff(np.concatenate([[0], bounds])) + 1)
        owner.append(own + lo)
        lo, n = i + 1, 0
    return (np.concatenate(words), np.concatenate(owner)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _units(batches):
        held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        w, own = tokens(utf8(b))
        u, n = np.unique(w[~held[own]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["word", "n"])
        pa.default_memory_pool().release_unused()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of UNIT_BYTES of text (a longer text alone)."""
    for b in batches:
        lo = n = 0
        for i, size in enumerate(pc.binary_length(b.column(1)).fill_null(0).to_pylist()):
            if n and n + size > UNIT_BYTES:
                yield b.slice(lo, i - lo)
                lo, n = i, 0
            n += size
        if lo < b.num_rows:
            yield b.slice(lo)


def _event_batches(buckets: int, split):
    """One row per bucket and batch: the batch's events (word after word) whose word or pair belongs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.sort(split.value[0])
        for serial, b in enumerate(_units(batches)):
            batch = (TaskContext.get().partitionId() << 24) + serial
            held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            word, own = tokens(utf8(b))
            ctx = np.concatenate([[START], word[:-1]])
            ctx[np.concatenate([[True], own[1:] != own[:-1]])] = START
            w = word.astype(np.uint64)
            at = _among(word, frequent)
            deal = np.where(at >= 0, mix(w, ctx.astype(np.uint64)), mix(w, w))
            deal = (deal >> np.uint64(33)).astype(np.int64) % buckets
            word, ctx = _short(word, at, frequent), _short(ctx, _among(ctx, frequent), frequent)
            order = np.lexsort((own, word, deal))
            deal, word, ctx, own = deal[order], word[order], ctx[order], own[order]
            edges = np.searchsorted(deal, np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(edges)):
                s = slice(edges[k], edges[k + 1])
                first = np.flatnonzero(np.concatenate([[True], word[s][1:] != word[s][:-1]]))
                c, at, times = np.unique(ctx[s], return_inverse=True, return_counts=True)
                rank = np.argsort(-times, kind="stable")
                place = np.empty(len(rank), np.uint32)
                place[rank] = np.arange(len(rank))
                out.append((int(k), pack(word[s][first], np.diff(np.append(first, s.stop - s.start)).astype(np.uint32), c[rank], place[at], own[s].astype(np.uint32), held)))
            out.append((-1 - (batch % 2**30), pack(b.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.asarray(b.column(0).is_null()), held)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([batch] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())], ["bucket", "batch", "data"])
            pa.default_memory_pool().release_unused()

    return run


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 for none."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _short(x: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Frequent words as small negative numbers, which compress where many blobs repeat them; others as they are."""
    return np.where(at >= 0, at - len(frequent), x)


def _plain(x: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return np.where(x < 0, frequent[np.minimum(x, -1)], x) if len(frequent) else x


def _merged(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    u, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return u, *(np.bincount(at, np.concatenate(v), len(u)).astype(np.int64) if v else np.zeros(len(u), np.int64) for v in values)


def _bucket(split):
    """All events of one bucket: pair counts from training texts, then what each text's events come to."""

    def run(table: pa.Table) -> pa.Table:
        blobs, batch = table["data"].to_pylist(), table["batch"].to_pylist()
        if table["bucket"][0].as_py() < 0:
            return _rows([(NAMES, {"batch": batch, "data": blobs})])
        frequent, totals = split.value
        counts, words, uses, firsts = [], [], [], []
        for blob in blobs:  # counts first, blob by blob
            w, n, c, place, own, held = unpack(blob)
            w, c = _plain(w, frequent), _plain(c, frequent)
            train = ~held.astype(bool)[own]
            word = np.repeat(w, n)
            _, at, times = np.unique(_pair(c[place[train]], word[train]), return_index=True, return_counts=True)
            counts.append(times)
            firsts.append(np.stack([c[place[train]][at], word[train][at]], axis=1))
            words.append(w)
            uses.append(np.add.reduceat(train.astype(np.int64), np.concatenate([[0], np.cumsum(n.astype(np.int64))[:-1]])))
        both, counts = np.concatenate(firsts), np.concatenate(counts)
        firsts.clear()
        pair, at, inverse = np.unique(_pair(both[:, 0], both[:, 1]), return_index=True, return_inverse=True)
        both, count = both[at], np.bincount(inverse, counts, len(pair)).astype(np.int64)
        del inverse, counts, at
        word_u, word_n = _merged(words, uses)
        at = _among(word_u, frequent)
        word_n[at >= 0] = totals[at[at >= 0]]  # pairs of a frequent word lie in many buckets; its count is known
        out = [(COUNTS, {"total": [int((count == K + 1).sum())], **{f"n{r}": [int((count == r).sum())] for r in range(1, K + 1)}})]
        if len(pair):
            c_u, c_at = np.unique(both[:, 0], return_inverse=True)
            per = {"word": c_u, "total": np.bincount(c_at, count).astype(np.int64), "seen": np.bincount(c_at), "mass": np.bincount(c_at, word_n[_among(both[:, 1], word_u)]).astype(np.int64)}
            out.append((CONTEXT, per | {f"n{r}": np.bincount(c_at, count == r).astype(np.int64) for r in range(1, K + 1)}))
            w_u, w_at, w_n = np.unique(both[:, 1], return_inverse=True, return_counts=True)
            order = np.lexsort((both[:, 0], w_at))
            ctx = both[order, 0]
            out.append((PAIRS, {"batch": [table["bucket"][0].as_py()], "data": [pack(w_u, w_n.astype(np.uint32), _short(ctx, _among(ctx, frequent), frequent), count[order].astype(np.uint32))]}))
            del c_at, both, w_at, order, ctx
        for blob, b in zip(blobs, batch, strict=True):  # then scores, blob by blob
            w, n, c, place, own, held = unpack(blob)
            w, c = _plain(w, frequent), _plain(c, frequent)
            word, ctx = np.repeat(w, n), c[place]
            docs, own = np.unique(own, return_inverse=True)
            uni = np.repeat(word_n[_among(w, word_u)], n)
            at = _among(_pair(ctx, word), pair)
            r = np.where(at >= 0, count[np.maximum(at, 0)] if len(count) else 0, 0)
            size = len(docs)
            log_uni = np.log10(uni + PRIOR)
            part = np.where(r > K, np.log10(np.maximum(r - LARGE_LOSS, 1e-9)), 0.0) - np.where((uni > 0) & (word != END), np.log10(np.maximum(uni, 1)), 0.0) + np.where(r == 0, log_uni, 0.0)
            sums = [np.bincount(own, x, size) for x in (log_uni, part)]
            ints = [np.bincount(own, x, size).astype(np.uint32) for x in (np.ones(len(own)), uni > 0, r == 0, *(r == k for k in range(1, K + 1)))]
            out.append((DOC, {"batch": [b], "data": [pack(docs.astype(np.uint32), *sums, *ints)]}))
            new = r == 0
            if new.any():
                u, times = np.unique(np.stack([docs[own[new]], ctx[new]], axis=1), axis=0, return_counts=True)
                hot = (_among(u[:, 1], frequent) >= 0) | (u[:, 1] == START)
                out.append((UNSEEN, {"batch": np.full(len(u), b), "idx": u[:, 0], "word": u[:, 1], "total": times, "seen": hot.astype(np.int64)}))
        pa.default_memory_pool().release_unused()
        return _rows(out)

    return run


def _pair(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(ctx.astype(np.uint64), word.astype(np.uint64))


@lru_cache(maxsize=1)
def _mid_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _MID.split(", ")])


def _rows(parts: list[tuple[int, dict]]) -> pa.Table:
    schema, tables = _mid_schema(), []
    for kind, cols in parts:
        n = len(next(iter(cols.values())))
        tables.append(pa.Table.from_arrays([pa.array(np.full(n, kind, np.int32)) if f.name == "kind" else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema))
    return pa.concat_tables(tables)


def _gathered(table: pa.Table) -> pa.Table:
    """All rows of one batch of texts -> a row per text."""
    names, parts = None, []
    for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        if kind == NAMES:
            names = unpack(data)
        else:
            parts.append(unpack(data))
    doc, null, held = names
    sums, ints = np.zeros((2, len(doc))), np.zeros((3 + K, len(doc)), np.int64)
    for docs, *cols in sorted(parts, key=lambda p: (len(p[0]), p[1].sum())):
        for k in range(2):
            sums[k, docs] += cols[k]
        for k in range(3 + K):
            ints[k, docs] += cols[2 + k]
    batch = table["batch"][0].as_py()
    cols = [pa.array(np.full(len(doc), batch)), pa.array(np.arange(len(doc), dtype=np.int32)), pa.array(doc, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(sums[0]), pa.array(sums[1]), *(pa.array(x) for x in ints)]
    return pa.Table.from_arrays(cols, ["batch", "idx", "doc_id", "held_out", "uni", "part", "n_tokens", "n_known", "n_unseen", *(f"r{k}" for k in range(1, K + 1))])


def discounted(n: list[int]) -> list[float]:
    """Counts 1 to K as Katz discounts them, from the numbers of pairs seen 1 to K+1 times; SMALL_LOSS where that fails."""
    out = []
    cap = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - cap) / (1 - cap) if n[r - 1] and cap < 1 else 0.0
        out.append(r * d if 0 < d < 1 else r - SMALL_LOSS)
    return out


def _pair_rows(split):
    """Stored blobs of pairs -> rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                w, n, ctx, count = unpack(blob)
                word, ctx = np.repeat(w, n), _plain(ctx, split.value[0])
                for at in range(0, len(word), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(ctx[s]), pa.array(word[s]), pa.array(count[s].astype(np.int64))], ["context", "word", "n"])

    return run


def _text_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's pairs of neighbours, once each, with how often they occur there."""
    row = TaskContext.get().partitionId() << 33
    for b in _units(batches):
        word, own = tokens(utf8(b))
        ctx = np.concatenate([[START], word[:-1]])
        ctx[np.concatenate([[True], own[1:] != own[:-1]])] = START
        (own, ctx, word), times = np.unique(np.stack([own, ctx, word]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(row + own), b.column(0).take(pa.array(own)), pa.array(ctx), pa.array(word), pa.array(times)], ["row", "doc_id", "context", "word", "times"])
        row += b.num_rows


class Katz:
    """A fitted model's tables, and the scores of the texts that it was given.

    ``words``: word, n. ``contexts``: context, total (its count), weight (log10 of its exactly normalised backoff weight).
    ``pairs``: context, word, n. All are in Parquet files of the shared folder, words and contexts as rows, pairs as
    blobs of a bucket's words. ``scores``: a row per text. ``of``: the same model's scores of other texts.
    """

    def __init__(self, docs: DataFrame, held_out):
        spark = docs.sparkSession
        view = doc_view(docs, F.coalesce(held_out, F.lit(False)).alias("held"))
        stats = view.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held"), 1)).alias("texts")).first()
        self.words = cut(view.mapInArrow(_word_batches, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
        n = self.words.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.types, self.texts = n[0] or 0, n[1], stats["texts"]
        top = sorted((r["word"], r["n"]) for r in self.words.orderBy(F.desc("n"), "word").limit(SPLIT_WORDS).collect())
        split = spark.sparkContext.broadcast((np.array([w for w, _ in top], np.int64), np.array([c for _, c in top], np.int64)))
        buckets = max(1, -(-(stats["bytes"] or 0) // BUCKET_BYTES))
        events = view.mapInArrow(_event_batches(buckets, split), _IN)
        mid = cut(events.groupBy("bucket").applyInArrow(_bucket(split), _MID), "katz")
        self.pairs = mid.where(F.col("kind") == PAIRS).select("data").mapInArrow(_pair_rows(split), "context long, word long, n long")

        got = mid.where(F.col("kind") == COUNTS).agg(*[F.sum(f"n{r}") for r in range(1, K + 1)], F.sum("total")).first()
        self.star = discounted([x or 0 for x in got])
        z = self.scale = self.tokens + PRIOR * (self.types + 1)
        sums = mid.where(F.col("kind") == CONTEXT).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("total", "seen", "mass", *(f"n{r}" for r in range(1, K + 1)))])
        small = sum((F.col(f"n{r}") * (r - self.star[r - 1]) for r in range(1, K + 1)), F.lit(0.0))
        large = (F.col("seen") - sum((F.col(f"n{r}") for r in range(1, K + 1)), F.lit(0))) * LARGE_LOSS
        lost = (small + large) / F.col("total")
        weight = F.log10(lost / (1 - (F.col("mass") + PRIOR * F.col("seen")) / z))
        self.contexts = cut(sums.select(F.col("word").alias("context"), "total", weight.alias("weight")), "contexts")

        text = mid.where(F.col("kind").isin(DOC, NAMES)).select("kind", "batch", "data").groupBy("batch")
        text = text.applyInArrow(_gathered, "batch long, idx int, doc_id long, held_out boolean, uni double, part double, n_tokens long, n_known long, n_unseen long, " + ", ".join(f"r{k} long" for k in range(1, K + 1)))
        frequent = spark.createDataFrame([(START,), *((w,) for w, _ in top)], "context long")  # SPLIT_WORDS + 1 rows at most
        unseen = mid.where(F.col("kind") == UNSEEN).select("batch", "idx", F.col("word").alias("context"), F.col("total").alias("times"), "seen")
        hot = unseen.where("seen = 1").join(F.broadcast(self.contexts.join(F.broadcast(frequent), "context", "left_semi")), "context")
        back = hot.unionByName(unseen.where("seen = 0").join(self.contexts, "context"))
        back = back.groupBy("batch", "idx").agg(F.sum(F.col("times") * (F.col("weight") + F.log10("total"))).alias("back"))
        seen = sum((F.col(f"r{r}") * math.log10(self.star[r - 1]) for r in range(1, K + 1)), F.lit(0.0))
        start = math.log10(self.texts) if self.texts else 0.0
        log_z = math.log10(z)
        self.scores = text.join(back, ["batch", "idx"], "left").select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(self.tokens).cast("long").alias("train_tokens"),
            (F.col("uni") - F.col("n_tokens") * log_z).alias("base_score"),
            (F.col("part") + seen - F.col("n_unseen") * log_z - start + F.coalesce("back", F.lit(0.0))).alias("score"),
        )

    def of(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n_tokens, score`` of texts that the model need not have seen, from its tables alone.

        Each pair of neighbours asks for its own count; where there is none, for its first word's weight and its second
        word's share; after an unknown word, for that share. Frequent first words are joined by both words, so they don't
        meet in one task.
        """
        asked = doc_view(docs).mapInArrow(_text_pairs, "row long, doc_id long, context long, word long, times long")
        distinct = asked.select("context", "word").distinct()
        seen = distinct.join(self.pairs.withColumnRenamed("n", "count"), ["context", "word"], "left")
        star = F.when(F.col("count") > K, F.col("count") - LARGE_LOSS).otherwise(F.element_at(F.array(*map(F.lit, self.star)), F.col("count").cast("int")))
        known = seen.join(self.contexts, "context", "left").join(self.words, "word", "left")
        share = F.log10((F.coalesce("n", F.lit(0)) + PRIOR) / self.scale)
        value = F.when(F.col("count").isNotNull(), F.log10(star) - F.log10("total")).otherwise(F.coalesce("weight", F.lit(0.0)) + share)
        valued = known.select("context", "word", value.alias("value"))
        return asked.join(valued, ["context", "word"]).groupBy("row", "doc_id").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("value")).alias("score")).drop("row")


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10), one row per input row.

    Learns from the texts that aren't ``held_out`` and scores all. A pair seen in training has its discounted count over
    its first word's; else the word's smoothed share times the first word's backoff weight, which makes the shares of
    all words after it (and of one unknown word) add up to 1; after an unknown word the smoothed share alone. Null and
    empty texts are the end token alone; repeated rows are counted and scored as often as they occur; an empty table
    gives none.

    Every event goes once to the bucket of its word (for frequent words, of the pair), which counts and scores it; only
    events of unseen pairs go on, to their first word's backoff weight.
    """
    held = F.expr("crc32(cast(doc_id as string)) % 10 = 0") if held_out is None else held_out
    return Katz(docs, held).scores


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
