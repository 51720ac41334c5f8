"""Importance resampling towards a target text: one dictionary of all n-gram strings, each hashed once."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import cut, doc_view, mix, word_hashes, word_spans
from graphloom.llm.decontaminate import FOLD
from graphloom.plans.shared import cut_and_free

#: Words of the longest n-gram; bytes of text in a unit and, over all units, for each shard of the dictionary; buckets.
GRAMS, UNIT_BYTES, SHARD_BYTES, BUCKETS = 3, 6 << 20, 6 << 20, 10_000
#: Parts of the dictionary, and of the units, that are dealt one after another: only one part's exchange is on disk at once.
ROUNDS = 3
_SPACE, _AFTER_SPACE = np.arange(256) == 32, zlib.crc32(b" ")
_NEXT_TWO = re.compile(rb" *[^ ]+( +[^ ]+)?")


class Grams:
    """The distinct n-grams of some texts, as numbers of words: counts, and for every occurrence its n-gram and text.

    ``heads`` and ``tails`` have, of each level beyond single words, an n-gram's first n-1 words (a number of the level
    before) and its last (a number of ``words``). The last ``extra`` words of a text only follow its own; no n-gram that
    begins there counts. With ``part`` (a number of shards and a round) longer n-grams are those of the round's shards alone.
    """

    def __init__(self, texts: list[bytes], extra: list[int], part: tuple[int, int] | None = None):
        raw = np.frombuffer(b" ".join(texts).translate(FOLD), np.uint8)
        starts, ends = word_spans(raw, _SPACE)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right").astype(np.int32)
        last = np.cumsum(np.bincount(text, minlength=len(texts)))
        own = np.ones(len(text), bool)
        for k in np.flatnonzero(extra).tolist():
            own[last[k] - extra[k] : last[k]] = False
        self.n_words = np.bincount(text[own], minlength=len(texts))
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 32].tobytes())]).dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy()
        del raw, starts, ends, offsets, coded
        bounds, data = _buffers(self.words)
        self.hashes = word_hashes(data, bounds[:-1], bounds[1:], 1)
        first, at, v, live = ids, len(self.words), max(1, len(self.words)), np.ones(len(ids), bool)
        self.heads, self.tails, self.at = [], [], [0, at]
        grams, of = [ids[own]], [text[own]]
        for n in range(2, GRAMS + 1):
            whole = text[: len(text) - n + 1] == text[n - 1 :] if len(text) >= n else np.zeros(0, bool)
            if part and n == 2:
                whole &= _shard(mix(self.hashes[ids[:-1]], self.hashes[ids[1:]]), part[0]) % ROUNDS == part[1]
            whole = live = whole & live[: len(whole)]
            # a run of n words by its first n-1, which have a number, and its last
            distinct, number = _numbered((first[: len(whole)].astype(np.int64) * v + ids[n - 1 :])[whole])
            self.heads.append((distinct // v).astype(np.int32))
            self.tails.append((distinct % v).astype(np.int32))
            first = np.zeros(len(whole), np.int32)
            first[whole] = number
            counted = whole & own[: len(whole)]
            grams.append(first[counted] + np.int32(at))
            of.append(text[: len(whole)][counted])
            at += len(distinct)
            self.at.append(at)
        self.gram, self.text = np.concatenate(grams), np.concatenate(of)

    def by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of the n-grams by shard, and where each shard's begin (and the last one's end).

        What begins with the same two words is in one shard, so that longer n-grams are told by shorter ones.
        """
        shard = [_shard(self.hashes, shards)]
        for n, (head, tail) in enumerate(zip(self.heads, self.tails)):
            shard.append(shard[-1][head] if n else _shard(mix(self.hashes[head], self.hashes[tail]), shards))
        shard = np.concatenate(shard)
        order = np.argsort(shard, kind="stable").astype(np.int32)
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def packed(self, picked: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> bytes:
        """One shard's n-grams (ascending numbers) and their counts; ``seen`` is False for all words, also afterwards."""
        levels = np.split(picked, np.searchsorted(picked, self.at[1:-1]))
        levels = [x - at for x, at in zip(levels, self.at)]
        heads, tails = [h[x] for h, x in zip(self.heads, levels[1:])], [t[x] for t, x in zip(self.tails, levels[1:])]
        for x in (levels[0], heads[0], *tails):
            seen[x] = True
        words = np.flatnonzero(seen)
        seen[words] = False
        local = np.zeros(len(seen), np.int32)
        local[words] = np.arange(len(words), dtype=np.int32)
        bounds, data = _buffers(self.words.take(pa.array(words)))
        step = lambda x: np.diff(x, prepend=0)
        # numbers of words ascend in the first two; of longer n-grams each shorter one has its number
        parts = [np.diff(bounds), step(local[levels[0]]), step(local[heads[0]]), local[tails[0]]]
        for n in range(1, GRAMS - 1):
            parts += [np.bincount(np.searchsorted(levels[n], heads[n]), minlength=len(levels[n])), local[tails[n]]]
        sizes = np.array([len(words), *map(len, levels)], "<u4").tobytes()
        return zstandard.ZstdCompressor(1).compress(b"".join([sizes, *map(_planes, parts), _planes(counts), data.tobytes()]))


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """All lowest bytes first, then all second ones: what is small or alike compresses well."""
    return x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(raw: bytes, n: int, at: int = 0, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(f"<u{width}").ravel()


class Unpacked:
    """What ``Grams.packed`` made of one unit's n-grams: local words, and of each level heads and tails."""

    def __init__(self, blob: bytes):
        raw, at = zstandard.ZstdDecompressor().decompress(blob), 4 * (GRAMS + 1)
        words, *levels = np.frombuffer(raw, "<u4", GRAMS + 1).tolist()

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += 4 * n
            return _from_planes(raw, n, at - 4 * n)

        bounds = np.concatenate([[0], np.cumsum(take(words), dtype=np.int64)])
        self.single = np.cumsum(take(levels[0]), dtype=np.int32)
        self.heads, self.tails = [np.cumsum(take(levels[1]), dtype=np.int32)], [take(levels[1])]
        for n in range(2, GRAMS):
            self.heads.append(np.repeat(np.arange(levels[n - 1], dtype=np.int32), take(levels[n - 1])))
            self.tails.append(take(levels[n]))
        self.counts = take(sum(levels))
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), words, [None, pa.py_buffer(bounds), pa.py_buffer(raw[at:])])


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.min_scalar_type(shards))  # 16 bits sort fastest


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and for every key its place there."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.diff(keys, prepend=keys[:1] - 1) != 0
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


def _buffers(strings: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of an array that may be a slice."""
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return bounds - bounds[0], np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]


def _pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text between words in pieces of about a unit, each with up to two words more that follow, and how many."""
    low, at = text.translate(FOLD) if len(text) > UNIT_BYTES else b"", 0
    while (end := low.find(b" ", at + UNIT_BYTES)) >= 0 and (more := _NEXT_TWO.match(low, end)):
        yield text[at : more.end()], 1 + (more.group(1) is not None)
        at = end
    yield text[at:], 0


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some texts, compressed, to a row; very long ones in pieces, which ``place`` names as one document's."""
    part, serial, count, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0

    def unit() -> pa.RecordBatch:
        doc, place, extra, texts = zip(*rows)
        blob = zstandard.ZstdCompressor(3).compress(b"".join(texts))
        longs = lambda x: pa.array([list(x)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict({"unit": pa.array([(part << 31) + serial]), "ids": longs(doc), "places": longs(place), "extra": longs(extra), "sizes": longs(map(len, texts)), "blob": pa.array([blob], pa.binary())})

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            for piece, extra in _pieces(t.as_py() or b""):
                rows.append((i, (part << 40) + count, extra, piece))
                size += len(piece)
                if size >= UNIT_BYTES:
                    yield unit()
                    rows, size, serial = [], 0, serial + 1
            count += 1
    if rows:
        yield unit()


def _texts(sizes: list[int], blob: bytes) -> list[bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, sum(sizes))) if sum(sizes) else b"", 0, []
    for n in sizes:
        out.append(raw[at : at + n])
        at += n
    return out


def _deal(shards: int, turn: int, target: bool):
    """A unit's distinct n-grams and their counts, one row for each shard of a round that has any."""

    def rows(unit: int, g: Grams) -> Iterator[tuple]:
        order, first = g.by_shard(shards)
        counts, seen = np.bincount(g.gram, minlength=g.at[-1]), np.zeros(len(g.words), bool)
        for k in (np.flatnonzero(np.diff(first[turn:])[::ROUNDS]) * ROUNDS + turn).tolist():
            picked = order[first[k] : first[k + 1]]
            yield k, unit, target, g.packed(picked, counts[picked], seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, extra, sizes, blob in zip(*(b.column(c).to_pylist() for c in ("unit", "extra", "sizes", "blob")), strict=True):
                of_shards = list(zip(*rows(unit, Grams(_texts(sizes, blob), extra, (shards, turn)))))
                if of_shards:
                    yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in zip(("shard", "unit", "target", "blob"), of_shards)})

    return run


def _followed(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What CRC-32 has left of texts with these CRCs when so many bytes follow: with the CRC of these bytes it makes, by
    exclusive or, that of both. It is linear in the bits, so tables by byte tell it."""
    found, which = np.unique(sizes, return_inverse=True)
    bits, byte = np.zeros((len(found), 32), np.uint32), np.arange(256)
    for row, n in zip(bits, found.tolist()):
        row[:] = [zlib.crc32(bytes(n), 1 << k) ^ zlib.crc32(bytes(n)) for k in range(32)]
    tables = np.zeros((len(found), 4, 256), np.uint32)
    for k in range(32):
        tables[:, k // 8] ^= np.where(byte >> k % 8 & 1, bits[:, k, None], 0).astype(np.uint32)
    tables, at, out = tables.ravel(), which * 1024, np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= tables[at + ((crc >> np.uint32(8 * k) & np.uint32(255)) + 256 * k)]
    return out


def _count(t: pa.Table) -> pa.Table:
    """One shard of the dictionary: every string is hashed once. A row per unit has its strings' buckets, in order; one
    more has what the buckets count in all, of documents, then of the target."""
    t = t.sort_by([("target", "ascending"), ("unit", "ascending")])
    got = [Unpacked(blob.as_py()) for blob in t["blob"]]
    coded = pa.concat_arrays([u.words for u in got]).dictionary_encode()
    words, v, at = coded.dictionary.to_pylist(), len(coded.dictionary), np.cumsum([0, *(len(u.words) for u in got)]).tolist()
    ids = coded.indices.to_numpy()
    number = [ids[a:b] for a, b in zip(at, at[1:])]
    # the hash of a string comes from that of all but its last word, which is one already, and the last word's
    crc, size = np.fromiter(map(zlib.crc32, words), np.uint32, v), np.fromiter(map(len, words), np.int64, v) + 1
    spaced = np.fromiter((zlib.crc32(w, _AFTER_SPACE) for w in words), np.uint32, v)
    del coded, ids, words
    found, first = [[(crc[n[u.single]] % BUCKETS).astype(np.uint16)] for n, u in zip(number, got)], number
    for n in range(GRAMS - 1):
        distinct, codes = _numbered(np.concatenate([f[u.heads[n]].astype(np.int64) * v + k[u.tails[n]] for f, k, u in zip(first, number, got)]))
        crc = _followed(crc[distinct // v], size[distinct % v]) ^ spaced[distinct % v]
        bucket, ends = (crc % BUCKETS).astype(np.uint16), np.cumsum([0, *(len(u.tails[n]) for u in got)]).tolist()
        first = [codes[a:b] for a, b in zip(ends, ends[1:])]
        for own, x in zip(found, first, strict=True):
            own.append(bucket[x])
    totals, rows = np.zeros((2, BUCKETS), np.int64), []
    for target, u, own in zip(t["target"].to_pylist(), got, map(np.concatenate, found), strict=True):
        totals[int(target)] += np.bincount(own, u.counts, BUCKETS).astype(np.int64)
        rows.append(None if target else zstandard.ZstdCompressor(1).compress(_planes(own, 2)))
    rows.append(zstandard.ZstdCompressor(3).compress(totals.tobytes()))
    shard = t["shard"][0].as_py()
    out = pa.table({"unit": pa.array([*t["unit"].to_pylist(), None], pa.int64()), "shard": pa.array([shard] * len(rows), pa.int64()), "blob": pa.array(rows, pa.binary())})
    return out.filter(pc.is_valid(out["blob"]))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column("blob").to_pylist():
            s, t = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(2, -1)
            some = np.flatnonzero(s + t)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "s": pa.array(s[some]), "t": pa.array(t[some])})


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What an occurrence in each bucket adds to a weight, in thousandths of a nat, floored."""
    more, other = float(s.sum() + len(s)), float(t.sum() + len(t))
    return np.array([math.floor(1000 * math.log((b + 1) * more / ((a + 1) * other))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray):
    """A unit's documents with their weights: its strings' buckets come back from all shards in the order they were dealt."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        shards = t["shard"].to_pylist()
        ids, places, extra, sizes = (t[c][0].as_py() for c in ("ids", "places", "extra", "sizes"))
        blobs = t["blob"].to_pylist()
        g = Grams(_texts(sizes, blobs[0]), extra)
        order, first = g.by_shard(t["shards"][0].as_py())
        there = np.flatnonzero(np.diff(first)).tolist()
        assert shards == [-1, *there], "a unit's strings must come back from every shard"
        of = np.zeros(len(order), np.uint16)
        for k, blob in zip(there, blobs[1:], strict=True):
            own = order[first[k] : first[k + 1]]
            of[own] = _from_planes(zstandard.ZstdDecompressor().decompress(blob), len(own), width=2)
        # gains and their sums are whole numbers below 2^53
        weight = np.bincount(g.text, gain[of[g.gram]], len(ids)).astype(np.int64)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "place": pa.array(places, pa.int64()), "n_words": pa.array(g.n_words.astype(np.int64)), "n_features": pa.array(np.bincount(g.text, minlength=len(ids)).astype(np.int64)), "weight": pa.array(weight)})

    return run


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of gains over all runs of 1 to 3 words of each document.

    Documents are read in units of whole texts; very long ones are cut between words, and no run of words is lost. A unit's distinct n-gram strings are dealt, with their counts, by the
    hash of their first two words, a third of the shards after another: each shard of the dictionary counts its strings over all units and hashes each once, to a bucket. Buckets'
    counts give gains (BUCKETS numbers), and each unit gets the buckets of its own strings back, to add up the gains of
    its documents' features. However frequent a string is, a unit sends it once.
    """
    spark = docs.sparkSession
    schema = "unit long, ids array<long>, places array<long>, extra array<long>, sizes array<long>, blob binary"
    own = cut(doc_view(docs).mapInArrow(_units, schema), "units")
    other = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_units, schema)
    size = own.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    dealt_schema = "shard long, unit long, target boolean, blob binary"
    parts = []
    for turn in range(min(ROUNDS, shards)):
        dealt = own.mapInArrow(_deal(shards, turn, False), dealt_schema).unionByName(other.mapInArrow(_deal(shards, turn, True), dealt_schema))
        parts.append(cut_and_free(dealt.groupBy("shard").applyInArrow(_count, "unit long, shard long, blob binary"), "buckets"))
    counted = reduce(DataFrame.unionByName, parts)
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for bucket, a, b in counted.where("unit is null").mapInArrow(_totals, "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s"), F.sum("t")).collect():
        s[bucket], t[bucket] = a, b
    both = own.withColumn("shard", F.lit(-1).cast("long")).unionByName(counted.where("unit is not null"), allowMissingColumns=True).withColumn("shards", F.lit(shards))
    some = []
    for turn in range(ROUNDS):
        weighed = both.where(F.pmod("unit", F.lit(ROUNDS)) == turn).groupBy("unit").applyInArrow(_weigh(gains(s, t)), "doc_id long, place long, n_words long, n_features long, weight long")
        some.append(cut_and_free(weighed, "weights"))
    weighed = reduce(DataFrame.unionByName, some)
    return weighed.groupBy("place").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]).drop("place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every document: the ``percent`` of those with at least
    ``least_words`` words that are most like the ``target`` texts, drawn without replacement by Gumbel noise.

    ``weight`` as in ``weigh``; ``score`` adds noise from a hash of the seed and the id; the highest scores are drawn, ties
    to smaller ids, and have ranks from 1. Null and empty texts have no features, weight 0 and are never drawn, and so are
    rows without an id, whose score is null; repeated rows count and are ranked each. Empty tables are allowed on both sides.
    """
    spark = docs.sparkSession
    h = f"(conv(substring(sha2(concat('{seed}:', doc_id), 256), 1, 8), 16, 10) + 0.5D)"
    scored = weigh(docs, target).withColumn("score", F.expr(f"weight + floor(-1000D * ln(-ln({h} / 4294967296D)))"))
    scored = scored.withColumn("open", F.expr(f"n_words >= {least_words} and doc_id is not null"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(scored.repartitionByRange(parts, F.desc("open"), F.desc("score"), "doc_id").withColumn("part", F.spark_partition_id()), "scores")
    counts = sorted(ranged.where("open").groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per partition
    first = [0, *np.cumsum([n for _, n in counts]).tolist()]
    drawn = percent * first[-1] // 100
    before = spark.createDataFrame([(part, n) for (part, _), n in zip(counts, first)], "part int, before long")
    place = F.row_number().over(W.partitionBy("part").orderBy(F.desc("open"), F.desc("score"), "doc_id")) + F.col("before")
    rows = ranged.join(F.broadcast(before), "part", "left").withColumn("place", place)
    return rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark"))
