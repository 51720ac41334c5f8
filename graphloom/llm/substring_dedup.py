"""Substring dedup: difference-cover anchors find shared passages, window hashes around them decide word by word."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WHITE, doc_view, mix, utf8, word_hashes, word_spans

#: A perfect difference cover. For any two residues some shift below PERIOD takes both into COVER.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes that are hashed at once.
SLICE = 4 << 20
_OUT = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` items from each place on (the last size-1 places are cut off)."""
    step = 1
    while step * 2 <= size:
        h = mix(h[:-step], h[step:])
        step *= 2
    return mix(h[: len(h) - (size - step)], h[size - step :]) if size > step else h


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or b"")
        if n >= SLICE:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _words(texts: list[bytes | None], seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Word hashes of all texts in a row, by seed, and the first word of each text (and of none after the last)."""
    raw = np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)
    starts, ends = word_spans(raw, WHITE)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return [word_hashes(raw, starts, ends, s) for s in seeds], bounds


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def _sent(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, pos: np.ndarray, keys: np.ndarray, before: int, limits: np.ndarray) -> pa.RecordBatch:
    """One row for each distinct hash of the batch, and intervals for those that occur more than once in it.

    A row holds the hash, and in ``at`` 32 more of its bits, the place and whether it repeats here. Of intervals, hash
    null, [start, end) of window starts: what a place stands for reaches from ``before`` words before it to itself.
    """
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(order))) > 1
    rep = order[first]
    at = (h2[rep].astype(np.int64) << 32) | (pos[rep] << 1) | many
    again = order[np.repeat(many, np.diff(np.append(first, len(order))))]
    base = np.concatenate([[0], np.cumsum(limits)])
    hit = _cover(int(base[-1]), base[doc[again]] + np.maximum(pos[again] - before, 0), base[doc[again]] + np.minimum(pos[again] + 1, limits[doc[again]]))
    cuts = base[1:-1]
    s, e = _runs(hit)
    inner = cuts[(cuts > 0) & (cuts < len(hit))]
    inner = np.unique(inner[hit[inner] & hit[inner - 1]]) if len(inner) else inner
    s, e = np.sort(np.concatenate([s, inner])), np.sort(np.concatenate([e, inner]))
    d = np.searchsorted(base, s, "right") - 1
    hashes = pa.concat_arrays([pa.array(h1[rep].view(np.int64)), pa.nulls(len(s), pa.int64())])
    return pa.RecordBatch.from_arrays([hashes, pa.array(np.concatenate([keys[doc[rep]], keys[d]])), pa.array(np.concatenate([at, ((s - base[d]) << 32) | (e - base[d])]))], schema=_OUT)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are dealt once and read twice."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        blobs = pa.array([None if t is None else pack(t) for t in utf8(b)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), blobs], ["key", "doc_id", "text"])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [b"" if t is None else unpack(t) for t in batch.column(1).to_pylist()]


def _anchor_batches(size: int):
    """Hashes of the ``size - PERIOD + 1`` words from each cover position on."""
    width = size - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = utf8(batch), []
            keys, limits = batch.column(0).to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
            for lo, hi in _slices(texts):
                (h,), bounds = _words(texts[lo:hi], (1,))
                n = np.diff(bounds)
                limits[lo:hi] = np.maximum(n - size + 1, 0)
                if len(h) < width:
                    continue
                pos = np.arange(len(h)) - np.repeat(bounds[:-1], n)
                ok = in_cover[pos % PERIOD] & (pos + width <= np.repeat(n, n)) & (np.repeat(n, n) >= size)
                at = np.flatnonzero(ok)
                found.append((_doubled(h, width)[at], np.repeat(np.arange(lo, hi), n)[at], pos[at]))
            if found:
                h, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _sent(h, np.zeros(len(h), np.uint64), doc, pos, keys, PERIOD - 1, limits)

    return run


def _window_batches(size: int):
    """Hashes of the windows that start in the intervals of the third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = _texts(batch), []
            keys, limits = batch.column(0).to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
            lists = batch.column(2)
            flat, off = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = flat.to_numpy(zero_copy_only=False)
            s_all, e_all = flat >> 32, flat & 0xFFFFFFFF
            for lo, hi in _slices(texts):
                (h1, h2), bounds = _words(texts[lo:hi], (1, 2))
                n = np.diff(bounds)
                limits[lo:hi] = np.maximum(n - size + 1, 0)
                if len(h1) < size:
                    continue
                base = np.repeat(bounds[:-1], np.diff(off[lo : hi + 1]))
                wanted = _cover(len(h1), base + s_all[off[lo] : off[hi]], base + e_all[off[lo] : off[hi]])
                pos = np.arange(len(h1)) - np.repeat(bounds[:-1], n)
                at = np.flatnonzero(wanted & (pos + size <= np.repeat(n, n)))
                found.append((_doubled(h1, size)[at], _doubled(h2, size)[at] >> np.uint64(32), np.repeat(np.arange(lo, hi), n)[at], pos[at]))
            if found:
                h1, h2, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _sent(h1, h2, doc, pos, keys, 0, limits)

    return run


def _shared_batches(before: int):
    """Rows sorted by hash -> intervals ``key, span`` of those whose hash another row has, or that repeat.

    A span is its start in the upper, its end in the lower half of one long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the group that the last batch ended in; its only row, while it has just one

        def out(key, start, end):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array((start << 32) | end)], ["key", "span"])

        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            key, at = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            if null.any():
                yield out(key[null], at[null] >> 32, at[null] & 0xFFFFFFFF)
            h = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)[~null]
            key, at = key[~null], at[~null]
            if not len(h):
                continue
            top, pos, many = at >> 32, (at & 0xFFFFFFFF) >> 1, (at & 1).astype(bool)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (top[1:] != top[:-1])
            first = np.flatnonzero(new)
            shared = (np.diff(np.append(first, len(h))) > 1) | np.logical_or.reduceat(many, first)
            if last == (h[0], top[0]):
                shared[0] = True
                if held is not None:
                    key, pos, shared = np.append(key, held[0]), np.append(pos, held[1]), shared
                    yield out(key[-1:], np.maximum(pos[-1:] - before, 0), pos[-1:] + 1)
                    key, pos = key[:-1], pos[:-1]
            keep = np.repeat(shared, np.diff(np.append(first, len(h))))
            yield out(key[keep], np.maximum(pos[keep] - before, 0), pos[keep] + 1)
            last, held = (h[-1], top[-1]), None if shared[-1] else (key[-1], pos[-1])

    return run


def _removed_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, removed, kept = [], [], []
            for t, own in zip(_texts(b), b.column(2), strict=True):
                words = t.split()
                n = 0
                if own.is_valid:
                    v = own.values.to_numpy(zero_copy_only=False)
                    hit = _cover(len(words), v >> 32, np.minimum((v & 0xFFFFFFFF) + size - 1, len(words)))
                    n = int(hit.sum())
                n_words.append(len(words))
                removed.append(n)
                kept.append(b" ".join(compress(words, ~hit) if n else words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: every text without the words of windows that start anywhere else too.

    Windows are ``size`` consecutive words of one text, judged on the input; kept words are joined by one space. Null and
    empty texts have no words; texts under ``size`` words lose none; repeated rows are repeats of each other; an empty
    table gives none.

    Anchors are hashed at cover positions only; two equal windows share one at the same place in both, so only windows
    around shared anchors are hashed whole (96 bits) and compared. Each task sends a hash once, however often it
    occurs there, and settles what repeats inside it on the spot, so a passage that half of all texts hold doesn't fill
    one task. Texts are dealt by row key once, for both passes.
    """
    if size < PERIOD + 1:
        raise ValueError(f"windows of over {PERIOD} words only")
    view = doc_view(docs)
    ids = view.groupBy("doc_id").count()
    plain = ids.where("doc_id is null or count > 1").isEmpty()
    keyed = view.select((F.col("doc_id") if plain else F.xxhash64("doc_id", "text")).alias("key"), "doc_id", "text")
    packed = keyed.mapInArrow(_packed, "key long, doc_id long, text binary").where("key is not null")
    # no key is null, but with this both joins deal the texts by one and the same exchange
    packed = packed.select("key", "text", *([] if plain else ["doc_id"]))

    def shared(sent: DataFrame, before: int) -> DataFrame:
        dealt = sent.repartition(F.coalesce("h", "key")).sortWithinPartitions("h", "at")
        found = dealt.mapInArrow(_shared_batches(before), "key long, span long")
        return found.groupBy("key").agg(F.collect_list("span").alias("spans"))

    rows = "h long, key long, at long"
    near = shared(keyed.select("key", "text").mapInArrow(_anchor_batches(size), rows), PERIOD - 1)
    again = shared(packed.join(near, "key").select("key", "text", "spans").mapInArrow(_window_batches(size), rows), 0)
    return packed.join(again, "key", "left").select(F.col("key").alias("doc_id") if plain else "doc_id", "text", "spans").mapInArrow(_removed_batches(size), "doc_id long, n_words long, n_removed long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
