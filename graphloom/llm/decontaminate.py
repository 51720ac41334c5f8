"""Benchmark decontamination: one FM-index per shard of training documents, searched for windows of benchmark words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import doc_view, mapped

#: Words of a window; words of one shard; distance of sampled suffix positions; bytes of benchmark text in one block.
WINDOW, SHARD_WORDS, SAMPLE, BLOCK_BYTES = 10, 400_000, 16, 8 << 20
#: A-Z become a-z; 0-9, a-z and all bytes from \x80 on are word bytes; the others separate words.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows_of(words: list, size: int = WINDOW) -> list[tuple]:
    """All runs of ``size`` words; shorter texts, but not empty ones, are one window."""
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Phrases:
    """The windows of one block of benchmark items, by word number (from 1), as a padded matrix."""

    def __init__(self, items: list[tuple[int, bytes | None]], size: int):
        self.vocab: dict[bytes, int] = {}
        by_window: dict[tuple, set[int]] = {}
        for item, text in items:
            for w in windows_of([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], size):
                by_window.setdefault(w, set()).add(item)
        self.items = [sorted(x) for x in by_window.values()]
        self.lengths = np.array([len(w) for w in by_window], np.int64)
        self.words = np.zeros((len(by_window), size), np.int64)
        for i, w in enumerate(by_window):
            self.words[i, : len(w)] = w


class FMIndex:
    """Backward search over integers (0 ends a run; every end sorts by its place), wavelet-tree ranks, sampled suffixes."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = self.n = len(text)
        order = self._suffixes(text)
        last = text[order - 1]
        self.levels: list[tuple[np.ndarray, int]] = []
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):  # wavelet matrix, top bit first
            ones = (last >> bit) & 1
            counts = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((counts, n - int(counts[-1])))
            last = np.concatenate([last[ones == 0], last[ones == 1]])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.top = len(self.levels) - 1
        self.first = self._descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        starts = np.ones(n, bool)
        starts[1:] = text[:-1] == 0
        sampled = starts | (np.arange(n) % SAMPLE == 0)
        self.marked = sampled[order]
        self.place = np.where(self.marked, order, -1)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; each round only sorts what earlier ones left equal.

        A run's end is unique, so suffixes differ at their run's end at the latest.
        """
        n = len(text)
        ends = text == 0
        symbol = text + np.count_nonzero(ends)
        symbol[ends] = np.arange(np.count_nonzero(ends))
        size = int(symbol.max()) + 1
        key, step = symbol, 1
        while size < 2**31:  # two, four, ... symbols at once; past a run's end nothing matters any more
            key = key * size
            key[:-step] += key[step:] // size
            size, step = size * size, step * 2
        order = np.argsort(key, kind="stable")
        slots, key = np.arange(n), key[order]
        rank = np.empty(n, np.int64)
        while True:
            head = np.ones(len(slots) + 1, bool)
            head[1:-1] = key[1:] != key[:-1]
            items = order[slots]
            rank[items] = np.maximum.accumulate(np.where(head[:-1], slots, 0))
            slots = slots[~(head[:-1] & head[1:])]
            if not len(slots):
                return order
            items = order[slots]
            key = rank[items] * n + rank[items + step]
            again = np.argsort(key, kind="stable")
            order[slots], key = items[again], key[again]
            step *= 2

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (counts, zeros) in enumerate(self.levels):
            ones = counts[at]
            at = np.where((symbol >> (self.top - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first ``at`` places of the transform."""
        return self._descend(symbol, at) - self.first[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((k < lengths) & (lo < hi))
            c = phrases[on, k]
            lo[on] = self.before[c] + self.rank(c, lo[on])
            hi[on] = self.before[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffix-array rows: steps back to the next sampled suffix, plus the steps."""
        rows, steps, out = rows.copy(), 0, np.full(len(rows), -1)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.marked[rows[todo]]
            out[todo[here]] = self.place[rows[todo[here]]] + steps
            todo = todo[~here]
            steps += 1
            symbol, at = np.zeros(len(todo), np.int64), rows[todo]
            for k, (counts, zeros) in enumerate(self.levels):
                bit = (counts[at + 1] - counts[at]).astype(bool)
                symbol = symbol * 2 + bit
                at = np.where(bit, zeros + counts[at], at - counts[at])
            rows[todo] = self.before[symbol] + at - self.first[symbol]
        return out


def shard_hits(ids: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Per document (word numbers, one past the last of the benchmark's for all other words): merged hit spans
    [start, end) in words, and the items that occur. The index holds every word of the shard; documents end with 0."""
    hits: list[tuple[list[tuple[int, int]], list[int]]] = [([], []) for _ in ids]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    if not lengths.sum() or not len(phrases.lengths):
        return hits
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    text = np.insert(np.concatenate(ids), bounds[1:], 0)
    index = FMIndex(text, len(phrases.vocab) + 1)
    lo, hi = index.search(phrases.words, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    which = np.repeat(found, (hi - lo)[found])
    if not len(which):
        return hits
    at = index.locate(np.concatenate([np.arange(lo[k], hi[k]) for k in found]))
    doc = np.searchsorted(bounds + np.arange(len(bounds)), at, "right") - 1
    at -= doc  # every document before it has an end
    n = int(bounds[-1])
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    hit = np.zeros(n + 2, np.int8)
    hit[1:-1] = np.cumsum(cover[:-1]) > 0
    pairs = np.unique(doc * len(phrases.lengths) + which)
    for d, w in zip((pairs // len(phrases.lengths)).tolist(), (pairs % len(phrases.lengths)).tolist(), strict=True):
        hits[d][1].extend(phrases.items[w])
    for d in np.unique(doc).tolist():
        own = hit[bounds[d] : bounds[d + 1] + 2].copy()
        own[0] = own[-1] = 0
        edge = np.diff(own)
        hits[d] = (list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)), sorted(set(hits[d][1])))
    return hits


SPANS = "array<struct<start:long,end:long>>"
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])


def _both(a: tuple[list, list], b: tuple[list, list]) -> tuple[list[tuple[int, int]], list[int]]:
    """Hits of two blocks of the benchmark in one document."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(a[0] + b[0]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out, sorted({*a[1], *b[1]})


def _searched(batches: Iterator[pa.RecordBatch], at: int, phrases: list) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], list[int], list]]:
    """Shards of rows: the rows, their texts (column ``at``), numbers of words, and hits over all blocks, row by row."""

    def numbers(block, text):
        other = len(block) + 1
        return np.array([block.get(w, other) for w in words_of(text)], np.int64)

    def done(parts, texts, ids):
        hits = shard_hits(ids, phrases[0].value)
        for held in phrases[1:]:
            _only(phrases, held)
            block = held.value
            more = shard_hits([numbers(block.vocab, t) for t in texts], block)
            hits = [_both(x, y) for x, y in zip(hits, more, strict=True)]
        _only(phrases, phrases[0])
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0], texts, [len(x) for x in ids], hits

    parts, texts, ids, n = [], [], [], 0
    for b in batches:
        start = 0
        for i, text in enumerate(b.column(at).cast(pa.binary()).to_pylist()):
            texts.append(text)
            ids.append(numbers(phrases[0].value.vocab, text))
            n += len(ids[-1])
            if n >= SHARD_WORDS:
                yield done([*parts, b.slice(start, i + 1 - start)], texts, ids)
                parts, texts, ids, n, start = [], [], [], 0, i + 1
        if start < b.num_rows:
            parts.append(b.slice(start))
    if texts:
        yield done(parts, texts, ids)


def _only(phrases: list, held) -> None:
    """A worker keeps one block in memory; the others are read again from its copy of the broadcast."""
    for other in phrases:
        if other is not held and hasattr(other, "_value"):
            del other._value


def _hit_batches(phrases: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, n_words, hits in _searched(batches, 1, phrases):
            spans = [[{"start": s, "end": e} for s, e in h[0]] for h in hits]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _HITS.field("spans").type), pa.array([h[1] for h in hits], _HITS.field("items").type)], schema=_HITS)

    return run


def _blocks(benchmark: DataFrame, size: int, item_col: str = "item_id") -> list:
    """Broadcasts of the benchmark's blocks of about BLOCK_BYTES; only one block at a time is on the driver."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null and length(text) > 0")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = max(1, -(-total // BLOCK_BYTES)), []
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toLocalIterator()
        out.append(spark.sparkContext.broadcast(Phrases([(r.item, bytes(r.text)) for r in rows], size)))
        if blocks > 1:
            _only(out, None)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id") -> DataFrame:
    """``doc_id, n_words, spans`` (merged, in words, end exclusive), ``items`` (sorted), one row per input row.

    Null and empty texts have no words and no hits; benchmark rows without words or with a null item are left out; an
    empty table of documents gives none. The benchmark is cut into blocks of about BLOCK_BYTES; each shard of documents
    is searched for one block after the other, and a row's hits are merged where it is read: no shuffle, and rows that
    share a doc_id or have none keep their own.
    """
    return doc_view(docs).mapInArrow(_hit_batches(_blocks(benchmark, size, item_col)), f"doc_id long, n_words long, spans {SPANS}, items array<long>")


def remove_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, without the hit words; ones with no word left go, untouched ones stay as they are.

    Each row is searched and cut in one place, whatever its doc_id. ``n_chars``, if there is one, follows the new text.
    """
    phrases, at, width = _blocks(benchmark, size), docs.columns.index("text"), len(docs.columns)

    def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raws, n_words, hits in _searched(batches, at, phrases):
            texts, left = [], []
            for raw, n, (own, _) in zip(raws, n_words, hits, strict=True):
                if own:
                    where = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
                    out, last = [], 0
                    for s, e in own:
                        out.append(raw[last : where[s][0]])
                        last = where[e - 1][1]
                    raw = b"".join(out) + raw[last:]
                left.append(not own or sum(e - s for s, e in own) < n)
                texts.append(raw)
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else b.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names).filter(pa.array(left, pa.bool_()))

    out = mapped(docs, cut_spans)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    got = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
