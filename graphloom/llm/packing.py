"""Best-fit packing of token pieces: local best-fit per partition, then tree-merges of the bins that stay underfull."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, doc_view

#: Tokens a bin may lack and still count as nearly full; partitions that meet in one merge; bins that one task merges.
SLACK, FAN_IN, BINS_PER_TASK = 2, 8, 200_000
#: Pieces that are packed together locally, and word encodings that a worker keeps.
LOCAL_ITEMS, KEPT_WORDS = 100_000, 400_000
ITEM = "array<struct<doc_id:long,piece:int,start:long,length:int,crc:long>>"


class Encoder:
    """Byte-level BPE ids as little-endian uint32 bytes, word by word from a bounded store.

    A space between two characters that aren't white always starts a new pre-token, so the text may be cut there; texts
    with other white runs next to such spaces are encoded whole by the library.
    """

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if "<|" in text:  # special strings are found in the text before it is cut
            return self.whole(text)
        if not all(rest) or not first:
            return self.whole(text)
        out = [self.word(first)]
        try:
            out += map(self.words.__getitem__, rest)
        except KeyError:
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            for w in rest:
                if w not in self.words:
                    self.words[w] = b"" if w[0].isspace() or w[-1].isspace() else array("I", self.one(" " + w)).tobytes()
            out[1:] = map(self.words.__getitem__, rest)
        if not all(out):  # b"" marks a word with white at an end: its neighbours matter
            return self.whole(text)
        return b"".join(out)

    def word(self, first: str) -> bytes:
        return b"" if first[-1].isspace() else self.whole(first)


@lru_cache(maxsize=1)
def _encoder(path: str, ranks: str) -> Encoder:
    """One per worker: what one task has encoded serves the next."""
    return Encoder(path, ranks)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of positions in ``sizes``. Bins are kept by what they can still take."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = some >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r - s:
            room[r - s].append(b)
            some |= 1 << (r - s)
    return bins


_BIN = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("items", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64())])))])


def _local_batches(path: str, ranks: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def bins(rows: np.ndarray, chosen: list[np.ndarray], serial: int) -> pa.RecordBatch:
        order = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in chosen])]).astype(np.int32)
        r = rows[order]
        items = pa.StructArray.from_arrays([pa.array(r[:, 0], mask=r[:, 5] == 1), pa.array(r[:, 1].astype(np.int32)), pa.array(r[:, 2]), pa.array(r[:, 3].astype(np.int32)), pa.array(r[:, 4])], ["doc_id", "piece", "start", "length", "crc"])
        fill = np.add.reduceat(r[:, 3], offsets[:-1]).astype(np.int32) if len(chosen) else np.zeros(0, np.int32)
        ids = (TaskContext.get().partitionId() << 33) + serial + np.arange(len(chosen))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fill), pa.ListArray.from_arrays(pa.array(offsets), items)], schema=_BIN)

    def pack(rows: list[tuple], serial: int) -> pa.RecordBatch:
        r = np.array(rows, np.int64)
        full = np.flatnonzero(r[:, 3] == capacity)
        part = np.flatnonzero(r[:, 3] < capacity)
        chosen = [full[i : i + 1] for i in range(len(full))] + [part[b] for b in best_fit(r[part, 3], capacity)]
        return bins(r, chosen, serial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, serial = _encoder(path, ranks), [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    rows.append((doc or 0, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), doc is None))
                    start, piece = start + length, piece + 1
            if len(rows) >= LOCAL_ITEMS:
                yield (out := pack(rows, serial))
                rows, serial = [], serial + out.num_rows
        if rows:
            yield pack(rows, serial)

    return run


def _merge_batches(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).combine_chunks().sort_by("bin")  # the same bins in the same order after a lost executor
        fill, ids, items = t["fill"].to_numpy(), t["bin"].to_numpy(), t["items"].combine_chunks()
        chosen = [np.array(b) for b in best_fit(fill, capacity)]
        order = np.concatenate(chosen)
        taken = items.take(pa.array(order))
        sizes = np.diff(taken.offsets.to_numpy())
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in chosen])])
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[[c.min() for c in chosen]]), pa.array(np.add.reduceat(fill[order], bounds[:-1]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), taken.flatten())], schema=_BIN
        )

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` is the library's file, ``ranks`` the same vocabulary as ranks, for single words.
    Each document is its ids plus ``end_id``; only documents over ``capacity`` are cut, the shorter piece first. Null and
    empty texts are one piece of one token; repeated rows are packed as often as they occur; an empty table gives none.

    Round 0 packs where the text is read, without a shuffle: best-fit over each partition's own pieces. Bins that lack
    over SLACK tokens become the items of the next round, FAN_IN partitions to one, until one task packs the rest. A
    round's tasks never hold over about BINS_PER_TASK bins: where that keeps tasks from becoming fewer, other bins meet in
    each round, until one saves less than a bin a task.
    """
    bins = cut(doc_view(docs).mapInArrow(_local_batches(tokenizer, ranks, capacity, end_id), f"bin long, fill int, items {ITEM}"), "bins")
    done, rest = [bins.where(F.col("fill") >= capacity - SLACK)], bins.where(F.col("fill") < capacity - SLACK)
    parts, n, turn = bins.rdd.getNumPartitions(), rest.count(), 0
    while n:
        was, before, turn = n, parts, turn + 1
        parts = max(1, -(-parts // FAN_IN), -(-n // BINS_PER_TASK))
        merged = cut(rest.repartition(parts, F.xxhash64(F.col("bin"), F.lit(turn))).mapInArrow(_merge_batches(capacity), rest.schema), "bins")
        left = merged.where(F.col("fill") < capacity - SLACK)
        n = left.count()
        if parts == 1 or parts >= before and was - n < parts:
            done.append(merged)
            break
        done.append(merged.where(F.col("fill") >= capacity - SLACK))
        rest = left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    placed = out.select(F.col("bin").alias("sequence_id"), "items").select("sequence_id", "items", F.posexplode("items").alias("at", "x"))
    before = F.aggregate(F.slice("items", 1, F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return placed.select("x.doc_id", "x.piece", "x.start", F.col("x.length").cast("long").alias("length"), F.col("x.crc").alias("ids_crc32"), "sequence_id", before.alias("offset"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
