"""Shared helpers of the training-data operators: document views, byte tables, and tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import cut

__all__ = ["WHITE", "by_place", "cut", "doc_view", "mapped", "mix", "utf8", "word_hashes", "word_spans"]


def doc_view(docs: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and the named extras only: other columns, whatever their names, never reach an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)


def by_place(docs: DataFrame) -> DataFrame:
    """The same columns under names that say their place: no name clashes with an operator's or needs quotes."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def mapped(docs: DataFrame, run) -> DataFrame:
    """``docs.mapInArrow`` for a function that keeps all columns, whatever their names."""
    plain = by_place(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    z = a * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z += b * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(31)
    return z


def _byte_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


def word_spans(raw: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``space`` (by byte value) is False."""
    word = np.empty(len(raw) + 2, np.int8)
    word[0] = word[-1] = 0
    np.logical_not(space[raw], out=word[1:-1].view(bool))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of every byte run: random byte values in a polynomial mod 2**64, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = np.uint64((0x5851F42D4C957F2D * (2 * seed + 1)) & (2**64 - 1) | 1)
    length = ends - starts
    out = np.zeros(len(starts), np.uint64)
    table = _byte_table(seed)
    alive = np.arange(len(starts))
    if int(length.max()) <= 64:
        vals = table[raw]
        for k in range(int(length.max())):  # Horner over byte k of every word still that long
            alive = alive[length[alive] > k] if k else alive
            out[alive] = out[alive] * base + vals[starts[alive] + k]
    else:
        short = length <= 64
        out[short] = word_hashes(raw, starts[short], ends[short], seed) if short.any() else 0
        for i in np.flatnonzero(~short):  # long words: powers once per word
            v = table[raw[starts[i] : ends[i]]]
            p = np.ones(len(v), np.uint64)
            p[1:] = base
            out[i] = (v[::-1] * np.multiply.accumulate(p)).sum(dtype=np.uint64)
            out[i] = mix(out[i : i + 1], length[i : i + 1].astype(np.uint64))[0]
        return out
    return mix(out, length.astype(np.uint64))


#: Bytes \x20 and \x09-\x0D, the separators of words `[^\x20\x09-\x0D]+`.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
