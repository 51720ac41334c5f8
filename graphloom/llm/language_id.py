"""Language identification in two steps: the family by linear SVMs, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import doc_view, mapped, utf8

#: Hashed byte trigrams; training documents per language and at most in all.
DIMS, PER_LANGUAGE, MAX_DOCS = 8192, 400, 3000
UNDETERMINED = "und"
#: Language families by ISO 639-1 code. A language of no listed family is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "mr", "ne", "bn", "ur", "pa", "gu"),
    "baltic": ("lt", "lv"),
    "semitic": ("ar", "he", "mt"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if re.search(rb"[A-Za-z]", text):
        return True
    return any(m.group().isalpha() for m in _LETTER.finditer(text.decode("utf-8", "replace")))


def trigram_counts(text: bytes | None) -> np.ndarray:
    """Counts of the hashed byte trigrams of the whole text; all but letters counts as one separator."""
    raw = np.frombuffer(b" " + (text or b"").translate(_FOLD) + b" ", np.uint8)
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw) - 2, 1 << 20):
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        key = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        out += np.bincount((key * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMS)
    return out


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length 1."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent; costs weigh both classes alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x**2).sum(axis=1)
    most = cost * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    r = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in r.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1].astype(np.float32), float(w[-1])


class Model:
    """One column of weights per family, then one per pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = [FAMILY_OF.get(a, a) for a in self.langs]
        self.families = sorted(set(family))
        self.members = [[i for i, f in enumerate(family) if f == name] for name in self.families]
        lang = np.array([self.langs.index(a) for a in langs])
        own = np.array([self.families.index(family[i]) for i in lang])
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        fits = [linear_svm(x, np.where(own == f, 1, -1)) if len(self.families) > 1 else (np.zeros(DIMS, np.float32), 0.0) for f in range(len(self.families))]
        for a, b in self.pairs:
            rows = (lang == a) | (lang == b)
            fits.append(linear_svm(x[rows], np.where(lang[rows] == a, 1, -1)))
        self.w, self.b = np.stack([w for w, _ in fits], axis=1), np.array([b for _, b in fits], np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.w + self.b
        share = 1 / (1 + np.exp(-4 * margins))
        fam = margins[:, : len(self.families)]
        best = fam.argmax(axis=1)
        weight = np.exp(4 * (fam - fam.max(axis=1, keepdims=True)))
        score = 1 / weight.sum(axis=1)
        votes, sums = np.zeros((len(x), len(self.langs))), np.zeros((len(x), len(self.langs)))
        for k, (a, b) in enumerate(self.pairs):
            p = share[:, len(self.families) + k]
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            sums[:, a] += p
            sums[:, b] += 1 - p
        out = []
        for i, f in enumerate(best):
            m = self.members[f]
            win = max(m, key=lambda a, i=i: (votes[i, a], sums[i, a]))
            out.append(self.langs[win])
            if len(m) > 1:
                score[i] *= sums[i, win] / (len(m) - 1)
        return out, np.clip(score, 0.0, 1.0)


def learn(docs: DataFrame) -> Model | None:
    """Fit on a bounded sample of labelled rows: whole texts of those whose crc32(doc_id) mod 4 is not 2.

    About PER_LANGUAGE documents per language, MAX_DOCS in all, chosen by a hash of doc_id at the rate that each
    language's count gives. Every language is learned: the more there are, the fewer documents of each, one at least.
    No labelled text at all: no model.
    """
    labelled = doc_view(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 != 2").where(F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**30))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(place).alias("first")).collect()
    if not counts:
        return None
    each = max(1, min(PER_LANGUAGE, MAX_DOCS // len(counts)))
    below = [(r["lang"], max(int(2**30 * min(1.0, each / r["count"])), r["first"] + 1)) for r in counts]
    rates = F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below long"))
    sample = labelled.join(rates, "lang").where(place < F.col("below")).select("doc_id", "text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, blobs = [], []
            for i, t in enumerate(utf8(b)):
                if has_letter(t):
                    c = trigram_counts(t)
                    at = np.flatnonzero(c)
                    keep.append(i)
                    blobs.append(np.stack([at, c[at]]).astype("<u4").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(blobs, pa.binary())], ["doc_id", "lang", "counts"])

    rows = sorted(sample.mapInArrow(vectors, "doc_id long, lang string, counts binary").collect())
    if not rows:
        return None
    x = np.zeros((len(rows), DIMS), np.float32)
    for k, r in enumerate(rows):
        at, n = np.frombuffer(r["counts"], "<u4").reshape(2, -1)
        x[k, at] = np.sqrt(n / n.sum())
    return Model(x, [r["lang"] for r in rows])


def predicted(model: Model | None, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; null or without a letter, or no model at all: ``und``, 0."""
    pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    for at in range(0, len(rows), 128):
        part = rows[at : at + 128]
        langs, score[part] = model.predict(unit(np.stack([trigram_counts(texts[i]) for i in part])))
        for i, a in zip(part, langs, strict=True):
            pred[i] = a
    return pred, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from the whole text and nothing else."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = predicted(shared.value, utf8(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return doc_view(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, all columns kept; without a model all whose text has a letter."""
    model = learn(docs)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            keep = [has_letter(t) for t in texts] if shared.value is None else [p != UNDETERMINED for p in predicted(shared.value, texts)[0]]
            yield b.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select("doc_id", F.expr("crc32(cast(doc_id as string)) % 4 = 2").alias("held_out"), "lang_pred", "score")
