"""Exact token counts of every prefix by dynamic programming over token ends."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, doc_view

SPACE = "▁"
#: Segments and token pairs that a worker keeps.
KEPT_SEGMENTS, KEPT_PAIRS = 1_200_000, 500_000


class PrefixCounter:
    """Token counts of all prefixes of a text under a BPE model with byte fallback.

    The last token of each prefix is found from those of shorter prefixes: a token t ends the prefix if it and the last
    token before it stay apart when the two are encoded as one string. Merges never cross from another character into a
    word mark, so texts are cut before such marks and segments are solved once.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in usual}
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a word mark after another character: texts can't be cut at word marks")
        #: Neighbours inside some piece: between any others every encoding has a token end.
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        #: Steps of the counts of each segment solved so far, a signed byte a character.
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def apart(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self._apart(a, b)
        return got

    def _apart(self, a: str, b: str) -> bool:
        """Whether a and b, merged by the model's scores from single characters, end as the two tokens a, b."""
        if a[-1] + b[0] not in self.inside:
            return True
        parts, score, none = list(a + b), self.score.get, float("-inf")
        gains = [score(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while gains and (best := max(gains)) > none:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
        return parts == [a, b]

    def solve(self, segment: str) -> bytes:
        """By how much the count changes at each character of a segment: what a token gains or a merge loses.

        One token alone can end a prefix; what is most often right is tried first: the last token made longer, then the
        new character alone, then all others.
        """
        steps, ends, last, low, i = bytearray(), [0], [""], 0, 0
        pairs, score, apart, inside, longest = self.pairs, self.score, self.apart, self.inside, self.longest
        before = t = ""
        for j, c in enumerate(segment, 1):
            if before + c not in inside:
                low = j - 1
            before = c
            if i < low:
                i = low
            t = segment[i:j]
            if t in score and (not (a := last[i]) or (pairs[a, t] if (a, t) in pairs else apart(a, t))):
                k = i
            else:
                for k in (j - 1, *range(j - longest if j - longest > low else low, j - 1)):
                    t = segment[k:j]
                    if t in score and (not (a := last[k]) or (pairs[a, t] if (a, t) in pairs else apart(a, t))):
                        break
                else:  # no piece has this character: its bytes are tokens, and nothing merges with them
                    steps.append(len(c.encode()))
                    ends.append(ends[-1] + len(c.encode()))
                    last.append("")
                    i = j
                    continue
            n = ends[k] + 1
            steps.append((n - ends[-1]) & 255)
            ends.append(n)
            last.append(t)
            i = k
        return bytes(steps)

    def segment(self, segment: str) -> bytes:
        """``solve`` of a segment, kept where it is short."""
        got = self.known.get(segment)
        if got is None:
            got = self.solve(segment)
            if len(segment) <= 60:
                if len(self.known) > KEPT_SEGMENTS:
                    self.known.clear()
                self.known[segment] = got
        return got

    def segments(self, text: str) -> list[str]:
        """The normalised text, cut before each word mark that follows another character."""
        if not text:
            return []
        parts = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]
        if all(parts):
            return [SPACE + p for p in parts]
        out, marks = [], ""
        for p in parts:
            marks += SPACE
            if p:
                out.append(marks + p)
                marks = ""
        return out + [marks] * bool(marks)

    def prefixes(self, text: str) -> bytes:
        """Steps of the token counts of a text's prefixes, a signed byte a character."""
        parts = self.segments(text)
        if not parts:
            return b""
        try:
            steps = b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            steps = b"".join(map(self.segment, parts))
        # the mark that the model puts before a text is no character of it
        return bytes([(steps[0] + steps[1]) & 255]) + steps[2:]


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One per worker: what one task has solved serves the next."""
    return PrefixCounter(path)


def _prefix_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            steps = pa.array([counter.prefixes(x or "") for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), steps], ["doc_id", "n_bytes", "steps"])

    return run


def prefix_table(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_bytes, steps``: the token count of every prefix of every text, stored as its steps from character to
    character in signed bytes (a token gains one, a merge loses some), which compress well.

    Null and empty texts have no prefixes; repeated rows stay repeated; an empty table gives none. Counts come from
    segments, so a worker solves each frequent segment once, in linear time. The table is Parquet in the shared folder.
    """
    view = doc_view(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return cut(view.mapInArrow(_prefix_batches(model), "doc_id long, n_bytes long, steps binary"), "prefixes")


def counts_of(steps: bytes) -> np.ndarray:
    """Entry k: tokens of the first k characters (0 for none)."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


def characters_within(steps: bytes, budget: int) -> int:
    """Most characters from the start whose tokens fit the budget, read from a stored table."""
    return int(np.flatnonzero(counts_of(steps) <= budget)[-1])


def _answer_batches(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fits = [], []
            for x in b.column(2).to_pylist():
                total = int(np.frombuffer(x, np.int8).sum(dtype=np.int64))
                n.append(total)
                fits.append(len(x) if total <= budget else characters_within(x, budget))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([t > budget for t in n]), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return run


def within(table: DataFrame, budget: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars`` (most characters within the budget) from a prefix table alone."""
    return table.mapInArrow(_answer_batches(budget), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return within(prefix_table(docs, public_tokenizers.path("piece_bpe_32k.model")), 4096)
