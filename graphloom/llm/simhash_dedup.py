"""SimHash near-duplicates by a Gray-order hierarchical index; near copies of a corpus by exact shingle similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import by_place, cut, doc_view, mix, utf8
from graphloom.llm.components import components
from graphloom.plans.shared import only

#: Fan-out of the index; fingerprints a group may hold before it is split; rows that share one tree.
FANOUT, GROUP_LIMIT, CHUNK = 8, 4096, 8192
#: Steps of a search that are taken at once: where all of a group are near each other, all of its pairs are searched.
SEARCH_ROWS = 1 << 17
#: After so many splits a group has at most 14 free bits, so at most 2**14 distinct fingerprints.
LEVELS = 4
#: Near copies of a corpus: words of a shingle; least similarity, as a fraction; shingles of the texts that one task compares
#: with as many others.
NEAR_WIDTH, NEAR_NUM, NEAR_DEN, BLOCK_VALUES = 5, 4, 5, 1 << 20
#: Their fingerprints: differing bits at most, texts in a group on average, and the chance that a pair of least similarity is
#: near in none of the fingerprints.
NEAR_RADIUS, NEAR_GROUP, NEAR_MISS = 11, 256, 1e-6


# --- fingerprints -----------------------------------------------------------------------------------------------


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if set in over half of the XXH64 values of the shingles; no words: 0."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends[: n - width + 1] - np.fromiter(map(len, words[: n - width + 1]), np.int64, n - width + 1) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprint_batches(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, width, seed) for t in utf8(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long); null or blank text: 0. Repeated rows stay repeated."""
    return doc_view(docs).mapInArrow(_fingerprint_batches(width, seed), "doc_id long, fp long")


# --- the index --------------------------------------------------------------------------------------------------


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


class GrayTree:
    """Fingerprints in Gray order; each upper node keeps the bits on which all below agree and its parent doesn't.

    A search carries the differences counted so far and leaves a whole group as soon as they exceed the radius.
    """

    def __init__(self, ordered: np.ndarray):
        n = len(ordered)
        self.pats, self.masks, self.spans = [ordered], [np.full(n, 2**64 - 1, np.uint64)], [1]
        while len(self.pats[-1]) > FANOUT:
            at = np.arange(0, len(self.pats[-1]), FANOUT)
            both, any_ = np.bitwise_and.reduceat(self.pats[-1], at), np.bitwise_or.reduceat(self.pats[-1], at)
            mask = np.bitwise_and.reduceat(self.masks[-1], at) & ~(both ^ any_)
            self.pats.append(both & mask)
            self.masks.append(mask)
            self.spans.append(self.spans[-1] * FANOUT)
        self.own = [m & ~np.repeat(up, FANOUT)[: len(m)] for m, up in zip(self.masks, self.masks[1:], strict=False)] + [self.masks[-1]]
        self.n = n

    def pairs(self, radius: int, block: int = 1024, same: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i < j, at ``radius`` or fewer differing bits, none of them in ``same``, from few to SEARCH_ROWS at a time.

        Of queries that go on in more than SEARCH_ROWS nodes of a level, one half waits for the other.
        """
        values, top = self.pats[0], len(self.pats) - 1
        for lo in range(0, self.n, block):
            q = np.arange(lo, min(lo + block, self.n))
            waiting = [(top, np.repeat(q, len(self.pats[top])), np.tile(np.arange(len(self.pats[top])), len(q)), np.zeros(len(q) * len(self.pats[top]), np.uint8))]
            while waiting:
                level, q, node, seen = waiting.pop()
                if len(q) > SEARCH_ROWS:
                    half = len(q) // 2
                    waiting += [(level, q[half:], node[half:], seen[half:]), (level, q[:half], node[:half], seen[:half])]
                    continue
                differ = (values[q] ^ self.pats[level][node]) & self.own[level][node]
                seen = seen + np.bitwise_count(differ)
                keep = (seen <= radius) & ((node + 1) * self.spans[level] > q + 1)
                if same:
                    keep &= differ & np.uint64(same) == 0
                node, q, seen = node[keep], q[keep], seen[keep]
                if not level:
                    yield q, node
                elif len(q):
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, seen = np.repeat(q, FANOUT), np.repeat(seen, FANOUT)
                    inside = node < len(self.pats[level - 1])
                    waiting.append((level - 1, q[inside], node[inside], seen[inside]))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the classes that the pairs (a, b) link; a label is the smallest position of its class."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(label, up := label[label]):
            label = up


def _link_batches(radius: int):
    def links(rep: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
        rep_, v_ = np.concatenate(rep), np.concatenate(v).view(np.uint64)
        order = np.argsort(gray_rank(v_), kind="stable")
        rep_, label = rep_[order], np.arange(len(order))
        for i, j in GrayTree(v_[order]).pairs(radius):
            label = join_labels(label, i, j)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rep_[at]), pa.array(rep_[label[at]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, v, held, last = [], [], 0, None
        for b in batches:
            path, key, r, x = (b.column(k).to_numpy(zero_copy_only=False) for k in ("path", "key", "rep", "v"))
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (key[1:] != key[:-1])
            new[:1] = (path[0], key[0]) != last if len(path) else True
            at, last = 0, (path[-1], key[-1]) if len(path) else last
            for edge in np.flatnonzero(new):  # trees end between groups, never inside one
                if held + edge - at >= CHUNK:
                    rep.append(r[at:edge]), v.append(x[at:edge])
                    yield links(rep, v)
                    rep, v, held, at = [], [], 0, edge
            rep.append(r[at:]), v.append(x[at:])
            held += len(r) - at
        if held:
            yield links(rep, v)

    return run


_LOW = "(case when free = 64 then -1L else shiftleft(1L, free) - 1 end)"
_ROT = f"((v & ~{_LOW}) | ((shiftleft(v & {_LOW}, s) | shiftrightunsigned(v & {_LOW}, free - s)) & {_LOW}))"


def _split(rows: DataFrame) -> DataFrame:
    """Three rows for each: every third of the free bits, in turn, moves to the top of them and joins the key.

    Two values at two or fewer differing bits agree on at least one third, so they meet in at least one group.
    """
    third, rest = "int(ceil(free / 3))", "int(ceil((free - ceil(free / 3)) / 2))"
    cuts = F.expr(f"array(struct(0 as s, {third} as w, 0 as j), struct({third} as s, {rest} as w, 1 as j), struct({third} + {rest} as s, free - {third} - {rest} as w, 2 as j))")
    out = rows.select("rep", "v", "free", "path", F.inline(cuts)).select("rep", F.expr(_ROT).alias("v"), F.expr("free - w").cast("int").alias("free"), F.expr("path * 3 + j + 1").cast("int").alias("path"))
    return out.withColumn("key", F.expr("shiftrightunsigned(v, free)"))


def links(reps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct ``rep, fp`` -> edges ``a, b`` whose classes are those of all pairs within ``radius`` (0 to 2) bits.

    Groups by a shared third of the bits that hold over GROUP_LIMIT fingerprints are split again by thirds of what is
    left; after LEVELS splits so few bits are free that a group is small whatever the data. Each group is searched
    by its own part of a Gray-order tree and gives a spanning forest of its links, never all its pairs.
    """
    rows = _split(reps.select("rep", F.col("fp").alias("v"), F.lit(64).alias("free"), F.lit(0).alias("path")))
    ready: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        hot = rows.groupBy("path", "key").count().where(F.col("count") > GROUP_LIMIT).select("path", "key")
        if level == LEVELS or (hot := cut(hot, "hot")).isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, ["path", "key"], "left_anti"))
        rows = _split(rows.join(hot, ["path", "key"], "left_semi"))
    found: DataFrame | None = None
    for part in ready:
        part = part.repartition("path", "key").sortWithinPartitions("path", _gray("v")).select("path", "key", "rep", "v")
        part = part.mapInArrow(_link_batches(radius), "a long, b long")
        found = part if found is None else found.union(part)
    return found


def _gray(name: str) -> Column:
    """Order key equal to the unsigned Gray rank: the rank with its top bit turned, as longs compare signed."""
    c = F.col(name)
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c.bitwiseXOR(F.lit(-(2**63)))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` (smallest doc_id linked to it, itself included), one row per input row.

    Null, empty and blank texts share fingerprint 0 and link like any other; rows with a null doc_id are dropped; an
    empty table gives an empty table. Exact copies and equal fingerprints collapse to one node before the search.
    """
    fps = cut(fingerprints(docs, width, seed).where("doc_id is not null"), "fp")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "rep")
    comp = components(links(reps, radius))
    named = reps.join(comp, reps.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# --- near copies of a corpus ------------------------------------------------------------------------------------


def shingle_set(text: bytes | None, width: int = NEAR_WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; fewer words than ``width``: one of all; no words: none."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - width]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets' common share (Jaccard) is at least NEAR_NUM / NEAR_DEN; both empty: yes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * NEAR_DEN >= NEAR_NUM * (len(a) + len(b) - both)


def near_plan(n: int) -> tuple[int, int]:
    """For ``n`` texts: by how many leading bits a fingerprint's groups are formed, and how many fingerprints each text has.

    Two sets of similarity s have a cosine of 2s / (1 + s), and a bit of their fingerprints differs with a chance of the angle
    over pi. A fingerprint finds them if the leading bits agree and at most NEAR_RADIUS others differ.
    """
    bits = min(24, max(4, math.ceil(math.log2(max(n, 1) / NEAR_GROUP))))
    p = math.acos(2 * NEAR_NUM / (NEAR_NUM + NEAR_DEN)) / math.pi
    found = (1 - p) ** bits * sum(math.comb(64 - bits, k) * p**k * (1 - p) ** (64 - bits - k) for k in range(NEAR_RADIUS + 1))
    return bits, math.ceil(math.log(NEAR_MISS) / math.log1p(-found))


_SALTS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, (2, 4096), dtype=np.uint64)


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows have each bit of their words, in the order of the bits: full adders on whole words."""
    out, level, shift = np.zeros(rows.shape[1] * 64, np.int64), rows, 0
    while len(level):
        carries = []
        while (third := len(level) // 3) or len(level) == 2:
            if third:
                a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
                either = a ^ b
                carries.append((a & b) | (c & either))
                level = np.concatenate([either ^ c, level[3 * third :]])
            else:
                carries.append(level[:1] & level[1:])
                level = level[:1] ^ level[1:]
        out += np.unpackbits(level[0].astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << shift
        level, shift = np.concatenate(carries) if carries else level[:0], shift + 1
    return out


def near_prints(shingles: np.ndarray, tables: int) -> np.ndarray:
    """SimHash fingerprints of 64 bits, one for each of as many hashes of the shingles; a bit as in ``simhash``."""
    ones = np.zeros(64 * tables, np.int64)
    for at in range(0, len(shingles), 1024):
        h = (shingles[at : at + 1024, None] ^ _SALTS[0, :tables]) * (_SALTS[1, :tables] | np.uint64(1))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        ones += _bit_counts(h)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")


def _set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each value, which keep the order: a set as it is dealt and compared."""
    return np.ascontiguousarray(shingles.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: sets of shingles are larger than their texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _near_batches(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            sets = [shingle_set(t) for t in utf8(b)]
            prints = pa.array([near_prints(s, tables).tobytes() if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), prints], ["doc_id", "node", "n", "prints"])

    return run


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint of a text, and which of them it is."""
    for b in _few(batches):
        some = [(node, np.frombuffer(x, "<i8")) for node, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x]
        if some:
            v = np.stack([x for _, x in some])
            place = np.tile(np.arange(v.shape[1], dtype=np.int32), len(v))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(v.ravel()), pa.array(np.repeat([node for node, _ in some], v.shape[1]))], ["place", "v", "node"])


def _class_batches(bits: int):
    """Rows sorted by ``place`` and Gray rank -> ``key, node`` of those that a search of their group links to others.

    A group is what shares ``place`` and the leading ``bits``. One of over GROUP_LIMIT texts is not searched: all of it is one
    class. So no link is lost, and no task holds such a group or compares its pairs.
    """
    same = ((1 << bits) - 1) << (64 - bits)

    def keyed(root: np.ndarray, place: int) -> np.ndarray:
        return mix(root.view(np.uint64), np.full(len(root), place, np.uint64)).view(np.int64)

    def classes(v: list[np.ndarray], node: list[np.ndarray], place: int) -> pa.RecordBatch:
        v_, node_ = np.concatenate(v), np.concatenate(node)
        label = np.arange(len(v_))
        for i, j in GrayTree(v_).pairs(NEAR_RADIUS, same=same):
            label = join_labels(label, i, j)
        at = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        return pa.RecordBatch.from_arrays([pa.array(keyed(node_[label[at]], place)), pa.array(node_[at])], ["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, held = ([], []), 0  # whole groups
        group, size, last, hot = ([], []), 0, None, None
        for b in batches:
            place, v, node = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            head = v >> np.uint64(64 - bits)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (head[1:] != head[:-1])) + 1).tolist(), len(v)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if (own := (int(place[lo]), int(head[lo]))) != last:
                    ready[0].extend(group[0]), ready[1].extend(group[1])
                    held += size
                    group, size, hot = ([], []), 0, None
                    if held and (own[0] != last[0] or held >= CHUNK):  # no tree has rows of two places
                        yield classes(*ready, last[0])
                        ready, held = ([], []), 0
                    last = own
                group[0].append(v[lo:hi]), group[1].append(node[lo:hi])
                size += hi - lo
                if size > GROUP_LIMIT or hot is not None:
                    nodes = np.concatenate(group[1])
                    hot = int(nodes[0]) if hot is None else hot
                    yield pa.RecordBatch.from_arrays([pa.array(keyed(np.full(len(nodes), hot), own[0])), pa.array(nodes)], ["key", "node"])
                    group, size = ([], []), 0
        if held + size:
            yield classes(ready[0] + group[0], ready[1] + group[1], last[0])

    return run


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, to be dealt."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in _few(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(t or b"") for t in utf8(b)], pa.binary())], ["doc_id", "text"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in _few(batches):
        sets = [shingle_set(unpack(t)) for t in b.column(1).to_pylist()]
        at = [i for i, (s, node) in enumerate(zip(sets, b.column(2).to_pylist(), strict=True)) if _set_id(s) == node]
        yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(at, pa.int64())), pa.array([packed(sets[i]) for i in at], pa.binary())], ["node", "shingles"])


def _alike_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _few(batches):
        both = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
        at = pa.array([i for i, (x, y) in enumerate(both) if alike(unpacked(x), unpacked(y))], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])


class Block:
    """Sets of one block side by side: how much a set shares with each is counted through all their values in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        values, owner = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def alike(self, s: np.ndarray) -> np.ndarray:
        """Places of the sets that are alike to ``s``."""
        lo, n = np.searchsorted(self.values, s, "left"), np.searchsorted(self.values, s, "right")
        n -= lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(both * NEAR_DEN >= NEAR_NUM * (len(s) + self.sizes - both))


def _block_links(side: np.ndarray, node: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links between the two sides, or within one where there is no other; one for each two classes that they join."""
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    rest = second if len(second) else first
    block, label = Block([sets[k] for k in rest]), np.unique(label, return_inverse=True)[1]
    for x in first:
        for y in rest[block.alike(sets[x])]:
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                yield node[x], node[y]


def _rest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``hub, kind, i, j`` -> links of each such group."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        side, node, label = (t[c].to_numpy() for c in ("side", "node", "label"))
        found = list(_block_links(side, node, label, [unpacked(x) for x in t["shingles"].to_pylist()]))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    held, last = [], None
    for b in batches:
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and last != tuple(keys[lo]):
                yield links(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = tuple(keys[lo])
    if held:
        yield links(held)


def _hubs(rows: DataFrame, bits: int) -> DataFrame:
    """``node, hub``: for each class of a fingerprint's index the one of its nodes that shares most classes with most nodes.

    Two nodes in a class have its hub in common.
    """
    dealt = rows.select("node", "prints").mapInArrow(_print_batches, "place int, v long, node long")
    dealt = dealt.repartition("place", F.shiftrightunsigned("v", 64 - bits)).sortWithinPartitions("place", _gray("v"))
    many = cut(dealt.mapInArrow(_class_batches(bits), "key long, node long").distinct(), "keys")
    c = many.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    weight = many.join(c, "key").groupBy("node").agg(F.sum("c").alias("weight"))
    hub = many.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    return cut(many.join(hub, "key").where("node != hub").select("node", "hub").distinct(), "hubs")


def _rest_links(hubs: DataFrame, nodes: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """``a, b``: links of nodes that aren't in their hub's class: to its class, and among each other.

    Both are dealt in blocks of BLOCK_VALUES shingles or so, and each two blocks meet in a task that has them alone.
    """
    known = nodes.select("node", "n").join(label, "node", "left").select("node", "n", F.coalesce("component", "node").alias("label"))
    rows = hubs.join(known, "node").join(known.select(F.col("node").alias("hub"), F.col("label").alias("own")), "hub")
    rows = rows.select("hub", "node", "n", "label", (F.col("label") != F.col("own")).alias("apart"))
    size = rows.groupBy("hub").agg(*[F.sum(F.when(F.col("apart") == x, v).otherwise(0)).alias(c) for c, x, v in (("na", True, F.lit(1)), ("nm", False, F.lit(1)), ("va", True, F.col("n")), ("vm", False, F.col("n")))])
    size = size.where("na > 1 or na = 1 and nm > 0").select("hub", *[F.ceil(F.col(v) / BLOCK_VALUES).cast("int").alias(c) for c, v in (("ba", "va"), ("bm", "vm"))])
    rows = rows.join(size, "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("apart"), F.col("ba")).otherwise(F.col("bm"))).cast("int"))
    places = "transform(sequence(0, {0} - 1), o -> named_struct('kind', {1}, 'i', {2}, 'j', {3}, 'side', {4}))"
    none = "array()"
    among = places.format("ba", 1, "least(own, o)", "greatest(own, o)", "if(own > o, 1, 0)")
    across = f"if(bm > 0, {places.format('bm', 0, 'own', 'o', 0)}, {none})"
    rows = rows.withColumn("places", F.expr(f"if(apart, concat({across}, {among}), {places.format('ba', 0, 'o', 'own', 1)})"))
    met = rows.select("hub", "node", "label", F.inline("places")).join(sets, "node")
    key = ["hub", "kind", "i", "j"]
    return met.select(*key, "side", "node", "label", "shingles").repartition(*key).sortWithinPartitions(*key, "side", "node").mapInArrow(_rest_batches, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` (smallest doc_id linked to it), one row per input row with a doc_id.

    Two texts are linked if their sets of NEAR_WIDTH-word shingles are alike (``alike``, on the sets' hashes of 48 bits). Texts
    to compare are near in one of their SimHash fingerprints, found by the Gray-order index of each (``near_plan``: a
    pair at 0.8 is near in none with a chance of NEAR_MISS, more
    alike ones more seldom still). Equal sets, as those of null and blank texts, collapse to one node. Each node is
    compared with the hubs of its classes; only those that are in another class than a hub then meet all others of that
    hub, block by block. So no group sends its pairs, and of a large group of near copies few are compared with all.
    """
    view = doc_view(docs).where("doc_id is not null")
    bits, tables = near_plan(view.count())
    rows = cut(view.mapInArrow(_near_batches(tables), "doc_id long, node long, n long, prints binary"), "near")
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "nodes")
    hubs = _hubs(rows, bits)
    asked = hubs.select("node").union(hubs.select("hub")).distinct()
    packed = view.mapInArrow(_packed_batches, "doc_id long, text binary")
    texts = packed.join(nodes.join(asked, "node", "left_semi").select(F.col("rep").alias("doc_id"), "node"), "doc_id").select("doc_id", "text", "node")
    sets = cut(texts.mapInArrow(_set_batches, "node long, shingles binary").dropDuplicates(["node"]), "sets")
    both = hubs.toDF("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = cut(both.mapInArrow(_alike_batches, "a long, b long"), "alike")
    label = components(links)
    label = components(links.union(_rest_links(hubs, nodes, sets, label)))
    labelled = nodes.join(label, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "node").join(labelled.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, all columns kept: that with the smallest doc_id.

    A document is a row's id with its text, so that unlike texts stay whatever ids they share or lack; of rows that are equal
    in both one stays. Rows without an id come after all that have one.
    """
    at = [f"c{docs.columns.index(c)}" for c in ("doc_id", "text")]
    plain = by_place(docs)
    rows = plain.withColumn("row", F.xxhash64(*[x for c in at for x in (F.col(c).isNull(), F.col(c))]))
    found = only(lambda: near_copies(rows.select(F.col("row").alias("doc_id"), F.col(at[1]).alias("text"))), "copies").toDF("row", "class")
    ids = rows.select("row", F.struct(F.col(at[0]).isNull().alias("no_id"), F.col(at[0]).alias("id"), "row").alias("place"))
    first = ids.join(found.distinct(), "row").groupBy("class").agg(F.min("place").alias("place")).select("place.row")
    kept = rows.join(first, "row", "left_semi")
    kept = kept if found.groupBy("row").count().where("count > 1").isEmpty() else kept.dropDuplicates(["row"])
    return kept.select(plain.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
