"""A search holds a bounded number of steps at once, also where all fingerprints of a group are near each other."""

import tracemalloc

import numpy as np

from graphloom.llm import simhash_dedup as m


def test_a_group_of_near_copies_is_searched_in_bounded_memory():
    r = np.random.default_rng(1)
    v = np.full(3000, 0x123456789ABCDEF0, np.uint64)
    for _ in range(5):
        v ^= np.uint64(1) << r.integers(0, 54, len(v)).astype(np.uint64)
    v = v[np.argsort(m.gray_rank(v), kind="stable")]
    same = ((1 << 10) - 1) << 54
    tracemalloc.start()
    most, n, total = 0, 0, 0
    for i, j in m.GrayTree(v).pairs(10, same=same):
        assert (i < j).all() and (np.bitwise_count(v[i] ^ v[j]) <= 10).all()
        most, n, total = max(most, len(i)), n + len(i), total + int((i * len(v) + j).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(v) * (len(v) - 1) // 2  # every pair differs in ten bits at most
    assert total == sum(int((i * len(v) + np.arange(i + 1, len(v))).sum()) for i in range(len(v)))
    assert most <= m.SEARCH_ROWS and peak < 60 << 20
