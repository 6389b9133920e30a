"""A batch's distinct runs and their contexts: as numpy's own functions give them, without sorting all places by place."""

import numpy as np
import pytest

from bondsight.llm import suffixtree as st

RNG = np.random.default_rng(7)
MANY = RNG.integers(0, 40, 5000).astype(np.uint64) << np.uint64(50)


@pytest.mark.parametrize("values", [MANY[:n] for n in (0, 1, 2, 3, 4096, 4097)] + [RNG.integers(0, 2**63, 3000).astype(np.uint64)])
@pytest.mark.parametrize("alike", [False, True])
def test_distinct_is_unique(monkeypatch, values, alike):
    if alike:  # hashes that all begin the same: kinds come mixed
        monkeypatch.setattr(st, "mixed", np.zeros_like)
    kinds, of = st._distinct(values)
    want, own = np.unique(values, return_inverse=True)
    assert kinds.tolist() == want.tolist() and of.tolist() == own.tolist() and of.dtype == np.int32


def test_only_kinds_are_sorted_by_place(monkeypatch):
    sorted_, plain = [], np.argsort
    monkeypatch.setattr(st.np, "argsort", lambda x, *a, **b: (sorted_.append(len(x)), plain(x, *a, **b))[1])
    st._distinct(MANY)
    assert max(sorted_) <= len(np.unique(MANY))


def test_contexts_in_order():
    known, depth = RNG.integers(0, 2**63, 2000).astype(np.uint64) % np.uint64(70_000), RNG.integers(0, 4, 2000).astype(np.uint8)
    for n, (some, begin) in enumerate(st.by_context(known, depth)):
        low = st._low(known[some], n + 1)
        assert sorted(some.tolist()) == np.flatnonzero(depth == n).tolist()
        assert low[begin[:-1]].tolist() == np.unique(low).tolist() and begin[-1] == len(some)


@pytest.mark.parametrize("kind", [np.uint8, np.uint32, np.uint64, np.int64, np.float32])
def test_planes_come_back(kind):
    for n in (0, 1, 1000):
        values = RNG.integers(0, 200, n).astype(kind)
        assert st._unplaned(st._planes(values), kind).tolist() == values.tolist()


def test_buckets_keep_their_order():
    for buckets in (1, 27, 1 << 16, 1 << 17):
        hashes = RNG.integers(0, 2**63, 3000).astype(np.uint64)
        order, bucket = st._by_bucket(hashes, buckets)
        assert order.tolist() == sorted(range(3000), key=lambda i: (int(hashes[i]) % buckets, i)) and bucket.tolist() == sorted(int(h) % buckets for h in hashes)
