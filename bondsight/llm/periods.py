"""Operator 11, periodic run detection: branching squares from the LCP intervals of each text's suffix array.

Words are what white space (space, tab to carriage return) parts. A run is a stretch of words with smallest period q
(words q apart are equal), at least `exponent` times q and `least` words long, that no neighbouring word extends.

Stretches of 1, 2, 4, ... words are ranked, each round refining only the groups not yet told apart; the last ranks are
the inverse suffix array, and all of them together answer how far two places agree, exactly, in either direction. An
LCP interval of depth d splits at its first least boundary; the suffixes of the smaller side look by the inverse array
whether the suffix d words on, or d words back, lies on the other side. If so, a square of period d begins there that
can't be rotated right. Rotated left as far as words agree, the squares of a run become one; where several periods give
the same stretch the smallest counts. All steps are numpy on a batch of texts; no tree nodes, n log n in the worst case.

Runs never cross rows: a word's code includes its row. Each row has its own result, so repeated rows repeat it. Null,
empty and blank texts have no words and no runs, and an empty table no rows; columns other than doc_id and text are
ignored. A text longer than a batch (2 MB) is a batch of its own; its task takes about 150 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bondsight.llm import shared
from bondsight.llm.arrays import U, covered, flat, joined, mixed, pieces, word_hashes, words

LEAST, EXPONENT = 6, 4
#: Suffixes that look for their square at a time.
AT_ONCE = 1 << 21
RUN = "struct<start:long,length:long,period:long>"
OUT = f"doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<{RUN}>, collapsed string"


def ranked(codes: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: the rank of the 2 ** k words from i, equal for equal stretches; the last: of each suffix."""
    n = len(codes)
    order = np.argsort(codes)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    head = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks, step, at = [rank.astype(np.int32)], 1, order
    while True:
        same = rank[at][1:] == rank[at][:-1]
        at = at[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if not len(at):
            return ranks
        mine, next_ = rank[at], rank[np.minimum(at + step, n)]
        order = np.argsort(mine * (n + 2) + next_ + 1)
        at, mine, next_ = at[order], mine[order], next_[order]
        group = np.concatenate([[True], mine[1:] != mine[:-1]])
        part = group | np.concatenate([[True], next_[1:] != next_[:-1]])
        place = np.arange(len(at))
        rank[at] = mine + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        ranks.append(rank.astype(np.int32))
        step *= 2


def agree(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and from j, two places of one row, are equal."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    last = len(ranks[0]) - 1
    for k in range(len(ranks) - 1, -1, -1):
        step = (ranks[k][np.minimum(i, last)] == ranks[k][np.minimum(j, last)]).astype(np.int64) << k
        i, j, n = i + step, j + step, n + step
    return n


def agree_before(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words before i and before j are equal; i < j, and i's row begins at `first`."""
    n = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        to = i - n - (1 << k)
        n += ((to >= first) & (ranks[k][np.maximum(to, 0)] == ranks[k][np.maximum(to + j - i, 0)])).astype(np.int64) << k
    return n


def sides(depth: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary in `at`: the nearest before it that is no deeper, and the nearest after it that is less deep."""
    longest = int(np.diff(np.flatnonzero(np.concatenate([[True], depth == 0, [True]]))).max(initial=1))
    least = [depth]
    while 2 << len(least) - 1 <= longest:
        d, half = least[-1], 1 << len(least) - 1
        least.append(np.minimum(d, np.concatenate([d[half:], np.zeros(half, d.dtype)])))
    own, left, right = depth[at], at.copy(), at + 1
    for k in range(len(least) - 1, -1, -1):
        to = left - (1 << k)
        left = np.where((to >= 0) & (least[k][np.maximum(to, 0)] > own), to, left)
        right = np.where(least[k][np.minimum(right, len(depth) - 1)] >= own, right + (1 << k), right)
    return left - 1, right


def squares(ranks: list[np.ndarray], row: np.ndarray, size: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and period of all squares that can't be rotated right; periods that leave room for a run only."""
    n = len(row)
    place = ranks[-1][:n].astype(np.int64)
    suffix = np.empty(n, np.int64)
    suffix[place] = np.arange(n)
    near = np.flatnonzero(ranks[0][suffix[:-1]] == ranks[0][suffix[1:]]) + 1
    depth = np.zeros(n + 1, np.int64)
    depth[near] = agree(ranks, suffix[near - 1], suffix[near])
    at = near[depth[near] * exponent <= size[row[suffix[near]]]]
    before, after = sides(depth, at)
    small_left = at - before <= after - at
    lo, count = np.where(small_left, before, at), np.minimum(at - before, after - at)
    other_lo, other_hi = np.where(small_left, at, before), np.where(small_left, after, at)
    begins, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(count)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, side="right")))
        node = np.repeat(np.arange(a, b), count[a:b])
        i = suffix[np.arange(len(node)) - np.repeat(ends[a:b] - count[a:b] - (ends[a - 1] if a else 0), count[a:b]) + lo[node]]
        d = depth[at[node]]
        for to, begin in ((i + d, i), (i - d, i - d)):
            inside = (to >= 0) & (to < n)
            p = place[np.where(inside, to, 0)]
            hit = inside & (p >= other_lo[node]) & (p < other_hi[node])
            begins.append(begin[hit])
            periods.append(d[hit])
        a = b
    return np.concatenate(begins), np.concatenate(periods)


def runs_of(codes: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and then period. codes: equal for equal words of one row only."""
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    ranks = ranked(codes)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, period = squares(ranks, row, np.diff(first), exponent)
    start, end = at - agree_before(ranks, at, at + period, first[row[at]]), at + 2 * period
    long = end - start >= np.maximum(least, exponent * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, period = start[once], end[once], period[once]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def _detect(least: int, exponent: int, texts: bool):
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, off = flat(batch.column("text"))
            start, end, first = words(data, off)
            row = np.repeat(np.arange(len(batch)), np.diff(first))
            codes = mixed(word_hashes(data, start, end) + mixed(row.astype(U) + U(1)))
            a, b, q = runs_of(codes, first, least, exponent)
            kept = joined(data, off, start, end, first, ~covered(len(codes), np.minimum(a + q, b), b))
            whose = row[a]
            parts = np.searchsorted(whose, np.arange(len(batch) + 1))
            a = a - first[whose]
            found = list(zip(a.tolist(), (b - first[whose] - a).tolist(), q.tolist(), strict=True))
            lists = [found[x:y] for x, y in zip(parts[:-1], parts[1:], strict=True)]
            best = [max(x, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if x else (None,) * 3 for x in lists]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(parts), pa.int64()),
                *(pa.array([x[k] for x in best], pa.int64()) for k in range(3)),
                pa.array([x[2] and 1000 * x[1] // x[2] for x in best], pa.int64()),
                pa.array([_digest("".join(f"{s},{n},{p}\n" for s, n, p in x)) for x in lists], pa.string()),
                pa.array(map(_digest, kept), pa.string()),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] if texts else None for x in lists], pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))),
                pa.array([x.decode() if texts else None for x in kept], pa.string()),
            ], names=[x.split()[0] for x in OUT.split(", ")])

    return detect


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, texts: bool = True) -> DataFrame:
    """One row for each row of docs: its words and runs, the run of greatest exponent (ties: smallest start, period),
    the digests of all runs and of the text whose runs are cut to their first period, and with texts both in full."""
    shared.session(docs)
    return shared.documents(docs).mapInArrow(_detect(least, exponent, texts), OUT)
