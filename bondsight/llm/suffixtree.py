"""Operator 7, language-model scoring: a probabilistic suffix tree over bytes, and a word-count base beside it.

A text is spelled in lower case (A-Z), each white-space word followed by one space, then an end. Of all training
spellings every run of DEPTH + 1 bytes is counted. A context of up to DEPTH bytes stays in the tree if it holds LEAST
symbols or more, a fixed number whatever the corpus, and if its next-symbol distribution diverges from that of its
suffix one byte shorter: the likelihood gained must pass the Bayesian information criterion. A retained context's
distribution is smoothed towards its suffix's, the root's by adding one for each of 256 symbols. DEPTH, the order bound
that the method asks for, is at most 7 here, as a run is one 64-bit number.

The tree is never in one place. Texts are packed once into stored batches of about BATCH bytes (one text at least). Of
a batch each distinct run goes once, with its count in training, to the bucket of its context's last NEAR bytes, where
all longer contexts with that ending lie; what a batch repeats costs nothing more, so a line or passage in a third of
all texts weighs one run a batch. An ending with more than HOT times a bucket's share of all places is dealt out in
parts by the byte before it, and each part is also told how often which symbol follows the ending as a whole. The bucket
sums, retains, smooths, and answers: for each run the length of its longest retained context, and for each such context
and symbol its logarithm once, in single precision; the batch knows which of its runs share one. Contexts shorter than
NEAR, at most 256 ** (NEAR - 1) however large the corpus, are known to every task.

The base is the add-one unigram over words and the end. Its counts travel the same way: a batch asks for each distinct
word once, the word's bucket sums and answers.

Null text is empty: just an end. Rows are scored one by one, equal rows alike; held-out rows count nowhere. Empty tables
give no rows. Without a row to learn from, all counts are 0. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondsight.llm import shared
from bondsight.llm.arrays import LOWER, U, flat, lists, mixed, pieces, runs, word_hashes, words

DEPTH, NEAR, LEAST, SMOOTH = 7, 3, 2, 4.0
STOP = 0x0A  # white space is in no word, so this byte is free to mean the end
WORD, RUN = 0, 1
BATCH = 6_000_000
HOT = 4
SMALL = bytes(LOWER)
END = U(0)  # the end among the word hashes


def spelled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All spellings in one array and where each begins: DEPTH spaces, the words with a space after each, the end."""
    lead, end = b" " * DEPTH, bytes([STOP])
    lines = [b"".join((lead, b" ".join(words), b" " if words else b"", end)) for words in (t.translate(SMALL).split() for t in texts)]
    return np.frombuffer(b"".join(lines), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sum of each one's counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, at = keys[order], runs(keys[order])[:-1]
    return keys[at], np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with the inverse, in half the time.

    Places are sorted by the first bits of a hash, the place in the last ones, as numbers sort quicker than places do;
    then the kinds alone are put in order. Kinds whose hashes begin alike may come several times until then.
    """
    low = U(max(len(values) - 1, 1).bit_length())
    at = mixed(values)
    at >>= low
    at <<= low
    at |= np.arange(len(values), dtype=U)
    at.sort()
    at &= (U(1) << low) - U(1)
    begin = runs(values[at])
    kinds = values[at[begin[:-1]]]
    order = np.argsort(kinds)
    kinds = kinds[order]
    new = np.concatenate([[True], kinds[1:] != kinds[:-1]]) if len(kinds) else np.zeros(0, bool)
    number = np.empty(len(kinds), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    of = np.empty(len(values), np.int32)
    of[at] = np.repeat(number, np.diff(begin))
    return kinds[new], of


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """At every place of the spellings the symbol and the DEPTH bytes before it, and the first place of each text.

    A run is one number: the nearest byte of the context first, the farthest seventh, the symbol last; so what shares an
    ending sorts together. Eight bytes are read at every place as one number, whose parts are then turned round.
    """
    line, begin = spelled(texts)
    n = len(line) - DEPTH
    key = np.ndarray((max(n, 0),), "<u8", line, strides=(1,)).copy()  # the symbol is the highest byte here
    key <<= U(8)
    key |= line[DEPTH : DEPTH + len(key)]
    if len(texts) > 1:  # runs that reach over a text's beginning
        inside = np.ones(n, bool)
        for k in range(DEPTH):
            inside[begin[1:-1] - DEPTH + k] = False
        key = key[inside]
    return key, np.cumsum(np.diff(begin) - DEPTH) - (np.diff(begin) - DEPTH)


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys if n >= 8 else keys & U((1 << 8 * n) - 1)


def _found(of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x lies among the sorted values `of`, and whether it does."""
    at = np.minimum(np.searchsorted(of, x), max(len(of) - 1, 0))
    return at, of[at] == x if len(of) else np.zeros(len(x), bool)


class Level:
    """Contexts of n bytes: their counts, and which stay. keys, count: runs of n + 1 bytes or more; up: the level below."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, n: int, up: Level | None) -> None:
        self.keys, self.count = _merged([(_low(keys, n + 1), count)])
        at = runs(self.keys >> U(8))[:-1]
        self.contexts = self.keys[at] >> U(8)
        self.all = np.add.reduceat(self.count, at) if len(at) else self.count
        self.kept = np.zeros(len(at), bool)
        if up is not None and len(at):
            shorter = _low(self.keys, n)
            base = up.count[_found(up.keys, shorter)[0]] / up.all[_found(up.contexts, shorter >> U(8))[0]]
            kinds = np.diff(np.append(at, len(self.keys)))
            gain = np.add.reduceat(self.count * np.log(self.count / np.repeat(self.all, kinds) / base), at)
            self.kept = (self.all >= LEAST) & (gain > 0.5 * kinds * np.log(self.all))

    def smoothed(self, keys: np.ndarray, n: int, p: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The probability of each run's last symbol after n bytes, from that after n - 1; depth: n where a context is retained."""
        own = _low(keys, n + 1)
        at, hit = _found(self.contexts, own >> U(8))
        i = np.flatnonzero(hit & self.kept[at] if len(self.kept) else hit)
        where, seen = _found(self.keys, own[i])
        times = np.where(seen, self.count[where], 0) if len(self.count) else np.zeros(len(i))
        p[i] = (times + SMOOTH * p[i]) / (self.all[at[i]] + SMOOTH)
        depth[i] = n
        return p


def short_levels(keys: np.ndarray, count: np.ndarray) -> list[Level]:
    """The levels below NEAR, from all runs of NEAR bytes."""
    out: list[Level] = []
    for n in range(NEAR):
        out.append(Level(keys, count, n, out[-1] if out else None))
    return out


class Dealing:
    """Which bucket a run goes to: by its context's last NEAR bytes, and parts of the hot endings by one byte more.

    hot: the hot endings as the bytes stand in a text; parts: how many each is dealt out to.
    """

    def __init__(self, buckets: int, grams: np.ndarray, count: np.ndarray) -> None:
        share = max(count.sum() / buckets, 1)
        some = np.flatnonzero(count > HOT * share)
        self.buckets, self.hot, self.parts = buckets, grams[some], np.ceil(count[some] / share / 2).astype(U)

    def part_hash(self, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mixed(self.hot[at] << U(16) | part + U(1))

    def hashes(self, wire: np.ndarray) -> np.ndarray:
        out = mixed(wire >> U(64 - 8 * NEAR))
        if len(self.hot):
            at, hit = _found(self.hot, _low(_unwired(wire) >> U(8), NEAR))
            at = at[hit]
            out[hit] = self.part_hash(at, mixed(wire[hit] >> U(56 - 8 * NEAR) & U(255)) % self.parts[at])
        return out

    def wholes(self, wire: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, runs of NEAR + 1 bytes, counts) for every bucket that holds a part of a hot ending: its symbols' counts."""
        if not len(self.hot):
            return
        low = _low(_unwired(wire), NEAR + 1)
        at, hit = _found(self.hot, low >> U(8))
        hit &= times > 0
        keys, n = _merged([(low[hit], times[hit])])
        of = _found(self.hot, keys >> U(8))[0]
        every = [(b, i) for i, parts in enumerate(self.parts) for b in np.unique(self.part_hash(np.full(int(parts), i), np.arange(int(parts), dtype=U)) % U(self.buckets)).tolist()]
        held: dict[int, list[int]] = {}
        for b, i in every:
            held.setdefault(b, []).append(i)
        for b, some in held.items():
            mine = np.isin(of, some)
            if mine.any():
                yield b, keys[mine], n[mine]


def run_logs(asked: np.ndarray, keys: np.ndarray, count: np.ndarray, short: list[Level], hot: np.ndarray, whole: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability of each asked run's last symbol, and the length of its longest retained context.

    keys, count: all training runs with the same endings; of the hot endings a part, but `whole` has the counts by symbol.
    """
    root = np.zeros(256, np.int64)
    root[short[0].keys.astype(int)] = short[0].count
    p, depth = ((root + 1) / (root.sum() + 256))[_low(asked, 1).astype(int)], np.zeros(len(asked), np.uint8)
    up = short[-1]
    for n in range(1, DEPTH + 1):
        if n == NEAR and len(hot):
            cold = ~_found(hot, _low(keys >> U(8), NEAR))[1]
            level = Level(np.concatenate([keys[cold], whole[0]]), np.concatenate([count[cold], whole[1]]), n, up)
        else:
            level = short[n] if n < NEAR else Level(keys, count, n, up)
        p, up = level.smoothed(asked, n, p, depth), level
    return np.log10(p), depth


def by_context(known: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of context: the runs whose longest retained one it is, in the order of their contexts with symbol,
    and where in that order each distinct one begins, then the end. known: as _unwired gives them.

    Runs of one context and symbol have one logarithm, so any of them stands for the others."""
    for n in range(DEPTH + 1):
        some = np.flatnonzero(depth == n)
        if len(some):
            values = _low(known[some], n + 1)
            order = np.argsort(values)
            yield some[order], runs(values[order])


def _planes(values: np.ndarray, level: int = 3) -> bytes:
    """Numbers with their first bytes together, as those compress, and so on; the size leads."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)  # tobytes() alone copies sign by sign
    return raw.size.to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(pa.py_buffer(raw), asbytes=True)


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _unwired(wire: np.ndarray) -> np.ndarray:
    """A run with the context's bytes in the text's order, the symbol still last."""
    return (wire & ~U(255)).byteswap() << U(8) | wire & U(255)


PACK = "batch long, docs array<long>, held array<boolean>, sizes array<int>, data binary"
ASK, TOLD = "kind int, bucket int, batch long, keys binary, counts binary", "batch long, kind int, bucket int, depths binary, told binary"
ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, totals boolean"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BATCH bytes of text each."""
    part, nth = TaskContext.get().partitionId(), 0

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data, off = flat(table["text"].chunk(0))
        one = np.array([0, len(table)])
        ids = pa.ListArray.from_arrays(pa.array(one, pa.int32()), table["doc_id"].chunk(0))
        flags = pa.ListArray.from_arrays(pa.array(one, pa.int32()), table["held_out"].chunk(0))
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | nth]), ids, flags, lists(np.diff(off), one, pa.int32()), pa.array([_planes(data, 6)], pa.binary())], names=["batch", "docs", "held", "sizes", "data"])

    held, size = [], 0
    for batch in pieces(batches, limit=BATCH // 12):
        own = len(flat(batch.column("text"))[0])
        if held and size + own > BATCH:
            yield row(held)
            held, size, nth = [], 0, nth + 1
        held.append(batch)
        size += own
    if held:
        yield row(held)


class Batch:
    """A stored batch: its texts, distinct runs and words, and where each stands."""

    def __init__(self, row: dict) -> None:
        raw, at = _unplaned(row["data"], np.uint8).tobytes(), np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))]).tolist()
        self.texts = [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        self.taught = ~np.array(row["held"], bool)

    def each_run(self, deal: Dealing) -> tuple[np.ndarray, ...]:
        """Distinct runs, each place's one, each text's first place, the order by bucket, and the buckets in that order."""
        key, first = _runs(self.texts)
        key, of = _distinct(key)
        return key, of, first, *_by_bucket(deal.hashes(key), deal.buckets)

    def taught_runs(self, deal: Dealing) -> tuple[np.ndarray, ...]:
        """Distinct runs and how often each stands in training texts, the order by bucket, and the buckets in that order.

        Sorting is quicker than sorting with places, which asking doesn't need.
        """
        key, first = _runs(self.texts)
        own = np.sort(key[np.repeat(self.taught, np.diff(np.append(first, len(key))))])
        key.sort()
        key = key[runs(key)[:-1]]
        at, times = runs(own), np.zeros(len(key), np.uint32)
        times[np.searchsorted(key, own[at[:-1]])] = np.diff(at)
        return key, times, *_by_bucket(deal.hashes(key), deal.buckets)

    def each_word(self, buckets: int) -> tuple[np.ndarray, ...]:
        """The same of words and ends."""
        data, off = flat(pa.array(self.texts, pa.binary()))
        start, end, first = words(data, off)
        n = len(self.texts)
        key = np.insert(word_hashes(LOWER[data], start, end), first[1:], END)
        key, of = _distinct(key)
        return key, of, first[:-1] + np.arange(n), *_by_bucket(key, buckets)

    def taught_times(self, of: np.ndarray, first: np.ndarray, kinds: int) -> np.ndarray:
        """How often each kind stands in training texts."""
        stands = np.repeat(self.taught, np.diff(np.append(first, len(of))))
        return np.bincount(of[stands], minlength=kinds).astype(np.uint32)


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (hashes % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # of 16 bits a stable sort is linear
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of runs of NEAR bytes in training texts."""
    for rows in batches:
        for row in rows.to_pylist():
            b = Batch(row)
            key = _runs([t for t, own in zip(b.texts, b.taught, strict=True) if own])[0]
            key, n = np.unique((_unwired(key) & U((1 << 8 * NEAR) - 1)).astype(np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


def _ask(shared_):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words and runs of a batch by bucket, with how often each is in its training texts; under batch -1
        what the parts of hot endings must know of the whole."""
        deal = Dealing(*shared_.value)
        for rows in batches:
            for stored in rows.to_pylist():
                b = Batch(stored)
                key, of, first, order, bucket = b.each_word(deal.buckets)
                n = b.taught_times(of, first, len(key))
                parts = [(WORD, stored["batch"], int(bucket[i]), key[order[i:j]], n[order[i:j]]) for i, j in _spans(bucket)]
                del of, first
                key, n, order, bucket = b.taught_runs(deal)
                parts += [(RUN, stored["batch"], int(bucket[i]), key[order[i:j]], n[order[i:j]]) for i, j in _spans(bucket)]
                parts += [(RUN, -1, at, keys, times.astype(np.uint32)) for at, keys, times in deal.wholes(key, n)]
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([x[k] for x in parts], kind) for k, kind in ((0, pa.int32()), (2, pa.int32()), (1, pa.int64()))),
                    pa.array([_planes(np.diff(x[3], prepend=U(0))) for x in parts], pa.binary()), pa.array([_planes(x[4]) for x in parts], pa.binary()),
                ], names=["kind", "bucket", "batch", "keys", "counts"])

    return ask


def _spans(sorted_: np.ndarray) -> list[tuple[int, int]]:
    at = runs(sorted_).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _tell(shared_):
    def tell(group: pa.Table) -> pa.Table:
        """Of a bucket's runs the logarithms, of its words the counts; and under batch -1 how many tokens and kinds of word it has."""
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        parts = [(b, np.cumsum(_unplaned(k, np.uint64), dtype=U), _unplaned(c, np.uint32)) for b, k, c in zip(*(group[c].to_pylist() for c in ("batch", "keys", "counts")), strict=True)]
        asked = [(b, k) for b, k, _ in parts if b >= 0]
        every, n = _merged([(k, c) for b, k, c in parts if b >= 0] or [(np.zeros(0, U), np.zeros(0, np.int64))])
        rows = []
        if kind == WORD:
            rows = [(b, b"", _planes(n[np.searchsorted(every, k)])) for b, k in asked]
            rows.append((-1, b"", _planes(np.array([n.sum(), (n > 0).sum()]))))
        else:
            grams = shared_.value[1:]
            known, hot = _unwired(every), Dealing(*shared_.value).hot
            whole = _merged([(k, c) for b, k, c in parts if b < 0] or [(np.zeros(0, U), np.zeros(0, np.int64))])
            logs, depth = run_logs(known, known[n > 0], n[n > 0], short_levels(*grams), hot, whole)
            logs = logs.astype(np.float32)
            for b, k in asked:
                at = np.searchsorted(every, k)
                values = [logs[at[some[begin[:-1]]]] for some, begin in by_context(known[at], depth[at])]
                rows.append((b, _planes(depth[at]), _planes(np.concatenate(values))))
        columns = [[x[0] for x in rows], [kind] * len(rows), [bucket] * len(rows), [x[1] for x in rows], [x[2] for x in rows]]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["batch", "kind", "bucket", "depths", "told"])

    return tell


def _scored(shared_):
    def scored(stored: pa.Table, told: pa.Table) -> pa.Table:
        replies = list(zip(*(told[c].to_pylist() for c in ("bucket", "kind", "depths", "told")), strict=True))
        if not len(stored):
            total, kinds = np.sum([_unplaned(x, np.int64) for *_, x in replies if x], 0).tolist()
            return pa.table([pa.array([x], t.type) for x, t in zip((None, None, total, kinds, None, None, True), EMPTY, strict=True)], schema=EMPTY)
        b, deal = Batch(stored.to_pylist()[0]), Dealing(*shared_.value)
        of_kind = lambda kind: [(d, x) for _, k, d, x in sorted(replies, key=lambda r: r[0]) if k == kind]
        key, of, first, order, _ = b.each_word(deal.buckets)
        answer = np.empty(len(key))
        answer[order] = np.concatenate([_unplaned(x, np.int64) for _, x in of_kind(WORD)])
        tokens, known = np.diff(np.append(first, len(of))), np.add.reduceat((answer > 0)[of].astype(np.int64), first)
        base = np.add.reduceat(np.log10(answer + 1)[of], first)  # every text has an end, so none is without a place
        key, of, first, order, bucket = b.each_run(deal)
        logs = np.empty(len(key), np.float32)
        for (i, j), (depths, x) in zip(_spans(bucket), of_kind(RUN), strict=True):
            mine, values, done = order[i:j], _unplaned(x, np.float32), 0
            for some, begin in by_context(_unwired(key[mine]), _unplaned(depths, np.uint8)):
                logs[mine[some]] = np.repeat(values[done : done + len(begin) - 1], np.diff(begin))
                done += len(begin) - 1
        score = np.add.reduceat(logs[of].astype(np.float64), first)
        columns = (stored["docs"].combine_chunks().flatten(), ~b.taught, tokens, known, base, score, np.zeros(len(tokens), bool))
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(columns, EMPTY, strict=True)], schema=EMPTY)

    return scored


EMPTY = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("totals", pa.bool_())])


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """One row for each row of docs: held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    held_out: a condition on doc_id; the other rows are learned from.
    """
    spark = shared.session(docs)
    docs = shared.documents(docs).select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = shared.text_bytes(docs)
    # neighbouring splits are read together, so that batches are full
    packed = docs.coalesce(int(size / BATCH) + 1).mapInArrow(_pack, PACK)
    stored = shared.bucketed(packed, "batch", shared.bucket_count(docs, size, BATCH))  # read again where the answers meet the texts
    grams = stored.mapInArrow(_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # at most 256 ** NEAR
    buckets, grams = shared.bucket_count(docs, size, BATCH), grams.sort_values("key")
    known = spark.sparkContext.broadcast((buckets, grams["key"].to_numpy(np.int64).view(np.uint64), grams["n"].to_numpy(np.int64)))
    told = stored.mapInArrow(_ask(known), ASK).groupBy("kind", "bucket").applyInArrow(_tell(known), TOLD)
    rows = shared.settle(stored.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_scored(known), ROW))
    n, kinds = rows.where("totals").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + kinds + 1)))
    return rows.where("not totals").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
