"""Which keys of a text stand anywhere else: keys dealt out by bucket, counted, and the repeated ones returned.

A text's keys travel as packed arrays, one row for each bucket and batch, so that a shuffled key costs little over
its 8 bytes; answers travel back the same way, by text. What repeats inside a batch is known there: one witness for each such key goes to its bucket, and no
bucket gets more rows of a key than there are batches. Buckets are as many as the size of the input asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bondsight.llm.arrays import binary, lists, numbers, pieces, runs

QUERY, WITNESS, KNOWN = 0, 1, 2
PACKED = "bucket int, kind int, texts array<long>, counts array<int>, keys binary"
REPLY = "text_hash long, keys binary"

#: Keys of the rows of a batch, the row of each key, and a second hash of each that chooses its bucket.
Keys = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _packed(kind: int, bucket: np.ndarray, text: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((text, bucket))
    bucket, text, keys = bucket[order], text[order], keys[order]
    rows, parts = runs(bucket), np.unique(np.concatenate([runs(bucket), runs(text)]))
    named = kind != WITNESS
    lists_off = np.searchsorted(parts, rows) * named
    n = len(rows) - 1
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[rows[:-1]], pa.int32()), pa.array(np.full(n, kind), pa.int32()),
        lists(text[parts[:-1]] if named else text[:0], lists_off, pa.int64()),
        lists(np.diff(parts) if named else text[:0], lists_off, pa.int32()), binary(keys, rows),
    ], names=["bucket", "kind", "texts", "counts", "keys"])


def _deal(keys_of: Keys, buckets: int, distinct: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes = batch.column("text_hash").to_numpy()
            if distinct:  # one row of each text
                first = np.unique(hashes, return_index=True)[1]
                batch, hashes = batch.take(pa.array(first)), hashes[first]
            keys, row, other = keys_of(batch.column("text"))
            order = np.lexsort((row, keys)) if distinct else np.argsort(keys, kind="stable")
            keys, row, other = keys[order], row[order], other[order]
            if distinct and len(keys):  # a text has each key once
                once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])
                keys, row, other = keys[once], row[once], other[once]
            begin = runs(keys)
            many = np.repeat(np.diff(begin) > 1, np.diff(begin))
            bucket, text = (other % np.uint64(buckets)).astype(np.int64), hashes[row]
            heads = begin[:-1][many[begin[:-1]]] if len(keys) else begin[:0]
            salt = int(hashes[0]) % buckets
            for kind, where in ((QUERY, ~many), (WITNESS, heads), (KNOWN, many)):
                some, whose, to = keys[where], text[where], bucket[where]
                if kind == KNOWN:  # what is known needs no meeting: each text's keys once, spread over buckets
                    some, whose = _once(some, whose)
                    to = (whose + salt) % buckets
                if len(some):
                    yield _packed(kind, to, whose, some)

    return deal


EMPTY = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("texts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("keys", pa.binary())])


def _meet(buckets: int, distinct: bool) -> Callable[[pa.Table], pa.Table]:
    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        kind = group["kind"].to_numpy()
        keys, off = numbers(group["keys"].chunk(0), np.uint64)
        per_row = np.diff(off)
        known, witness = np.repeat(kind == KNOWN, per_row), np.repeat(kind == WITNESS, per_row)
        counts, texts = group["counts"].chunk(0), group["texts"].chunk(0)
        n_of, of = counts.flatten().to_numpy(), texts.flatten().to_numpy()
        text = np.zeros(len(keys), np.int64)
        text[~witness] = np.repeat(of, n_of)
        order = np.lexsort((text, keys)) if distinct else np.argsort(keys, kind="stable")
        order = order[~known[order]]
        k, w, t = keys[order], witness[order], text[order]
        begin = runs(k)
        size = np.diff(begin)
        if len(k):
            news = np.concatenate([[1], (t[1:] != t[:-1]).astype(int)]) if distinct else np.ones(len(k), int)
            news[begin[:-1]] = 1
            rep = np.repeat((np.add.reduceat(news, begin[:-1]) > 1) | np.maximum.reduceat(w, begin[:-1]), size)
            known[order[rep & ~w]] = True
        answer = known & ~witness
        keys, text = _once(keys[answer], text[answer])
        parts = (text % buckets).astype(np.int64)
        return pa.Table.from_batches([_packed(KNOWN, parts, text, keys)]) if len(keys) else pa.Table.from_batches([], EMPTY)

    return meet


def _once(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, key) once, ordered."""
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])]) if len(keys) else np.zeros(0, bool)
    return keys[new], text[new]


def _unpack(group: pa.Table) -> pa.Table:
    """One row for each text: all its answers lie in one group."""
    group = group.combine_chunks()
    keys = numbers(group["keys"].chunk(0), np.uint64)[0]
    keys, text = _once(keys, np.repeat(group["texts"].chunk(0).flatten().to_numpy(), group["counts"].chunk(0).flatten().to_numpy()))
    at = runs(text)
    return pa.table({"text_hash": pa.array(text[at[:-1]], pa.int64()), "keys": binary(keys, at)})


def repeated_keys(texts: DataFrame, keys_of: Keys, buckets: int, distinct: bool = False) -> DataFrame:
    """Rows (text_hash, keys), one a text: its keys that stand at two places of the table or more.

    texts: (text_hash long, text). distinct: places in equal texts, or in one text, count as one.
    """
    dealt = texts.select("text_hash", "text").mapInArrow(_deal(keys_of, buckets, distinct), PACKED)
    found = dealt.groupBy("bucket").applyInArrow(_meet(buckets, distinct), PACKED)
    return found.groupBy("bucket").applyInArrow(_unpack, REPLY)
