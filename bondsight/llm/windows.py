"""Operator 4, substring dedup: Rabin-Karp hashes of every fixed-length word window, counted over the corpus.

Words are what white space (space, tab to carriage return) parts; a window is `size` consecutive words of a document.
A word goes if it lies in a window whose words also start anywhere else, in the same document or another. Windows are
judged on the input. Null, empty and short texts have no window; each row counts as a document, so that a repeated
row repeats all its windows. All places of a repeated window go, so that there are no ties to break. An empty table
gives no rows; columns other than doc_id and text are ignored. A text longer than a batch is a batch of its own: its
task holds it whole, with about 40 bytes a word. Two independent hashes tell windows
apart: one of 64 bits is compared, the other chooses the bucket in which it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondsight.llm import shared
from bondsight.llm.arrays import BASE, OTHER, covered, flat, numbers, pieces, runs, window_starts, windows_hash, word_hashes, words
from bondsight.llm.repeats import repeated_keys

WINDOW = 35
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"


def _keys(size: int):
    def keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, first = words(*flat(text))
        hashes = word_hashes(flat(text)[0], start, end)
        at, row = window_starts(first, size)
        return windows_hash(hashes, at, size, BASE), row, windows_hash(hashes, at, size, OTHER)

    return keys


def _cut(size: int, texts: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, off = flat(batch.column("text"))
            start, end, first = words(data, off)
            at, _ = window_starts(first, size)
            found, _ = numbers(batch.column("keys"), np.uint64)
            hit = at[np.isin(windows_hash(word_hashes(data, start, end), at, size, BASE), found)] if len(found) else at[:0]
            gone = covered(len(start), hit, hit + size)
            row = np.repeat(np.arange(len(batch)), np.diff(first))
            stay = np.flatnonzero(~gone)
            lead = np.concatenate([[True], row[stay][1:] != row[stay][:-1]]) if len(stay) else np.zeros(0, bool)
            out = data.copy()
            gap = start[stay][~lead] - 1
            out[gap] = 0x20
            mask = np.zeros(len(data) + 1, np.int8)
            mask[start[stay]] += 1
            mask[end[stay]] -= 1
            mask = np.cumsum(mask[:-1]).astype(bool) if len(data) else mask[:0].astype(bool)
            mask[gap] = True
            ends = np.concatenate([[0], np.cumsum(mask)])[off]
            kept = out[mask].tobytes()
            parts = [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) != 0) if texts else []
            spans = [[] for _ in parts]
            if texts and gone.any():
                cuts = np.unique(np.concatenate([edge, first]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if gone[a]:
                        r = row[a]
                        spans[r].append({"start": int(a - first[r]), "end": int(b - first[r])})
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(removed[first]), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
                pa.array([x.decode() for x in parts] if texts else [None] * len(parts), pa.string()),
                pa.array(spans if texts else [None] * len(parts), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return cut


def remove_repeats(docs: DataFrame, size: int = WINDOW, texts: bool = True) -> DataFrame:
    """One row for each row of docs: its words, how many go, the rest (kept) and the maximal removed word intervals.

    texts=False leaves `kept` and `spans` null, for those who want only counts and the digest.
    """
    shared.session(docs)
    docs = shared.documents(docs).withColumn("text_hash", F.xxhash64("text"))
    keys = repeated_keys(docs, _keys(size), shared.bucket_count(docs, 1.3 * shared.text_bytes(docs)))
    both = docs.join(keys, "text_hash", "left").select("doc_id", "text", F.coalesce("keys", F.lit(b"")).alias("keys"))
    return both.mapInArrow(_cut(size, texts), OUT)
