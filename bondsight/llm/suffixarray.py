"""Operator 10, suffix-array dedup: prefix-free parsing of the corpus, bounded suffix ranks, first owner of each string.

Texts are UTF-8 bytes. A byte goes if it lies in a string of SIZE bytes that also starts in a document with a smaller
doc_id, overlaps included, judged on the input; matches stay inside documents.

Parsing. Every string of SIZE bytes has a trigger: of the GRAM-byte pieces in it, the first with the least rolling
hash. Equal strings have equal triggers at equal places, so a string can only repeat if its trigger does; triggers are
counted over distinct texts, and only the strings around repeated ones go on. The strings that share one trigger place
form a phrase, their union; a phrase is dealt to the bucket of its trigger, where all equal strings meet.

Ranking. A bucket's distinct phrases are its dictionary, each with the smallest doc_id that holds it. All places of the
dictionary are ranked by their first 8, 16, 32 and SIZE bytes, as in the building of a suffix array by doubling; equal
ranks are equal strings, and the smallest doc_id of a rank is the string's first owner. The parse (which documents hold
which phrase where) is then set against the owners. The order over the whole corpus isn't materialized: removal needs
only which suffixes agree in SIZE bytes, and those are neighbours in one bucket.

Equal texts of larger doc_ids go whole if they have SIZE bytes. A phrase that several documents of a batch hold is sent
once, for the smallest; the others lose it without asking. Null text is empty. A null doc_id is neither smaller nor
larger than any: such rows keep everything. Rows with one doc_id don't match each other. An empty table gives no rows; other columns are ignored. A text longer than
a batch is a batch of its own, held whole by its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondsight.llm import shared
from bondsight.llm.arrays import BASE, OTHER, U, binary, covered, flat, lists, mixed, numbers, pieces, prefixes, runs, spans_hash
from bondsight.llm.repeats import repeated_keys

SIZE, GRAM = 50, 20
GRAMS = SIZE - GRAM + 1  # in a string
QUERY, KNOWN = 0, 2
PHRASES = "bucket int, kind int, texts array<long>, docs array<long>, counts array<int>, places binary, lead binary, sizes binary, data binary"
SPANS = "text_hash long, spans binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _slide(x: np.ndarray, n: int, take) -> np.ndarray:
    """take (minimum or maximum) over n neighbours from each place on."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = take(out[:-step], out[step:])
        have += step
    return out


def triggers(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigger places, hashes of all pieces, the least hash of each string, and which strings lie in one row."""
    n = len(data) - SIZE + 1
    if n <= 0:
        return (np.zeros(0, np.int64), *[np.zeros(0, U)] * 2, np.zeros(0, bool))
    at = np.arange(len(data) - GRAM + 1)
    h = mixed(spans_hash(prefixes(data.astype(U) + U(1), BASE), at, at + GRAM, BASE))
    least = _slide(h, GRAMS, np.minimum)[:n]
    inside = np.zeros(n, bool)
    for a, b in zip(off[:-1], off[1:] - SIZE + 1, strict=True):
        inside[a : max(a, b)] = True
    top = np.concatenate([np.zeros(GRAMS - 1, U), np.where(inside, least, U(0)), np.zeros(GRAMS - 1, U)])
    return np.flatnonzero(h == _slide(top, GRAMS, np.maximum)[: len(h)]), h, least, inside


def _keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off = flat(text)
    at, h, _, _ = triggers(data, off)
    return h[at], np.searchsorted(off, at, side="right") - 1, mixed(h[at] + U(OTHER))


def phrases(data: np.ndarray, off: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trigger hash, first and last string and trigger place of every phrase whose trigger is among keys."""
    at, h, least, inside = triggers(data, off)
    some = np.isin(h[at], keys)
    i = np.flatnonzero(inside)
    c = np.searchsorted(at, i)
    while len(late := np.flatnonzero(h[at[c]] != least[i])):  # of equal neighbours, the first
        c[late] += 1
    i, c = i[some[c]], c[some[c]]
    cut = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (i[1:] != i[:-1] + 1)])) if len(i) else c
    return h[at[c[cut]]], i[cut], i[np.append(cut[1:], len(i)) - 1] if len(i) else i, at[c[cut]]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    off = np.cumsum(size) - size
    return data[np.arange(size.sum()) + np.repeat(start - off, size)]


def _packed(kind: int, bucket, text, doc, place, lead, size, start, data) -> pa.RecordBatch:
    order = np.lexsort((place, text, bucket))
    bucket, text, doc, place, lead, size, start = (x[order] for x in (bucket, text, doc, place, lead, size, start))
    rows, parts = runs(bucket), np.unique(np.concatenate([runs(bucket), runs(text), runs(doc)]))
    cut, n = np.searchsorted(parts, rows), len(rows) - 1
    known = kind == KNOWN
    ends = (np.concatenate([[0], np.cumsum(size)])[rows] * (not known)).tolist()
    whole = b"" if known else _gather(data, start, size).tobytes()
    packed = [pa.compress(whole[a:b], codec="zstd", asbytes=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[rows[:-1]], pa.int32()), pa.array(np.full(n, kind), pa.int32()), lists(text[parts[:-1]], cut, pa.int64()), lists(doc[parts[:-1]], cut, pa.int64()), lists(np.diff(parts), cut, pa.int32()),
        binary(place.astype(np.int32), rows), binary((lead[:0] if known else lead).astype(np.uint8), rows * (not known)),
        binary(size.astype(np.uint8), rows), pa.array(packed, pa.binary()),
    ], names=["bucket", "kind", "texts", "docs", "counts", "places", "lead", "sizes", "data"])


def _parse(buckets: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, off = flat(batch.column("text"))
            keys = np.unique(numbers(batch.column("keys"), np.uint64)[0])
            key, lo, hi, at = phrases(data, off, keys)
            if not len(key):
                continue
            row = np.searchsorted(off, lo, side="right") - 1
            text, doc = batch.column("text_hash").to_numpy()[row], batch.column("doc_id").to_numpy()[row]
            place, lead, size = lo - off[row], at - lo, hi - lo + SIZE
            whole = mixed(spans_hash(prefixes(data.astype(U) + U(1), OTHER), lo, lo + size, OTHER) + U(BASE) * lead.astype(U)) ^ key
            order = np.lexsort((doc, whole))
            begin = runs(whole[order])
            least = np.repeat(doc[order][begin[:-1]], np.diff(begin))
            head = np.repeat(order[begin[:-1]], np.diff(begin))
            same = (size[order] == size[head]) & (lead[order] == lead[head]) & (key[order] == key[head])
            known = np.zeros(len(doc), bool)
            known[order] = same & (least < doc[order])
            for kind, where in ((QUERY, ~known), (KNOWN, known)):
                if where.any():
                    to = (text % buckets if kind == KNOWN else (mixed(key + U(OTHER)) % U(buckets)).astype(np.int64))[where]
                    yield _packed(kind, to, *(x[where] for x in (text, doc, place, lead, size, lo)), data)

    return parse


def _ranks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Equal numbers for equal strings of SIZE bytes at the places `start`; numbers in the strings' order."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    rank = np.zeros(len(data), U)
    for k in range(8):
        rank |= padded[k : k + len(data)] << U(56 - 8 * k)
    have = 8
    while have < SIZE:
        rank = np.unique(rank, return_inverse=True)[1].astype(U)
        step = min(have, SIZE - have)
        after = np.concatenate([rank[step:], np.zeros(step, U)])
        rank = rank << U(32) | after
        have += step
    return np.unique(rank[start], return_inverse=True)[1]


def _own(group: pa.Table) -> pa.Table:
    """Of each text, the spans of its phrases that a smaller document owns."""
    group = group.combine_chunks()
    kind = group["kind"].to_numpy()
    places, place_off = numbers(group["places"].chunk(0), np.int32)
    sizes = numbers(group["sizes"].chunk(0), np.uint8)[0].astype(np.int64)
    counts = group["counts"].chunk(0).flatten().to_numpy()
    text = np.repeat(group["texts"].chunk(0).flatten().to_numpy(), counts)
    doc = np.repeat(group["docs"].chunk(0).flatten().to_numpy(), counts)
    known = np.repeat(kind == KNOWN, np.diff(place_off))
    spans = [(text[known], places[known], places[known] + sizes[known])]
    if len(lead := numbers(group["lead"].chunk(0), np.uint8)[0]):
        text, doc, places, sizes = text[~known], doc[~known], places[~known].astype(np.int64), sizes[~known]
        bytes_of = np.add.reduceat(np.append(sizes, 0), np.minimum(np.diff(place_off)[kind == QUERY].cumsum() - np.diff(place_off)[kind == QUERY], len(sizes)))
        blobs = (x for x, k in zip(group["data"].chunk(0), kind, strict=True) if k == QUERY)
        data = np.frombuffer(b"".join(pa.decompress(x.as_py(), int(n), codec="zstd", asbytes=True) for x, n in zip(blobs, bytes_of, strict=True)), np.uint8)
        off = np.cumsum(sizes) - sizes
        whole = mixed(spans_hash(prefixes(data.astype(U) + U(1), OTHER), off, off + sizes, OTHER) + U(BASE) * lead.astype(U))
        _, one, of = np.unique(whole, return_index=True, return_inverse=True)
        same = sizes == sizes[one][of]
        if same.all():
            same = _gather(data, off, sizes) == _gather(data, off[one][of], sizes)
        if not same.all():  # two phrases with one hash: none is merged
            one = of = np.arange(len(whole))
        entry, size = _gather(data, off[one], sizes[one]), sizes[one]
        n = size - SIZE + 1
        begin = np.cumsum(size) - size
        rank = _ranks(entry, np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n))
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, of, doc)
        owner = np.full(rank.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(owner, rank, np.repeat(least, n))
        each = n[of]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        first = owner[rank[np.repeat((np.cumsum(n) - n)[of], each) + nth]]
        member = np.repeat(np.arange(len(of)), each)
        gone = first < doc[member]
        member, nth = member[gone], nth[gone]
        if len(member):
            cut = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (nth[1:] != nth[:-1] + 1)]))
            last = np.append(cut[1:], len(member)) - 1
            m = member[cut]
            spans.append((text[m], places[m] + nth[cut], places[m] + nth[last] + SIZE))
    text, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.argsort(text, kind="stable")
    text, pairs = text[order], np.stack([start[order], end[order]], 1).astype(np.int32)
    at = runs(text)
    return pa.table({"text_hash": pa.array(text[at[:-1]], pa.int64()), "spans": binary(pairs.reshape(-1), at * 2)})


def _cut(texts: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, off = flat(batch.column("text"))
            lists_ = batch.column("spans")
            pairs, at = numbers(lists_.flatten(), np.int32)
            per_row = at[np.concatenate([[0], np.cumsum(np.diff(lists_.offsets.to_numpy()))])] // 2
            row = np.repeat(np.arange(len(batch)), np.diff(per_row))
            pairs = pairs.reshape(-1, 2).astype(np.int64)
            gone = covered(len(data), off[row] + pairs[:, 0], off[row] + pairs[:, 1])
            for r in np.flatnonzero(batch.column("copy").to_numpy(zero_copy_only=False)):
                gone[off[r] : off[r + 1]] = off[r + 1] - off[r] >= SIZE
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            starts = off[:-1][off[:-1] < len(data)]
            head[starts] = gone[starts]
            removed, spans, kept = np.concatenate([[0], np.cumsum(gone)])[off], np.concatenate([[0], np.cumsum(head)])[off], data[~gone].tobytes()
            left = off - removed
            parts = [kept[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(off)), pa.array(np.diff(removed)), pa.array(np.diff(spans)),
                pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()), pa.array(parts if texts else [None] * len(parts), pa.binary()),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each row of docs: its bytes, how many go, in how many maximal runs, and the rest (kept; null if not texts)."""
    shared.session(docs)
    docs = shared.documents(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    total = shared.text_bytes(docs)
    keys = repeated_keys(docs, _keys, shared.bucket_count(docs, 0.6 * total), distinct=True)
    firsts = docs.groupBy("text_hash", "md5").agg(F.min("doc_id").alias("first"))
    # not doc_id = first: as a filter or join key it would part this exchange of the texts from that of the join below
    held = docs.join(firsts.join(keys, "text_hash"), ["text_hash", "md5"]).where(F.coalesce(F.col("doc_id") - F.col("first"), F.lit(1)) == 0)
    held = held.select("doc_id", "text_hash", "text", "keys")
    spans = held.mapInArrow(_parse(shared.bucket_count(docs, total, 2.5e6)), PHRASES).groupBy("bucket").applyInArrow(_own, SPANS)
    spans = spans.groupBy("text_hash").agg(F.collect_list("spans").alias("spans"))
    both = docs.join(firsts.join(spans, "text_hash", "left"), ["text_hash", "md5"], "left")
    mine = F.when(F.col("doc_id") == F.col("first"), F.col("spans"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("doc_id", "text", copy.alias("copy"), F.coalesce(mine, F.array().cast("array<binary>")).alias("spans")).mapInArrow(_cut(texts), OUT)
