"""Operator 2, MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are five consecutive lower-cased (A-Z) white-space words; a text of fewer words, but not none, is one. A
shingle's weight is its count in the text times a smoothed inverse document frequency: 1 for shingles in at most
least = max(N / COMMON, FLOOR) of the N documents, falling with the logarithm of the frequency by DAMP at N. It is mild
because the shingles of a large group of near copies are common too, and must not lose against their few differences.
Only common shingles need be known, at most COMMON times the mean number in a document, and exactly: document
frequencies are summed in a fixed table of 2 ** TABLE hash cells, and shingles in cells heavy enough are then counted
by themselves.

Each text gets BANDS * ROWS consistent samples; texts that agree in all ROWS samples of a band share a bucket. In a
bucket each text is set against one centre, and pairs whose weighted Jaccard similarity, computed from both whole
texts, reaches the threshold are links; components of links are classes. Buckets that still hold several components
get another centre, ROUNDS times; what then remains is compared block against block: every pair of different components is
verified inside the task by its weighted shingles, and only the links that join components come back, so that no bucket
is left with two components untested and no group is expanded into its pairs.

Equal texts are one node. Empty tables give no rows; other columns are not read, whatever their names. A text longer than
a batch is a batch of its own, and where it is verified its task holds it whole. Null, empty and blank texts are in a
class of their own each. A class's id is its smallest
doc_id; rows with the same id and text stay or go together. A row without doc_id goes if its class has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondsight.llm import shared
from bondsight.llm.arrays import BASE, LOWER, OTHER, U, binary, flat, lists, mixed, numbers, pieces, prefixes, spans_hash, window_starts, word_hashes, words
from bondsight.llm.components import components

SIZE, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
COMMON, FLOOR, TABLE, DAMP = 1000, 16, 20, 0.25
SLICES = 64
ROUNDS, BLOCK = 2, 512


def shingles(data: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by row: row, hash and count, sorted by row and hash."""
    data = LOWER[data]
    start, end, first = words(data, off)
    h = word_hashes(data, start, end)
    at, row = window_starts(first, size)
    sums = prefixes(h, OTHER)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    row = np.concatenate([row, short])
    key = mixed(np.concatenate([spans_hash(sums, at, at + size, OTHER), spans_hash(sums, first[short], first[short + 1], OTHER) + n[short].astype(U)]))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    return row[new], key[new], np.diff(np.append(new, len(key)))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << TABLE, np.int64)
    for batch in pieces(batches):
        key = shingles(*flat(batch.column("text")))[1]
        table += np.bincount((key >> U(64 - TABLE)).astype(np.int64), minlength=1 << TABLE)
    if table.any():
        packed = [pa.compress(part.tobytes(), codec="zstd", asbytes=True) for part in table.reshape(SLICES, -1)]  # mostly zeros in a small partition
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "cells"])


def _sum_cells(group: pa.Table) -> pa.Table:
    size = (1 << TABLE) // SLICES
    cells = np.zeros(size, np.int64)
    for packed in group["cells"]:
        cells += np.frombuffer(pa.decompress(packed.as_py(), 8 * size, codec="zstd", asbytes=True), np.int64)
    return pa.table({"slice": group["slice"][:1], "cells": binary(cells, np.array([0, size]))})


def _heavy(bits: np.ndarray):
    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.unpackbits(bits).astype(bool)
        for batch in pieces(batches):
            key = shingles(*flat(batch.column("text")))[1]
            found, n = np.unique(key[cells[(key >> U(64 - TABLE)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return heavy


class Weights:
    """Inverse document frequencies: of the common shingles; all others weigh 1."""

    def __init__(self, shingle: np.ndarray, frequency: np.ndarray, total: int, least: float) -> None:
        order = np.argsort(shingle)
        self.shingle = shingle[order]
        span = np.log(max(total / least, 2.0))
        self.idf = 1 - DAMP * np.clip(np.log(np.maximum(frequency[order] / least, 1)) / span, 0, 1)

    def of(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return count.astype(np.float64)
        at = np.minimum(np.searchsorted(self.shingle, key), len(self.shingle) - 1)
        return count * np.where(self.shingle[at] == key, self.idf[at], 1.0)


def document_weights(texts: DataFrame) -> Weights:
    """From one column, text, of all documents."""
    total = texts.count()
    least = max(total / COMMON, FLOOR)
    summed = texts.mapInArrow(_cells, "slice int, cells binary").groupBy("slice").applyInArrow(_sum_cells, "slice int, cells binary")
    table = np.zeros((SLICES, (1 << TABLE) // SLICES), np.int64)
    for part, cells in summed.collect():  # a table of fixed size
        table[part] = np.frombuffer(cells, np.int64)
    bits = np.packbits(table.reshape(-1) >= least)
    if not bits.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0), total, least)
    counted = texts.mapInArrow(_heavy(bits), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    return Weights(counted["shingle"].to_numpy(np.int64).view(np.uint64), counted["n"].to_numpy(np.float64), total, least)


#: -log of uniform numbers, by 16 random bits: two of them add up to a gamma(2, 1) value.
_LOGS = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def samples(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, BANDS * ROWS) consistent samples; rows without shingles are 0."""
    out = np.zeros((n_rows, BANDS * ROWS), U)
    if not len(row):
        return out
    has, at = np.unique(row, return_index=True)
    size = np.diff(np.append(at, len(row)))
    log_w = np.log(weight).astype(np.float32)
    for k in range(BANDS * ROWS):
        g = mixed(key + U((k + 1) * BASE % (1 << 64)))
        bits = g.view(np.uint16).reshape(-1, 4)
        r = _LOGS[bits[:, 0]] + _LOGS[bits[:, 1]]
        c = np.log(_LOGS[bits[:, 2]] + _LOGS[bits[:, 3]])
        b = ((g * U(OTHER)) >> U(40)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_w / r + b)
        a = c - r * (t - b) - r
        least = np.minimum.reduceat(a, at)
        hit = np.flatnonzero(a == np.repeat(least, size))
        pick = hit[np.searchsorted(hit, at)]
        out[has, k] = mixed(key[pick] ^ mixed(t[pick].astype(np.int64).view(U) * U(BASE) + U(k)))
    return out


def _signed(weights):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, key, n = shingles(*flat(batch.column("text")))
            found = samples(row, key, weights.value.of(key, n), len(batch))
            has = np.zeros(len(batch), bool)
            has[row] = True
            bands = mixed(sum(found[:, i::ROWS] * U(pow(BASE, i + 1, 1 << 64)) for i in range(ROWS)))[has].view(np.int64)
            off = np.concatenate([[0], np.cumsum(has)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("md5"), lists(bands.reshape(-1), off * BANDS, pa.int64()),
            ], names=["doc_id", "md5", "bands"])

    return signed


def _similarity(weights, similar: float):
    def similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in pieces(batches, "text_a"):
            parts = [shingles(*flat(batch.column(c))) for c in ("text_a", "text_b")]
            row, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            weight = w.of(key, n)
            order = np.lexsort((key, row))
            row, key, weight = row[order], key[order], weight[order]
            both = np.flatnonzero((row[1:] == row[:-1]) & (key[1:] == key[:-1]))
            least = np.bincount(row[both], np.minimum(weight[both], weight[both + 1]), len(batch))
            most = np.bincount(row, weight, len(batch)) - least
            got = least / np.where(most > 0, most, 1)
            keep = pa.array(got >= similar - 1e-12)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("a", "b")), pa.array(got).filter(keep)], names=["a", "b", "similarity"])

    return similarity


def _linked(weights, similar: float):
    """Links between two blocks of a bucket: all pairs of different components, each in the first band that brings the two
    together. A text's shingles are looked up among all the task's at once, which gives its similarity with every other;
    pairs that a link found here already joins are skipped."""

    def linked(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, root, side, band = (group[c].to_numpy() for c in ("node", "root", "side", "band"))
        bands = group["bands"].chunk(0).flatten().to_numpy().reshape(len(node), -1)[:, : band[0]]
        row, key, n = shingles(*flat(group["text"].chunk(0)))
        weight = weights.value.of(key, n)
        off = np.searchsorted(row, np.arange(len(node) + 1))
        total = np.add.reduceat(np.append(weight, 0.0), off[:-1])
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_row, sorted_weight = key[order], row[order], weight[order]
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        out: list[tuple[int, int]] = []
        left, right = np.flatnonzero(side != 1), side != 0
        for i in left:
            other = right & (root != root[i]) & ~(bands == bands[i]).any(1)
            if side[i] == 2:
                other[: i + 1] = False
            if not other.any():
                continue
            own, own_weight = key[off[i] : off[i + 1]], weight[off[i] : off[i + 1]]
            at, to = np.searchsorted(sorted_key, own, "left"), np.searchsorted(sorted_key, own, "right")
            many = to - at
            where = np.arange(many.sum()) + np.repeat(at - (np.cumsum(many) - many), many)
            both = np.bincount(sorted_row[where], np.minimum(sorted_weight[where], np.repeat(own_weight, many)), len(node))
            for k in np.flatnonzero(other & (both >= (similar - 1e-12) * (total[i] + total - both))).tolist():
                if (a := top(int(root[i]))) != (b := top(int(root[k]))):
                    up[max(a, b)] = min(a, b)
                    out.append((int(node[i]), int(node[k])))
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return linked


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row for each row of docs: doc_id, md5 of its text, class_id, kept."""
    spark = shared.session(docs)
    docs = shared.documents(docs)
    weights = spark.sparkContext.broadcast(document_weights(docs.select("text")))
    hashed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"), "text")
    signed = shared.settle(hashed.mapInArrow(_signed(weights), "doc_id long, md5 string, bands array<long>"))
    nodes = signed.where(F.size("bands") > 0).groupBy("md5").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    nodes = shared.settle(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    members = shared.settle(members.join(sizes, ["band", "key"]).select("band", "key", "node", "centre"))
    some = members.select("node").distinct().join(nodes.select("node", "md5"), "node")
    texts = hashed.select("md5", "text").join(some, "md5").groupBy("node").agg(F.first("text").alias("text"))
    texts = shared.settle(texts)

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_similarity(weights, similar), "a long, b long, similarity double")

    def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
        return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    tried = shared.settle(ordered(members, "node", "centre"))
    links = shared.settle(verified(tried))
    roots = components(links)
    for turn in range(ROUNDS + 1):
        now = members.drop("centre").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        centre = F.min_by(F.struct("node", "root"), F.xxhash64("node", "band", F.lit(turn))).alias("c")
        open_ = now.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), centre).where("low < high")
        rest = shared.settle(now.join(open_.select("band", "key", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root")), ["band", "key"]))
        if not rest.limit(1).count():
            break
        if turn == ROUNDS:
            more = nodes.select("node", "bands").join(texts, "node")
            links = shared.settle(links.select("a", "b").unionByName(_blocks(rest.select("band", "key", "node", "root").join(more, "node"), weights, similar)))
            roots = components(links)
            break
        pairs = shared.settle(ordered(rest.where("root != centre_root"), "node", "centre").join(tried, ["a", "b"], "left_anti"))
        if pairs.limit(1).count():
            links = shared.settle(links.unionByName(verified(pairs)))
            tried = tried.unionByName(pairs)
            roots = components(links)
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    out = signed.select("doc_id", "md5").join(placed.join(ids, "root").select("md5", "class_id"), "md5", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", "md5", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, class_id.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs' own columns; one row of each class stays, that of its smallest doc_id."""
    stay = classes(docs, similar).where("kept").select(F.col("doc_id").alias("_id"), F.col("md5").alias("_stay")).distinct()
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("_md5"))
    own = own.join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_stay")), "left_semi")
    return own.dropDuplicates(["_doc", "_md5"]).select("_row.*")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id of its class), kept."""
    return classes(docs, similar).drop("md5")


def _blocks(rest: DataFrame, weights, similar: float) -> DataFrame:
    """Links in the buckets that are left, block against block."""
    size = rest.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rest = rest.join(size, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    with_ = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    with_ = with_.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "bands", "text", side.alias("side"))
    return with_.groupBy("band", "key", "i", "j").applyInArrow(_linked(weights, similar), "a long, b long").distinct()
