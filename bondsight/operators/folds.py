"""Folds in an order that no aggregate knows: keys dealt out, rows sorted, and carried through a walk batch by batch.

A walk gets a partition's Arrow batches in order and keeps what it must know of the key it is in, so that a key of any
number of rows takes the memory of a batch and of that state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Walk = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def fold(rows: DataFrame, keys: list[str], order: list[str], walk: Walk, schema: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


def budget_gate(calls: DataFrame, limit: int) -> DataFrame:
    """A-11: calls (run_id, call_id, estimate, actual) of a run in order: refused if spent + estimate passes the limit, and
    then free; later smaller ones may pass. A run is walked with what it has spent so far."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, spent = None, 0
        for batch in batches:
            refused, so_far = [], []
            for own, estimate, actual in zip(*(batch.column(c).to_pylist() for c in ("run_id", "estimate", "actual")), strict=True):
                if own != run:
                    run, spent = own, 0
                no = spent + estimate > limit
                spent += 0 if no else actual
                refused.append(no)
                so_far.append(spent)
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("call_id"), pa.array(refused, pa.bool_()), pa.array(so_far, pa.int64())], names=["run_id", "call_id", "refused", "spent"])

    rows = calls.select(F.col("run_id").cast("long"), F.col("call_id").cast("long"), F.col("estimate").cast("long"), F.col("actual").cast("long"))
    return fold(rows, ["run_id"], ["call_id"], walk, "run_id long, call_id long, refused boolean, spent long")


#: Signs of text that a bin of spans covers.
BIN = 256


def overlapping(left: DataFrame, right: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Pairs of spans (doc_id, s0, s1) and (doc_id, g0, g1) that overlap, each once.

    A span goes to each bin it touches; a pair counts in the bin of the later of its two starts, which both touch.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bin_size))).alias("bin")
    some = left.where("s0 is not null and s1 is not null").select("*", bins("s0", "s1"))
    others = right.where("g0 is not null and g1 is not null").select("*", bins("g0", "g1"))
    return some.join(others, ["doc_id", "bin"]).where("s0 < g1 and g0 < s1").where(F.col("bin") == F.floor(F.greatest("s0", "g0") / bin_size)).drop("bin")


def stretches(spans: DataFrame) -> DataFrame:
    """(..., stretch) of spans (doc_id, a, b): spans that touch through others have one stretch, others don't."""
    in_order = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("a") >= reach).cast("int"), F.lit(1))
    return spans.withColumn("_begins", begins).withColumn("stretch", F.sum("_begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def first_fit(gold: DataFrame, pred: DataFrame, bin_size: int = BIN) -> DataFrame:
    """J-17: gold statements in order each take the first valid prediction, in order, that overlaps and isn't taken.

    A sweep over starts parts a document into stretches without overlap between them, so that a stretch is a key of its
    own; its pairs come from bins, in order, and are walked with the predictions taken so far.
    """
    valid = pred.where("validation_status = 'VALID'").select("doc_id", "idx", "s0", "s1", "status")
    known = gold.select("doc_id", "k", F.col("s0").alias("g0"), F.col("s1").alias("g1"), "split", F.col("status").alias("gold_status"))
    spans = known.select("doc_id", F.col("k").alias("own"), F.col("g0").alias("a"), F.col("g1").alias("b"), F.lit(True).alias("gold")).unionByName(valid.select("doc_id", F.col("idx").alias("own"), F.col("s0").alias("a"), F.col("s1").alias("b"), F.lit(False).alias("gold")))
    of = stretches(spans.where("a is not null and b is not null")).where("gold").select("doc_id", F.col("own").alias("k"), "stretch")
    pairs = overlapping(valid, known, bin_size).select("doc_id", "idx", "k", "split", "status", "gold_status").join(of, ["doc_id", "k"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, taken = None, None, set()
        for batch in batches:
            keep = []
            for i, (doc, stretch, k, idx) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "stretch", "k", "idx")), strict=True)):
                if (doc, stretch) != at:
                    at, last, taken = (doc, stretch), None, set()
                if k != last and idx not in taken:
                    last = k
                    taken.add(idx)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["doc_id", "idx", "k", "split", "status", "gold_status"])

    return fold(pairs, ["doc_id", "stretch"], ["k", "idx"], walk, "doc_id long, idx long, k long, split string, status string, gold_status string")
