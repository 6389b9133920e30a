"""Ordered folds against plain walks."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bondsight.operators import folds

SPANS = "doc_id long, {} long, s0 long, s1 long, {} string, status string"


@pytest.mark.parametrize(("bin_size", "most"), [(7, 30), (256, 30), (16, 400)])
def test_first_fit_of_overlapping_spans(spark, bin_size, most):
    """Random spans, some empty, long, null or repeated, and a document of very many; bins smaller and larger than spans."""
    rng = random.Random(5)
    span = lambda: (None, None) if rng.random() < 0.05 else (lambda a: (a, a + rng.randint(0, most)))(rng.randint(0, 100))
    many = lambda d: 300 if d == 3 else 6
    gold = [(d, k, *span(), "dev", "cut") for d in range(8) for k in range(many(d))]
    pred = [(d, i, *span(), "VALID" if rng.random() < 0.8 else "INVALID", "cut") for d in range(9) for i in range(many(d))]
    want = set()
    for d in range(8):
        taken = set()
        for _, k, a, b, *_ in (g for g in gold if g[0] == d):
            hit = next((p[1] for p in pred if p[0] == d and p[4] == "VALID" and p[1] not in taken and None not in (a, p[2]) and a < p[3] and p[2] < b), None)
            if hit is not None:
                taken.add(hit)
                want.add((d, k, hit))
    found = folds.first_fit(spark.createDataFrame(gold, SPANS.format("k", "split")), spark.createDataFrame(pred, SPANS.format("idx", "validation_status")), bin_size)
    assert {(r.doc_id, r.k, r.idx) for r in found.collect()} == want and len(want) > 100


def test_stretches(spark):
    spans = [(1, 0, 5), (1, 3, 9), (1, 9, 12), (1, 20, 90), (1, 30, 31), (1, 89, 95), (2, 0, 1), (2, 1, 1), (2, 1, 4)]
    got = {(r.doc_id, r.a, r.b): r.stretch for r in folds.stretches(spark.createDataFrame(spans, "doc_id long, a long, b long")).collect()}
    assert [got[s] for s in spans] == [1, 1, 2, 3, 3, 3, 1, 2, 3]


def gate(calls, limit):
    spent, out = {}, []
    for run, call, estimate, actual in sorted(calls):
        no = spent.get(run, 0) + estimate > limit
        spent[run] = spent.get(run, 0) + (0 if no else actual)
        out.append((run, call, no, spent[run]))
    return out


def test_budget_gate(spark):
    rng = random.Random(3)
    calls = [(rng.randint(0, 3), i, rng.randint(1, 90), rng.randint(1, 90)) for i in rng.sample(range(10_000), 900)]
    got = sorted(tuple(r) for r in folds.budget_gate(spark.createDataFrame(calls, "run_id long, call_id long, estimate long, actual long"), 2000).collect())
    assert got == gate(calls, 2000) and 50 < sum(r[2] for r in got) < 900


def test_budget_gate_of_one_long_run(spark):
    """Two million calls of one run."""
    n = 2_000_000
    calls = spark.range(n).select(F.lit(7).alias("run_id"), F.col("id").alias("call_id"), F.lit(3).alias("estimate"), F.lit(2).alias("actual"))
    row = folds.budget_gate(calls, 1_000_000).agg(F.count_if("refused").alias("refused"), F.max("spent").alias("spent"), F.min_by("call_id", F.when(F.col("refused"), F.col("call_id"))).alias("first")).first()
    assert (row.refused, row.spent, row.first) == (n - 499_999, 999_998, 499_999)


def test_walk_holds_a_batch(monkeypatch):
    walks = []
    monkeypatch.setattr(folds, "fold", lambda rows, keys, order, walk, schema: walks.append(walk))

    class Rows:
        def select(self, *_):
            return self

    monkeypatch.setattr(folds.F, "col", lambda c: type("C", (), {"cast": lambda self, t: self})())
    folds.budget_gate(Rows(), 10**8)
    size, batches = 10_000, 60
    columns = {"run_id": [7] * size, "call_id": list(range(size)), "estimate": [300] * size, "actual": [250] * size}
    made = pa.record_batch({k: pa.array(v, pa.int64()) for k, v in columns.items()})
    tracemalloc.start()
    last = None
    for last in walks[0](made for _ in range(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last.column("spent")[-1].as_py() == 10**8 or last.column("refused")[-1].as_py()
    assert peak < 20_000_000
