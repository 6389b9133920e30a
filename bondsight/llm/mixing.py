"""Operator 6, mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

A document's size is its number of words. Sources by code point, null last, weigh as `weights` says, over and over,
and share all sizes; no source's target exceeds `most` times its size, and what is above goes to the others by weight.
A source's target is so many whole passes over its documents and a rest. The rest goes to the documents whose hash is
below a threshold: sizes are summed by source and leading hash digit, the digit is found in which the sum passes the
rest, and only that digit's documents are summed by their next digit. No sort of documents, and the same documents
whenever it runs. A document's hash is of its id and text; equal rows go together. Null text has size 0, and a source
whose sizes are all 0 has target 0. A very long text is one size; if its source's rest ends inside its hash digit, it
goes in if that brings the sum nearer. Empty tables give no rows. Columns other than doc_id, text and source are not
read; rows that are repeated keep all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bondsight.llm import shared

WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of a digit, and digits: documents of one source that still share all of them go in or stay out together.
BITS, LEVELS = 12, 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to those and target: weighted shares of the whole, held to `most` times the size.

    A source is held if its limit by weight is low. With the held ones taken away, lowest first, the others' level is
    what remains by weight; those are held whose limit by weight is no higher than the level at their place.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("limit", most * F.col("source_size").cast("double"))
    everyone = Window.partitionBy()
    lower = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everyone).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(lower), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))))
    s = s.withColumn("held", F.col("limit") <= F.col("level") * F.col("weight"))
    free = F.when(~F.col("held"), F.col("weight"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("limit"))).over(everyone), F.lit(0.0))
    return s.select("source", "source_size", F.when(F.col("held"), F.col("limit")).otherwise(rest * F.col("weight") / F.sum(free).over(everyone)).alias("target"))


def digit(level: int) -> F.Column:
    return F.shiftrightunsigned(F.col("hash"), 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, rest) to (source, below): a source's documents with hash digits below `below` sum to about its rest.

    sized: (source, size, hash). Each level's sums are of the documents that share the boundary's digits so far.
    """
    at = budgets.select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        inside = sized.join(at, sized["source"].eqNullSafe(at["source"]) & (F.shiftrightunsigned(F.col("hash"), 64 - BITS * level) == F.col("below") if level else F.lit(True)), "inner")
        sums = inside.groupBy(at["source"], "left", "below", digit(level).alias("digit")).agg(F.sum("size").alias("size"))
        before = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        last = level == LEVELS - 1
        fits = F.when(F.col("before") + (F.col("size") / 2 if last else F.lit(0)) <= F.col("left"), F.col("digit"))
        found = sums.groupBy("source", "left", "below").agg(F.max(fits).alias("digit"), F.max_by("before", fits).alias("before"))
        digits = F.coalesce(F.col("digit") + int(last), F.lit(0))
        at = shared.settle(found.select("source", (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"), (F.shiftleft("below", BITS) + digits).alias("below")))
    return at.select("source", "below")


def sizes(docs: DataFrame) -> DataFrame:
    docs = shared.documents(docs, "source")
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(shared.TEXT_WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("hash"))


def plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Of each source (_source): source_size, target, passes, and the hash digits below which one pass more is taken."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    passes = F.coalesce(F.least(F.floor(F.try_divide("target", "source_size")), F.lit(most)), F.lit(0)).cast("long")
    goal = shared.settle(goal.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    below = thresholds(sized, goal.where((F.col("rest") > 0) & (F.col("passes") < most))).withColumnRenamed("source", "_source")
    both = goal.join(below, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return shared.settle(both.select(F.col("source").alias("_source"), "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below")))


def times(hash_: F.Column) -> F.Column:
    return F.col("passes") + (F.shiftrightunsigned(hash_, 64 - BITS * LEVELS) < F.col("below")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, times (passes) and taken (words)."""
    sized = shared.settle(sizes(docs))
    both = sized.join(plan(sized, weights, most), F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("times", times(F.col("hash")))
    return both.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs' own columns; each row as many times as the mix takes it."""
    goal = plan(shared.settle(sizes(docs)), weights, most).select("_source", "passes", "below")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("_row"), F.col("source").cast("string").alias("_own"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_hash"))
    rows = rows.join(goal, F.col("_own").eqNullSafe(F.col("_source")), "left").withColumn("_times", times(F.col("_hash")).cast("int")).where("_times > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
