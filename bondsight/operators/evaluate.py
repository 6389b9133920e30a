"""Runs against gold: one-to-one matching, scores, categories, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicted_behaviour(pred: DataFrame) -> DataFrame:
    """Q-01: per document changed > maintained > mentioned > none, from valid statements."""
    valid = F.col("validation_status") == "VALID"
    has = lambda *s: F.bool_or(valid & F.col("status").isin(*s))
    return pred.groupBy("doc_id").agg(F.when(has("cut", "raised", "withdrawn"), "changed").when(has("reaffirmed", "in_line"), "maintained").when(F.bool_or(valid), "mentioned").otherwise("none").alias("predicted"))


def ranked_match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """J-16: one-to-one, first fit, on document, metric and period (case aside; null equals null). As equality sorts rows
    into classes, the n-th gold row of a class meets the n-th valid prediction."""
    period = F.lower("period")
    of = lambda order: Window.partitionBy("doc_id", "metric", period).orderBy(order)
    g = gold.withColumn("rn", F.row_number().over(of("k"))).select("doc_id", "metric", period.alias("p"), "rn", "k", "split", F.col("status").alias("gold_status"), F.col("current_lower").alias("gold_lower"), F.col("s0").alias("g0"), F.col("s1").alias("g1"))
    v = pred.where("validation_status = 'VALID'").withColumn("rn", F.row_number().over(of("idx")))
    v = v.select(F.col("doc_id").alias("_d"), F.col("metric").alias("_m"), period.alias("_p"), F.col("rn").alias("_r"), "idx", "status", "current_lower", "s0", "s1")
    return g.join(v, (g["doc_id"] == v["_d"]) & (g["metric"] == v["_m"]) & g["p"].eqNullSafe(v["_p"]) & (g["rn"] == v["_r"])).drop("_d", "_m", "_p", "_r")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(p: Column, r: Column) -> Column:
    """Null when either is null or 0."""
    return F.when((p != 0) & (r != 0), 2 * p * r / (p + r))


def occurrence_scores(gold: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """Q-03: one row of counts and rates."""
    g = gold.agg(F.count("*").alias("gold"))
    p = pred.agg(F.count("*").alias("predicted"), F.count_if(F.col("validation_status") == "VALID").alias("valid"))
    m = matched.agg(F.count("*").alias("matched"))
    one = g.withColumn("_", F.lit(1)).join(p.withColumn("_", F.lit(1)), "_").join(m.withColumn("_", F.lit(1)), "_").drop("_")
    one = one.withColumn("precision_valid", ratio(F.col("matched"), F.col("valid"))).withColumn("precision_all", ratio(F.col("matched"), F.col("predicted"))).withColumn("recall", ratio(F.col("matched"), F.col("gold")))
    return one.withColumn("f1", f1(F.col("precision_valid"), F.col("recall"))).withColumn("invalid_rate", ratio(F.col("predicted") - F.col("valid"), F.col("predicted")))


def field_agreement(matched: DataFrame) -> DataFrame:
    """Q-04: share of matched pairs that agree, by field, and of spans that overlap or are equal."""
    checks = {"status": F.col("status").eqNullSafe(F.col("gold_status")), "current_lower": F.abs(F.col("current_lower") - F.col("gold_lower")) < 1e-9, "span_overlap": (F.col("s0") < F.col("g1")) & (F.col("g0") < F.col("s1")), "span_equal": (F.col("s0") == F.col("g0")) & (F.col("s1") == F.col("g1"))}
    rows = matched.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.cast("int").alias("same")) for k, v in checks.items()))).alias("x")).select("x.*")
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("same").alias("agreement"))


def unmatched_overlapping(pred: DataFrame, matched: DataFrame, passages: DataFrame) -> DataFrame:
    """J-18: valid predictions without a match that overlap an ineligible passage (doc_id, p0, p1)."""
    left = pred.where("validation_status = 'VALID'").join(matched.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    p = passages.select(F.col("doc_id").alias("_d"), "p0", "p1")
    return left.join(p, (F.col("doc_id") == F.col("_d")) & (F.col("s0") < F.col("p1")) & (F.col("p0") < F.col("s1")), "left_semi")


def family_scores(gold: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """Q-05: statement precision, recall and status accuracy, by split and overall (split null)."""
    splits = gold.select("doc_id", "split").distinct()
    rows = gold.select("split", F.lit("g").alias("what"), F.lit(0).alias("ok")).unionByName(
        pred.where("validation_status = 'VALID'").join(splits, "doc_id").select("split", F.lit("p").alias("what"), F.lit(0).alias("ok"))
    ).unionByName(matched.select("split", F.lit("m").alias("what"), (F.col("status") == F.col("gold_status")).cast("int").alias("ok")))
    n = lambda w: F.count_if(F.col("what") == w)
    out = rows.cube("split").agg(n("g").alias("gold"), n("p").alias("valid"), n("m").alias("matched"), F.sum("ok").alias("status_ok"))
    return out.select("split", "gold", "valid", "matched", ratio(F.col("matched"), F.col("valid")).alias("precision"), ratio(F.col("matched"), F.col("gold")).alias("recall"), ratio(F.col("status_ok"), F.col("matched")).alias("status_accuracy"))


def categories(pred: DataFrame, matched: DataFrame) -> DataFrame:
    """Q-06: each prediction in one category: invalid by its first failed check, matched with the right or another status, or unsupported."""
    m = matched.select(F.col("doc_id").alias("_d"), F.col("idx").alias("_i"), (F.col("status") == F.col("gold_status")).alias("right"))
    out = pred.join(m, (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")), "left")
    check = F.substring_index("reason", ":", 1)
    category = F.when(F.col("validation_status") != "VALID", F.concat(F.lit("invalid_"), check)).when(F.col("right"), "correct").when(~F.col("right"), "wrong_status").otherwise("unsupported")
    return out.withColumn("category", category).drop("_d", "_i", "right")


def missed(gold: DataFrame, matched: DataFrame, categorised: DataFrame) -> DataFrame:
    """Q-07: gold rows without a match, with the category of the first invalid proposal of their document and metric."""
    left = gold.join(matched.select("doc_id", "k"), ["doc_id", "k"], "left_anti")
    bad = categorised.where("validation_status != 'VALID'").groupBy("doc_id", "metric").agg(F.min_by("category", "idx").alias("why"))
    return left.join(bad, ["doc_id", "metric"], "left").withColumn("why", F.coalesce("why", F.lit("not_proposed")))
