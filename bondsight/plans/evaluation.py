"""Evaluation of runs against gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondsight.operators import evaluate as ev
from bondsight.operators import folds
from bondsight.plans.registry import Registry

R = Registry()

MATCHED = """SELECT g.doc_id, g.k, g.split, g.metric, v.idx, v.status, g.status AS gold_status, v.current_lower, g.current_lower AS gold_lower, v.s0, v.s1, g.s0 AS g0, g.s1 AS g1 FROM
(SELECT *, row_number() OVER (PARTITION BY doc_id, metric, lower(period) ORDER BY k) AS rn FROM v_gold) g JOIN
(SELECT *, row_number() OVER (PARTITION BY doc_id, metric, lower(period) ORDER BY idx) AS rn FROM v_pred WHERE validation_status = 'VALID') v
ON g.doc_id = v.doc_id AND g.metric = v.metric AND lower(g.period) IS NOT DISTINCT FROM lower(v.period) AND g.rn = v.rn"""
M = {"matched": MATCHED}


def matched(load):
    return ev.ranked_match(load("v_gold"), load("v_pred"))


@R.query("J16_gold_match", "SELECT doc_id, k, idx, metric FROM matched", **M)
def gold_match(load):
    return matched(load).select("doc_id", "k", "idx", "metric")


#: Overlapping pairs in order, walked one at a time with what is taken.
FIT = {
    "pairs": "SELECT g.doc_id, g.k, p.idx, g.split, p.status, g.status AS gold_status, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.k, p.idx) AS rn FROM v_gold g JOIN v_pred p ON g.doc_id = p.doc_id AND p.validation_status = 'VALID' AND p.s0 < g.s1 AND g.s0 < p.s1",
    "fit": """SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ks, CAST([] AS BIGINT[]) AS ids, false AS hit FROM (SELECT DISTINCT doc_id FROM pairs)
UNION ALL SELECT p.doc_id, p.rn, CASE WHEN fresh THEN list_append(ks, p.k) ELSE ks END, CASE WHEN fresh THEN list_append(ids, p.idx) ELSE ids END, fresh
FROM (SELECT q.*, ks, ids, NOT list_contains(ks, q.k) AND NOT list_contains(ids, q.idx) AS fresh FROM fit JOIN pairs q ON q.doc_id = fit.doc_id AND q.rn = fit.rn + 1) p""",
}


@R.query("J17_gold_span_match", "SELECT doc_id, idx, k, split, status, gold_status FROM fit JOIN pairs USING (doc_id, rn) WHERE hit", **FIT)
def gold_span_match(load):
    return folds.first_fit(load("v_gold"), load("v_pred"))


@R.query("J18_ineligible_overlap", "SELECT doc_id, idx FROM v_pred p WHERE validation_status = 'VALID' AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = p.doc_id AND m.idx = p.idx) AND EXISTS (SELECT 1 FROM v_gold g WHERE g.doc_id = p.doc_id AND g.k % 2 = 1 AND p.s0 < g.s1 AND g.s0 < p.s1)", **M)
def ineligible_overlap(load):
    passages = load("v_gold").where("k % 2 = 1").select("doc_id", F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    return ev.unmatched_overlapping(load("v_pred"), matched(load), passages).select("doc_id", "idx")


BEHAVIOUR = "SELECT doc_id, CASE WHEN bool_or(validation_status = 'VALID' AND status IN ('cut', 'raised', 'withdrawn')) THEN 'changed' WHEN bool_or(validation_status = 'VALID' AND status IN ('reaffirmed', 'in_line')) THEN 'maintained' WHEN bool_or(validation_status = 'VALID') THEN 'mentioned' ELSE 'none' END AS predicted FROM v_pred GROUP BY 1"
GOLD_BEHAVIOUR = "SELECT doc_id, CASE WHEN bool_or(status IN ('cut', 'raised')) THEN 'changed' WHEN bool_or(status = 'reaffirmed') THEN 'maintained' ELSE 'mentioned' END AS behaviour FROM v_gold GROUP BY 1"


@R.query("Q01_predicted_behaviour", BEHAVIOUR)
def predicted_behaviour(load):
    return ev.predicted_behaviour(load("v_pred"))


@R.query("Q02_confusion", "SELECT behaviour, count(*) FILTER (predicted = 'changed') AS changed, count(*) FILTER (predicted = 'maintained') AS maintained, count(*) FILTER (predicted = 'mentioned') AS mentioned, count(*) FILTER (coalesce(predicted, 'none') = 'none') AS none FROM g LEFT JOIN p USING (doc_id) GROUP BY 1", g=GOLD_BEHAVIOUR, p=BEHAVIOUR)
def confusion(load):
    has = lambda *s: F.bool_or(F.col("status").isin(*s))
    gold = load("v_gold").groupBy("doc_id").agg(F.when(has("cut", "raised"), "changed").when(has("reaffirmed"), "maintained").otherwise("mentioned").alias("behaviour"))
    both = gold.join(ev.predicted_behaviour(load("v_pred")), "doc_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit("none")))
    return both.groupBy("behaviour").pivot("predicted", ["changed", "maintained", "mentioned", "none"]).count().fillna(0)


@R.query("Q03_occurrence_scores", """SELECT gold, predicted, valid, matched, matched / valid AS precision_valid, matched / predicted AS precision_all, matched / gold AS recall, 2 * (matched / valid) * (matched / gold) / (matched / valid + matched / gold) AS f1, (predicted - valid) / predicted AS invalid_rate
FROM (SELECT (SELECT count(*) FROM v_gold) AS gold, (SELECT count(*) FROM v_pred) AS predicted, (SELECT count(*) FROM v_pred WHERE validation_status = 'VALID') AS valid, (SELECT count(*) FROM matched) AS matched)""", **M)
def occurrence_scores(load):
    return ev.occurrence_scores(load("v_gold"), load("v_pred"), matched(load))


@R.query("Q04_field_agreement", """SELECT 'status' AS field, count(*) AS n, avg(CAST(status = gold_status AS INT)) AS agreement FROM matched UNION ALL SELECT 'current_lower', count(*), avg(CAST(abs(current_lower - gold_lower) < 1e-9 AS INT)) FROM matched
UNION ALL SELECT 'span_overlap', count(*), avg(CAST(s0 < g1 AND g0 < s1 AS INT)) FROM matched UNION ALL SELECT 'span_equal', count(*), avg(CAST(s0 = g0 AND s1 = g1 AS INT)) FROM matched""", **M)
def field_agreement(load):
    return ev.field_agreement(matched(load))


@R.query("Q05_family_scores", """SELECT split, gold, valid, matched, matched / nullif(valid, 0) AS precision, matched / nullif(gold, 0) AS recall, ok / nullif(matched, 0) AS status_accuracy FROM (
SELECT split, count(*) FILTER (w = 'g') AS gold, count(*) FILTER (w = 'p') AS valid, count(*) FILTER (w = 'm') AS matched, CAST(sum(ok) AS BIGINT) AS ok FROM (
SELECT split, 'g' AS w, 0 AS ok FROM v_gold UNION ALL SELECT s.split, 'p', 0 FROM v_pred p JOIN (SELECT DISTINCT doc_id, split FROM v_gold) s USING (doc_id) WHERE validation_status = 'VALID'
UNION ALL SELECT split, 'm', CAST(status = gold_status AS INT) FROM matched) GROUP BY GROUPING SETS ((split), ()))""", **M)
def family_scores(load):
    return ev.family_scores(load("v_gold"), load("v_pred"), matched(load))


CATEGORY = """SELECT p.*, CASE WHEN validation_status <> 'VALID' THEN 'invalid_' || split_part(reason, ':', 1) WHEN m.idx IS NULL THEN 'unsupported' WHEN p.status = m.gold_status THEN 'correct' ELSE 'wrong_status' END AS category
FROM v_pred p LEFT JOIN (SELECT doc_id, idx, gold_status FROM matched) m ON p.doc_id = m.doc_id AND p.idx = m.idx"""


@R.query("Q06_statement_category", "SELECT category, count(*) AS n FROM cat GROUP BY 1", **M, cat=CATEGORY)
def statement_category(load):
    return ev.categories(load("v_pred"), matched(load)).groupBy("category").agg(F.count("*").alias("n"))


@R.query("Q07_missed_gold", "SELECT g.doc_id, g.k, coalesce(why, 'not_proposed') AS why FROM v_gold g LEFT JOIN (SELECT doc_id, metric, arg_min(category, idx) AS why FROM cat WHERE validation_status <> 'VALID' GROUP BY 1, 2) b ON g.doc_id = b.doc_id AND g.metric = b.metric WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = g.doc_id AND m.k = g.k)", **M, cat=CATEGORY)
def missed_gold(load):
    m = matched(load)
    return ev.missed(load("v_gold"), m, ev.categories(load("v_pred"), m)).select("doc_id", "k", "why")


@R.query("Q08_compare_runs", "SELECT metric, count(*) FILTER (doc_id % 2 = 0 AND validation_status = 'VALID') AS run_a, count(*) FILTER (doc_id % 2 = 1 AND validation_status = 'VALID') AS run_b FROM v_pred GROUP BY 1")
def compare_runs(load):
    valid = load("v_pred").withColumn("run", F.when(F.col("doc_id") % 2 == 0, "run_a").otherwise("run_b")).withColumn("v", (F.col("validation_status") == "VALID").cast("long"))
    return valid.groupBy("metric").pivot("run", ["run_a", "run_b"]).agg(F.sum("v"))


@R.query("Q09_flag_per_document", "SELECT d.doc_id, d.doc_id % 3 = 0 AS expected, p.predicted FROM (SELECT DISTINCT doc_id FROM v_gold) d LEFT JOIN (SELECT doc_id, bool_or(validation_status = 'VALID' AND status = 'cut') AS predicted FROM v_pred GROUP BY 1) p USING (doc_id)")
def flag_per_document(load):
    docs = load("v_gold").select("doc_id").distinct().withColumn("expected", F.col("doc_id") % 3 == 0)
    run = load("v_pred").groupBy("doc_id").agg(F.bool_or((F.col("validation_status") == "VALID") & (F.col("status") == "cut")).alias("predicted"))
    return docs.join(run, "doc_id", "left")


@R.query("Q10_featured_check", "SELECT g.doc_id, g.k, CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN p.status <> g.status THEN 'other status' END AS problem FROM v_gold g LEFT JOIN v_pred p ON g.doc_id = p.doc_id AND g.k = p.idx WHERE p.doc_id IS NULL OR p.status <> g.status")
def featured_check(load):
    p = load("v_pred").select(F.col("doc_id").alias("_d"), F.col("idx").alias("_i"), F.col("status").alias("got"))
    g = load("v_gold").join(p, (F.col("doc_id") == F.col("_d")) & (F.col("k") == F.col("_i")), "left")
    problem = F.when(F.col("_d").isNull(), "missing").when(F.col("got") != F.col("status"), "other status")
    return g.select("doc_id", "k", problem.alias("problem")).where("problem is not null")


@R.query("A13_rejections_by_reason", "SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM v_pred WHERE validation_status <> 'VALID' GROUP BY 1")
def rejections_by_reason(load):
    return load("v_pred").where("validation_status != 'VALID'").groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


@R.query("V03_bounds_in_order", "SELECT metric, count(*) AS n, count(*) FILTER (s1 > s0) AS spans_ok FROM v_pred GROUP BY 1")
def bounds_in_order(load):
    return load("v_pred").groupBy("metric").agg(F.count("*").alias("n"), F.count_if(F.col("s1") > F.col("s0")).alias("spans_ok"))
