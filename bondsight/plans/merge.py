"""Deduplication, merge, statements and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondsight.operators import dedup, enrich
from bondsight.plans.registry import Registry

R = Registry()


@R.query("D01_doc_exact_dedup", """SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CASE WHEN doc_id <> f THEN f END AS duplicate_of
FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS f FROM documents)""")
def doc_exact_dedup(load):
    return dedup.first_by_hash(load("documents"), "text", F.col("doc_id")).select("doc_id", "content_hash", "duplicate_of")


ARRIVALS = """SELECT event_key * 2 AS seq, issuer_id, agency, event_type, CASE WHEN event_key % 13 = 0 THEN NULL ELSE eff END AS eff, event_key FROM v_rating_events
UNION ALL SELECT event_key * 2 + 1, issuer_id, agency, event_type, CASE WHEN event_key % 17 = 0 THEN NULL ELSE eff + CAST(event_key % 4 AS INT) END, event_key FROM v_rating_events"""


def arrivals(load):
    e = load("v_rating_events").select("issuer_id", "agency", "event_type", "eff", "event_key")
    a = e.select((F.col("event_key") * 2).alias("seq"), "issuer_id", "agency", "event_type", F.when(F.col("event_key") % 13 != 0, F.col("eff")).alias("eff"), "event_key")
    b = e.select((F.col("event_key") * 2 + 1).alias("seq"), "issuer_id", "agency", "event_type", F.when(F.col("event_key") % 17 != 0, F.expr("date_add(eff, cast(event_key % 4 as int))")).alias("eff"), "event_key")
    return a.unionByName(b)


GREEDY = """SELECT seq, anchor FROM (
WITH RECURSIVE n AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', eff), -1) AS d, dense_rank() OVER (ORDER BY issuer_id, agency, event_type, eff IS NULL) AS g,
  row_number() OVER (PARTITION BY issuer_id, agency, event_type, eff IS NULL ORDER BY seq) AS rn FROM arrivals),
f AS (SELECT g, rn, seq, seq AS anchor, [{'o': seq, 'd': d}] AS anchors FROM n WHERE rn = 1
  UNION ALL SELECT n.g, n.rn, n.seq, coalesce([a.o FOR a IN f.anchors IF abs(a.d - n.d) <= 2][1], n.seq), CASE WHEN len([a FOR a IN f.anchors IF abs(a.d - n.d) <= 2]) > 0 THEN f.anchors ELSE list_append(f.anchors, {'o': n.seq, 'd': n.d}) END
  FROM f JOIN n ON n.g = f.g AND n.rn = f.rn + 1)
SELECT seq, anchor FROM f)"""


@R.query("D03_event_greedy_dedup", "SELECT * FROM greedy", arrivals=ARRIVALS, greedy=GREEDY)
def event_greedy_dedup(load):
    return dedup.greedy(arrivals(load), ["issuer_id", "agency", "event_type"], "eff", "seq").select("seq", "anchor")


@R.query("J13_event_dedup_band", "SELECT count(*) AS merged, count(*) FILTER (anchor % 2 = 0) AS on_first FROM greedy WHERE seq <> anchor", arrivals=ARRIVALS, greedy=GREEDY)
def event_dedup_band(load):
    placed = dedup.greedy(arrivals(load), ["issuer_id", "agency", "event_type"], "eff", "seq").where("seq != anchor")
    return placed.agg(F.count("*").alias("merged"), F.count_if(F.col("anchor") % 2 == 0).alias("on_first"))


@R.query("D04_merge_sources", "SELECT anchor, array_to_string(list_sort(list(DISTINCT a.event_key)), ',') AS sources, count(*) AS n FROM greedy g JOIN arrivals a USING (seq) GROUP BY 1", arrivals=ARRIVALS, greedy=GREEDY)
def merge_sources(load):
    placed = dedup.greedy(arrivals(load), ["issuer_id", "agency", "event_type"], "eff", "seq")
    return dedup.merged_sources(placed, "event_key").select("anchor", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), "n")


TERMS = """SELECT event_key % 500 AS id, event_key AS seq, currency, seniority, amount, CASE WHEN event_key % 3 = 0 THEN event_type END AS event_type FROM v_issuance_events"""


def terms(load):
    return load("v_issuance_events").select((F.col("event_key") % 500).alias("id"), F.col("event_key").alias("seq"), "currency", "seniority", "amount", F.when(F.col("event_key") % 3 == 0, F.col("event_type")).alias("event_type"))


@R.query("D02_same_id_merge", """SELECT id, CAST(arg_min(seq, r) AS BIGINT) AS seq, arg_min(currency, r) FILTER (currency IS NOT NULL) AS currency, arg_min(seniority, r) FILTER (seniority IS NOT NULL) AS seniority,
arg_min(amount, r) FILTER (amount IS NOT NULL) AS amount, arg_min(event_type, r) FILTER (event_type IS NOT NULL) AS event_type, count(*) AS merged
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -((currency IS NOT NULL)::INT + (seniority IS NOT NULL)::INT + (amount IS NOT NULL)::INT + (event_type IS NOT NULL)::INT), seq) AS r FROM terms) GROUP BY id""", terms=TERMS)
def same_id_merge(load):
    return dedup.richest(terms(load), "id", ["currency", "seniority", "amount", "event_type"], "seq")


@R.query("D05_obs_insert_ignore", "SELECT issuer_id, agency, as_of, min(source) AS source FROM v_rating_candidates GROUP BY 1, 2, 3")
def obs_insert_ignore(load):
    return dedup.one_per(load("v_rating_candidates").select("issuer_id", "agency", "as_of", "source"), ["issuer_id", "agency", "as_of"], F.col("source"))


@R.query("D06_stmt_first_wins", "SELECT doc_id, metric, arg_min(status, idx) AS status, min(idx) AS idx FROM v_pred GROUP BY 1, 2")
def stmt_first_wins(load):
    return dedup.one_per(load("v_pred").select("doc_id", "metric", "status", "idx"), ["doc_id", "metric"], F.col("idx"))


@R.query("D07_superseded_issuance", """SELECT issuer_id, event_type, event_key FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, event_type ORDER BY -((seniority IS NOT NULL)::INT + (amount IS NOT NULL)::INT), event_key) AS r FROM v_issuance_events) WHERE r = 1""")
def superseded_issuance(load):
    n = F.col("seniority").isNotNull().cast("int") + F.col("amount").isNotNull().cast("int")
    return dedup.one_per(load("v_issuance_events").select("issuer_id", "event_type", "event_key", "seniority", "amount"), ["issuer_id", "event_type"], -n, F.col("event_key")).select("issuer_id", "event_type", "event_key")


@R.query("D08_conflict_groups", "SELECT doc_id, metric, period, count(*) AS n, count(DISTINCT coalesce(status, '') || CAST(round(current_lower, 6) AS VARCHAR)) AS readings, count(DISTINCT coalesce(status, '') || CAST(round(current_lower, 6) AS VARCHAR)) > 1 AS conflict FROM v_pred GROUP BY 1, 2, 3")
def conflict_groups(load):
    return dedup.conflicts(load("v_pred"), ["doc_id", "metric", "period"], ["status", "current_lower"])


@R.query("D09_idempotent_apply", """SELECT enrichment_id, event_key, CASE WHEN enrichment_id % 3 = 0 THEN 'already_applied' WHEN EXISTS (SELECT 1 FROM e a WHERE a.enrichment_id % 3 = 0 AND a.event_key = e.event_key AND a.payload_hash = e.payload_hash) THEN 'unchanged' ELSE 'applied' END AS status FROM e""",
         e="SELECT event_key AS enrichment_id, event_key % 100 AS event_key, md5(event_type || coalesce(currency, '')) AS payload_hash FROM v_issuance_events")
def idempotent_apply(load):
    e = load("v_issuance_events").select(F.col("event_key").alias("enrichment_id"), (F.col("event_key") % 100).alias("event_key"), F.md5(F.concat("event_type", F.coalesce("currency", F.lit("")))).alias("payload_hash"))
    return dedup.apply_once(e, e.where("enrichment_id % 3 = 0")).select("enrichment_id", "event_key", "status")


BOUNDS = """SELECT event_key, issuer_id, metric, status, g_old AS previous_lower, CASE WHEN event_key % 3 = 0 THEN NULL ELSE g_old + 4 END AS previous_upper, CASE WHEN event_key % 7 = 0 THEN NULL ELSE g_new END AS current_lower, g_new + CASE WHEN event_key % 10 = 0 THEN -5 ELSE 6 END AS current_upper, CASE WHEN event_key % 11 = 0 THEN 'percent' ELSE 'eur' END AS unit FROM v_earnings_events"""


def bounds(load):
    k = F.col("event_key")
    return load("v_earnings_events").select("event_key", "issuer_id", "metric", "status", F.col("g_old").alias("previous_lower"), F.when(k % 3 != 0, F.col("g_old") + 4).alias("previous_upper"), F.when(k % 7 != 0, F.col("g_new")).alias("current_lower"), (F.col("g_new") + F.when(k % 10 == 0, -5).otherwise(6)).alias("current_upper"), F.when(k % 11 == 0, "percent").otherwise("eur").alias("unit"))


MID = "CASE WHEN {0}_lower > {0}_upper THEN NULL ELSE coalesce(({0}_lower + {0}_upper) / 2, {0}_lower, {0}_upper) END"
CHANGED = f"""SELECT *, CASE WHEN unit <> 'percent' AND abs(p) > 1e-9 THEN (c - p) / abs(p) * 100 END AS pct, c - p AS delta, CASE WHEN abs(c - p) < 1e-9 THEN 'unchanged' WHEN c > p THEN 'up' WHEN c < p THEN 'down' END AS direction,
CASE WHEN c IS NOT NULL AND p IS NOT NULL THEN 'quantitative' WHEN status IS NOT NULL THEN 'qualitative' ELSE 'none' END AS basis, coalesce(previous_lower > previous_upper OR current_lower > current_upper, false) OR coalesce(current_lower > current_upper, false) AS inverted
FROM (SELECT *, {MID.format('previous')} AS p, {MID.format('current')} AS c FROM bounds)"""


@R.query("G01_midpoint_delta", "SELECT event_key, round(p, 6) AS previous_mid, round(c, 6) AS current_mid, round(delta, 6) AS delta, round(pct, 6) AS pct, direction, inverted FROM changed", bounds=BOUNDS, changed=CHANGED)
def midpoint_delta(load):
    out = enrich.guidance_change(bounds(load))
    return out.select("event_key", *(F.round(c, 6).alias(c) for c in ("previous_mid", "current_mid", "delta", "pct")), "direction", "inverted")


@R.query("G02_change_basis", "SELECT basis, count(*) AS n FROM changed GROUP BY 1", bounds=BOUNDS, changed=CHANGED)
def change_basis(load):
    return enrich.guidance_change(bounds(load)).groupBy("basis").agg(F.count("*").alias("n"))


SIM = "CASE WHEN status = 'cut' AND pct <= -10 THEN 'ERN-02' WHEN status = 'cut' AND (pct < 0 OR pct IS NULL) THEN 'ERN-03' END"


@R.query("G03_simulate_rule", f"SELECT event_key, {SIM} AS rule FROM changed", bounds=BOUNDS, changed=CHANGED)
def simulate_rule(load):
    return enrich.guidance_change(bounds(load)).select("event_key", enrich.simulated_rule().alias("rule"))


@R.query("G04_governing_metric", f"""SELECT issuer_id, metric AS governing FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY CASE {SIM} WHEN 'ERN-02' THEN 2 WHEN 'ERN-03' THEN 1 ELSE 0 END DESC, round(coalesce(abs(pct), -1), 6) DESC, CASE metric WHEN 'revenue' THEN 0 WHEN 'adjusted ebitda' THEN 1 WHEN 'free cash flow' THEN 2 ELSE 3 END, event_key) AS r FROM changed WHERE metric IS NOT NULL) WHERE r = 1""", bounds=BOUNDS, changed=CHANGED)
def governing_metric(load):
    return enrich.governing(enrich.guidance_change(bounds(load)), "issuer_id", ["revenue", "adjusted ebitda", "free cash flow"]).select("issuer_id", "governing")


@R.query("G05_status_precedence", "SELECT issuer_id, CASE WHEN bool_or(status = 'cut') THEN 'cut' WHEN bool_or(status = 'withdrawn') THEN 'withdrawn' WHEN bool_or(status IN ('reaffirmed', 'in_line')) THEN 'reaffirmed' END AS status FROM bounds GROUP BY 1", bounds=BOUNDS)
def status_precedence(load):
    return enrich.strongest_status(bounds(load), "issuer_id")


@R.query("G06_carrier_fields", f"""SELECT issuer_id, event_key, round(p, 6) AS g_old, round(c, 6) AS g_new, round(pct, 6) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY CASE {SIM} WHEN 'ERN-02' THEN 2 WHEN 'ERN-03' THEN 1 ELSE 0 END DESC, round(coalesce(abs(pct), -1), 6) DESC, CASE metric WHEN 'revenue' THEN 0 WHEN 'adjusted ebitda' THEN 1 WHEN 'free cash flow' THEN 2 ELSE 3 END, event_key) AS r FROM changed WHERE metric IS NOT NULL) WHERE r = 1""", bounds=BOUNDS, changed=CHANGED)
def carrier_fields(load):
    out = enrich.governing(enrich.guidance_change(bounds(load)), "issuer_id", ["revenue", "adjusted ebitda", "free cash flow"])
    return out.select("issuer_id", "event_key", F.round("previous_mid", 6).alias("g_old"), F.round("current_mid", 6).alias("g_new"), F.round("pct", 6).alias("pct"))


@R.query("G07_family_flag", "SELECT issuer_id, bool_or(f_liquidity AND event_key % 4 <> 0) AS liquidity, bool_or(f_covenant AND event_key % 4 <> 0) AS covenant, bool_or(f_going_concern AND event_key % 4 <> 0) AS going_concern FROM v_earnings_events GROUP BY 1")
def family_flag(load):
    valid = load("v_earnings_events").withColumn("valid", F.col("event_key") % 4 != 0)
    return enrich.family_flags(valid, "issuer_id", {"liquidity": F.col("f_liquidity"), "covenant": F.col("f_covenant"), "going_concern": F.col("f_going_concern")})


MERGE = """SELECT event_key, CASE WHEN event_key % 2 = 0 THEN metric END AS d_metric, CASE WHEN event_key % 3 = 0 THEN g_old END AS d_old, CASE WHEN event_key % 4 = 0 THEN 'revenue' ELSE metric END AS n_metric, g_old AS n_old FROM v_earnings_events"""


@R.query("G08_fill_only_empty", "SELECT event_key, conflict, CASE WHEN conflict THEN d_metric ELSE coalesce(d_metric, n_metric) END AS metric, CASE WHEN conflict THEN d_old ELSE coalesce(d_old, n_old) END AS g_old FROM (SELECT *, coalesce(d_metric <> n_metric, false) OR coalesce(d_old <> n_old, false) AS conflict FROM m)", m=MERGE)
def fill_only_empty(load):
    k = F.col("event_key")
    m = load("v_earnings_events").select("event_key", F.when(k % 2 == 0, F.col("metric")).alias("d_metric"), F.when(k % 3 == 0, F.col("g_old")).alias("d_old"), F.when(k % 4 == 0, F.lit("revenue")).otherwise(F.col("metric")).alias("n_metric"), F.col("g_old").alias("n_old"))
    return enrich.fill_empty(m, {"metric": ("d_metric", "n_metric"), "g_old": ("d_old", "n_old")}).select("event_key", "conflict", "metric", "g_old")


@R.query("G09_flag_merge", "SELECT event_key, array_to_string(list_sort(list_distinct([x FOR x IN [CASE WHEN f_liquidity THEN 'liquidity' END, CASE WHEN f_covenant THEN 'covenant' END, CASE WHEN f_impairment THEN 'covenant' END] IF x IS NOT NULL])), ',') AS flags, f_covenant AND NOT f_impairment AS disagreement FROM v_earnings_events")
def flag_merge(load):
    have = F.array_compact(F.array(F.when(F.col("f_liquidity"), F.lit("liquidity")), F.when(F.col("f_covenant"), F.lit("covenant"))))
    out = enrich.merge_flag(load("v_earnings_events").withColumn("flags", have), "flags", "covenant", F.col("f_impairment"))
    return out.select("event_key", F.array_join(F.array_sort("flags"), ",").alias("flags"), "disagreement")


@R.query("G12_source_provenance", "SELECT run_id, CASE WHEN count(DISTINCT model) = 1 THEN min(model) ELSE '[' || array_to_string(list_sort(list(DISTINCT model)), ',') || ']' END AS model, count(DISTINCT status) AS statuses FROM v_calls GROUP BY 1")
def source_provenance(load):
    return enrich.provenance(load("v_calls"), "run_id", "model").join(load("v_calls").groupBy("run_id").agg(F.count_distinct("status").alias("statuses")), "run_id")


@R.query("J14_statements_to_events", "SELECT e.event_key, p.idx, p.metric FROM v_earnings_events e JOIN v_pred p ON p.doc_id = e.event_key % 1000 AND p.validation_status = 'VALID'")
def statements_to_events(load):
    return enrich.statements_of(load("v_earnings_events").select("event_key", F.array(F.col("event_key") % 1000).alias("doc_ids")), load("v_pred")).select("event_key", "idx", "metric")


@R.query("G11_apply_pipeline", "SELECT event_key, status, count(*) AS n FROM (SELECT e.event_key, CASE WHEN bool_or(p.status = 'cut') THEN 'cut' WHEN bool_or(p.status = 'reaffirmed') THEN 'reaffirmed' END AS status FROM v_earnings_events e JOIN v_pred p ON p.doc_id = e.event_key % 1000 AND p.validation_status = 'VALID' GROUP BY 1) GROUP BY 1, 2")
def apply_pipeline(load):
    linked = enrich.statements_of(load("v_earnings_events").select("event_key", F.array(F.col("event_key") % 1000).alias("doc_ids")), load("v_pred").withColumnRenamed("status", "status"))
    return enrich.strongest_status(linked, "event_key").groupBy("event_key", "status").agg(F.count("*").alias("n"))
