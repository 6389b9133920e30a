"""Listings, aggregates, spend, constraints, alerts: rows, not renderings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bondsight.operators import folds
from bondsight.operators import reports as rp
from bondsight.plans.rating import ALL, BEFORE, CAND, NAME, before, decided  # noqa: F401
from bondsight.plans.registry import Registry

R = Registry()
D = ALL


@R.query("P01_unprocessed_docs", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0")
def unprocessed_docs(load):
    return rp.unprocessed(load("documents").withColumn("processed_at", F.when(F.col("doc_id") % 3 == 0, F.current_timestamp()))).select("doc_id", "n_chars")


@R.query("P02_document_status", "SELECT doc_id, lang, source, n_chars, CASE WHEN n_chars < 500 THEN 'short' ELSE 'full' END AS status FROM documents WHERE source = 'src3'")
def document_status(load):
    return load("documents").where("source = 'src3'").select("doc_id", "lang", "source", "n_chars", F.when(F.col("n_chars") < 500, "short").otherwise("full").alias("status"))


@R.query("P03_events_for", "SELECT event_key, eff, event_type FROM v_rating_events WHERE issuer_id = 'ISS3'")
def events_for(load):
    return load("v_rating_events").where("issuer_id = 'ISS3'").select("event_key", "eff", "event_type").orderBy("eff", "event_key")


@R.query("P04_audit_trail", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 OR event_id % 50 = 0")
def audit_trail(load):
    return load("events").where("user_id = 7 or event_id % 50 = 0").select("event_id", "user_id", "event_type")


@R.query("P05_alert_filter", f"SELECT event_key, family, coalesce({NAME.format('final_rank')}, 'NONE') AS priority FROM decided WHERE coalesce({NAME.format('final_rank')}, 'NONE') IN ('P1', 'NONE') AND family <> 'issuance'", **D)
def alert_filter(load):
    return rp.alerts(decided(load), ["P1", "NONE"], ["rating", "earnings"]).select("event_key", "family", "priority")


@R.query("P06_event_listing", f"SELECT event_key, family, coalesce({NAME.format('final_rank')}, 'undecided') AS priority, CASE family WHEN 'rating' THEN agency || ' ' || event_type WHEN 'issuance' THEN event_type ELSE coalesce(status, '-') END AS detail FROM decided", **D)
def event_listing(load):
    detail = F.when(F.col("family") == "rating", F.concat_ws(" ", "agency", "event_type")).when(F.col("family") == "issuance", F.col("event_type")).otherwise(F.coalesce("status", F.lit("-")))
    return decided(load).select("event_key", "family", F.coalesce("priority", F.lit("undecided")).alias("priority"), detail.alias("detail"))


@R.query("P07_universe_tag", "SELECT issuer_id, CASE WHEN first_key % 3 = 0 THEN 'live_watchlist' WHEN first_key % 3 = 1 THEN 'historical_stress_case' ELSE 'other' END AS universe FROM v_issuers")
def universe_tag(load):
    tags = F.array(F.when(F.col("first_key") % 3 == 0, F.lit("live")).when(F.col("first_key") % 3 == 1, F.lit("historical")).otherwise(F.lit("none")))
    return load("v_issuers").withColumn("tags", tags).select("issuer_id", rp.universe(F.col("tags")).alias("universe"))


@R.query("P08_sources_by_issuer", "SELECT e.event_key, e.event_key % 1000 + i AS doc_id, CAST(i AS INT) AS pos, d.doc_id IS NOT NULL AS available FROM v_earnings_events e, range(0, 2) r(i) LEFT JOIN documents d ON d.doc_id = e.event_key % 1000 + i")
def sources_by_issuer(load):
    base = F.col("event_key") % 1000
    rows = load("v_earnings_events").select("event_key", F.posexplode(F.array(base, base + 1)).alias("pos", "doc_id"))
    return rows.join(load("documents").select(F.col("doc_id").alias("_d")), F.col("doc_id") == F.col("_d"), "left").select("event_key", "doc_id", "pos", F.col("_d").isNotNull().alias("available"))


@R.query("A01_priority_summary", f"SELECT p.priority, count(d.event_key) AS n FROM (VALUES ('P1'), ('P2'), ('P3'), ('NONE')) p(priority) LEFT JOIN decided d ON coalesce({NAME.format('final_rank')}, 'NONE') = p.priority GROUP BY 1", **D)
def priority_summary(load):
    return rp.priority_summary(decided(load))


@R.query("A02_watchlist", f"SELECT i.issuer_id, coalesce(n, 0) AS n_events, last_event, CASE best WHEN 3 THEN 'P1' WHEN 2 THEN 'P2' WHEN 1 THEN 'P3' END AS highest FROM v_issuers i LEFT JOIN (SELECT issuer_id, count(*) AS n, max(eff) AS last_event, max(final_rank) AS best FROM decided GROUP BY 1) d USING (issuer_id)", **D)
def watchlist(load):
    return rp.watchlist(load("v_issuers"), decided(load)).select("issuer_id", "n_events", "last_event", "highest")


@R.query("A03_watchlist_groups", "SELECT grp, count(*) AS n FROM (SELECT CASE WHEN n IS NULL THEN 'not_ingested' WHEN first_key % 3 = 0 THEN 'live' WHEN first_key % 3 = 1 THEN 'historical' ELSE 'other' END AS grp FROM v_issuers LEFT JOIN (SELECT issuer_id, count(*) AS n FROM v_rating_events GROUP BY 1) USING (issuer_id)) GROUP BY 1")
def watchlist_groups(load):
    counts = load("v_rating_events").groupBy("issuer_id").agg(F.count("*").alias("n"))
    kind = F.when(F.col("n").isNull(), "not_ingested").when(F.col("first_key") % 3 == 0, "live").when(F.col("first_key") % 3 == 1, "historical").otherwise("other")
    return load("v_issuers").join(counts, "issuer_id", "left").groupBy(kind.alias("grp")).agg(F.count("*").alias("n"))


@R.query("A04_ingest_summary", "SELECT count(*) AS fetched, count(DISTINCT text) AS stored, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def ingest_summary(load):
    return rp.ingest_summary(load("documents"))


@R.query("A05_process_summary", "SELECT count(*) AS documents, count(*) FILTER (n_chars >= 500) AS full_texts, count(*) FILTER (lang = 'en') AS resolved, count(*) FILTER (lang <> 'en') AS unresolved FROM documents")
def process_summary(load):
    return load("documents").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") >= 500).alias("full_texts"), F.count_if(F.col("lang") == "en").alias("resolved"), F.count_if(F.col("lang") != "en").alias("unresolved"))


@R.query("A06_table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(load):
    return rp.table_counts({t: load(t) for t in ("orders", "lineitem", "documents", "events")})


@R.query("A07_run_status_mix", "SELECT status, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM v_calls GROUP BY 1")
def run_status_mix(load):
    return load("v_calls").groupBy("status").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@R.query("A08_latency_stats", "SELECT model, round(avg(latency_ms), 6) AS mean_ms, round(median(latency_ms), 6) AS median_ms, round(max(latency_ms), 6) AS max_ms FROM v_calls WHERE status = 'ok' GROUP BY 1")
def latency_stats(load):
    return rp.latency(load("v_calls").where("status = 'ok'"), "model")


SPEND = "SELECT c.*, (input_tokens * input_price + output_tokens * output_price) / 1e6 AS cost FROM v_calls c JOIN v_prices USING (model)"


@R.query("A09_spend", "SELECT call_id, round(CAST(cost AS DOUBLE), 6) AS cost FROM spend", spend=SPEND)
def spend(load):
    return rp.spend(load("v_calls"), load("v_prices")).select("call_id", F.round("cost", 6).alias("cost"))


@R.query("A10_token_estimate", "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 3) AS BIGINT) AS tokens FROM documents")
def token_estimate(load):
    return load("documents").select("doc_id", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 3).alias("tokens"))


CALLS = "SELECT run_id, call_id, input_tokens + output_tokens * 5 AS estimate, input_tokens + output_tokens * 4 AS actual FROM v_calls"
GATE = """SELECT run_id, call_id, refused, spent FROM (
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY call_id) AS rn FROM calls),
f AS (SELECT run_id, call_id, rn, estimate > 60000 AS refused, CASE WHEN estimate > 60000 THEN 0 ELSE actual END AS spent FROM n WHERE rn = 1
UNION ALL SELECT n.run_id, n.call_id, n.rn, f.spent + n.estimate > 60000, f.spent + CASE WHEN f.spent + n.estimate > 60000 THEN 0 ELSE n.actual END FROM f JOIN n ON n.run_id = f.run_id AND n.rn = f.rn + 1)
SELECT * FROM f)"""


@R.query("A11_budget_gate", "SELECT run_id, call_id, refused, spent FROM gate", calls=CALLS, gate=GATE)
def budget_gate(load):
    calls = load("v_calls").select("run_id", "call_id", (F.col("input_tokens") + F.col("output_tokens") * 5).alias("estimate"), (F.col("input_tokens") + F.col("output_tokens") * 4).alias("actual"))
    return folds.budget_gate(calls, 60_000)


@R.query("A12_spend_ledger", "SELECT run_id, call_id, round(CAST(sum(cost) OVER (PARTITION BY run_id ORDER BY call_id) AS DOUBLE), 6) AS spent FROM spend", spend=SPEND)
def spend_ledger(load):
    costs = rp.spend(load("v_calls"), load("v_prices"))
    return costs.select("run_id", "call_id", F.round(F.sum("cost").over(Window.partitionBy("run_id").orderBy("call_id").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("spent"))


@R.query("C08_constraints", """SELECT check_name, count(*) AS n FROM (SELECT 'span_order' AS check_name FROM v_pred WHERE s1 <= s0 UNION ALL SELECT 'notch_range' FROM v_rating_events WHERE new_notch NOT BETWEEN 7 AND 14
UNION ALL SELECT 'unique_line' FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'dated' FROM v_rating_candidates WHERE as_of IS NULL) GROUP BY 1""")
def constraints(load):
    bad = rp.violations({
        "span_order": load("v_pred").where("s1 <= s0"),
        "notch_range": load("v_rating_events").where("new_notch not between 7 and 14"),
        "unique_line": load("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "dated": load("v_rating_candidates").where("as_of is null"),
    })
    return bad.groupBy("check_name").agg(F.count("*").alias("n"))


@R.query("C09_gold_coherence", "SELECT doc_id, k, array_to_string([x FOR x IN [CASE WHEN status = 'cut' AND current_lower = 0 THEN 'cut without bound' END, CASE WHEN status = 'new' AND period IS NULL THEN 'new without period' END] IF x IS NOT NULL], ';') AS problems FROM v_gold WHERE (status = 'cut' AND current_lower = 0) OR (status = 'new' AND period IS NULL)")
def gold_coherence(load):
    problems = F.array_compact(F.array(F.when((F.col("status") == "cut") & (F.col("current_lower") == 0), F.lit("cut without bound")), F.when((F.col("status") == "new") & F.col("period").isNull(), F.lit("new without period"))))
    return load("v_gold").select("doc_id", "k", F.array_join(problems, ";").alias("problems")).where("problems != ''")


@R.query("C11_gold_drift", "SELECT doc_id FROM (SELECT doc_id, md5(string_agg(metric || status, ',' ORDER BY k)) AS h FROM v_gold GROUP BY 1) a FULL JOIN (SELECT doc_id, md5(string_agg(metric || CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE status END, ',' ORDER BY k)) AS h FROM v_gold WHERE doc_id % 10 <> 3 GROUP BY 1) b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h")
def gold_drift(load):
    old = load("v_gold").select("doc_id", "k", F.concat("metric", "status").alias("v"))
    new = load("v_gold").where("doc_id % 10 != 3").select("doc_id", "k", F.concat("metric", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("status"))).alias("v"))
    return rp.drift(old, new, "doc_id", "k", "v").select("doc_id")


@R.query("L02_alert_title", f"SELECT event_key, CASE WHEN new_notch > old_notch THEN agency || ' downgrade of ' || issuer_id || ' by ' || CAST(new_notch - old_notch AS VARCHAR) WHEN new_notch < old_notch THEN agency || ' upgrade of ' || issuer_id ELSE agency || ' affirms ' || issuer_id END AS title FROM v_rating_events")
def alert_title(load):
    return load("v_rating_events").select("event_key", rp.title().alias("title"))


@R.query("L03_alert_feed", f"SELECT event_key, family, {NAME.format('final_rank')} AS priority, eff FROM decided WHERE base_rank > 0 ORDER BY final_rank DESC, eff DESC NULLS LAST, family, event_key LIMIT 10", **D)
def alert_feed(load):
    feed = decided(load).where("base_rank > 0").orderBy(F.col("priority"), F.col("eff").desc_nulls_last(), "family", "event_key").limit(10)  # the report's ten
    return feed.select("event_key", "family", "priority", "eff")


@R.query("L04_key_facts", "SELECT doc_id, k, substr(metric || ' ' || status, 1, 300) AS fact FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM v_gold) WHERE r <= 3")
def key_facts(load):
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))
    return load("v_gold").withColumn("r", r).where("r <= 3").select("doc_id", "k", F.substring(F.concat_ws(" ", "metric", "status"), 1, 300).alias("fact"))


@R.query("L05_recorded_statements", "SELECT doc_id, string_agg(metric || ':' || status, ',' ORDER BY idx) AS statements, bool_or(status = 'cut') AS negative FROM v_pred WHERE validation_status = 'VALID' GROUP BY 1")
def recorded_statements(load):
    listed = F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(":", "metric", "status").alias("s"))))
    return load("v_pred").where("validation_status = 'VALID'").groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("statements"), F.bool_or(F.col("status") == "cut").alias("negative"))


@R.query("L06_model_provenance", "SELECT run_id, model, count(*) FILTER (status = 'ok') AS applied, count(*) AS recorded FROM v_calls GROUP BY 1, 2")
def model_provenance(load):
    return load("v_calls").groupBy("run_id", "model").agg(F.count_if(F.col("status") == "ok").alias("applied"), F.count("*").alias("recorded"))


@R.query("L01_alert_build", f"SELECT event_key, family, coalesce({NAME.format('final_rank')}, 'NONE') AS priority, len(triggered) AS n_rules, coalesce(n, 0) AS n_ratings FROM decided LEFT JOIN (SELECT event_key, 'rating' AS family, count(*) AS n FROM before GROUP BY 1) USING (event_key, family)", **D)
def alert_build(load):
    events, found = before(load)
    built = rp.build_alerts(decided(load), events, found)
    return built.select("event_key", "family", F.coalesce("priority", F.lit("NONE")).alias("priority"), F.size("rules").cast("long").alias("n_rules"), F.size("ratings").cast("long").alias("n_ratings"))


CARD = f"""SELECT d.event_key, '{{"family":"' || family || '"' || CASE WHEN final_rank IS NOT NULL THEN ',"priority":"' || {NAME.format('final_rank')} || '"' ELSE '' END || ',"rules":[' || array_to_string(list_transform(triggered, lambda r: '"' || r || '"'), ',') || '],"ratings":['
  || coalesce(CASE WHEN family = 'rating' THEN ratings END, '') || ']}}' AS card
FROM decided d LEFT JOIN (SELECT event_key, string_agg('{{"agency":"' || agency || '","notch":' || notch || ',"as_of":"' || CAST(as_of AS VARCHAR) || '"}}', ',' ORDER BY agency) AS ratings FROM before GROUP BY 1) b ON b.event_key = d.event_key"""


@R.query("L07_alert_card_json", CARD, **D)
def alert_card_json(load):
    events, found = before(load)
    return rp.build_alerts(decided(load), events, found).select("event_key", F.to_json(F.struct("family", "priority", "rules", "ratings")).alias("card"))


@R.query("L10_indicators", "SELECT event_key, label, value FROM (SELECT event_key, 'old' AS label, CAST(old_notch AS VARCHAR) AS value FROM v_rating_events UNION ALL SELECT event_key, 'new', CAST(new_notch AS VARCHAR) FROM v_rating_events UNION ALL SELECT event_key, 'outlook', new_outlook FROM v_rating_events) WHERE value IS NOT NULL")
def indicators(load):
    e = load("v_rating_events").select("event_key", F.col("old_notch").cast("string").alias("old"), F.col("new_notch").cast("string").alias("new"), F.col("new_outlook").alias("outlook"))
    return e.unpivot("event_key", ["old", "new", "outlook"], "label", "value").where("value is not null")


@R.query("J21_route", f"SELECT event_key, family, r.channels, r.mode FROM decided JOIN (VALUES ('P1', 'email,webhook', 'immediate'), ('P2', 'email', 'every 4 h'), ('P3', 'email', 'every 24 h')) r(priority, channels, mode) ON {NAME.format('final_rank')} = r.priority", **D)
def route(load):
    return rp.route(decided(load)).select("event_key", "family", "channels", "mode")


@R.query("J15_cache_lookup", "SELECT e.event_id, c.event_id IS NOT NULL AS hit FROM events e LEFT JOIN (SELECT max(event_id) AS event_id, event_type, user_id FROM events WHERE event_id % 4 = 0 GROUP BY 2, 3) c ON e.event_type = c.event_type AND e.user_id = c.user_id")
def cache_lookup(load):
    e = load("events").select("event_id", F.sha2(F.concat_ws("\x1f", "event_type", F.col("user_id").cast("string")), 256).alias("cache_key"))
    return rp.cache_lookup(e, e.where("event_id % 4 = 0").select("cache_key")).select("event_id", "hit")


@R.query("E18_outcome", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM v_pred WHERE validation_status = 'VALID') THEN 'EVENTS' WHEN doc_id IN (SELECT doc_id FROM v_pred) THEN 'OBSERVATIONS_ONLY' ELSE 'NO_EVENT' END AS outcome FROM documents")
def outcome(load):
    p = load("v_pred")
    return rp.outcomes(load("documents").select("doc_id"), p.where("validation_status = 'VALID'"), p).select("doc_id", "outcome")
