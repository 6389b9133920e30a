"""Seeds, feeds, tables in text, finer validation, notes, late events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondsight.operators import corpus as c
from bondsight.operators import enrich, rules
from bondsight.operators import validate as v
from bondsight.plans.corpus import SPANS, spans
from bondsight.plans.rating import ALL, decided
from bondsight.plans.registry import Registry
from bondsight.sources import tables as src
from bondsight.sources.views import quoted

R = Registry()


#: Cells as agencies and issuers spell them, with outlook and watch as they should be read.
CELLS = [
    ("Stable", "stable", "none"), (" NEGATIVE ", "negative", "none"), ("Developing", "developing", "none"), ("stabel", None, "none"), ("Négative", None, "none"), ("", None, "none"), (None, None, "none"), ("Outlook stable", None, "none"),
    ("Review for downgrade", None, "negative"), ("On CreditWatch Positive", None, "positive"), ("rating watch negative (RWN)", None, "negative"), ("Review direction uncertain", None, "developing"), ("under review", None, "none"), ("Stable; RWP", None, "positive"),
]


@R.query("M06_outlook_watch", f"SELECT event_key, CASE event_key % {len(CELLS)} " + " ".join(f"WHEN {i} THEN {quoted(o)}" for i, (_, o, _) in enumerate(CELLS)) + f" END AS outlook, CASE event_key % {len(CELLS)} " + " ".join(f"WHEN {i} THEN {quoted(w)}" for i, (*_, w) in enumerate(CELLS)) + " END AS watch FROM v_rating_events")
def outlook_watch(load):
    cells = F.array(*(F.lit(c) for c, *_ in CELLS))
    outlook, watch = src.outlook_watch(F.get(cells, (F.col("event_key") % len(CELLS)).cast("int")))
    return load("v_rating_events").select("event_key", outlook.alias("outlook"), watch.alias("watch"))


#: Dates as seed files spell them; only a full day is one.
SPELLED = [("2024-05-06", "2024-05-06"), (" 2024-02-29 ", "2024-02-29"), ("2023-02-29", None), ("2024-05", None), ("2024", None), ("May 6, 2024", None), ("2024-5-6", None), ("2024-05-06T00:00", None), ("06/05/2024", None), ("", None), (None, None)]


@R.query("M07_partial_date", f"SELECT event_key, CASE event_key % {len(SPELLED) + 1} " + " ".join(f"WHEN {i} THEN CAST({quoted(d)} AS DATE)" for i, (_, d) in enumerate(SPELLED)) + " ELSE eff END AS as_of FROM v_rating_events")
def partial_date(load):
    texts = F.array(*(F.lit(x) for x, _ in SPELLED))
    at = (F.col("event_key") % (len(SPELLED) + 1)).cast("int")
    return load("v_rating_events").select("event_key", src.partial_date(F.when(at < len(SPELLED), F.get(texts, at)).otherwise(F.col("eff").cast("string"))).alias("as_of"))


@R.query("M08_verification_rank", "SELECT event_key, event_key % 5 >= 3 AS enough FROM v_rating_events")
def verification_rank(load):
    level = F.element_at(F.array(*map(F.lit, src.LADDER)), (F.col("event_key") % 5 + 1).cast("int"))
    return load("v_rating_events").select("event_key", src.verified_at_least(level, "DATE_VERIFIED").alias("enough"))


@R.query("S08_seed_load", "SELECT event_key AS row_id, CASE WHEN event_key % 7 <> 0 THEN e.agency END AS agency, CASE WHEN event_key % 7 <> 0 AND event_key % 11 <> 0 AND s.notch IS NOT NULL THEN e.new_notch END AS notch, new_outlook AS outlook, 'none' AS watch, eff AS as_of, CASE WHEN event_key % 7 = 0 THEN 'unknown agency' WHEN event_key % 11 = 0 OR s.notch IS NULL THEN 'unknown label' END AS reject FROM v_rating_events e LEFT JOIN (SELECT DISTINCT agency, notch FROM v_scale) s ON s.agency = e.agency AND s.notch = e.new_notch")
def seed_load(load):
    """The events' agencies, labels, outlooks and dates as a seed file spells them; some names and labels are unknown."""
    from bondsight.functions.scales import notch_to_label

    k = F.col("event_key")
    rows = notch_to_label(load("v_rating_events"), "agency", "new_notch", "label")
    name = F.when(k % 7 == 0, "Nobody").when(F.col("agency") == "SP", "S&P Global").when(F.col("agency") == "MOODYS", " moody's ").otherwise(F.col("agency"))
    label = F.when(k % 11 == 0, "Z9").when((k % 2 == 0) & (F.col("agency") != "MOODYS"), F.lower("label")).otherwise(F.col("label"))
    return src.load_seeds(rows.select(k.alias("row_id"), name.alias("rating_agency"), label.alias("rating"), F.initcap("new_outlook").alias("outlook_text"), F.col("eff").cast("string").alias("rating_date"))).withColumn("watch", F.coalesce("watch", F.lit("none")))


@R.query("S03_feed_entries", "SELECT doc_id % 10 AS feed, doc_id AS pos, 'http://x/' || CAST(doc_id AS VARCHAR) AS link FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS r FROM v_documents WHERE published >= DATE '2024-01-01' AND regexp_matches(added, 'guidance|rating') AND doc_id % 4 <> 3) WHERE r <= 3")
def feed_entries(load):
    e = load("v_documents").select((F.col("doc_id") % 10).alias("feed"), F.col("doc_id").alias("pos"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("link"), F.col("added").alias("title"), "published", F.when(F.col("doc_id") % 4 == 3, F.array(F.lit("other"))).otherwise(F.array(F.lit("Results"), F.lit("x"))).alias("categories"))
    return src.feed_entries(e, F.lit("2024-01-01").cast("date"), "guidance|rating", ["results"], 3)


@R.query("S04_sitemap_urls", "SELECT page_id % 5 AS site, url AS loc FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id % 40 DESC, url) AS r FROM pages WHERE page_id % 3 <> 0) WHERE r <= 4")
def sitemap_urls(load):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 40).cast("int"))
    rows = load("pages").where("page_id % 3 != 0").select((F.col("page_id") % 5).alias("site"), F.col("url").alias("loc"), day.alias("lastmod"))
    return src.sitemap_urls(rows, F.lit("2024-01-01").cast("date"), "/", 4).select("site", "loc")


@R.query("S09_universe_load", "SELECT alias, count(DISTINCT issuer_id) AS n FROM (SELECT issuer_id, lower(issuer_id) AS alias FROM v_issuers UNION ALL SELECT issuer_id, 'group ' || CAST(first_key % 7 AS VARCHAR) FROM v_issuers) GROUP BY 1 HAVING count(DISTINCT issuer_id) > 1")
def universe_load(load):
    u = load("v_issuers").select("issuer_id", F.col("issuer_id").alias("name"), F.array(F.concat(F.lit("Group "), (F.col("first_key") % 7).cast("string"))).alias("aliases"))
    each, shared = src.alias_rows(u)
    return each.join(shared, "alias").groupBy("alias").agg(F.count_distinct("issuer_id").alias("n"))


@R.query("S12_table_sinks", "SELECT issuer_id, arg_max(new_notch, (eff, event_key)) AS notch, CASE WHEN max(eff) >= DATE '1999-01-01' THEN 'second' ELSE 'first' END AS run FROM v_rating_events WHERE agency = 'SP' GROUP BY 1")
def table_sinks(load):
    """The last notch of each issuer, stored in two runs: the second replaces issuers with later events, and is given twice."""
    e = load("v_rating_events").where("agency = 'SP'")
    spark, path = e.sparkSession, src.shared_folder(e.sparkSession)
    last = lambda df, run: df.groupBy("issuer_id").agg(F.max_by("new_notch", F.struct("eff", "event_key")).alias("notch")).withColumn("run", F.lit(run))
    cut = F.lit("1999-01-01").cast("date")
    for _ in range(2):
        src.insert_absent(spark, last(e.where(F.col("eff") < cut), "first"), path, "issuer_id")
    touched = e.join(e.where(F.col("eff") >= cut).select("issuer_id").distinct(), "issuer_id", "left_semi")
    return src.upserted(spark.read.parquet(path), last(touched, "second"), "issuer_id")


@R.query("C10_gold_build_check", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'quote not found' WHEN NOT regexp_matches(added, '(?i)\\bbreach') THEN 'status not supported' END AS problem FROM v_documents")
def gold_build_check(load):
    docs = load("v_documents")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("added", F.lit(" not in the text at all"))).otherwise(F.col("added")).alias("quote"), F.lit("breached").alias("status"))
    return src.gold_build(labels, docs).select("doc_id", "problem")


@R.query("V02_span_fuzzy")
def span_fuzzy(load):
    """Each document's passage, every twelfth sign of it replaced or left out; so many as a place may differ by, or more."""
    signs = F.split("added", "")
    told = F.transform(signs, lambda x, i: F.when((i + F.col("doc_id")) % 12 != 0, x).when(F.col("doc_id") % 3 == 0, F.lit("#")).when((F.col("doc_id") % 3 == 1) | (i % 2 == 0), F.lit("")).otherwise(F.concat(F.lit("~"), F.lit("#"))))
    docs = load("v_documents")
    quotes = docs.select("doc_id", F.lit(0).cast("long").alias("k"), F.array_join(told, "").alias("quote"))
    return v.fuzzy_spans(quotes, docs)


LABELS = {"revenue": "revenue", "ebitda": "ebitda", "fcf": "free cash flow", "margin": "margin"}


@R.query("V04_metric_match", "SELECT doc_id, k, contains(lower(text), CASE metric " + " ".join(f"WHEN '{m}' THEN '{x}'" for m, x in LABELS.items()) + " END) AND metric <> 'ebitda' AS ok FROM v_gold JOIN v_documents USING (doc_id)")
def metric_match(load):
    """Gold metrics against their documents' text; the label of ebitda rows is one that fits no such metric."""
    label = F.when(F.col("metric") == "ebitda", "guidance")
    for m, x in LABELS.items():
        label = label.when(F.col("metric") == m, x)
    both = load("v_gold").join(load("v_documents").select("doc_id", "text"), "doc_id")
    return both.select("doc_id", "k", v.metric_match(label, F.col("metric"), F.col("text")).alias("ok"))


@R.query("V07_scope_match", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 3 THEN lower(c_mktsegment) END AS segment FROM customer")
def scope_match(load):
    """Statements about a customer's market segment, in the label, as holder or introduced; one in four about the group."""
    k, segment = F.col("c_custkey") % 4, F.lower("c_mktsegment")
    rows = load("customer").select(F.col("c_custkey").alias("id"), F.lit("I").alias("issuer_id"), F.when(k == 0, F.concat(F.lit("Capex "), "c_mktsegment")).otherwise("Capex").alias("label"), F.when(k == 1, F.concat(F.lit("Capex for the "), segment, F.lit(" fell"))).when(k == 2, F.concat(segment, F.lit("'s ratio fell"))).otherwise(F.concat(F.lit("Group capex, not "), segment, F.lit(", fell"))).alias("quote"))
    return v.segment_named(rows, load("customer").select(F.lit("I").alias("issuer_id"), segment.alias("segment")).distinct())


SEGMENTS = ("widget", "small widget", "cold widget", "brand 1", "brand")


@R.query("J19_segment_guard", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN list_max(hits) WHEN 3 THEN CASE WHEN len(hits) > 0 THEN list_max(hits) END WHEN 1 THEN list_max(hits) ELSE NULL END AS segment FROM (SELECT p_partkey, list_filter(" + str(list(SEGMENTS)) + ", lambda s: CASE p_partkey % 5 WHEN 0 THEN regexp_matches(lower(p_name), '^' || s || '\\b') WHEN 1 THEN regexp_matches(lower(p_name), '\\b' || s || '\\b') WHEN 3 THEN regexp_matches(lower(p_name), '\\b' || s || '$') ELSE false END) AS h FROM part), LATERAL (SELECT list_transform(list_sort(list_transform(h, lambda x: lpad(CAST(length(x) AS VARCHAR), 3, '0') || x)), lambda x: x[4:]) AS k), LATERAL (SELECT [k[-1]] AS hits)")
def segment_guard(load):
    """Parts as segments: their names begin a sentence, stand in a label, follow a lead, hold something, or are mere mentions."""
    k, name = F.col("p_partkey") % 5, F.lower("p_name")
    quote = F.when(k == 0, F.concat(F.initcap("p_name"), F.lit(" sales rose"))).when(k == 1, F.lit("Sales rose")).when(k == 2, F.concat(F.lit("We sold many "), name, F.lit(" items"))).when(k == 3, F.concat(F.lit("The ratio, as to one "), name, F.lit("'s owner, rose"))).otherwise(F.concat(F.lit("Not a "), name, F.lit(", but all")))
    rows = load("part").select(F.col("p_partkey").alias("id"), F.lit("I").alias("issuer_id"), F.when(k == 1, F.concat(F.lit("Sales "), name)).otherwise("Sales").alias("label"), quote.alias("quote"))
    segments = rows.sparkSession.createDataFrame([("I", x) for x in SEGMENTS], "issuer_id string, segment string")
    return v.segment_named(rows, segments)


@R.query("V08_issuer_voice", "SELECT doc_id, NOT (doc_id % 4 = 0 AND doc_id % 3 = 0) AS ok FROM documents")
def issuer_voice(load):
    kind, speaker = F.when(F.col("doc_id") % 4 == 0, "rating_report").otherwise("press_release"), F.when(F.col("doc_id") % 3 == 0, "issuer").otherwise("agency")
    return load("documents").select("doc_id", v.issuer_voice(kind, speaker).alias("ok"))


@R.query("G10_evidence_swap", "SELECT doc_id, k, CASE WHEN doc_id % 2 = 0 THEN 'document' ELSE 'sentence' END AS evidence_type, CASE WHEN doc_id % 2 = 0 THEN quote ELSE 'own' END AS quote FROM spans", spans=SPANS)
def evidence_swap(load):
    s = spans(load).select("doc_id", "k", "quote")
    have = s.select("doc_id", "k", F.when(F.col("doc_id") % 2 == 0, "claimed").otherwise("own").alias("quote"), F.when(F.col("doc_id") % 2 == 0, "llm_statement").otherwise("sentence").alias("evidence_type"))
    return enrich.swap_evidence(have, s.where("doc_id % 2 = 0"))


@R.query("R20_guards", "SELECT event_key, CASE WHEN agency = 'DBRS' THEN 'non-admissible agency' WHEN event_type <> 'downgrade' THEN 'not a downgrade' END AS guard FROM v_rating_events")
def guards(load):
    return load("v_rating_events").select("event_key", rules.downgrade_guard().alias("guard"))


@R.query("R28_provenance", "SELECT event_key, family, CASE WHEN family = 'rating' AND agency IN ('SP', 'MOODYS', 'FITCH') THEN agency ELSE '' END AS acting, '1.5' AS rules_version FROM decided", **ALL)
def provenance(load):
    from bondsight.functions.scales import ADMISSIBLE

    acting = F.when((F.col("family") == "rating") & F.col("agency").isin(*ADMISSIBLE), F.col("agency")).otherwise("")
    return decided(load).select("event_key", "family", acting.alias("acting"), F.lit("1.5").alias("rules_version"))


@R.query("L09_note_rows", "SELECT rule_id, lang, text, count(*) AS n FROM (SELECT unnest(triggered) AS rule_id FROM decided) JOIN (VALUES ('RAT-01', 'en', 'Check covenants with rating triggers'), ('RAT-01', 'fr', 'Vérifier les covenants liés à la note'), ('ERN-01', 'en', 'Check liquidity sources'), ('ERN-01', 'fr', 'Vérifier les sources de liquidité')) t(rule_id, lang, text) USING (rule_id) GROUP BY 1, 2, 3", **ALL)
def note_rows(load):
    notes = [("RAT-01", "en", "Check covenants with rating triggers"), ("RAT-01", "fr", "Vérifier les covenants liés à la note"), ("ERN-01", "en", "Check liquidity sources"), ("ERN-01", "fr", "Vérifier les sources de liquidité")]
    d = decided(load)
    table = d.sparkSession.createDataFrame(notes, "rule_id string, lang string, text string")
    return d.select(F.explode("triggered").alias("rule_id")).join(F.broadcast(table), "rule_id").groupBy("rule_id", "lang", "text").agg(F.count("*").alias("n"))
