"""Readings of whole documents: lines, sentences, dates, numbers, ratings, guidance, flags, bonds; and checks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondsight.functions import textfns as tf
from bondsight.functions import wording as w
from bondsight.operators import corpus as c
from bondsight.operators import profiles as p
from bondsight.operators import validate as v
from bondsight.plans import twins as t
from bondsight.plans.registry import Registry
from bondsight.sources.views import quoted as q

R = Registry()


def whole(load, *keep):
    return c.sentences(load("v_documents"), *keep)


@R.query("X01_logical_lines", "SELECT doc_id, CAST(lead0 AS BIGINT) AS start, line FROM logical", **t.LINES)
def logical_lines(load):
    return c.logical_lines(load("v_documents"))


@R.query("X02_sentences", 'SELECT doc_id, start, "end", text FROM sents', **t.SENTS)
def sentences(load):
    return whole(load)


@R.query("X03_dates", "SELECT doc_id, day FROM dated", **t.DATES)
def dates(load):
    return c.dates(load("v_documents")).select("doc_id", "day")


@R.query("X04_latest_reference", "SELECT doc_id, latest FROM latest", **t.LATEST)
def latest_reference(load):
    return c.latest_reference(load("v_documents"))


@R.query("X05_historical", "SELECT doc_id, coalesce(date_diff('day', latest, published) > 365, false) AS historical FROM v_documents LEFT JOIN latest USING (doc_id)", **t.LATEST)
def historical(load):
    docs = load("v_documents")
    return docs.join(c.latest_reference(docs), "doc_id", "left").select("doc_id", F.coalesce(F.datediff("published", "latest") > tf.HISTORY_DAYS, F.lit(False)).alias("historical"))


@R.query("X06_numbers", f"SELECT doc_id, CAST(len(x) AS INT) AS n, list_min(x) AS least, list_max(x) AS most, CAST(len(list_distinct(x)) AS INT) AS kinds FROM (SELECT doc_id, {t.numbers('text')} AS x FROM v_documents)")
def numbers(load):
    found = load("v_documents").select("doc_id", tf.numbers(F.col("text")).alias("x"))
    return found.select("doc_id", F.size("x").alias("n"), F.array_min("x").alias("least"), F.array_max("x").alias("most"), F.size(F.array_distinct("x")).alias("kinds"))


@R.query("X07_amounts", f"SELECT doc_id, {t.amount()} AS amount FROM v_documents")
def amounts(load):
    return load("v_documents").select("doc_id", tf.amount(F.col("text")).alias("amount"))


TERMS = "doc_id, start, event_type, amount, coupon, tenor, seniority, due, green"


@R.query("X08_bond_terms", f"SELECT {TERMS} FROM bonds", **t.SENTS, bonds=t.BONDS)
def bond_terms(load):
    return c.issuance(whole(load)).select(*TERMS.split(", "))


@R.query("X09_named_entities", "SELECT doc_id, name FROM named", **t.SENTS, named=t.NAMED)
def named_entities(load):
    return c.named_entities(whole(load))


@R.query("X10_entity_target", "SELECT doc_id, CASE WHEN NOT bool_or(name LIKE 'Acme%') THEN 'unresolved_entity' END AS skip FROM named GROUP BY 1", **t.SENTS, named=t.NAMED)
def entity_target(load):
    names = c.named_entities(whole(load)).groupBy("doc_id").agg(F.bool_or(F.col("name").startswith("Acme")).alias("own"))
    return names.select("doc_id", F.when(~F.col("own"), "unresolved_entity").alias("skip"))


@R.query("X11_agency_mentions", "SELECT doc_id, start, agency, count(*) AS n FROM mentions GROUP BY 1, 2, 3", **t.SENTS, mentions=t.MENTIONS)
def agency_mentions(load):
    return c.agency_mentions(whole(load)).groupBy("doc_id", "start", "agency").agg(F.count("*").alias("n"))


_IN = lambda text: f"SELECT doc_id, agency FROM (SELECT doc_id, unnest(regexp_extract_all({text}, {q(f'({c.AGENCY})')}, 1)) AS named FROM v_documents) JOIN v_aliases ON lower(trim(named)) = alias"
_ONLY = "SELECT doc_id, CASE WHEN min(agency) = max(agency) THEN min(agency) END AS a FROM {} GROUP BY 1"


@R.query("X12_document_agency", f"SELECT w.doc_id, coalesce(w.a, h.a) AS agency FROM ({_ONLY.format('whole')}) w LEFT JOIN ({_ONLY.format('head')}) h USING (doc_id)", whole=_IN("text"), head=_IN("substr(text, 1, 600)"))
def document_agency(load):
    return c.document_agency(load("v_documents"))


ZONES = {"zones": "SELECT *, coalesce(max(CAST(regexp_matches(line, '^Rating history') AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) = 1 AS zone FROM raw"}


@R.query("X13_reference_zones", "SELECT doc_id, CAST(n - 1 AS INT) AS n, line FROM zones WHERE zone", **t.LINES, **ZONES)
def reference_zones(load):
    return c.reference_zone(load("v_documents"), "^Rating history").where("zone").select("doc_id", "n", "line")


@R.query("X14_historical_filter", "SELECT doc_id, day, CASE WHEN date_diff('day', day, published) > 90 THEN 'historical' WHEN date_diff('day', day, published) < -3 THEN 'future' END AS skip FROM v_documents JOIN dated USING (doc_id)", **t.DATES)
def historical_filter(load):
    docs = load("v_documents")
    age = F.datediff("published", "day")
    return docs.join(c.dates(docs).select("doc_id", "day"), "doc_id").select("doc_id", "day", F.when(age > 90, "historical").when(age < -3, "future").alias("skip"))


@R.query("E01_rating_transitions", "SELECT doc_id, agency, old, new, delta, skip FROM judged", **t.SENTS, moved=t.MOVED, judged=t.JUDGED)
def rating_transitions(load):
    return c.transitions(whole(load)).select("doc_id", "agency", "old", "new", "delta", "skip")


@R.query("E02_watch_outlook_affirm", f"SELECT doc_id, agency, event_type, rating, value, was FROM ({t.ACTED})", **t.SENTS)
def actions(load):
    return c.actions(whole(load)).drop("start")


@R.query("E04_results_release", f"""SELECT doc_id, CASE WHEN len(s) = 1 THEN s[1] END AS status, len(s) > 1 AS conflict, title FROM (SELECT doc_id, list_distinct(list(status)) AS s FROM statuses GROUP BY 1)
JOIN (SELECT doc_id, {t.says(w.RESULTS_TITLE, 'string_split(text, chr(10))[1]')} OR {t.says(w.HALF_TITLE, 'string_split(text, chr(10))[1]')} AS title FROM v_documents) USING (doc_id)""", **t.SENTS, statuses=t.STATUSES)
def results_release(load):
    titles = load("v_documents").select("doc_id", c.results_title(F.col("text")).alias("title"))
    return c.guidance_status(c.guidance_scan(whole(load))).join(titles, "doc_id")


@R.query("E05_guidance_status_scan", "SELECT doc_id, start, status FROM statuses", **t.SENTS, statuses=t.STATUSES)
def guidance_status_scan(load):
    return c.guidance_scan(whole(load))


@R.query("E06_flag_scan", "SELECT doc_id, start, flag, aside, aside IS NULL AND start = min(CASE WHEN aside IS NULL THEN start END) OVER (PARTITION BY doc_id, flag) AS first FROM flagged", **t.SENTS, **t.FLAGS)
def flag_scan(load):
    return c.flag_scan(whole(load, "published"))


@R.query("E07_going_concern_reading", f"SELECT doc_id, start, reading FROM (SELECT doc_id, start, {t.READING} AS reading FROM sents) WHERE reading IS NOT NULL", **t.SENTS)
def going_concern_reading(load):
    return whole(load).select("doc_id", "start", c.going_concern(F.col("text")).alias("reading")).where("reading is not null")


@R.query("E08_periodic_report", "SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN '8-K' WHEN 3 THEN '10-K' ELSE '10-Q' END AS form, CASE WHEN doc_id % 5 < 4 THEN f IS NOT NULL END AS going_concern FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS f FROM flagged WHERE flag = 'going_concern' AND aside IS NULL) USING (doc_id)", **t.SENTS, **t.FLAGS)
def periodic_report(load):
    k = F.col("doc_id") % 5
    forms = load("documents").select("doc_id", F.when(k == 4, "8-K").when(k == 3, "10-K").otherwise("10-Q").alias("form"))
    flag = c.flag_scan(whole(load, "published")).where("flag = 'going_concern' and aside is null").select(F.col("doc_id").alias("_d")).distinct()
    return forms.join(flag, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "form", F.when(F.col("form") != "8-K", F.col("_d").isNotNull()).alias("going_concern"))


@R.query("E09_issuance", "SELECT doc_id, start, event_type, amount, skip FROM bonds", **t.SENTS, bonds=t.BONDS)
def issuance(load):
    return c.issuance(whole(load)).select("doc_id", "start", "event_type", "amount", "skip")


@R.query("E10_recap_suppression", "SELECT b.doc_id, CASE WHEN s.doc_id IS NOT NULL THEN 'recap' END AS skip FROM bonds b LEFT JOIN (SELECT DISTINCT doc_id FROM statuses) s USING (doc_id) WHERE b.skip IS NULL", **t.SENTS, bonds=t.BONDS, statuses=t.STATUSES)
def recap_suppression(load):
    sents = whole(load)
    return c.suppress(c.issuance(sents).where("skip is null").select("doc_id"), c.guidance_scan(sents).select("doc_id").distinct())


TABLE = "doc_id, n, agency, label, notch, outlook, watch, as_of, skip"


def tables(load, profile, names=None):
    return p.rating_rows(load("v_documents"), profile, names).select(*TABLE.split(", "))


@R.query("E11_ratings_table_as_of", f"SELECT {TABLE} FROM table_rows", **t.AS_OF_WALK, **t.ROWS_READ)
def ratings_table_as_of(load):
    return tables(load, "as_of")


@R.query("E12_ratings_table_current", f"SELECT {TABLE} FROM table_rows", **t.CURRENT_WALK, **t.ROWS_READ)
def ratings_table_current(load):
    return tables(load, "current", ["Acme Holdings plc", "Acme"])


@R.query("E13_ratings_table_dated", f"SELECT {TABLE} FROM table_rows", **t.DATED_WALK, **t.ROWS_READ)
def ratings_table_dated(load):
    return tables(load, "dated")


@R.query("E14_observation_build", "SELECT 'obs_' || substr(sha256(doc_id || chr(31) || agency || chr(31) || CAST(as_of AS VARCHAR) || chr(31) || label), 1, 20) AS observation_id, doc_id, agency, as_of, label, 'stated' AS basis, published AS observed_at FROM table_rows JOIN v_documents USING (doc_id) WHERE skip IS NULL", **t.DATED_WALK, **t.ROWS_READ)
def observation_build(load):
    rows = tables(load, "dated").where("skip is null").join(load("v_documents").select("doc_id", F.col("published").alias("observed_at")), "doc_id")
    key = F.concat_ws("\x1f", F.col("doc_id").cast("string"), "agency", F.col("as_of").cast("string"), "label")
    return rows.select(F.concat(F.lit("obs_"), F.substring(F.sha2(key, 256), 1, 20)).alias("observation_id"), "doc_id", "agency", "as_of", "label", F.lit("stated").alias("basis"), "observed_at")


@R.query("E16_extractor_routing", "SELECT branch, count(*) AS n, count(skip) AS skipped FROM branches GROUP BY 1", **t.ALL)
def extractor_routing(load):
    return c.extract_all(whole(load, "published")).groupBy("branch").agg(F.count("*").alias("n"), F.count("skip").alias("skipped"))


@R.query("E17_skip_ledger", "SELECT skip AS reason, branch, count(*) AS n FROM branches WHERE skip IS NOT NULL GROUP BY 1, 2", **t.ALL)
def skip_ledger(load):
    return c.extract_all(whole(load, "published")).where("skip is not null").groupBy(F.col("skip").alias("reason"), "branch").agg(F.count("*").alias("n"))


#: Where a document came from: a path with an ISO date, with spelled ones, with none; a date after the mark doesn't count.
URL = "'https://example.org/' || CASE doc_id % 4 WHEN 0 THEN 'news/2023-05-' || CAST(10 + doc_id % 25 AS VARCHAR(20)) || '/x' WHEN 1 THEN '3-may-2022/5_June_2023/a.html' WHEN 2 THEN 'a?d=2021-01-01' ELSE '2023/07/01' END"
DAYS = {
    "dated_by": f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN published END AS published, substr(text, 1, 600) AS text, string_split({URL.replace('(20)', '')}, '?')[1] AS path FROM v_documents",
    **t.dates_of("dated_by", "doc_id", "h_"), "words": "SELECT doc_id, regexp_replace(path, '[-_/]', ' ', 'g') AS text FROM dated_by", **t.dates_of("words", "doc_id", "u_"),
}


@R.query("N09_document_date", r"""SELECT doc_id, coalesce(published, first, try_cast(nullif(regexp_extract(path, '20\d\d-\d\d-\d\d'), '') AS DATE), last) AS day FROM dated_by
LEFT JOIN (SELECT doc_id, arg_min(day, i) AS first FROM h_dated GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, arg_max(day, i) AS last FROM u_dated GROUP BY 1) USING (doc_id)""", **DAYS)
def document_date(load):
    """Every fifth document has a day of publication; the others' head or URL tells."""
    docs = load("v_documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, F.col("published")).alias("published"), F.expr(URL.replace("VARCHAR(20)", "STRING")).alias("url"))
    return c.document_date(docs)


@R.query("V03_numbers_match", f"SELECT doc_id, bound, list_contains({t.numbers('text')}, bound) AS ok FROM v_documents, (VALUES (95.0::DOUBLE), (250.0), (-1234.5)) b(bound)")
def numbers_match(load):
    docs = load("v_documents").select("doc_id", "text", F.explode(F.array(F.lit(95.0), F.lit(250.0), F.lit(-1234.5))).alias("bound"))
    return docs.select("doc_id", "bound", c.numbers_match(F.col("text"), [F.col("bound"), F.lit(None).cast("double")]).alias("ok"))


@R.query("V05_entity_match", "SELECT doc_id, others IS NULL AS ok FROM documents LEFT JOIN (SELECT doc_id, count(*) AS others FROM named WHERE name NOT LIKE 'Acme%' GROUP BY 1) USING (doc_id)", **t.SENTS, named=t.NAMED)
def entity_match(load):
    others = c.named_entities(whole(load)).where("name not like 'Acme%'").groupBy("doc_id").agg(F.count("*").alias("others"))
    return load("documents").select("doc_id").join(others, "doc_id", "left").select("doc_id", F.col("others").isNull().alias("ok"))


@R.query("V06_temporal", "SELECT doc_id, NOT coalesce(late > published + 3, false) AS temporal FROM v_documents LEFT JOIN (SELECT doc_id, max(day) AS late FROM dated GROUP BY 1) USING (doc_id)", **t.DATES)
def temporal(load):
    docs = load("v_documents")
    late = c.dates(docs).groupBy("doc_id").agg(F.max("day").alias("late"))
    return docs.join(late, "doc_id", "left").select("doc_id", (~F.coalesce(F.col("late") > F.date_add("published", 3), F.lit(False))).alias("temporal"))


@R.query("V09_liquidity_polarity", f"SELECT doc_id, start, {t.LIQUID} AS stands FROM sents WHERE {t.says(w.LIQUIDITY_TOPIC)}", **t.SENTS)
def liquidity_polarity(load):
    return whole(load).where(F.col("text").rlike(w.LIQUIDITY_TOPIC)).select("doc_id", "start", v.liquidity_stands(F.col("text")).alias("stands"))


@R.query("V10_covenant_status", f"SELECT doc_id, start, {t.COVENANT} AS status FROM sents WHERE {t.IS_COVENANT}", **t.SENTS)
def covenant_status(load):
    return whole(load).select("doc_id", "start", v.covenant_status(F.col("text")).alias("status")).where("status is not null")


@R.query("V12_going_concern_status", f"SELECT doc_id, start, claim, reading, claim = CASE reading WHEN 'stated' THEN 'doubt' WHEN 'denied' THEN 'negated' ELSE reading END AS ok FROM (SELECT doc_id, start, {t.READING} AS reading FROM sents), (VALUES ('doubt'), ('alleviated'), ('negated')) x(claim) WHERE reading IS NOT NULL", **t.SENTS)
def going_concern_status(load):
    read = whole(load).select("doc_id", "start", c.going_concern(F.col("text")).alias("reading")).where("reading is not null")
    means = F.when(F.col("reading") == "stated", "doubt").when(F.col("reading") == "denied", "negated").otherwise(F.col("reading"))
    return read.withColumn("claim", F.explode(F.array(F.lit("doubt"), F.lit("alleviated"), F.lit("negated")))).withColumn("ok", F.col("claim") == means)


@R.query("V13_historical_reference", f"SELECT doc_id, coalesce(date_diff('day', latest, published) > 365, false) AS rejected FROM (SELECT DISTINCT doc_id FROM sents WHERE {t.IS_COVENANT} AND {t.COVENANT} = 'breached' OR {t.READING} = 'stated') JOIN v_documents USING (doc_id) LEFT JOIN latest USING (doc_id)", **t.SENTS, **t.LATEST)
def historical_reference(load):
    docs, text = load("v_documents"), F.col("text")
    bad = whole(load).where((v.covenant_status(text) == "breached") | (c.going_concern(text) == "stated")).select("doc_id").distinct()
    late = c.latest_reference(docs)
    return docs.join(bad, "doc_id").join(late, "doc_id", "left").select("doc_id", F.coalesce(F.datediff("published", "latest") > 365, F.lit(False)).alias("rejected"))


@R.query("V11_covenant_resolution", f"SELECT doc_id, resolution, CASE resolution {' '.join(f'WHEN {q(k)} THEN {t.says(p)}' for k, p in w.RESOLUTIONS.items())} END AS ok, CASE WHEN contains(lower(text), 'leverage') THEN 'covenant_label' ELSE '' END AS salvaged FROM v_documents, (VALUES ('waived'), ('amended'), ('cured')) r(resolution)")
def covenant_resolution(load):
    docs = load("v_documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, w.RESOLUTIONS))).alias("resolution"))
    kept = v.salvage({"covenant_label": F.lit("leverage"), "agreement": F.lit("no such agreement")}, F.col("text"))
    return docs.select("doc_id", "resolution", v.resolution_ok(F.col("resolution"), F.col("text")).alias("ok"), F.array_join(F.map_keys(kept), ",").alias("salvaged"))


ALIASES = [("ISS1", "Acme Holdings plc"), ("ISS2", "Delta Energy N.V"), ("ISS2", "Delta Energy"), ("ISS3", "Nobody Inc"), ("ISS4", "the group")]
FOUND = {"found": "SELECT doc_id, CASE WHEN count(DISTINCT issuer_id) = 1 THEN min(issuer_id) END AS alias_issuer, count(DISTINCT issuer_id) > 1 AS ambiguous FROM (" + " UNION ALL ".join(
    rf"SELECT doc_id, {q(i)} AS issuer_id FROM v_documents WHERE regexp_matches(lower(substr(text, 1, 3000)), {q(rf'(?:^|[^a-z0-9]){a.lower().replace(".", chr(92) + ".")}(?:[^a-z0-9]|$)')})" for i, a in ALIASES) + ") GROUP BY 1"}


def aliases(load):
    return load("v_scale").sparkSession.createDataFrame(ALIASES, "issuer_id string, alias string")


@R.query("J03_resolve_alias", "SELECT doc_id, alias_issuer, ambiguous FROM found", **FOUND)
def resolve_alias(load):
    return c.resolve_alias(load("v_documents"), aliases(load)).select("doc_id", "alias_issuer", "ambiguous")
