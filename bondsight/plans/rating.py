"""Scales, rating state, decision matrix and composite."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondsight.functions import scales
from bondsight.operators import rules, state
from bondsight.plans.registry import Registry

R = Registry()

ELIGIBLE = "agency IN ('SP', 'MOODYS', 'FITCH') AND rating_type IN ('long_term_issuer', 'long_term_issuer_default') AND notch IS NOT NULL AND as_of IS NOT NULL"
ORIGIN = "CASE origin WHEN 'event' THEN 0 WHEN 'observation' THEN 1 ELSE 2 END"
CELIGIBLE = ELIGIBLE.replace("agency IN", "c.agency IN")
CORIGIN = ORIGIN.replace("CASE origin", "CASE c.origin")
CATEGORY = "CASE WHEN {0} <= 10 THEN 'IG' WHEN {0} <= 21 THEN 'HY' WHEN {0} IS NOT NULL THEN 'DEFAULT' END"
CAND = """SELECT issuer_id, agency, notch, as_of, rating_type, origin, outlook, source FROM v_rating_candidates
UNION ALL SELECT issuer_id, agency, new_notch, eff, 'long_term_issuer', 'event', new_outlook, CAST(event_key AS VARCHAR) FROM v_rating_events"""
BEFORE = f"""SELECT event_key, issuer_id, eff, agency, notch, as_of, origin, outlook, source, age_days FROM (
SELECT e.event_key, e.issuer_id, e.eff, c.agency, c.notch, c.as_of, c.origin, c.outlook, c.source, date_diff('day', c.as_of, e.eff) AS age_days,
       row_number() OVER (PARTITION BY e.event_key, c.agency ORDER BY c.as_of DESC, {CORIGIN}, c.source) AS rn
FROM {{events}} e JOIN cand c ON e.issuer_id = c.issuer_id
WHERE {CELIGIBLE} AND c.as_of <= e.eff AND date_diff('day', c.as_of, e.eff) <= 400 AND NOT (c.origin = 'event' AND c.source = CAST(e.event_key AS VARCHAR))) WHERE rn = 1"""
AFTER = """SELECT b.event_key, b.agency, b.notch, b.outlook, b.age_days FROM before b JOIN v_rating_events e ON b.event_key = e.event_key WHERE b.agency <> e.agency
UNION ALL SELECT event_key, agency, new_notch, new_outlook, 0 FROM v_rating_events WHERE agency IN ('SP', 'MOODYS', 'FITCH')"""
STATE = {"cand": CAND, "before": BEFORE.format(events="v_rating_events"), "after_": AFTER}


def before(load):
    events = load("v_rating_events")
    known = load("v_rating_candidates")
    found = state.candidates(known.where("origin = 'seed'"), known.where("origin != 'seed'"), events)
    return events, found


@R.query("S10_scale_load", f"SELECT s.agency, label, CAST(s.notch AS INT) AS notch, {CATEGORY.format('s.notch')} AS category, count(e.event_key) AS events FROM v_scale s LEFT JOIN v_rating_events e ON e.agency = s.agency AND e.new_notch = s.notch GROUP BY ALL")
def scale_load(load):
    """The scales, with how many rating events reach each label's notch."""
    seen = load("v_rating_events").groupBy(F.col("agency").alias("_a"), F.col("new_notch").alias("_n")).agg(F.count("*").alias("events"))
    s = load("v_scale").join(seen, (F.col("agency") == F.col("_a")) & (F.col("notch") == F.col("_n")), "left")
    return s.select("agency", "label", F.col("notch").cast("int").alias("notch"), scales.category(F.col("notch")).alias("category"), F.coalesce("events", F.lit(0)).alias("events"))


LABELS = """SELECT e.event_key, e.agency, CASE WHEN e.event_key % 3 = 0 THEN lower(s.label) WHEN e.event_key % 5 = 0 THEN ' ' || replace(s.label, '-', chr(8211)) || ' ' ELSE s.label END AS raw
FROM v_rating_events e JOIN (SELECT agency, notch, arg_min(label, seq) AS label FROM v_scale GROUP BY 1, 2) s ON e.agency = s.agency AND e.new_notch = s.notch"""


def labels(load):
    named = scales.notch_to_label(load("v_rating_events"), "agency", "new_notch", "label").where("label is not null")
    return named.select("event_key", "agency", F.when(F.col("event_key") % 3 == 0, F.lower("label")).when(F.col("event_key") % 5 == 0, F.concat(F.lit(" "), F.regexp_replace("label", "-", "–"), F.lit(" "))).otherwise(F.col("label")).alias("raw"))


@R.query("J05_label_to_notch", r"""
SELECT event_key, raw, CAST(coalesce(x.notch, f.notch) AS INT) AS notch FROM (SELECT *, replace(regexp_replace(raw, '\s+', '', 'g'), chr(8211), '-') AS r FROM labels) l
LEFT JOIN v_scale x ON l.agency = x.agency AND l.r = regexp_replace(x.label, '\s+', '', 'g')
LEFT JOIN (SELECT agency, lower(regexp_replace(label, '\s+', '', 'g')) AS k, arg_min(notch, seq) AS notch FROM v_scale GROUP BY 1, 2) f
  ON l.agency = f.agency AND lower(l.r) = f.k AND (l.r = upper(l.r) OR l.r = lower(l.r))""", labels=LABELS)
def label_to_notch(load):
    return scales.label_to_notch(labels(load), "agency", "raw", "notch").select("event_key", "raw", "notch")


@R.query("J06_notch_to_category", f"SELECT event_key, {CATEGORY.format('old_notch')} AS old_category, {CATEGORY.format('new_notch')} AS new_category FROM v_rating_events")
def notch_to_category(load):
    return load("v_rating_events").select("event_key", scales.category(F.col("old_notch")).alias("old_category"), scales.category(F.col("new_notch")).alias("new_category"))


@R.query("J07_notch_to_label", """SELECT event_key, e.agency, new_notch, s.label FROM v_rating_events e
LEFT JOIN (SELECT agency, notch, arg_min(label, seq) AS label FROM v_scale GROUP BY 1, 2) s ON e.agency = s.agency AND e.new_notch = s.notch""")
def notch_to_label(load):
    return scales.notch_to_label(load("v_rating_events"), "agency", "new_notch", "label").select("event_key", "agency", "new_notch", "label")


NAMES = """SELECT event_key, CASE event_key % 6 WHEN 0 THEN 'S&P  Global' WHEN 1 THEN 'moody''s' WHEN 2 THEN ' Fitch Ratings' WHEN 3 THEN 'Morningstar DBRS' WHEN 4 THEN 'Scope' ELSE agency END AS name FROM v_rating_events"""


@R.query("J08_agency_alias", r"SELECT event_key, name, a.agency AS resolved FROM names n LEFT JOIN v_aliases a ON lower(regexp_replace(trim(name), '\s+', ' ', 'g')) = a.alias", names=NAMES)
def agency_alias(load):
    k = F.col("event_key") % 6
    name = F.when(k == 0, "S&P  Global").when(k == 1, "moody's").when(k == 2, " Fitch Ratings").when(k == 3, "Morningstar DBRS").when(k == 4, "Scope").otherwise(F.col("agency"))
    return scales.resolve_agency(load("v_rating_events").select("event_key", name.alias("name")), "name", "resolved")


@R.query("T01_candidates", "SELECT * FROM cand", cand=CAND)
def candidates(load):
    return before(load)[1]


STATE_COLS = "event_key, agency, notch, as_of, origin, outlook, source, age_days"


@R.query("J09_rating_state", f"SELECT {STATE_COLS.replace('age_days', 'CAST(age_days AS INT) AS age_days')} FROM before", **STATE)
def rating_state(load):
    return state.state_before(*before(load)).select(*STATE_COLS.split(", "))


@R.query("T03_state_before_summary", "SELECT event_key, count(*) AS n_agencies, CAST(min(age_days) AS INT) AS youngest FROM before GROUP BY 1", **STATE)
def state_before_summary(load):
    return state.state_before(*before(load)).groupBy("event_key").agg(F.count("*").alias("n_agencies"), F.min("age_days").alias("youngest"))


@R.query("T02_decision_date", """SELECT e.event_key, coalesce(CASE WHEN e.event_key % 4 = 0 THEN NULL ELSE e.eff END, min(CAST(l_shipdate AS DATE))) AS decision_date
FROM v_rating_events e LEFT JOIN lineitem ON l_orderkey = e.event_key GROUP BY e.event_key, e.eff""")
def decision_date(load):
    own = load("v_rating_events").select("event_key", F.when(F.col("event_key") % 4 != 0, F.col("eff")).alias("eff"))
    published = load("lineitem").groupBy(F.col("l_orderkey").alias("event_key")).agg(F.min(F.col("l_shipdate").cast("date")).alias("published"))
    return own.join(published, "event_key", "left").select("event_key", F.coalesce("eff", "published").alias("decision_date"))


@R.query("T04_state_after", "SELECT event_key, agency, notch, outlook, CAST(age_days AS INT) AS age_days FROM after_", **STATE)
def state_after(load):
    events, found = before(load)
    return state.state_after(state.state_before(events, found), events)


@R.query("T05_weakest", "SELECT event_key, agency, notch FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY notch DESC, agency DESC) AS rn FROM after_) WHERE rn = 1", **STATE)
def weakest(load):
    events, found = before(load)
    return state.weakest(state.state_after(state.state_before(events, found), events))


@R.query("T06_previous_outlook", """SELECT e.event_key, b.outlook AS previous_outlook, coalesce(e.new_notch, b.notch) AS rating_after FROM v_rating_events e LEFT JOIN before b ON b.event_key = e.event_key AND b.agency = e.agency""", **STATE)
def previous_outlook(load):
    events, found = before(load)
    return rules.with_state(rules.shaped(events, "rating"), found).select("event_key", F.col("state_outlook").alias("previous_outlook"), F.coalesce("new_notch", "state_notch").alias("rating_after"))


@R.query("T08_age_days", "SELECT CAST(age_days / 100 AS INT) AS hundreds, count(*) AS n FROM (SELECT CAST(floor(age_days / 100) * 100 AS INT) AS age_days FROM before) GROUP BY 1", **STATE)
def age_days(load):
    return state.state_before(*before(load)).groupBy(F.floor(F.col("age_days") / 100).cast("int").alias("hundreds")).agg(F.count("*").alias("n"))


@R.query("J10_rejected_candidates", f"""SELECT reason, count(*) AS n FROM (
SELECT event_key, agency, coalesce(bad, CASE WHEN rn > 1 THEN 'superseded' END) AS reason FROM (
SELECT *, row_number() OVER (PARTITION BY event_key, agency ORDER BY bad IS NOT NULL, as_of DESC NULLS LAST, {ORIGIN}, source) AS rn FROM (
SELECT e.event_key, c.*, CASE WHEN c.agency NOT IN ('SP', 'MOODYS', 'FITCH') THEN 'non-admissible agency' WHEN rating_type NOT IN ('long_term_issuer', 'long_term_issuer_default') THEN 'rating type not eligible'
  WHEN notch IS NULL THEN 'unknown rating label' WHEN as_of IS NULL THEN 'incomplete date' WHEN as_of > eff THEN 'observed after D' WHEN date_diff('day', as_of, eff) > 400 THEN 'stale' END AS bad
FROM v_rating_events e JOIN v_rating_candidates c ON e.issuer_id = c.issuer_id))) WHERE reason IS NOT NULL GROUP BY reason""")
def rejected_candidates(load):
    return state.rejected(load("v_rating_events"), load("v_rating_candidates")).groupBy("reason").agg(F.count("*").alias("n"))


@R.query("M01_notch_delta", "SELECT event_key, new_notch - old_notch AS delta, new_notch = 10 AS at_boundary, new_notch <= 10 AS investment_grade FROM v_rating_events")
def notch_delta(load):
    return load("v_rating_events").select("event_key", (F.col("new_notch") - F.col("old_notch")).alias("delta"), (F.col("new_notch") == scales.LAST_IG).alias("at_boundary"), (scales.category(F.col("new_notch")) == "IG").alias("investment_grade"))


@R.query("M02_boundary_ig", "SELECT event_key, CASE WHEN old_notch <= 10 AND new_notch BETWEEN 11 AND 21 THEN 'falls' WHEN old_notch > 10 AND new_notch <= 10 THEN 'rises' END AS crossing, old_notch <= 10 AS was_ig, new_notch = 10 AS at_boundary FROM v_rating_events")
def boundary_ig(load):
    old, new = scales.category(F.col("old_notch")), scales.category(F.col("new_notch"))
    return load("v_rating_events").select("event_key", F.when((old == "IG") & (new == "HY"), "falls").when((old != "IG") & (new == "IG"), "rises").alias("crossing"), (old == "IG").alias("was_ig"), (F.col("new_notch") == scales.LAST_IG).alias("at_boundary"))


INPUTS = f"SELECT issuer_id, agency, notch, as_of FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, agency ORDER BY as_of DESC NULLS LAST, source) AS rn FROM v_rating_candidates WHERE {ELIGIBLE.replace(' AND as_of IS NOT NULL', '')}) WHERE rn = 1"


@R.query("M03_composite_inputs", "SELECT * FROM inputs", inputs=INPUTS)
def composite_inputs(load):
    return state.composite_inputs(load("v_rating_candidates"))


@R.query("M04_composite", f"""SELECT issuer_id, CAST(n AS INT) AS n_agencies, middle, {CATEGORY.format('middle')} AS category, CAST(greatest(1, least(22, floor(mean + 0.5))) AS INT) AS nearest_weaker,
CAST(greatest(1, least(22, ceil(mean))) AS INT) AS weaker, CAST(greatest(1, least(22, floor(mean))) AS INT) AS stronger
FROM (SELECT issuer_id, count(*) AS n, list_sort(list(notch))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS middle, avg(notch) AS mean FROM inputs GROUP BY 1)""", inputs=INPUTS)
def composite(load):
    return state.composite(state.composite_inputs(load("v_rating_candidates")))


@R.query("M05_composite_average", "SELECT issuer_id, CAST(floor(avg(notch) + 0.5) AS INT) AS nearest_weaker, CAST(ceil(avg(notch)) AS INT) AS weaker, CAST(floor(avg(notch)) AS INT) AS stronger FROM inputs GROUP BY 1", inputs=INPUTS)
def composite_average(load):
    return state.composite(state.composite_inputs(load("v_rating_candidates"))).select("issuer_id", "nearest_weaker", "weaker", "stronger")


# The matrix in SQL, over all families.
METRIC = "CASE lower(trim(metric)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.METRICS.items()) + " END"
EVENTS = f"""
SELECT e.event_key, e.issuer_id, 'rating' AS family, e.event_type, e.eff, e.agency, old_notch, new_notch, new_outlook, watch, NULL AS scope, NULL AS metric, CAST(NULL AS DOUBLE) AS pct, NULL AS status, NULL AS significant,
  NULL AS critical, NULL AS impaired, NULL AS seniority, CAST(NULL AS DOUBLE) AS euros, NULL AS item, b.outlook AS previous, coalesce(e.new_notch, b.notch) AS rating_after, w.weakest, w.other_ig
FROM v_rating_events e LEFT JOIN before b ON b.event_key = e.event_key AND b.agency = e.agency
LEFT JOIN (SELECT a.event_key, max(a.notch) AS weakest, bool_or(a.agency <> x.agency AND a.notch <= 10) AS other_ig FROM after_ a JOIN v_rating_events x ON a.event_key = x.event_key GROUP BY 1) w ON w.event_key = e.event_key
UNION ALL SELECT e.event_key, e.issuer_id, 'earnings', NULL, e.eff, NULL, NULL, NULL, NULL, NULL, {METRIC}, metric, CASE WHEN g_old <> 0 THEN (g_new - g_old) / abs(g_old) * 100 END, status, significant,
  f_liquidity OR f_covenant OR f_going_concern, f_impairment, NULL, NULL, item, NULL, NULL, w.weakest, NULL
FROM v_earnings_events e LEFT JOIN (SELECT event_key, max(notch) AS weakest FROM before_e GROUP BY 1) w ON w.event_key = e.event_key
UNION ALL SELECT e.event_key, e.issuer_id, 'issuance', event_type, e.eff, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, seniority, CASE WHEN currency = 'EUR' THEN CAST(amount AS DOUBLE) END, NULL, NULL, NULL, w.weakest, NULL
FROM v_issuance_events e LEFT JOIN (SELECT event_key, max(notch) AS weakest FROM before_i GROUP BY 1) w ON w.event_key = e.event_key"""
ACTS = "family = 'rating' AND agency IN ('SP', 'MOODYS', 'FITCH')"
FALLS, RISES = "(old_notch <= 10 AND new_notch BETWEEN 11 AND 21)", "(old_notch > 10 AND new_notch <= 10)"
ISSUES, JUNIOR = "family = 'issuance' AND event_type IN ('new_issue', 'tap')", "seniority IN ('subordinated', 'hybrid', 'AT1', 'T2')"
WHEN = {
    "RAT-01": f"{ACTS} AND event_type = 'downgrade' AND {FALLS}", "RAT-02": f"{ACTS} AND event_type = 'downgrade' AND {FALLS} AND other_ig", "RAT-03": f"{ACTS} AND event_type = 'downgrade' AND new_notch - old_notch >= 2",
    "RAT-04": f"{ACTS} AND watch = 'negative' AND rating_after = 10", "RAT-05": f"{ACTS} AND event_type = 'downgrade' AND new_notch - old_notch = 1 AND NOT {FALLS}",
    "RAT-06": f"{ACTS} AND new_outlook = 'negative' AND previous IN ('stable', 'positive')", "RAT-07": f"{ACTS} AND watch = 'negative' AND rating_after <> 10", "RAT-08": f"{ACTS} AND event_type = 'upgrade' AND {RISES}",
    "RAT-09": f"{ACTS} AND ((event_type = 'upgrade' AND NOT {RISES}) OR coalesce(new_outlook = 'positive', false) OR watch = 'positive')",
    "RAT-10": f"{ACTS} AND event_type = 'affirmation' AND watch = 'none' AND (new_outlook IS NULL OR previous IS NULL OR new_outlook = previous)",
    "ERN-01": "family = 'earnings' AND critical", "ERN-02": "family = 'earnings' AND (coalesce(scope IS NOT NULL AND pct <= -10, false) OR significant)",
    "ERN-03": "family = 'earnings' AND (coalesce(scope IS NOT NULL AND pct > -10 AND pct < 0, false) OR coalesce(status = 'cut' AND pct IS NULL AND (metric IS NULL OR scope IS NOT NULL), false) OR impaired)",
    "ERN-04": "family = 'earnings' AND status IN ('reaffirmed', 'in_line') AND NOT coalesce(scope IS NOT NULL AND pct < 0, false) AND NOT significant AND NOT critical AND NOT impaired",
    "ISS-01": f"{ISSUES} AND euros >= 1000000000", "ISS-02": f"{ISSUES} AND {JUNIOR}", "ISS-03": "family = 'issuance' AND event_type = 'non_call' AND seniority IN ('AT1', 'hybrid')",
    "ISS-04": f"{ISSUES} AND (event_type = 'tap' OR (euros < 1000000000 AND NOT coalesce({JUNIOR}, false)))", "EDG-01": "item = '2.04'",
}
HITS = "[x FOR x IN [" + ", ".join(f"CASE WHEN {w} THEN '{r}' END" for r, w in WHEN.items()) + "] IF x IS NOT NULL]"
RANKS = "greatest(" + ", ".join(f"CASE WHEN {WHEN[r]} THEN {rules.RANK[p]} ELSE 0 END" for r, p, *_ in rules.RULES) + ")"
BAD = " OR ".join(f"coalesce({WHEN[r]}, false)" for r, _, d, _ in rules.RULES if d == "negative")
DECIDED = f"""SELECT *, CASE WHEN base_rank > 0 THEN least(3, greatest(base_rank + CASE WHEN mod01 THEN 1 ELSE 0 END + CASE WHEN mod03 THEN 1 ELSE 0 END, CASE WHEN mod02 THEN 3 ELSE 0 END)) END AS final_rank FROM (
SELECT *, negative AND coalesce(weakest = 10, false) AS mod01, negative AND base_rank = 2 AND recent >= 2 AS mod02, negative AND coalesce(leverage > 4.5, false) AS mod03 FROM (
SELECT *, sum(CASE WHEN negative AND base_rank = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY issuer_id ORDER BY eff RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS recent FROM (
SELECT *, {HITS} AS triggered, {RANKS} AS base_rank, ({BAD}) AS negative FROM (SELECT e.*, x.leverage FROM all_events e ASOF LEFT JOIN leverage x ON e.issuer_id = x.issuer_id AND e.eff >= x.as_of))))"""
LEVERAGE = """SELECT 'ISS' || CAST(CAST(floor(o_custkey / 10) AS BIGINT) AS VARCHAR) AS issuer_id, CAST(o_orderdate AS DATE) AS as_of, max(CAST((o_orderkey % 80) AS DOUBLE) / 10) AS leverage FROM orders WHERE o_orderkey % 11 = 0 GROUP BY 1, 2"""
ALL = {**STATE, "before_e": BEFORE.format(events="v_earnings_events").replace("AND NOT (c.origin = 'event' AND c.source = CAST(e.event_key AS VARCHAR))", ""), "before_i": BEFORE.format(events="v_issuance_events").replace("AND NOT (c.origin = 'event' AND c.source = CAST(e.event_key AS VARCHAR))", ""), "all_events": EVENTS, "leverage": LEVERAGE, "decided": DECIDED}
NAME = "CASE {} WHEN 3 THEN 'P1' WHEN 2 THEN 'P2' WHEN 1 THEN 'P3' END"


def decided(load):
    events, found = before(load)
    names = {"f_liquidity": "liquidity", "f_covenant": "covenant", "f_going_concern": "going_concern", "f_impairment": "impairment"}
    earnings = load("v_earnings_events").withColumn("flags", F.array_compact(F.array(*(F.when(F.col(k), F.lit(v)) for k, v in names.items()))))
    return rules.decide_all(events, earnings, load("v_issuance_events"), found, leverage(load))


def leverage(load):
    """A figure of an issuer's leverage now and then."""
    orders = load("orders").where("o_orderkey % 11 = 0")
    return orders.groupBy(F.concat(F.lit("ISS"), F.floor(F.col("o_custkey") / 10)).alias("issuer_id"), F.col("o_orderdate").cast("date").alias("as_of")).agg(F.max((F.col("o_orderkey") % 80).cast("double") / 10).alias("leverage"))


@R.query("T07_rating_after_action", "SELECT event_key, rating_after FROM all_events WHERE family = 'rating'", **ALL)
def rating_after_action(load):
    events, found = before(load)
    return rules.with_state(rules.shaped(events, "rating"), found).select("event_key", F.coalesce("new_notch", "state_notch").alias("rating_after"))


@R.query("R00_rule_matrix", "SELECT rule_id, family, CAST(count(*) AS BIGINT) AS evaluated, CAST(sum(CASE WHEN triggered THEN 1 ELSE 0 END) AS BIGINT) AS triggered FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, family, coalesce({w}, false) AS triggered FROM all_events" for r, w in WHEN.items()) + ") GROUP BY 1, 2", **ALL)
def rule_matrix(load):
    return rules.matrix(decided(load)).groupBy("rule_id", "family").agg(F.count("*").alias("evaluated"), F.count_if("triggered").alias("triggered"))


def _one_rule(rule: str) -> None:
    @R.query(f"R{[r for r, *_ in rules.RULES].index(rule) + 1:02d}_{rule.replace('-', '').lower()}", f"SELECT event_key, issuer_id, eff FROM all_events WHERE {WHEN[rule]}", **ALL)
    def one(load):
        return decided(load).where(rules.conditions()[rule]).select("event_key", "issuer_id", "eff")


for _rule, *_ in rules.RULES:
    _one_rule(_rule)


@R.query("R21_mod01", "SELECT event_key, family, base_rank FROM decided WHERE mod01", **ALL)
def mod01(load):
    return decided(load).where("mod01").select("event_key", "family", "base_rank")


@R.query("R22_mod02", "SELECT event_key, family, CAST(recent AS BIGINT) AS recent FROM decided WHERE mod02", **ALL)
def mod02(load):
    return decided(load).where("mod02").select("event_key", "family", "recent")


@R.query("R23_mod03", "SELECT event_key, family, leverage FROM decided WHERE mod03", **ALL)
def mod03(load):
    return decided(load).where("mod03").select("event_key", "family", "leverage")


@R.query("R24_decisions", f"SELECT event_key, family, {NAME.format('base_rank')} AS base_priority, {NAME.format('final_rank')} AS priority, negative, CASE WHEN base_rank > 0 THEN 'DECIDED' ELSE 'NO_APPLICABLE_RULE' END AS decision_status FROM decided", **ALL)
def decisions(load):
    return decided(load).select("event_key", "family", "base_priority", "priority", "negative", "decision_status")


@R.query("R25_triggered_list", "SELECT event_key, family, array_to_string(list_concat(triggered, [x FOR x IN [CASE WHEN mod01 AND base_rank > 0 THEN 'MOD-01' END, CASE WHEN mod02 THEN 'MOD-02' END, CASE WHEN mod03 AND base_rank > 0 THEN 'MOD-03' END] IF x IS NOT NULL]), ',') AS applied FROM decided", **ALL)
def triggered_list(load):
    return decided(load).select("event_key", "family", F.array_join("applied", ",").alias("applied"))


@R.query("R26_guidance_inputs", f"SELECT event_key, {METRIC} AS scope, round(CASE WHEN g_old <> 0 THEN (g_new - g_old) / abs(g_old) * 100 END, 6) AS pct FROM v_earnings_events")
def guidance_inputs(load):
    return rules.guidance_inputs(load("v_earnings_events")).select("event_key", "scope", F.round("pct", 6).alias("pct"))


@R.query("R27_priority_counts", f"SELECT family, coalesce({NAME.format('final_rank')}, 'NONE') AS priority, count(*) AS n FROM decided GROUP BY 1, 2", **ALL)
def priority_counts(load):
    return decided(load).groupBy("family", F.coalesce("priority", F.lit("NONE")).alias("priority")).agg(F.count("*").alias("n"))


@R.query("R29_explain_rows", f"""SELECT event_key, family, section, text FROM (SELECT event_key, family, 'triggered' AS section, unnest(triggered) AS text FROM decided
UNION ALL SELECT event_key, family, 'modifier', 'MOD-01' FROM decided WHERE mod01 AND base_rank > 0 UNION ALL SELECT event_key, family, 'modifier', 'MOD-02' FROM decided WHERE mod02 UNION ALL SELECT event_key, family, 'modifier', 'MOD-03' FROM decided WHERE mod03 AND base_rank > 0
UNION ALL SELECT event_key, family, 'decision', coalesce({NAME.format('final_rank')}, 'NO_APPLICABLE_RULE') FROM decided
UNION ALL SELECT event_key, 'rating', 'state', agency || ':' || CAST(notch AS VARCHAR) FROM before)""", **ALL)
def explain_rows(load):
    events, found = before(load)
    return rules.explain(decided(load), state.state_before(events, found))


@R.query("J20_rules_config", "SELECT rule_id, priority, direction, n FROM (SELECT unnest(triggered) AS rule_id, count(*) AS n FROM decided GROUP BY 1) JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{p}', '{d}')" for r, p, d, _ in rules.RULES) + ") c(rule_id, priority, direction)) USING (rule_id)", **ALL)
def rules_config(load):
    spark = load("v_scale").sparkSession
    config = spark.createDataFrame([(r, p, d) for r, p, d, _ in rules.RULES], "rule_id string, priority string, direction string")
    counts = decided(load).select(F.explode("triggered").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(config), "rule_id").select("rule_id", "priority", "direction", "n")


@R.query("J11_other_agencies_split", "SELECT event_key FROM all_events WHERE family = 'rating' AND other_ig", **ALL)
def other_agencies_split(load):
    events, found = before(load)
    return rules.with_state(rules.shaped(events, "rating"), found).where("other_ig").select("event_key")


@R.query("J12_prior_events", "SELECT event_key, family, CAST(recent AS BIGINT) AS recent FROM decided WHERE negative AND base_rank = 2", **ALL)
def prior_events(load):
    return decided(load).where("negative and base_rank = 2").select("event_key", "family", "recent")
