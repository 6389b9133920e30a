"""Answers of all statement kinds: parsed, placed in their documents, and judged by the checks of their kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondsight.functions import wording as w
from bondsight.operators import kinds
from bondsight.operators import validate as v
from bondsight.plans import twins as t
from bondsight.plans.registry import Registry
from bondsight.sources.views import quoted as q

R = Registry()

_TYPES = {"string": ("VARCHAR",), "bigint": ("BIGINT", "UBIGINT", "DOUBLE"), "double": ("BIGINT", "UBIGINT", "DOUBLE")}


def _wrong(kind: kinds.Kind) -> str:
    """The first thing wrong with statement s, by DuckDB's JSON functions."""
    cases = ["json_type(s) <> 'OBJECT' THEN 'no_object'"]
    for name, f in kind.fields.items():
        at = f"json_type(s, '$.{name}')"
        cases += [f"coalesce({at}, 'NULL') = 'NULL' THEN 'missing:{name}'"] if f.needed else []
        cases.append(f"coalesce({at}, 'NULL') <> 'NULL' AND {at} NOT IN ({', '.join(map(q, _TYPES[f.kind]))}) THEN 'type:{name}'")
        cases += [f"coalesce({at}, 'NULL') <> 'NULL' AND s->>'$.{name}' NOT IN ({', '.join(map(q, f.values))}) THEN 'value:{name}'"] if f.values else []
    known = f"[{', '.join(map(q, kind.fields))}]"
    cases.append(f"len(list_filter(json_keys(s), lambda x: NOT list_contains({known}, x))) > 0 THEN 'unknown:' || list_min(list_filter(json_keys(s), lambda x: NOT list_contains({known}, x)))")
    cases.append("s->>'$.evidence_quote' = '' THEN 'empty_quote'")
    cases.append("CAST(s->>'$.start_offset' AS BIGINT) < 0 OR CAST(s->>'$.end_offset' AS BIGINT) <= CAST(s->>'$.start_offset' AS BIGINT) THEN 'offsets'")
    return "CASE " + " ".join(f"WHEN {x}" for x in cases) + " END"


PARSED = {
    "answer_rows": "SELECT doc_id, kind, CASE WHEN json_valid(answer) THEN CAST(answer AS JSON) END AS j FROM v_answers",
    "stated": f"SELECT doc_id, kind, i - 1 AS idx, s, CASE kind {' '.join(f'WHEN {q(n)} THEN {_wrong(k)}' for n, k in kinds.KINDS.items())} END AS wrong FROM (SELECT doc_id, kind, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, kind, json_extract(j, '$.statements[*]') AS l FROM answer_rows WHERE json_type(j, '$.statements') = 'ARRAY'))",
    "runs": "SELECT doc_id, kind, CASE WHEN j IS NULL THEN 'no_json' WHEN coalesce(json_type(j, '$.statements'), 'ARRAY') <> 'ARRAY' THEN 'type:statements' ELSE e END AS error, n FROM answer_rows LEFT JOIN (SELECT doc_id, kind, arg_min(wrong, idx) AS e, count(*) AS n FROM stated GROUP BY 1, 2) USING (doc_id, kind)",
}
#: What a reading function of a sentence sees as its text is the quote.
_QUOTES = """SELECT doc_id, kind, idx, s, s->>'$.evidence_quote' AS text, s->>'$.status' AS status, CAST(s->>'$.start_offset' AS BIGINT) AS s0, CAST(s->>'$.end_offset' AS BIGINT) AS s1, d.text AS whole, published,
  CASE doc_id % 7 WHEN 0 THEN 'rating_report' ELSE 'press_release' END AS document_kind FROM stated JOIN (SELECT doc_id, kind FROM runs WHERE error IS NULL) USING (doc_id, kind) JOIN v_documents d USING (doc_id)"""
_NUMBERS = " AND ".join(f"(s->>'$.{b}' IS NULL OR list_contains({t.numbers('text')}, CAST(s->>'$.{b}' AS DOUBLE)))" for b in kinds.BOUNDS)
_SIGNS = lambda signs: "(" + (" OR ".join(f"contains(lower(text), {q(x)})" for x in signs) or "true") + ")"
_UNIT = "(coalesce(" + ", ".join(f"s->>'$.{b}'" for b in kinds.BOUNDS) + ") IS NULL OR CASE s->>'$.unit' " + " ".join(f"WHEN {q(u)} THEN {_SIGNS(a)} AND {_SIGNS(b)}" for u, (a, b) in kinds.UNIT_SIGNS.items()) + " END)"
_METRIC = "(contains(lower(text), lower(trim(s->>'$.metric_label'))) AND CASE s->>'$.metric' " + " ".join(f"WHEN {q(m)} THEN regexp_matches(lower(s->>'$.metric_label'), {q(rf'\b(?:{words})\b')})" for m, words in v.METRIC_WORDS.items()) + " ELSE true END)"
_PERIOD = "(len(regexp_extract_all(coalesce(s->>'$.period', ''), '\\b(20\\d\\d)\\b')) = 0 OR len(list_filter(regexp_extract_all(coalesce(s->>'$.period', ''), '\\b(20\\d\\d)\\b'), lambda y: CAST(y AS INT) BETWEEN year(published) - 1 AND year(published) + 3)) > 0)".replace("\\\\", "\\")
_PAST = lambda status: f"NOT (status = {q(status)} AND coalesce(date_diff('day', latest, published) > 365, false))"
_VOICE = "document_kind <> 'rating_report'"
_MEANS = f"CASE {t.READING} WHEN 'stated' THEN 'doubt' WHEN 'denied' THEN 'negated' ELSE {t.READING} END"
_RESOLVED = "CASE s->>'$.resolution' " + " ".join(f"WHEN {q(k)} THEN {t.says(p)}" for k, p in w.RESOLUTIONS.items()) + " ELSE true END"
_SPAN = "match IS NOT NULL"
CHECKS = {
    "guidance": {"span_match": _SPAN, "temporal_consistency": _PERIOD, "numbers_match": _NUMBERS, "unit_match": _UNIT, "metric_match": _METRIC},
    "liquidity": {"span_match": _SPAN, "temporal_consistency": _PERIOD, "issuer_voice": _VOICE, "liquidity_named": t.says(w.LIQUIDITY_TOPIC), "polarity": f"(status NOT IN ('deteriorated', 'concern') OR {t.LIQUID})"},
    "covenant": {
        "span_match": _SPAN, "temporal_consistency": _PERIOD, "issuer_voice": _VOICE, "historical_reference": _PAST("breached"), "covenant_named": t.says(rf"(?i){w.words(w.COVENANT)}|compliance"),
        "status_match": f"(status = 'mentioned' OR status = CASE WHEN {t.IS_COVENANT} THEN {t.COVENANT} ELSE 'mentioned' END)", "resolution_match": _RESOLVED,
    },
    "going_concern": {"span_match": _SPAN, "temporal_consistency": _PERIOD, "issuer_voice": _VOICE, "historical_reference": _PAST("doubt"), "going_concern_named": t.says(r"(?i)going\s+concern"), "status_match": f"(status = 'mentioned' OR status = coalesce({_MEANS}, 'none'))"},
}
JUDGED = PARSED | {
    "quotes": _QUOTES, "asked": "SELECT DISTINCT doc_id, kind, idx, text FROM quotes", **t.dates_of("asked", "doc_id, kind, idx", "q_"),
    "late": f"SELECT doc_id, kind, idx, max(day) AS latest FROM (SELECT doc_id, kind, idx, day FROM q_dated UNION ALL SELECT doc_id, kind, idx, CAST(y || {t.ENDS} AS DATE) FROM (SELECT doc_id, kind, idx, unnest({t.every(t.c.QUARTER, 1)}) AS n, unnest({t.every(t.c.QUARTER, 2)}) AS y FROM asked)) GROUP BY 1, 2, 3",
    "placed": "SELECT *, CASE WHEN substr(whole, s0 + 1, s1 - s0) = text THEN 'exact' WHEN instr(whole, text) > 0 AND instr(substr(whole, instr(whole, text) + 1), text) = 0 THEN 'unique' END AS match, CASE WHEN substr(whole, s0 + 1, s1 - s0) = text THEN s0 WHEN instr(whole, text) > 0 AND instr(substr(whole, instr(whole, text) + 1), text) = 0 THEN instr(whole, text) - 1 END AS at_ FROM quotes LEFT JOIN late USING (doc_id, kind, idx)",
    "judged_": "SELECT *, CASE kind " + " ".join(f"WHEN {q(k)} THEN list_filter([{', '.join(f'CASE WHEN NOT coalesce({x}, false) THEN {q(n)} END' for n, x in checks.items())}], lambda x: x IS NOT NULL)" for k, checks in CHECKS.items()) + " END AS failed FROM placed",
}


def parsed(load, name: str) -> DataFrame:
    return kinds.parse(load("v_answers").where(F.col("kind") == name).select("doc_id", "answer"), name)


def every(load, one) -> DataFrame:
    return reduce(DataFrame.unionByName, (one(name) for name in kinds.KINDS))


def judged(load, name: str) -> DataFrame:
    docs = load("v_documents").select("doc_id", "text", "published", F.when(F.col("doc_id") % 7 == 0, "rating_report").otherwise("press_release").alias("document_kind"))
    return kinds.validate(parsed(load, name), docs, name)


@R.query("V16_answer_parse", "SELECT doc_id, kind, CASE WHEN error IS NULL THEN 'ok' ELSE 'schema_failure' END AS run_status, error, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS n FROM runs", **PARSED)
def answer_parse(load):
    return every(load, lambda name: parsed(load, name).groupBy("doc_id", F.lit(name).alias("kind"), "run_status", "error").agg(F.count("idx").alias("n")))


@R.query("V14_verdict", "SELECT doc_id, kind, CAST(idx AS INT) AS idx, status, match, CASE WHEN len(failed) = 0 THEN 'VALID' ELSE 'INVALID' END AS verdict, array_to_string(failed, ',') AS failed FROM judged_", **JUDGED)
def verdict(load):
    return every(load, lambda name: judged(load, name).select("doc_id", "kind", "idx", "status", "match", "verdict", F.array_join("failed", ",").alias("failed")))


@R.query("V15_statement_ids", f"SELECT doc_id, kind, CAST(idx AS INT) AS idx, sha256(CASE kind {' '.join(f'WHEN {q(n)} THEN {q(k.version)}' for n, k in kinds.KINDS.items())} END || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || CAST(idx AS VARCHAR)) AS statement_id FROM judged_", **JUDGED)
def statement_ids(load):
    return every(load, lambda name: judged(load, name).select("doc_id", "kind", "idx", "statement_id"))


@R.query("V01_span_exact", "SELECT doc_id, kind, CAST(idx AS INT) AS idx, match, CAST(at_ AS BIGINT) AS start FROM judged_", **JUDGED)
def span_exact(load):
    """Exact places, moved quotes found at their only other place, and quotes that nobody said."""
    return every(load, lambda name: judged(load, name).select("doc_id", "kind", "idx", "match", F.col("at").alias("start")))
