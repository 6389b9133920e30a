"""SQL twins of the text operators: lines, sentences, dates and readings over documents, as common table expressions.

They work on the same texts by window functions and DuckDB's own list and pattern functions, so a query and its twin
share the word tables and nothing else.
"""

from __future__ import annotations

from bondsight.functions import textfns as tf
from bondsight.functions import wording as w
from bondsight.operators import corpus as c
from bondsight.sources.views import quoted as q

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def says(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def group(pattern: str, n: int = 1, text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {n}), '')"


def every(pattern: str, n: int = 0, text: str = "text") -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {n})"


def picked(cases: dict[str, str], otherwise: str = "NULL") -> str:
    """The first key whose condition holds."""
    return "CASE " + " ".join(f"WHEN {cond} THEN {q(name)}" for name, cond in cases.items()) + f" ELSE {otherwise} END"


def hits(cases: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {q(name)} END" for name, cond in cases.items()) + "], lambda x: x IS NOT NULL)"


WRAPS = (
    r"regexp_matches(prev, '[^ \t\r\f\v]') AND NOT contains(prev, '|') AND NOT contains(line, '|') AND NOT regexp_matches(prev, '[.!?;:][\"'')\]’”]*[ \t\r\f\v]*$')"
    r" AND (regexp_matches(line, '^[ \t\r\f\v]*\p{Ll}') OR (regexp_matches(prev, '-[ \t\r\f\v]*$') AND regexp_matches(line, '^\p{L}')))"
)
LINES = {
    "raw": "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM v_documents)",
    "phys": "SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead0, lag(line, 1, '') OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM raw",
    "logical": f"SELECT doc_id, g, min(lead0) AS lead0, string_agg(line, chr(10) ORDER BY n) AS line FROM (SELECT *, sum(CASE WHEN n > 1 AND {WRAPS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM phys) GROUP BY doc_id, g",
}
STEM = "lower(regexp_extract(rtrim(left(p, length(p) - 1), '.'), '[A-Za-z.&]*$'))"
SHORT = ", ".join(q(a) for a in sorted(tf.ABBREVIATIONS))
SENTS = LINES | {
    "toks": r"SELECT doc_id, g, lead0, unnest(t) AS tok, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, g, lead0, regexp_extract_all(line, '[ \t\r\f\v\n]*[^ \t\r\f\v\n]+') AS t FROM logical)",
    "marked": f"SELECT *, lead0 + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, ltrim(tok, {BLANKS}) AS word FROM toks",
    "cuts": f"SELECT *, CASE WHEN k > 1 AND regexp_matches(word, '^[A-Z0-9(\"''“]') AND regexp_matches(p, '[.!?]$') AND NOT ({STEM} IN ({SHORT}) OR regexp_matches({STEM}, '^[a-z]$')) THEN 1 ELSE 0 END AS b FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id, g ORDER BY k) AS p FROM marked)",
    "sents": f"SELECT doc_id, CAST(min(o + length(tok) - length(word)) AS BIGINT) AS start, CAST(max(o + length(tok)) AS BIGINT) AS \"end\", ltrim(string_agg(tok, '' ORDER BY k), {BLANKS}) AS text FROM (SELECT *, sum(b) OVER (PARTITION BY doc_id, g ORDER BY k) AS s FROM cuts) GROUP BY doc_id, g, s",
}

MONTH = "CASE x " + " ".join(f"WHEN {q(name)} THEN {n}" for name, n in tf.MONTH_OF.items()) + " END"
NEXT = ", ".join([*(f"lead(x, {i}, '') OVER w AS f{i}" for i in range(1, 7)), *(f"lag(x, {i}, '') OVER w AS b{i}" for i in range(1, 5))])
def dates_of(source: str, key: str = "doc_id", names: str = "") -> dict[str, str]:
    """The spelled dates of source (key, text): `dated`, with each table's name behind `names`."""
    p = names
    return {
        f"{p}parts": f"SELECT {key}, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z]+|[0-9]+|[^a-z0-9]+') AS p FROM {source} WHERE regexp_matches(text, '[0-9]{{4}}'))",
        f"{p}beside": f"SELECT *, {MONTH} AS m, {NEXT} FROM {p}parts WINDOW w AS (PARTITION BY {key} ORDER BY i) QUALIFY m IS NOT NULL",
        f"{p}paired": f"SELECT {key}, i, m," + r"""
       regexp_matches(f1, '^\.*[ \t\n\r]+$') AND regexp_matches(f2, '^[0-9]{1,2}$') AND NOT regexp_matches(b1, '[\p{L}\p{N}]$') AS day_after,
       CASE WHEN f3 IN ('st', 'nd', 'rd', 'th') THEN f4 ELSE f3 END AS g_gap, CASE WHEN f3 IN ('st', 'nd', 'rd', 'th') THEN f5 ELSE f4 END AS g_year, CASE WHEN f3 IN ('st', 'nd', 'rd', 'th') THEN f6 ELSE f5 END AS g_then,
       regexp_matches(f1, '^[.,]*[ \n\t-]') AND regexp_matches(b1, '^[ \n\t-]$') AS day_before,
       CASE WHEN b2 IN ('st', 'nd', 'rd', 'th') THEN b3 ELSE b2 END AS d_day, CASE WHEN b2 IN ('st', 'nd', 'rd', 'th') THEN b4 ELSE b3 END AS d_lead, f1, f2, f3
    """ + f" FROM {p}beside",
        f"{p}spelled": f"SELECT {key}, i, CASE" + r"""
         WHEN day_after AND regexp_matches(g_gap, '^,*[ \t\n\r]+$') AND regexp_matches(g_year, '^[0-9]{4}$') AND NOT regexp_matches(g_then, '^[\p{L}\p{N}]') THEN try_cast(g_year || '-' || m || '-' || f2 AS DATE)
         WHEN day_before AND regexp_matches(d_day, '^[0-9]{1,2}$') AND regexp_matches(f2, '^[0-9]{4}$') AND NOT regexp_matches(f3, '^[\p{L}\p{N}]') AND NOT regexp_matches(d_lead, '[\p{L}\p{N}]$') THEN try_cast(f2 || '-' || m || '-' || d_day AS DATE) END AS day""" + f" FROM {p}paired",
        f"{p}dated": f"SELECT {key}, day, i FROM {p}spelled WHERE day IS NOT NULL",
    }


DATES = dates_of("v_documents")
ENDS = "CASE lower(n) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in c.QUARTER_ENDS.items()) + " END"
LATEST = DATES | {
    "quarters": f"SELECT doc_id, CAST(y || {ENDS} AS DATE) AS day FROM (SELECT doc_id, unnest({every(c.QUARTER, 1)}) AS n, unnest({every(c.QUARTER, 2)}) AS y FROM v_documents)",
    "latest": "SELECT doc_id, max(day) AS latest FROM (SELECT doc_id, day FROM dated UNION ALL SELECT doc_id, day FROM quarters) GROUP BY 1",
}


def numbers(text: str) -> str:
    """X-06, a list of doubles."""
    found = every(tf.NUMBER, 0, text)
    return rf"list_transform({found}, lambda x: try_cast(replace(regexp_replace(regexp_replace(x, '^[‐‑‒–−]', '-'), ',(\d{{1,2}})$', '.\1'), ',', '') AS DOUBLE))"


def amount(text: str = "text") -> str:
    """X-07."""
    unit = "CASE lower(e.u) " + " ".join(f"WHEN {q(u)} THEN {s:.0f}" for u, s in w.UNITS.items()) + " ELSE 1 END"

    def found(pattern: str) -> str:
        pairs = f"list_transform(list_zip({every(pattern, 1, text)}, {every(pattern, 2, text)}), lambda z: {{'f': z[1], 'u': z[2]}})"
        value = rf"try_cast(replace(regexp_replace(e.f, ',(\d{{1,2}})$', '.\1'), ',', '') AS DOUBLE) * {unit}"
        return f"list_filter(list_transform({pairs}, lambda e: {{'u': e.u, 'x': {value}}}), lambda e: coalesce(e.x >= 1000, false) OR (e.u <> '' AND e.x IS NOT NULL))[1].x"

    return f"coalesce({found(w.AMOUNT)}, {found(w.AMOUNT_NAMED)})"


GUIDANCE = hits({s: says(p) for s, p in w.GUIDANCE.items()})
READING = picked({
    "alleviated": f"{says(w.DOUBT)} AND {says(w.RELIEVED)} AND NOT {says(w.RELIEF_OPEN)}",
    "denied": f"{says(w.DOUBT)} AND {says(w.DOUBT_DENIED)} AND NOT {says(w.RELIEVED)}",
    "hypothetical": f"{says(w.DOUBT)} AND NOT {says(w.DOUBT_CONCLUDED)} AND ({says(w.DOUBT_SUPPOSED)} OR {says(w.DOUBT_WEIGHED)} OR {says(w.DOUBT_CONDITION)}) AND NOT {says(w.RELIEVED)}",
    "stated": says(w.DOUBT),
})


def aside(flag: str) -> str:
    return f"nullif({READING}, 'stated')" if flag == "going_concern" else picked({"denied": says(w.DENIED[flag]), "hypothetical": says(w.SUPPOSED[flag])})


#: Flags of sentences, those whose own dates are all history set aside first.
FLAGS = {
    "raised": " UNION ALL ".join(f"SELECT doc_id, start, text, {q(flag)} AS flag, {aside(flag)} AS aside FROM sents WHERE {says(p)}" for flag, p in w.FLAGS.items()),
    "told": "SELECT DISTINCT doc_id, start, text FROM raised",
    **dates_of("told", "doc_id, start", "s_"),
    "s_latest": f"SELECT doc_id, start, max(day) AS latest FROM (SELECT doc_id, start, day FROM s_dated UNION ALL SELECT doc_id, start, CAST(y || {ENDS} AS DATE) FROM (SELECT doc_id, start, unnest({every(c.QUARTER, 1)}) AS n, unnest({every(c.QUARTER, 2)}) AS y FROM told)) GROUP BY 1, 2",
    "flagged": "SELECT doc_id, start, flag, CASE WHEN date_diff('day', latest, published) > 365 THEN 'historical' ELSE aside END AS aside FROM raised JOIN (SELECT doc_id, published FROM v_documents) USING (doc_id) LEFT JOIN s_latest USING (doc_id, start)",
}
STATUSES = f"SELECT doc_id, start, unnest({GUIDANCE}) AS status FROM sents"

AGENCIES = every(f"({c.AGENCY})", 1)
MOVED = f"""SELECT doc_id, start, old, new, a.agency, o.notch AS old_notch, n.notch AS new_notch, verb, short FROM (
  SELECT doc_id, start, regexp_extract(x, {q(rf'from[ \t\r\f\v\n]+({c.LABEL}){c.FREE}')}, 1) AS old, regexp_extract(x, {q(rf'to[ \t\r\f\v\n]+({c.LABEL}){c.FREE}')}, 1) AS new,
         {every(f'({c.AGENCY})', 1, 'lead')}[-1] AS named, lower({every(w.VERB, 1, 'lead')}[-1]) AS verb, short
  FROM (SELECT doc_id, start, found[i] AS x, array_to_string(cut[1:i], ' ') AS lead, short
        FROM (SELECT doc_id, start, found, cut, short, unnest(range(1, len(found) + 1)) AS i
              FROM (SELECT doc_id, start, {every(c.MOVE)} AS found, regexp_split_to_array(text, {q(c.MOVE)}) AS cut, {says(w.SHORT_TERM)} AS short FROM sents WHERE {says(c.MOVE)}))))
  LEFT JOIN v_aliases a ON lower(trim(named)) = a.alias
  LEFT JOIN v_scale o ON o.agency = a.agency AND o.label = old LEFT JOIN v_scale n ON n.agency = a.agency AND n.label = new"""
_DOWN, _UP = (", ".join(map(q, v)) for v in (w.DOWN, w.UP))
JUDGED = f"""SELECT doc_id, start, agency, old, new, new_notch - old_notch AS delta, CASE WHEN short THEN 'short_term' WHEN agency IS NULL THEN 'no_agency' WHEN new_notch - old_notch IS NULL THEN 'label_not_in_scale' WHEN verb IS NULL THEN 'no_verb'
  WHEN (verb IN ({_DOWN}) AND new_notch < old_notch) OR (verb IN ({_UP}) AND new_notch > old_notch) THEN 'direction_mismatch' END AS skip FROM moved"""


def value(x: str) -> str:
    return f"CASE {x} WHEN 'downgrade' THEN 'negative' WHEN 'upgrade' THEN 'positive' WHEN 'evolving' THEN 'developing' ELSE {x} END"


_WATCH = value(f"lower(coalesce({group(w.WATCH)}, {group(w.REVIEW)}))")
_OUTLOOK = f"CASE WHEN {says(w.MOVED)} THEN {value(f'lower({group(w.OUTLOOK_TO)})')} END"
ACTED = f"""SELECT doc_id, start, agency, event_type, rating, value, was FROM (
  SELECT doc_id, start, {AGENCIES}[1] AS named, CASE WHEN {_WATCH} IS NOT NULL THEN 'watch' WHEN {_OUTLOOK} IS NOT NULL THEN 'outlook_change' WHEN {says(w.AFFIRMED)} THEN 'affirmation' END AS event_type,
         coalesce({group(c.LABEL_AT)}, {group(c.LABEL_QUOTED)}, {group(c.LABEL_NOUN)}) AS rating, coalesce({_WATCH}, {_OUTLOOK}) AS value, CASE WHEN {_OUTLOOK} IS NOT NULL THEN {value(f'lower({group(w.OUTLOOK_FROM)})')} END AS was
  FROM sents WHERE {says(c.AGENCY)} AND NOT {says(c.MOVE)}) LEFT JOIN v_aliases ON lower(trim(named)) = alias
WHERE event_type IS NOT NULL AND (event_type <> 'affirmation' OR rating IS NOT NULL)"""

_KIND = picked({"non_call": says(w.NOT_CALLED), "redemption": says(w.REDEEMED), "tap": says(w.TAPPED)}, "'new_issue'")
_TENOR = f"lower({group(w.TENOR)})"
BONDS = f"""SELECT doc_id, start, {_KIND} AS event_type, {amount()} AS amount, try_cast(coalesce({group(w.COUPON_FIRST)}, {group(w.COUPON_LAST)}) AS DOUBLE) AS coupon,
  coalesce(try_cast({_TENOR} AS INT), CASE {_TENOR} {' '.join(f'WHEN {q(k)} THEN {v}' for k, v in w.TENOR_WORDS.items())} END) AS tenor,
  {picked({s: says(w.phrase(names)) for s, names in w.SENIORITIES.items()})} AS seniority, try_cast({group(w.DUE_YEAR)} AS INT) AS due, {says(w.GREEN)} AS green,
  CASE WHEN {says(w.INTENT)} AND NOT {says(w.NOT_CALLED)} THEN 'intent_only' WHEN {says(w.TOTAL)} AND {says(w.LOAN)} THEN 'total_with_loan' WHEN {amount()} IS NULL AND NOT {says(w.NOT_CALLED)} THEN 'no_amount' END AS skip
FROM sents WHERE {says(w.INSTRUMENT)} AND {says('|'.join((w.COMPLETED, w.REDEEMED, w.NOT_CALLED, w.TAPPED, w.INTENT)))}"""
ALL = SENTS | {
    "moved": MOVED, "judged": JUDGED, "statuses": STATUSES, **FLAGS, "bonds": BONDS,
    "branches": "SELECT doc_id, start, 'rating' AS branch, skip FROM judged UNION ALL SELECT doc_id, start, 'guidance', NULL FROM statuses UNION ALL SELECT doc_id, start, 'flag', aside FROM flagged UNION ALL SELECT doc_id, start, 'issuance', skip FROM bonds",
}
NAMED = f"SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest({every(c.ENTITY, 1)}) AS name FROM sents) WHERE NOT regexp_matches(name, {q(rf'\b(?:{c.AGENCY})\b')})"
MENTIONS = f"SELECT doc_id, start, agency FROM (SELECT doc_id, start, unnest({AGENCIES}) AS named FROM sents) JOIN v_aliases ON lower(trim(named)) = alias"

_WORDS = [w.before(w.MODALS[:4], w.WORRY, 4), w.near(w.WORRY, w.MODALS[:4], 1)]
LIQUID = f"({says(w.NOT_ENOUGH)} OR ({says(w.WORRIED)} AND NOT {says(w.WORRY_DENIED)} AND NOT {says(w.ADVERSE)} AND NOT {says(_WORDS[0])} AND NOT {says(_WORDS[1])}))"
_SUPPOSED = f"({says(w.BREACH_SUPPOSED)} OR {says(w.DOUBT_CONDITION)} OR ({says(w.BREACH_MODAL)} AND NOT {says(w.BREACH_STATED)}))"
COVENANT = picked({
    "breached": f"{says(w.BREACHED)} AND NOT {says(w.BREACH_DENIED)} AND NOT {_SUPPOSED}", "risk_of_breach": says(w.ANTICIPATED), "compliant": f"{says(w.COMPLIANT)} OR ({says(w.COMPARED)} AND {says(w.CONTRACT)})",
}, "'mentioned'")
IS_COVENANT = says(w.COVENANT_TOPIC)

# Rating tables: a recursive walk takes a line of each document at a time; what a row says is then read by joins.
_NAME = r"lower(trim(regexp_replace(regexp_replace(replace(c[1], '’', ''''), '(\(\w{1,2}\)|[*†‡])+$', ''), '\s+', ' ', 'g')))"
_STATED = rf"(?i)\bas of\s+((?:{'|'.join(tf.MONTHS)})\s+\d{{1,2}},\s+\d{{4}})\b"
_DAY = rf"try_strptime(regexp_replace({group(_STATED, 1, 'line')}, '\s+', ' ', 'g'), '%B %d, %Y')"
_LONG, _SHORT = "strpos(replace(lower(line), '-', ' '), 'long term')", "strpos(replace(lower(line), '-', ' '), 'short term')"
FEATURES = LINES | {
    "split": "SELECT doc_id, n, line, list_transform(string_split(line, '|'), lambda x: trim(x)) AS c FROM raw WHERE doc_id IN (SELECT doc_id FROM raw WHERE contains(line, '|'))",
    "feat": f"""SELECT s.*, len(c) AS w, agency AS ag, lead(c) OVER (PARTITION BY s.doc_id ORDER BY n) AS after, CASE WHEN {_LONG} > 0 THEN {_SHORT} > 0 AND {_SHORT} < {_LONG} END AS hl,
      CASE WHEN contains(lower(line), 'rating') THEN CAST({_DAY} AS DATE) END AS h FROM split s LEFT JOIN v_aliases ON {_NAME} = alias""",
}
AS_OF_WALK = FEATURES | {
    # o: 1 waits for a table, 2 is in one; t, k: lines waited, rows; j: this line was read with the one before
    "walk": """SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, 0 AS o, CAST(NULL AS DATE) AS d, 0 AS t, 0 AS k, false AS l, false AS j, false AS hit FROM feat
UNION ALL SELECT doc_id, n, x.o, x.d, x.t, x.k, x.l, x.j, x.hit FROM (SELECT f.doc_id, f.n, CASE
  WHEN walk.j THEN {'o': walk.o, 'd': walk.d, 't': walk.t, 'k': walk.k, 'l': walk.l, 'j': false, 'hit': false}
  WHEN walk.o > 0 AND f.ag IS NOT NULL AND (f.w > 1 OR (len(f.after) > 1 AND f.after[1] = '')) THEN {'o': CASE WHEN walk.k = 7 THEN 0 ELSE 2 END, 'd': walk.d, 't': walk.t, 'k': walk.k + 1, 'l': walk.l, 'j': f.w = 1, 'hit': true}
  WHEN walk.o = 1 THEN {'o': CASE WHEN walk.t = 3 THEN 0 ELSE 1 END, 'd': walk.d, 't': walk.t + 1, 'k': walk.k, 'l': coalesce(f.hl, walk.l), 'j': false, 'hit': false}
  WHEN f.h IS NOT NULL THEN {'o': 1, 'd': f.h, 't': 0, 'k': 0, 'l': false, 'j': false, 'hit': false}
  ELSE {'o': 0, 'd': NULL, 't': 0, 'k': 0, 'l': false, 'j': false, 'hit': false} END AS x
FROM walk JOIN feat f ON f.doc_id = walk.doc_id AND f.n = walk.n + 1)""",
    "hits": "SELECT f.doc_id, f.n, ag AS agency, walk.d AS as_of, walk.l AS last, CASE WHEN f.w = 1 THEN after ELSE c END AS row, CAST(NULL AS VARCHAR) AS skip FROM walk JOIN feat f ON f.doc_id = walk.doc_id AND f.n = walk.n WHERE walk.hit",
}
_ON, _NEW = "(walk.p = 2 AND f.line LIKE '|%')", "(walk.p = 1 AND f.w > 1 AND f.c[1] <> '' AND f.ag IS NULL)"
CURRENT_WALK = FEATURES | {
    # p: 1 after a header, 2 in an entity's row, which began at line s
    "walk": f"""SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, 0 AS p, CAST(NULL AS VARCHAR) AS a, false AS l, CAST(0 AS BIGINT) AS s FROM feat
UNION ALL SELECT f.doc_id, f.n, CASE WHEN {_ON} OR {_NEW} THEN 2 WHEN f.w > 1 AND f.ag IS NOT NULL AND f.hl IS NOT NULL THEN 1 ELSE 0 END,
  CASE WHEN {_ON} OR {_NEW} THEN walk.a ELSE f.ag END, CASE WHEN {_ON} OR {_NEW} THEN walk.l ELSE coalesce(f.hl, false) END, CASE WHEN {_ON} THEN walk.s ELSE f.n END
FROM walk JOIN feat f ON f.doc_id = walk.doc_id AND f.n = walk.n + 1""",
    "hits": r"""SELECT doc_id, n, agency, CAST(NULL AS DATE) AS as_of, last, row, CASE WHEN regexp_replace(lower(row[1]), '\s+', ' ', 'g') NOT IN ('acme holdings plc', 'acme') THEN 'entity_mismatch' END AS skip
FROM (SELECT walk.doc_id, walk.s AS n, walk.a AS agency, bool_or(walk.l) AS last, flatten(list(CASE WHEN walk.s = walk.n THEN f.c ELSE f.c[2:] END ORDER BY walk.n)) AS row
      FROM walk JOIN feat f ON f.doc_id = walk.doc_id AND f.n = walk.n WHERE walk.p = 2 GROUP BY 1, 2, 3)""",
}
#: A cell that is a date as a whole, in the usual spellings.
_CELL_DAY = "coalesce(" + ", ".join(f"try_strptime(replace(replace(f.c[1], '.', ''), '-', ' '), '{x}')" for x in ("%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y")) + ")"
DATED_WALK = FEATURES | {
    # p: 1 after an agency alone on its line, 2 in its table
    "walk": f"""SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, 0 AS p, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS DATE) AS d FROM feat
UNION ALL SELECT f.doc_id, f.n, CASE WHEN walk.p = 2 AND f.w > 1 AND {_CELL_DAY} IS NOT NULL THEN 2 WHEN walk.p = 1 AND f.w > 1 AND contains(lower(f.line), 'date') AND contains(lower(f.line), 'rating') THEN 2 WHEN f.w = 1 AND f.ag IS NOT NULL THEN 1 ELSE 0 END,
  CASE WHEN walk.p > 0 AND f.w > 1 THEN walk.a ELSE f.ag END, CASE WHEN walk.p = 2 AND f.w > 1 THEN CAST({_CELL_DAY} AS DATE) END
FROM walk JOIN feat f ON f.doc_id = walk.doc_id AND f.n = walk.n + 1""",
    "hits": "SELECT f.doc_id, f.n, walk.a AS agency, walk.d AS as_of, false AS last, c AS row, CAST(NULL AS VARCHAR) AS skip FROM walk JOIN feat f ON f.doc_id = walk.doc_id AND f.n = walk.n WHERE walk.p = 2 AND walk.d IS NOT NULL",
}
_PLAIN = r"regexp_replace(translate(cell, '‐‑‒–—−', '------'), '\s+', '', 'g')"
_WATCHED = picked({k: " OR ".join(f"contains(lower(cell), {q(m)})" for m in marks) for k, marks in tf.WATCHES.items()})
ROWS_READ = {
    "cells": f"SELECT doc_id, n, agency, last, cell, i, {_PLAIN} AS plain, {_WATCHED} AS watch, CASE WHEN lower(cell) IN ({', '.join(map(q, tf.OUTLOOKS))}) THEN lower(cell) END AS outlook FROM (SELECT doc_id, n, agency, last, unnest(row) AS cell, generate_subscripts(row, 1) AS i FROM hits)",
    "known": """SELECT c.*, coalesce(e.label, CASE WHEN plain = upper(plain) OR plain = lower(plain) THEN f.label END) AS label FROM cells c LEFT JOIN v_scale e ON e.agency = c.agency AND replace(e.label, ' ', '') = plain
      LEFT JOIN (SELECT agency, lower(replace(label, ' ', '')) AS low, arg_min(label, seq) AS label FROM v_scale GROUP BY 1, 2) f ON f.agency = c.agency AND f.low = lower(plain)""",
    "chosen": "SELECT doc_id, n, CASE WHEN bool_or(last) THEN max(i) ELSE min(i) END AS pos FROM known WHERE label IS NOT NULL AND i > 1 GROUP BY 1, 2",
    "viewed": "SELECT k.doc_id, k.n, arg_min({'o': CASE WHEN watch IS NULL THEN outlook END, 'w': watch}, i) AS v FROM known k JOIN chosen x ON x.doc_id = k.doc_id AND x.n = k.n AND i > x.pos WHERE outlook IS NOT NULL OR watch IS NOT NULL GROUP BY 1, 2",
    "table_rows": """SELECT h.doc_id, CAST(h.n - 1 AS INT) AS n, h.agency, CASE WHEN h.skip IS NULL THEN k.label END AS label, CASE WHEN h.skip IS NULL THEN notch END AS notch, CASE WHEN h.skip IS NULL THEN v.o END AS outlook,
      CASE WHEN h.skip IS NULL AND k.label IS NOT NULL THEN coalesce(v.w, 'none') END AS watch, CASE WHEN h.skip IS NULL AND k.label IS NOT NULL THEN as_of END AS as_of, coalesce(h.skip, CASE WHEN k.label IS NULL THEN 'no_long_term_label' END) AS skip
      FROM hits h LEFT JOIN chosen x ON x.doc_id = h.doc_id AND x.n = h.n LEFT JOIN known k ON k.doc_id = h.doc_id AND k.n = h.n AND k.i = x.pos
      LEFT JOIN viewed ON viewed.doc_id = h.doc_id AND viewed.n = h.n LEFT JOIN v_scale s ON s.agency = h.agency AND s.label = k.label""",
}
