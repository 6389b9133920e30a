"""Credit inputs derived from the given tables by integer arithmetic, in SQL that Spark and DuckDB both read.

A view is a SELECT over the tables and over views named before it; where the dialects differ, a pair (Spark, DuckDB).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from bondsight.functions.scales import alias_rows, scale_rows, values_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
AGENCIES = ("SP", "MOODYS", "FITCH", "DBRS")
ISSUER = "'ISS' || CAST(CAST(floor(o_custkey / 10) AS BIGINT) AS VARCHAR(20))"


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


#: One sentence or table is added to each document, as the given documents hold no credit vocabulary.
SENTENCES = (
    "S&P Global Ratings downgraded Acme Holdings plc from BBB- to BB+ on March 5, 2024.",
    "Moody's upgraded the issuer to Baa3 from Ba1 on 8 Jul 2024.",
    "Fitch Ratings affirmed the rating at BBB with a stable outlook.",
    "Moody's lowered the rating from Baa1 to A3, an apparent error.",
    "The company confirmed its full-year guidance for 2024.",
    "Results were in line with market expectations.",
    "Management lowered its revenue guidance to 95 million from 110 million.",
    "The board withdrew its outlook for fiscal 2024.",
    "There is substantial doubt about the ability to continue as a going concern.",
    "No breach of any covenant occurred in the second quarter of 2023.",
    "A breach of the leverage covenant was reported on 17-Dec-2022.",
    "Liquidity constraints could arise if markets close.",
    "The group recorded a significant impairment of EUR 250 million.",
    "Delta Energy N.V. issued EUR 1.2 billion of senior notes with a 7-year tenor and a 4.25% coupon.",
    "The bank decided not to call its USD 500 million AT1 instrument.",
    "The issuer plans to issue subordinated notes of EUR 300 million.",
    "The company will redeem its GBP 400 million bonds due 2027.",
    "Rating history\nS&P\n2023-01-15 | BBB+\n2024-02-20 | BBB",
    "Net debt fell to -1,234.5 and the margin was 12,5 by 30 June 2024.",
    "Acme Holdings plc and Delta Energy N.V. met the U.S. agency. It was approved.",
    "S&P placed Acme Holdings plc on CreditWatch negative. Moody's put the rating on review for upgrade.",
    "Fitch revised the outlook to negative from stable and affirmed the IDR at 'BBB'.",
    "Moody's Investors Service affirmed its Baa2 rating. DBRS confirmed its opinion.",
    "The group issued 500 million euros of senior notes with a seven-year tenor and a coupon of 4.5%.",
    "CHF 500 million of green bonds were placed, maturing in 2031.",
    "In the first quarter of 2022 sales rose; in the Third Quarter of 2023 they fell.",
    "Management's plans alleviated the substantial doubt about the going concern.",
    "Such losses could raise substantial doubt about the ability to continue as a going concern.",
    "Management concluded that, if the sale fails, there is a material uncertainty about the going concern.",
    "The company was in compliance with all covenants. The lenders waived the leverage covenant.",
    "The group may breach the leverage covenant next year.",
    "There are no liquidity concerns. Liquidity was strained by the closure.",
    "Loans and bonds of a total of EUR 700 million were placed on 3rd May, 2024.",
    "Moody's lowered the short-term rating to Ba1 from Baa3. Fitch cut it from Baa1 to BB.",
    "Our ratings as of 2024-02-20\nAgency | Long term\nS&P | BBB+ | stable\nMoody's | Baa2 | negative\nNobody | A",
    "S&P | Short term | Long term\nAcme Holdings plc | A-2 | BBB+ | stable\nFitch | Long term | Short term\nOther plc | BBB | F2\nMoody's | Long term | Short term\nAcme | Baa2\n| P-2 | negative",
    "Debt ratings as of June 30, 2024 were as follows\nThey are unsolicited.\nAgency | Short-term | Long-term | Outlook\nS&P(1) | A-2 | BBB+ | Stable\nMoody’s  Investors Service\n| P-2 | Baa2 | Review for downgrade\nFitch** | F2 | WD\nTotal | 3",
    "Credit ratings as of February 30, 2024\nS&P | BBB",
    "Ratings as of May 1, 2024\none\ntwo\nRatings as of May 2, 2023\nFitch | bbb- | none | RWN\nFitch | BBB\nRatings as of May 3, 2022\na\nb\nc\nd\nFitch | BBB",
    "The credit rating, as of December 31, 2023, is shown\nS&P | A\nS&P | A-\nS&P | A+\nFitch | AA\nFitch | AA-\nFitch | AA+\nMoody's | A1\nMoody's | A2\nMoody's | A3",
    "Fitch Ratings | Short-Term | Long-Term | Outlook\nAcme | F2\n| unsolicited\n| BBB+\n| Rating Watch Negative | stable\nS&P | Long-Term\nMoody's | Long-Term\nACME  holdings plc | Baa1 | bbb | Positive\nMoody's | Long-Term\n| Baa2",
    "On March 31, 2020 we breached the leverage covenant. We breached the leverage covenant again on June 30, 2024. On 1 July 2024 we violated a covenant.",
    "We breached the leverage covenant. A breach of the covenant was found in the first quarter of 2019. Liquidity was strained in 2019. Liquidity was strained by June 30, 2018.",
    "The company has not met the leverage covenant. An event of default under the notes occurred, as a covenant was not kept. We will not remain in compliance with the covenant.",
    "Net worth was above the required covenant. If sales fall, the company is in breach of the covenant. The covenants might by the end of next year be breached. The lenders agreed to forbearance.\n"
    "The lenders might agree, as the covenants were breached. A ratio above the minimum was asked for in the waiver.",
    "We had difficulty meeting payments; liquidity fell. Our business is free of liquidity pressure. A reduction of our liquidity was seen. In the absence of liquidity constraints we paid.",
    "We lowered our revenue guidance to EUR 95 million from EUR 110 million for 2024.",
    "There is substantial doubt about our ability to continue as a going concern, as of March 31, 2019.",
    "Fitch Ratings\nDate | Rating | Outlook\nMarch 5, 2024 | BBB+ | Stable\n8 Jul 2023 | NR\n17-Dec-2022 | bbb | Negative\nMay 2022 | A\nMoody's\nYear | Rating\nMay 1, 2024 | Baa1\nS&P\nRating | Date\nDec. 1, 2021 or so | BB",
)


def pick(values: tuple, index: str) -> str:
    """The index-th value, from 0."""
    cases = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {cases} END"


VIEWS: dict[str, str | tuple[str, str]] = {
    "v_scale": values_sql(scale_rows(), "agency, label, notch, seq"),
    "v_aliases": values_sql(alias_rows(), "alias, agency"),
    "v_issuers": """
SELECT 'ISS' || CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS VARCHAR(20)) AS issuer_id, min(c_mktsegment) AS sector, min(c_custkey) AS first_key, count(*) AS n_entities
FROM customer GROUP BY 1""",
    "v_rating_events": f"""
SELECT event_key, issuer_id, agency, old_notch, new_notch, new_outlook, watch, eff,
       CASE WHEN new_notch > old_notch THEN 'downgrade' WHEN new_notch < old_notch THEN 'upgrade' ELSE 'affirmation' END AS event_type
FROM (SELECT o_orderkey AS event_key, {ISSUER} AS issuer_id, {pick(AGENCIES, "o_orderkey * 7 + o_custkey")} AS agency,
             CAST(6 + (o_orderkey * 7919 + o_custkey) % 8 AS INT) AS old_notch,
             CAST(greatest(1, least(22, 6 + (o_orderkey * 7919 + o_custkey) % 8 + (o_orderkey * 31 + o_custkey * 17) % 6 - 2)) AS INT) AS new_notch,
             {pick(("positive", "stable", "negative", "developing", None), "o_orderkey * 11 + o_custkey * 3")} AS new_outlook,
             {pick(("none", "none", "none", "negative", "positive", "developing"), "o_orderkey * 13 + o_custkey * 5")} AS watch,
             CAST(o_orderdate AS DATE) AS eff
      FROM orders WHERE (o_orderkey + o_custkey) % 3 = 0) x""",
    "v_rating_candidates": f"""
SELECT issuer_id, agency, notch, as_of, rating_type, origin, outlook,
       issuer_id || '/' || CAST(l_orderkey AS VARCHAR(20)) || '/' || CAST(l_partkey AS VARCHAR(20)) || '/' || CAST(l_suppkey AS VARCHAR(20)) || '/' || CAST(l_linenumber AS VARCHAR(20)) AS source
FROM (SELECT DISTINCT {ISSUER} AS issuer_id, {pick(AGENCIES, "l_partkey + l_suppkey * 3")} AS agency, CAST(6 + (l_partkey * 17 + l_suppkey) % 8 AS INT) AS notch,
             CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS as_of,
             CASE WHEN l_linestatus = 'O' THEN 'long_term_issuer' ELSE 'senior_unsecured' END AS rating_type,
             CASE WHEN l_partkey % 3 = 0 THEN 'seed' ELSE 'observation' END AS origin,
             {pick(("positive", "stable", "negative", None), "l_partkey + l_orderkey")} AS outlook, l_orderkey, l_partkey, l_suppkey, l_linenumber
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 10 = 0) x""",
    "v_earnings_events": f"""
SELECT o_orderkey AS event_key, {ISSUER} AS issuer_id, CAST(o_orderdate AS DATE) AS eff,
       {pick(("sales", "revenue", "adjusted ebitda", "free cash flow", "ebit", "margin", None), "o_orderkey * 3 + o_custkey")} AS metric,
       CASE WHEN (o_orderkey + o_custkey) % 4 = 0 THEN NULL ELSE CAST(100 + (o_orderkey * 13) % 50 AS DOUBLE) END AS g_old,
       CASE WHEN (o_orderkey + o_custkey) % 4 = 0 THEN NULL ELSE CAST(100 + (o_orderkey * 13) % 50 + (o_custkey * 7 + o_orderkey * 5) % 41 - 25 AS DOUBLE) END AS g_new,
       {pick(("reaffirmed", "in_line", "cut", "raised", "withdrawn", None), "o_orderkey * 11 + o_custkey * 7")} AS status,
       (o_orderkey * 17 + o_custkey) % 97 = 0 AS significant, (o_orderkey * 19 + o_custkey) % 11 = 0 AS f_liquidity,
       (o_orderkey * 23 + o_custkey) % 13 = 0 AS f_covenant, (o_orderkey * 29 + o_custkey) % 17 = 0 AS f_going_concern, (o_orderkey * 31 + o_custkey) % 7 = 0 AS f_impairment,
       CASE WHEN (o_orderkey * 37 + o_custkey) % 41 = 0 THEN '2.04' WHEN (o_orderkey * 37 + o_custkey) % 41 = 1 THEN '2.02' END AS item
FROM orders WHERE o_orderkey % 5 = 0""",
    "v_issuance_events": f"""
SELECT o_orderkey AS event_key, {ISSUER} AS issuer_id, CAST(o_orderdate AS DATE) AS eff,
       {pick(("new_issue", "new_issue", "new_issue", "tap", "redemption", "non_call"), "o_orderkey * 7 + o_custkey")} AS event_type,
       {pick(("EUR", "EUR", "EUR", "USD", "GBP"), "o_orderkey * 3 + o_custkey")} AS currency,
       {pick(("senior", "senior", "senior", "subordinated", "hybrid", "AT1", "T2", None), "o_orderkey * 9 + o_custkey * 5")} AS seniority,
       CASE WHEN (o_orderkey + o_custkey) % 9 = 0 THEN NULL ELSE CAST(round(o_totalprice) AS BIGINT) * 4000 END AS amount
FROM orders WHERE o_orderkey % 5 = 1""",
    "v_documents": tuple(f"""
SELECT doc_id, coalesce(text, '') || chr(10) || {pick(SENTENCES, "doc_id")} AS text, {pick(SENTENCES, "doc_id")} AS added, {day} AS published,
       CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 60 AS VARCHAR(20)) END AS cik, CASE WHEN doc_id % 3 = 0 THEN 'ISS' || CAST(doc_id % 60 AS VARCHAR(20)) END AS issuer_hint
FROM documents""" for day in ("date_sub(DATE '2024-09-01', CAST(doc_id % 400 AS INT))", "DATE '2024-09-01' - CAST(doc_id % 400 AS INT)")),
    "v_gold": tuple(f"""
SELECT doc_id, k, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split, {pick(("revenue", "ebitda", "fcf", "margin"), "doc_id + k % 3")} AS metric,
       CASE WHEN (doc_id + k) % 5 = 0 THEN NULL ELSE CAST(2025 + k % 2 AS VARCHAR(4)) END AS period, {pick(("cut", "reaffirmed", "new", "raised"), "doc_id * 3 + k")} AS status,
       CAST((doc_id * k) % 50 AS DOUBLE) AS current_lower, k * 40 AS s0, k * 40 + 30 AS s1
FROM {source} WHERE k < doc_id % 5""" for source in ("documents LATERAL VIEW explode(sequence(0L, 3L)) t AS k", "documents, range(0, 4) t(k)")),
    "v_pred": tuple(f"""
SELECT doc_id, k AS idx, {pick(("revenue", "ebitda", "fcf", "margin"), "doc_id + k % 3")} AS metric,
       CASE WHEN (doc_id + k) % 5 = 0 THEN NULL ELSE CAST(2025 + k % 2 AS VARCHAR(4)) END AS period,
       {pick(("cut", "reaffirmed", "new", "raised"), "doc_id * 3 + k + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END")} AS status,
       CASE WHEN (doc_id * 5 + k) % 6 = 0 THEN 'INVALID' ELSE 'VALID' END AS validation_status,
       {pick(("numbers_match: 5", "span_exact: moved", "temporal: 2030", "metric_match: other"), "doc_id + k * 3")} AS reason,
       CAST((doc_id * k) % 49 AS DOUBLE) AS current_lower, k * 40 + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS s0, k * 40 + CASE WHEN doc_id % 3 = 0 THEN 35 ELSE 28 END AS s1
FROM {source} WHERE k < (doc_id + 1) % 6""" for source in ("documents LATERAL VIEW explode(sequence(0L, 4L)) t AS k", "documents, range(0, 5) t(k)")),
    "v_calls": f"""
SELECT event_id AS call_id, CAST(user_id % 50 AS BIGINT) AS run_id, ts, {pick(("terra", "sol"), "event_id")} AS model,
       {pick(("ok", "ok", "ok", "cached", "schema_failure", "refused"), "event_id + user_id")} AS status,
       CAST(1000 + (event_id * 37) % 9000 AS BIGINT) AS input_tokens, CAST(100 + (event_id * 17) % 1900 AS BIGINT) AS output_tokens, CAST(value * 100 AS DOUBLE) AS latency_ms
FROM events""",
    "v_prices": "SELECT * FROM (VALUES ('terra', 2.5, 15.0), ('sol', 5.0, 30.0)) AS t(model, input_price, output_price)",
}


KIND_NAMES = ("guidance", "liquidity", "covenant", "going_concern")
_STATUSES = {"guidance": ("cut", "raised", "mentioned", "cut"), "liquidity": ("concern", "stable", "deteriorated", "mentioned"), "covenant": ("breached", "compliant", "risk_of_breach", "mentioned"), "going_concern": ("doubt", "alleviated", "negated", "mentioned")}
_STATUS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {pick(x, 'floor(doc_id / 4)')}" for k, x in _STATUSES.items()) + " END"
_PERIOD = """CASE doc_id % 3 WHEN 0 THEN '"2024"' WHEN 1 THEN '"FY 2031"' ELSE 'null' END"""
_FIELDS = f"""'"status":"' || CASE WHEN m = 1 THEN 'awful' ELSE {_STATUS} END || '","period":' || {_PERIOD} || CASE WHEN m = 2 THEN ',"note":"x"' ELSE '' END || CASE kind
  WHEN 'guidance' THEN ',"metric":"' || {pick(('revenue', 'ebitda', 'revenue', 'other'), 'doc_id')} || '","metric_label":"revenue ","basis":"absolute","unit":"' || {pick(('EUR_MN', 'USD_MN', 'EUR_MN', 'PCT', 'EUR_BN'), 'doc_id')} || '","current_lower":95' || CASE WHEN doc_id % 5 = 0 THEN ',"previous_upper":111.5' WHEN doc_id % 5 = 1 THEN ',"previous_upper":null' ELSE '' END
  WHEN 'covenant' THEN ',"risk_type":"covenant","covenant_label":"Leverage","agreement":"senior notes"' || {pick(('', ',"resolution":"waived"', ',"resolution":"none"'), 'doc_id')}
  WHEN 'liquidity' THEN ',"risk_type":"liquidity","value":1e3' ELSE ',"risk_type":"going_concern"' END"""
_QUOTE = "CASE WHEN m = 4 THEN '' ELSE ',\"evidence_quote\":\"' || quote || CASE WHEN m = 8 THEN ' and nobody ever said so in public' ELSE '' END || '\"' END"
_PLACE = "CAST(CASE WHEN m = 3 THEN s1 WHEN m = 7 THEN s0 + 5 ELSE s0 END AS VARCHAR(20))", "CAST(CASE WHEN m = 3 THEN s0 WHEN m = 7 THEN s1 + 5 ELSE s1 END AS VARCHAR(20))"
#: Cached answers of every kind for each document: most quote its passage, others are broken off, misspelt, moved or foreign.
VIEWS["v_answers"] = tuple(f"""
SELECT doc_id, kind, CASE m WHEN 0 THEN '{{"statements":[' WHEN 6 THEN '{{"statements":[]}}' WHEN 9 THEN '{{"statements":{{"a":1}}}}' WHEN 11 THEN '{{"has":true}}'
  ELSE '{{"statements":[' || one || CASE WHEN m = 10 THEN ',' || replace(one, '"end_offset":', '"end_offset":-') ELSE '' END || ']}}' END AS answer
FROM (SELECT doc_id, kind, m, '{{' || {_FIELDS} || {_QUOTE} || ',"start_offset":' || CASE WHEN m = 5 THEN '"7"' ELSE {_PLACE[0]} END || ',"end_offset":' || {_PLACE[1]} || '}}' AS one
      FROM (SELECT doc_id, kind, CAST((doc_id + length(kind)) % 17 AS INT) AS m, split_part(added, chr(10), 1) AS quote, length(text) - length(added) AS s0, length(text) - length(added) + length(split_part(added, chr(10), 1)) AS s1
            FROM v_documents {kinds}) x) y""" for kinds in (f"LATERAL VIEW explode(array({', '.join(map(quoted, KIND_NAMES))})) t AS kind", f", (VALUES {', '.join(f'({quoted(k)})' for k in KIND_NAMES)}) t(kind)"))


def text(name: str, spark: bool) -> str:
    view = VIEWS[name]
    sql = view if isinstance(view, str) else view[0 if spark else 1]
    return re.sub(r"VARCHAR\(\d+\)", "STRING" if spark else "VARCHAR", sql)


def needed(sql: str) -> list[str]:
    """The views that a statement names, those they need first."""
    found = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    more = [v for v in VIEWS if v not in found and any(re.search(rf"\b{v}\b", text(f, False)) for f in found)]
    return [v for v in VIEWS if v in {*found, *more}]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over the tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = text(name, True)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    tables |= {v: view(spark, sf_dir, v) for v in VIEWS if v != name and re.search(rf"\b{v}\b", sql)}
    if not tables:
        return spark.sql(sql)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"(?<=FROM |JOIN ){t}\b", f"{{{t}}}", sql)
    return spark.sql(sql, **tables)


def oracle(sql: str, **extra: str) -> str:
    """The statement with its views, and named extra views after them, as common table expressions for DuckDB;
    an extra view may name itself."""
    whole = sql + " ".join(extra.values())
    ctes = [f"{v} AS ({text(v, False)})" for v in needed(whole)] + [f"{k} AS ({v})" for k, v in extra.items()]
    again = any(re.search(rf"\b(?:FROM|JOIN) {k}\b", v) for k, v in extra.items())
    return f"WITH {'RECURSIVE ' if again else ''}{', '.join(ctes)} {sql}" if ctes else sql
