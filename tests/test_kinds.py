"""Answers of each statement kind: what fails them, and which checks fail a statement."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bondsight.operators import corpus, kinds, validate

TEXTS = {
    "guidance": "Intro. We lowered our revenue guidance to EUR 95 million from EUR 110 million for 2024. Sales rose.",
    "liquidity": "Intro. Liquidity was strained by the closure. There are no liquidity concerns.",
    "covenant": "Intro. We breached the leverage covenant on June 30, 2024. In 2019, on May 5, 2019, we breached the covenant.",
    "going_concern": "Intro. There is substantial doubt about our ability to continue as a going concern. Management's plans alleviated the substantial doubt about the going concern.",
}
BASE = {
    "guidance": {"metric": "revenue", "metric_label": "revenue guidance", "basis": "absolute", "unit": "EUR_MN", "current_lower": 95, "previous_upper": 110.0, "period": "2024", "status": "cut"},
    "liquidity": {"risk_type": "liquidity", "status": "concern", "period": None},
    "covenant": {"risk_type": "covenant", "status": "breached", "resolution": "none", "covenant_label": "Leverage", "agreement": "bank loan"},
    "going_concern": {"risk_type": "going_concern", "status": "doubt"},
}
QUOTE = {"guidance": "We lowered our revenue guidance to EUR 95 million from EUR 110 million for 2024.", "liquidity": "Liquidity was strained by the closure.", "covenant": "We breached the leverage covenant on June 30, 2024.", "going_concern": "There is substantial doubt about our ability to continue as a going concern."}


def said(kind, quote=None, **more):
    quote = QUOTE[kind] if quote is None else quote
    start = max(TEXTS[kind].find(quote), 0)
    return {k: v for k, v in (BASE[kind] | {"evidence_quote": quote, "start_offset": start, "end_offset": start + len(quote)} | more).items() if v != "gone"}


def judged(spark, kind, statements, document_kind="press_release"):
    docs = spark.createDataFrame([(1, TEXTS[kind], dt.date(2024, 9, 1), document_kind)], "doc_id long, text string, published date, document_kind string")
    answers = spark.createDataFrame([(1, json.dumps({"statements": statements}))], "doc_id long, answer string")
    rows = kinds.validate(kinds.parse(answers, kind), docs, kind).orderBy("idx").collect()
    return [(r.match, r.verdict, list(r.failed), list(r.dropped)) for r in rows]


@pytest.mark.parametrize("kind", list(kinds.KINDS))
def test_answers_of_each_kind(spark, kind):
    """One wrong thing fails the whole answer, and is named."""
    good = said(kind)
    cases = {
        json.dumps({"statements": [good, good]}): (None, 2), json.dumps({"statements": []}): (None, 0), json.dumps({"other": 1}): (None, 0), '{"statements":[': ("no_json", 0), "": ("no_json", 0), json.dumps({"statements": 7}): ("type:statements", 0),
        json.dumps({"statements": [good, said(kind, status="awful")]}): ("value:status", 0), json.dumps({"statements": [said(kind, status="gone")]}): ("missing:status", 0), json.dumps({"statements": [said(kind, evidence_quote=None)]}): ("missing:evidence_quote", 0),
        json.dumps({"statements": [said(kind, start_offset="7")]}): ("type:start_offset", 0), json.dumps({"statements": [said(kind, period=2024)]}): ("type:period", 0), json.dumps({"statements": [said(kind, note="x")]}): ("unknown:note", 0),
        json.dumps({"statements": [said(kind, evidence_quote="")]}): ("empty_quote", 0), json.dumps({"statements": [said(kind, end_offset=0)]}): ("offsets", 0), json.dumps({"statements": [said(kind, start_offset=-1)]}): ("offsets", 0),
        json.dumps({"statements": [said(kind, start_offset=10**12)]}): ("offsets", 0),
    }
    rows = spark.createDataFrame([*enumerate(cases), (99, None)], "doc_id long, answer string")
    got = {r.doc_id: (r.error, r.n) for r in kinds.parse(rows, kind).groupBy("doc_id", "error").agg(F.count("idx").alias("n")).collect()}
    assert got == dict(enumerate(cases.values())) | {99: ("no_json", 0)}


def test_verdicts(spark):
    assert judged(spark, "guidance", [said("guidance"), said("guidance", current_lower=96), said("guidance", unit="USD_MN"), said("guidance", unit="EUR_BN"), said("guidance", metric="ebitda"), said("guidance", metric_label="sales"), said("guidance", period="FY 2031"), said("guidance", start_offset=0, end_offset=9), said("guidance", evidence_quote="never said")]) == [
        ("exact", "VALID", [], []), ("exact", "INVALID", ["numbers_match"], []), ("exact", "INVALID", ["unit_match"], []), ("exact", "INVALID", ["unit_match"], []), ("exact", "INVALID", ["metric_match"], []), ("exact", "INVALID", ["metric_match"], []),
        ("exact", "INVALID", ["temporal_consistency"], []), ("unique", "VALID", [], []), (None, "INVALID", ["span_match", "numbers_match", "unit_match", "metric_match"], []),
    ]
    assert judged(spark, "liquidity", [said("liquidity"), said("liquidity", "There are no liquidity concerns."), said("liquidity", "There are no liquidity concerns.", status="stable"), said("liquidity", "Intro.")]) == [("exact", "VALID", [], []), ("exact", "INVALID", ["polarity"], []), ("exact", "VALID", [], []), ("exact", "INVALID", ["liquidity_named", "polarity"], [])]
    assert judged(spark, "covenant", [said("covenant"), said("covenant", "In 2019, on May 5, 2019, we breached the covenant."), said("covenant", status="compliant"), said("covenant", resolution="waived"), said("covenant", status="mentioned", covenant_label=None, agreement=None)]) == [
        ("exact", "VALID", [], ["agreement"]), ("exact", "INVALID", ["historical_reference"], ["covenant_label", "agreement"]), ("exact", "INVALID", ["status_match"], ["agreement"]), ("exact", "INVALID", ["resolution_match"], ["agreement"]), ("exact", "VALID", [], []),
    ]
    assert judged(spark, "going_concern", [said("going_concern"), said("going_concern", status="negated"), said("going_concern", "Management's plans alleviated the substantial doubt about the going concern.", status="alleviated"), said("going_concern", "Management's plans alleviated the substantial doubt about the going concern.")]) == [
        ("exact", "VALID", [], []), ("exact", "INVALID", ["status_match"], []), ("exact", "VALID", [], []), ("exact", "INVALID", ["status_match"], []),
    ]
    assert judged(spark, "covenant", [said("covenant")], "rating_report")[0][2] == ["issuer_voice"]


def one(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").orderBy("i").select(f(F.col("text")).alias("x"))
    return dict(zip(texts, (r.x for r in rows.collect()), strict=True))


def test_wording_of_breaches_and_worries(spark):
    covenants = {
        "The company has not met the leverage covenant.": "breached", "An event of default occurred under the covenant.": "breached", "An event of default occurred.": None, "No event of default under any covenant occurred.": "compliant",
        "We will not remain in compliance with the covenant.": "risk_of_breach", "Any event of default would breach a covenant.": "mentioned",
        "Net worth was above the required covenant.": "compliant", "The ratio did not exceed the maximum that the covenant allows.": "compliant", "A ratio above the minimum was asked for in the waiver.": "mentioned",
        "If sales fall, the company is in breach of the covenant.": "mentioned", "The covenants might by the end of next year be breached.": "mentioned", "The lenders might agree, as the covenants were breached.": "breached", "The lenders agreed to forbearance.": "mentioned",
    }
    assert one(spark, validate.covenant_status, list(covenants)) == covenants
    worries = {"We had difficulty meeting payments.": True, "Difficulties in refinancing arose.": True, "A reduction in our liquidity was seen.": True, "We are free of liquidity pressure.": False, "In the absence of constraints we paid.": False, "Liquidity is strong.": False}
    assert one(spark, validate.liquidity_stands, list(worries)) == worries


def test_flags_of_history(spark):
    """Historical before and after; the first that stands is the first, whatever was set aside before it."""
    text = "On March 31, 2020 we breached the covenant. We breached the covenant on June 30, 2024. We breached the covenant. A breach of the covenant was found in the first quarter of 2019. No breach of a covenant occurred on May 1, 2019."
    docs = spark.createDataFrame([(1, text, dt.date(2024, 9, 1)), (2, text, None)], "doc_id long, text string, published date")
    rows = corpus.flag_scan(corpus.sentences(docs, "published")).where("flag = 'covenant'").orderBy("doc_id", "start").collect()
    assert [(r.aside, r.first) for r in rows if r.doc_id == 1] == [("historical", False), (None, True), (None, False), ("historical", False), ("historical", False)]
    assert [r.aside for r in rows if r.doc_id == 2] == [None, None, None, None, "denied"]


def test_document_date(spark):
    rows = [
        (1, "x", dt.date(2024, 1, 1), "https://x/2020-01-01"), (2, "x" * 590 + " May 5, 2023", None, "https://x/2020-01-01"), (3, "May 5, 2023 and June 6, 2022", None, None), (4, None, None, "https://x/a/2020-01-31/b?d=2021-01-01"),
        (5, "", None, "https://x/3-may-2022/5_June_2023"), (6, "", None, "https://x/2020-13-31"), (7, "", None, None),
    ]
    got = {r.doc_id: r.day for r in corpus.document_date(spark.createDataFrame(rows, "doc_id long, text string, published date, url string")).collect()}
    assert got == {1: dt.date(2024, 1, 1), 2: dt.date(2020, 1, 1), 3: dt.date(2023, 5, 5), 4: dt.date(2020, 1, 31), 5: dt.date(2023, 6, 5), 6: None, 7: None}
