"""Registered queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from bondsight import plans

SF = "/root/testdata/sf0.001"
#: A share of each group; the whole set is compared by the driver.
SOME = [
    "J05_label_to_notch", "J09_rating_state", "J10_rejected_candidates", "M04_composite", "T04_state_after", "R00_rule_matrix", "R22_mod02", "R23_mod03", "R24_decisions",
    "D01_doc_exact_dedup", "D02_same_id_merge", "D03_event_greedy_dedup", "D09_idempotent_apply", "G01_midpoint_delta", "G04_governing_metric", "G08_fill_only_empty",
    "J16_gold_match", "Q03_occurrence_scores", "Q05_family_scores", "Q07_missed_gold", "A02_watchlist", "A11_budget_gate", "C11_gold_drift", "L05_recorded_statements",
    "N11_span_verify", "N12_unique_quote_find", "X05_historical", "E01_rating_transitions", "E06_flag_scan", "J04_resolve_cascade", "L08_claim_verify", "S06_canonical_url", "V16_answer_parse",
    "X01_logical_lines", "X02_sentences", "X03_dates", "X06_numbers", "X09_named_entities", "X12_document_agency", "E02_watch_outlook_affirm", "E09_issuance", "E12_ratings_table_current", "E17_skip_ledger", "V09_liquidity_polarity", "V10_covenant_status", "V12_going_concern_status",
    "S05_page_links", "S08_seed_load", "S11_gold_scan", "S13_alert_sink", "M02_boundary_ig", "M05_composite_average", "M06_outlook_watch", "T07_rating_after_action", "N01_text_canonical", "N02_html_to_lines", "N03_boilerplate_drop", "N06_two_hashes", "L07_alert_card_json", "ST01_incremental_documents", "ST02_alert_digest", "V07_scope_match",
]


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return None
        if hasattr(v, "year"):
            return str(v)[:10]
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return str(v)
        return f"{float(v):.6f}"

    return sorted((tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, duck, name):
    ours, theirs = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_every_oracle_parses(duck):
    for name, sql in plans.ORACLES.items():
        duck.execute(f"EXPLAIN {sql}"), name


def test_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
