"""Decision tables on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from bondsight.functions import textfns as tf
from bondsight.operators import dedup, profiles, rules, state

DAY = dt.date(2024, 6, 1)
CAND = "issuer_id string, agency string, notch int, as_of date, rating_type string, origin string, outlook string, source string"
EVENT = "event_key long, issuer_id string, agency string, old_notch int, new_notch int, new_outlook string, watch string, eff date, event_type string"


def cand(agency, notch, days, origin="observation", source="s", kind="long_term_issuer", outlook=None):
    return ("I", agency, notch, None if days is None else DAY - dt.timedelta(days), kind, origin, outlook, source)


def test_state_has_no_look_ahead(spark):
    rows = [cand("SP", 9, 10), cand("SP", 12, -1), cand("SP", 8, 10, "seed"), cand("FITCH", 7, 401), cand("FITCH", 6, 400), cand("MOODYS", 5, None), cand("DBRS", 4, 1), cand("MOODYS", 3, 0, kind="senior_unsecured")]
    events = spark.createDataFrame([(1, "I", "SP", 9, 10, None, "none", DAY, "downgrade")], EVENT)
    got = {r.agency: (r.notch, r.age_days) for r in state.state_before(events, spark.createDataFrame(rows, CAND)).collect()}
    assert got == {"SP": (9, 10), "FITCH": (6, 400)}
    reasons = {r.reason for r in state.rejected(events, spark.createDataFrame(rows, CAND)).collect()}
    assert reasons == {"observed after D", "superseded", "stale", "incomplete date", "non-admissible agency", "rating type not eligible"}


def test_state_leaves_the_event_itself_out(spark):
    events = spark.createDataFrame([(1, "I", "SP", 9, 10, None, "none", DAY, "downgrade")], EVENT)
    found = state.candidates(spark.createDataFrame([], CAND), spark.createDataFrame([cand("SP", 9, 3)], CAND), events)
    assert [r.notch for r in state.state_before(events, found).collect()] == [9]


def decided(spark, rows, cands=()):
    return rules.decide(rules.decide_base(rules.guidance_inputs(rules.with_state(rules.shaped(spark.createDataFrame(rows, EVENT), "rating"), spark.createDataFrame(list(cands), CAND)))))


def test_rating_rules_and_modifiers(spark):
    rows = [
        (1, "I", "SP", 10, 11, None, "none", DAY, "downgrade"),  # falls to high yield by one notch
        (2, "J", "SP", 5, 6, None, "none", DAY, "downgrade"),
        (3, "K", "SP", 9, 10, None, "none", DAY, "downgrade"),  # the weakest rating is then the last investment grade
        (4, "L", "DBRS", 5, 9, None, "none", DAY, "downgrade"),  # no admissible agency
        (5, "M", "SP", 8, 8, None, "none", DAY, "affirmation"),
    ]
    got = {r.event_key: (r.priority, list(r.applied)) for r in decided(spark, rows, [cand("FITCH", 9, 5)]).collect()}
    assert got[1] == ("P1", ["RAT-01", "RAT-02"])
    assert got[2] == ("P2", ["RAT-05"])
    assert got[3] == ("P1", ["RAT-05", "MOD-01"])
    assert got[4] == (None, [])
    assert got[5] == ("P3", ["RAT-10"])


def test_second_negative_p2_in_thirty_days_is_raised(spark):
    rows = [(k, "I", "SP", 5, 6, None, "none", DAY + dt.timedelta(d), "downgrade") for k, d in ((1, 0), (2, 30), (3, 61))]
    got = {r.event_key: r.priority for r in decided(spark, rows).collect()}
    assert got == {1: "P2", 2: "P1", 3: "P2"}


def test_greedy_anchors(spark):
    days = [1, 2, 9, 10, 11, 20, None, None]
    rows = [(i, "a", None if d is None else dt.date(2024, 1, d)) for i, d in enumerate(days)]
    got = dedup.greedy(spark.createDataFrame(rows, "seq long, key string, day date"), ["key"], "day", "seq").orderBy("seq").collect()
    assert [r.anchor for r in got] == [0, 0, 2, 2, 2, 5, 6, 6]


def test_text_helpers(spark):
    text = "Mr. Smith of Acme Inc. spoke. It rained\non 5 March 2024. J. Doe left."
    assert [t for _, _, t in tf.sentences_of(text)] == ["Mr. Smith of Acme Inc. spoke.", "It rained\non 5 March 2024.", "J. Doe left."]
    assert all(text[a:b] == t for a, b, t in tf.sentences_of(text))
    assert [d for d, _, _ in tf.find_dates("31 Feb 2024, Dec. 17, 2025 and March 2024")] == [dt.date(2025, 12, 17)]
    assert tf.html_lines("<p>a<b>b</b></p><script>x</script><table><tr><td>1</td><td>2</td></tr></table><nav>n</nav>", True) == "ab\n1 | 2"
    df = spark.createDataFrame([("fell −1,234.5 to 12,5 and 7",)], "t string").select(tf.numbers(F.col("t")).alias("n"), tf.amount(F.lit("EUR 1.2 bn")).alias("a"))
    assert df.first() == ([-1234.5, 12.5, 7.0], 1.2e9)


def test_latest_reference_takes_every_quarter(spark):
    from bondsight.operators import corpus

    texts = [(1, "In the first quarter of 2022 sales rose; in the Third Quarter of 2024 they fell."), (2, "Fourth quarter of 2023, then the second quarter of 2023."), (3, "first quarter of 2022, 5 March 2024, second quarter ended 2023"), (4, "nothing")]
    got = {r.doc_id: str(r.latest) for r in corpus.latest_reference(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "2024-09-30", 2: "2023-12-31", 3: "2024-03-05"}


def sents(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, start long, text string")


def test_rating_actions(spark):
    from bondsight.operators import corpus

    texts = [
        "Moody's affirmed its Baa2 rating.", "Fitch affirmed the long-term IDR at 'BBB'.", "S&P placed the ratings on CreditWatch negative.", "Moody's put A3 notes under review for a possible upgrade.",
        "Fitch revised the outlook to negative from stable.", "S&P affirmed its view.", "The outlook is stable.", "S&P lowered its rating to BB from BBB- and affirmed the notes.",
    ]
    got = {r.doc_id: (r.agency, r.event_type, r.rating, r.value, r.was) for r in corpus.actions(sents(spark, *texts)).collect()}
    assert got == {
        0: ("MOODYS", "affirmation", "Baa2", None, None), 1: ("FITCH", "affirmation", "BBB", None, None), 2: ("SP", "watch", None, "negative", None),
        3: ("MOODYS", "watch", "A3", "positive", None), 4: ("FITCH", "outlook_change", None, "negative", "stable"),
    }


def test_rating_moves(spark):
    from bondsight.operators import corpus

    texts = [
        "S&P downgraded Acme from BBB- to BB+.", "Moody's raised it to Baa3 from Ba1, and Fitch cut it to BB from BBB.", "S&P lowered the short-term rating from A to B.", "It was cut from BBB to BB.",
        "Fitch moved it from BBB to BB.", "Moody's lowered it from BBB to BB.", "Moody's upgraded it from A3 to Baa1.", "from AAAx to BB",
    ]
    got = sorted((r.doc_id, r.agency, r.old, r.new, r.delta, r.skip) for r in corpus.transitions(sents(spark, *texts)).collect())
    assert got == [
        (0, "SP", "BBB-", "BB+", 1, None), (1, "FITCH", "BBB", "BB", 3, None), (1, "MOODYS", "Ba1", "Baa3", -1, None), (2, "SP", "A", "B", 9, "short_term"),
        (3, None, "BBB", "BB", None, "no_agency"), (4, "FITCH", "BBB", "BB", 3, "no_verb"), (5, "MOODYS", "BBB", "BB", None, "label_not_in_scale"), (6, "MOODYS", "A3", "Baa1", 1, "direction_mismatch"),
    ]


def test_bond_terms(spark):
    from bondsight.operators import corpus

    texts = [
        "The group issued CHF 500 million of senior notes.", "It placed 500 million euros of bonds with a seven-year tenor and a coupon of 4.5%.", "Green bonds of EUR 1.2 bn due 2031 were priced with a 3.25% coupon.",
        "The issuer intends to issue notes of EUR 300 million.", "It decided not to call its AT1 instrument.", "Loans and notes of a total of EUR 2 bn were placed.", "Notes were placed.", "A walk in the park.",
    ]
    got = {r.doc_id: (r.event_type, r.amount, r.coupon, r.tenor, r.seniority, r.due, r.green, r.skip) for r in corpus.issuance(sents(spark, *texts)).collect()}
    assert got == {
        0: ("new_issue", 5e8, None, None, "senior", None, False, None), 1: ("new_issue", 5e8, 4.5, 7, None, None, False, None), 2: ("new_issue", 1.2e9, 3.25, None, None, 2031, True, None),
        3: ("new_issue", 3e8, None, None, None, None, False, "intent_only"), 4: ("non_call", None, None, None, "AT1", None, False, None),
        5: ("new_issue", 2e9, None, None, None, None, False, "total_with_loan"), 6: ("new_issue", None, None, None, None, None, False, "no_amount"),
    }


def test_risk_readings(spark):
    from bondsight.operators import corpus, validate

    texts = {
        "There is substantial doubt about the going concern.": "stated", "There is no substantial doubt about it.": "denied", "Losses could raise substantial doubt.": "hypothetical", "If sales fall, material uncertainty remains.": "hypothetical",
        "Plans alleviated the substantial doubt.": "alleviated", "Plans intended to mitigate the substantial doubt exist.": "stated", "Management evaluated whether conditions raise substantial doubt.": "hypothetical",
        "Even if the sale closes, management concluded that there is substantial doubt.": "stated", "All is well.": None,
    }
    got = [r.x for r in sents(spark, *texts).orderBy("doc_id").select(corpus.going_concern(F.col("text")).alias("x")).collect()]
    assert got == list(texts.values())
    covenants = {"We breached the covenant.": "breached", "No breach of any covenant occurred.": "compliant", "We may breach the covenant.": "risk_of_breach", "We were in compliance with all covenants.": "compliant", "The covenant was agreed.": "mentioned", "Sales rose.": None, "We were not in compliance with the covenant.": "breached"}
    got = [r.x for r in sents(spark, *covenants).orderBy("doc_id").select(validate.covenant_status(F.col("text")).alias("x")).collect()]
    assert got == list(covenants.values())
    liquid = {"Liquidity was strained.": True, "There are no liquidity concerns.": False, "Liquidity constraints could arise.": False, "We may not have sufficient liquidity.": True, "Liquidity is fine.": False}
    got = [r.x for r in sents(spark, *liquid).orderBy("doc_id").select(validate.liquidity_stands(F.col("text")).alias("x")).collect()]
    assert got == list(liquid.values())


def table_of(spark, text, profile, names=None):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = profiles.rating_rows(docs, profile, names).orderBy("start").collect()
    assert all(text[r.start : r.end].startswith(text.split("\n")[r.n]) for r in found)
    return [(r.agency, r.label, r.outlook, r.watch, r.as_of, r.skip) for r in found]


def test_current_ratings_table(spark):
    text = "S&P | Short term | Long term\nAcme | A-2 | BBB+ | stable\nFitch | Long term | Short term\nOther | BBB | F2\nMoody's | Long term | Short term\nACME | Baa2\n| P-2\n| x\n| negative\nDBRS | Short-term | Long-term\nAcme | R-1\nFitch | Long-Term\nMoody's | Long-Term\n | Baa1"
    assert table_of(spark, text, "current", ["Acme"]) == [
        ("SP", "BBB+", "stable", "none", None, None), ("FITCH", None, None, None, None, "entity_mismatch"), ("MOODYS", "Baa2", "negative", "none", None, None), ("DBRS", None, None, None, None, "no_long_term_label"),
    ]
    assert [r[5] for r in table_of(spark, text, "current")] == [None, None, None, "no_long_term_label"]  # no names: any entity


def test_ratings_table_as_of(spark):
    """Split rows, footnotes, a header that names the long term last, a heading inside the wait, one row too many."""
    day = dt.date(2024, 6, 30)
    text = "Our RATINGS as of June 30, 2024:\na\nAgency | Short Term | Long Term\nRatings as of May 1, 2020\nS&P(1) | A-2 | BBB+ | CreditWatch Negative\nMoody's*\n | P-2 | Baa2 | x | Stable\nFitch | F2\nend\nFitch | BBB"
    assert table_of(spark, text, "as_of") == [("SP", "BBB+", None, "negative", day, None), ("MOODYS", "Baa2", "stable", "none", day, None), ("FITCH", None, None, None, None, "no_long_term_label")]
    nine = "rating as of June 30, 2024\n" + "\n".join(["Fitch | bbb-"] * 9)
    assert [r[1] for r in table_of(spark, nine, "as_of")] == ["BBB-"] * 8
    for none in ("rating as of 2024-06-30\nFitch | BBB", "rating as of June 31, 2024\nFitch | BBB", "rating as of June 30, 2024\na\nb\nc\nd\nFitch | BBB", "as of June 30, 2024\nFitch | BBB", "rating as of Jun 30, 2024\nFitch | BBB"):
        assert table_of(spark, none, "as_of") == []
    late = "rating as of June 30, 2024\na\nb\nc\nFitch | BBB\nrating as of May 5, 2023\nFitch | A"
    assert [(r[1], r[4]) for r in table_of(spark, late, "as_of")] == [("BBB", day), ("A", dt.date(2023, 5, 5))]


def test_ratings_table_dated(spark):
    text = "Fitch\nRating | Date\n5 March 2024 | A | A- | positive\nDec. 17, 2022 | NR\n1 May 2021 (x) | B\n1 May 2020 | B\nS&P\nLabel | Day\n1 May 2020 | B\nS&P\nx\nDate | Rating\n1 May 2020 | B"
    assert table_of(spark, text, "dated") == [("FITCH", "A", "positive", "none", dt.date(2024, 3, 5), None), ("FITCH", None, None, None, None, "no_long_term_label")]


def test_leverage_raises_a_priority(spark):
    rows = [(1, "I", "SP", 5, 6, None, "none", DAY, "downgrade"), (2, "J", "SP", 5, 6, None, "none", DAY, "downgrade"), (3, "I", "SP", 6, 5, None, "none", DAY, "upgrade")]
    based = rules.decide_base(rules.guidance_inputs(rules.with_state(rules.shaped(spark.createDataFrame(rows, EVENT), "rating"), spark.createDataFrame([], CAND))))
    known = spark.createDataFrame([("I", DAY - dt.timedelta(9), 2.0), ("I", DAY, 4.6), ("I", DAY + dt.timedelta(1), 1.0), ("J", DAY, 4.5)], "issuer_id string, as_of date, leverage double")
    got = {r.event_key: (r.priority, list(r.applied)) for r in rules.decide(based, known).collect()}
    assert got == {1: ("P1", ["RAT-05", "MOD-03"]), 2: ("P2", ["RAT-05"]), 3: ("P3", ["RAT-09"])}


def test_declared_charset_and_dropped_header(spark):
    from bondsight.sources import tables

    raw = [(1, "é".encode()), (2, b"<meta charset=iso-8859-1>\xe9"), (3, b"\x80 \xe9"), (4, b'<meta charset="nonsense">\xe9')]
    got = {r.k: r.t for r in spark.createDataFrame(raw, "k int, b binary").select("k", tables.decoded(F.col("b")).alias("t")).collect()}
    assert got == {1: "é", 2: "<meta charset=iso-8859-1>é", 3: "€ é", 4: '<meta charset="nonsense">é'}
    page = "<header><h1>Name</h1><nav><a>x</a></nav>more</header><p>Text</p><header>Kept</header>"
    assert tf.html_lines(page, True) == "Text\nKept" and tf.html_lines(page, False) == "Name\nx\nmore\nText\nKept"


def test_segments(spark):
    from bondsight.operators import validate

    rows = [(1, "I", "Capex Chemicals", "x"), (2, "I", "Capex", "Capex for the Chemicals Europe fell"), (3, "I", "Capex", "Energy's ratio fell"), (4, "I", "Capex", "The energy business"), (5, "I", "Capex", "Group capex, not energy, fell"), (6, "J", "Energy", "Energy"), (7, "I", None, None)]
    segments = spark.createDataFrame([("I", s) for s in ("Chemicals", "Chemicals Europe", "Energy")], "issuer_id string, segment string")
    got = {r.id: r.segment for r in validate.segment_named(spark.createDataFrame(rows, "id int, issuer_id string, label string, quote string"), segments).collect()}
    assert got == {1: "Chemicals", 2: "Chemicals Europe", 3: "Energy", 4: "Energy", 5: None, 6: None, 7: None}


def test_longest_common_subsequence():
    import random

    from bondsight.operators.validate import best_window, common_length, places_of

    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert common_length(places_of(a), len(a), b) == row[-1]
    assert best_window("the quick brown fox", "so: the quikc brown fox ran")[1] == 4


def test_queries_read_whole_texts(spark):
    from bondsight.plans import reading as corpus

    body = "S&P Global Ratings said so.\nA breach of the leverage covenant was reported on 17-Dec-2022.\nResults were in line with market expectations."
    docs = spark.createDataFrame([(11, body, "Results were in line with market expectations.", dt.date(2024, 9, 1))], "doc_id long, text string, added string, published date")
    load = lambda name: docs
    assert [r.agency for r in corpus.agency_mentions(load).collect()] == ["SP"]
    assert [r.status for r in corpus.covenant_status(load).collect()] == ["breached"]
    assert [str(r.latest) for r in corpus.latest_reference(load).collect()] == ["2022-12-17"]
    assert [r.historical for r in corpus.historical(load).collect()] == [True]


def test_fuzzy_spans_of_every_document(spark):
    from bondsight.plans import more

    line = "Results were in line with market expectations."
    docs = spark.createDataFrame([(k, f"before\n{line}", line) for k in (1, 5, 18)], "doc_id long, text string, added string")
    assert sorted((r.doc_id, r.match) for r in more.span_fuzzy(lambda name: docs).collect()) == [(1, "fuzzy"), (5, "none"), (18, "fuzzy")]  # the second is told with two signs for one


def test_greedy_of_a_hot_key(spark):
    """D-03 against a plain fold: many events a day, days without gaps, null days and null keys."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", None]), rng.choice([None, *(dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(30))])) for i in range(400)]
    anchors, want = {}, {}
    for i, key, day in rows:
        own = anchors.setdefault(key, [])
        near = next((a for a, d in own if (d is None and day is None) or (d and day and abs((d - day).days) <= 2)), None)
        if near is None:
            own.append((i, day))
        want[i] = i if near is None else near
    got = dedup.greedy(spark.createDataFrame(rows, "seq long, key string, day date"), ["key"], "day", "seq").collect()
    assert {r.seq: r.anchor for r in got} == want and len(got) == 400
