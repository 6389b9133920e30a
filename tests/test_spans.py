"""Quotes and aliases in texts against plain searches."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bondsight.operators import corpus, validate


def ratio(a, b):
    """100 * 2 * common / (both lengths), by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


def every_window(quote, text):
    if len(quote) > len(text):
        score, *_ = every_window(text, quote)
        return (score, 0, len(text)) if score else (0.0, -1, -1)
    m, n = len(quote), len(text)
    spans = {(s, s + m) for s in range(n - m + 1)} | {(0, k) for k in range(1, m)} | {(n - k, n) for k in range(1, m)}
    score, s, e = max((ratio(quote, text[s:e]), -s, e) for s, e in spans)
    return (score, -s, e) if score >= 90 else (0.0, -1, -1)


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_best_window_equals_all_windows(data):
    """Quotes of 10 to 60 signs, edited within and beyond what passes, at the ends of the text and inside it."""
    signs = data.draw(st.sampled_from(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzé 😀"]))
    quote = data.draw(st.text(signs, min_size=10, max_size=60))
    told = list(quote)
    for _ in range(data.draw(st.integers(0, len(quote) // 6))):
        at = data.draw(st.integers(0, max(0, len(told) - 1)))
        told[at : at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "#", "a"]))
    text = data.draw(st.text(signs, max_size=40)) + "".join(told) + data.draw(st.text(signs, max_size=40))
    text = text[data.draw(st.sampled_from([0, 0, 3])) :]
    if text:
        assert validate.best_window(quote, text) == every_window(quote, text)


def test_long_quotes_and_changed_signs():
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    for size in (10, 30, 100, 300):
        start = rng.randrange(3000)
        quote = list(base[start : start + size])
        for k in rng.sample(range(size), size // 10):
            quote[k] = "#"
        score, s, e = validate.best_window("".join(quote), base)
        assert score >= 90 and (s, e) == (start, start + size)
    quote = "abcdefg#ijklmno#qrstuvw#yzabcd"
    assert validate.best_window(quote, "xx abcdefghijklmnopqrstuvwxyzabcd yy")[:2] == (90.0, 3)


def test_fuzzy_spans(spark):
    docs = spark.createDataFrame([(1, "The board withdrew its outlook for fiscal 2024."), (2, "short"), (3, None), (4, "")], "doc_id long, text string")
    quotes = [(1, 0, "withdrew its outlook"), (1, 1, "withdrew its oudlook"), (1, 2, "nothing like it here"), (2, 0, "a short one that is longer"), (2, 1, "shorts"), (3, 0, "x"), (4, 0, "x"), (1, 3, None)]
    got = {(r.doc_id, r.k): (r.match, r.start, r.end) for r in validate.fuzzy_spans(spark.createDataFrame(quotes, "doc_id long, k long, quote string"), docs).collect()}
    assert got == {(1, 0): ("fuzzy", 10, 30), (1, 1): ("fuzzy", 10, 30), (1, 2): ("none", None, None), (2, 0): ("fuzzy", 0, 5), (2, 1): ("fuzzy", 0, 5), (3, 0): ("none", None, None), (4, 0): ("none", None, None), (1, 3): ("none", None, None)}


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_aliases_in_heads(spark, most):
    """Several aliases an issuer, one inside another, bounds of letters and figures only; blocks of one alias too."""
    docs = [(1, "ACME Holdings, é Acme"), (2, "acmeholdings Delta_Energy"), (3, "x" * 2990 + " Delta Energy"), (4, "Éacmeé and DELTA"), (5, None), (6, "delta energy n.v. and Acme"), (7, "beta")]
    aliases = [("A", "Acme"), ("A", "ACME Holdings"), ("D", "Delta Energy N.V."), ("D", "delta"), ("B", "Beta"), ("C", "beta "), ("D", ""), ("D", None)]
    a = spark.createDataFrame(aliases, "issuer_id string, alias string")
    got = {(r.doc_id, r.issuer_id, r.alias) for r in corpus.alias_hits(spark.createDataFrame(docs, "doc_id long, text string"), a, 3000, most).collect()}
    assert got == {(1, "A", "acme"), (1, "A", "acme holdings"), (2, "D", "delta"), (3, "D", "delta"), (4, "A", "acme"), (4, "D", "delta"), (6, "D", "delta energy n.v."), (6, "D", "delta"), (6, "A", "acme"), (7, "B", "beta"), (7, "C", "beta")}
    one = {r.doc_id: (r.alias_issuer, r.ambiguous, r.longest) for r in corpus.resolve_alias(spark.createDataFrame(docs, "doc_id long, text string"), a).collect()}
    assert one == {1: ("A", False, "acme holdings"), 2: ("D", False, "delta"), 3: ("D", False, "delta"), 4: (None, True, "delta"), 6: (None, True, "delta energy n.v."), 7: (None, True, "beta")}
    titled = spark.createDataFrame([(1, "Beta plc", "none")], "doc_id long, title string, text string")
    assert corpus.alias_hits(titled, a).count() == 2
