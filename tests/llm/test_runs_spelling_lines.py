"""Operators 11 to 13 against brute force; and on nulls, blanks, ties, repeats, long texts, clashing columns and no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bondsight.llm import linededup, periods, queries, spelling
from tests.llm.conftest import SCHEMA, rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def all_runs(w, least=6, exponent=4):
    """By every period: maximal stretches of words that equal the word q on; of one stretch the smallest period counts."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end > at and end + q - at >= max(least, exponent * q):
                found.setdefault((at, end + q), q)
            at = end + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def expected(doc_id, text):
    w = SPACE.findall(text or "")
    found = all_runs(w)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    milli = best[2] and 1000 * best[1] // best[2]
    return doc_id, len(w), len(found), *best, milli, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.integers(2, 5))
def test_runs_of_small_alphabets(texts, exponent):
    first = np.cumsum([0, *map(len, texts)])
    codes = np.array([3 * k + x for k, t in enumerate(texts) for x in t], np.int64)
    a, b, q = periods.runs_of(codes, first, 2, exponent)
    want = [(s + first[k], n, p) for k, t in enumerate(texts) for s, n, p in all_runs(t, 2, exponent)]
    assert list(zip(a.tolist(), (b - a).tolist(), q.tolist(), strict=True)) == want


def test_periodic_runs(spark, docs, none):
    rng = random.Random(5)
    made = []
    for k in range(80):
        w = [rng.choice("abc") if k % 2 else f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 120))]
        for _ in range(k % 4):
            cut, unit = rng.randint(0, len(w)), [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            w[cut:cut] = (unit * 9)[: rng.randint(1, 9 * len(unit))]
        made.append((k, (" ", "\n", " \t")[k % 3].join(w)))
    data = [r[:2] for r in rows()] + made
    some = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    found = periods.find_runs(some).collect()
    got = Counter(tuple(r)[:9] for r in found)
    assert got == Counter(expected(*r) for r in data)
    for r in found:
        assert sha(r.collapsed) == r.collapsed_sha256 and len(r.runs) == r.n_runs
    assert max(r.n_runs for r in found) > 2 and periods.find_runs(none).count() == 0


def test_runs_of_a_text_above_two_megabytes(spark):
    """A third of the words is one word, another third repeats a passage of 5,000 words."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(5000)]
    w = ["a"] * 100_000 + [word() for _ in range(100_000)] + passage * 20 + ["end"]
    row = periods.find_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert len(" ".join(w)) > 1 << 21 or row.n_words == len(w)
    assert {(r.start, r.length, r.period) for r in row.runs} >= {(0, 100_000, 1), (200_000, 100_000, 5000)} and (row.start, row.length, row.period) == (0, 100_000, 1)
    assert row.exponent_milli == 100_000_000 and len(row.collapsed.split()) == len(w) - 99_999 - 95_000 - sum(r.length - r.period for r in row.runs if r.period not in (1, 5000))


def test_query_makes_texts_periodic(spark, docs):
    """The query's words by the contract: from word g % n on, words repeat with period p."""
    got = Counter((r.doc_id, tuple(SPACE.findall(r.text or ""))) for r in queries.periodic(docs).collect())
    want = Counter()
    for i, text, *_ in rows():
        w, h = SPACE.findall(text or ""), zlib.crc32(b"" if i is None else str(i).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        want[(i, tuple(w))] += 1
    assert got == want and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows() if r[0] is not None)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = max(a, b, key=len), min(a, b, key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(counts):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    around = {w: [x for x in counts if near(w, x)] for w in counts}
    best = {w: min(around[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= 5 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(around[w]), form[w] and counts[form[w]]) for w in counts}


@pytest.mark.parametrize(("bits", "symbols"), [(26, None), (15, 3), (20, 9)])
def test_variants_equal_all_pairs(spark, bits, symbols):
    """Chains of misspellings, accents, ties and words that end in letters of the sign range; few bits and few symbols too."""
    rng = random.Random(7)
    counts = {"abcdef": 20_000, "abcdeg": 3_000, "abcdhg": 500, "abcihg": 80, "abjihg": 12, "éabcdef": 5, "abcdefÿ": 5, "abcdef×": 5, "aaaaaa": 40, "aaaaaaa": 8, "aaaaaaaa": 1000}
    for _ in range(300):
        w = list(rng.choice(list(counts)) if rng.random() < 0.7 else "".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(6, 11))))
        at = rng.randrange(len(w))
        w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "b", "à"])
        if len(w) >= 6:
            counts.setdefault("".join(w), rng.choice([5, 5, 6, 30, 31, 200]))
    got = {tuple(r) for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), 5, bits, symbols).collect()}
    assert got == variants(counts)
    assert sum(r[1] is not None for r in got) > 30 and max(r[4] for r in got) > 5


def test_spelling_query_counts(spark, docs, none):
    """From rows to counts: nulls, repeats, clashing columns, long texts, one letter of each 199th word deleted."""
    made = [(k, "Zebrafish zebraFISH; Éclairs-éclairs naïveté " + "zebrafishes " * (k % 9), "x", "y", 1, "w", "h", "n", "k") for k in range(700)]
    long = [(9_999, "Schmetterling " * 200_000, None, None, None, None, None, None, None)]
    every = [*rows(), *made, *long]
    counts = Counter()
    for i, text, *_ in every:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    some = docs.union(spark.createDataFrame([*made, *long], SCHEMA))
    words = queries.misspelt(spelling.occurrences(some))
    got = {r.word: r.n for r in spelling.vocabulary(words).collect()}
    assert got == want and {"zebrafish", "Éclairs", "éclairs"} <= set(got)
    assert {tuple(r) for r in spelling.group_variants(spelling.vocabulary(words)).collect()} == variants(want)
    assert spelling.group_variants(spelling.vocabulary(spelling.occurrences(none))).count() == 0


LINES = ["Common line", "  common LINE\t", "COMMON line\r", "", "   ", "rare", "Ünique", "tail\x0b"]


def line_rows(seed=8):
    rng = random.Random(seed)
    texts = [None, "", "\n", "\n\n", "Common line", "common line\n", "\nCOMMON LINE\n\nrare"]
    texts += ["\n".join(rng.choice(LINES) if rng.random() < 0.4 else f"own {k} {rng.randint(0, 3)}" for _ in range(rng.randint(0, 30))) for k in range(60)]
    texts += ["common line\n" * 3000 + "rare\n" + "x" * (3 << 20)]
    out = [(i, t, "en", "s", 0, "w", "h", "n", "k") for i, t in enumerate(texts)]
    return [*out, out[9], out[9], (9, "rare\nrare", *out[0][2:]), (None, texts[8], *out[0][2:]), (None, texts[10], *out[0][2:])]


@pytest.mark.parametrize(("least", "first", "hot"), [(10, False, 4096), (10, False, 1), (2, True, 4096), (2, True, 1), (3, True, 30), (50, False, 5)])
def test_line_dedup(spark, none, least, first, hot):
    """hot=1: no key counts as hot, so that all are streamed; 4096: all are counted."""
    data = line_rows()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen, head = {}, {}
    hashes = {r._1: r.h for r in spark.createDataFrame([(i, r[1]) for i, r in enumerate(data)], "_1 int, text string").select("_1", F.xxhash64("text").alias("h")).collect()}
    for k, (i, t, *_) in enumerate(data):
        for pos, line in enumerate((t or "").split("\n")):
            if key(line):
                seen.setdefault(key(line), set()).add(i)
                place = (i is not None, i or 0, hashes[k], pos)
                head[key(line)] = min(head.get(key(line), place), place)
    want = Counter()
    for k, (i, t, *_) in enumerate(data):
        every = (t or "").split("\n")
        gone = [bool(key(x)) and len(seen[key(x)]) >= least and not (first and head[key(x)] == (i is not None, i or 0, hashes[k], pos)) for pos, x in enumerate(every)]
        flips = [pos for pos in range(len(every) + 1) if (pos < len(every) and gone[pos]) != (pos > 0 and gone[pos - 1])]
        want[(i, len(every), sum(gone), tuple(flips), sha("\n".join(x for x, g in zip(every, gone, strict=True) if not g)))] += 1
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, tuple(r.bitmap or ()), sha(r.kept)) for r in linededup.drop_lines(spark.createDataFrame(data, SCHEMA), least, first, hot).collect())
    assert got == want and sum(x[2] for x in want) > 50
    assert linededup.drop_lines(none, least, first, hot).count() == 0
