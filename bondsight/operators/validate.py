"""Statements against source text beyond equality: fuzzy spans, topic, segment, voice; and readings of risk sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondsight.functions import wording as w
from bondsight.functions.wording import RESOLUTIONS
from bondsight.operators.shares import held, shares

# Words by which a label fits a metric; who speaks for itself.
METRIC_WORDS = {"revenue": "revenue|revenues|sales|turnover", "ebitda": "ebitda", "ebit": "ebit|operating result|operating profit|operating income", "fcf": "free cash flow|net cash flow|cash flow", "margin": "margin|return on sales"}
#: Tenths of a quote and its place together that must be common; signs of a piece.
COMMON, GRAM = 9, 3


def places_of(quote: str) -> dict[str, int]:
    """Of each sign the places in the quote, as the bits of one integer."""
    out: dict[str, int] = {}
    for i, x in enumerate(quote):
        out[x] = out.get(x, 0) | 1 << i
    return out


def common_length(places: dict[str, int], size: int, window: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one integer."""
    row = whole = (1 << size) - 1
    for y in window:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & whole
    return size - row.bit_count()


def pieces(text: str) -> np.ndarray:
    """A number for each GRAM signs that follow each other, equal for equal signs only."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:] if len(points) >= GRAM else points[:0]


def candidate_windows(quote: str, text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every window that can pass: of the quote's length, or shorter at either end of the text.

    A window that passes differs by at most (both lengths) / 10 signs put in or taken out; each of those spoils at most
    GRAM of the quote's pieces, and the others stand in the window. Windows that hold fewer of them are left out, and
    nothing is lost.
    """
    m, n = len(quote), len(text)
    here = np.concatenate([[0], np.cumsum(np.isin(pieces(text), pieces(quote)))])
    held = lambda start, end: here[np.maximum(end - GRAM + 1, start).clip(0, len(here) - 1)] - here[np.minimum(start, len(here) - 1)]
    starts = np.arange(n - m + 1)
    for s in starts[held(starts, starts + m) >= m - GRAM + 1 - GRAM * (2 * m // 10)]:
        yield int(s), int(s) + m
    sizes = np.arange(-(-COMMON * m // (20 - COMMON)), m)  # shorter ones can't have enough in common
    for starts in (sizes * 0, n - sizes):
        ok = held(starts, starts + sizes) >= m - GRAM + 1 - GRAM * ((m + sizes) // 10)
        for s, size in zip(starts[ok], sizes[ok], strict=True):
            yield int(s), int(s + size)


def best_window(quote: str, text: str) -> tuple[float, int, int]:
    """The best partial ratio of a quote in a text, 100 * 2 * common / (both lengths), with the window's start and end
    (ties: the first, then the longest); (0, -1, -1) if no window has nine tenths in common. A text shorter than its quote
    is looked for in the quote, and its place is all of it."""
    if len(quote) > len(text):
        return (found[0], 0, len(text)) if (found := best_window(text, quote))[0] else found
    places, best = places_of(quote), (0.0, -1, -1)
    seen, from_, to = 0, 0, 0  # the last window that was compared; another has at most one sign more in common for each sign outside it
    for s, e in candidate_windows(quote, text):
        both = len(quote) + e - s
        most = min(len(quote), seen + (e - s) - max(0, min(e, to) - max(s, from_)))
        if 20 * most < COMMON * both or (200.0 * most / both, -s, e) <= (best[0], -best[1], best[2]):
            continue
        seen, from_, to = common_length(places, len(quote), text[s:e]), s, e
        if 20 * seen >= COMMON * both and (score := 200.0 * seen / both, -s, e) > (best[0], -best[1], best[2]):
            best = (score, s, e)
    return best


def fuzzy_spans(residue: DataFrame, docs: DataFrame) -> DataFrame:
    """V-02: of statements (doc_id, k, quote) that no exact rule placed, the best window where one passes; null places otherwise."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shares(batches, "text"):
            pairs = zip(batch.column("quote").to_pylist(), batch.column("text").to_pylist(), strict=True)
            found = [best_window(q, t) if q and t else (0.0, -1, -1) for q, t in pairs]
            at = [[None if x[i] < 0 else x[i] for x in found] for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("k"), pa.array([x[0] for x in found], pa.float64()),
                *(pa.array(x, pa.int64()) for x in at), pa.array(["none" if x is None else "fuzzy" for x in at[0]]),
            ], names=["doc_id", "k", "score", "start", "end", "match"])

    both = held(residue.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "k", "quote", "text"))
    return both.mapInArrow(place, "doc_id long, k long, score double, start long, end long, match string")


def metric_match(label: Column, metric: Column, quote: Column) -> Column:
    """V-04: the label stands in the quote and fits the metric's words; a metric without words fits any."""
    fits = F.lit(True)
    for name, words in METRIC_WORDS.items():
        fits = fits & ((metric != name) | F.lower(label).rlike(rf"\b(?:{words})\b"))
    return F.contains(F.lower(quote), F.lower(label)) & fits


LEADS = ("for", "of", "in", "at")
#: Shares by the row's id that an issuer's rows are dealt out to, so that one issuer of most rows doesn't meet its segments in one task.
SHARES = 32


def tokens(text: Column) -> Column:
    """Lower-cased words, a possessive ending apart."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "['’][sS]\\b", " 's ")), F.lit(r"'s|[\w&]+"), F.lit(0))


def segment_named(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """V-07, J-19: the longest configured segment of the issuer that the label or quote is about; null if none.

    It is, if the label holds the segment's words, or if the quote begins with them (an article aside), has them with a
    possessive, or has them after one of LEADS (an article aside). rows: (id, issuer_id, label, quote); segments:
    (issuer_id, segment).
    """
    # words are cut before the join, once a row: behind it, the filter would cut them again at each place that it compares
    own = rows.select("id", "issuer_id", tokens(F.col("quote")).alias("q"), tokens(F.col("label")).alias("l"), F.pmod(F.xxhash64("id"), F.lit(SHARES).cast("long")).alias("_share"))
    known = segments.select("issuer_id", "segment", tokens(F.col("segment")).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("_share"))
    both = own.join(known, ["issuer_id", "_share"])
    n = F.size("s")
    at = lambda q: F.filter(F.sequence(F.lit(1), F.greatest(F.size(q) - n + 1, F.lit(1))), lambda i: F.slice(q, i, n) == F.col("s"))
    word = lambda i: F.coalesce(F.get("q", i - 1), F.lit(""))

    def about(i: Column) -> Column:
        lead = F.when(word(i - 1) == "the", i - 2).otherwise(i - 1)
        return (lead == 0) | (word(i + n) == "'s") | F.when(lead > 0, word(lead).isin(*LEADS)).otherwise(F.lit(False))

    hit = both.where((n > 0) & ((F.size(at(F.col("l"))) > 0) | F.exists(at(F.col("q")), about)))
    best = hit.groupBy("id").agg(F.max_by("segment", F.struct(F.length("segment"), "segment")).alias("segment"))
    return rows.select("id").join(best, "id", "left")


def issuer_voice(kind: Column, speaker: Column) -> Column:
    """V-08: an agency's report never carries the issuer's own statement."""
    return ~((kind == "rating_report") & (speaker == "issuer"))


def resolution_ok(resolution: Column, quote: Column) -> Column:
    """V-11: a resolution needs its word in the quote; none is always fine."""
    ok = resolution.isNull()
    for name, words in RESOLUTIONS.items():
        ok = ok | ((resolution == name) & quote.rlike(words))
    return F.coalesce(ok, F.lit(False))


def salvage(fields: dict[str, Column], quote: Column) -> Column:
    """V-11: a map of the optional fields that the quote supports; the others are dropped, not fatal."""
    pairs = F.map_from_entries(F.array(*(F.struct(F.lit(k), v) for k, v in fields.items())))
    return F.map_filter(pairs, lambda _, v: F.coalesce(F.contains(F.lower(quote), F.lower(v)), F.lit(False)))


def liquidity_stands(text: Column) -> Column:
    """V-09: whether a sentence on liquidity states a present worry: none denied within five words, no mere supposition."""
    return text.rlike(w.NOT_ENOUGH) | (text.rlike(w.WORRIED) & ~text.rlike(w.WORRY_DENIED) & ~text.rlike(w.ADVERSE) & ~text.rlike(w.before(w.MODALS[:4], w.WORRY, 4)) & ~text.rlike(w.near(w.WORRY, w.MODALS[:4], 1)))


def covenant_status(text: Column) -> Column:
    """V-10: breached if a breach is stated, neither denied nor supposed; else risk_of_breach, compliant or mentioned.

    A sentence that opens with a condition supposes, and so does a modal with nothing stated between it and the breach;
    compliance is stated in words or by a comparison with what a contract asks for.
    """
    supposed = text.rlike(w.BREACH_SUPPOSED) | text.rlike(w.DOUBT_CONDITION) | (text.rlike(w.BREACH_MODAL) & ~text.rlike(w.BREACH_STATED))
    stated = text.rlike(w.BREACHED) & ~text.rlike(w.BREACH_DENIED) & ~supposed
    complies = text.rlike(w.COMPLIANT) | (text.rlike(w.COMPARED) & text.rlike(w.CONTRACT))
    return F.when(text.rlike(w.COVENANT_TOPIC), F.when(stated, "breached").when(text.rlike(w.ANTICIPATED), "risk_of_breach").when(complies, "compliant").otherwise("mentioned"))
