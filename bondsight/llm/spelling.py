"""Operator 12, spelling variants: one-edit neighbourhoods in a reduced alphabet, joined to the reduced vocabulary.

Words are maximal runs of Latin letters, A-Z lower-cased, of `length` code points or more that occur `least` times or
more. Two are near if they differ by one code point inserted, deleted or replaced. A word's form is its near word of the
largest count (ties: the smallest in code-point order), if that is at least `ratio` times the word's own; its root is
where following forms ends.

A letter's symbol is its code point modulo the number of symbols, which is the sixth root of the vocabulary's size:
so many that words of the shortest length would meet about once. Each word's symbols are spelled with every symbol
deleted, replaced and inserted, and unchanged (a letter may stand for another of its symbol). Of these, those whose bit
is set in a bitmap of the reduced vocabulary (2 ** BITS bits whatever the data, thus broadcast) are joined to it, and
the words that meet are compared letter by letter. The bitmap spares the shuffle what would meet nobody; it loses nothing.

Null and empty texts have no words; rows that repeat count again; an empty table gives no rows; columns other than
doc_id and text are not read. Very long texts are read by the row, and only their words' counts are shuffled; a frequent
word is counted before it is. Words of any length are spelled, in batches of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondsight.llm import shared
from bondsight.llm.arrays import BASE, U, flat, inverse, mixed, powers

LENGTH, LEAST, RATIO = 6, 5, 5
BITS = 26
#: Bits of one of Spark's bitmaps.
PAGE = 32768
#: Neighbours that a task spells at a time.
AT_ONCE = 1 << 19
LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def occurrences(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, word): each run of letters of `length` or more."""
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    return shared.documents(docs).select("doc_id", F.explode(runs).alias("word")).withColumn("word", F.translate("word", UPPER, UPPER.lower()))


def vocabulary(words: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of the words that count; written, as several steps read it."""
    counts = words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return shared.settle(counts.where(F.col("n") >= least))


def _reduced(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: the words' numbers, and their symbols + 1, one row each."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words.to_pylist()), np.int64, len(words))
    begin = np.cumsum(size) - size
    for n in np.unique(size):
        who = np.flatnonzero(size == n)
        for part in np.array_split(who, int(len(who) * 2 * n * (symbols + 1) / AT_ONCE) + 1):
            yield part, (points[begin[part][:, None] + np.arange(n)] % symbols + 1).astype(U)


def _hash(sums: np.ndarray, size: int) -> np.ndarray:
    return mixed(sums ^ U(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def _keyed(symbols: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(len(batch), U)
            for who, s in _reduced(batch.column("word"), symbols):
                keys[who] = _hash((s * powers(BASE, s.shape[1])).sum(1, dtype=U), s.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(keys.view(np.int64))], names=["word", "n", "key"])

    return keyed


def neighbourhood(s: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of each row's symbols unchanged and with one deleted, replaced and inserted; a row may name a hash twice."""
    m, n = s.shape
    power, back = powers(BASE, n + 1), U(inverse(BASE))
    terms, new = s * power[:n], np.arange(1, symbols + 1, dtype=U)
    upto = np.concatenate([np.zeros((m, 1), U), np.cumsum(terms, 1, dtype=U)], 1)
    total, rest = upto[:, -1:], upto[:, -1:] - upto
    deleted = _hash(upto[:, :-1] + rest[:, 1:] * back, n - 1)
    replaced = _hash((total - terms)[:, :, None] + new * power[:n, None], n)  # its own symbol among them: unchanged
    inserted = _hash((upto + rest * U(BASE))[:, :, None] + new * power[:, None], n + 1)
    return np.concatenate([deleted, replaced.reshape(m, -1), inserted.reshape(m, -1)], 1)


def _spelled(symbols: int, bitmap, bits: int):
    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = bitmap.value
        for batch in batches:
            for who, s in _reduced(batch.column("word"), symbols):
                keys = np.sort(neighbourhood(s, symbols), 1)
                bit = (keys & U((1 << bits) - 1)).astype(np.int64)
                ask = is_set[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0
                ask[:, 1:] &= keys[:, 1:] != keys[:, :-1]
                row, at = np.nonzero(ask)
                some = batch.take(pa.array(who[row]))
                yield pa.RecordBatch.from_arrays([some.column("word"), pa.array(keys[row, at].view(np.int64))], names=["word", "key"])

    return spelled


def bitmap_of(keys: DataFrame, bits: int) -> np.ndarray:
    """Which values of the keys' low bits occur, as 2 ** bits bits: at most 2 ** bits / 32768 rows come to the driver."""
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    page = F.shiftright(low, 15)
    out = np.zeros(max(1 << bits, PAGE) >> 3, np.uint8)
    for p, bitmap in keys.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(low.bitwiseAND(PAGE - 1))).toLocalIterator():
        out[p * PAGE // 8 : (p + 1) * PAGE // 8] = np.frombuffer(bitmap, np.uint8)
    return out


def near_pairs(counts: DataFrame, bits: int = BITS, symbols: int | None = None) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words. counts: (word, n), each word once."""
    spark = shared.session(counts)
    symbols = symbols or max(3, round(counts.count() ** (1 / 6)))
    keyed = shared.settle(counts.mapInArrow(_keyed(symbols), "word string, n long, key long"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(keyed, bits))
    asked = keyed.repartition(F.col("word")).mapInArrow(_spelled(symbols, bitmap, bits), "word string, key long")
    met = asked.join(keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key"), "key")
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round doubles how far a chain is followed.

    A form's count is `ratio` times its word's, so that chains are short: 27 links at most for a ratio of 5 and any count of 64 bits.
    """
    spark, old = forms.sparkSession, shared.shared_dir(forms.sparkSession)
    found = shared.settle(forms.select("word", F.col("form").alias("root")), old)
    while True:
        path = shared.shared_dir(spark)
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = shared.settle(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), path)
        shared.forget(spark, old)
        found, old = moved.select("word", "root"), path
        if not moved.where("moved").limit(1).count():
            return found


def group_variants(counts: DataFrame, ratio: int = RATIO, bits: int = BITS, symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of counts (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_pairs(counts, bits, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best)
    both = counts.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))
    large = F.col("form_n") >= ratio * F.col("n")
    both = shared.settle(both.withColumns({"form": F.when(large, F.col("form")), "form_n": F.when(large, F.col("form_n"))}))
    root = roots(both.where("form IS NOT NULL"))
    return both.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
