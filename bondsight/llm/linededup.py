"""Operator 13, line dedup: hashed lines range-partitioned, sorted by document and position within, bitmaps returned.

A text is split at line feeds; a line's key is the line without the white space at its ends, A-Z lower-cased. A key of
one code point or more that is found in `least` documents or more loses its lines: all of them, or with keep_first all
but the first by document and position (nulls first). What comes back to a document is no text but its keep bitmap,
compressed to the line numbers at which the bit flips, first to 0; a document that keeps all lines has none.

Documents are told apart by doc_id where they are counted, null being one id; a bitmap belongs to an id and a text, so
rows that repeat both share it, and are counted once. Null and empty texts are one empty line, which is never dropped;
so are blank lines. An empty table gives no rows; columns other than doc_id and text are not read. A very long text is
one row of its lines' hashes each, and only its own task holds its text. A key is known by 96 bits of two hashes.

Keys with at least 1 / HOT of all lines can't be more than HOT: they are found by counting, first in ranges of hashes
and then by key inside the ranges that hold so many, and are counted by document before they meet. Only the others are
sorted, so that no task gets more than 1 / HOT of the lines for the sake of one key. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bondsight.llm import shared

LEAST = 10
HOT, RANGE_BITS = 4096, 16
#: Bytes of a line's row (hashes, document, position).
ROW = 36
EDGES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ("h", "g")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(EDGES)), UPPER, UPPER.lower())


def hashed(docs: DataFrame) -> DataFrame:
    """(h, g, doc_id, text_hash, pos): one row for each line that has a key."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("key", key(F.col("line"))).where("key != ''")
    return rows.select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "doc_id", "text_hash", "pos")


def hot_keys(rows: DataFrame, total: int, hot: int) -> DataFrame:
    """(h, g, n_docs, at): at most `hot` keys, those with total / hot rows or more; at: the first place."""
    span = F.shiftrightunsigned("h", 64 - RANGE_BITS).alias("span")
    heavy = rows.groupBy(span).count().where(F.col("count") >= total / hot).select("span")
    inside = rows.withColumn("span", span).join(F.broadcast(heavy), "span", "left_semi")
    by_doc = inside.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n"), F.min(F.struct("text_hash", "pos")).alias("at"))
    by_key = by_doc.groupBy(*KEY).agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "at.text_hash", "at.pos")).alias("at"))
    return shared.settle(by_key.where(F.col("n") >= total / hot).drop("n"))


def streamed(rows: DataFrame, ranges: int) -> DataFrame:
    """The rows with n_docs, the documents of their key, and first; one shuffle by ranges of hashes and one sort."""
    in_order = Window.partitionBy(*KEY).orderBy("doc_id", "text_hash", "pos")
    rows = rows.repartitionByRange(ranges, "h").withColumn("first", F.row_number().over(in_order) == 1)
    other = F.col("first") | ~F.lag("doc_id").over(in_order).eqNullSafe(F.col("doc_id"))
    return rows.withColumn("other", other.cast("int")).withColumn("n_docs", F.sum("other").over(Window.partitionBy(*KEY)))


def flips(dropped: Column) -> Column:
    """Sorted line numbers to the bitmap: where a stretch of them begins and where it ends, in turn."""
    begin = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    end = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))
    return F.flatten(F.zip_with(begin, end, lambda a, b: F.array(a, b + 1)))


def keep_bitmaps(docs: DataFrame, least: int = LEAST, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, bitmap) of the documents that lose lines. bitmap: ascending line numbers where the bit flips."""
    rows = shared.settle(hashed(shared.documents(docs)))
    total = rows.count()
    frequent = hot_keys(rows, total, hot)
    ranges = shared.bucket_count(rows, total * ROW)
    bound = F.broadcast(frequent)  # at most `hot` rows
    rest = streamed(rows.join(bound, [*KEY], "left_anti"), ranges)
    known = rows.join(bound, [*KEY]).withColumn("first", F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("at")))
    gone = [x.where(F.col("n_docs") >= least).where(~F.col("first") if keep_first else F.lit(True)).select("doc_id", "text_hash", "pos") for x in (rest, known)]
    by_doc = gone[0].unionByName(gone[1]).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return by_doc.select("doc_id", "text_hash", flips(F.col("dropped")).alias("bitmap"))


def kept_lines(of: Column, bitmap: Column) -> Column:
    """The lines that a bitmap keeps; all where it is null."""
    until = lambda i: F.coalesce(F.get(bitmap, i + 1), F.size(of)) - F.get(bitmap, i)
    parts = F.transform(F.sequence(F.lit(1), F.size(bitmap) - 1, F.lit(2)), lambda i: F.slice(of, F.get(bitmap, i) + 1, until(i)))
    return F.when(bitmap.isNull(), of).otherwise(F.concat(F.slice(of, F.lit(1), F.get(bitmap, F.lit(0))), F.flatten(parts)))


def drop_lines(docs: DataFrame, least: int = LEAST, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, bitmap (null: nothing goes) and the kept text."""
    found = keep_bitmaps(docs, least, keep_first, hot).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "bitmap")
    rows = shared.documents(docs).withColumn("text_hash", F.xxhash64("text"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    both = both.select("doc_id", "bitmap", lines(F.col("text")).alias("lines"))
    dropped = F.aggregate(F.transform("bitmap", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    return both.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"), "bitmap",
        F.array_join(kept_lines(F.col("lines"), F.col("bitmap")), "\n").alias("kept"),
    )
