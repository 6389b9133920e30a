"""Operator 1, benchmark decontamination: a positional inverted index of the corpus, DataFrame functions only.

Words are lower-cased (A-Z only) runs of letters, digits and non-ASCII characters. The index stores a row (term,
document, position) for every place of every term, or where the items are known of every term that they hold, as places
of others can't be in a phrase of theirs; and an end for each document, whose position is its number of words. Rows are
dealt out to buckets by document once, when they are stored. A stored index of all terms serves any benchmark.

A phrase is found from its rarest term: each place of it proposes a start, the second rarest term's places, less its
offset, are intersected with those, and what is left with all other terms' places: the documents that are left go to
their buckets and meet the index there, so that it is never shuffled again, however many they are. The plan is the same
at every size, but for the items' own tables.

Phrases are windows of `size` consecutive item words; an item with fewer, but not none, is one window. Null and empty
texts have no words. A document is known by two 64-bit hashes of its id and text, so that null, repeated and extreme
ids do no harm, and equal rows of docs give equal rows. A null item_id counts as the id of an empty string. Empty tables
give no rows, or documents without hits. Other columns are not read, whatever their names. A very long
text is cut by one task, and leaves it as one row for each place of an item's term. Terms of equal frequency are taken in
the order of their hashes and offsets, which changes no result.
Items' tables are broadcast only below BROADCAST_ROWS rows, counted first; above, the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bondsight.llm import shared

SIZE = 10
BROADCAST_ROWS = 1_000_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]


def words(text: Column) -> Column:
    """lower() is the fast way where all is ASCII; elsewhere it would change other letters too."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def key() -> list[Column]:
    """The document's two hashes; neither is ever null."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.xxhash64(doc, text).alias("k1"), F.xxhash64(text, F.lit(1), doc).alias("k2")]


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS).count() < BROADCAST_ROWS else df


def item_words(items: DataFrame) -> DataFrame:
    items = shared.columns(items, item_id="string", text="string")
    return shared.settle(items.select(F.coalesce("item_id", F.lit("")).alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct())


def end() -> Column:
    """The term of a document's end: that of the empty word, which no text holds."""
    return F.xxhash64(F.lit(""))


#: Bytes of text whose places one bucket of the index holds.
BUCKET_TEXT = 12e6


def postings(docs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The stored index: (term, k1, k2, pos) of all places in docs of all words, or of those of items(words), and of the
    ends; a term is its word's hash. In buckets by k1."""
    buckets = shared.bucket_count(docs, shared.text_bytes(shared.documents(docs)), BUCKET_TEXT)
    places = shared.documents(docs).select(*key(), F.posexplode(F.array_append(words(F.col("text")), F.lit(""))).alias("pos", "word"))
    places = places.select(F.xxhash64("word").alias("term"), *KEY, "pos")
    if items is not None:
        terms = items.select(F.explode(F.array_append("words", F.lit(""))).alias("word")).select(F.xxhash64("word").alias("term"))
        ends = items.sparkSession.range(1).select(end().alias("term"))  # items may be none
        places = places.join(small(shared.settle(terms.union(ends).distinct())), "term", "left_semi")
    return shared.dealt(places.select("term", *KEY, "pos"), "k1", buckets)


def windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (win, terms) of items(item_id, words), and which items have them (win, item_id)."""
    n = F.least(F.size("words"), F.lit(size))
    at = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)))
    each = at.select("item_id", F.slice("words", F.col("at"), n).alias("terms")).distinct()
    each = shared.settle(each.withColumn("win", F.xxhash64("terms")))
    return each.select("win", "terms").distinct(), each.select("win", "item_id")


def ranked(wins: DataFrame, index: DataFrame) -> DataFrame:
    """(win, n, rank, term, off): the terms of each window from the rarest on; windows with an absent term are left out."""
    each = wins.select("win", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    counts = index.join(small(each.select("term").distinct()), "term", "left_semi").groupBy("term").count()
    each = each.join(small(shared.settle(counts)), "term", "left")
    by = Window.partitionBy("win")
    each = each.withColumn("least", F.min(F.coalesce("count", F.lit(0))).over(by)).where("least > 0")
    return shared.settle(each.select("win", "n", "term", "off", F.row_number().over(by.orderBy("count", "term", "off")).alias("rank")))


def phrases(index: DataFrame, wins: DataFrame) -> DataFrame:
    """Every exact occurrence (doc_id, text_hash, win, start, n) of the windows, by intersecting offset-adjusted lists."""
    terms = ranked(wins, index)
    first = terms.where("rank = 1").select("term", "win", "n", "off")
    starts = index.join(small(first), "term").select(*KEY, "win", "n", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    # repeated rows of docs list their places twice, hence distinct
    second = terms.where("rank = 2").select("win", F.col("term").alias("term2"), F.col("off").alias("off2"))
    more = starts.join(small(second), "win", "left").withColumn("at", F.col("start") + F.col("off2"))
    lists = index.join(small(second.select("term2").distinct()), index["term"] == F.col("term2"), "left_semi")
    met = lists.select(*KEY, F.col("term").alias("term2"), F.col("pos").alias("at"))
    two = shared.settle(more.where("n = 1").select(*KEY, "win", "n", "start").unionByName(more.where("n > 1").join(met, [*KEY, "term2", "at"]).select(*KEY, "win", "n", "start")).distinct())
    rest = two.where("n > 2").join(small(terms.where("rank > 2").select("win", "term", "off")), "win").withColumn("pos", F.col("start") + F.col("off"))
    left = two.where("n > 2").select("k1").distinct().hint("shuffle_hash")  # by k1 alone, as the index lies
    near = index.join(left, "k1", "left_semi").join(small(terms.where("rank > 2").select("term").distinct()), "term", "left_semi")
    full = rest.join(near, [*KEY, "term", "pos"]).groupBy(*KEY, "win", "n", "start").agg(F.count_distinct("pos").alias("met")).where("met = n - 2")
    return two.where("n <= 2").unionByName(full.drop("met"))


def proximity(docs: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """(doc_id, item_id, pos): places of an item's rarest word that have every other word of the item at most
    `within` words away, in any order. Items without words match nothing.
    """
    items = item_words(items)
    sets = items.select("item_id", F.array_distinct("words").alias("terms")).distinct().withColumn("win", F.xxhash64("item_id", "terms"))
    index = postings(docs, items)
    terms = ranked(sets, index)
    anchors = index.join(small(terms.where("rank = 1").select("term", "win", "n")), "term").select(*KEY, "win", "n", F.col("pos").alias("anchor"))
    others = anchors.join(small(terms.where("rank > 1").select("win", "term")), "win")
    cell = F.floor(F.col("anchor") / (within + 1))
    near = others.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    there = index.withColumn("cell", F.floor(F.col("pos") / (within + 1)))
    met = near.join(there, [*KEY, "term", "cell"]).where(F.abs(F.col("pos") - F.col("anchor")) <= within)
    full = met.select(*KEY, "win", "n", "anchor", "term").distinct().groupBy(*KEY, "win", "n", "anchor").count().where("count = n - 1").drop("count")
    found = full.unionByName(anchors.where("n = 1"))
    places = found.join(sets.select("win", "item_id"), "win").select(*KEY, "item_id", F.col("anchor").alias("pos")).distinct()
    return shared.documents(docs).select("doc_id", *key()).join(places, KEY).select("doc_id", "item_id", "pos")


def occurrences(index: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """All places (k1, k2, win, start, n) of the items' windows in the index, and which items have which window."""
    wins, of = windows(items, size)
    return shared.settle(phrases(index, wins)), of


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """docs' own columns; rows that hold a window of an item go."""
    items = item_words(items)
    found, _ = occurrences(postings(docs, items), items, size)
    gone = shared.settle(found.select(*KEY).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *key())
    return rows.join(small(gone), KEY, "left_anti").select("_row.*")


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, index: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: n_words, n_hit (words inside an occurrence), n_items, item_ids, contaminated.

    index: of postings(docs), stored before; without one, that of the items' terms is made.
    """
    items = item_words(items)
    index = postings(docs, items) if index is None else index
    found, of = occurrences(index, items, size)
    hit = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    named = found.select(*KEY, "win").distinct().join(small(of), "win").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    lengths = index.where(F.col("term") == end()).groupBy(*KEY).agg(F.max("pos").cast("long").alias("n_words"))
    out = shared.documents(docs).select("doc_id", *key()).join(lengths, KEY, "left").join(small(shared.settle(hit.join(named, KEY))), KEY, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
