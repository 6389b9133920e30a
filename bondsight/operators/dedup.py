"""Exact and greedy deduplication, merges, and idempotent application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_hash(docs: DataFrame, content: str, *order: Column) -> DataFrame:
    """D-01: docs with `duplicate_of`: null for the earliest row of a content, else that row's doc_id.

    A content's earliest row is found by aggregation and joined back, so that a content held by very many rows is
    never gathered.
    """
    hashed = docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("doc_id").alias("first_id"))).alias("f")).select("content_hash", "f.first_id")
    out = hashed.join(first, "content_hash")
    return out.withColumn("duplicate_of", F.when(F.col("doc_id") != F.col("first_id"), F.col("first_id"))).drop("first_id")


def greedy(events: DataFrame, keys: list[str], day: str, order: str, window: int = 2) -> DataFrame:
    """D-03: in arrival order, an event joins the first anchor with equal keys (null equals null) at most `window` days
    away, or becomes an anchor. Adds `anchor`, the order value of its anchor.

    Of the events of one day only the first can become an anchor, and the others share its anchor; so events are first
    aggregated to one row a key and day, however many there are. Days more than the window apart can't meet, so a key's
    days are cut into chains of near ones, and a chain, as long as the calendar at most, is folded as one array. Events
    without a day join the first such event of their key.
    """
    number = (F.unix_date(F.col(day)) if dict(events.dtypes)[day] == "date" else F.col(day)).cast("int")
    firsts = events.groupBy(*keys, number.alias("_day")).agg(F.min(order).cast("long").alias("_first"))
    by = Window.partitionBy(*keys).orderBy(F.col("_day").asc_nulls_first())
    cut = F.coalesce((F.col("_day") - F.lag("_day").over(by) > window).cast("int"), F.lit(1))
    chained = firsts.withColumn("_cut", cut).withColumn("_chain", F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    groups = chained.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(F.struct(F.col("_first").alias("o"), F.col("_day").alias("d")))).alias("_all"))
    near = lambda x: lambda a: F.coalesce(F.abs(a["d"] - x["d"]) <= window, F.lit(True))  # noqa: E731  a day that is null stands alone
    empty = F.filter("_all", lambda x: F.lit(False))
    anchors = F.aggregate("_all", empty, lambda acc, x: F.when(F.exists(acc, near(x)), acc).otherwise(F.concat(acc, F.array(x))))
    each = groups.withColumn("_anchors", anchors).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.explode("_all").alias("_x"), "_anchors")
    placed = each.select(*(f"_k{i}" for i in range(len(keys))), F.col("_x.d").alias("_d"), F.filter("_anchors", near(F.col("_x")))[0]["o"].alias("anchor"))
    same = number.eqNullSafe(F.col("_d"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return events.join(placed, same).drop("_d", *(f"_k{i}" for i in range(len(keys))))


def merged_sources(placed: DataFrame, source: str) -> DataFrame:
    """D-04: each anchor's distinct sources, sorted."""
    return placed.groupBy("anchor").agg(F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("n"))


def richest(rows: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """D-02: of rows with one key the one with most fields set, first among equals; its nulls filled from the next ones."""
    n = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    rank = F.struct(-n, F.col(order))
    fill = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fields]
    return rows.groupBy(key).agg(F.min_by(order, rank).alias(order), *fill, F.count("*").alias("merged"))


def one_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """D-05, D-06, D-07: the first row of each key, by aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).alias(c) for c in rest]))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def conflicts(statements: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """D-08: keys whose rows don't agree on the values, rounded to six digits."""
    rounded = F.struct(*(F.round(F.col(v).cast("double"), 6).alias(v) if dict(statements.dtypes)[v] in ("double", "float") else F.col(v) for v in values))
    return statements.groupBy(*keys).agg(F.count_distinct(F.to_json(rounded, {"ignoreNullFields": "false"})).alias("readings"), F.count("*").alias("n")).withColumn("conflict", F.col("readings") > 1)


def apply_once(new: DataFrame, applied: DataFrame) -> DataFrame:
    """D-09: `status` of each enrichment (enrichment_id, event_key, payload_hash): seen by id, the same payload again, or applied."""
    by_id = applied.select(F.col("enrichment_id").alias("_i")).distinct()
    by_payload = applied.select(F.col("event_key").alias("_e"), F.col("payload_hash").alias("_p")).distinct()
    out = new.join(by_id, F.col("enrichment_id") == F.col("_i"), "left").join(by_payload, (F.col("event_key") == F.col("_e")) & (F.col("payload_hash") == F.col("_p")), "left")
    status = F.when(F.col("_i").isNotNull(), "already_applied").when(F.col("_e").isNotNull(), "unchanged").otherwise("applied")
    return out.withColumn("status", status).drop("_i", "_e", "_p")
