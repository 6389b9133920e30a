"""Aggregates, ledgers, listings and alert rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bondsight.operators import state

#: Where alerts of a priority go and how soon.
ROUTES = [("P1", "email,webhook", "immediate"), ("P2", "email", "every 4 h"), ("P3", "email", "every 24 h")]


def unprocessed(docs: DataFrame) -> DataFrame:
    return docs.where("processed_at is null")


def alerts(decided: DataFrame, priorities: list[str], families: list[str]) -> DataFrame:
    """P-05: null priority counts as NONE."""
    return decided.withColumn("priority", F.coalesce("priority", F.lit("NONE"))).where(F.col("priority").isin(*priorities) & F.col("family").isin(*families))


def universe(tags: Column) -> Column:
    return F.when(F.array_contains(tags, "live"), "live_watchlist").when(F.array_contains(tags, "historical"), "historical_stress_case").otherwise("other")


def priority_summary(decided: DataFrame) -> DataFrame:
    """A-01: with zeros."""
    domain = decided.sparkSession.createDataFrame([("P1",), ("P2",), ("P3",), ("NONE",)], "priority string")
    counts = decided.groupBy(F.coalesce("priority", F.lit("NONE")).alias("priority")).agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "priority", "left").select("priority", F.coalesce("n", F.lit(0)).alias("n"))


def watchlist(issuers: DataFrame, decided: DataFrame) -> DataFrame:
    """A-02: P1 is the highest, and null below P3."""
    by = decided.groupBy("issuer_id").agg(F.count("*").alias("n"), F.max("eff").alias("last_event"), F.min("priority").alias("highest"))
    return issuers.join(by, "issuer_id", "left").withColumn("n_events", F.coalesce("n", F.lit(0)))


def ingest_summary(docs: DataFrame) -> DataFrame:
    n = F.count_distinct(F.sha2("text", 256))
    return docs.agg(F.count("*").alias("fetched"), n.alias("stored"), (F.count("*") - n).alias("duplicates"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()))


def latency(calls: DataFrame, by: str) -> DataFrame:
    six = lambda c, name: F.round(c, 6).alias(name)
    return calls.groupBy(by).agg(six(F.avg("latency_ms"), "mean_ms"), six(F.median("latency_ms"), "median_ms"), six(F.max("latency_ms"), "max_ms"))


def spend(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """A-09: tokens times the price a million; a call of a model without a price is left out by the join and found by its anti join."""
    p = prices.select("model", F.col("input_price").cast("double").alias("i"), F.col("output_price").cast("double").alias("o"))
    return calls.join(F.broadcast(p), "model").withColumn("cost", (F.col("input_tokens") * F.col("i") + F.col("output_tokens") * F.col("o")) / 1e6).drop("i", "o")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """C-08: one row for each row that breaks a check."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("check_name"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in checks.items()))


def drift(old: DataFrame, new: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """C-11: keys whose (order, value) pairs differ, or that only one side has.

    A key's pairs are compared by their number and two sums of independent 64-bit hashes, which partial aggregates add
    up; no key's rows are gathered.
    """
    pair = [F.col(order), F.col(value)]
    total = lambda *seed: F.sum(F.xxhash64(*seed, *pair).cast("decimal(38,0)"))
    locked = lambda df, name: df.groupBy(key).agg(F.struct(F.count("*").alias("n"), total().alias("a"), total(F.lit(1)).alias("b")).alias(name))
    return locked(old, "_a").join(locked(new, "_b"), key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))


def title() -> Column:
    delta = F.col("new_notch") - F.col("old_notch")
    return F.when(delta > 0, F.concat_ws("", "agency", F.lit(" downgrade of "), "issuer_id", F.lit(" by "), delta.cast("string"))).when(delta < 0, F.concat_ws("", "agency", F.lit(" upgrade of "), "issuer_id")).otherwise(F.concat_ws("", "agency", F.lit(" affirms "), "issuer_id"))


def build_alerts(decided: DataFrame, events: DataFrame, found: DataFrame) -> DataFrame:
    """L-01: one nested row an event: id, decision, rules and the ratings known on the day."""
    known = state.state_before(events, found).groupBy("event_key").agg(F.array_sort(F.collect_list(F.struct("agency", "notch", "as_of"))).alias("ratings"))
    known = known.withColumn("family", F.lit("rating"))
    out = decided.join(known, ["event_key", "family"], "left")
    none = F.array().cast(known.schema["ratings"].dataType)
    alert_id = F.concat(F.lit("alr_"), F.substring(F.sha2(F.concat_ws("\x1f", "family", F.col("event_key").cast("string")), 256), 1, 20))
    return out.select(alert_id.alias("alert_id"), "event_key", "family", "issuer_id", "eff", "priority", F.col("triggered").alias("rules"), F.coalesce("ratings", none).alias("ratings"))


def route(decided: DataFrame) -> DataFrame:
    return decided.join(F.broadcast(decided.sparkSession.createDataFrame(ROUTES, "priority string, channels string, mode string")), "priority")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """J-15: whether a request's key has an answer."""
    known = cache.select(F.col("cache_key").alias("_k")).distinct()
    return requests.join(known, F.col("cache_key") == F.col("_k"), "left").withColumn("hit", F.col("_k").isNotNull()).drop("_k")


def outcomes(docs: DataFrame, events: DataFrame, observations: DataFrame) -> DataFrame:
    """E-18."""
    e, o = events.select(F.col("doc_id").alias("_e")).distinct(), observations.select(F.col("doc_id").alias("_o")).distinct()
    out = docs.join(e, F.col("doc_id") == F.col("_e"), "left").join(o, F.col("doc_id") == F.col("_o"), "left")
    return out.withColumn("outcome", F.when(F.col("_e").isNotNull(), "EVENTS").when(F.col("_o").isNotNull(), "OBSERVATIONS_ONLY").otherwise("NO_EVENT"))


def ledger(costs: DataFrame, limit: float) -> DataFrame:
    """A-12: what is spent and what remains after each call."""
    so_far = Window.partitionBy("run_id").orderBy("call_id").rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("spent", F.sum("cost").over(so_far)).withColumn("remaining", limit - F.col("spent"))
