"""The issuer's rating state as known on a day: an as-of join without look-ahead, its losers with reasons, and the composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bondsight.functions import scales
from bondsight.functions.scales import category


def origin_rank() -> Column:
    return F.when(F.col("origin") == "event", 0).when(F.col("origin") == "observation", 1).otherwise(2)


def candidates(seeds: DataFrame, observations: DataFrame, events: DataFrame) -> DataFrame:
    """T-01: one table of dated ratings. An observation's own date counts first, then the day it was seen; an event's
    new rating is a long-term issuer rating of its effective day, with the event as source."""
    own = ["issuer_id", "agency", "notch", "as_of", "rating_type", "origin", "outlook", "source"]
    seen = observations.withColumn("as_of", F.coalesce("as_of", "observed_at")) if "observed_at" in observations.columns else observations
    acted = events.where("new_notch is not null").select("issuer_id", "agency", F.col("new_notch").alias("notch"), F.col("eff").alias("as_of"), F.lit("long_term_issuer").alias("rating_type"), F.lit("event").alias("origin"), F.col("new_outlook").alias("outlook"), F.col("event_key").cast("string").alias("source"))
    return seeds.select(*own).unionByName(seen.select(*own)).unionByName(acted)


def eligible() -> Column:
    return F.col("agency").isin(*scales.ADMISSIBLE) & F.col("rating_type").isin(*scales.ELIGIBLE_TYPES) & F.col("notch").isNotNull() & F.col("as_of").isNotNull()


def state_before(events: DataFrame, found: DataFrame, max_age: int = scales.MAX_AGE_DAYS) -> DataFrame:
    """J-09, T-03: for each event (event_key, issuer_id, eff) and admissible agency, the latest eligible candidate dated
    on or before eff and not older than max_age days, other than the event itself. Ties: event, observation, seed, then
    the least source.

    Candidates and events of an issuer and agency lie in one order, candidates first on a day, and the last candidate is
    carried forward: linear in both, whatever the length of a history. Each candidate also carries the one before it,
    for the event whose own rating is the latest.
    """
    cand = found.where(eligible()).select("issuer_id", "agency", F.col("as_of").alias("day"), F.lit(0).alias("kind"), origin_rank().alias("rank"), "source", F.struct("notch", "as_of", "origin", "outlook", "source").alias("c"), F.lit(None).cast("bigint").alias("event_key"))
    best_last = Window.partitionBy("issuer_id", "agency").orderBy("day", "kind", F.col("rank").desc(), F.col("source").desc(), "event_key")
    cand = cand.withColumn("before", F.lag("c").over(best_last))
    asked = events.select("issuer_id", F.explode(F.array(*map(F.lit, scales.ADMISSIBLE))).alias("agency"), F.col("eff").alias("day"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("source"), F.lit(None).cast(cand.schema["c"].dataType).alias("c"), F.col("event_key").cast("bigint").alias("event_key"), F.lit(None).cast(cand.schema["c"].dataType).alias("before"))
    carried = F.last(F.when(F.col("kind") == 0, F.struct("c", "before")), ignorenulls=True).over(best_last.rowsBetween(Window.unboundedPreceding, 0))
    out = cand.unionByName(asked).withColumn("last", carried).where("kind = 1 and last is not null")
    own = (F.col("last.c.origin") == "event") & (F.col("last.c.source") == F.col("event_key").cast("string"))
    out = out.withColumn("w", F.when(own, F.col("last.before")).otherwise(F.col("last.c"))).where(F.col("w").isNotNull())
    age = F.datediff("day", "w.as_of")
    return out.where(age <= max_age).select("event_key", "issuer_id", F.col("day").alias("eff"), "agency", "w.notch", "w.as_of", "w.origin", "w.outlook", "w.source", age.alias("age_days"))


def rejected(events: DataFrame, found: DataFrame, max_age: int = scales.MAX_AGE_DAYS) -> DataFrame:
    """J-10: every candidate of the event's issuer that its state doesn't use, with the first reason that fails. As long
    as the issuers' events times their candidates, which is what is asked for."""
    pairs = events.select("event_key", "issuer_id", "eff").join(found, "issuer_id")
    age = F.datediff("eff", "as_of")
    reason = (
        F.when(~F.col("agency").isin(*scales.ADMISSIBLE), "non-admissible agency")
        .when(~F.col("rating_type").isin(*scales.ELIGIBLE_TYPES), "rating type not eligible")
        .when(F.col("notch").isNull(), "unknown rating label")
        .when(F.col("as_of").isNull(), "incomplete date")
        .when(F.col("as_of") > F.col("eff"), "observed after D")
        .when(age > max_age, "stale")
    )
    best = Window.partitionBy("event_key", "agency").orderBy(F.col("bad").isNotNull(), F.col("as_of").desc(), origin_rank(), "source")
    ranked = pairs.withColumn("bad", reason).withColumn("rn", F.row_number().over(best))
    return ranked.select("event_key", "agency", "source", F.coalesce("bad", F.when(F.col("rn") > 1, "superseded")).alias("reason")).where("reason is not null")


def state_after(before: DataFrame, events: DataFrame) -> DataFrame:
    """T-04: the acting agency's entry is the event's new rating, aged 0."""
    others = before.join(events.select("event_key", F.col("agency").alias("_acting"), "new_notch"), "event_key", "left")
    others = others.where(F.col("new_notch").isNull() | (F.col("agency") != F.col("_acting"))).select("event_key", "agency", "notch", "outlook", "age_days")
    acted = events.where(F.col("new_notch").isNotNull() & F.col("agency").isin(*scales.ADMISSIBLE))
    return others.unionByName(acted.select("event_key", "agency", F.col("new_notch").alias("notch"), F.col("new_outlook").alias("outlook"), F.lit(0).alias("age_days")))


def weakest(state: DataFrame) -> DataFrame:
    """T-05: by notch, then agency."""
    return state.groupBy("event_key").agg(F.max(F.struct("notch", "agency")).alias("w")).select("event_key", F.col("w.agency").alias("agency"), F.col("w.notch").alias("notch"))


def composite_inputs(found: DataFrame, agencies: tuple[str, ...] = scales.ADMISSIBLE) -> DataFrame:
    """M-03: one issuer-level rating an agency: the latest dated, else the first by source."""
    latest = Window.partitionBy("issuer_id", "agency").orderBy(F.col("as_of").desc_nulls_last(), "source")
    fit = found.where(F.col("agency").isin(*agencies) & F.col("rating_type").isin(*scales.ELIGIBLE_TYPES) & F.col("notch").isNotNull())
    return fit.withColumn("rn", F.row_number().over(latest)).where("rn = 1").select("issuer_id", "agency", "notch", "as_of")


def composite(inputs: DataFrame) -> DataFrame:
    """M-04, M-05: the middle (the weaker of two) and the rounded averages of an issuer's notches."""
    n = F.array_sort(F.collect_list("notch"))
    out = inputs.groupBy("issuer_id").agg(n.alias("notches"), F.avg("notch").alias("mean"))
    held = lambda c: F.greatest(F.lit(1), F.least(F.lit(22), c)).cast("int")
    middle = F.element_at("notches", (F.floor(F.size("notches") / 2) + 1).cast("int"))
    return out.select("issuer_id", F.size("notches").alias("n_agencies"), middle.alias("middle"), category(middle).alias("category"), held(F.floor(F.col("mean") + 0.5)).alias("nearest_weaker"), held(F.ceil("mean")).alias("weaker"), held(F.floor("mean")).alias("stronger"))
