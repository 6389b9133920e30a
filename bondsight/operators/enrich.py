"""Guidance arithmetic, and the merge of validated statements into events under deterministic precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondsight.operators.rules import CUT_PERCENT

CLOSE = 1e-9


def middle(lower: str, upper: str) -> Column:
    """One bound may be missing; inverted bounds have no middle."""
    mid = F.coalesce((F.col(lower) + F.col(upper)) / 2, F.col(lower), F.col(upper))
    return F.when(F.coalesce(F.col(lower) > F.col(upper), F.lit(False)), F.lit(None)).otherwise(mid)


def guidance_change(df: DataFrame) -> DataFrame:
    """G-01, G-02: middles, delta, percent (not for growth rates or a previous value of about 0), direction, basis."""
    df = df.withColumn("previous_mid", middle("previous_lower", "previous_upper")).withColumn("current_mid", middle("current_lower", "current_upper"))
    p, delta = F.col("previous_mid"), F.col("current_mid") - F.col("previous_mid")
    inverted = F.coalesce(F.col("previous_lower") > F.col("previous_upper"), F.lit(False)) | F.coalesce(F.col("current_lower") > F.col("current_upper"), F.lit(False))
    return df.withColumns({
        "delta": delta,
        "pct": F.when((F.col("unit") != "percent") & (F.abs(p) > CLOSE), delta / F.abs(p) * 100),
        "direction": F.when(F.abs(delta) < CLOSE, "unchanged").when(delta > 0, "up").when(delta < 0, "down"),
        "basis": F.when(delta.isNotNull(), "quantitative").when(F.col("status").isNotNull(), "qualitative").otherwise("none"),
        "inverted": inverted,
    })


def simulated_rule() -> Column:
    """G-03: which rule a cut alone would fire."""
    cut = F.col("status") == "cut"
    return F.when(cut & (F.col("pct") <= -CUT_PERCENT), "ERN-02").when(cut & ((F.col("pct") < 0) | F.col("pct").isNull()), "ERN-03")


def governing(df: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """G-04, G-06: per key the statement with the strongest rule, then the largest percent, then the metric's place in scope."""
    rank = F.when(simulated_rule() == "ERN-02", 2).when(simulated_rule() == "ERN-03", 1).otherwise(0)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, scope)), F.col("metric")), F.lit(0))
    order = F.struct(-rank, -F.round(F.coalesce(F.abs("pct"), F.lit(-1.0)), 6), F.when(place == 0, len(scope) + 1).otherwise(place), "event_key")
    best = df.where("metric is not null").groupBy(key).agg(F.min_by(F.struct("metric", "event_key", "previous_mid", "current_mid", "pct"), order).alias("b"))
    return best.select(key, F.col("b.metric").alias("governing"), "b.event_key", "b.previous_mid", "b.current_mid", "b.pct")


def strongest_status(df: DataFrame, key: str) -> DataFrame:
    """G-05: cut, then withdrawn, then reaffirmed, else null."""
    has = lambda *s: F.bool_or(F.col("status").isin(*s))
    return df.groupBy(key).agg(F.when(has("cut"), "cut").when(has("withdrawn"), "withdrawn").when(has("reaffirmed", "in_line"), "reaffirmed").alias("status"))


def family_flags(df: DataFrame, key: str, negative: dict[str, Column]) -> DataFrame:
    """G-07: a family's flag is set by one valid negative statement."""
    return df.groupBy(key).agg(*(F.bool_or(c & F.col("valid")).alias(name) for name, c in negative.items()))


def fill_empty(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """G-08: a new reading that disagrees with a deterministic one anywhere is refused whole; else it fills what is empty."""
    clash = [F.coalesce(F.col(d) != F.col(n), F.lit(False)) for d, n in fields.values()]
    conflict = clash[0]
    for c in clash[1:]:
        conflict = conflict | c
    out = df.withColumn("conflict", conflict)
    return out.withColumns({f: F.when(F.col("conflict"), F.col(d)).otherwise(F.coalesce(d, n)) for f, (d, n) in fields.items()})


def merge_flag(df: DataFrame, flags: str, flag: str, proposed: Column) -> DataFrame:
    """G-09: a proposed flag is added, never removed; its absence where it is set is recorded."""
    had = F.array_contains(flags, flag)
    return df.withColumn("disagreement", had & ~proposed).withColumn(flags, F.when(proposed, F.array_union(F.col(flags), F.array(F.lit(flag)))).otherwise(F.col(flags)))


def provenance(df: DataFrame, key: str, what: str) -> DataFrame:
    """G-12: the one value, or the sorted list of several."""
    values = F.array_sort(F.collect_set(what))
    return df.groupBy(key).agg(F.when(F.size(values) == 1, values[0]).otherwise(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))).alias(what))


def statements_of(events: DataFrame, statements: DataFrame) -> DataFrame:
    """J-14: valid statements of the events' documents (doc_ids)."""
    return events.select("event_key", F.explode("doc_ids").alias("doc_id")).join(statements.where("validation_status = 'VALID'"), "doc_id")


def swap_evidence(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """G-10: evidence of type llm_statement gives way to the document's own passage (event_key, doc_id, start, end, quote)."""
    kept = evidence.where("evidence_type != 'llm_statement'")
    return kept.unionByName(spans.withColumn("evidence_type", F.lit("document")).select(kept.columns))
