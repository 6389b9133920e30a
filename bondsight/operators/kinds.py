"""Statement kinds: what an answer of each kind must hold, and which checks make one of its statements valid.

An answer is JSON text. It is parsed as a variant, so that answers of all kinds lie in one table; a kind's fields are
then taken out of each statement and their types, values and order of offsets tested. One statement that doesn't fit
fails its whole answer, with the first thing that is wrong. Checks are columns over the fields and the document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondsight.functions import wording as w
from bondsight.operators import corpus as c
from bondsight.operators import validate as v

#: Fields with their type, whether they may be missing, and the values they may have.
UNITS = ("EUR_BN", "EUR_MN", "USD_BN", "USD_MN", "PCT")
#: Signs one of which a unit needs in the quote, for its currency and for its scale.
UNIT_SIGNS = {
    "EUR_BN": (("eur", "€", "euro"), ("billion", "bn")), "EUR_MN": (("eur", "€", "euro"), ("million", "mn")),
    "USD_BN": (("usd", "$", "dollar"), ("billion", "bn")), "USD_MN": (("usd", "$", "dollar"), ("million", "mn")), "PCT": ((), ("%", "percent", "per cent")),
}
PAST_YEARS, FUTURE_YEARS = 1, 3


@dataclass(frozen=True)
class Field:
    kind: str
    needed: bool = False
    values: tuple[str, ...] = ()


QUOTED = {"evidence_quote": Field("string", True), "start_offset": Field("bigint", True), "end_offset": Field("bigint", True)}
BOUNDS = ("previous_lower", "previous_upper", "current_lower", "current_upper")


def risk(name: str, statuses: str, **more: Field) -> dict[str, Field]:
    return {"risk_type": Field("string", True, (name,)), "status": Field("string", True, tuple(statuses.split())), "period": Field("string"), **more, **QUOTED}


def _named(pattern: str) -> Column:
    return F.col("s.evidence_quote").rlike(pattern)


def period_fits() -> Column:
    """V-06: years that a period names lie near the document's."""
    years = F.transform(F.regexp_extract_all(F.coalesce("s.period", F.lit("")), F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    of = F.year("published")
    return (F.size(years) == 0) | F.exists(years, lambda y: (y >= of - PAST_YEARS) & (y <= of + FUTURE_YEARS))


def unit_fits() -> Column:
    """V-03: signs of the unit's currency and scale stand in the quote; without bounds no unit is needed."""
    low = F.lower("s.evidence_quote")
    any_of = lambda signs: F.lit(True) if not signs else F.exists(F.array(*map(F.lit, signs)), lambda x: F.contains(low, x))
    fits = F.lit(False)
    for unit, (currency, scale) in UNIT_SIGNS.items():
        fits = F.when(F.col("s.unit") == unit, any_of(currency) & any_of(scale)).otherwise(fits)
    return F.coalesce(*(F.col(f"s.{b}") for b in BOUNDS)).isNull() | fits


def common() -> dict[str, Column]:
    """Checks of every kind: the quote has a place, its period fits, the issuer speaks."""
    return {"span_match": F.col("match").isNotNull(), "temporal_consistency": period_fits()}


def issuer_speaks() -> dict[str, Column]:
    return {"issuer_voice": v.issuer_voice(F.col("document_kind"), F.lit("issuer"))}


def current(status: str) -> dict[str, Column]:
    """V-13: what is claimed of today isn't dated more than a year before the document."""
    return {"historical_reference": ~((F.col("s.status") == status) & c.historical(F.col("s.evidence_quote"), F.col("published")))}


def guidance_checks() -> dict[str, Column]:
    quote = F.col("s.evidence_quote")
    return common() | {
        "numbers_match": c.numbers_match(quote, [F.col(f"s.{b}") for b in BOUNDS]),
        "unit_match": unit_fits(),
        "metric_match": v.metric_match(F.trim("s.metric_label"), F.col("s.metric"), quote),
    }


def liquidity_checks() -> dict[str, Column]:
    """V-09: a negative status needs a worry that stands; others are never refused for their polarity."""
    worried = F.col("s.status").isin("deteriorated", "concern")
    return common() | issuer_speaks() | {"liquidity_named": _named(w.LIQUIDITY_TOPIC), "polarity": ~worried | v.liquidity_stands(F.col("s.evidence_quote"))}


def covenant_checks() -> dict[str, Column]:
    """V-10, V-11: the status that the words give; being mentioned is always right."""
    reading = F.coalesce(v.covenant_status(F.col("s.evidence_quote")), F.lit("mentioned"))
    status = F.col("s.status")
    fits = (status == "mentioned") | (status == reading)
    resolution = F.when(F.coalesce(F.col("s.resolution"), F.lit("none")) != "none", F.col("s.resolution"))
    return common() | issuer_speaks() | current("breached") | {"covenant_named": _named(rf"(?i){w.words(w.COVENANT)}|compliance"), "status_match": fits, "resolution_match": v.resolution_ok(resolution, F.col("s.evidence_quote"))}


def going_concern_checks() -> dict[str, Column]:
    """V-12: doubt needs one stated, alleviated one relieved, negated one denied."""
    reading = F.coalesce(c.going_concern(F.col("s.evidence_quote")), F.lit("none"))
    means = F.when(reading == "stated", "doubt").when(reading == "denied", "negated").otherwise(reading)
    return common() | issuer_speaks() | current("doubt") | {"going_concern_named": _named(r"(?i)going\s+concern"), "status_match": (F.col("s.status") == "mentioned") | (F.col("s.status") == means)}


@dataclass(frozen=True)
class Kind:
    fields: dict[str, Field]
    checks: Callable[[], dict[str, Column]]
    version: str
    #: Fields that go, not fatally, if the quote doesn't support them.
    salvaged: tuple[str, ...] = field(default=())


KINDS = {
    "guidance": Kind(
        {
            "metric": Field("string", True, ("revenue", "ebitda", "ebit", "fcf", "margin", "capex", "other")), "metric_label": Field("string", True), "basis": Field("string", True, ("absolute", "yoy_change_pct", "margin_pct")), "unit": Field("string", True, UNITS),
            **{b: Field("double") for b in BOUNDS}, "period": Field("string"), "status": Field("string", True, ("raised", "cut", "reaffirmed", "new", "withdrawn", "mentioned")), "direction_claimed": Field("string", False, ("up", "down", "unchanged")), **QUOTED,
        }, guidance_checks, "guidance-1.0",
    ),
    "liquidity": Kind(risk("liquidity", "deteriorated concern stable improved mentioned", metric_label=Field("string"), value=Field("double"), unit=Field("string", False, UNITS)), liquidity_checks, "liquidity-1.0"),
    "covenant": Kind(risk("covenant", "compliant risk_of_breach breached mentioned", resolution=Field("string", False, ("none", "waived", "cured", "amended")), covenant_label=Field("string"), agreement=Field("string")), covenant_checks, "covenant-1.0", ("covenant_label", "agreement")),
    "going_concern": Kind(risk("going_concern", "doubt alleviated negated mentioned"), going_concern_checks, "going_concern-1.0"),
}


def _value(s: Column, name: str, f: Field) -> Column:
    return F.try_variant_get(s, f"$.{name}", f.kind)


def _given(s: Column, name: str) -> Column:
    """What stands there is a value: neither missing nor null."""
    there = F.try_variant_get(s, f"$.{name}", "variant")
    return there.isNotNull() & ~F.coalesce(F.is_variant_null(there), F.lit(True))


def statement_error(s: Column, kind: Kind) -> Column:
    """What is wrong with one statement, first things first; null if nothing is."""
    found = []
    for name, f in kind.fields.items():
        text = F.schema_of_variant(F.try_variant_get(s, f"$.{name}", "variant")) == "STRING"
        right = _value(s, name, f).isNotNull() & (text if f.kind == "string" else ~text)
        found.append(F.when(~_given(s, name), F.lit(f"missing:{name}") if f.needed else F.lit(None)).when(~right, F.lit(f"type:{name}")))
        if f.values:
            found.append(F.when(_given(s, name) & ~_value(s, name, f).isin(*f.values), F.lit(f"value:{name}")))
    names = F.map_keys(F.try_variant_get(s, "$", "map<string,variant>"))
    more = F.array_except(names, F.array(*map(F.lit, kind.fields)))
    found.append(F.when(names.isNull(), "no_object").when(F.size(more) > 0, F.concat(F.lit("unknown:"), F.array_min(more))))
    quote, start, end = (_value(s, n, f) for n, f in QUOTED.items())
    found.append(F.when(quote == "", "empty_quote").when((start < 0) | (end <= start), "offsets"))
    return F.coalesce(*found)


def parse(answers: DataFrame, name: str) -> DataFrame:
    """V-16: answers (doc_id, answer) of one kind to (doc_id, run_status, error, idx, s), one row a statement; an answer
    that fails, or has none, is one row without idx."""
    kind = KINDS[name]
    rows = answers.select("doc_id", F.try_parse_json("answer").alias("v")).withColumn("list", F.try_variant_get("v", "$.statements", "array<variant>"))
    rows = rows.withColumn("list", F.when(F.try_variant_get("v", "$.statements", "variant").isNull() & F.col("v").isNotNull(), F.array().cast("array<variant>")).otherwise(F.col("list")))
    first = F.try_element_at(F.array_compact(F.transform("list", lambda s: statement_error(s, kind))), F.lit(1))
    rows = rows.withColumn("error", F.when(F.col("v").isNull(), "no_json").when(F.col("list").isNull(), "type:statements").otherwise(first))
    taken = F.transform("list", lambda s: F.struct(*(_value(s, n, f).alias(n) for n, f in kind.fields.items())))
    each = rows.select("doc_id", F.when(F.col("error").isNull(), "ok").otherwise("schema_failure").alias("run_status"), "error", F.posexplode_outer(F.when(F.col("error").isNull(), taken)).alias("idx", "s"))
    return each.where("run_status != 'ok' or s is not null or idx is null")


def places(rows: DataFrame) -> DataFrame:
    """V-01, N-12 for parsed statements with their document's text: exact at their offsets, unique elsewhere, or null."""
    quote, text, start, end = F.col("s.evidence_quote"), F.col("text"), F.col("s.start_offset"), F.col("s.end_offset")
    here = F.substring(text, start.cast("int") + 1, (end - start).cast("int")) == quote
    first = F.call_function("locate", quote, text)
    once = (first > 0) & (F.call_function("locate", quote, text, first + 1) == 0)
    return rows.withColumn("match", F.when(here, "exact").when(once, "unique")).withColumn("at", F.when(here, start).when(once, (first - 1).cast("long")))


def validate(parsed: DataFrame, docs: DataFrame, name: str, issuer_kind: str = "document_kind") -> DataFrame:
    """V-14: statements of one kind with match, place, failed (the names of the checks that fail), verdict and dropped
    (V-11: fields that the quote doesn't support). docs: (doc_id, text, published, document_kind)."""
    kind = KINDS[name]
    rows = places(parsed.where("s is not null").join(docs.select("doc_id", "text", "published", F.col(issuer_kind).alias("document_kind")), "doc_id"))
    out = c.verdict(rows, kind.checks())
    low = F.lower("s.evidence_quote")
    gone = [F.when(F.col(f"s.{n}").isNotNull() & ~F.contains(low, F.lower(F.trim(f"s.{n}"))), F.lit(n)) for n in kind.salvaged]
    dropped = F.array_compact(F.array(*gone)) if gone else F.array().cast("array<string>")
    key = F.sha2(F.concat_ws("\x1f", F.lit(kind.version), F.col("doc_id").cast("string"), F.col("idx").cast("string")), 256)
    return out.select(key.alias("statement_id"), "doc_id", F.lit(name).alias("kind"), "idx", F.col("s.status").alias("status"), "match", "at", "verdict", "failed", dropped.alias("dropped"))
