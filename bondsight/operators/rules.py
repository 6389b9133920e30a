"""The decision matrix: every rule a named condition over columns, all reported; modifiers raise; no default priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bondsight.functions import scales
from bondsight.functions.scales import LAST_IG, category
from bondsight.operators import state

# Rule, priority, direction, family.
RULES = [
    ("RAT-01", "P1", "negative", "rating"), ("RAT-02", "P1", "negative", "rating"), ("RAT-03", "P1", "negative", "rating"), ("RAT-04", "P1", "negative", "rating"),
    ("RAT-05", "P2", "negative", "rating"), ("RAT-06", "P2", "negative", "rating"), ("RAT-07", "P2", "negative", "rating"), ("RAT-08", "P2", "positive", "rating"),
    ("RAT-09", "P3", "positive", "rating"), ("RAT-10", "P3", "neutral", "rating"),
    ("ERN-01", "P1", "negative", "earnings"), ("ERN-02", "P1", "negative", "earnings"), ("ERN-03", "P2", "negative", "earnings"), ("ERN-04", "P3", "neutral", "earnings"),
    ("ISS-01", "P2", "neutral", "issuance"), ("ISS-02", "P2", "neutral", "issuance"), ("ISS-03", "P1", "negative", "issuance"), ("ISS-04", "P3", "neutral", "issuance"),
    ("EDG-01", "P1", "negative", "edgar"),
]
RANK = {"P3": 1, "P2": 2, "P1": 3}
CUT_PERCENT, LARGE_ISSUE_EUR, WINDOW_DAYS, WINDOW_EVENTS, LEVERAGE_ABOVE = 10, 1_000_000_000, 30, 2, 4.5
MODIFIERS = ("MOD-01", "MOD-02", "MOD-03")
# Spellings of the metrics that guidance rules look at.
METRICS = {
    "revenue": "revenue", "revenues": "revenue", "sales": "revenue", "net sales": "revenue", "net revenue": "revenue",
    "ebitda": "ebitda", "adjusted ebitda": "ebitda", "fcf": "fcf", "free cash flow": "fcf", "free_cash_flow": "fcf",
}
CRITICAL = ("liquidity", "going_concern", "covenant")
JUNIOR = ("subordinated", "hybrid", "AT1", "T2")
#: Columns that every family has after with_family(); a family leaves the others' null.
SHAPE = "event_key long, issuer_id string, family string, event_type string, eff date, agency string, old_notch int, new_notch int, new_outlook string, watch string, metric string, g_old double, g_new double, status string, significant boolean, flags array<string>, currency string, seniority string, amount double, item string"


def shaped(df: DataFrame, family: str) -> DataFrame:
    """Events of one family with the columns of all."""
    have = set(df.columns)
    cols = []
    for part in SHAPE.split(", "):
        name, kind = part.split(" ", 1)
        cols.append((F.lit(family) if name == "family" else F.col(name) if name in have else F.lit(None)).cast(kind).alias(name))
    return df.select(*cols)


def guidance_inputs(df: DataFrame) -> DataFrame:
    """R-26: `scope` (revenue, ebitda, fcf or null) and `pct`, the change in percent (null if there is no old value or it is 0)."""
    scope = F.lower(F.trim("metric"))
    known = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])
    return df.withColumn("scope", F.element_at(known, scope)).withColumn("pct", F.when(F.col("g_old") != 0, (F.col("g_new") - F.col("g_old")) / F.abs("g_old") * 100))


def with_state(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events of the common shape with what the state before says of their agency (T-06, T-07), whether another agency is
    investment grade after the action (J-11), and the weakest rating: after a rating action (T-05), before other events.

    The state of an event is at most one entry an agency, so it becomes columns: one aggregate and one join for all families.
    """
    # rating events keep their own number, by which the state leaves the event itself out; the others' are below zero
    number = F.when(F.col("family") == "rating", F.col("event_key")).when(F.col("family") == "earnings", -2 * F.col("event_key") - 1).otherwise(-2 * F.col("event_key") - 2)
    keyed = events.withColumn("_k", number)
    before = state.state_before(keyed.select(F.col("_k").alias("event_key"), "issuer_id", "eff"), found)
    entry = lambda a, c: F.max(F.when(F.col("agency") == a, F.col(c)))
    wide = before.groupBy(F.col("event_key").alias("_k")).agg(*(entry(a, c).alias(f"_{c}_{a}") for a in scales.ADMISSIBLE for c in ("notch", "outlook")))
    acting = F.col("family") == "rating"
    own = lambda a: acting & (F.col("agency") == a)
    of = lambda c: F.coalesce(*(F.when(own(a), F.col(f"_{c}_{a}")) for a in scales.ADMISSIBLE))
    after = {a: F.when(own(a) & F.col("new_notch").isNotNull(), F.col("new_notch")).otherwise(F.col(f"_notch_{a}")) for a in scales.ADMISSIBLE}
    other_ig = F.lit(False)
    for a in scales.ADMISSIBLE:
        other_ig = other_ig | F.coalesce((F.col("agency") != a) & (after[a] <= LAST_IG), F.lit(False))
    out = keyed.join(wide, "_k", "left").withColumns({"state_outlook": of("outlook"), "state_notch": of("notch"), "weakest_notch": F.greatest(*after.values()), "other_ig": F.when(acting, other_ig)})
    return out.drop("_k", *(f"_{c}_{a}" for a in scales.ADMISSIBLE for c in ("notch", "outlook")))


def conditions() -> dict[str, Column]:
    """Each rule's condition; never null."""
    c = F.col
    delta = c("new_notch") - c("old_notch")
    acts = (c("family") == "rating") & c("agency").isin(*scales.ADMISSIBLE)
    down, up = acts & (c("event_type") == "downgrade"), acts & (c("event_type") == "upgrade")
    ig_to_hy = (category(c("old_notch")) == "IG") & (category(c("new_notch")) == "HY")
    previous = c("state_outlook")
    after = F.coalesce(c("new_notch"), c("state_notch"))
    rat04 = acts & (c("watch") == "negative") & (after == LAST_IG)
    crosses_up = (category(c("old_notch")) != "IG") & (category(c("new_notch")) == "IG")
    earns, issues = c("family") == "earnings", (c("family") == "issuance") & c("event_type").isin("new_issue", "tap")
    euros = F.when(c("currency") == "EUR", c("amount"))
    scoped, large = c("scope").isNotNull(), issues & (euros >= LARGE_ISSUE_EUR)
    junior = issues & c("seniority").isin(*JUNIOR)
    flagged = lambda *names: F.arrays_overlap(c("flags"), F.array(*map(F.lit, names)))
    big = (scoped & (c("pct") <= -CUT_PERCENT)) | c("significant")
    found = {
        "RAT-01": down & ig_to_hy,
        "RAT-02": down & ig_to_hy & c("other_ig"),
        "RAT-03": down & (delta >= 2),
        "RAT-04": rat04,
        "RAT-05": down & (delta == 1) & ~ig_to_hy,
        "RAT-06": acts & (c("new_outlook") == "negative") & previous.isin("stable", "positive"),
        "RAT-07": acts & (c("watch") == "negative") & ~F.coalesce(rat04, F.lit(False)),
        "RAT-08": up & crosses_up,
        "RAT-09": acts & ((F.coalesce(up & ~crosses_up, F.lit(False))) | F.coalesce(c("new_outlook") == "positive", F.lit(False)) | (c("watch") == "positive")),
        "RAT-10": acts & (c("event_type") == "affirmation") & (F.coalesce(c("watch"), F.lit("none")) == "none") & (c("new_outlook").isNull() | previous.isNull() | (c("new_outlook") == previous)),
        "ERN-01": earns & flagged(*CRITICAL),
        "ERN-02": earns & F.coalesce(big, c("significant"), F.lit(False)),
        "ERN-03": earns & (F.coalesce(scoped & (c("pct") > -CUT_PERCENT) & (c("pct") < 0), F.lit(False)) | F.coalesce((c("status") == "cut") & c("pct").isNull() & (c("metric").isNull() | scoped), F.lit(False)) | flagged("impairment")),
        "ERN-04": earns & c("status").isin("reaffirmed", "in_line") & ~F.coalesce(scoped & (c("pct") < 0), F.lit(False)) & ~c("significant") & ~flagged(*CRITICAL, "impairment"),
        "ISS-01": large,
        "ISS-02": junior,
        "ISS-03": (c("family") == "issuance") & (c("event_type") == "non_call") & c("seniority").isin("AT1", "hybrid"),
        "ISS-04": issues & ((c("event_type") == "tap") | ((euros < LARGE_ISSUE_EUR) & ~F.coalesce(junior, F.lit(False)))),
        "EDG-01": c("item") == "2.04",
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def decide_base(events: DataFrame) -> DataFrame:
    """R-00, R-24: per event the triggered rules in config order, base priority (null without any) and whether negative."""
    each = conditions()
    hits = F.array_compact(F.array(*(F.when(each[r], F.lit(r)) for r, *_ in RULES)))
    rank = F.greatest(*(F.when(each[r], F.lit(RANK[p])).otherwise(F.lit(0)) for r, p, *_ in RULES))
    bad = F.greatest(*(F.when(each[r] & F.lit(d == "negative"), 1).otherwise(0) for r, _, d, _ in RULES)) == 1
    return events.withColumn("triggered", hits).withColumn("base_rank", rank).withColumn("negative", bad)


def matrix(events: DataFrame) -> DataFrame:
    """R-00: one row for each event and rule, triggered or not."""
    each = conditions()
    rows = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(p).alias("priority"), F.lit(d).alias("direction"), each[r].alias("triggered")) for r, p, d, _ in RULES))
    return events.select("event_key", "family", F.explode(rows).alias("r")).select("event_key", "family", "r.*")


def named(rank: Column) -> Column:
    return F.when(rank == 3, "P1").when(rank == 2, "P2").when(rank == 1, "P3")


def raised(rank: Column, by: Column, to_first: Column) -> Column:
    """The final rank: raised by so many, or to the first; none stays none."""
    return F.when(rank > 0, F.least(F.lit(3), F.greatest(rank + by, F.when(to_first, 3).otherwise(0))))


def decide(based: DataFrame, leverage: DataFrame | None = None, threshold: float = LEVERAGE_ABOVE) -> DataFrame:
    """Modifiers and the final priority. MOD-01: a negative event whose issuer's weakest rating stands at the last
    investment grade is raised by one. MOD-02: a negative P2 event with WINDOW_EVENTS such in the WINDOW_DAYS up to its
    day, itself included, becomes P1. MOD-03: a negative event whose issuer's latest known leverage (issuer_id, as_of,
    leverage) is above the threshold is raised by one. The base never reads other decisions, so one window over
    effective days is the fixed point of deciding again and again."""
    p2 = F.col("negative") & (F.col("base_rank") == 2)
    span = Window.partitionBy("issuer_id").orderBy(F.unix_date("eff")).rangeBetween(-WINDOW_DAYS, 0)
    df = based.withColumn("recent", F.sum(p2.cast("int")).over(span))
    mod01 = F.coalesce(F.col("negative") & (F.col("weakest_notch") == LAST_IG), F.lit(False))
    mod02 = p2 & (F.col("recent") >= WINDOW_EVENTS)
    df = df.withColumn("mod01", mod01).withColumn("mod02", mod02)
    if leverage is None:
        df = df.withColumn("leverage", F.lit(None).cast("double"))
    else:
        df = with_leverage(df, leverage)
    df = df.withColumn("mod03", F.coalesce(F.col("negative") & (F.col("leverage") > threshold), F.lit(False)))
    decided = F.col("base_rank") > 0
    final = raised(F.col("base_rank"), F.col("mod01").cast("int") + F.col("mod03").cast("int"), F.col("mod02"))
    applied = F.concat(F.col("triggered"), F.array_compact(F.array(*(F.when(F.col(m.lower().replace("-", "")) & decided, F.lit(m)) for m in MODIFIERS))))
    return df.withColumn("base_priority", named(F.col("base_rank"))).withColumn("priority", named(final)).withColumn("applied", applied).withColumn("decision_status", F.when(decided, "DECIDED").otherwise("NO_APPLICABLE_RULE"))


def decide_all(rating: DataFrame, earnings: DataFrame, issuance: DataFrame, found: DataFrame, leverage: DataFrame | None = None) -> DataFrame:
    """R-27: all families through the matrix. Only rating events act on the state; the others' weakest rating is that before."""
    events = shaped(rating, "rating").unionByName(shaped(earnings, "earnings")).unionByName(shaped(issuance, "issuance"))
    return decide(decide_base(guidance_inputs(with_state(events, found))), leverage)


def with_leverage(events: DataFrame, known: DataFrame) -> DataFrame:
    """R-23: `leverage`, the issuer's latest figure on or before the event's day; null without one.

    known: (issuer_id, as_of, leverage). Figures and events lie in one order by issuer, figures first on a day, and the
    last figure is carried forward.
    """
    given = known.select("issuer_id", F.col("as_of").alias("eff"), F.lit(0).alias("_kind"), F.col("leverage").alias("_leverage"))
    both = given.unionByName(events.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("issuer_id").orderBy("eff", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("leverage", F.last("_leverage", ignorenulls=True).over(so_far)).where("_kind = 1").drop("_kind", "_leverage")


def explain(decided: DataFrame, before: DataFrame) -> DataFrame:
    """R-29: (event_key, family, section, text), a row for each thing that made the decision."""
    one = lambda df, section, text: df.select("event_key", "family", F.lit(section).alias("section"), text.alias("text"))
    parts = [
        one(decided, "triggered", F.explode("triggered")),
        *(one(decided.where(f"{m.lower().replace('-', '')} and base_rank > 0"), "modifier", F.lit(m)) for m in MODIFIERS),
        one(decided, "decision", F.coalesce("priority", "decision_status")),
        one(before.withColumn("family", F.lit("rating")), "state", F.concat_ws(":", "agency", F.col("notch").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def downgrade_guard() -> Column:
    """R-20: why a downgrade rule can't apply, first reason first; null if it can."""
    c = F.col
    return (
        F.when(~c("agency").isin(*scales.ADMISSIBLE), "non-admissible agency")
        .when(c("event_type") != "downgrade", "not a downgrade")
        .when(c("old_notch").isNull() | c("new_notch").isNull(), "missing transition")
    )
