"""Rating scales on a common notch scale (1 strongest, 22 default), and other fixed values of the credit domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The published scales. The n-th label of a list is notch n; where a notch has two, they stand together.
SP = "AAA AA+ AA AA- A+ A A- BBB+ BBB BBB- BB+ BB BB- B+ B B- CCC+ CCC CCC- CC C D/SD"
MOODYS = "Aaa Aa1 Aa2 Aa3 A1 A2 A3 Baa1 Baa2 Baa3 Ba1 Ba2 Ba3 B1 B2 B3 Caa1 Caa2 Caa3 Ca C"
FITCH = "AAA AA+ AA AA- A+ A A- BBB+ BBB BBB- BB+ BB BB- B+ B B- CCC+ CCC CCC- CC C RD/D"
DBRS = "AAA,AA (high),AA,AA (low),A (high),A,A (low),BBB (high),BBB,BBB (low),BB (high),BB,BB (low),B (high),B,B (low),CCC (high),CCC,CCC (low),CC,C,D"
LAST_IG, LAST_HY = 10, 21
UNRATED = ("NR", "WD", "WR", "N/A", "NOT RATED", "WITHDRAWN")
AGENCY_NAMES = {
    "SP": ("S&P", "S&P Global", "S&P Global Ratings", "Standard & Poor's", "Standard and Poor's"),
    "MOODYS": ("Moody's", "Moodys", "Moody's Investors Service", "Moody's Ratings"),
    "FITCH": ("Fitch", "Fitch Ratings"),
    "DBRS": ("DBRS", "Morningstar DBRS", "DBRS Morningstar"),
}
ADMISSIBLE = ("SP", "MOODYS", "FITCH")
ELIGIBLE_TYPES = ("long_term_issuer", "long_term_issuer_default")
MAX_AGE_DAYS = 400


def scale_rows() -> list[tuple[str, str, int, int]]:
    """(agency, label, notch, seq)"""
    rows = []
    for agency, labels in (("SP", SP.split()), ("MOODYS", MOODYS.split()), ("FITCH", FITCH.split()), ("DBRS", DBRS.split(","))):
        for notch, names in enumerate(labels, 1):
            rows += [(agency, name, notch) for name in names.split("/")]
    return [(*r, i) for i, r in enumerate(rows)]


def alias_rows() -> list[tuple[str, str]]:
    """(alias in lower case, agency)"""
    return [(name, agency) for agency, names in AGENCY_NAMES.items() for name in dict.fromkeys(n.lower() for n in (agency, *names))]


#: Alias in lower case to agency; agency to its labels, exact and (first of the scale) without case.
AGENCY_OF = dict(alias_rows())
LABELS = {(a, x.replace(" ", "")): x for a, x, _, _ in scale_rows()}
FOLDED = {(a, x.replace(" ", "").lower()): x for a, x, _, _ in reversed(scale_rows())}
DASHES = str.maketrans(dict.fromkeys("‐‑‒–—−", "-"))


def label_of(agency: str, raw: str) -> str | None:
    """J-05 for one cell of text: the scale's label, exact, or without case where the cell has only one case."""
    plain = "".join(raw.split()).translate(DASHES)
    return LABELS.get((agency, plain)) or (FOLDED.get((agency, plain.lower())) if plain in (plain.upper(), plain.lower()) else None)


def values_sql(rows: list[tuple], columns: str) -> str:
    """An inline table that Spark SQL and ANSI SQL both read."""
    quoted = (", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in r) for r in rows)
    return f"SELECT * FROM (VALUES {', '.join(f'({q})' for q in quoted)}) AS t({columns})"


def scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(scale_rows(), "agency string, label string, notch int, seq int")


def agency_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "alias string, agency string")


def clean_label(label: Column) -> Column:
    """White space away, dashes of all kinds to a hyphen."""
    return F.regexp_replace(F.regexp_replace(label, r"\s+", ""), "[‐‑‒–—−]", "-")


def single_case(label: Column) -> Column:
    """Only labels all upper or all lower are matched without case."""
    return (label == F.upper(label)) | (label == F.lower(label))


def category(notch: Column) -> Column:
    return F.when(notch <= LAST_IG, "IG").when(notch <= LAST_HY, "HY").when(notch.isNotNull(), "DEFAULT")


def label_to_notch(df: DataFrame, agency: str, label: str, out: str) -> DataFrame:
    """J-05: the notch of an agency's label, exact first, then without case; null if unknown. The scale is 89 rows."""
    s = scale(df.sparkSession)
    exact = F.broadcast(s.select(F.col("agency").alias("_a"), clean_label(F.col("label")).alias("_l"), F.col("notch").alias("_n")))
    fold = F.broadcast(s.groupBy(F.col("agency").alias("_b"), F.lower(clean_label(F.col("label"))).alias("_m")).agg(F.min_by("notch", "seq").alias("_o")))
    raw = clean_label(F.col(label))
    df = df.join(exact, (F.col(agency) == F.col("_a")) & (raw == F.col("_l")), "left")
    df = df.join(fold, (F.col(agency) == F.col("_b")) & (F.lower(raw) == F.col("_m")) & single_case(raw), "left")
    return df.withColumn(out, F.coalesce("_n", "_o")).drop("_a", "_l", "_n", "_b", "_m", "_o")


def notch_to_label(df: DataFrame, agency: str, notch: str, out: str) -> DataFrame:
    """J-07: the first label of an agency's notch; null where the agency has none."""
    first = scale(df.sparkSession).groupBy("agency", "notch").agg(F.min_by("label", "seq").alias(out))
    first = F.broadcast(first.select(F.col("agency").alias("_a"), F.col("notch").alias("_n"), out))
    return df.join(first, (F.col(agency) == F.col("_a")) & (F.col(notch) == F.col("_n")), "left").drop("_a", "_n")


def resolve_agency(df: DataFrame, name: str, out: str) -> DataFrame:
    """J-08: the agency of a display name or alias, white space and case aside."""
    names = F.broadcast(agency_aliases(df.sparkSession).select(F.col("alias").alias("_n"), F.col("agency").alias(out)))
    return df.join(names, F.lower(F.regexp_replace(F.trim(F.col(name)), r"\s+", " ")) == F.col("_n"), "left").drop("_n")
