"""Documents to lines, sentences, dates, numbers and events; statements against their source text; issuers of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from bondsight.functions import scales
from bondsight.functions import textfns as tf
from bondsight.functions import wording as w
from bondsight.operators.shares import each_text

AGENCY = "|".join(sorted((n.replace(".", r"\.") for names in scales.AGENCY_NAMES.values() for n in names), key=len, reverse=True))
LABEL = "(?:" + "|".join(sorted({x.replace("+", r"\+") for names in (scales.SP, scales.MOODYS, scales.FITCH) for n in names.split() for x in n.split("/")}, key=lambda x: (-len(x), x))) + ")"
#: A label stands free: no letter, figure or sign beside it.
FREE = r"(?:[^\w+-]|$)"
QUOTE = "[\"'“”‘’]"


def sentences(docs: DataFrame, *keep: str) -> DataFrame:
    """X-02: (doc_id, start, end, text), one row a sentence, with the document's columns in `keep`."""
    return each_text(docs, "doc_id", "text", tf.sentences_of, "start long, end long, text string", *keep)


@F.pandas_udf(DateType())
def latest_day(texts: pd.Series) -> pd.Series:
    """X-04 for short texts: the latest of each one's spelled dates."""
    return pd.Series([max((d for d, _, _ in tf.find_dates(t)), default=None) if t else None for t in texts], dtype=object)


def historical(text: Column, published: Column) -> Column:
    """X-05 for a sentence: every day it refers to, quarter ends too, lies more than HISTORY_DAYS before the document's.

    Only sentences with a year have their dates read.
    """
    nth, year = (F.regexp_extract_all(text, F.lit(QUARTER), F.lit(g)) for g in (1, 2))
    end_of = F.create_map(*(F.lit(x) for pair in QUARTER_ENDS.items() for x in pair))
    ends = F.array_max(F.zip_with(nth, year, lambda n, y: F.to_date(F.concat(y, end_of[F.lower(n)]))))
    latest = F.greatest(latest_day(F.when(text.rlike(r"\d{4}"), text)), ends)
    return F.coalesce(F.datediff(published, latest) > tf.HISTORY_DAYS, F.lit(False))


def dates(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """X-03: (key, day, start, end) of every date; texts without a four-digit year never reach Python."""

    return each_text(df.where(F.col("text").rlike(r"\b\d{4}\b")), key, "text", tf.find_dates, "day date, start long, end long")


def page_lines(pages: DataFrame, page: bool, closed: bool = False) -> DataFrame:
    """N-02, N-03: text of each page, as of a filing or (page) of an issuer's site; closed: entities need their semicolon."""
    return each_text(pages, "page_id", "html", lambda html: [(tf.html_lines(html, page, closed),)], "text string")


def logical_lines(docs: DataFrame) -> DataFrame:
    """X-01: (doc_id, start, line)."""
    return each_text(docs, "doc_id", "text", tf.lines_of, "start long, line string")


def canonical(docs: DataFrame) -> DataFrame:
    return each_text(docs, "doc_id", "text", lambda text: [(tf.canonical(text),)], "text string")


def readings(sents: DataFrame, hits: Column, name: str) -> DataFrame:
    return sents.select("doc_id", "start", F.explode(hits).alias(name))


def has_word(text: Column, some: list[str]) -> Column:
    """Whether one of the words, in lower case, stands in the text: a cheap test before patterns that need one of them."""
    return F.arrays_overlap(F.split(F.lower(text), r"[^a-z0-9_]+"), F.array(*map(F.lit, some)))


def guidance_hits() -> Column:
    """E-05: the statuses that a sentence states."""
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(s)) for s, p in w.GUIDANCE.items())))
    return F.when(has_word(F.col("text"), w.GUIDANCE_NEEDS), found).otherwise(F.array().cast("array<string>"))


def guidance_scan(sents: DataFrame) -> DataFrame:
    """E-05: a row for each status a sentence states."""
    return readings(sents, guidance_hits(), "status")


def guidance_status(scan: DataFrame) -> DataFrame:
    """E-04: a document's status if all its statements agree, else a conflict."""
    by = scan.groupBy("doc_id").agg(F.array_sort(F.collect_set("status")).alias("s"))
    return by.select("doc_id", F.when(F.size("s") == 1, F.col("s")[0]).alias("status"), (F.size("s") > 1).alias("conflict"))


def results_title(text: Column) -> Column:
    """E-04: the first line names a reporting period; a half year needs a noun of results beside it."""
    title = F.element_at(F.split(text, "\n"), 1)
    return title.rlike(w.RESULTS_TITLE) | title.rlike(w.HALF_TITLE)


def flag_hits() -> Column:
    """E-06: (flag, aside) for each flag a sentence raises; aside says why it doesn't stand: denied, alleviated, hypothetical."""
    text = F.col("text")

    def hit(flag: str, pattern: str) -> Column:
        aside = F.when(text.rlike(w.DENIED[flag]), "denied").when(text.rlike(w.SUPPOSED[flag]), "hypothetical")
        if flag == "going_concern":
            reading = going_concern(text)
            aside = F.when(reading != "stated", reading)
        return F.when(text.rlike(pattern), F.struct(F.lit(flag).alias("flag"), aside.alias("aside")))

    none = F.array().cast("array<struct<flag:string,aside:string>>")
    return F.when(has_word(text, w.FLAGS_NEED), F.array_compact(F.array(*(hit(flag, pattern) for flag, pattern in w.FLAGS.items())))).otherwise(none)


def flag_scan(sents: DataFrame) -> DataFrame:
    """E-06: (doc_id, start, flag, aside, first): a row for each flag a sentence raises, why it is set aside (null: it
    stands), and whether it is the document's first of that flag that stands.

    sents: with `published`. A sentence all of whose dates are history is set aside before anything else is asked.
    """
    hits = sents.select("doc_id", "start", "text", "published", F.explode(flag_hits()).alias("hit"))
    aside = F.when(historical(F.col("text"), F.col("published")), "historical").otherwise(F.col("hit.aside"))
    rows = hits.select("doc_id", "start", F.col("hit.flag").alias("flag"), aside.alias("aside"))
    order = Window.partitionBy("doc_id", "flag").orderBy(F.col("aside").isNotNull(), "start")
    return rows.withColumn("first", F.col("aside").isNull() & (F.row_number().over(order) == 1))


def going_concern(text: Column) -> Column:
    """E-07: stated, hypothetical, denied or alleviated for a sentence that names the doubt; else null.

    Relief counts unless it is merely planned; a conclusion clears suppositions before the doubt; a condition or the
    description of the evaluation leaves it hypothetical.
    """
    relieved = text.rlike(w.RELIEVED) & ~text.rlike(w.RELIEF_OPEN)
    denied = text.rlike(w.DOUBT_DENIED) & ~text.rlike(w.RELIEVED)
    supposed = ~text.rlike(w.DOUBT_CONCLUDED) & (text.rlike(w.DOUBT_SUPPOSED) | text.rlike(w.DOUBT_WEIGHED) | text.rlike(w.DOUBT_CONDITION))
    return F.when(text.rlike(w.DOUBT), F.when(relieved, "alleviated").when(denied, "denied").when(supposed & ~text.rlike(w.RELIEVED), "hypothetical").otherwise("stated"))


MOVE = rf"\bfrom\s+(?:{LABEL})\s+to\s+(?:{LABEL}){FREE}|\bto\s+(?:{LABEL})\s+from\s+(?:{LABEL}){FREE}"


MOVED = "array<struct<branch:string,skip:string,old:string,new:string,named:string,verb:string,short:boolean>>"


def _found(branch: str, skip: Column | None = None, **more: Column) -> Column:
    """A struct of what a sentence gives, in the fields that all branches share."""
    none = F.lit(None).cast("string")
    fields = {"skip": none if skip is None else skip.cast("string"), "old": none, "new": none, "named": none, "verb": none, "short": F.lit(False)} | more
    return F.struct(F.lit(branch).alias("branch"), *(c.alias(n) for n, c in fields.items()))


def moves() -> Column:
    """E-01: of each "from X to Y" or "to Y from X" of a sentence, the labels, and the last agency and verb before it."""
    text = F.col("text")
    cut, found = F.split(text, MOVE), F.regexp_extract_all(text, F.lit(MOVE), F.lit(0))

    def move(m: Column, i: Column) -> Column:
        lead = F.array_join(F.slice(cut, 1, i + 1), " ")
        last = lambda pattern: F.try_element_at(F.regexp_extract_all(lead, F.lit(pattern), F.lit(1)), F.lit(-1))
        return _found("rating", old=F.regexp_extract(m, rf"\bfrom\s+({LABEL}){FREE}", 1), new=F.regexp_extract(m, rf"\bto\s+({LABEL}){FREE}", 1), named=last(rf"({AGENCY})"), verb=F.lower(last(w.VERB)), short=text.rlike(w.SHORT_TERM))

    return F.when(text.rlike(MOVE), F.transform(found, move)).otherwise(F.array().cast(MOVED))


def judged(found: DataFrame) -> DataFrame:
    """E-01: agency and delta of rows (old, new, named, verb, short), and in `skip` why a move gives no event."""
    hit = scales.resolve_agency(found, "named", "agency")
    hit = scales.label_to_notch(scales.label_to_notch(hit, "agency", "old", "old_notch"), "agency", "new", "new_notch")
    delta = F.col("new_notch") - F.col("old_notch")
    wrong = (F.col("verb").isin(*w.DOWN) & (delta < 0)) | (F.col("verb").isin(*w.UP) & (delta > 0))
    why = F.when(F.col("short"), "short_term").when(F.col("agency").isNull(), "no_agency").when(delta.isNull(), "label_not_in_scale").when(F.col("verb").isNull(), "no_verb").when(wrong, "direction_mismatch")
    return hit.withColumn("delta", delta).withColumn("skip", F.when(F.col("branch") == "rating", why).otherwise(F.col("skip")))


def transitions(sents: DataFrame) -> DataFrame:
    """E-01: a row for each move between two labels; `skip` says why it gives no event."""
    return judged(readings(sents, moves(), "m").select("doc_id", "start", "m.*")).select("doc_id", "start", "agency", "old", "new", "delta", "skip")


LABEL_AT, LABEL_QUOTED = rf"\bat\s+{QUOTE}?({LABEL}){FREE}", rf"{QUOTE}({LABEL})(?:/[\w+-]+)?{QUOTE}"
LABEL_NOUN = rf"(?:^|[^\w+-])({LABEL})\s+(?:[a-z-]+\s+){{0,3}}(?i:ratings?|idr|issuer|long-term|senior|notes|debt)\b"


def actions(sents: DataFrame) -> DataFrame:
    """E-02: watch placements before outlook revisions before affirmations, of sentences that name an agency and move no
    label; an affirmation without a label is none."""
    text = F.col("text")
    first = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    value = lambda c: F.when(c == "downgrade", "negative").when(c == "upgrade", "positive").when(c == "evolving", "developing").otherwise(c)
    watch = value(F.lower(F.coalesce(first(w.WATCH), first(w.REVIEW))))
    outlook = F.when(text.rlike(w.MOVED), value(F.lower(first(w.OUTLOOK_TO))))
    kind = F.when(watch.isNotNull(), "watch").when(outlook.isNotNull(), "outlook_change").when(text.rlike(w.AFFIRMED), "affirmation")
    label = F.coalesce(first(LABEL_AT), first(LABEL_QUOTED), first(LABEL_NOUN))
    was = F.when(outlook.isNotNull(), value(F.lower(first(w.OUTLOOK_FROM))))
    named = F.try_element_at(F.regexp_extract_all(text, F.lit(rf"({AGENCY})"), F.lit(1)), F.lit(1))
    out = sents.where(text.rlike(AGENCY) & ~text.rlike(MOVE)).select("doc_id", "start", named.alias("named"), kind.alias("event_type"), label.alias("rating"), F.coalesce(watch, outlook).alias("value"), was.alias("was"))
    out = out.where("event_type is not null and (event_type != 'affirmation' or rating is not null)")
    return scales.resolve_agency(out, "named", "agency").select("doc_id", "start", "agency", "event_type", "rating", "value", "was")


def bond() -> tuple[Column, Column, Column]:
    """E-09: whether a sentence tells of a bond, which type of event, and why it gives none."""
    text = F.col("text")
    said = lambda *patterns: text.rlike("|".join(patterns))
    kind = F.when(said(w.NOT_CALLED), "non_call").when(said(w.REDEEMED), "redemption").when(said(w.TAPPED), "tap").otherwise("new_issue")
    skip = F.when(said(w.INTENT) & ~said(w.NOT_CALLED), "intent_only").when(said(w.TOTAL) & said(w.LOAN), "total_with_loan").when(tf.amount(text).isNull() & ~said(w.NOT_CALLED), "no_amount")
    return has_word(text, w.INSTRUMENTS) & said(w.INSTRUMENT) & said(w.COMPLETED, w.REDEEMED, w.NOT_CALLED, w.TAPPED, w.INTENT), kind, skip


def issuance(sents: DataFrame) -> DataFrame:
    """E-09, X-08: bond sentences with type, amount, coupon, tenor, seniority, maturity and greenness; `skip` says why one gives no event."""
    text = F.col("text")
    told, kind, skip = bond()
    senior = F.coalesce(*(F.when(text.rlike(w.phrase(names)), F.lit(s)) for s, names in w.SENIORITIES.items()))
    group = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    coupon = F.coalesce(group(w.COUPON_FIRST), group(w.COUPON_LAST)).try_cast("double")
    years = F.lower(group(w.TENOR))
    tenor = F.coalesce(years.try_cast("int"), F.try_element_at(F.create_map(*(F.lit(x) for pair in w.TENOR_WORDS.items() for x in pair)), years))
    return sents.where(told).select(
        "doc_id", "start", kind.alias("event_type"), tf.amount(text).alias("amount"), coupon.alias("coupon"), tenor.alias("tenor"), senior.alias("seniority"),
        group(w.DUE_YEAR).try_cast("int").alias("due"), text.rlike(w.GREEN).alias("green"), skip.alias("skip"),
    )


def reference_zone(docs: DataFrame, heading: str, lines: int = 12) -> DataFrame:
    """X-13: lines (doc_id, n, line) that follow a heading within so many lines."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    near = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-lines, -1)
    return each.withColumn("zone", F.coalesce(F.max(F.col("line").rlike(heading)).over(near), F.lit(False)))


#: Aliases that one automaton holds at most (some tens of MB); more are read in as many passes as they fill.
MOST_ALIASES = 500_000


def alias_hits(docs: DataFrame, aliases: DataFrame, chars: int = 3000, most: int = MOST_ALIASES) -> DataFrame:
    """J-03: (doc_id, issuer_id, alias): aliases that stand between word bounds, case aside, in a document's title (if it
    has that column) and first characters.

    The aliases are counted, dealt out by hash to blocks of about `most`, and each block is broadcast as one automaton
    that reads every head once. Only hits are shuffled, no text.
    """
    spark = docs.sparkSession
    known = aliases.select("issuer_id", F.trim(F.lower("alias")).alias("alias")).where("alias != ''").distinct()
    head = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, chars))
    heads = docs.select("doc_id", F.concat_ws("\n", F.lower("title"), head).alias("head") if "title" in docs.columns else head.alias("head"))

    def reader(table: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for alias, issuers in table.value.items():
                automaton.add_word(alias, (alias, issuers))
            automaton.make_automaton()
            word = lambda t, i: 0 <= i < len(t) and t[i].isascii() and t[i].isalnum()
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("head").to_pylist(), strict=True):
                    met = {alias: issuers for end, (alias, issuers) in automaton.iter(text) if not word(text, end + 1) and not word(text, end - len(alias))}
                    rows += [(doc, i, a) for a, issuers in met.items() for i in issuers]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_id", "issuer_id", "alias"])

        return read

    blocks, found = max(1, -(-known.count() // most)), []
    for block in range(blocks):
        table: dict[str, list[str]] = {}
        for row in known.where(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == block).toLocalIterator():
            table.setdefault(row.alias, []).append(row.issuer_id)
        if table:
            found.append(heads.mapInArrow(reader(spark.sparkContext.broadcast(table)), "doc_id long, issuer_id string, alias string"))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "doc_id long, issuer_id string, alias string")


def resolve_alias(docs: DataFrame, aliases: DataFrame, chars: int = 3000) -> DataFrame:
    """J-03: the only issuer that a document's head names, or that there are several; and the longest alias found."""
    by = alias_hits(docs, aliases, chars).groupBy("doc_id").agg(F.min("issuer_id").alias("a"), F.max("issuer_id").alias("b"), F.max_by("alias", F.struct(F.length("alias"), "alias")).alias("longest"))
    return by.select("doc_id", F.when(F.col("a") == F.col("b"), F.col("a")).alias("alias_issuer"), (F.col("a") != F.col("b")).alias("ambiguous"), "longest")


def resolve(docs: DataFrame, issuers: DataFrame, by_alias: DataFrame) -> DataFrame:
    """J-04: registry number, then hint, then alias. A number that is unknown, shared or against the hint leaves the document unresolved."""
    numbers = issuers.groupBy("cik").agg(F.count("*").alias("_n"), F.min("issuer_id").alias("_cik_issuer"))
    hints = issuers.select(F.col("issuer_id").alias("_hint")).distinct()
    out = docs.withColumn("cik", F.lpad("cik", 10, "0")).join(numbers, "cik", "left").join(hints, F.col("issuer_hint") == F.col("_hint"), "left").join(by_alias, "doc_id", "left")
    bad = F.col("cik").isNotNull() & (F.col("_cik_issuer").isNull() | (F.col("_n") > 1) | (F.col("issuer_hint") != F.col("_cik_issuer")))
    bad = F.coalesce(bad, F.lit(False))
    method = F.when(bad, "unresolved").when(F.col("_cik_issuer").isNotNull(), "cik").when(F.col("_hint").isNotNull(), "hint").when(F.col("alias_issuer").isNotNull(), "alias").otherwise("unresolved")
    issuer = F.when(bad, F.lit(None)).otherwise(F.coalesce("_cik_issuer", "_hint", "alias_issuer"))
    return out.select("doc_id", method.alias("method"), issuer.alias("issuer_id"))


def quote_places(statements: DataFrame, docs: DataFrame) -> DataFrame:
    """V-01, N-12: `match` is exact (text at the offsets is the quote), unique (it stands once elsewhere), or null; with the offsets found."""
    both = statements.join(docs.select(F.col("doc_id").alias("_d"), "text"), F.col("doc_id") == F.col("_d"))
    exact = F.substring(F.col("text"), F.col("s0").cast("int") + 1, (F.col("s1") - F.col("s0")).cast("int")) == F.col("quote")
    first = F.expr("instr(text, quote)")
    once = (first > 0) & (F.expr("locate(quote, text, instr(text, quote) + 1)") == 0)
    match = F.when(exact, "exact").when(once, "unique")
    start = F.when(exact, F.col("s0")).when(once, first - 1)
    return both.select(*statements.columns, match.alias("match"), start.alias("at"))


def numbers_match(quote: Column, bounds: list[Column]) -> Column:
    """V-03: every bound that is set is among the quote's numbers."""
    found = tf.numbers(quote)
    ok = F.lit(True)
    for b in bounds:
        ok = ok & (b.isNull() | F.exists(found, lambda x: F.abs(x - b) < 1e-9))
    return ok


def verdict(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """V-14: VALID if all checks hold, with the names of those that don't."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
    return df.withColumn("failed", failed).withColumn("verdict", F.when(F.size("failed") == 0, "VALID").otherwise("INVALID"))


def verify_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """L-08: citations like [F3] must exist, and each figure of a claim must stand in a cited fact."""
    cited = claims.select("claim_id", "text", F.explode_outer(F.regexp_extract_all("text", F.lit(r"\[F(\d+)\]"), F.lit(1))).alias("f"))
    both = cited.join(facts.select(F.col("fact_id").cast("string").alias("f"), F.col("text").alias("fact")), "f", "left")
    plain = F.regexp_replace("text", r"\[F\d+\]", "")
    by = both.groupBy("claim_id").agg(F.first("text").alias("text"), F.count("f").alias("n"), F.count_if(F.col("f").isNotNull() & F.col("fact").isNull()).alias("unknown"), F.flatten(F.collect_list(tf.numbers(F.coalesce("fact", F.lit(""))))).alias("have"))
    missing = F.array_except(tf.numbers(plain), F.col("have"))
    status = F.when(F.col("n") == 0, "no_citation").when(F.col("unknown") > 0, "unknown_fact").when(F.size(missing) > 0, "unsupported_figure").otherwise("verified")
    return by.withColumn("status", status)


QUARTER_ENDS = {"first": "-03-31", "second": "-06-30", "third": "-09-30", "fourth": "-12-31"}
QUARTER = rf"(?i)\b({'|'.join(QUARTER_ENDS)})[\s-]+quarter\b[^\d.;]{{0,20}}\b(20\d\d)\b"


def document_date(docs: DataFrame, head: int = 600) -> DataFrame:
    """N-09: (doc_id, day): the day of publication, else the first date in the text's first characters, else the URL's: an
    ISO date in its path, or the last spelled one, signs between words aside.

    docs: (doc_id, text, published, url). Only documents without a day of publication are read.
    """
    path = F.substring_index("url", "?", 1)
    iso = F.try_to_date(F.regexp_extract(path, r"20\d\d-\d\d-\d\d", 0), "yyyy-MM-dd")
    open_ = docs.where("published is null")
    first = dates(open_.select("doc_id", F.substring("text", 1, head).alias("text"))).groupBy("doc_id").agg(F.min_by("day", "start").alias("_head"))
    last = dates(open_.select("doc_id", F.regexp_replace(path, "[-_/]", " ").alias("text"))).groupBy("doc_id").agg(F.max_by("day", "start").alias("_url"))
    return docs.join(first, "doc_id", "left").join(last, "doc_id", "left").select("doc_id", F.coalesce("published", "_head", iso, "_url").alias("day"))


def latest_reference(docs: DataFrame) -> DataFrame:
    """X-04: the latest of a text's dates and ends of "nth quarter of year"; documents without any are left out."""
    nth, year = (F.regexp_extract_all("text", F.lit(QUARTER), F.lit(g)) for g in (1, 2))
    end_of = F.create_map(*(F.lit(x) for pair in QUARTER_ENDS.items() for x in pair))
    ends = docs.select("doc_id", F.explode(F.zip_with(nth, year, lambda n, y: F.to_date(F.concat(y, end_of[F.lower(n)])))).alias("day"))
    return dates(docs).select("doc_id", "day").unionByName(ends).groupBy("doc_id").agg(F.max("day").alias("latest"))


#: What ends a company's name.
SUFFIXES = "Inc GmbH AG N.V NV S.A SA SE S.p.A SpA Ltd Limited plc PLC LLC L.P Corp Corporation ASA AB Oyj B.V BV KGaA Aktiengesellschaft Company".split()
ENTITY = rf"((?:[A-Z][\w&']*,?\s){{1,7}}(?:{'|'.join(x.replace('.', chr(92) + '.') for x in sorted(SUFFIXES, key=len, reverse=True))}))(?:[^\w]|$)"


def named_entities(sents: DataFrame) -> DataFrame:
    """X-09: capitalised names that end in a corporate suffix, agencies apart."""
    names = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(1))
    return sents.select("doc_id", F.explode(names).alias("name")).where(~F.col("name").rlike(rf"\b(?:{AGENCY})\b")).distinct()


def agency_mentions(sents: DataFrame) -> DataFrame:
    """X-11: a row for each naming of an agency, with the sentence's start."""
    found = sents.select("doc_id", "start", F.explode(F.regexp_extract_all("text", F.lit(rf"({AGENCY})"), F.lit(1))).alias("named"))
    return scales.resolve_agency(found, "named", "agency").where("agency is not null")


def document_agency(docs: DataFrame, head: int = 600) -> DataFrame:
    """X-12: the only agency that a document names, else the only one in its first characters, else null."""
    mentions = lambda df: agency_mentions(df.withColumn("start", F.lit(0)))
    only = lambda df, name: df.groupBy("doc_id").agg(F.when(F.min("agency") == F.max("agency"), F.min("agency")).alias(name))
    whole = only(mentions(docs), "whole")
    first = only(mentions(docs.select("doc_id", F.substring("text", 1, head).alias("text"))), "first")
    return whole.join(first, "doc_id", "left").select("doc_id", F.coalesce("whole", "first").alias("agency"))


def suppress(found: DataFrame, releases: DataFrame) -> DataFrame:
    """E-10: what a results release recaps becomes a skip."""
    r = releases.select(F.col("doc_id").alias("_d"))
    return found.join(r, F.col("doc_id") == F.col("_d"), "left").select("doc_id", F.when(F.col("_d").isNotNull(), "recap").alias("skip"))


def extract_all(sents: DataFrame) -> DataFrame:
    """E-16, E-17: (doc_id, start, branch, skip) of all extractors; skip is null for what stands. sents: with `published`.

    All branches read a sentence in one pass; only what they found meets the scales, and flags the dates of their sentence.
    """
    some = sorted({*w.GUIDANCE_NEEDS, *w.FLAGS_NEED, *w.INSTRUMENTS, "from"})
    sents = sents.where(has_word(F.col("text"), some))  # most sentences have none of the words that any branch needs
    told, _, skip = bond()
    found = F.concat(
        moves(), F.transform(guidance_hits(), lambda s: _found("guidance")), F.transform(flag_hits(), lambda h: _found("flag", h["aside"], old=F.col("text"))),
        F.when(told, F.array(_found("issuance", skip))).otherwise(F.array().cast(MOVED)),
    )
    each = sents.select("doc_id", "start", "published", F.explode(found).alias("x")).select("doc_id", "start", "published", "x.*")
    past = (F.col("branch") == "flag") & historical(F.when(F.col("branch") == "flag", F.col("old")), F.col("published"))
    return judged(each.withColumn("skip", F.when(past, "historical").otherwise(F.col("skip")))).select("doc_id", "start", "branch", "skip")
