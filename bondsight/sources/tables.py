"""Parsing of landed sources into tables, and sinks with insert-if-absent, upsert and partitioned files."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bondsight.functions import textfns as tf

#: Filing items and prospectus forms that make events, with the event's family.
ITEMS = [
    ("1.01", "other", "material_agreement"), ("2.01", "other", "acquisition_or_disposition"), ("2.02", "earnings", "earnings_release"), ("2.03", "issuance", "direct_financial_obligation"),
    ("2.04", "other", "obligation_acceleration"), ("2.06", "earnings", "material_impairment"), ("5.02", "other", "management_change"),
    ("424B2", "issuance", "prospectus_supplement"), ("424B5", "issuance", "prospectus_supplement"), ("FWP", "issuance", "free_writing_prospectus"),
]
#: Character sets that Spark's decode() knows besides UTF-8.
CHARSETS = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one of a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='spark-', dir='/tmp')).rstrip('/')}/bondsight-{uuid.uuid4().hex}"


def western(raw: Column) -> Column:
    """The Western code page: as ISO 8859-1 but for the bytes 80 to 9F."""
    odd = bytes(range(0x80, 0xA0))
    return F.translate(F.decode(raw, "iso-8859-1"), odd.decode("iso-8859-1"), odd.decode("cp1252", errors="replace"))


def decoded(raw: Column) -> Column:
    """N-04: UTF-8 if valid, else the charset that the first 4096 bytes declare, else the Western code page."""
    named = F.lower(F.regexp_extract(F.decode(F.substring(raw, 1, 4096), "iso-8859-1"), "(?i)charset=[\"']?([\\w-]+)", 1))
    declared = F.coalesce(*(F.when(named == c, F.decode(raw, c)) for c in CHARSETS))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), declared, western(raw))


def normaliser(content_type: Column, raw: Column, kind: Column) -> Column:
    """N-05: PDF by media type or by its first bytes, which nothing here reads; else by the kind of source."""
    media = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    pdf = (media == "application/pdf") | (F.coalesce(F.substring(raw, 1, 5), F.lit(b"")) == F.lit(b"%PDF-"))
    return F.when(pdf, "reject_pdf").when(kind == "ir", "issuer_page").otherwise("filing")


def document_kind(source_type: Column, stated: Column) -> Column:
    """N-08: filings are of one kind; other documents of what their provenance states, if anything."""
    return F.when(source_type == "edgar", "edgar").otherwise(F.coalesce(F.nullif(stated, F.lit("")), F.lit("other")))


def filings(index: DataFrame) -> DataFrame:
    """S-01: one row a filing of parallel arrays; rows without date or document go."""
    zipped = index.select("cik", F.posexplode(F.arrays_zip("form", "filingDate", "primaryDocument")).alias("i", "f"))
    return zipped.select("cik", "i", "f.*").where("filingDate is not null and primaryDocument is not null")


def filing_events(rows: DataFrame) -> DataFrame:
    """E-03."""
    known = rows.sparkSession.createDataFrame(ITEMS, "item string, family string, event_type string")
    return rows.withColumn("item", F.explode("items")).join(F.broadcast(known), "item")


def canonical_url(url: Column) -> Column:
    """S-06: no fragment, no download or disposition keys."""
    plain = F.regexp_replace(url, "#.*$", "")
    query = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike("^(disposition|download)(=|$)") & (p != ""))
    base = F.regexp_replace(plain, r"\?.*$", "")
    return F.when(F.size(query) > 0, F.concat_ws("?", base, F.array_join(query, "&"))).otherwise(base)


def page_title(html: Column) -> Column:
    """S-07."""
    return F.trim(F.regexp_replace(F.substring_index(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), " | ", 1), r"\s+", " "))


def page_links(pages: DataFrame, pattern: str, most: int) -> DataFrame:
    """S-05: a page's first `most` distinct links that match, in order."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"']+)"), F.lit(1))).alias("pos", "url"))
    links = links.where(F.col("url").rlike(pattern)).withColumn("url", canonical_url(F.col("url"))).groupBy("page_id", "url").agg(F.min("pos").alias("pos"))
    listed = links.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "url"))), 1, most).alias("l"))
    return listed.select("page_id", F.posexplode("l").alias("n", "x")).select("page_id", "n", "x.url")


def rebind(statements: DataFrame, docs: DataFrame) -> DataFrame:
    """J-22: `bound`: the text at a statement's offsets has the recorded hash."""
    both = statements.join(docs.select("doc_id", "text"), "doc_id")
    here = F.substring(F.col("text"), F.col("s0").cast("int") + 1, (F.col("s1") - F.col("s0")).cast("int"))
    return both.withColumn("bound", F.sha2(here, 256) == F.col("hash")).drop("text")


def sanitised(rows: DataFrame) -> DataFrame:
    """S-14: quotes give way to their hash and length."""
    return rows.withColumn("quote_sha256", F.sha2("quote", 256)).withColumn("quote_chars", F.length("quote")).drop("quote")


def insert_absent(spark: SparkSession, new: DataFrame, path: str, key: str) -> None:
    """S-12: rows whose key isn't there yet are appended."""
    try:
        old = spark.read.parquet(path).select(key)
        new = new.join(old, key, "left_anti")
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.dropDuplicates([key]).write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """S-12: the table with new rows in place of old ones of their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """S-13: JSON by day. Ranges of days and events share out the folders: a day lies in as few tasks as its rows ask for,
    and the files are as many as days and ranges, not their product."""
    by_range(alerts.withColumn("day", F.col("eff")), "day", "event_key").write.mode("overwrite").partitionBy("day").json(path)


def by_range(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in as many ranges as the session has shuffle partitions: small ones aren't joined, as each row may be a file."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def outlook_watch(text: Column) -> tuple[Column, Column]:
    """M-06: free text to outlook and watch; a watch leaves the outlook null, unknown text gives neither."""
    low = F.lower(F.trim(text))
    marked = lambda marks: reduce(lambda a, m: a | low.contains(m), marks, F.lit(False))
    watch = F.coalesce(*(F.when(marked(marks), w) for w, marks in tf.WATCHES.items()), F.lit("none"))
    return F.when((watch == "none") & low.isin(*tf.OUTLOOKS), low), watch


def partial_date(text: Column) -> Column:
    """M-07: only a full day is a date."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(text), "yyyy-MM-dd"))


#: How far a seed was verified, weakest first.
LADDER = ("UNVERIFIED", "SOURCE_FOUND", "VALUE_VERIFIED", "DATE_VERIFIED", "FULLY_VERIFIED")


def verified_at_least(level: Column, least: str) -> Column:
    """M-08."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LADDER)), level) >= LADDER.index(least) + 1, F.lit(False))


def load_seeds(raw: DataFrame) -> DataFrame:
    """S-08: seed rows with agency, notch, outlook, watch and date; `reject` says what can't be read."""
    from bondsight.functions.scales import label_to_notch, resolve_agency

    out = label_to_notch(resolve_agency(raw, "rating_agency", "agency"), "agency", "rating", "notch")
    outlook, watch = outlook_watch(F.col("outlook_text"))
    reject = F.when(F.col("agency").isNull(), "unknown agency").when(F.col("notch").isNull(), "unknown label")
    return out.select("row_id", "agency", "notch", outlook.alias("outlook"), watch.alias("watch"), partial_date(F.col("rating_date")).alias("as_of"), reject.alias("reject"))


def feed_entries(entries: DataFrame, since: Column, title: str, categories: list[str], most: int) -> DataFrame:
    """S-03: entries (feed, pos, link, title, published, categories) that fit, the first `most` of a feed."""
    fit = (F.col("link") != "") & (F.col("published").isNull() | (F.col("published") >= since)) & F.coalesce(F.col("title").rlike(title), F.lit(False))
    fit = fit & F.arrays_overlap(F.transform("categories", F.lower), F.array(*map(F.lit, categories)))
    kept = entries.where(fit).groupBy("feed").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "link"))), 1, most).alias("x"))
    return kept.select("feed", F.explode("x").alias("x")).select("feed", "x.pos", "x.link")


def sitemap_urls(rows: DataFrame, since: Column, prefix: str, most: int) -> DataFrame:
    """S-04: urls (site, loc, lastmod) below a prefix and not older, newest first (undated last), the first `most` of a site."""
    path = F.coalesce(F.parse_url("loc", F.lit("PATH")), F.lit("/"))
    fit = rows.where(path.startswith(prefix) & (F.col("lastmod").isNull() | (F.col("lastmod") >= since)))
    newest = F.struct(-F.coalesce(F.unix_date("lastmod"), F.lit(-999_999)).cast("long"), "loc")
    top = fit.groupBy("site").agg(F.slice(F.array_sort(F.collect_list(newest)), 1, most).alias("x"))
    return top.select("site", F.posexplode("x").alias("n", "x")).select("site", "n", "x.loc")


def read_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Feeds and site maps as rows."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_gold(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-11: JSON lines of gold documents or run rows."""
    return spark.read.schema(schema).json(path)


def alias_rows(universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-09: (issuer_id, alias) of names and aliases, and the aliases that several issuers claim."""
    each = universe.select("issuer_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), F.lower))).alias("alias"))
    shared = each.groupBy("alias").agg(F.count_distinct("issuer_id").alias("n")).where("n > 1").select("alias")
    return each, shared


def replayed(manifest: DataFrame, landed: DataFrame, since: Column) -> DataFrame:
    """S-15: manifest rows from a day on; `status` tells whether their bytes are there."""
    have = landed.select(F.col("raw_hash").alias("_h")).distinct()
    return manifest.where(F.col("day") >= since).join(have, F.col("raw_hash") == F.col("_h"), "left").withColumn("status", F.when(F.col("_h").isNull(), "missing_bytes").otherwise("present")).drop("_h")


def gold_build(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """C-10: labels (doc_id, quote, status) with what is wrong: the quote isn't in the text, or its wording doesn't support the status."""
    both = labels.join(docs.select("doc_id", "text"), "doc_id")
    problem = F.when(~F.contains("text", "quote"), "quote not found").when((F.col("status") == "breached") & ~F.col("quote").rlike(r"(?i)\bbreach"), "status not supported")
    return both.select("doc_id", (F.expr("instr(text, quote)") - 1).alias("start"), problem.alias("problem"))
