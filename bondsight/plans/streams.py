"""Streams driven to their end: landed documents to decisions, digests, decisions that late events change; landed bytes in batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondsight.functions import scales
from bondsight.operators import corpus as c
from bondsight.operators import rules
from bondsight.plans import twins as t
from bondsight.plans.rating import ALL, NAME, decided
from bondsight.plans.registry import Registry
from bondsight.sources import landed
from bondsight.sources import tables as src
from bondsight.sources.tables import shared_folder
from bondsight.sources.views import view
from bondsight.streaming import jobs

R = Registry()
SINCE = dt.date(2024, 3, 1)


def drained(stream: DataFrame, at: str | None = None) -> DataFrame:
    """All rows of an append stream over what is there now; with the same folder again, over what came since as well."""
    spark = stream.sparkSession
    at = at or shared_folder(spark)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def fetched(docs: DataFrame) -> DataFrame:
    """Documents as an adapter lands them."""
    return src.by_range(docs.select(
        F.col("published").alias("day"), "doc_id", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), F.coalesce("source", F.lit("other")).alias("kind"),
        F.lit("text/plain; charset=utf-8").alias("content_type"), "issuer_hint", F.col("text").cast("binary").alias("content"),
    ), "day", "doc_id")


def with_source(load) -> DataFrame:
    return load("v_documents").join(load("documents").select("doc_id", "source"), "doc_id")


@R.query("S02_select_filings", "SELECT doc_id, published AS filing_date, source AS form, sha256(text) AS raw_hash FROM v_documents JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE published >= DATE '2024-03-01' AND source IN ('src1', 'src2')")
def select_filings(load):
    docs = with_source(load)
    folder = shared_folder(docs.sparkSession)
    landed.land(fetched(docs), folder, 0)
    return landed.since(landed.read_landed(docs.sparkSession, folder), SINCE, ["src1", "src2"]).select("doc_id", F.col("day").alias("filing_date"), F.col("kind").alias("form"), "raw_hash")


@R.query("S15_fixture_replay", "SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM v_documents WHERE length(text) >= 600) THEN 'present' ELSE 'missing_bytes' END AS status FROM v_documents WHERE published >= DATE '2024-03-01'")
def fixture_replay(load):
    """Of a manifest of all documents, those of 600 signs or more have landed; equal content is the same bytes."""
    docs = with_source(load)
    folder = shared_folder(docs.sparkSession)
    landed.land(fetched(docs.where(F.length("text") >= 600)), folder, 0)
    manifest = docs.select("doc_id", F.col("published").alias("day"), F.sha2("text", 256).alias("raw_hash"))
    return src.replayed(manifest, landed.read_landed(docs.sparkSession, folder), F.lit(SINCE)).select("doc_id", "status")


def rating_events(docs: DataFrame) -> DataFrame:
    """New landed documents to the rating events that their sentences state."""
    texts = docs.select("doc_id", src.decoded(F.col("content")).alias("text"))
    found = c.judged(c.readings(c.sentences(texts), c.moves(), "m").select("doc_id", "start", "m.*")).where("skip is null")
    found = found.join(docs.select("doc_id", "content_hash", "issuer_hint", F.col("day").alias("eff")), "doc_id")
    kind = F.when(F.col("delta") > 0, "downgrade").when(F.col("delta") < 0, "upgrade").otherwise("affirmation")
    key = F.xxhash64("content_hash", "start", "agency", "old", "new").alias("event_key")
    return found.select(key, "content_hash", F.col("issuer_hint").alias("issuer_id"), "agency", "old", "new", "old_notch", "new_notch", kind.alias("event_type"), "eff")


def base_decisions(events: DataFrame) -> DataFrame:
    """The events with what the matrix says of them by themselves; later streams raise by other events."""
    given = events.select("event_key", "content_hash", "old", "new")
    known = rules.decide_base(rules.guidance_inputs(rules.shaped(events, "rating").withColumns({"state_outlook": F.lit(None).cast("string"), "state_notch": F.lit(None).cast("int"), "weakest_notch": F.lit(None).cast("int"), "other_ig": F.lit(False)})))
    return given.join(known, "event_key").select("event_key", "content_hash", "agency", "old", "new", F.array_join("triggered", ",").alias("triggered"), rules.named(F.col("base_rank")).alias("priority"))


_SAID = "SELECT sha256(text) AS content_hash, j.agency, j.old, j.new, o.notch AS o, n.notch AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k, min(doc_id) OVER (PARTITION BY sha256(text)) AS one, doc_id FROM judged j JOIN v_documents USING (doc_id) JOIN v_scale o ON o.agency = j.agency AND o.label = j.old JOIN v_scale n ON n.agency = j.agency AND n.label = j.new WHERE skip IS NULL"


@R.query("ST01_incremental_documents", """SELECT content_hash, agency, old, new, CASE WHEN agency = 'DBRS' THEN '' WHEN n - o >= 2 AND o <= 10 AND n > 10 THEN 'RAT-01,RAT-03' WHEN n - o >= 2 THEN 'RAT-03' WHEN n > o AND o <= 10 AND n > 10 THEN 'RAT-01' WHEN n > o THEN 'RAT-05' WHEN n < o AND o > 10 AND n <= 10 THEN 'RAT-08' WHEN n < o THEN 'RAT-09' ELSE 'RAT-10' END AS triggered,
CASE WHEN agency = 'DBRS' THEN NULL WHEN n - o >= 2 OR (n > o AND o <= 10 AND n > 10) THEN 'P1' WHEN n > o OR (n < o AND o > 10 AND n <= 10) THEN 'P2' ELSE 'P3' END AS priority FROM said WHERE doc_id = one""", **t.SENTS, moved=t.MOVED, judged=t.JUDGED, said=_SAID)
def incremental_documents(load):
    """Documents land three times; each landing streams to events and decisions, equal contents once; the third run finds nothing new."""
    docs = with_source(load)
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    at = shared_folder(spark)
    for number in range(2):
        landed.land(fetched(docs.where(F.pmod("doc_id", F.lit(2)) == number)), folder, number)
        arrivals(spark, folder, at)
    arrivals(spark, folder, at)
    return spark.read.parquet(f"{at}/decisions").select("content_hash", "agency", "old", "new", "triggered", "priority")


def arrivals(spark: SparkSession, folder: str, at: str, steps: dict | None = None) -> None:
    """Stream what has landed since the last run to at/events and at/decisions."""
    stream = landed.stream_landed(spark, folder).withColumn("at", F.col("day").cast("timestamp"))
    new = jobs.new_documents(stream, "at", "content", "500 days")
    batch = jobs.once(steps or {"events": rating_events, "decisions": base_decisions}, at)
    new.writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()


CLOSED = "SELECT time_bucket(INTERVAL {0} HOUR, ts) AS start, time_bucket(INTERVAL {0} HOUR, ts) + INTERVAL {0} HOUR AS \"end\", priority, count(*) AS n, min(event_id) AS least_key FROM arrived WHERE priority = '{1}' GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL {0} HOUR, ts) + INTERVAL {0} HOUR <= (SELECT max(ts) FROM arrived) - INTERVAL 1 HOUR"


@R.query("ST02_alert_digest", "SELECT ts AS start, ts AS \"end\", priority, CAST(1 AS BIGINT) AS n, event_id AS least_key FROM arrived WHERE priority = 'P1' UNION ALL " + " UNION ALL ".join(CLOSED.format(hours, p) for p, hours in jobs.DIGEST_HOURS.items()), arrived="SELECT CAST(ts AS TIMESTAMP) AS ts, event_id, CASE event_id % 3 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' ELSE 'P3' END AS priority FROM events")
def alert_digest(load):
    k = F.col("event_id") % 3
    s = load("events").select("ts", F.col("event_id").alias("event_key"), F.when(k == 0, "P1").when(k == 1, "P2").otherwise("P3").alias("priority"))
    return drained(jobs.digest(s, "ts")).select("start", "end", "priority", "n", F.array_min("event_keys").alias("least_key"))


R.queries["ST02_alert_digest"] = lambda spark, sf_dir: alert_digest(lambda _: source(spark, sf_dir))

BASED = ("issuer_id", "event_key", "family", "eff", "base_rank", "negative", "mod01", "mod03")


@R.query("ST03_trailing_negative_p2", f"SELECT event_key, family, {NAME.format('final_rank')} AS priority, mod02 FROM decided", **ALL)
def trailing_negative_p2(load):
    """Events arrive up to 59 days after their day, in three batches by arrival; each batch is a run that goes on from the last."""
    events = decided(load).select(*BASED).withColumn("arrival", F.date_add("eff", F.pmod(F.col("event_key"), F.lit(60)).cast("int")))
    spark, folder, at = events.sparkSession, shared_folder(events.sparkSession), shared_folder(events.sparkSession)
    events.write.parquet(f"{folder}/all")
    held = spark.read.schema(events.schema).parquet(f"{folder}/all")
    cuts = [dt.date(1900, 1, 1), dt.date(1997, 3, 1), dt.date(1999, 5, 1), dt.date(9999, 1, 1)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        held.where((F.col("arrival") >= F.lit(begin)) & (F.col("arrival") < F.lit(end))).drop("arrival").write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(held.drop("arrival").schema).parquet(f"{folder}/arrived")
        log = drained(jobs.redecide(stream, "60 days"), at)
    return jobs.last_decisions(log)
