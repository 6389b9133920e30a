"""Streams: restarts in mid-batch, late rows, tiers, landed bytes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bondsight.operators import rules
from bondsight.plans import streams
from bondsight.sources import landed
from bondsight.streaming import jobs

DAY = dt.date(2024, 3, 1)
FETCHED = "day date, doc_id long, url string, kind string, content_type string, issuer_hint string, content binary"


def rows(*docs):
    return [(d, i, f"https://x/{i}", kind, "text/plain", f"ISS{i % 3}", text.encode()) for i, d, kind, text in docs]


def put(spark, folder, number, *docs):
    landed.land(spark.createDataFrame(rows(*docs), FETCHED), folder, number)


def test_landed_bytes_in_batch(spark, tmp_path):
    """Days and landings are pruned before files are opened; a landing without its mark isn't there."""
    folder = str(tmp_path / "in")
    put(spark, folder, 0, (1, DAY, "edgar", "a"), (2, DAY + dt.timedelta(1), "press", "b"))
    put(spark, folder, 1, (3, DAY + dt.timedelta(1), "edgar", "c"), (4, DAY + dt.timedelta(9), "edgar", "a"))
    got = landed.read_landed(spark, folder)
    assert {(r.landing, r.doc_id, r.day, bytes(r.content)) for r in got.collect()} == {(0, 1, DAY, b"a"), (0, 2, DAY + dt.timedelta(1), b"b"), (1, 3, DAY + dt.timedelta(1), b"c"), (1, 4, DAY + dt.timedelta(9), b"a")}
    some = landed.since(got, DAY + dt.timedelta(1), ["edgar"])
    assert {r.doc_id for r in some.select("doc_id").collect()} == {3, 4}
    assert some.rdd.getNumPartitions() < got.rdd.getNumPartitions()
    reader = landed.LandedReader(folder, got.schema)
    rest = list(reader.pushFilters([landed.GreaterThanOrEqual(("day",), DAY + dt.timedelta(2)), landed.EqualTo(("kind",), "edgar"), landed.EqualTo(("landing",), 1)]))
    assert [f.attribute for f in rest] == [("kind",)] and [p.day for p in reader.partitions()] == [DAY + dt.timedelta(9)]
    (tmp_path / "in" / "landing=1" / "_SUCCESS").unlink()
    assert landed.landings(folder) == [0] and landed.read_landed(spark, folder).count() == 2
    assert landed.read_landed(spark, str(tmp_path / "none")).count() == 0


def test_restart_in_mid_batch_gives_no_double_row(spark, tmp_path):
    """The second step of the second batch fails once; after the restart every event and decision is there once."""
    folder, at, plain = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "plain")
    told = ["S&P downgraded it from BBB- to BB+.", "Moody's lowered it from A1 to A3.", "Fitch upgraded it from BB to BB+.", "S&P downgraded it from A to A-.", "S&P downgraded it from BBB- to BB+."]
    put(spark, folder, 0, (0, DAY, "press", told[0]), (1, DAY, "press", told[1]))
    streams.arrivals(spark, folder, at)
    put(spark, folder, 1, (2, DAY + dt.timedelta(3), "press", told[2]), (3, DAY - dt.timedelta(5), "press", told[3]), (4, DAY, "press", told[4]))
    failed = []

    def broken(events):
        failed.append(events.count())
        raise RuntimeError("lost")

    with pytest.raises(Exception):  # noqa: B017, PT011  what a failed query raises depends on where it fails
        streams.arrivals(spark, folder, at, {"events": streams.rating_events, "decisions": broken})
    assert failed == [2]  # the fifth document's content has been there before
    streams.arrivals(spark, folder, at)
    streams.arrivals(spark, folder, at)
    streams.arrivals(spark, folder, plain)
    read = lambda base, name: sorted(tuple(r) for r in spark.read.parquet(f"{base}/{name}").drop("batch").select("agency", "old", "new").collect())
    assert read(at, "events") == read(at, "decisions") == read(plain, "events") == read(plain, "decisions") == [("FITCH", "BB", "BB+"), ("MOODYS", "A1", "A3"), ("SP", "A", "A-"), ("SP", "BBB-", "BB+")]
    first = {(r.old, r.new): (r.triggered, r.priority) for r in spark.read.parquet(f"{at}/decisions").collect()}
    assert first == {("BB", "BB+"): ("RAT-09", "P3"), ("A1", "A3"): ("RAT-03", "P1"), ("A", "A-"): ("RAT-05", "P2"), ("BBB-", "BB+"): ("RAT-01", "P1")}


BASED = "issuer_id string, event_key long, family string, eff date, base_rank int, negative boolean, mod01 boolean, mod03 boolean"


def test_late_events_decide_anew(spark, tmp_path):
    """Four batches whose events come up to 60 days late: the last decisions are those of one batch over all."""
    rng = random.Random(2)
    made = [(f"I{rng.randint(0, 2)}", k, rng.choice(["rating", "earnings"]), DAY + dt.timedelta(rng.randint(0, 260)), rng.choice([0, 1, 2, 2, 2, 3]), rng.random() < 0.8, rng.random() < 0.2, rng.random() < 0.2) for k in range(160)]
    made.append(("I0", 900, "rating", None, 2, True, False, False))
    arrived = sorted(made, key=lambda r: (r[3] or DAY) + dt.timedelta(r[1] * 7 % 60))
    folder, at = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        part = arrived[k * 41 : (k + 1) * 41]
        spark.createDataFrame(part + part[:3], BASED).coalesce(1).write.mode("append").parquet(folder)  # some are sent twice
        log = streams.drained(jobs.redecide(spark.readStream.schema(BASED).parquet(folder), "60 days"), at)
    got = {(r.event_key, r.family): (r.priority, r.mod02) for r in jobs.last_decisions(log).collect()}
    based = spark.createDataFrame([r for r in made if r[3]], BASED).withColumns({"triggered": F.array().cast("array<string>"), "weakest_notch": F.when(F.col("mod01"), 10)})
    known = based.where("mod03").select("issuer_id", F.col("eff").alias("as_of"), F.lit(9.0).alias("leverage")).limit(0)
    want = {(r.event_key, r.family): r.mod02 for r in rules.decide(based, known).collect()} | {(900, "rating"): False}
    assert {k: v[1] for k, v in got.items()} == want and 5 < sum(want.values()) < 150
    rank = {r[1]: (r[4], r[6] + r[7]) for r in made}
    for (key, _), (priority, mod02) in got.items():
        base, by = rank[key]
        assert priority == (None if base == 0 else "P1" if mod02 else {3: "P1", 2: "P2", 1: "P3"}[min(3, base + by)])
    again = log.groupBy("event_key", "family").count().where("count > 1").count()
    assert 0 < again < 120  # only events that a later arrival can change are sent again


def test_digests_in_tiers(spark, tmp_path):
    """P1 at once, P2 by four hours, P3 by a day; rows late within the delay count, later ones only if P1."""
    at, folder, out = dt.datetime(2024, 3, 1, 1), str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, event_key long, priority string"
    hour = lambda h: at + dt.timedelta(hours=h)
    batches = [
        [(hour(0), 1, "P2"), (hour(2), 2, "P2"), (hour(0), 3, "P3"), (hour(1), 4, "P1")],
        [(hour(2.5), 5, "P2"), (hour(5), 6, "P2"), (hour(1), 7, "P3")],  # 5 is late, but its window is still open
        [(hour(0), 8, "P2"), (hour(0), 9, "P1"), (hour(40), 10, "P2"), (hour(6), 11, "P3")],  # 8 is too late, 9 passes
        [(hour(80), 12, "P3")],
    ]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
        found = streams.drained(jobs.digest(spark.readStream.schema(schema).parquet(folder), "ts"), out)
    got = {(r.priority, r.start.hour, r.n, tuple(sorted(r.event_keys))) for r in found.collect()}
    assert got == {("P1", 2, 1, (4,)), ("P1", 1, 1, (9,)), ("P2", 0, 3, (1, 2, 5)), ("P2", 4, 1, (6,)), ("P2", 16, 1, (10,)), ("P3", 0, 3, (3, 7, 11))}
