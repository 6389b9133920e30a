"""Documents to decisions as they land, alert digests, and decisions that late events change: Structured Streaming."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bondsight.operators import rules

#: Hours between the digests of a priority; those without are sent at once.
DIGEST_HOURS = {"P2": 4, "P3": 24}
DAY_MS = 86_400_000


def new_documents(stream: DataFrame, ts: str, content: str, delay: str = "1 day") -> DataFrame:
    """ST-01: each content once within the watermark; restarts go on from the checkpoint."""
    return stream.withColumn("content_hash", F.sha2(content, 256)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])


def once(steps: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """ST-01: for foreachBatch: each step's rows of a batch, written below path/<step>/batch=<its number>.

    A step reads what the step before has written, so that all of a batch's tables tell the same. A batch that is begun
    again after a failure has the same number and the same input, and its folders are written anew as a whole: rows are
    there once, whatever was half done.
    """

    def batch(df: DataFrame, number: int) -> None:
        for name, step in steps.items():
            at = f"{path}/{name}/batch={number}"
            df = step(df)
            df.write.mode("overwrite").parquet(at)
            df = df.sparkSession.read.schema(df.schema).parquet(at)

    return batch


def digest(alerts: DataFrame, ts: str, hours: dict[str, int] | None = None, delay: str = "1 hour") -> DataFrame:
    """ST-02: one stream in tiers: (start, end, priority, n, event_keys).

    Alerts of a priority without a digest pass through at once, each its own row from its time to its time, however late.
    Those of the others wait in tumbling windows of effective time, which are sent when the watermark passes their end;
    rows that come late but before that are counted in their window.
    """
    hours = DIGEST_HOURS if hours is None else hours
    known = alerts.withWatermark(ts, delay)
    row = lambda df: df.select("start", "end", "priority", "n", "event_keys")
    at_once = alerts.where(~F.col("priority").isin(*hours)).select(F.col(ts).alias("start"), F.col(ts).alias("end"), "priority", F.lit(1).cast("long").alias("n"), F.array("event_key").alias("event_keys"))
    out = row(at_once)
    for priority, every in hours.items():
        windows = known.where(F.col("priority") == priority).groupBy(F.window(ts, f"{every} hours").alias("w"), "priority").agg(F.count("*").alias("n"), F.collect_list("event_key").alias("event_keys"))
        out = out.unionByName(row(windows.select("w.start", "w.end", "priority", "n", "event_keys")))
    return out


class Trailing(StatefulProcessor):
    """ST-03: an issuer's negative P2 events by effective day; an event decides anew the days it can change, and no others.

    State: the issuer's events as parallel lists, read and written once a batch. One timer stands for the earliest day: when
    the watermark has passed the last day that it can change, it drops all days that are done and is set for the next.
    """

    def __init__(self, days: int, least: int) -> None:
        self.span, self.least = days, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "days array<int>, keys array<bigint>, families array<string>, raises array<int>")

    def due(self, day: int) -> int:
        return (day + self.span + 1) * DAY_MS

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        days, keys, families, raises = (list(x) for x in self.held.get() or ((), (), (), ()))
        known, first = set(zip(days, keys, families, strict=True)), min(days, default=None)
        arrived, seen = set(), set()
        for r in rows:
            if (r.event_key, r.family) in seen:
                continue
            seen.add((r.event_key, r.family))
            arrived.add(r.day)
            if (r.day, r.event_key, r.family) not in known:
                for held, x in zip((days, keys, families, raises), (r.day, r.event_key, r.family, r.raises), strict=True):
                    held.append(x)
        self.held.update((days, keys, families, raises))
        if first is None or min(days) < first:
            self.handle.registerTimer(self.due(min(days)))
        order, come = sorted(days), sorted(arrived)
        within = lambda ordered, day: bisect_right(ordered, day) - bisect_left(ordered, day - self.span)
        for day, k, f, r in zip(days, keys, families, raises, strict=True):
            if within(come, day):
                recent = within(order, day)
                yield Row(issuer_id=key[0], event_key=k, family=f, raises=r, recent=recent, mod02=recent >= self.least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        left = [x for x in zip(*(self.held.get() or ((), (), (), ())), strict=True) if self.due(x[0]) > now]
        if left:
            self.held.update(tuple(list(x) for x in zip(*left, strict=True)))
            self.handle.registerTimer(self.due(min(x[0] for x in left)))
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def redecide(based: DataFrame, delay: str, window: int = rules.WINDOW_DAYS, least: int = rules.WINDOW_EVENTS) -> DataFrame:
    """ST-03: a stream of based events (issuer_id, event_key, family, eff, base_rank, negative, mod01, mod03) to decisions
    (event_key, family, priority, mod02, recent), again for each event that a later arrival changes.

    Only negative P2 events look at others, so only they are keyed by issuer and kept; the rest pass through. Events may
    come as late as `delay`; the decision of an event with the largest `recent` is the last, as counts only grow.
    """
    with_state_store(based.sparkSession)
    rows = based.withColumn("raises", F.coalesce(F.col("mod01").cast("int"), F.lit(0)) + F.coalesce(F.col("mod03").cast("int"), F.lit(0)))
    p2 = F.coalesce(F.col("negative") & (F.col("base_rank") == rules.RANK["P2"]), F.lit(False))
    done = lambda df, mod02, rank: df.select("event_key", "family", rules.named(rules.raised(rank, F.col("raises"), mod02)).alias("priority"), mod02.alias("mod02"), "recent")
    alone = done(rows.where(~p2 | F.col("eff").isNull()).withColumn("recent", F.lit(0).cast("long")), F.lit(False), F.col("base_rank"))
    timed = rows.where(p2 & F.col("eff").isNotNull()).withColumn("at", F.col("eff").cast("timestamp")).withWatermark("at", delay)
    timed = timed.select("issuer_id", "event_key", "family", "raises", F.unix_date("eff").alias("day"), "at")
    kept = timed.groupBy("issuer_id").transformWithState(Trailing(window, least), "issuer_id string, event_key long, family string, raises int, recent long, mod02 boolean", "Append", "EventTime")
    return alone.unionByName(done(kept, F.col("mod02"), F.lit(rules.RANK["P2"])))


def last_decisions(log: DataFrame) -> DataFrame:
    """ST-03: the decision that stands of each event."""
    return log.groupBy("event_key", "family").agg(F.max_by(F.struct("priority", "mod02"), "recent").alias("d")).select("event_key", "family", "d.*")

