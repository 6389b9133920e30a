"""What the operators share on the Spark side: input columns, the shared folder, batch limits."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into numpy arrays at a time.
BATCH_BYTES = 2 << 20

TEXT_WORDS = r"[^\x20\x09-\x0D]+"


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches held to a size that a task's arrays can bear."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="bondsight-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one in spark.checkpoint.dir; where that is unset, a temporary one of a local session (tests),
    and an error on a cluster, whose executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or _own_dir()).rstrip('/')}/bondsight-{uuid.uuid4().hex}"


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, and the rows outlive executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As settle, but stored in buckets by the key: what groups or joins by it alone reads it without a shuffle."""
    name = f"bondsight_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", shared_dir(df.sparkSession)).saveAsTable(name)
    return df.sparkSession.table(name)


def dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """bucketed, after one shuffle by the key, so that a bucket is one file."""
    return bucketed(df.repartition(buckets, key), key, buckets)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a settled folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; others, whatever their names, go."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def documents(df: DataFrame, *more: str) -> DataFrame:
    return columns(df, doc_id="long", text="string", **dict.fromkeys(more, "string"))


def crc_rest(of: Column, divisor: int) -> Column:
    """crc32 of the value's decimal text, modulo; a null value counts as the empty string."""
    return F.crc32(F.coalesce(of.cast("string"), F.lit("")).cast("binary")) % divisor


def text_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(df: DataFrame, total: float, each: float = 12e6) -> int:
    """Buckets of about `each` bytes; at least as many as shuffle partitions, so that no task stays idle."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / each) + 1)
