"""Landed bytes as a data source: what adapters have fetched lies in numbered landings and is read in batch or as a stream.

Layout of a landing folder: landing=<number>/day=<date>/*.parquet with the columns of SCHEMA but the first two. A landing
counts when its _SUCCESS file is there, so that half-written ones are never seen. A file is a partition. A filter on the
day (from a day on, up to one, on one) and on the landing is taken by the source and prunes folders before any file is
opened. The offset of a stream is the number of the last landing, so that a restart reads the same landings again.
Files are opened by pyarrow's file systems, by the folder's URI, on the driver for names only and in the tasks for rows.
"""

from __future__ import annotations

import datetime as dt
import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "landing int, day date, doc_id long, url string, kind string, content_type string, issuer_hint string, raw_hash string, content binary"
BATCH_ROWS = 1024
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class LandedFile(InputPartition):
    path: str
    landing: int
    day: dt.date


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (fs.LocalFileSystem(), folder)


def landings(folder: str) -> list[int]:
    """The numbers of the landings that are complete."""
    from pyarrow import fs

    files, root = file_system(folder)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    numbers = [int(x.base_name.removeprefix("landing=")) for x in found if x.base_name.startswith("landing=")]
    done = files.get_file_info([f"{root}/landing={n}/_SUCCESS" for n in numbers])
    return sorted(n for n, x in zip(numbers, done, strict=True) if x.type == fs.FileType.File)


def landed_files(folder: str, numbers: Iterable[int], wanted=lambda landing, day: True) -> list[LandedFile]:
    """The files of some landings whose landing and day are wanted; other days' folders aren't listed."""
    from pyarrow import fs

    files, root = file_system(folder)
    out = []
    for n in numbers:
        for at in files.get_file_info(fs.FileSelector(f"{root}/landing={n}")):
            if not at.base_name.startswith("day="):
                continue
            day = dt.date.fromisoformat(at.base_name.removeprefix("day="))
            if wanted(n, day):
                out += [LandedFile(x.path, n, day) for x in files.get_file_info(fs.FileSelector(at.path)) if x.base_name.endswith(".parquet")]
    return sorted(out, key=lambda x: x.path)


def read_file(folder: str, schema: StructType, part: LandedFile | None) -> Iterator[pa.RecordBatch]:
    """A file's rows by batches; Spark asks for a partition of None where there are no files."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    if part is None:
        return
    files, _ = file_system(folder)
    target = to_arrow_schema(schema)
    with files.open_input_file(part.path) as f:
        held = pq.ParquetFile(f)
        names = [n for n in target.names if n not in ("landing", "day")]
        for batch in held.iter_batches(BATCH_ROWS, columns=names):
            own = {"landing": pa.array([part.landing] * len(batch), pa.int32()), "day": pa.array([part.day] * len(batch), pa.date32())}
            yield pa.RecordBatch.from_arrays([(own[x.name] if x.name in own else batch.column(x.name)).cast(x.type) for x in target], schema=target)


class LandedReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.of_schema, self.tests = folder, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of day and landing with a value are taken; all others stay with Spark."""
        for f in filters:
            if type(f) in COMPARED and f.attribute in (("day",), ("landing",)):
                self.tests.append((f.attribute[0], COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[LandedFile]:
        def wanted(landing: int, day: dt.date) -> bool:
            return all(test({"landing": landing, "day": day}[name], value) for name, test, value in self.tests)

        return landed_files(self.folder, landings(self.folder), wanted)

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return read_file(self.folder, self.of_schema, partition)


class LandedStream(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.of_schema = folder, schema

    def initialOffset(self) -> dict:
        return {"landing": -1}

    def latestOffset(self) -> dict:
        return {"landing": max(landings(self.folder), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        return landed_files(self.folder, (n for n in landings(self.folder) if start["landing"] < n <= end["landing"]))

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return read_file(self.folder, self.of_schema, partition)

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    """spark.read.format("landed").load(folder), and readStream."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> LandedStream:
        return LandedStream(self.options["path"], schema)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Landed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_landed(spark: SparkSession, folder: str) -> DataFrame:
    return _registered(spark).read.format("landed").load(folder)


def stream_landed(spark: SparkSession, folder: str) -> DataFrame:
    return _registered(spark).readStream.format("landed").load(folder)


def land(docs: DataFrame, folder: str, number: int) -> None:
    """Write one landing: docs (day, doc_id, url, kind, content_type, issuer_hint, content), their hash added."""
    rows = docs.select("day", F.col("doc_id").cast("long"), "url", "kind", "content_type", "issuer_hint", F.sha2("content", 256).alias("raw_hash"), F.col("content").cast("binary"))
    rows.write.partitionBy("day").parquet(f"{folder}/landing={number}", mode="overwrite")


def since(landed: DataFrame, day: dt.date, forms: list[str] | None = None) -> DataFrame:
    """S-02: what landed for a day or later (the source opens no other folder), of the wanted kinds."""
    return landed.where(F.col("day") >= F.lit(day)).where(F.col("kind").isin(*forms) if forms else F.lit(True))
