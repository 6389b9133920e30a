"""Python over texts in shares of bounded size, so that a task's memory doesn't follow the rows of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a task turns into Python objects at a time, and bytes of an Arrow batch.
SHARE_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
KINDS = {"long": pa.int64(), "string": pa.string(), "date": pa.date32()}


def shares(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut after each SHARE_BYTES of the column; a share holds one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + SHARE_BYTES, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def held(df: DataFrame) -> DataFrame:
    """The frame, its session's Arrow batches held to a size that a task can bear."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def each_text(df: DataFrame, key: str, text: str, found: Callable[[str], list[tuple]], fields: str, *keep: str) -> DataFrame:
    """(key, fields, keep): a row for each tuple that `found` gives for a text, null being the empty one."""
    own = held(df).select(key, text, *keep)
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in shares(batches, text):
            each = [found(x or "") for x in share.column(text).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            columns = [pa.array([row[i] for rows in each for row in rows], KINDS[kind]) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([share.column(key).take(at), *columns, *(share.column(c).take(at) for c in keep)], names=[key, *names, *keep])

    kept = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(read, f"{key} long, {fields}{kept}")
