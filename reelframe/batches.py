"""Bounds on what Python gets, and makes, at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows that go to Python together, and the setting that bounds them.
BATCH, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Wide rows go to Python a few at a time: by bytes, unless the session has a bound of its own."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most rows rows, so that what is made of one doesn't grow with Spark's batches."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
