"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to ``BYTES`` if it is higher,
    so that a worker's memory hangs on neither the number nor the length of rows (a single
    longer row is a batch of its own)."""
    now = spark.conf.get(_SETTING, None)
    if now is None or not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BYTES:
        spark.conf.set(_SETTING, str(BYTES))


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of bounded size."""
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)
