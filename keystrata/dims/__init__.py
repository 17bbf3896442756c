"""Reference data as small DataFrames.

Every table here is a fixed list of at most about a hundred rows, so joining to
it with a broadcast is safe at any data size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.dims import algorithms, apis, libraries, patterns, symbols


def local_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small constant table. Arrow input gives Spark a local relation, whose
    size the optimizer knows, instead of a scan over a Python RDD."""
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def small(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return F.broadcast(local_table(spark, rows))


def registries(spark: SparkSession) -> dict[str, DataFrame]:
    """All dimension tables by name."""
    return {
        "dim_algorithm": local_table(spark, algorithms.algorithm_rows()),
        "dim_algorithm_alias": local_table(spark, algorithms.alias_rows()),
        "dim_library": local_table(spark, libraries.library_rows()),
        "dim_api": local_table(spark, apis.api_rows()),
        "dim_pattern": local_table(spark, patterns.pattern_rows()),
        "dim_symbol": local_table(spark, symbols.symbol_rows()),
        "dim_symbol_prefix": local_table(spark, symbols.prefix_rows()),
    }
