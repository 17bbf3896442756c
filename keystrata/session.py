"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: dict[str, list[str]] = {}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; a cluster's own values win."""
    builder = SparkSession.builder.appName("keystrata")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder ``spark.checkpoint.dir``. A local session without that
    setting, as in tests, gets a temporary folder, which the setting then names."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="keystrata-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the cluster's shared checkpoint folder and go on from
    there, so that later stages neither recompute it nor depend on live executors. A table
    rather than an RDD checkpoint lets each later stage read only the columns it needs and
    gives the planner sizes to go by.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/keystrata-{uuid.uuid4()}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_checkpoints(spark: SparkSession) -> int:
    """Deletes the tables that ``checkpointed`` wrote for this application so far, and says how
    many. DataFrames that still read them fail afterwards, so results are written first."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)
