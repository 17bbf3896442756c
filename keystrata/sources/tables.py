"""Reading and writing of stage tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators.components import FIXED_SERIAL, NAMESPACE


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A persisted stage table with its declared schema."""
    return spark.read.schema(schema).format(fmt).load(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by scan where the table has one."""
    writer = df.write.mode(mode)
    by = partition_by if partition_by is not None else [c for c in ("scan_id",) if c in df.columns]
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One record per line; fields without a value are left out. The part files are compressed."""
    df.write.mode(mode).option("ignoreNullFields", "true").option("compression", "gzip").json(path)


def write_csv(inventory: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Compressed part files, each with a header."""
    inventory.write.mode(mode).option("header", "true").option("escape", '"').option("compression", "gzip").csv(path)


def component_xml(components: DataFrame) -> DataFrame:
    """Components shaped for the XML source: attributes carry a leading underscore."""
    cp, ap = F.col("crypto_properties"), F.col("crypto_properties.algorithm_properties")
    return components.select(
        F.col("type").alias("_type"),
        F.col("bom_ref").alias("_bom-ref"),
        "name",
        F.struct(
            cp["asset_type"].alias("assetType"),
            F.when(ap.isNotNull(), F.struct(
                ap["primitive"].alias("primitive"),
                ap["execution_environment"].alias("executionEnvironment"),
                ap["parameter_set_identifier"].alias("parameterSetIdentifier"),
                ap["curve"].alias("curve"),
                ap["mode"].alias("mode"),
                ap["padding"].alias("padding"),
                ap["classical_security_level"].alias("classicalSecurityLevel"),
                ap["nist_quantum_security_level"].alias("nistQuantumSecurityLevel"),
            )).alias("algorithmProperties"),
        ).alias("cryptoProperties"),
        F.struct(F.struct(F.col("evidence").alias("occurrence")).alias("occurrences")).alias("evidence"),
        F.struct(F.transform("properties", lambda p: F.struct(
            p["name"].alias("_name"), p["value"].alias("_VALUE")
        )).alias("property")).alias("properties"),
    )


def write_xml(components: DataFrame, path: str, mode: str = "overwrite", serial: str = FIXED_SERIAL) -> None:
    """XML part files, each a bom document with the serial number and its share of the
    components."""
    (
        component_xml(components).write.mode(mode).format("xml")
        .option("rootTag", f'bom xmlns="{NAMESPACE}" serialNumber="{serial}" version="1"')
        .option("rowTag", "component")
        .save(path)
    )


def write_document(header: DataFrame, components: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A whole document in JSON: the header below ``header``, components below ``components``."""
    head = header.select(
        F.col("bom_format").alias("bomFormat"), F.col("spec_version").alias("specVersion"), F.col("serial_number").alias("serialNumber"), "version",
        F.struct("timestamp", F.struct(F.array(F.struct(
            F.col("tool_type").alias("type"), F.col("tool_name").alias("name"), F.col("tool_version").alias("version"))).alias("components")).alias("tools")).alias("metadata"))
    write_json(head, f"{path}/header", mode)
    write_json(component_json(components), f"{path}/components", mode)


def component_json(components: DataFrame) -> DataFrame:
    """Components with the field names of the JSON format."""
    cp, ap = F.col("crypto_properties"), F.col("crypto_properties.algorithm_properties")
    return components.select(
        "type",
        F.col("bom_ref").alias("bom-ref"),
        "name",
        F.struct(
            cp["asset_type"].alias("assetType"),
            F.when(ap.isNotNull(), F.struct(
                ap["primitive"].alias("primitive"),
                ap["execution_environment"].alias("executionEnvironment"),
                ap["parameter_set_identifier"].alias("parameterSetIdentifier"),
                ap["curve"].alias("curve"),
                ap["mode"].alias("mode"),
                ap["padding"].alias("padding"),
                ap["classical_security_level"].alias("classicalSecurityLevel"),
                ap["nist_quantum_security_level"].alias("nistQuantumSecurityLevel"),
            )).alias("algorithmProperties"),
        ).alias("cryptoProperties"),
        F.struct(F.col("evidence").alias("occurrences")).alias("evidence"),
        "properties",
    )
