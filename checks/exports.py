"""Checks of what is written: tables, exports and documents, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import asset_sql as A
from checks import assets
from keystrata.operators import components
from keystrata.session import checkpoint_folder
from keystrata.sources import documents, tables

QUERIES, SQL = {}, {}


def check(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return register


def target(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/export-{uuid.uuid4()}"


@check("csv_export", assets.SQL["inventory_export"])
def _(spark, sf):
    rows, path = assets.QUERIES["inventory_export"](spark, sf), target(spark)
    tables.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").option("escape", '"').csv(path)


@check("table_round_trip", assets.SQL["classify"])
def _(spark, sf):
    rows, path = assets.QUERIES["classify"](spark, sf), target(spark)
    tables.write_table(rows, path)
    return tables.read_table(spark, path, rows.schema)


@check("json_export", assets.SQL["to_components"])
def _(spark, sf):
    """Components with the field names of the format, a record a line."""
    path = target(spark)
    tables.write_json(tables.component_json(assets.component_table(spark, sf)), path)
    return _flat(spark.read.schema(_COMPONENT).json(path))


_COMPONENT = """type string, `bom-ref` string, name string, cryptoProperties struct<assetType:string,algorithmProperties:struct<primitive:string,
  parameterSetIdentifier:string,curve:string,mode:string,padding:string,classicalSecurityLevel:int,nistQuantumSecurityLevel:int>>,
  evidence struct<occurrences:array<struct<location:string,line:int,symbol:string>>>"""


def _flat(found: DataFrame) -> DataFrame:
    a = "cryptoProperties.algorithmProperties"
    return found.select(
        "type", F.col("`bom-ref`").alias("bom_ref"), "name", F.col("cryptoProperties.assetType").alias("asset_type"), F.col(f"{a}.primitive").alias("primitive"),
        F.col(f"{a}.parameterSetIdentifier").alias("parameter_set_identifier"), F.col(f"{a}.curve").alias("curve"), F.col(f"{a}.mode").alias("mode"),
        F.col(f"{a}.padding").alias("padding"), F.col(f"{a}.classicalSecurityLevel").alias("classical_security_level"), F.col(f"{a}.nistQuantumSecurityLevel").alias("nist_quantum_security_level"))


def _written(spark: SparkSession, sf: str, fmt: str) -> str:
    """A document of all components with their location as the one occurrence, packed."""
    parts, path = assets.component_table(spark, sf), target(spark)
    spots = parts.select("bom_ref", F.inline("evidence"))
    documents.write_bom(components.document_header(spark), parts, spots, path, fmt, compressed=True)
    return path


@check("document_json", assets.SQL["to_components"])
def _(spark, sf):
    found = documents.read_bom(spark, _written(spark, sf, "json"), _COMPONENT)
    return _flat(found.where("header.bomFormat = 'CycloneDX' and header.specVersion = '1.6' and header.version = 1").select("component.*"))


@check("document_occurrences", A.with_ctes(*assets._C, select="SELECT asset_id AS bom_ref, file_path AS location, CAST(start_line AS INT) AS line FROM facts"))
def _(spark, sf):
    component = "`_bom-ref` string, evidence struct<occurrences:struct<occurrence:array<struct<location:string,line:int>>>>"
    found = documents.read_bom_xml(spark, _written(spark, sf, "xml"), component).select("component.*")
    return found.select(F.col("`_bom-ref`").alias("bom_ref"), F.inline("evidence.occurrences.occurrence"))
