"""Component documents: one valid file each, read back by plain parsers."""

import gzip
import json
import os
import xml.etree.ElementTree as ET
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from checks.assets import component_table
from checks.compare import DATA
from keystrata.operators import components
from keystrata.operators.components import FIXED_SERIAL
from keystrata.sources import documents

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
NS = "{http://cyclonedx.org/schema/bom/1.6}"


@pytest.fixture(scope="module")
def tables(spark):
    parts = component_table(spark, SF)
    spots = parts.where("hash(bom_ref) % 3 <> 0").select(
        F.col("bom_ref"), F.explode(F.sequence(F.lit(0), F.pmod(F.hash("bom_ref"), F.lit(4)))).alias("k")).select(
        "bom_ref", F.concat_ws(":", F.lit("f"), "bom_ref", "k").alias("finding_id"), F.col("k").cast("long").alias("emit_seq"),
        F.lit('a "b" <c> & d.py').alias("location"), (F.col("k") + 1).alias("line"), F.when(F.col("k") > 1, "x\ny").alias("symbol"))
    return parts, spots.unionAll(spots.where("k = 0"))  # some occurrences twice


def test_json(spark, tables, tmp_path):
    parts, spots = tables
    path = str(tmp_path / "bom.json")
    size = documents.write_bom(components.document_header(spark), parts, spots, path)
    assert os.listdir(tmp_path) in (["bom.json"], [".bom.json.crc", "bom.json"], ["bom.json", ".bom.json.crc"]) and os.path.getsize(path) == size
    found = json.load(open(path, encoding="utf-8"))
    assert (found["bomFormat"], found["serialNumber"], found["version"]) == ("CycloneDX", FIXED_SERIAL, 1)
    assert found["metadata"]["tools"]["components"][0]["name"] == "keystrata"
    refs = [c["bom-ref"] for c in found["components"]]
    assert refs == sorted(r["bom_ref"] for r in parts.collect()) and len(set(refs)) == len(refs)
    want = defaultdict(list)
    for r in spots.collect():
        want[r["bom_ref"]].append((r["location"], r["line"], r["symbol"]))
    got = {c["bom-ref"]: [(o.get("location"), o.get("line"), o.get("symbol")) for o in c["evidence"]["occurrences"]] for c in found["components"]}
    key = lambda x: (x[1], str(x[2]))
    assert all(sorted(got[r], key=key) == sorted(want[r], key=key) for r in refs)
    assert all(c["cryptoProperties"]["assetType"] for c in found["components"])


def test_xml(spark, tables, tmp_path):
    parts, spots = tables
    path = str(tmp_path / "bom.xml")
    documents.write_bom(components.document_header(spark), parts, spots, path, "xml")
    root = ET.parse(path).getroot()
    assert root.tag == NS + "bom" and root.get("serialNumber") == FIXED_SERIAL
    assert root.findtext(f"{NS}metadata/{NS}tools/{NS}components/{NS}component/{NS}name") == "keystrata"
    found = root.findall(f"{NS}components/{NS}component")
    assert [c.get("bom-ref") for c in found] == sorted(r["bom_ref"] for r in parts.collect())
    assert sum(len(c.findall(f"{NS}evidence/{NS}occurrences/{NS}occurrence")) for c in found) == spots.count()
    assert all(c.findtext(f"{NS}cryptoProperties/{NS}assetType") and c.findtext(f"{NS}name") for c in found)
    assert [x.tag.removeprefix(NS) for x in found[0]] == ["name", "properties", "evidence", "cryptoProperties"]


def test_empty_document(spark, tables, tmp_path):
    parts, spots = (x.limit(0) for x in tables)
    for fmt in ("json", "xml"):
        documents.write_bom(components.document_header(spark), parts, spots, str(tmp_path / fmt), fmt)
    assert json.load(open(tmp_path / "json"))["components"] == []
    assert len(ET.parse(tmp_path / "xml").getroot().find(f"{NS}components")) == 0


def test_whole_or_not_at_all(spark, tables, tmp_path, monkeypatch):
    parts, spots = tables
    head, path = components.document_header(spark), str(tmp_path / "bom.json")
    for bad in (parts.unionAll(parts.limit(1)), parts.withColumn("bom_ref", F.lit(None).cast("string"))):
        with pytest.raises(documents.InvalidDocument):
            documents.write_bom(head, bad, spots, path)
    with pytest.raises(documents.InvalidDocument):
        documents.write_bom(head.withColumn("serial_number", F.lit("none")), parts, spots, path)
    with pytest.raises(documents.InvalidDocument):
        documents.write_bom(head.limit(0), parts, spots, path)
    whole = documents.joined
    monkeypatch.setattr(documents, "joined", lambda spark, folder, path, size: whole(spark, folder, path, size + 1))
    with pytest.raises(OSError):
        documents.write_bom(head, parts, spots, path)
    assert os.listdir(tmp_path) in ([], [".bom.json.crc"])


def test_json_is_read_component_by_component(spark, tables, tmp_path):
    """No task reads the document as one row; values may hold what closes a component."""
    head, parts = components.document_header(spark), tables[0]
    spots = parts.select("bom_ref", F.lit("a\n]}}\nb").alias("location"), F.lit(1).alias("line"), F.lit('"').alias("symbol"))
    path = str(tmp_path / "bom.json")
    documents.write_bom(head, parts, spots.unionByName(spots), path)
    found = documents.read_bom(spark, path, "`bom-ref` string, evidence struct<occurrences:array<struct<location:string,line:int,symbol:string>>>")
    rows = found.select("header.version", "component.*").collect()
    assert sorted(r["bom-ref"] for r in rows) == sorted(r[0] for r in parts.select("bom_ref").collect())
    assert all(r["version"] == 1 and [x["location"] for x in r["evidence"]["occurrences"]] == ["a\n]}}\nb"] * 2 for r in rows)
    documents.write_bom(head, parts.limit(0), spots, path)
    assert documents.read_bom(spark, path, "`bom-ref` string").count() == 0


def test_exports_are_compressed(spark, tmp_path):
    from keystrata.sources import tables as exports

    rows = spark.createDataFrame([("a\nb", 1)], "name string, n int")
    exports.write_csv(rows, str(tmp_path / "csv"))
    exports.write_json(rows, str(tmp_path / "json"))
    parts = [x for d in ("csv", "json") for x in os.listdir(tmp_path / d) if x.startswith("part-")]
    assert parts and all(x.endswith(".gz") for x in parts)
    assert spark.read.json(str(tmp_path / "json")).select("name", "n").collect() == rows.collect()


def test_packed_is_the_plain_document(spark, tables, tmp_path, monkeypatch):
    """One gzip file that any tool unpacks, cut into members of whole components, and read back
    as the plain document is; the plain text lies on no disk."""
    monkeypatch.setattr(documents, "_MEMBER", 1)  # each batch of rows ends one
    head, (parts, spots) = components.document_header(spark), tables
    spots = spots.unionByName(spots.limit(1).withColumn("bom_ref", F.lit("of no component")))
    schema = {"json": "`bom-ref` string, evidence struct<occurrences:array<struct<location:string,line:int,symbol:string>>>",
              "xml": "`_bom-ref` string, evidence struct<occurrences:struct<occurrence:array<struct<location:string,line:int>>>>"}
    for fmt, read in (("json", documents.read_bom), ("xml", documents.read_bom_xml)):
        plain, packed = str(tmp_path / f"plain.{fmt}"), str(tmp_path / f"packed-{fmt}")
        documents.write_bom(head, parts, spots, plain, fmt)
        assert documents.write_bom(head, parts, spots, packed, fmt, compressed=True) == os.path.getsize(packed)
        text = open(plain, "rb").read()
        assert gzip.open(packed).read() == text and 5 * os.path.getsize(packed) < len(text)
        for small in ("4096", None):  # bytes of a stretch: members cross its borders
            if small:
                spark.conf.set("spark.sql.files.maxPartitionBytes", small)
            try:
                found = read(spark, packed, schema[fmt])
                assert small is None or found.rdd.getNumPartitions() > 8
                rows = sorted(str(r["component"]) for r in found.collect())
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert len(rows) == parts.count() and rows == sorted(str(r["component"]) for r in read(spark, plain, schema[fmt]).collect())


def test_rows_are_dealt_once(spark, tables):
    """Texts are neither counted nor joined before the document is sorted."""
    parts, spots = tables
    rows = documents.document_rows(components.document_header(spark), parts, spots)
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate [min", "")
    assert "Join LeftSemi" not in rows._jdf.queryExecution().optimizedPlan().toString()
