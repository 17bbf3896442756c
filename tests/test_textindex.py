"""Indexed search against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.operators import listing, textindex

FIELDS = ["name", "lib"]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(2)
    names = ["AES-256-GCM", "RSA", "SHA-256", "ÉCDSA", None, "", "ChaCha20", "😀 key"]
    rows = [(f"k{i}", r.choice(names), r.choice(["OpenSSL", "hashlib", None]), f"/src{i % 9}/Mod{i % 70}/file{i}.py") for i in range(2000)]
    return spark.createDataFrame(rows, "id string, name string, lib string, path string")


@pytest.fixture(scope="module")
def folder(spark, table, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index"))
    textindex.build(table, out, "id", FIELDS, "path", slots=32)
    return out


@pytest.mark.parametrize("query", [" rsa OpenSSL ", "src3/mod7", "file1234.py", "écd", "😀 k", "gcm hash", "s", "", None, "no such text", "aes-256-gcm openssl/src", "\u0000/s", "ssl"])
def test_as_the_scan(spark, table, folder, query):
    got = textindex.find(spark, folder, query, "id", FIELDS, "path")
    want = listing.search(table, query, FIELDS, "path")
    assert got.columns == table.columns or set(got.columns) == set(table.columns)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def test_reads_hang_on_hits(spark, folder):
    rows = spark.read.parquet(f"{folder}/rows")
    every = rows.select(F.input_file_name()).distinct().count()
    found = textindex.candidates(spark, folder, "file1234.py")
    slots = [r[0] for r in found.select("slot").distinct().collect()]
    read = rows.where(F.col("_slot").isin(slots)).select(F.input_file_name()).distinct().count()
    assert len(slots) == 1 and read <= 8 < every
    plan = textindex.find(spark, folder, "file1234.py", "id", FIELDS, "path")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == plan.count("FileScan") - plan.count("PartitionFilters: []") >= 2


def test_empty_index(spark, table, tmp_path):
    textindex.build(table.limit(0), str(tmp_path), "id", FIELDS)
    assert spark.read.schema(table.schema).parquet(f"{tmp_path}/rows").count() == 0


def test_trigrams_overlap_and_count_characters(spark):
    rows = spark.createDataFrame([(1, "abcab"), (2, "a\n\U0001F511b"), (3, "ab"), (4, None)], "id int, text string")
    found = {r[0]: r[1] for r in rows.select("id", textindex.trigrams(F.col("text"))).collect()}
    assert found == {1: ["abc", "bca", "cab"], 2: ["a\n\U0001F511", "\n\U0001F511b"], 3: [], 4: None}


def test_trigrams_cut_a_text_once(spark):
    """The text is not cut into characters again for each of them."""
    plan = spark.createDataFrame([("abc",)], "text string").select(textindex.trigrams(F.col("text")))._jdf.queryExecution().toString()
    assert "lambda" not in plan


def test_postings_are_lists_of_numbers(spark, table, folder):
    """Postings are written as lists for many rows each, without keys, and none is lost; lists
    whose rows lie far apart are begun anew."""
    lists = spark.read.parquet(f"{folder}/postings")
    assert "key" not in lists.columns
    grams = table.select(F.explode(textindex.trigrams(textindex._text(FIELDS, "path"))).alias("gram")).groupBy("gram").count()
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/grams").select("gram", "n").collect()} == {tuple(r) for r in grams.collect()}
    assert lists.count() * 2 < lists.agg(F.sum(F.size("gaps"))).first()[0]
    numbers = spark.createDataFrame([(1, 5, ["abc", "bcd"]), (0, 1 << 40, ["abc"]), (1, 7, ["abc"]), (1, 1 << 33, ["abc"]), (2, 9, [])], "slot int, number long, grams array<string>")
    held = numbers.coalesce(1).mapInArrow(textindex._listed, "gram string, slot int, base long, gaps array<int>")
    assert sorted((r["gram"], r["slot"], r["base"], r["gaps"]) for r in held.collect()) == [
        ("abc", 0, 1 << 40, [0]), ("abc", 1, 5, [0, 2]), ("abc", 1, 1 << 33, [0]), ("bcd", 1, 5, [0])]
    single = held.where("gram = 'abc'").select("slot", "base", "gaps").mapInArrow(textindex._single, "slot int, number long")
    assert sorted(map(tuple, single.collect())) == [(0, 1 << 40), (1, 5), (1, 7), (1, 1 << 33)]
