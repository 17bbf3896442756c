"""The pipeline stage by stage against its operators, on the smallest tables and on odd rows."""

import os
import re

import pytest

import __spark_entry__ as registered
import corpus_pipeline as P
from checks.compare import compare, connect
from keystrata.llm import contamination, mixing, neardup, pii, quality
from keystrata.llm import queries as Q
from tests.llm.test_pii import spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_query_for_each_operator():
    names = [n for n in registered.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registered.queries()
    assert set(Q.SQL) <= set(Q.QUERIES)


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query_against_sql(spark, name):
    ok, message = compare(spark, connect(SF), Q.QUERIES[name], Q.SQL[name], SF)
    assert ok, message


def test_stages_take_effect(spark):
    docs = Q.table(spark, SF, "documents")
    labels, benchmark = Q.table(spark, SF, "labels"), Q.table(spark, SF, "benchmark")
    now = docs
    want = {r["doc_id"] for r in quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        after = {r["doc_id"]: r for r in now.collect()}
        assert now.columns == docs.columns
        if name == "near_duplicates":
            kept = spark.createDataFrame(list(before.values()), docs.schema)
            want = {r["doc_id"] for r in neardup.near_duplicates(kept).where("kept").collect()}
        elif name == "decontamination":
            kept = spark.createDataFrame(list(before.values()), docs.schema)
            want = {r["doc_id"] for r in contamination.scan(kept, benchmark).where("not contaminated").collect()}
        assert set(after) == want, name
        changed = {k for k in after if after[k] != before[k]}
        assert changed == ({k for k in before if spans(before[k]["text"])} if name == "personal_data" else set()) or name == "personal_data"
        if name == "personal_data":
            assert {k for k in before if spans(before[k]["text"])} <= changed
            assert not [k for k in after if spans(after[k]["text"])]
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    mixed = P.STAGES[-1][1](spark, now, SF).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(now).collect()}
    got = {}
    for r in mixed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["words"]
    assert got == {k: v for k, v in taken.items() if v}


def test_run_repeats(spark):
    a, b = (sorted(map(str, P.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("rows", [
    [], [(None, None, None, None, None)], [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 60_000, None, None, 1), (3, "word " * 60_000, None, None, 1)],
])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF).collect()
        assert len(out) <= 3 * max(len(rows), 1)
    assert pii.redact(docs).columns == docs.columns
