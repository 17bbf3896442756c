"""Decontamination against plain Python, by both ways of lookup."""

import hashlib
import random
import re

import pytest

from keystrata.llm import contamination as C

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    known = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in known}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["Ünï", "x1", "É"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, sentence(rng.choice([3, 12, 13, 14, 40]))) for k in range(30)] + [(98, ""), (99, None), (100, "only"), (2, "w1 w2 w3 w4 w5")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "ONLY"), (4, "a" * 300_000 + " only " + "b " * 1000)]
    for k in range(5, 80):
        own = sentence(rng.choice([1, 5, 60, 400]))
        cut = rng.randrange(len(own))
        item = items[rng.randrange(30)][1]
        docs.append((k, own[:cut] + " " + rng.choice([item.upper(), item.replace(" ", " -\n"), item[: len(item) // 2], ""]) + " " + own[cut:]))
    return docs + docs[5:9], items


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_scan(spark, data, most):
    docs, items = data
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = C.scan(d, b, max_broadcast=most).collect()
    want = brute(docs, items)
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_documents_removed(spark, data, most):
    docs, items = data
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(k for k, _ in docs if not brute(docs, items)[k][4])
    out = C.decontaminate(d, b, max_broadcast=most)
    assert sorted(r["doc_id"] for r in out.collect()) == want and out.columns == d.columns


def test_spans_removed(spark):
    item = " ".join(f"t{k}" for k in range(15))
    d = spark.createDataFrame([(1, f"before {item.upper()}, after"), (2, "clean é"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in C.decontaminate(d, b, remove="spans").collect()}
    assert got == {1: "before , after", 2: "clean é", 3: None}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_null_ids(spark, most):
    item, other = (" ".join(f"{x}{k}" for k in range(15)) for x in "tu")
    rows = [(None, f"a {item} b"), (None, "clean"), (7, f"{other} {item}"), (7, "clean too"), (8, other)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(None, item), (3, other)], "item_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(None, 17, 15, 1, sha(""), True), (None, 1, 0, 0, sha(""), False), (7, 30, 30, 2, sha("3"), True), (7, 2, 0, 0, sha(""), False), (8, 15, 15, 1, sha("3"), True)]
    assert sorted(map(tuple, C.scan(d, b, max_broadcast=most).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, C.decontaminate(d, b, max_broadcast=most).collect()), key=str) == [(7, "clean too"), (None, "clean")]
    spans = C.decontaminate(d, b, remove="spans", max_broadcast=most).collect()
    assert sorted(map(tuple, spans), key=str) == sorted([(None, "a  b"), (None, "clean"), (7, ""), (7, "clean too"), (8, "")], key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert C.scan(d, b).count() == 0
    assert [tuple(r)[:3] for r in C.scan(one, b).collect()] == [(1, 2, 0)]
    assert C.scan(one, b, max_broadcast=-1).count() == 1
