"""Ranked search against a plain version over all documents, and its odd cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from keystrata.llm import search

DOCS = "doc_id long, text string, item_id string, rank int, score string"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(search.UPPER, search.LOWER)


def plain(docs, items, k=50):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [x for x in bags if x[1]]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, own in terms.items():
        found = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in own if t in bag)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in search.search(d, q, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def random_docs(n, words, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{min(int(z), words)}" for z in rng.zipf(1.3, int(rng.integers(0, 60))))) for i in range(n)]


@pytest.mark.parametrize("blocks", [100_000, 40])
def test_as_plain(spark, blocks):
    docs = random_docs(1500, 400, 1) + random_docs(40, 400, 1)  # the first forty twice
    items = [(i, t) for i, t in random_docs(25, 400, 2)] + [(100, " ".join(f"w{i}" for i in range(1, 200))), (101, "nowhere"), (102, None)]
    assert run(spark, docs, items, max_pairs=blocks) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (None, "alpha beta"), (3, "Alpha, BETA"), (3, "alpha beta"), (4, None), (5, ""), (6, "..."), (7, "Été été"), (8, "long " * 300_000 + "beta"), (9, "x" * 400_000), (10, "gamma")]
    items = [(1, "alpha"), (1, "BETA"), (None, "gamma"), (None, "beta"), (2, "été"), (3, "x" * 400_000), (4, None)]
    assert run(spark, docs, items) == plain(docs, items)


def test_ties_keep_the_smallest_ids(spark):
    docs = [(1000 - i, "same words here") for i in range(300)] + [(5000, "other")]
    got = run(spark, docs, [(1, "words")], k=20)
    assert sorted(r[2] for r in got) == list(range(701, 721))


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    assert run(spark, docs, items) == []


def test_groups_left_out_cannot_matter():
    rng = np.random.default_rng(5)
    best, every, evaluated = search.Best(10), search.Best(10), 0
    for block in range(20):
        parts = rng.integers(1, 1000, (70, 500)) * (rng.random((70, 500)) < rng.random((70, 1)) * 0.3)
        w, ids, null = rng.integers(1, 50, 70), np.arange(500) + 500 * block, np.zeros(500, bool)
        evaluated += search.search_block(best, parts, w, ids, null)
        every.add(w @ parts, ids, null)
    assert best.score.tolist() == every.score.tolist() and best.id.tolist() == every.id.tolist()
    assert evaluated < 20 * 500
