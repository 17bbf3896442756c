"""Targets against the stated procedure; draws against their targets."""

import random
from fractions import Fraction

import numpy as np
import pytest

from keystrata.llm import mixing as M


def targets(sizes):
    """Shares by weight; what is above three times a source's size goes to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    open_, left = set(names), Fraction(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            out |= share
            break
        for s in full:
            out[s] = Fraction(3 * sizes[s])
            left -= out[s]
        open_ -= full
    return {s: float(t) for s, t in out.items()}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    rows = []
    for k in range(900):
        source = rng.choice(["a"] * 6 + ["b", "c", "d", "", None, "é", "Z"])
        n = rng.choice([0, 1, 5, 30, 200]) if k else 30_000
        rows.append((k, None if k % 97 == 5 else rng.choice([" ", "\n\t "]).join(["wörd"] * n), source, k, "x"))
    rows += [(900 + k, "one two", "tiny", k, "x") for k in range(3)] + [(1, "same row", "a", 1, "x")] * 2
    return rows


@pytest.mark.parametrize("block", [300, 1 << 16])
def test_taken(spark, docs, block):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, target long, words string").repartition(4)
    got = M.taken(df, block_words=block, shard_blocks=4).collect()
    again = M.taken(df.coalesce(1), block_words=block, shard_blocks=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len(got) == len(docs)
    source = {d[0]: d[2] for d in docs}
    sizes, took, said = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        took[s] = took.get(s, 0) + r["taken"]
        said[s] = (r["target"], r["source_size"])
    want = targets(sizes)
    for s in sizes:
        assert said[s][0] == pytest.approx(want[s]) and said[s][1] == sizes[s]
        assert abs(took[s] - want[s]) <= 1, s
    assert {r["doc_id"]: r["size"] for r in got}[0] == 30_000


def test_shards_split_every_quota(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 1)], "key string, n long")
    rows = M.leaves(quotas, 50, seed=4).collect()
    drawn = sorted((r["key"], d) for r in rows for d in range(r["first"], r["first"] + r["n"]))
    assert drawn == sorted([("a", k) for k in range(1000)] + [("b", k) for k in range(37)] + [("c", 0)])
    by = {}
    for r in rows:
        by[r["shard"]] = by.get(r["shard"], 0) + r["n"]
    assert len(by) == 50 and max(by.values()) - min(by.values()) <= 6


def test_quotas_follow_the_hypergeometric_law():
    quotas, shards = np.array([60, 30, 10]), 8
    drawn = np.array([[n[0] for _, _, n in M._split(quotas, 0, shards, seed, 10)] for seed in range(4000)])
    total, size = quotas.sum(), [sum(n) for _, _, n in M._split(quotas, 0, shards, 0, 10)]
    for shard in range(shards):
        k, share = size[shard], quotas[0] / total
        spread = k * share * (1 - share) * (total - k) / (total - 1)
        assert abs(drawn[:, shard].mean() - k * share) < 4 * (spread / len(drawn)) ** 0.5
        assert abs(drawn[:, shard].var() / spread - 1) < 0.12
    assert (drawn.sum(axis=1) == quotas[0]).all()


def test_shards_are_part_of_the_result(spark, docs):
    df = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, source string").repartition(4)
    options = {"block_words": 300, "shard_blocks": 4}
    listed = sorted((r["doc_id"], x) for r in M.taken(df, **options).collect() for x in r["shards"].split(",") if x)
    rows = M.mixed(df, **options).collect()
    assert listed == sorted((r["doc_id"], f"{r['shard']}:{r['position']}:{r['words']}") for r in rows)
    assert len({r["shard"] for r in rows}) > 10


def test_mixed_rows(spark, docs):
    df = spark.createDataFrame([(k, t, s, len(t or "")) for k, t, s, *_ in docs], "doc_id long, text string, source string, n_chars long")
    out = M.mixed(df, block_words=300, shard_blocks=4)
    assert out.columns == [*df.columns, "shard", "position", "copy", "words"]
    rows = out.collect()
    for r in rows:
        assert len(r["text"].split()) == r["words"] and r["n_chars"] == len(r["text"])
    taken = {r["doc_id"]: r["taken"] for r in M.taken(df, block_words=300, shard_blocks=4).collect() if r["doc_id"] != 1}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["words"]
    assert {k: v for k, v in got.items() if k != 1} == {k: v for k, v in taken.items() if v}


def test_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    assert M.taken(spark.createDataFrame([], schema)).count() == 0
    got = M.taken(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
