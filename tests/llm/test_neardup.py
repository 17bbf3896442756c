"""Near-duplicates against all pairs."""

import random
import re

from keystrata.llm import graph
from keystrata.llm import neardup as N


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    low = {k: k for k, _ in docs}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            b = docs[j][0]
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {k: (len(s), root(k), root(k) == k) for (k, _), s in zip(docs, sets)}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "one two three")]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 200]))] for _ in range(40)]
    star = [rng.choice(vocabulary) for _ in range(400)]
    for k in range(6, 400):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, len(w) // 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((k, rng.choice([" ", "\n", "  "]).join(w)))
    # copies of one text that are linked with it but hardly with each other
    docs.append((400, " ".join(star)))
    for k in range(401, 520):
        w = list(star)
        for at in rng.sample(range(0, 400, 5), 11):
            w[at] = rng.choice(vocabulary)
        docs.append((k, " ".join(w)))
    docs.append((520, " ".join(f"l{k}" for k in range(30_000))))
    docs.append((521, " ".join(f"l{k}" for k in range(28_000))))
    return docs


def test_all_links_found(spark):
    docs = corpus()
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, component_id int").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in N.near_duplicates(df).collect()}
    assert got == brute(docs)


def pages_of_one_template():
    """Pages of which any two share 0.62, and pairs of them 0.77, of their shingles."""
    rng = random.Random(5)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    template, docs = [f"t{k}" for k in range(100)], []
    for _ in range(120):
        shared = own(9)
        docs += [template + shared + own(16) for _ in range(2)]
    rng.shuffle(docs)
    return [(k, " ".join(w)) for k, w in enumerate(docs)]


def test_links_of_crowded_regions(spark, monkeypatch):
    monkeypatch.setattr(N, "REGION", 4)
    docs = pages_of_one_template()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    assert sum(not kept for _, _, kept in want.values()) == 120
    for chunk in (N.CHUNK, 20_000):  # a region in one chunk, and in several
        monkeypatch.setattr(N, "CHUNK", chunk)
        assert {r["doc_id"]: tuple(r)[1:] for r in N.near_duplicates(df).collect()} == want


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x y z"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)
    assert got.count((1, 2, 1, True)) == 2 and (2, 2, 1, False) in got and (None, 1, None, False) in got
    kept = N.deduplicate(spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y"), (3, None, "z")], "doc_id long, text string, lang string"))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b", "x"), (3, None, "z")]


def test_one_row_of_each_group_stays(spark):
    text = "one text that all of these rows have"
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, text, "c"), (2, text, "d"), (None, "lone words", "e"), (None, "LONE words", "e"), (7, "", "f"), (7, "", "f"), (None, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(3)
    kept = sorted((tuple(r) for r in N.deduplicate(docs).collect()), key=str)
    assert [r for r in kept if r[1] == text] == [(1, text, "a")]
    assert sum((r[1] or "").lower() == "lone words" for r in kept) == 1
    assert kept.count((7, "", "f")) == 2 and (None, None, "g") in kept and len(kept) == 5


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 9), (9, 5), (7, 7)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{k: 100 for k in range(100, 161)}, 3: 3, 5: 3, 9: 3}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
