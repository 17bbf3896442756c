"""Quality and language models on held-out rows and odd texts."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from keystrata.llm import language as L
from keystrata.llm import quality as Q

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n\n", "x", "\n".join(["line"] * 3000), "word " * 120_000, "é\n" * 10, "a\tb\r\nc"]


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not there")
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_chain_against_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        s, steps = rng.normal(0, 2, n), np.array([1.3, 0.4])
        weights = {}
        for path in range(1 << n):
            y = [path >> k & 1 for k in range(n)]
            weights[path] = math.exp(sum(s[k] for k in range(n) if y[k]) + sum(steps[0] if a and b else steps[1] if not a and not b else 0 for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        want = [sum(w for path, w in weights.items() if path >> k & 1) / total for k in range(n)]
        assert Q._score_lines(s.tolist(), steps) == pytest.approx(want)
    assert all(0 <= p <= 1 for p in Q._score_lines([900.0, -900.0, 0.0, 60.0], np.array([4.0, 4.0])))


def test_lines_of_every_text():
    got = {row: (len(f), int(length.sum())) for row, f, length in Q.line_features(pa.array(ODD))}
    for k, text in enumerate(ODD):
        raw = (text or "").encode()
        assert got[k][1] == len(raw)
        if len(raw) < Q.PIECE:
            assert got[k][0] == max(1, raw.count(b"\n") + (not raw.endswith(b"\n")))


def test_quality_held_out(spark, tables):
    docs, labels = tables
    model = Q.fit(docs, labels)
    rows = Q.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in Q.score(odd, model).collect())
    kept = Q.keep_good(odd.selectExpr("text", "doc_id", "1 AS score"), model)
    assert kept.columns == ["text", "doc_id", "score"]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in Q.score(docs, Q.fit(docs, none)).collect()] == [0.5, 0.5]
    assert Q.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")).prior == 1.0
    assert Q.score(docs.limit(0), Q.Model(0.5)).count() == 0


def test_language_held_out(spark, tables):
    docs, _ = tables
    model = L.fit(docs)
    rows = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    names, scores, rejected = L.predict([None, "", "12 !? 3", "the", "ж" * 50], model)
    assert names[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0] and names[3] in model.langs and rejected[4]
    long = docs.where("lang = 'fr'").first()["text"] * 200
    assert len(long) > L._PIECE and L.predict([long], model)[0] == ["fr"]


def test_long_texts_as_in_one_piece(spark, tables, monkeypatch):
    docs, _ = tables
    model = L.fit(docs, max_train=20)
    texts = [r["text"] for r in docs.limit(20).collect()]
    whole, sizes = L.entropies(texts, model)
    monkeypatch.setattr(L, "_PIECE", 100)
    pieces, again = L.entropies(texts, model)
    assert np.abs(sizes - again).max() <= 1 and np.allclose(whole, pieces, atol=0.01)


def counted(spark, texts):
    """(lang, gram, n) of texts by language, padded as training texts are."""
    rows = Counter((lang, padded[k : k + 4]) for lang, text in texts for padded in ["   " + text + " "] for k in range(len(padded) - 3))
    return spark.createDataFrame([(*x, n) for x, n in rows.items()], "lang string, gram string, n long")


class Plain:
    """Interpolated Kneser-Ney of one language over dictionaries."""

    def __init__(self, counts, symbols):
        self.levels, self.symbols = {4: counts}, symbols
        for n in (3, 2, 1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.discount = {}
        for n, level in self.levels.items():
            ones, twos = (sum(c == k for c in level.values()) for k in (1, 2))
            self.discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(self, context, symbol):
        n = len(context) + 1
        lower = self.p(context[1:], symbol) if context else 1 / self.symbols
        follows = {g: c for g, c in self.levels[n].items() if g[:-1] == context}
        if not follows:
            return lower
        total, d = sum(follows.values()), self.discount[n]
        return max(follows.get(context + symbol, 0) - d, 0) / total + d * len(follows) / total * lower


@pytest.mark.parametrize("block", [8, 2])
def test_probabilities_against_dictionaries(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    texts = [("x", "abracadabra bra cad abra"), ("y", "z zz"), ("z", "ça déjà vu cad"), ("x", "a cab"), ("\U0001f600", "\U00010400b ab")]
    grams = counted(spark, texts)
    model = L.build(grams)
    symbols = sorted({" "} | {c for _, t in texts for c in t})
    assert model.floor == pytest.approx(-math.log(len(symbols) + 1)) and len(model.blocks) == -(-4 // block)
    plain = [Plain({r["gram"]: r["n"] for r in grams.where(grams.lang == x).collect()}, len(symbols) + 1) for x in model.langs]
    contexts = {r["gram"][:3] for r in grams.collect()} | {"zzz", "q q", "bra", "  q"}
    for context in contexts:
        codes = [np.array([ord(c) for c in context + s], np.uint64) for s in [*symbols, "q"]]
        got = np.exp([L._log_probabilities(c, model)[0] for c in codes])
        assert got == pytest.approx(np.array([[m.p(context, s) for m in plain] for s in [*symbols, "q"]]), rel=1e-5)
        assert got.sum(axis=0) == pytest.approx(np.ones(4), abs=1e-5)


def test_training_keeps_every_gram(spark):
    docs = spark.createDataFrame([(k, f"text number {chr(97 + k % 26)}{chr(98 + k % 24)} of many", "en" if k % 3 else "de", 5) for k in range(300)], "doc_id long, text string, lang string, n long")
    model = L.fit(docs)
    used = {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    codes = {x for r in docs.collect() if r["doc_id"] in used for t in ["   " + "".join(c if c.isalpha() else " " for c in r["text"].lower()) + " "] for x in (t[k : k + 4] for k in range(len(t) - 3))}
    assert 0.75 * len(codes) <= len(model.blocks[0].grams[4][0]) <= len(codes)  # a fifth of the rows is set aside


def test_few_repeated_and_tied_rows(spark):
    rows = [(k, "une phrase courte", "fr") for k in (2, 3, 3, 7)] + [(k, "ein kurzer satz", "de") for k in (2, 9)] + [(4, "ein kurzer satz", "aa"), (None, "x", "zz"), (8, None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.langs == ["aa", "de", "fr"]  # none is lost, however few its documents
    odd = spark.createDataFrame([(1, "une phrase", 0.5, "q"), (1, "une phrase", 0.5, "q"), (None, "ein satz", 1.0, "r")], "doc_id long, text string, score double, lang_pred string")
    got = sorted(L.identify(odd, model).collect(), key=str)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 1] == ["fr", "fr"] and len(got) == 3
    assert L.predict(["qqq"], L.build(counted(spark, [("b", "same"), ("a", "same")])))[0] == ["a"]


def test_language_without_training(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert [tuple(r)[2:4] for r in L.identify(docs, model).collect()] == [("und", 0.0)]
    assert L.identify(docs.limit(0), model).count() == 0
