"""Collocations against plain counting, and odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

from keystrata.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, key int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {x: n for x, n in f.items() if n >= least}
    out = {}
    for (lang, words), a in f.items():
        if len(words) < 2:
            continue
        inside = any(
            other == lang and b >= a and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), b in f.items()
        )
        if inside:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items() for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top])
    )


def run(spark, rows, **more):
    docs = spark.createDataFrame([(1, t, lang, "x", "y", 3) for t, lang in rows], SCHEMA)
    return sorted(tuple(r) for r in C.collocations(docs, **more).collect())


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"W{i}" if i % 7 else f"é{i}" for i in range(40)]
    marks = ["", "", "", "", "", ".", ",", "\n", " ;", "\t"]
    for _ in range(n):
        k = int(rng.integers(0, 80))
        yield " ".join(words[int(i) % 40] + marks[int(j)] for i, j in zip(rng.zipf(1.5, k), rng.integers(0, len(marks), k)))


def test_as_plain(spark):
    langs = ["en", "de", None, "und"]
    rows = [(t, langs[i % 4]) for i, t in enumerate(texts(400, 1))]
    rows += [("one fixed phrase of seven words here, and the rest", "en")] * 30
    want = plain(rows, 12)
    assert run(spark, rows, least=12) == want and len(want) > 50
    assert run(spark, rows, least=12, longest=3, top=5) == plain(rows, 12, 3, 5)


def test_small_bitmaps_change_nothing(spark, monkeypatch):
    rows = [(t, "en") for t in texts(150, 2)]
    monkeypatch.setattr(C, "BITS", 10)
    assert run(spark, rows, least=5) == plain(rows, 5)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;", "en"), ("a a a a a a a", "fr"), ("A a\x0ba a", "fr"), ("x" * 400_000 + " y", "en"), ("x" * 400_000 + " y", "en"),
            ("long text, " * 60_000, "de"), ("a b c\x00d a b c\x00d", "es"), ("a b", ""), ("a b", "")]
    assert run(spark, rows, least=2) == plain(rows, 2)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one two", "en")]])
def test_nothing_frequent(spark, rows):
    assert run(spark, rows) == []


def test_exact_past_64_bits(spark):
    big = 4 * 10**13
    found = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", 3 * 10**12), ("en", 1, "b", 7 * 10**11), ("en", 2, "a b", 10**11 + 7)], "lang string, size int, phrase string, n long")
    got = C.scored(found).first()
    assert got["score"] == 1000 * (10**11 + 7) * big // (3 * 10**12 * 7 * 10**11)
