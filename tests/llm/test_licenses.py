"""License scans against plain containment over every window, and on texts not in the list."""

import glob
import os

import pytest

from keystrata.llm import licenses as L
from keystrata.llm.license_texts import NAMES, TEMPLATES


def brute(text):
    words, out, rivals = L.words_of(text or ""), set(), L.marks()
    for (license_, template), (own, others) in zip(TEMPLATES, rivals):
        tw = L.words_of(template)
        size, q = L.window_class(tw)
        want = set(L.shingles_of(tw))
        for start in range(0, max(len(words) - size // 2, 1), size // 2):
            win = words[start : start + size]
            have = {" ".join(win[k : k + q]) for k in range(len(win) - q + 1)}
            told = 2 * len(have & set(own)) >= len(own) if own else not have & set(others)
            if len(want & have) >= L.SHARE * len(want) and told:
                out.add(license_)
    return ",".join(sorted(out))


def scanned(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    return {r["doc_id"]: r["licenses"] for r in L.scan(df).collect()}


def test_anchors_cover_every_template():
    known = set(L.anchors())
    for _, text in TEMPLATES:
        s = L.shingles_of(L.words_of(text))
        # Less than the required share can be there without an anchor.
        assert sum(not known & set(x.split()) for x in s) < L.SHARE * len(s)
    assert L.band_guarantee() > 0.999


def test_scan_against_every_window(spark):
    filler = " ".join(f"word{k}" for k in range(37))
    texts = [None, "", "plain text", "license"]
    for _, t in TEMPLATES[::3]:
        w = t.split()
        texts += [t, filler + " " + t + " " + filler, filler + "\n" + t.upper(), " ".join(w[: len(w) * 3 // 4]), " ".join(w[: len(w) // 2] + ["other"] + w[len(w) // 2 :])]
    texts += [" ".join(t for _, t in TEMPLATES), (filler + " ") * 400 + "under the MIT License " + filler]
    got = scanned(spark, texts)
    for k, t in enumerate(texts):
        assert got[k] == brute(t), (k, t)


# Wordings that are not in the list.
UNSEEN = [
    ("This library is licensed under the MIT License; see the file COPYING.", "MIT"),
    ("Distributed under the Apache License 2.0 by its authors.", "Apache-2.0"),
    ("You may use it under the terms of the GNU General Public License version 2 only.", "GPL-2.0"),
    ("released under the GNU Lesser General Public License, version 2.1, or later", "LGPL-2.1"),
    ("available under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("GNU General Public License, version 4, which does not exist", ""),
    ("Pictures are under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
    ("It is shared under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("published under the New BSD License", "BSD-3-Clause"),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-3.0-or-later", "Apache-2.0,LGPL-3.0-or-later,MIT"),
    ("a license to fish and all rights of way reserved", ""),
]


def test_unseen_wordings(spark):
    got = scanned(spark, [t for t, _ in UNSEEN])
    assert [got[k] for k in range(len(UNSEEN))] == [want for _, want in UNSEEN]


FILES = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": None, "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not glob.glob("/usr/share/common-licenses/*"), reason="no license files on this machine")
def test_license_files(spark):
    names = [n for n in FILES if FILES[n] and os.path.exists(f"/usr/share/common-licenses/{n}")]
    got = scanned(spark, [open(f"/usr/share/common-licenses/{n}", encoding="utf-8", errors="replace").read() for n in names])
    for k, name in enumerate(names):
        assert FILES[name] in got[k].split(","), (name, got[k])


def test_clauses_and_versions_are_told_apart(spark):
    bodies = [(license_, t) for license_, t in TEMPLATES if len(t) > 300]
    got = scanned(spark, ["Copyright 2020 Someone. " + t for _, t in bodies])
    for k, (license_, _) in enumerate(bodies):
        assert license_ in got[k].split(",") and not set(got[k].split(",")) & {x for x in NAMES if x != license_ and x.split("-")[0] == license_.split("-")[0]}


def test_missing_and_repeated_ids(spark):
    rows = [(None, "under the MIT License"), (None, "nothing"), (1, "under the MIT License"), (1, "under CC BY 4.0"), (1, "under CC BY 4.0"), (2, None), (3, "x" * 300_000 + " under the ISC License " + "word " * 100_000)]
    got = sorted((tuple(r)[0:3] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(None, 1, "MIT"), (None, 0, ""), (1, 1, "MIT"), (1, 1, "CC-BY-4.0"), (1, 1, "CC-BY-4.0"), (2, 0, ""), (3, 1, "ISC")]
    assert got == sorted(want, key=str)
    assert L.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").count() == 3


def test_own_templates(spark):
    df = spark.createDataFrame([(1, "this house license lets you read it at home only"), (2, "under the MIT License")], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in L.scan(df, [("House-1.0", "house license lets you read it at home")]).collect()}
    assert got == {1: "House-1.0", 2: ""}


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
