"""License texts found in documents, with column functions only.

Texts become words; overlapping windows of each size class are cut out of them, a class for
templates of up to half its window, with a stride of half a window, so every template-long
passage lies whole in some window. MinHash bands of one row each retrieve templates: a
window that holds the required share of a template agrees with it in one of ``BANDS`` bands
with probability of at least ``band_guarantee()``. Retrieved pairs are verified by exact
containment of the template's five-word shingles (all its words where it has fewer).

Templates (see ``license_texts``) of different licenses that share half of their shingles
compete: of such a template at least half of the shingles that only it has must be there as
well (the version, "Lesser", a third clause), and where it has none, none of those that only
its rivals have. SPDX lines are read as they are.

A text is only cut up if it holds an anchor word. Anchors are chosen such that more than a
quarter of any template's shingles have one. A window without any lacks all of those, so it
holds less than three quarters of the template: nothing is lost.

What is found depends on the text alone, so rows are told apart by a digest of their text:
null and repeated ids change nothing, and equal texts have equal results. Null and empty
texts have no license. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.binding import bind
from keystrata.llm.license_texts import TEMPLATES

WORD = r"[a-z0-9]+(?:\.[0-9]+)*+"
SHINGLE = 5
SHARE = 0.75
BANDS = 56


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def shingles_of(words: list[str]) -> list[str]:
    q = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[k : k + q]) for k in range(len(words) - q + 1)))


def window_class(words: list[str]) -> tuple[int, int]:
    """(window, shingle) sizes: twice the words, rounded up to a few sizes for longer templates."""
    size = 2 * len(words)
    if size > 16:
        ladder = 16
        while ladder < size:
            ladder = ladder * 3 // 2 if ladder & ladder - 1 == 0 else ladder * 4 // 3
        size = ladder
    return size, min(SHINGLE, len(words))


Templates = list[tuple[str, str]]


def anchors(templates: Templates = TEMPLATES) -> list[str]:
    """Words such that over a quarter of each template's shingles have one of them. Long words
    come first, as they are the rarest in other texts, then those that many templates have."""
    common = set("a all and any are as at be by do for from have in is it may not of on one or other such that the this to under want what with you your".split())
    each = [[x.split() for x in shingles_of(words_of(text))] for _, text in templates]
    spread = Counter(w for rest in each for w in {w for s in rest for w in s})
    chosen: set[str] = set()
    for rest in each:
        total = len(rest)
        while 4 * len(rest := [s for s in rest if not chosen & set(s)]) >= 3 * total:
            hits = Counter(w for s in rest for w in set(s))
            chosen.add(max(hits, key=lambda w: (w not in common, len(w) >= 10, hits[w], spread[w], len(w), w)))
    return sorted(chosen)


def band_guarantee(templates: Templates = TEMPLATES) -> float:
    """Least probability that a window with the required share of a template shares a band."""
    least = 1.0
    for _, text in templates:
        words = words_of(text)
        size, q = window_class(words)
        t, w = len(shingles_of(words)), size - q + 1
        common = max(1, -(-int(SHARE * 100) * t // 100))
        least = min(least, 1 - (1 - common / (t + w - common)) ** BANDS)
    return least


def marks(templates: Templates = TEMPLATES) -> list[tuple[list[str], list[str]]]:
    """For each template the shingles that its rivals lack, and those that only its rivals
    have; both empty without rivals."""
    sets = [(license_, shingles_of(words_of(text))) for license_, text in templates]
    out = []
    for license_, own in sets:
        mine = set(own)
        rivals = [set(s) for other, s in sets if other != license_ and 2 * len(mine & set(s)) >= min(len(mine), len(s))]
        theirs = set().union(*rivals)
        out.append(([s for s in own if rivals and s not in theirs], sorted(theirs - mine)))
    return out


def _shingles(words: Column, q: Column | int) -> Column:
    """Distinct shingles of an array of at least q words."""
    starts = F.sequence(F.lit(1), F.size(words) - q + 1)
    return F.array_distinct(F.transform(starts, lambda k: F.array_join(F.slice(words, k, q), " ")))


def _bands(hashes: Column) -> Column:
    """The minimum of each band's hash."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band))))


def _template_table(spark: SparkSession, templates: Templates) -> DataFrame:
    rows = []
    for number, ((license_, text), (own, others)) in enumerate(zip(templates, marks(templates))):
        words = words_of(text)
        rows.append((number, license_, *window_class(words), shingles_of(words), own, others))
    df = spark.createDataFrame(rows, "number int, license string, window int, q int, shingles array<string>, own array<string>, others array<string>")
    return bind(df, bands=_bands(F.transform("shingles", lambda s: F.xxhash64(s))))


def _key() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("text_key")


def _windows(docs: DataFrame, templates: Templates) -> DataFrame:
    """(text_key, window, q, start, words) of every window that holds an anchor, those of one
    size class of a text at a time."""
    known = anchors(templates)
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    gate = text.rlike(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, known))})(?![a-z0-9])")
    df = bind(docs.select(_key(), "text").where(gate), w=F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).drop("text")
    sizes = F.array(*(F.struct(F.lit(size).alias("window"), F.lit(q).alias("q")) for size, q in sorted({window_class(words_of(t)) for _, t in templates})))
    df = df.select("text_key", "w", F.inline(sizes)).withColumn("half", F.expr("window div 2").cast("int"))
    last = F.greatest(F.ceil((F.size("w") - F.col("half")) / F.col("half")), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.struct((k * F.col("half")).alias("start"), F.slice("w", k * F.col("half") + 1, F.col("window")).alias("words")))
    cut = F.filter(cut, lambda x: F.arrays_overlap(x["words"], F.array(*map(F.lit, known))) & (F.size(x["words"]) >= F.col("q")))
    return df.select("text_key", "window", "q", F.inline(cut))


def _found(docs: DataFrame, templates: Templates) -> DataFrame:
    """(text_key, license, containment, start): each license found in a text, with the best
    window of its best template (the first of the best)."""
    t = _template_table(docs.sparkSession, templates)
    windows = bind(_windows(docs, templates), shingles=_shingles(F.col("words"), F.col("q"))).drop("words")
    windows = bind(windows, bands=_bands(F.transform("shingles", lambda s: F.xxhash64(s))))
    # The templates are a fixed list, so their bands and shingles are sent to every task.
    keys = t.select("number", "license", F.col("window").alias("t_window"), F.col("q").alias("t_q"), F.posexplode("bands").alias("t_band", "t_value"))
    found = windows.select("text_key", "window", "q", "start", "shingles", F.posexplode("bands").alias("band", "value")).join(
        F.broadcast(keys), (F.col("window") == F.col("t_window")) & (F.col("q") == F.col("t_q")) & (F.col("band") == F.col("t_band")) & (F.col("value") == F.col("t_value")))
    found = found.join(F.broadcast(t.select("number", F.col("shingles").alias("t_shingles"), "own", "others")), "number")
    common = lambda c: F.size(F.array_intersect(F.col(c), F.col("shingles")))
    told = F.when(F.size("own") > 0, 2 * common("own") >= F.size("own")).otherwise(common("others") == 0)
    found = found.select("text_key", "license", "start", (common("t_shingles") / F.size("t_shingles")).alias("containment"), told.alias("told"))
    found = found.where((F.col("containment") >= SHARE) & F.col("told"))
    return found.groupBy("text_key", "license").agg(F.max("containment").alias("containment"), F.min_by("start", F.struct(-F.col("containment"), "start")).alias("start"))


def find(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, start) for every row of docs: each license told by a
    template, its best containment and the first word of the window that has it."""
    return docs.select("doc_id", _key()).join(_found(docs, templates), "text_key").drop("text_key")


def spdx(text: Column) -> Column:
    """Identifiers in a text's SPDX lines, sorted, each once."""
    lines = F.regexp_extract_all(text, F.lit(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*+)"), F.lit(1))
    names = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"[()]", ""), r"[ \t]+(?:AND|OR|WITH)[ \t]+")))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != "")))


def scan(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """(doc_id, n_licenses, licenses, containment) for every row of docs: names told by
    templates or SPDX lines, sorted and comma-joined, and the best containment (1 for an SPDX
    line, 0 if there is nothing)."""
    per = _found(docs, templates).groupBy("text_key").agg(F.collect_set("license").alias("found"), F.max("containment").alias("best"))
    out = docs.select("doc_id", _key(), spdx(F.col("text")).alias("named")).join(per, "text_key", "left")
    names = F.array_sort(F.array_union("named", F.coalesce("found", F.array().cast("array<string>"))))
    out = out.select("doc_id", names.alias("names"), F.when(F.size("named") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("containment"))
    return out.select("doc_id", F.size("names").cast("long").alias("n_licenses"), F.array_join("names", ",").alias("licenses"), "containment")
