"""Phrase collocations by relational mining (SETM): sorted occurrence relations, extended a word
at a time by joining neighbouring rows.

A text, A-Z lowered, falls into pieces at punctuation and line ends, and pieces into words at
blanks and tabs. A relation of length k has a row for each place where a phrase of k words
that may still be frequent occurs: document, position and the phrase's 64-bit key, sorted by
document and position; it is stored with one document's rows side by side in a row of lists.
Positions leave a number out between pieces, so neighbours by position are neighbours in a
piece. Keys start from the language, so the same words in two languages are two phrases.

1. Words are counted (in each batch first, then by key), and those of at least ``least``
   occurrences are the frequent groups of length 1. The relation of length 1 is written with
   their rows only.
2. The relation of length k is merge-joined with itself on document and next position: both
   sides are the same sorted rows, so the join is one step along the lists and shuffles
   nothing. Only group counts by key are shuffled. The rows of frequent groups are written as
   the relation of length k + 1; the relation before it is not needed any more.
3. After the last length a pass over the texts names the frequent groups and counts them
   again by their text, so keys that happen to be equal cannot change a count: they only
   make a group be looked at in vain.
4. The named counts are scored by joins: every cut of a candidate with the counts of its two
   parts, and every candidate with those one word longer that hold it.

The semi-join with the frequent groups of a length looks keys up in a bitmap of at most 16 MiB
(``BITS``), whatever the number of groups. Its false positives cost work and change nothing,
as every length is counted anew. Nothing else is broadcast or collected.

Null texts are empty and a null lang is ``und``. Repeated rows count as often as they are
there. Only the text and lang columns are read, texts as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.batches import map_batches
from keystrata.llm.words import buffers, located, lower, mix
from keystrata.session import checkpointed

LEAST = 100
LONGEST = 5
TOP = 2000
TOGETHER = 3_000_000  #: occurrences that a task counts before it hands counts on
PART = 2 << 20  #: bytes of text whose words are laid out at once
BITS = 27  #: two to this power bits at most in a bitmap of frequent keys
_U = np.uint64
_BREAK = np.array([chr(b) in ".,;:!?\n\x0b\x0c\r" for b in range(256)])
_SEPARATORS = _BREAK | np.array([chr(b) in " \t" for b in range(256)])
_STEP = _U(0x9E3779B97F4A7C15)


@dataclass
class Places:
    """Words of a batch of texts: row, position and key of each, in that order."""

    row: np.ndarray
    position: np.ndarray
    key: np.ndarray
    second: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _salt(lang: str) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=16).digest(), _U)


def places(texts: pa.Array, langs: pa.Array) -> Places:
    """All words of a column, their keys (and second, independent ones) salted by language."""
    data, _ = buffers(texts)
    codes = langs.dictionary_encode()
    salts = np.array([_salt(x) for x in codes.dictionary.to_pylist()], _U).reshape(-1, 2)
    lang, parts = codes.indices.to_numpy(), [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * 2]
    for part in located(texts, _SEPARATORS):
        if not len(part.start):
            continue
        low = part.start[0]
        breaks = np.flatnonzero(_BREAK[data[low : part.end[-1]]]) + low
        before = np.searchsorted(breaks, part.start)
        row = np.repeat(np.arange(part.first, part.last), np.diff(part.offsets))
        count = np.arange(len(row)) + np.cumsum(np.r_[False, before[1:] != before[:-1]])
        first = count[np.minimum(part.offsets[:-1], len(row) - 1)]
        own = salts[lang[row]]
        parts.append((row, count - first[row - part.first], mix(part.hashes + own[:, 0]), mix(part.second + own[:, 1]), part.start, part.end))
    return Places(*(np.concatenate(x) for x in zip(*parts)))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``PART`` bytes of text, so that memory hangs on neither
    the number of rows nor, but for a single row's own, on the length of texts."""
    _, at = buffers(batch.column(0))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PART, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _neighbours(row: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Where the next row of a sorted relation is the next position of the same document."""
    return np.flatnonzero((row[1:] == row[:-1]) & (position[1:] == position[:-1] + 1))


def extended(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys one word longer, from the keys of a phrase and of the one a word further on."""
    return mix(mix(key[at] * _STEP) + key[at + 1])


class Frequent:
    """A bitmap of keys: holds every key it was made of, and a few others."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.bits = min(BITS, max(10, (64 * n).bit_length()))
        slot = f"(key & {(1 << self.bits) - 1}L)"
        words = keys.groupBy(F.expr(f"cast(shiftright({slot}, 6) as int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 as int)))").alias("word")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), _U)
        self.words[words["at"].to_numpy()] = words["word"].to_numpy().view(_U)
        self.number = n

    def holds(self, key: np.ndarray) -> np.ndarray:
        slot = key & _U((1 << self.bits) - 1)
        return (self.words[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) == 1


def _counted(found: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Keys with their counts, ``TOGETHER`` occurrences at a time."""
    held, size = [], 0

    def counts():
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    for keys in found:
        held.append(keys)
        size += len(keys)
        if size >= TOGETHER:
            yield counts()
            held, size = [], 0
    if held:
        yield counts()


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(places(part.column(0), part.column(1)).key for batch in batches for part in _parts(batch))


def _lists(row: np.ndarray, rows: int, position: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Sorted rows of a relation, those of a document in one list; documents without any left out."""
    ends = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    out = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(position.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64)))], names=["position", "key"])
    return out.filter(pa.array(np.diff(ends.to_numpy()) > 0))


def _relation(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, position and key of a stored relation."""
    position, key = batch.column(0), batch.column(1)
    row = np.repeat(np.arange(batch.num_rows), np.diff(position.offsets.to_numpy()))
    return row, position.flatten().to_numpy(), key.flatten().to_numpy().view(_U)


def _first_relation(frequent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _parts(batch)):
            p = places(part.column(0), part.column(1))
            good = frequent.value.holds(p.key)
            yield _lists(p.row[good], part.num_rows, p.position[good], p.key[good])

    return run


def _extended_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def keys():
        for batch in batches:
            row, position, key = _relation(batch)
            yield extended(key, _neighbours(row, position))

    yield from _counted(keys())


def _next_relation(frequent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, position, key = _relation(batch)
            at = _neighbours(row, position)
            key = extended(key, at)
            good = frequent.value.holds(key)
            yield _lists(row[at][good], batch.num_rows, position[at][good], key[good])

    return run


def _named(frequent):
    """Frequent groups by their text with their counts; of size 0: all words of a language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _parts(batch)):
            texts, langs = part.column(0), part.column(1)
            p, (data, _) = places(texts, langs), buffers(texts)
            out = {"lang": [], "size": [], "phrase": [], "n": []}
            for lang, words in _by_lang(langs, p.row):
                out["lang"].append(lang)
                out["size"].append(0)
                out["phrase"].append("")
                out["n"].append(words)
            at, key, second = np.arange(len(p.row)), p.key, p.second
            for size, known in enumerate(frequent.value, 1):
                if size > 1:
                    # places whose phrase one word shorter, and the next place's, are there
                    near = np.flatnonzero((at[1:] == at[:-1] + 1) & (p.row[at[1:]] == p.row[at[:-1]]) & (p.position[at[1:]] == p.position[at[:-1]] + 1))
                    at, key, second = at[near], extended(key, near), extended(second, near)
                good = known.holds(key)
                at, key, second = at[good], key[good], second[good]
                order = np.argsort(key, kind="stable")
                new = np.flatnonzero(np.r_[True, (key[order[1:]] != key[order[:-1]]) | (second[order[1:]] != second[order[:-1]])]) if len(order) else order
                counts = np.diff(np.r_[new, len(order)])
                for i, n in zip(at[order[new]].tolist(), counts.tolist()):
                    words = [data[p.start[j] : p.end[j]].tobytes() for j in range(i, i + size)]
                    out["phrase"].append(lower(b" ".join(words)).decode())
                    out["n"].append(n)
                out["size"] += [size] * len(counts)
                out["lang"] += langs.take(pa.array(p.row[at[order[new]]])).to_pylist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())]))

    return run


def _by_lang(langs: pa.Array, row: np.ndarray) -> list[tuple[str, int]]:
    codes = langs.dictionary_encode()
    n = np.bincount(codes.indices.to_numpy()[row], minlength=len(codes.dictionary))
    return list(zip(codes.dictionary.to_pylist(), n.tolist()))


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, n): every phrase of up to ``longest`` words with at least ``least``
    occurrences, and (size 0) the number of words of each language; written once."""
    spark = docs.sparkSession
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    held, relation = [], None
    for size in range(1, longest + 1):
        source, count = (rows, _word_counts) if relation is None else (relation, _extended_counts)
        counts = map_batches(source, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        known = Frequent(checkpointed(counts.where(F.col("n") >= least).select("key")))
        held.append(known)
        if not known.number or size == longest:
            break
        shared = spark.sparkContext.broadcast(known)
        write = _first_relation(shared) if relation is None else _next_relation(shared)
        relation = checkpointed(map_batches(source, write, "position array<int>, key array<long>"))
    shared = spark.sparkContext.broadcast(held)
    named = map_batches(rows, _named(shared), "lang string, size int, phrase string, n long")
    named = named.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return checkpointed(named.where((F.col("n") >= least) | (F.col("size") == 0)))


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate no longer one of equal count holds."""
    totals = found.where("size = 0").select("lang", "n")
    counts = found.where("size > 0").select("lang", "phrase", F.col("n").alias("count"))
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cut = candidates.select("lang", "phrase", "a", "size", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(part), F.col("count").alias(name)), ["lang", part])
    exact = {x: f"cast({x} as decimal(17,0))" for x in "alrn"}
    score = F.expr(f"(1000 * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})")
    best = cut.join(totals, "lang").groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "n", "a")).alias("x"))
    longer = candidates.where("size > 2").select("lang", "a", F.explode(F.expr("array(array_join(slice(words, 1, size - 1), ' '), array_join(slice(words, 2, size - 1), ' '))")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score").join(longer, ["lang", "phrase"], "left")
    return best.where("longer is null or longer < a").drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored(mined(docs, least, longest)).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
