"""Ranked lexical search by presence masks: the best documents for each of a table of items.

A term is a run of letters, digits and non-ASCII characters, A-Z lowered. Each matched term
of an item adds its weight (rarer terms more) times a saturating function of its occurrences
in the document, damped for documents longer than the mean; ``scores`` states the integers.

1. Items' terms are hashed (two independent 64-bit hashes) and shared with the tasks. Their
   number is counted first; above ``max_pairs`` (item, term) pairs the items are dealt into
   blocks by a hash of their id, and each block goes over all documents by itself.
2. One pass over the texts writes the occurrences of those terms in each document as a table;
   document counts, lengths and the terms' document frequencies are aggregated from it.
3. A task takes the table's documents in blocks. A bitmap over an item's terms is laid over
   each document (its presence mask), documents of equal masks form a group, and a group's
   highest possible score is the sum of its terms' highest parts in the block. Groups are
   evaluated in descending order of it until the k-th best score so far, also of earlier
   blocks of the task, is above what any further group can reach. Every group not evaluated
   is thereby known to hold no result.
4. Each task sends at most k rows an item; these are ranked in two levels, 256 tasks at a
   time and then all, so no item's rows meet in one task at once.

Null texts have no terms; items without terms, or whose terms occur nowhere, get no rows.
Items with the same id (also null) count as one item with the terms of all of them. Every row
of documents is ranked for itself, also repeated ones; equal scores are ordered by id, null
ids last. Of both tables only the id and text columns are read. Long texts are read whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.batches import map_batches
from keystrata.llm.words import PLAIN, located
from keystrata.session import checkpointed

K = 50
MAX_PAIRS = 100_000  #: (item, term) pairs shared with the tasks at once; some 100 bytes each
CELLS = 1 << 23  #: entries of a block's table of terms by documents
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    found = F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), r'{TERM}', 0)")
    return items.select("item_id", F.explode(found).alias("term")).distinct()


@dataclass
class Terms:
    """The terms of a block of items: ``known`` looks hashes up, ``of`` lists an item's terms."""

    ids: list
    of: list[np.ndarray]
    first: np.ndarray
    second: np.ndarray
    order: np.ndarray

    @classmethod
    def build(cls, rows: Iterable[tuple]) -> Terms:
        number, of = {}, defaultdict(list)
        for item, term in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])):
            of[item].append(number.setdefault(term, len(number)))
        texts, one, two = list(number), [], []
        for part in located(pa.array(texts, pa.string()), PLAIN):
            one.append(part.hashes)
            two.append(part.second)
        one, two = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (one, two))
        order = np.argsort(one, kind="stable")
        return cls(list(of), [np.array(t) for t in of.values()], one[order], two[order], order)

    def __len__(self) -> int:
        return len(self.order)

    def known(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``one`` and ``two`` that hold a term, and the numbers of those terms."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.first, one), len(self) - 1)
        good = np.flatnonzero((self.first[at] == one) & (self.second[at] == two))
        return good, self.order[at[good]]


def _occurrences(terms):
    """doc_id, n, and the item terms of each text with their occurrences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        width = max(len(known), 1)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for part in located(batch.column(1), PLAIN):
                where, term = known.known(part.hashes, part.second)
                row = np.searchsorted(part.offsets, where, side="right") - 1
                pair, tf = np.unique(row * width + term, return_counts=True)
                ends = np.searchsorted(pair, np.arange(part.last - part.first + 1) * width).astype(np.int32)
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    ids.slice(part.first, part.last - part.first), pa.array(np.diff(part.offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array((pair % width).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))),
                ], names=["doc_id", "n", "terms", "tf"])

    return run


def occurrences(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, tf) for every row of docs: its number of terms, which terms of the
    items it holds, and how often; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    return checkpointed(map_batches(docs.select("doc_id", "text"), _occurrences(shared), "doc_id long, n long, terms array<int>, tf array<int>"))


def weights(table: DataFrame, terms: Terms) -> tuple[np.ndarray, int, int]:
    """Weight of each term, the number of documents with terms, and their total length."""
    n, total = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = np.zeros(len(terms), np.int64)
    for term, df in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        w[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return w, n, total


def scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A matched term's part of the score before its weight, for documents of damping m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents (columns) by presence mask: a document of each mask, and each one's mask."""
    bits = np.packbits(present, axis=0)
    words = -(-len(bits) // 8)
    masks = np.zeros((present.shape[1], words * 8), np.uint8)
    masks[:, : len(bits)] = bits.T
    masks = masks.view(np.uint64)[:, 0] if words == 1 else masks.view(f"V{words * 8}")[:, 0]
    _, example, mask = np.unique(masks, return_index=True, return_inverse=True)
    return example, mask


class Best:
    """The k best documents of one item so far: score descending, then id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """A score below which nothing can enter any more (scores start at 1)."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.floor()
        score, ids, null = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def search_block(best: Best, parts: np.ndarray, w: np.ndarray, ids: np.ndarray, null: np.ndarray) -> int:
    """Brings the documents of a block (columns of parts) into ``best``; says how many were
    evaluated."""
    example, mask = groups(parts > 0)
    limit = (w * parts.max(axis=1)) @ (parts[:, example] > 0)
    order = np.argsort(-limit, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_mask = np.argsort(place[mask], kind="stable")  # documents, those of the highest mask first
    ends = np.cumsum(np.bincount(place[mask], minlength=len(order)))
    done = start = 0
    step = 2 * best.k
    while done < len(order) and limit[order[done]] >= best.floor():
        open_ = int(np.searchsorted(-limit[order], -best.floor(), side="right"))  # masks that can still matter
        upto = min(max(int(np.searchsorted(ends, start + step)) + 1, done + 1), open_)
        docs = by_mask[start : ends[upto - 1]]
        best.add(w @ parts[:, docs].astype(np.int64), ids[docs], null[docs])
        start, done, step = int(ends[upto - 1]), upto, step * 2
    return start


def _ranked(terms, w, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = terms.value, [Best(k) for _ in terms.value.ids]
        width = max(16, min(4096, CELLS // max(len(known), 1)))
        for batch in batches:
            for low in range(0, batch.num_rows, width):
                block = batch.slice(low, width)
                listed = block.column(2)
                sizes = np.diff(listed.offsets.to_numpy())
                doc = np.repeat(np.arange(block.num_rows), sizes)
                tf, m = block.column(3).flatten().to_numpy().astype(np.int64), block.column(1).to_numpy()
                parts = np.zeros((len(known), block.num_rows), np.int32)
                parts[listed.flatten().to_numpy(), doc] = scores(tf, m[doc])
                ids, null = block.column(0).fill_null(0).to_numpy(), block.column(0).is_null().to_numpy(zero_copy_only=False)
                for item, own in enumerate(known.of):
                    search_block(best[item], parts[own], w[own], ids, null)
        here = TaskContext.get().partitionId()
        for item, x in enumerate(best):
            n = len(x.score)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, here, np.int32)), pa.array(np.full(n, item, np.int32)), pa.array(x.id, mask=x.null), pa.array(x.score),
            ], names=["part", "item", "doc_id", "score"])

    return run


def _search_terms(docs: DataFrame, terms: Terms, k: int, item_type: str) -> DataFrame:
    spark = docs.sparkSession
    table = occurrences(docs, terms)
    w, n, total = weights(table, terms)
    m = F.expr(f"50L + cast((50 * cast(n as decimal(20,0)) * {n}) div {max(total, 1)} as long)")
    rows = table.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tf")
    shared = spark.sparkContext.broadcast(terms)
    found = map_batches(rows, _ranked(shared, w, k), "part int, item int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for key in (["item", F.expr("part div 256")], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(terms.ids)), f"item int, item_id {item_type}")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    pairs = checkpointed(item_terms(items))
    blocks = max(1, -(-pairs.count() // max_pairs))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind = items.schema["item_id"].dataType.simpleString()
    results = [_search_terms(docs, Terms.build(map(tuple, pairs.where(block == b).collect())), k, kind) for b in range(blocks)]
    return reduce(DataFrame.unionByName, results)
