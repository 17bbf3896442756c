"""Near-duplicate documents by an LSH forest over MinHash signatures.

* A document's set is its distinct five-word shingles (the whole sequence if it has fewer
  words); documents with equal sets form one class, led by the smallest id.
* A signature holds ``TREES`` x ``DEPTH`` minima. Tree t orders the classes by its own
  stretch of the signature; classes with a common prefix of d values there form a region.
* Links come in two passes. First every class is compared with the centre of the regions of
  full depth it lies in, which collapses large groups of copies with one comparison each.
  Then shallow regions that still hold several groups are taken apart: small ones pair by
  pair, larger ones by their centre and, some values deeper, again. Pairs that one group
  already holds, or whose sizes alone rule a link out, are never made.
* Then every shallow region that was too large to pair and still holds several groups is cut
  into chunks of bounded bytes, and each chunk meets each other one and itself in a task of
  its own, so that no pair of such a region is left out. Two chunks of one group do not meet.
* Candidates whose signatures agree too little for the threshold (3.5 standard errors below
  it) go; all others are confirmed on full shingle sets.
* Components are closed over the confirmed links.

Null, empty and blank texts have no shingles, are linked with nothing and stay. Repeated
rows of an id share its verdict. A null id yields a null component and is not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from keystrata.llm.batches import map_batches
from keystrata.llm.graph import components
from keystrata.llm.words import SPACED, grams, words
from keystrata.session import checkpointed

WORDS = 5
PERCENT = 75
TREES, DEPTH = 24, 8
#: Depths at which regions are taken apart. A link at the threshold shares 4 values in one
#: of 24 trees at least with probability 1 - (1 - 0.75**4)**24 = 0.9999.
LEVELS = (4, 6, DEPTH)
#: Classes of a region that are still paired one by one.
REGION = 48
#: Bytes of signatures and sets in a chunk of a larger region.
CHUNK = 4 << 20

_RNG = np.random.Generator(np.random.PCG64(11))
_A, _B, _C = (_RNG.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(3))


def shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for part in words(column, SPACED):
        h5, off = grams(part.hashes, WORDS), part.offsets.tolist()
        for k in range(part.last - part.first):
            lo, hi = off[k], off[k + 1]
            if hi - lo >= WORDS:
                yield part.first + k, np.unique(h5[lo : hi - WORDS + 1])
            else:
                yield part.first + k, grams(part.hashes[lo:hi], hi - lo) if hi > lo else h5[:0]


def signature(s: np.ndarray) -> bytes:
    """The minima, 16 bits each."""
    x, low = (s >> np.uint64(32)).astype(np.uint32), None
    for k in range(0, len(x), 512):
        t = x[k : k + 512, None] ^ _A
        t *= _B
        t ^= t >> np.uint32(15)
        t *= _C
        m = t.min(axis=0)
        low = m if low is None else np.minimum(low, m)
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return (low >> np.uint32(16)).astype(">u2").tobytes()


def _sketch(batches):
    for batch in batches:
        n, key, sig = [], [], []
        for _, s in shingles(batch.column(1)):
            n.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])


def _sets(batches):
    for batch in batches:
        found = [s for _, s in shingles(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "n", "members"])


@F.pandas_udf(LongType())
def _common(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y)], dtype="int64")


@F.pandas_udf(DoubleType())
def _agreement(x: pd.Series, y: pd.Series) -> pd.Series:
    p, q = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (x, y))
    return pd.Series((p == q).mean(axis=1))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b", "na", "nb", _common("ma", "mb").alias("c"))
    return both.where(f"100 * c >= {PERCENT} * (na + nb - c)").select("a", "b")


def _region(depth: int):
    return F.xxhash64("tree", F.substring("label", 1, 2 * depth))


def _centres(rows: DataFrame) -> DataFrame:
    """(key, centre): of each region the class that lies in the most crowded regions over all
    trees; what a group of copies was made from shares its values with most of them."""
    crowd = rows.groupBy("node").agg(F.sum("size").alias("crowd"))
    return rows.join(crowd, "node").groupBy("key").agg(F.max_by("node", F.struct("crowd", -F.col("node"))).alias("centre"))


def _with_size(rows: DataFrame, depth: int) -> DataFrame:
    keyed = rows.withColumn("key", _region(depth))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"))
    return keyed.join(sizes.where("size > 1"), "key")


def _pairs_between(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b, of different groups, from rows (node, n, comp, tree, label).
    Regions of over REGION classes only meet their centres; _crowded_links has the rest."""
    out, own = [], rows
    for depth in LEVELS:
        keyed = own.withColumn("key", _region(depth))
        mixed = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        keyed = checkpointed(keyed.join(mixed.select("key", "size"), "key"))
        large = keyed.where(F.col("size") > REGION)
        small = keyed.where(F.col("size") <= REGION)
        groups = small.groupBy("key").agg(F.collect_list(F.struct("node", "n", "comp")).alias("all"))
        one = groups.select("all", F.explode("all").alias("x"))
        other = lambda y: (y.node > F.col("x.node")) & (y.comp != F.col("x.comp")) & (100 * F.least(y.n, F.col("x.n")) >= PERCENT * F.greatest(y.n, F.col("x.n")))
        out.append(one.select(F.col("x.node").alias("a"), F.explode(F.transform(F.filter("all", other), lambda y: y.node)).alias("b")))
        centre = large.select(F.col("node").alias("centre"), F.col("comp").alias("other")).distinct()
        centred = large.join(_centres(large), "key").join(centre, "centre").where("comp <> other")
        out.append(centred.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))
        own = large.select(*rows.columns)
        if large.isEmpty():
            break
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def _chunk_links(least: float):
    """Links between the two sides of a table (side, node, n, comp, sig, members), or within
    it if there is one side, as far as they connect different groups."""

    def run(table: pa.Table) -> pa.Table:
        side, node, n, comp = (table.column(c).to_numpy() for c in ("side", "node", "n", "comp"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        low: dict[int, int] = {}

        def root(x: int) -> int:
            while x in low:
                x = low[x]
            return x

        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        for at, i in enumerate(left):
            other = right if len(right) else left[at + 1 :]
            other = other[(comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= PERCENT * np.maximum(n[other], n[i]))]
            if not len(other):
                continue
            for j in other[(sig[other] == sig[i]).mean(axis=1) >= least]:
                x, y = root(comp[i]), root(comp[j])
                if x == y:
                    continue
                c = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * c >= PERCENT * (n[i] + n[j] - c):
                    low[max(x, y)] = min(x, y)
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _has_crowded(rows: DataFrame) -> bool:
    return not rows.groupBy(_region(LEVELS[0])).count().where(f"count > {REGION}").isEmpty()


def _crowded_links(rows: DataFrame, classes: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """Links (a, b) between different groups of the shallow regions of over REGION classes, all
    pairs compared; rows (node, n, comp, tree, label). None if no such region is left."""
    keyed = rows.withColumn("key", _region(LEVELS[0]))
    mixed = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(f"size > {REGION} and lo < hi")
    keyed = checkpointed(keyed.join(mixed.select("key"), "key").select("key", "node", "comp", (8 * F.col("n") + 2 * TREES * DEPTH).alias("bytes")))
    if keyed.isEmpty():
        return None
    # A group of many bytes has chunks of its own; small groups share theirs.
    group = keyed.groupBy("key", "comp").agg(F.sum("bytes").alias("bytes")).withColumn("own", F.when(F.col("bytes") >= CHUNK // 2, F.col("comp")))
    group = checkpointed(group)
    rest = group.where("own is null").groupBy("key").agg(F.sum("bytes").alias("rest"))
    group = group.join(rest, "key", "left").select("key", "comp", "own", F.ceil(F.when(F.col("own").isNull(), F.col("rest")).otherwise(F.col("bytes")) / CHUNK).alias("parts"))
    part = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("comp")).otherwise(F.col("node")), F.lit("part")), F.col("parts"))
    placed = keyed.select("key", "comp", "node").join(group, ["key", "comp"]).select("key", "node", "comp", "own", F.xxhash64("key", F.coalesce("own", F.lit(-1)), F.col("own").isNull(), part).alias("chunk"))
    placed = checkpointed(placed)
    x, y = (placed.select("key", F.col("own").alias(f"own_{s}"), F.col("chunk").alias(f"chunk_{s}")).distinct() for s in "xy")
    meet = x.join(y, "key").where("chunk_x <= chunk_y and not coalesce(own_x = own_y, false)").select("chunk_x", "chunk_y", F.xxhash64("key", "chunk_x", "chunk_y").alias("task"))
    sides = meet.select("task", F.lit(0).alias("side"), F.col("chunk_x").alias("chunk")).union(meet.where("chunk_x < chunk_y").select("task", F.lit(1), "chunk_y"))
    # One copy of each set and signature is attached to the rows of the tasks that need it.
    full = sets.join(classes.select("node", "sig"), "node").select("node", "n", "sig", "members")
    dealt = sides.join(placed.select("chunk", "node", "comp"), "chunk").join(full, "node").select("task", "side", "node", "n", "comp", "sig", "members")
    return checkpointed(dealt.groupBy("task").applyInArrow(_chunk_links(least), "a long, b long"))


def _grouped(confirmed: DataFrame) -> DataFrame:
    """(node, comp): two steps of the smallest label over the links, enough to name stars."""
    both = checkpointed(confirmed.union(confirmed.select("b", "a")).toDF("node", "next"))
    first = both.groupBy("node").agg(F.least("node", F.min("next")).alias("comp"))
    second = both.join(first.toDF("next", "near"), "next").groupBy("node").agg(F.min("near").alias("near"))
    return checkpointed(first.join(second, "node").select("node", F.least("comp", "near").alias("comp")))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, confirmed): members (doc_id, n_shingles, node) has each document's class,
    confirmed (a, b) links between classes that connect all linked ones."""
    docs = docs.select("doc_id", "text")
    sketch = checkpointed(map_batches(docs, _sketch, "doc_id long, n_shingles long, set_key binary, sig binary"))
    classes = sketch.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = checkpointed(classes.where("node is not null"))
    rows = classes.select("node", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("node", "n", "tree", F.substring("sig", F.col("tree") * F.lit(2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("label"))
    rows = checkpointed(_with_size(rows, LEVELS[0]).select("node", "n", "tree", "label"))

    needed = checkpointed(rows.select("node").distinct())
    sets = map_batches(docs.join(needed, docs["doc_id"] == needed["node"], "left_semi"), _sets, "node long, n long, members binary")
    sets = checkpointed(sets.join(classes.select("node", "n"), ["node", "n"], "left_semi"))

    # First pass: each class and the centre that it shares most trees with.
    deep = checkpointed(_with_size(rows, DEPTH))
    star = deep.join(_centres(deep), "key").where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("shared"))
    star = star.groupBy("node").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("centre"))
    star = checkpointed(_confirm(star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), sets))

    # Second pass: what is left between groups.
    plain = rows
    rows = rows.join(_grouped(star), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    a, b = (classes.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    least = PERCENT / 100 - 3.5 * (PERCENT / 100 * (1 - PERCENT / 100) / (TREES * DEPTH)) ** 0.5
    likely = checkpointed(_pairs_between(rows).join(a, "a").join(b, "b").select("a", "b", _agreement("sa", "sb").alias("estimate")).where(F.col("estimate") >= least))
    confirmed = star.union(checkpointed(_confirm(likely, sets)))

    # Third pass: what is left in crowded regions.
    if _has_crowded(plain):
        rows = plain.join(components(confirmed).toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rest = _crowded_links(rows, classes, sets, least)
        confirmed = confirmed if rest is None else confirmed.union(rest)
    members = sketch.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "node"), "set_key", "left").select("doc_id", "n_shingles", "node")
    return members, confirmed


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    members, confirmed = links(docs)
    comp = components(confirmed).toDF("node", "comp")
    out = members.join(comp, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node", "doc_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the smallest id, null ids last; of equal
    ids any one. Rows without words all stay. Rows get a key of their own, written once, so
    repeated and missing ids make no difference."""
    key = next(k for k in ("__row", "__row_key", "__row_key_of_own") if k not in docs.columns)
    rows = checkpointed(docs.withColumn(key, F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    found = checkpointed(found.join(rows.select(key, "doc_id"), key))
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", key))[key].alias("best"))
    gone = found.join(best, "component_id").where(F.col(key) != F.col("best")).select(key)
    return rows.join(checkpointed(gone), key, "left_anti").select(docs.columns)
