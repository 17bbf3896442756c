"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's size is its number of words. Sources, by code point with null last, weigh 5, 2,
1, 5, 2, 1, ... and share all words; a target stops at three times its source's size, and
the excess goes to the others by weight until none is above.

A source is dealt into blocks by a hash of the document and the pass, so each pass over the
source is another random permutation of it. Targets become exact quotas of block draws:
whole passes, then blocks in order up to the one that fills the target, where documents are
taken in hash order and the last in part. The tree splits the vector of quotas at the root
between halves of the output shards, and so on down, by multivariate-hypergeometric draws;
a leaf's quotas are runs of draws that no other leaf has. In a shard, documents are ordered
by a hash.

Documents only ever meet in aggregations by (source, block); the tables per source have one
row per source, and the tree one row per source and node. All choices hang on ids, sources,
sizes and the seed, so reruns agree. Null and blank texts have size 0 and are not taken;
repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.session import checkpointed

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK_WORDS = 1 << 16
SHARD_BLOCKS = 64
_FAN = 4  #: levels of the tree in one step


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(key, source_size, target) for each source of (key, size); key: "1" and the name, or "2"."""
    by = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("key")  # one row per source
    by = by.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    by = by.withColumn("most", F.lit(float(limit)) * F.col("source_size"))
    # Sources by the level at which they are full: those full below the common level stop there.
    level = Window.orderBy(F.col("most") / F.col("w"), "key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", share)
    # The first source that its level does not fill sets the level of all that are not full.
    ratio = F.col("most") / F.col("w")
    first = F.min(F.when(ratio > F.col("level"), F.struct(ratio.alias("ratio"), "key", "level"))).over(everything)
    return by.withColumn("common", first["level"]).select("key", "source_size", F.when(F.col("common").isNull() | (ratio <= F.col("common")), F.col("most")).otherwise(F.col("common") * F.col("w")).alias("target"))


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _split(quotas: np.ndarray, lo: int, hi: int, seed: int, depth: int) -> list[tuple[int, int, np.ndarray]]:
    """Quotas of the descendants of the node with the shards lo to hi, depth levels down."""
    if hi - lo == 1 or not depth:
        return [(lo, hi, quotas)]
    mid, total = (lo + hi) // 2, int(quotas.sum())
    draw = total * (mid - lo) // (hi - lo)
    left = np.random.Generator(np.random.PCG64([seed, lo, hi])).multivariate_hypergeometric(quotas, draw, method="marginals")
    return _split(left, lo, mid, seed, depth - 1) + _split(quotas - left, mid, hi, seed, depth - 1)


def leaves(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(key, shard, first, n): the run of draws that each shard has of each source, from
    quotas (key, n)."""
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "key", F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    width = shards
    while width > 1:
        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("key")
            first, out = pdf["first"].to_numpy(), []
            for lo, hi, n in _split(pdf["n"].to_numpy(), int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), seed, _FAN):
                out.append(pd.DataFrame({"lo": lo, "hi": hi, "key": pdf["key"].to_numpy(), "first": first, "n": n}))
                first = first + n
            return pd.concat(out)

        nodes = nodes.groupBy("lo", "hi").applyInPandas(grow, "lo int, hi int, key string, first long, n long").where("n > 0")
        width = -(-width // (1 << _FAN))
    return nodes.select("key", F.col("lo").alias("shard"), "first", "n")


@dataclass
class Mix:
    sized: DataFrame  #: (row, doc_id, key, size) and, if asked for, all columns
    targets: DataFrame  #: (key, source_size, target, ...)
    placed: DataFrame  #: (row, copy, shard, position, words): every document that the mix takes


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0, keep: bool = False) -> Mix:
    """Sizes, targets and draws for docs (doc_id, text, source). keep: sized holds docs' own
    columns, packed in ``own``."""
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.col("source").isNull(), "2").otherwise(F.concat(F.lit("1"), F.col("source"))).alias("key"),
        size_of(F.col("text")).alias("size"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")] if keep else []))
    sized = checkpointed(base)
    t = checkpointed(targets(sized, weights, limit))
    full = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(limit)).cast("int")
    t = t.select("key", "source_size", "target", F.when(F.col("source_size") > 0, full).otherwise(0).alias("full"), F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("long").alias("blocks"))
    t = t.withColumn("rest", F.least(F.round("target").cast("long") - F.col("full") * F.col("source_size"), F.col("source_size")))
    t = checkpointed(t.withColumn("rest", F.greatest("rest", F.lit(0))))

    own = sized.where("size > 0").select("row", "doc_id", "key", "size").join(t, "key")
    block = lambda pass_: F.floor(_uniform(F.lit(seed), pass_, F.col("doc_id"), F.col("size")) * F.col("blocks")).cast("long")

    # The pass that is not whole: sums by block, then running sums in two levels.
    part = own.where("rest > 0").select("row", "doc_id", "key", "size", "rest", block(F.col("full")).alias("block"))
    sums = part.groupBy("key", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("group", F.floor(F.col("block") / 1024))
    sums = checkpointed(sums)
    up_to = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("key", "group").agg(F.sum("words").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(up_to), F.lit(0)))
    inside = Window.partitionBy("key", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.join(groups.select("key", "group", "base"), ["key", "group"]).withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    cut = checkpointed(placed.where("before < rest and rest <= before + words").select("key", F.col("block").alias("cut"), (F.col("rest") - F.col("before")).alias("left")))
    edge = part.join(cut, "key").where("block = cut")
    so_far = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), F.lit("edge"), "doc_id"), "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    edge = edge.select("row", F.greatest(F.least(F.col("left") - F.col("before"), F.col("size")), F.lit(0)).alias("edge"))

    quotas = t.join(cut, "key", "left").select("key", "blocks", (F.col("full") * F.col("blocks") + F.coalesce(F.col("cut") + 1, F.lit(0))).alias("n"))
    total = quotas.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    runs = leaves(quotas.where("n > 0"), shards, seed)
    draws = runs.select("key", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("draw"))

    copies = own.join(cut, "key", "left").join(edge, "row", "left")
    copies = copies.select(
        "row", "doc_id", "key", "size", "blocks", "full", "cut", "edge", F.explode(F.filter(F.sequence(F.lit(0), F.lit(limit)), lambda c: (c < F.col("full")) | ((c == F.col("full")) & (F.col("rest") > 0)))).alias("copy"))
    copies = copies.withColumn("block", block(F.col("copy")))
    words = F.when((F.col("copy") < F.col("full")) | (F.col("block") < F.col("cut")), F.col("size")).when(F.col("block") == F.col("cut"), F.col("edge")).otherwise(0)
    copies = copies.withColumn("words", words).where("words > 0").withColumn("draw", F.col("copy") * F.col("blocks") + F.col("block"))
    shuffled = F.xxhash64(F.lit(seed), F.lit("order"), "copy", "doc_id")
    return Mix(sized, t, copies.join(draws, ["key", "draw"]).select("row", "copy", "shard", shuffled.alias("position"), "words"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, shards) for every row of docs; shards
    lists where the tree puts the document: shard, position in it and words of each copy."""
    m = mix(docs.select("doc_id", "text", "source"), **options)
    # A document is taken at most ``limit`` times, so the list is short.
    place = F.array_sort(F.collect_list(F.struct("shard", "position", "words")))
    listed = F.array_join(F.transform(place, lambda x: F.concat_ws(":", x["shard"].cast("string"), x["position"].cast("string"), x["words"].cast("string"))), ",")
    per = m.placed.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("copies"), listed.alias("shards"))
    out = m.sized.join(per, "row", "left").join(m.targets, "key")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("shards", F.lit("")).alias("shards"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns once for every time a document is taken, with shard,
    position (its place in the shard), copy and words; a document taken in part has only
    its first words, with n_chars to match. Columns of docs by those names are replaced."""
    added = ("shard", "position", "copy", "words")
    m = mix(docs, keep=True, **options)
    out = m.placed.join(m.sized.select("row", "size", "own"), "row")
    own = [F.col(f"own.`{c}`").alias(c) for c in docs.columns if c not in (*added, "text", "n_chars")]
    text = F.when(F.col("words") < F.col("size"), F.expr("regexp_extract(own.text, concat('^(?:[\\\\x20\\\\x09-\\\\x0D]*+[^\\\\x20\\\\x09-\\\\x0D]++){', words, '}+'), 0)")).otherwise(F.col("own.text"))
    out = out.select(*own, text.alias("text"), *([F.col("own.n_chars").alias("__n")] if "n_chars" in docs.columns else []), "words", "size", "shard", "position", "copy")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("words") < F.col("size"), F.length("text").cast("long")).otherwise(F.col("__n")))
    return out.select(*(c for c in docs.columns if c not in added), *added)
