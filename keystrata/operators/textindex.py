"""A stored trigram index for substring search over listings.

``build`` writes three tables below a folder: the rows, with a number for each key, in slots by
a hash of the key; for every three characters that occur in a row's searched text a posting,
in buckets by trigram; and how many rows have each trigram. ``find`` looks up the rarest
trigrams of the needle, intersects their postings, reads only the slots that hold what is
left, and verifies there by the search that would scan everything. So its result is that of
the scan, while what it reads hangs on the hits.

A posting is the key's number, of which a stretch of rows gives one list of gaps for each of
its trigrams: lists are dealt and written, not single postings, and no key is written again.

Needles of under three characters are scanned for. Keys must be unique and not null. A
trigram that a large part of all rows has is spread over many files of its bucket; postings
are counted per number with map-side combine, so none gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.operators.listing import search

BUCKETS = 64
SLOTS = 64
RAREST = 4  #: trigrams of a needle that are intersected
_SPREAD = 8
_SLOT, _FILE, _NUMBER = "_slot", "_file", "_number"
_LISTS = 100  # that are unpacked at a time


def _text(fields: list[str], path: str | None) -> Column:
    """What ``search`` looks at, the path set apart."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hay = F.concat_ws(" ", *(blank(f) for f in fields))
    return F.lower(F.concat_ws("\u0000", hay, blank(path)) if path else hay)


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    # Looked ahead for at each character, so that they overlap.
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), F.lit(1)))


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, slot, base, gaps) out of (slot, number, grams) of rows: for each trigram of a batch
    and slot the lowest number and the steps from number to number (0 for the first)."""
    for batch in batches:
        slot, number = (batch.column(c).to_numpy() for c in ("slot", "number"))
        order = np.lexsort((number, slot))
        grams = batch.column("grams").take(pa.array(order))
        row, named = order[pc.list_parent_indices(grams).to_numpy()], grams.flatten().dictionary_encode()
        if not len(row):
            continue
        code = named.indices.to_numpy()
        by = np.argsort(code.astype(np.uint16) if len(named.dictionary) < 1 << 16 else code, kind="stable")
        code, slot, number = code[by], slot[row[by]], number[row[by]]
        gap = np.diff(number, prepend=number[0])
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (slot[1:] != slot[:-1]) | (gap[1:] >= 1 << 31)])
        gap[first] = 0
        gaps = pa.ListArray.from_arrays(pa.array(np.r_[first, len(gap)], pa.int32()), pa.array(gap, pa.int32()))
        yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(code[first])), pa.array(slot[first]), pa.array(number[first]), gaps], names=["gram", "slot", "base", "gaps"])


def _single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, number) of each posting of (slot, base, gaps)."""
    for batch in batches:
        for at in range(0, batch.num_rows, _LISTS):
            some = batch.slice(at, _LISTS)
            gaps = some.column("gaps")
            of = pc.list_parent_indices(gaps).to_numpy()
            run = np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
            first = np.searchsorted(of, np.arange(some.num_rows))  # no list is empty
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.column("slot").to_numpy()[of]), pa.array(some.column("base").to_numpy()[of] + run - run[first][of])], names=["slot", "number"])


def build(df: DataFrame, folder: str, key: str, fields: list[str], path: str | None = None, slots: int = SLOTS, buckets: int = BUCKETS) -> None:
    """Writes the index of df's rows over ``fields`` (and ``path``) to a folder."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    rows = df.withColumns({_SLOT: slot, _FILE: F.pmod(F.xxhash64(key, F.lit("file")), F.lit(_SPREAD))}).repartition(_SLOT, _FILE)
    # A key has one number; its rows are in one part already.
    rows = rows.withColumn(_NUMBER, F.monotonically_increasing_id())
    rows = rows.withColumn(_NUMBER, F.min(_NUMBER).over(Window.partitionBy(_SLOT, _FILE, key))).drop(_FILE)
    rows.write.mode("overwrite").partitionBy(_SLOT).parquet(f"{folder}/rows")
    # The numbers are those in the files, whatever tasks were run again.
    rows = df.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    held = rows.select(F.col(_SLOT).alias("slot"), F.col(_NUMBER).alias("number"), trigrams(_text(fields, path)).alias("grams"))
    held = held.mapInArrow(_listed, "gram string, slot int, base long, gaps array<int>")
    bucket = F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int")
    held = held.withColumn("bucket", bucket)
    dealt = held.repartition("bucket", F.pmod(F.xxhash64("slot"), F.lit(_SPREAD))).sortWithinPartitions("bucket", "gram", "slot", "base")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    written = df.sparkSession.read.schema(dealt.schema).parquet(f"{folder}/postings")
    written.groupBy("bucket", "gram").agg(F.sum(F.size("gaps")).alias("n")).repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/grams")


def candidates(spark: SparkSession, folder: str, needle: str, buckets: int = BUCKETS) -> DataFrame | None:
    """(number, slot) of the keys that have the rarest trigrams of a needle; None if it has none."""
    grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    if not grams:
        return None
    bucket = {g: zlib.crc32(g.encode()) % buckets for g in grams}
    of = lambda table, some: spark.read.parquet(f"{folder}/{table}").where(F.col("bucket").isin(sorted({bucket[g] for g in some})) & F.col("gram").isin(some))
    counts = {r["gram"]: r["n"] for r in of("grams", grams).collect()}  # a row a trigram of the needle
    chosen = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    found = of("postings", chosen).select("slot", "base", "gaps").mapInArrow(_single, "slot int, number long")
    found = found.groupBy("number", "slot").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(chosen)).select("number", "slot")


def find(spark: SparkSession, folder: str, query: str | None, key: str, fields: list[str], path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of an index that ``search`` finds, read by the index."""
    rows = spark.read.parquet(f"{folder}/rows")
    found = candidates(spark, folder, (query or "").strip().lower(), buckets)
    if found is not None:
        slots = [r[0] for r in found.select("slot").distinct().collect()]  # at most the number of slots
        rows = rows.where(F.col(_SLOT).isin(slots)) if slots else rows.where(F.lit(False))
        rows = rows.where(F.col(key).isNotNull()).join(found.select(F.col("number").alias(_NUMBER)), _NUMBER, "left_semi")
    return search(rows, query, fields, path).drop(_SLOT, _NUMBER)
