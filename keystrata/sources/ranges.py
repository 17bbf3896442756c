"""Files read by byte ranges, so that no file has to fit into a row, a task or an executor.

Spark's text source cuts files into ranges and hands every line to the range its first byte
is not before; the line that crosses a border is read on from the next range. Lines of a
range thus tile the file without gaps, and byte offsets, line numbers and string positions
are running numbers within a range plus the totals of the ranges before it. Those totals
(one row a range) are all that is ever put in order for a whole file.

A printable string holds no line end, so strings are found line by line as well. Source
files are cut into chunks of whole lines for the scanners, each with the head of what
follows as overlap; see ``source_chunks``.

Offsets are exact for any file the source can read. Files compressed by extension are read
unpacked (offsets count unpacked bytes). One line may have up to 2 GiB. Files without any
byte are passed over, as by all of Spark's sources.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.session import checkpointed
from keystrata.sources import repository
from keystrata.sources.files import DEFAULT_EXCLUDES, _relative, excluded

HEAD = 16  #: leading bytes kept of each file, by which formats are told
CHUNK = 16 << 20  #: bytes of a source chunk (plus the line that crosses its end)
OVERLAP = 64 << 10  #: bytes of the following lines that a chunk sees as well
_RANGE = "spark.sql.files.maxPartitionBytes"


@contextmanager
def _ranges_of(spark: SparkSession, size: int | None):
    """Ranges of at most ``size`` bytes for what is read inside."""
    before = spark.conf.get(_RANGE)
    if size is not None:
        spark.conf.set(_RANGE, str(size))
    try:
        yield
    finally:
        spark.conf.set(_RANGE, before)


def _lines(spark: SparkSession, root: str, exclude: list[str] | None, over: int = -1) -> DataFrame:
    """path, range (where it begins) and bytes of every line, in file order within a range.
    Files of up to ``over`` bytes are never opened."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(root).where(F.col("_metadata.file_size") > over)
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = _relative(uri, root)
    df = raw.select(path.alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))
    return df.where(~excluded(F.col("path"), DEFAULT_EXCLUDES if exclude is None else exclude))


class _Running:
    """Offset and number of each line within its range, batch after batch of a task."""

    def __init__(self):
        self.last, self.at, self.n = None, 0, 0

    def of(self, path: pa.Array, start: pa.Array, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset, number, first of a range in this batch) of each line."""
        rows = len(length)
        new = np.zeros(rows, bool)
        new[1:] = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
        goes_on = (path[0].as_py(), start[0].as_py()) == self.last
        first = np.flatnonzero(np.r_[True, new[1:]])
        sizes = np.diff(np.r_[first, rows])
        ends = np.cumsum(length + 1)
        at = ends - length - 1 - np.repeat(ends[first] - length[first] - 1, sizes)
        n = np.arange(rows) - np.repeat(first, sizes)
        if goes_on:
            at[: sizes[0]] += self.at
            n[: sizes[0]] += self.n
        self.last = (path[rows - 1].as_py(), start[rows - 1].as_py())
        self.at, self.n = int(at[-1] + length[-1] + 1), int(n[-1]) + 1
        return at, n, first[1:] if goes_on else first


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    running = _Running()
    for batch in batches:
        if batch.num_rows:
            at, n, _ = running.of(batch.column(0), batch.column(1), pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(n)], names=["path", "range", "value", "at", "n"])


def _before(totals: DataFrame, *columns: str) -> DataFrame:
    """Each range's sums of the columns over the ranges before it in the file."""
    earlier = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("path", "range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns))


def read_lines(spark: SparkSession, root: str, exclude: list[str] | None = None, range_bytes: int | None = None, over: int = -1) -> DataFrame:
    """(path, line, byte_offset, value): every line of every file, its number from 1, where it
    begins, and its bytes without the line end. Read once and written to the shared folder.
    Files of up to ``over`` bytes are left out."""
    with _ranges_of(spark, range_bytes):
        found = checkpointed(_lines(spark, root, exclude, over).mapInArrow(_numbered, "path string, range long, value binary, at long, n long"))
    totals = found.groupBy("path", "range").agg(F.max(F.col("at") + F.octet_length("value") + 1).alias("bytes"), F.count("*").alias("lines"))
    return found.join(_before(totals, "bytes", "lines"), ["path", "range"]).select(
        "path", (F.col("n") + F.col("lines_before") + 1).alias("line"), (F.col("at") + F.col("bytes_before")).alias("byte_offset"), "value")


def printable_runs(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` printable bytes that cross none of ``ends``."""
    good = (data >= 0x20) & (data <= 0x7E)
    before, after = np.r_[False, good[:-1]], np.r_[good[1:], False]
    inner = ends[(ends > 0) & (ends < len(data))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(good & ~before), np.flatnonzero(good & ~after) + 1
    long = end - start >= least
    return start[long], end[long]


def _strings(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, sums = _Running(), {}  # of the range at hand: lines, bytes, strings and head
        schema = pa.schema([("path", pa.string()), ("range", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("line", pa.int64()),
                            ("string", pa.string()), ("bytes", pa.int64()), ("head", pa.binary())])

        def summary():
            row = {"path": sums["path"], "range": sums["range"], "at": None, "n": sums["strings"], "line": sums["lines"], "string": None, "bytes": sums["bytes"], "head": sums["head"][:HEAD]}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            path, start, value = batch.columns
            length = pc.binary_length(value).to_numpy().astype(np.int64)
            at, n, first = running.of(path, start, length)
            offsets = np.frombuffer(value.buffers()[1], np.int32)[value.offset : value.offset + len(value) + 1].astype(np.int64)
            data = np.frombuffer(value.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            low, high = printable_runs(data, offsets[1:-1], least)
            row = np.searchsorted(offsets, low, side="right") - 1
            for a, b in zip(np.unique(np.r_[0, first]), np.unique(np.r_[0, first])[1:].tolist() + [batch.num_rows]):
                if a in first:
                    if sums:
                        yield summary()
                    sums = {"path": path[a].as_py(), "range": start[a].as_py(), "strings": 0, "lines": 0, "bytes": 0, "head": b""}
                k = a
                while start[int(a)].as_py() == 0 and len(sums["head"]) < HEAD and k < b:
                    more = value[int(k)].as_py()
                    sums["head"] += (b"\n" if sums["lines"] or k > a else b"") + more[:HEAD]
                    k += 1
                own = slice(*np.searchsorted(row, [a, b]))
                count = own.stop - own.start
                texts = [data[i:j].tobytes().decode("ascii") for i, j in zip(low[own], high[own])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([sums["path"]] * count, pa.string()), pa.array([sums["range"]] * count, pa.int64()),
                    pa.array(low[own] - offsets[row[own]] + at[row[own]], pa.int64()), pa.array(np.arange(count) + sums["strings"], pa.int64()),
                    pa.array(n[row[own]], pa.int64()), pa.array(texts, pa.string()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.binary()),
                ], schema=schema)
                sums["strings"] += count
                sums["lines"] += int(b - a)
                sums["bytes"] = int(at[b - 1] + length[b - 1] + 1)
        if sums:
            yield summary()

    return run


def scan_ranges(
    spark: SparkSession, root: str, min_length: int = 6, exclude: list[str] | None = None, range_bytes: int | None = None, over: int = -1,
) -> DataFrame:
    """What one read of all files (of over ``over`` bytes) finds, written to the shared folder:
    a row for each printable string of each range, and one (without string) that sums the
    range up."""
    schema = "path string, range long, at long, n long, line long, string string, bytes long, head binary"
    with _ranges_of(spark, range_bytes):
        return checkpointed(_lines(spark, root, exclude, over).mapInArrow(_strings(min_length), schema))


def range_files(found: DataFrame) -> DataFrame:
    """(path, name, lines, content): each file of a scan with its first bytes as content, from
    which ``with_language`` and ``with_binary_format`` tell what it is."""
    sums = found.where("string is null").groupBy("path").agg(F.sum("line").alias("lines"), F.min_by("head", "range").alias("content"))
    return sums.select("path", F.substring_index("path", "/", -1).alias("name"), "lines", "content")


def range_strings(found: DataFrame) -> DataFrame:
    """(path, position, string, byte_offset) of a scan, as ``printable_strings`` gives them."""
    sums = found.where("string is null").select("path", "range", "bytes", F.col("n").alias("strings"))
    return found.where("string is not null").join(_before(sums, "bytes", "strings"), ["path", "range"]).select(
        "path", (F.col("n") + F.col("strings_before")).alias("position"), "string", (F.col("at") + F.col("bytes_before")).alias("byte_offset"))


def source_chunks(lines: DataFrame, chunk_bytes: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(path, chunk, base_line, base_place, own_place, text) of ``read_lines``: whole lines of
    at most ``chunk_bytes`` and the first ``overlap`` bytes of lines that follow. Text is as
    ``with_text`` reads it; places count characters."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("value").cast("string")), "\\r$", "")
    text = F.regexp_replace(text, "\\r", "\n")
    chunk = F.floor(F.col("byte_offset") / chunk_bytes).cast("int")
    rows = lines.select("path", "line", text.alias("text"), chunk.alias("chunk"), (F.col("byte_offset") % chunk_bytes < overlap).alias("near"))
    rows = rows.select("*", F.explode(F.when(F.col("near") & (F.col("chunk") > 0), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("own"))
    rows = rows.withColumn("chunk", F.when(F.col("own"), F.col("chunk")).otherwise(F.col("chunk") - 1))
    whole = rows.groupBy("path", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("line", "text"))).alias("held"), F.count_if("own").alias("own_lines"),
        F.sum(F.when(F.col("own"), F.length("text") + 1).otherwise(0)).alias("own_place"),
        F.sum(F.when(F.col("own"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0)).alias("lines"))
    # A chunk in which no line begins holds nothing but what the one before has.
    whole = whole.where("own_lines > 0")
    earlier = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = whole.select("path", "chunk", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for c, n in (("lines", "base_line"), ("own_place", "base_place"))))
    return whole.join(sums, ["path", "chunk"]).select(
        "path", "chunk", "base_line", "base_place", "own_place", F.array_join(F.transform("held", lambda x: x["text"]), "\n").alias("text"))


def scan_source_chunks(chunks: DataFrame) -> DataFrame:
    """Repository findings of (path, language and the columns of ``source_chunks``): those of
    the whole files wherever a match, call or string literal is no longer than the overlap
    beyond its chunk. Imports of any chunk count for the whole file."""
    mark = "\u0000"
    part = F.concat_ws(mark, "path", F.col("chunk").cast("string"))
    known = chunks.groupBy("path").agg(F.bool_or(F.col("text").rlike("crypto|jsonwebtoken")).alias("known"))
    source = checkpointed(chunks.join(known, "path").select(part.alias("path"), "language", "text", "known", F.col("path").alias("file"), "base_line", "base_place", "own_place"))
    src = source.select("path", "language", "text", "known")
    hits = checkpointed(repository.source_hits(repository.analyzable(src)))
    places = source.select("path", "file", "base_line", "base_place", "own_place")
    named = repository._imported_libraries(src, hits).join(places.select("path", "file"), "path").select("file", "module").distinct()
    imports = named.join(places.select("path", "file"), "file").select("path", "module")
    found = repository.union_all([
        repository.scan_imports(src, hits), repository.scan_api_calls(src, hits=hits, imports=imports), repository.scan_java_factories(src, hits),
        repository.scan_evp_ciphers(src, hits), repository.scan_patterns(src)])
    return _moved(found, places)


def _moved(found: DataFrame, places: DataFrame) -> DataFrame:
    """Findings of chunks as findings of their files."""
    names = found.columns
    place = F.col("emit_seq") % 2**40
    rows = found.withColumn("_path", F.col("location.file_path")).join(places.withColumnRenamed("path", "_path"), "_path").where(place < F.col("own_place"))
    location = F.col("location").withField("file_path", F.col("file")).withField("start_line", (F.col("location.start_line") + F.col("base_line")).cast("int"))
    rows = rows.withColumns({"location": location, "emit_seq": F.col("emit_seq") + F.col("base_place")})
    return repository.identified(rows).select(*names)
