"""One scan of a tree that holds source, binaries and extracted container filesystems.

Every file is read once. A row says what it is by its leading bytes, name and place, and is
tagged with the scanners it is for: ``repository`` for source, ``binary`` for executables and
libraries of a known format, ``container`` for what the container scanner looks at below one
of the filesystem roots. A file may be for several. What the scanners need of it (its text,
its printable strings) is written once; each scanner then reads its own part of that table.
Files over ``LARGE`` bytes are never read whole: they go by byte ranges.

Counters are observed while that table is written, not counted afterwards. A source file
that cannot be read as it is becomes an error row and is scanned as far as it goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.text import lookup
from keystrata.schemas import FINDINGS, conform
from keystrata.session import checkpointed
from keystrata.sources import container, files, ranges
from keystrata.sources.binary import scan_binaries, scan_binary_strings
from keystrata.sources.repository import ANALYZERS, identified, scan_repository, union_all

LARGE = 64 << 20
BINARY_FORMATS = ["ELF", "PE", "MACHO"]
#: Container files are looked for where no exclusion for source trees hides them.
EXCLUDES = [x for x in files.DEFAULT_EXCLUDES if x != "node_modules"]


def _below(path: Column, roots: tuple[str, ...]) -> Column:
    """Path within the first filesystem root it lies in, null outside of all."""
    out = F.lit(None).cast("string")
    for root in sorted(roots):
        start = f"{root.strip('/')}/" if root.strip("/") else ""
        out = F.when(F.startswith(path, F.lit(start)), F.substring(path, F.lit(len(start) + 1), F.length(path))).otherwise(out)
    return out


def _for_container(inner: Column) -> Column:
    """Whether the container scanner reads a file at this place of a filesystem."""
    folder, low = F.regexp_extract(inner, "^(.*)/[^/]*$", 1), F.lower(F.substring_index(inner, "/", -1))
    libraries = folder.isin(container.LIBRARY_DIRS) & (F.contains(low, F.lit(".so")) | F.endswith(low, F.lit(".dylib")))
    packages = "|".join(x.replace(".", r"\.") for x in (*container.SITE_PACKAGES, *container.NODE_MODULES))
    config = "|".join(container.TLS_DIRS)
    return libraries | (inner == container.DPKG_STATUS) | inner.rlike(f"^(?:{packages})/[^/]+/") | inner.rlike(f"^(?:{config})/")


def routed(found: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """Files (path, name, content) with language, binary_format, inner (path within the
    filesystem root) and targets, the scanners each is for; files for none of them stay."""
    df = files.with_binary_format(files.with_language(found))
    df = df.withColumn("inner", _below(F.col("path"), roots))
    excluded = files.excluded(F.col("path"), ["node_modules"])
    source = lookup(F.col("language"), ANALYZERS).isNotNull() & ~excluded & ~F.col("binary_format").isin(BINARY_FORMATS)
    tags = F.array(
        F.when(source, "repository"), F.when(F.col("binary_format").isin(BINARY_FORMATS), "binary"), F.when(_for_container(F.col("inner")), "container"))
    return df.withColumn("targets", F.array_compact(tags))


@dataclass
class Scan:
    """What a scan found; ``counters`` is one row."""

    findings: DataFrame
    errors: DataFrame
    counters: DataFrame


_COUNTERS = "files_discovered long, bytes_discovered long, files_scanned long, files_unclaimed long, files_errored long, source_files long, binary_files long, container_files long, large_files long"


def _parts(found: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """The tagged table: what any scanner needs of each file, and its error."""
    df = files.with_text(routed(found, roots))
    df = files.with_strings(df, F.array_contains("targets", "binary"))
    text = F.array_contains("targets", "repository") | F.array_contains("targets", "container") & ~F.array_contains("targets", "binary")
    error = F.when(F.col("content").isNull(), "unreadable").when(
        F.array_contains("targets", "repository") & ~F.is_valid_utf8(F.col("content").cast("string")), "invalid UTF-8")
    return df.select(
        "path", "name", "length", "language", "binary_format", "inner", "targets", error.alias("error"), F.when(text, F.col("text")).alias("text"), "strings")


def scan_files_mixed(found: DataFrame, roots: tuple[str, ...] = ("",), symbols: DataFrame | None = None, large: Scan | None = None) -> Scan:
    """Scans files (path, name, length, content) of any kinds; a name or length that is not
    given is that of the path or content. ``symbols`` (path, symbol, dll,
    binary_format) belong to the binaries among them; ``large`` is what was found elsewhere
    in files too large for a row."""
    spark = found.sparkSession
    given = {"name": F.substring_index("path", "/", -1), "length": F.length("content").cast("long")}
    found = found.withColumns({c: e for c, e in given.items() if c not in found.columns})
    seen = Observation()
    has = lambda t: F.array_contains("targets", t)
    count = lambda c: F.count_if(c)
    tagged = checkpointed(_parts(found, roots).observe(
        seen, F.count(F.lit(1)).alias("files_discovered"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_discovered"),
        count(F.size("targets") > 0).alias("files_scanned"), count(F.size("targets") == 0).alias("files_unclaimed"), count(F.col("error").isNotNull()).alias("files_errored"),
        count(has("repository")).alias("source_files"), count(has("binary")).alias("binary_files"), count(has("container")).alias("container_files")))
    source = tagged.where(has("repository")).select("path", "language", "text")
    strings = tagged.where(has("binary")).select("path", "binary_format", F.inline("strings"))
    parts = [scan_repository(source), scan_binary_strings(strings) if symbols is None else scan_binaries(strings, symbols)]
    parts += _container_findings(tagged.where(has("container")), roots)
    errors = tagged.where("error is not null").select("path", "error")
    row = {**seen.get, "large_files": 0}
    if large is not None:
        parts.append(large.findings)
        errors = errors.unionByName(large.errors)
        more = large.counters.first().asDict()
        row = {k: row[k] + more[k] for k in row}
    names = [x.split()[0] for x in _COUNTERS.split(", ")]
    return Scan(union_all([conform(p, FINDINGS) for p in parts]), errors, spark.createDataFrame([tuple(row[n] for n in names)], _COUNTERS))


def _scan_large(spark: SparkSession, root: str, exclude: list[str], over: int, roots: tuple[str, ...]) -> Scan:
    """Files over a size, by byte ranges: strings of binaries, patterns and calls of source,
    names of shared libraries. Package lists and configuration of that size are errors."""
    found = ranges.scan_ranges(spark, root, exclude=exclude, over=over)
    kinds = checkpointed(routed(ranges.range_files(found), roots).drop("content"))
    has = lambda t: F.array_contains("targets", t)
    sizes = files.list_files(spark, root, exclude).where(F.col("length") > over).agg(F.count(F.lit(1)), F.sum("length")).first()
    binaries = ranges.range_strings(found).join(kinds.where(has("binary")).select("path", "binary_format"), "path")
    n = kinds.agg(F.count_if(F.size("targets") > 0).alias("some"), *(F.count_if(has(t)).alias(t) for t in ("repository", "binary", "container"))).first()
    parts = [scan_binary_strings(binaries)]
    if n["repository"]:
        sources = kinds.where(has("repository")).select("path", "language")
        lines = ranges.read_lines(spark, root, exclude=exclude, over=over)
        parts.append(ranges.scan_source_chunks(ranges.source_chunks(lines.join(sources.select("path"), "path", "left_semi")).join(sources, "path")))
    inside = kinds.where(has("container")).withColumn("text", F.lit(None).cast("string"))
    parts += _container_findings(inside, roots)
    errors = inside.where(~has("binary") & ~has("repository")).select("path", F.lit("too large for a list or configuration").alias("error"))
    counters = [(sizes[0], sizes[1], n["some"], sizes[0] - n["some"], errors.count(), n["repository"], n["binary"], n["container"], sizes[0])]
    return Scan(union_all(parts), errors, spark.createDataFrame(counters, _COUNTERS))


def _container_findings(inside: DataFrame, roots: tuple[str, ...]) -> list[DataFrame]:
    """Findings of container files (path, name, inner, text), with their whole paths."""
    out = []
    for root in roots:
        start = f"{root.strip('/')}/" if root.strip("/") else ""
        own = inside.where(F.col("path") == F.concat(F.lit(start), "inner"))
        hits = container.scan_container(own.select(F.col("inner").alias("path"), "name", "text"), container.container_context(root=f"/{root.strip('/')}"))
        location = F.col("location").withField("file_path", F.concat(F.lit(start), F.col("location.file_path")))
        out.append(identified(hits.withColumn("location", location)) if start else hits)
    return out


def scan_tree(
    spark: SparkSession, root: str, roots: tuple[str, ...] = ("",), symbols: DataFrame | None = None, exclude: list[str] | None = None, large: int = LARGE,
) -> Scan:
    """Scans everything below a folder. ``roots`` are the folders in it that hold extracted
    container filesystems (by default the folder itself)."""
    exclude = EXCLUDES if exclude is None else exclude
    found = files.list_files(spark, root, exclude)
    some = found.where(F.col("length") > large).select("path").limit(1).count()
    return scan_files_mixed(files.scan_files(spark, root, exclude, max_bytes=large), roots, symbols, _scan_large(spark, root, exclude, large, roots) if some else None)
