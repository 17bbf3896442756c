"""Files as a table: listing, text, language and binary format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.binding import bind
from keystrata.functions.text import glob_to_regex, lookup, prefix_sums

# --- fixed values -----------------------------------------------------------
DEFAULT_EXCLUDES = [
    "node_modules", ".git", "dist", "build", "vendor", "__pycache__", ".venv", "venv", "env", ".tox",
    "target", "*.min.js", "*.bundle.js",
]

LANGUAGE_OF_EXTENSION = {
    "py": "python", "pyw": "python", "pyx": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "java": "java", "kt": "java",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
    "go": "go", "rs": "rust",
    "json": "manifest", "xml": "manifest", "toml": "manifest", "gradle": "manifest",
    "so": "binary", "dll": "binary", "exe": "binary", "o": "binary", "a": "binary", "lib": "binary",
    "dylib": "binary", "class": "binary", "pyc": "binary", "pyd": "binary", "jar": "binary",
    "war": "binary", "wasm": "binary",
}
MANIFEST_NAMES = [
    "requirements.txt", "requirements-dev.txt", "requirements-prod.txt", "package.json", "package-lock.json",
    "yarn.lock", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "go.mod", "go.sum",
    "Cargo.toml", "Cargo.lock", "pyproject.toml", "setup.py", "setup.cfg", "Gemfile", "Gemfile.lock",
    "composer.json",
]
# Leading bytes, in hex, that mark a file as binary.
BINARY_MAGIC = ["7F454C46", "4D5A", "CFFAED", "CEFAED", "504B0304", "7F4A4152", "CAFEBABE", "213C617263683E"]
# --- end of fixed values ----------------------------------------------------


def _relative(path: Column, root: str) -> Column:
    """Path below the scan root; the source reports paths as URIs."""
    bare = F.regexp_replace(path, "^[A-Za-z0-9]+:/*", "/")
    prefix = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(bare, F.lit(prefix)), F.substring(bare, F.lit(len(prefix) + 1), F.length(bare))).otherwise(bare)


def excluded(path: Column, exclude: list[str]) -> Column:
    """Whether any segment of the path matches one of the globs."""
    if not exclude:
        return F.lit(False)
    regex = "|".join(glob_to_regex(g) for g in exclude)
    return F.exists(F.split(path, "/"), lambda s: s.rlike(regex))


def list_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """Every file below the root that no exclusion covers. A plan that leaves out
    ``content`` does not open the files. Spark's file sources pass over files of zero
    length, which hold no evidence."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = raw.select(_relative(F.col("path"), root).alias("path"), "length", "modificationTime", "content")
    df = df.where(~excluded(F.col("path"), DEFAULT_EXCLUDES if exclude is None else exclude))
    return df.withColumn("name", F.substring_index("path", "/", -1))


def scan_files(
    spark: SparkSession, root: str, exclude: list[str] | None = None, max_bytes: int | None = None
) -> DataFrame:
    """path, name, length, modificationTime, content of eligible files. There is no size limit
    unless one is given; it is pushed to the source, so larger files are never read."""
    found = list_files(spark, root, exclude)
    found = found if max_bytes is None else found.where(F.col("length") <= max_bytes)
    return found.select("path", "name", "length", "modificationTime", "content")


def scan_counters(
    spark: SparkSession, root: str, exclude: list[str] | None = None, max_bytes: int | None = None
) -> DataFrame:
    """One row: directories that hold files, files discovered, files over the limit."""
    folder = F.when(F.contains(F.col("path"), F.lit("/")), F.regexp_extract("path", "^(.*)/", 1)).otherwise("")
    return list_files(spark, root, exclude).agg(
        F.count_distinct(folder).alias("directories_visited"),
        F.count(F.lit(1)).alias("files_discovered"),
        F.count_if(F.lit(False) if max_bytes is None else F.col("length") > max_bytes).alias("files_skipped_too_large"),
    )


def with_text(files: DataFrame) -> DataFrame:
    """Adds the content as text: invalid UTF-8 replaced, line ends unified."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("text", F.regexp_replace(text, "\\r\\n?", "\n"))


def read_problems(files: DataFrame) -> DataFrame:
    """(path, error) for source files that cannot be read as they are: no content, or bytes
    that are no UTF-8 (their text has replacement characters instead)."""
    error = F.when(F.col("content").isNull(), "unreadable").when(~F.is_valid_utf8(F.col("content").cast("string")), "invalid UTF-8")
    source = ~F.col("language").isin("binary", "unknown") if "language" in files.columns else F.lit(True)
    return files.where(source).select("path", error.alias("error")).where(F.col("error").isNotNull())


def _head(n: int) -> Column:
    return F.hex(F.substring(F.col("content"), F.lit(1), F.lit(n)))


def with_language(files: DataFrame) -> DataFrame:
    """Adds language: binary by leading bytes, then manifest by name, then extension."""
    head = F.col("_head")
    magic = F.lit(False)
    for m in BINARY_MAGIC:
        magic = magic | F.startswith(head, F.lit(m))
    extension = F.lower(F.regexp_extract("name", r"[^.]\.([^.]+)$", 1))
    df = bind(files, _head=_head(8))
    return df.withColumn(
        "language",
        F.when(magic, "binary")
        .when(F.col("name").isin(MANIFEST_NAMES), "manifest")
        .otherwise(F.coalesce(lookup(extension, LANGUAGE_OF_EXTENSION), F.lit("unknown"))),
    ).drop("_head")


def files_by_language(files: DataFrame) -> DataFrame:
    """Files and bytes per language that can be analysed as source."""
    return files.where(~F.col("language").isin("binary", "unknown")).groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def with_binary_format(files: DataFrame) -> DataFrame:
    """Adds binary_format by leading bytes. A fat executable and a class file share their
    first four bytes; the number that follows is small only for the former."""
    head = F.col("_head")
    starts = lambda m: F.startswith(head, F.lit(m))
    count = F.conv(F.substring(head, 9, 8), 16, 10).cast("long")
    df = bind(files, _head=_head(16))
    return df.withColumn(
        "binary_format",
        F.when(starts("7F454C46"), "ELF")
        .when(starts("4D5A"), "PE")
        .when(starts("CFFAEDFE") | starts("CEFAEDFE"), "MACHO")
        .when(starts("CAFEBABE") & (F.length(head) >= 16) & (count < 20), "MACHO")
        .when(starts("213C617263683E"), "ARCHIVE")
        .otherwise("UNKNOWN"),
    ).drop("_head")


def with_strings(files: DataFrame, where: Column, min_length: int = 6) -> DataFrame:
    """Adds strings: the runs of printable ASCII of at least ``min_length`` bytes, as structs
    (position, string, byte_offset), of the files for which ``where`` holds, none for others.

    One byte is one character in ISO-8859-1. Offsets are running sums of piece lengths.
    """
    run = f"[\\x20-\\x7e]{{{min_length},}}"
    df = bind(files, _bytes=F.when(where, F.decode("content", "ISO-8859-1")).otherwise(""))
    df = bind(
        df,
        _strings=F.coalesce(F.regexp_extract_all("_bytes", F.lit(run), F.lit(0)), F.array().cast("array<string>")),
        _gaps=F.transform(F.split("_bytes", run, -1), F.length),
    ).drop("_bytes")
    df = bind(df, _steps=F.transform("_strings", lambda s, i: F.get(F.col("_gaps"), i) + F.length(s)))
    df = prefix_sums(df, _before="_steps")
    found = F.transform("_strings", lambda s, i: F.struct(
        i.alias("position"), s.alias("string"), (F.get(F.col("_before"), i) + F.get(F.col("_gaps"), i)).alias("byte_offset")))
    return df.withColumn("strings", found).drop("_strings", "_gaps", "_steps", "_before")


def printable_strings(files: DataFrame, min_length: int = 6) -> DataFrame:
    """Runs of printable ASCII of at least ``min_length`` bytes: path, position, string,
    byte_offset (other columns but content stay)."""
    keep = [c for c in files.columns if c != "content"]
    return with_strings(files, F.lit(True), min_length).select(*keep, F.inline("strings"))
