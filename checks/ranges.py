"""Checks of files read by byte ranges: the documents, written as text files of many each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import table
from keystrata.session import checkpoint_folder
from keystrata.sources import files, ranges

QUERIES, SQL = {}, {}
RANGE = 256 << 10  #: bytes of a range, so that the files of the small tables have several
GROUP = 2000  #: document ids of a file


def check(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return register


def written(spark: SparkSession, sf: str) -> str:
    """A folder with a file for each language and run of ids, documents in order of their ids."""
    docs = table(spark, sf, "documents").where("text is not null").select("lang", F.floor(F.col("doc_id") / GROUP).alias("part"), "doc_id", "text")
    folder = f"{checkpoint_folder(spark)}/documents-{uuid.uuid4()}"
    docs.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id").select("lang", "part", "text").write.partitionBy("lang", "part").text(folder)
    return folder


def named(df: DataFrame) -> DataFrame:
    """lang and part instead of the path."""
    part = lambda k: F.regexp_extract("path", rf"{k}=([^/]*)/", 1)
    return df.select(part("lang").alias("lang"), part("part").cast("long").alias("part"), *(c for c in df.columns if c not in ("path", "name")))


_DOCS = f"""docs AS (SELECT lang, doc_id // {GROUP} AS part, doc_id, text,
  coalesce(sum(strlen(text) + 1) OVER (PARTITION BY lang, doc_id // {GROUP} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM documents WHERE text IS NOT NULL)"""
_LINES = f"""{_DOCS},
line AS (SELECT lang, part, doc_id, base, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
lines AS (SELECT lang, part, l, row_number() OVER w AS line, base + coalesce(sum(strlen(l) + 1) OVER (PARTITION BY lang, part, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_offset
  FROM line WINDOW w AS (PARTITION BY lang, part ORDER BY doc_id, i))"""


@check("range_lines", f"WITH {_LINES} SELECT lang, part, line, CAST(byte_offset AS BIGINT) AS byte_offset, CAST(strlen(l) AS INT) AS bytes, md5(l) AS digest FROM lines")
def _(spark, sf):
    found = ranges.read_lines(spark, written(spark, sf), range_bytes=RANGE)
    return named(found.select("path", "line", "byte_offset", F.octet_length("value").alias("bytes"), F.md5("value").alias("digest")))


@check("range_strings", rf"""WITH {_DOCS}, cut AS (SELECT lang, part, doc_id, base, regexp_extract_all(text, '[\x20-\x7e]{{6,}}') AS found, string_split_regex(text, '[\x20-\x7e]{{6,}}') AS gaps FROM docs),
each AS (SELECT lang, part, doc_id, base, unnest(found) AS string, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM cut)
SELECT lang, part, row_number() OVER (PARTITION BY lang, part ORDER BY doc_id, i) - 1 AS position, string,
  CAST(base + sum(strlen(gap) + strlen(string)) OVER (PARTITION BY lang, part, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - strlen(string) AS BIGINT) AS byte_offset FROM each""")
def _(spark, sf):
    return named(ranges.range_strings(ranges.scan_ranges(spark, written(spark, sf), range_bytes=RANGE)))


@check("range_files", f"""WITH {_DOCS} SELECT lang, part, CAST(sum(len(text) - len(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines, 'unknown' AS language, 'UNKNOWN' AS binary_format FROM docs GROUP BY lang, part""")
def _(spark, sf):
    found = ranges.range_files(ranges.scan_ranges(spark, written(spark, sf), range_bytes=RANGE))
    return named(files.with_binary_format(files.with_language(found)).drop("content"))


@check("read_text", "SELECT lang, doc_id // 2000 AS part, md5(string_agg(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10), '' ORDER BY doc_id)) AS digest FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return named(files.with_text(files.scan_files(spark, written(spark, sf))).select("path", F.md5("text").alias("digest")))
