"""Joins of names found in files with the reference dimensions.

Every dimension side is a fixed list of at most about a hundred rows, hence the
broadcasts. Prefix and boundary rules are expanded into equality keys, so none of
these is a nested-loop join over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.dims import algorithms, apis, libraries, small, symbols
from keystrata.functions.binding import bind
from keystrata.functions.text import strip


def resolve_algorithm(df: DataFrame, name: str) -> DataFrame:
    """Adds algorithm_key, canonical_name, family, category and quantum_threat of the
    algorithm that column ``name`` spells; null where no spelling matches."""
    dim = small(df.sparkSession, algorithms.alias_rows())
    return df.join(dim, F.lower(strip(F.col(name))) == dim["alias"], "left").drop("alias")


def _longest_alias(name: Column, aliases: list[str]) -> Column:
    """The longest alias a name begins with that ends with the name, before a . or / or just
    after a /; empty if there is none. Alternatives are tried in their order, the longest first."""
    quoted = "|".join(rf"\Q{a}\E" for a in sorted(aliases, key=len, reverse=True) if a)
    return F.regexp_extract(name, rf"^(?:{quoted})(?:\z|(?=[./])|(?<=/))", 0)


def match_library(df: DataFrame, name: str, kind: str = "import") -> DataFrame:
    """Adds library, ecosystem, base_confidence and primary_algorithms.

    ``kind='import'`` takes the exact alias, else the longest alias that ends at a
    module or path boundary of the name. ``kind='package'`` takes exact names only.
    """
    spark = df.sparkSession
    low = F.lower(strip(F.col(name)))
    rows = libraries.library_alias_rows(f"{kind}_aliases")
    if kind == "package":
        dim = small(spark, rows).drop("alias_ordinal")
        return df.join(dim, low == dim["alias"], "left").drop("alias")
    dim = small(spark, rows).drop("alias_ordinal")
    keyed = bind(bind(df, _low=low), _alias=_longest_alias(F.col("_low"), [r["alias"] for r in rows])).drop("_low")
    keyed = keyed.withColumn("_alias", F.when(F.col("_alias") != "", F.col("_alias")))
    return keyed.join(dim, keyed["_alias"] == dim["alias"], "left").drop("_alias", "alias")


def match_api(
    df: DataFrame, language: str, call: str, qualified_only: bool = False
) -> DataFrame:
    """Adds the API entry (api_name, api_library, api_algorithm, api_category,
    api_confidence and argument rules) a call refers to in its language.

    The full dotted name is tried first, then its last part. ``qualified_only`` accepts
    full names alone, which avoids taking any ``x.new()`` for the first registered ``new``.
    """
    spark = df.sparkSession
    rows = [
        {
            "lookup_language": r["language"], "lookup_key": r["lookup_key"],
            "entry": {
                "api_name": r["api_name"], "api_library": r["library"], "api_algorithm": r["algorithm"],
                "api_category": r["category"], "api_confidence": r["base_confidence"],
                "key_arg": r["key_arg"], "mode_arg": r["mode_arg"], "curve_arg": r["curve_arg"],
                "algorithm_arg": r["algorithm_arg"],
            },
        }
        for r in apis.api_key_rows()
        if r["is_qualified"] or not qualified_only
    ]
    full_dim = small(spark, rows).withColumnRenamed("entry", "_full")
    low = F.lower(strip(F.col(call)))
    out = df.join(
        full_dim,
        (F.lower(F.col(language)) == full_dim["lookup_language"]) & (low == full_dim["lookup_key"]),
        "left",
    ).drop("lookup_language", "lookup_key")
    if not qualified_only:
        short_dim = small(spark, rows).withColumnRenamed("entry", "_short")
        out = out.join(
            short_dim,
            (F.lower(F.col(language)) == short_dim["lookup_language"])
            & (F.substring_index(low, ".", -1) == short_dim["lookup_key"]),
            "left",
        ).drop("lookup_language", "lookup_key")
        out = out.withColumn("_full", F.coalesce("_full", "_short")).drop("_short")
    return out.select(*df.columns, "_full.*")


def match_shared_lib(df: DataFrame, name: str) -> DataFrame:
    """Adds the library of a shared object file name: exact, else the first registered
    name whose part before ``.so`` starts the file name."""
    rows = libraries.library_alias_rows("shared_objects")
    low = F.lower(strip(F.col(name)))
    best = F.lit(None).cast("string")
    for r in reversed(rows):
        best = F.when(F.startswith(low, F.lit(r["alias"].split(".so")[0])), r["alias"]).otherwise(best)
    dim = small(df.sparkSession, rows).drop("alias_ordinal")
    exact = low.isin([r["alias"] for r in rows])
    keyed = df.withColumn("_alias", F.when(exact, low).otherwise(best))
    return keyed.join(dim, keyed["_alias"] == dim["alias"], "left").drop("_alias", "alias")


def match_symbol(df: DataFrame, symbol: str) -> DataFrame:
    """Adds library, algorithm, category and confidence of a binary symbol: exact and
    case-sensitive, else by the first of the registered prefixes."""
    spark = df.sparkSession
    columns = ["library", "algorithm", "category", "confidence"]
    exact_rows = [{"_key": r["symbol"], "_exact": {c: r[c] for c in columns}} for r in symbols.symbol_rows()]
    prefix_rows = [{"_prefix": r["prefix"], "_by_prefix": {c: r[c] for c in columns}} for r in symbols.prefix_rows()]
    first = F.lit(None).cast("string")
    for r in reversed(symbols.prefix_rows()):
        first = F.when(F.startswith(F.col(symbol), F.lit(r["prefix"])), r["prefix"]).otherwise(first)
    exact, prefixes = small(spark, exact_rows), small(spark, prefix_rows)
    out = df.join(exact, F.col(symbol) == exact["_key"], "left").drop("_key")
    out = out.withColumn("_first", F.when(F.col("_exact").isNull(), first))
    out = out.join(prefixes, out["_first"] == prefixes["_prefix"], "left")
    out = out.withColumn("_hit", F.coalesce("_exact", "_by_prefix"))
    return out.select(*df.columns, "_hit.*")
