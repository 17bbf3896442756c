"""Findings from binaries: printable strings, symbols, and their correlation.

Strings come from ``printable_strings``; symbols from a table (path, symbol, dll) that any
symbol lister can write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.dims import patterns
from keystrata.dims import symbols as symbols_dim
from keystrata.functions.binding import bind
from keystrata.functions.text import lookup, pattern
from keystrata.operators.lookups import match_symbol
from keystrata.session import checkpointed
from keystrata.sources.repository import emission, finding

_STRINGS, _SYMBOLS, _CORRELATOR = "BinaryScanner/StringAnalyzer", "BinaryScanner/SymbolInspector", "BinaryScanner/Correlator"

# --- fixed values -----------------------------------------------------------
STRING_FACTOR, STRING_CAP, STRING_FLOOR = 0.55, 0.50, 0.28
BOOST, BOOST_CAP, KEEP_FLOOR, LIBRARY_FLOOR, SUMMARY_SYMBOLS, SUMMARY_SCORE = 0.15, 0.65, 0.35, 0.80, 3, 0.95
# --- end of fixed values ----------------------------------------------------

_PER_STEP = 8


def _seq(phase: int, index: Column | int, ordinal: Column | int = 0) -> Column:
    """Strings lie at different offsets, and a string has fewer matches than characters."""
    ordinal = ordinal if isinstance(ordinal, Column) else F.lit(ordinal)
    return emission(phase, index, F.coalesce("byte_offset", F.lit(0)) + ordinal)


def first_pattern(df: DataFrame, text: str) -> DataFrame:
    """Adds pattern_ordinal and symbol of the first pattern, in order, that the text holds
    and whose reduced score is not below the floor. Null where there is none."""
    rows = [
        r for r in patterns.pattern_rows()
        if min(r["base_confidence"] * STRING_FACTOR, STRING_CAP) >= STRING_FLOOR
    ]
    stems = pattern(r"\b(?:" + "|".join(patterns.STEMS) + r')|-----BEGIN|"alg"')
    names = []
    df = bind(df, _maybe=F.col(text).rlike(stems))
    for n in range(0, len(rows), _PER_STEP):
        name = f"_p{n}"
        hit = F.lit(None).cast("int")
        for r in reversed(rows[n:n + _PER_STEP]):
            hit = F.when(F.col(text).rlike(pattern(r["regex"])), r["pattern_ordinal"]).otherwise(hit)
        df = bind(df, **{name: F.when(F.col("_maybe"), hit)})
        names.append(name)
    df = bind(df, pattern_ordinal=F.coalesce(*names))
    symbol = F.lit(None).cast("string")
    for n in range(0, len(rows), _PER_STEP):
        part = F.lit(None).cast("string")
        for r in reversed(rows[n:n + _PER_STEP]):
            part = F.when(F.col("pattern_ordinal") == r["pattern_ordinal"], F.regexp_extract(text, pattern(r["regex"]), 0)).otherwise(part)
        df = bind(df, **{f"_s{n}": part})
    symbol = F.coalesce(*[f"_s{n}" for n in range(0, len(rows), _PER_STEP)])
    return bind(df, symbol=symbol).drop("_maybe", *names, *[f"_s{n}" for n in range(0, len(rows), _PER_STEP)])


_HITS = "array<struct<index:int,ordinal:int,category:string,score:double,rationale:string,symbol:string,algorithm:string,library:string,text:string>>"


def _hit(index: Column | int, ordinal: Column | int, category: Column | str, score: Column | float, rationale: Column | str, symbol: Column,
         algorithm: Column | None = None, library: Column | None = None, text: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    cells = dict(index=lit(index).cast("int"), ordinal=lit(ordinal).cast("int"), category=lit(category), score=lit(score).cast("double"), rationale=lit(rationale), symbol=symbol,
                 algorithm=none if algorithm is None else algorithm, library=none if library is None else library, text=F.col("string") if text is None else text)
    return F.struct(*(c.alias(n) for n, c in cells.items()))


def scan_binary_strings(strings: DataFrame) -> DataFrame:
    """Findings per string (path, position, string, byte_offset, binary_format): library
    version strings, cipher suites, a PEM header, or else the first general pattern. All hits
    of a string are one array, so the strings are read once."""
    s = F.col("string")
    empty = F.array().cast(_HITS)
    versions = F.filter(F.array(*[
        F.struct(F.lit(i).alias("index"), F.lit(lib).alias("library"), F.lit(conf).alias("score"), s.rlike(pattern(rx)).alias("hit"))
        for i, (rx, lib, conf) in enumerate(patterns.LIBRARY_VERSION_STRINGS)]), lambda v: v["hit"])
    libraries = F.transform(versions, lambda v: _hit(
        v["index"], 0, "LIBRARY", v["score"], F.format_string("version string of %s | score=%.2f", v["library"], v["score"]), s, library=v["library"]))
    suites = F.transform(F.regexp_extract_all("string", F.lit(pattern(patterns.BINARY_CIPHER_SUITE)), F.lit(0)), lambda x, i: _hit(
        20, i, "PROTOCOL", 0.72, "cipher suite string | score=0.72", x, algorithm=F.lit("TLS")))
    header = F.regexp_extract("string", pattern(patterns.BINARY_PEM_HEADER, False), 0)
    df = bind(
        strings, _pem=F.when(F.contains(s, F.lit("-----BEGIN")), header).otherwise(""),
        _libraries=F.when(s.rlike(pattern("ssl|tls|sodium|nss|nettle|bouncycastle")), libraries.cast(_HITS)).otherwise(empty),
        _suites=F.when(F.contains(F.upper("string"), F.lit("TLS_")), suites.cast(_HITS)).otherwise(empty))
    df = first_pattern(df, "string")
    rows = {r["pattern_ordinal"]: r for r in patterns.pattern_rows()}
    of = lambda field: lookup(F.col("pattern_ordinal"), {k: r[field] for k, r in rows.items() if r[field] is not None})
    df = bind(df, _score=F.least(of("base_confidence") * STRING_FACTOR, F.lit(STRING_CAP)), _name=of("pattern"), _category=of("category"), _algorithm=of("algorithm"))
    pem = _hit(21, 0, "KEY_MATERIAL", 0.90, "PEM header in a binary | score=0.90", F.col("_pem"), text=F.col("_pem"))
    plain = _hit(22, 0, F.col("_category"), F.col("_score"), F.format_string("pattern %s in a binary string | score=%.2f", "_name", "_score"), F.col("symbol"), algorithm=F.col("_algorithm"))
    df = bind(df, _all=F.concat(
        "_libraries", "_suites", F.when(F.col("_pem") != "", F.array(pem).cast(_HITS)).otherwise(empty),
        F.when((F.col("_pem") == "") & F.col("pattern_ordinal").isNotNull(), F.array(plain).cast(_HITS)).otherwise(empty)))
    hits = df.select("path", "byte_offset", "binary_format", F.inline("_all")).withColumnRenamed("text", "snippet")
    return finding(
        hits, "STRING_ANALYSIS", F.col("category"), _STRINGS, _seq(1, F.col("index"), F.col("ordinal")), F.col("score"), F.col("rationale"), F.col("symbol"),
        suspected_algorithm=F.col("algorithm"), library_hint=F.col("library"), binary_format=F.col("binary_format"))


def scan_symbols(symbols: DataFrame) -> DataFrame:
    """Findings for the distinct known symbols of each binary (path, symbol, dll,
    binary_format), in the order of ``ordinal`` where the listing has it, else of a hash."""
    order = F.min("ordinal") if "ordinal" in symbols.columns else F.pmod(F.xxhash64(F.min("symbol")), F.lit(2**40))
    distinct = symbols.groupBy("path", "symbol").agg(
        F.min("dll").alias("dll"), F.min("binary_format").alias("binary_format"), order.alias("place")
    )
    hits = match_symbol(distinct, "symbol").where(F.col("library").isNotNull())
    hits = hits.withColumn("position", F.lit(0)).withColumn(
        "snippet",
        F.concat_ws(" | ", F.concat(F.lit("Symbol: "), "symbol"), F.concat(F.lit("Library: "), "library"),
                    F.when(F.col("dll") != "", F.concat(F.lit("DLL: "), "dll"))),
    )
    return finding(
        hits, "SYMBOL_INSPECTION", F.col("category"), _SYMBOLS, F.col("place"), F.col("confidence"),
        F.format_string("symbol of %s for %s | score=%.2f", "library", "algorithm", "confidence"), F.col("symbol"),
        suspected_algorithm=F.col("algorithm"), library_hint=F.col("library"), symbol_name=F.col("symbol"),
        binary_format=F.col("binary_format"),
    )


def _registered() -> list[str]:
    """All algorithms that a symbol can stand for, in a fixed order."""
    return sorted({r["algorithm"] for r in (*symbols_dim.symbol_rows(), *symbols_dim.prefix_rows()) if r["algorithm"]})


def algorithm_bits(symbols: DataFrame) -> DataFrame:
    """(_path, _bits): the registered algorithms that each binary's symbols stand for, as bit
    sets over the registry, 63 algorithms a number. One aggregation with map-side combine."""
    place = lookup(F.col("suspected_algorithm"), {a: i for i, a in enumerate(_registered())})
    sets = range(-(-len(_registered()) // 63))
    words = [F.bit_or(F.when(F.floor(place / 63) == k, F.pow(F.lit(2), place % 63).cast("long")).otherwise(0)).alias(f"_{k}") for k in sets]
    return symbols.groupBy(F.col("location.file_path").alias("_path")).agg(*words).select("_path", F.array(*(f"_{k}" for k in sets)).alias("_bits"))


def correlate(strings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol findings plus the string findings they do not make redundant.

    A string finding that repeats a symbol of its binary goes. Sure library and key
    findings stay. A string whose algorithm the symbols confirm gains confidence; an
    unconfirmed one stays only above the floor. The symbols are written once; strings are
    judged against one row of bit sets for each binary.
    """
    symbols = checkpointed(symbols)
    path = F.col("location.file_path")
    rest = strings.withColumn("_path", path).join(symbols.select(path.alias("_path"), "raw_symbol"), ["_path", "raw_symbol"], "left_anti")
    rest = rest.join(algorithm_bits(symbols), "_path", "left")
    place = lookup(F.col("suspected_algorithm"), {a: i for i, a in enumerate(_registered())})
    word = F.get(F.col("_bits"), F.floor(place / 63).cast("int"))
    held = F.coalesce(word.bitwiseAND(F.pow(F.lit(2), place % 63).cast("long")) != 0, F.lit(False))
    score = F.col("confidence_score")
    always = ((F.col("artifact_category") == "LIBRARY") & (score >= LIBRARY_FLOOR)) | F.col("artifact_category").isin(
        "KEY_MATERIAL", "CERTIFICATE"
    )
    confirmed = ~always & held
    kept = rest.where(always | confirmed | (score >= KEEP_FLOOR))
    kept = kept.withColumn(
        "confidence_rationale",
        F.when(confirmed, F.concat("confidence_rationale", F.lit(" | confirmed by a symbol"))).otherwise(F.col("confidence_rationale")),
    ).withColumn("confidence_score", F.when(confirmed, F.least(score + BOOST, F.lit(BOOST_CAP))).otherwise(score))
    return symbols.unionByName(kept.select(*symbols.columns))


def library_summary(symbols: DataFrame, correlated: DataFrame) -> DataFrame:
    """One sure LIBRARY finding per binary and library with at least three symbols, unless
    a library finding of it is there already."""
    counts = (
        symbols.where(F.col("library_hint").isNotNull())
        .groupBy(F.col("location.file_path").alias("path"), "library_hint")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= SUMMARY_SYMBOLS)
    )
    present = correlated.where(F.col("artifact_category") == "LIBRARY").select(
        F.col("location.file_path").alias("path"), "library_hint"
    ).distinct()
    rows = counts.join(present, ["path", "library_hint"], "left_anti").withColumn(
        "snippet", F.format_string("%d cryptographic symbols of %s", "n", "library_hint")
    ).withColumn("position", F.lit(0))
    place = emission(9, 0, F.pmod(F.xxhash64("library_hint"), F.lit(2**40)))
    return finding(
        rows, "SYMBOL_INSPECTION", "LIBRARY", _CORRELATOR, place, F.lit(SUMMARY_SCORE),
        F.lit("several symbols of one library | score=0.95"),
        F.format_string("%s (%d crypto symbols found)", "library_hint", "n"), library_hint=F.col("library_hint"),
    )


def scan_binaries(strings: DataFrame, symbols: DataFrame) -> DataFrame:
    """All findings of binaries from their strings and symbols."""
    by_symbol = checkpointed(scan_symbols(symbols))
    correlated = checkpointed(correlate(scan_binary_strings(strings), by_symbol))
    return correlated.unionByName(library_summary(by_symbol, correlated))
