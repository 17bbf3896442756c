"""Findings from source files: imports, API calls, factories, cipher constructors, patterns.

Input is a table (path, language, text); typescript counts as javascript and c as cpp.
Everything but Python calls and line patterns is found in one pass over the text
(``source_hits``), Python calls in a second and line patterns in a third; nothing is
shuffled except the import flag of calls, which is one aggregate per file joined back by
path. Matches carry offsets instead of lines, and no expression recurses over the text, so
long lines, long arguments and deep nesting cost no more than their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.dims import apis, patterns, small
from keystrata.functions import ids
from keystrata.functions.binding import bind
from keystrata.functions.scoring import detection_confidence
from keystrata.functions.text import line_ends, line_heads, lookup, pattern, prefix_sums, snippet, strip, text_hits, text_lines
from keystrata.operators.lookups import match_api, match_library
from keystrata.schemas import FINDINGS, conform
from keystrata.session import checkpointed

ANALYZERS = {"python": "python", "javascript": "javascript", "typescript": "javascript", "java": "java", "c": "cpp", "cpp": "cpp"}
_SCANNER = {
    "python": "RepositoryScanner/PythonAnalyzer", "javascript": "RepositoryScanner/JavaScriptAnalyzer",
    "java": "RepositoryScanner/JavaAnalyzer", "cpp": "RepositoryScanner/CppAnalyzer",
}
VERSION = "1.0.0"

# Phases in emission order.
_IMPORTS, _CALLS, _CIPHERS, _PATTERNS = 1, 2, 3, 4


def analyzable(files: DataFrame) -> DataFrame:
    """path, analyzer and text (and known, if there) of the files an analyzer exists for; blank
    files are left out."""
    more = [c for c in ("known",) if c in files.columns]
    return files.select("path", lookup(F.col("language"), ANALYZERS).alias("analyzer"), "text", *more).where(
        F.col("analyzer").isNotNull() & F.col("text").rlike(r"\S")
    )


def emission(phase: int, index: Column | int, place: Column) -> Column:
    """Place in a file's emission order: phase, then pattern, then offset in the text. Matches
    of one pattern begin at different offsets and a text has under 2**31 characters, so
    places never coincide."""
    index = index if isinstance(index, Column) else F.lit(index)
    return F.lit(phase) * 2**50 + index.cast("long") * 2**40 + place.cast("long")


def finding(
    df: DataFrame, method: Column | str, category: Column | str, scanner: Column | str, seq: Column,
    score: Column, rationale: Column, symbol: Column, **more: Column,
) -> DataFrame:
    """Rows in the findings schema from a table with path, line and snippet columns."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    line = F.col("line") if "line" in df.columns else F.lit(None).cast("int")
    offset = F.col("byte_offset") if "byte_offset" in df.columns else F.lit(None).cast("long")
    text = F.col("snippet") if "snippet" in df.columns else F.lit(None).cast("string")
    out = df.select(
        seq.alias("emit_seq"), as_col(scanner).alias("scanner_name"), F.lit(VERSION).alias("scanner_version"),
        as_col(method).alias("discovery_method"), symbol.alias("raw_symbol"), as_col(category).alias("artifact_category"),
        F.struct(
            F.col("path").alias("file_path"), line.alias("start_line"), F.lit(None).cast("int").alias("end_line"),
            offset.alias("byte_offset"), text.alias("snippet"),
        ).alias("location"),
        score.alias("confidence_score"), rationale.alias("confidence_rationale"),
        *[v.alias(k) for k, v in more.items()],
    )
    return conform(identified(out), FINDINGS)


def identified(findings: DataFrame) -> DataFrame:
    """Adds (or renews) the ids, which hang on path, scanner, method, symbol and place."""
    name = F.concat_ws("|", "location.file_path", "scanner_name", "discovery_method", "raw_symbol", F.col("emit_seq").cast("string"))
    return findings.withColumn("finding_id", ids.uuid_v5(ids.FINDING_NAMESPACE, name))


def _scanner_of() -> Column:
    return lookup(F.col("analyzer"), _SCANNER)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- fixed values -----------------------------------------------------------
# Expressions that decide what counts as an import, a factory or a cipher constructor.
_TRIPLE = r'''"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|\'{3}(?:[^\'\\]++|\\[\s\S]|\'(?!\'\'))*+\'{3}'''
_PY_IMPORT = r"^[ \t]*import[ \t]+[A-Za-z_][\w.]*(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[A-Za-z_][\w.]*(?:[ \t]+as[ \t]+\w+)?)*+"
_PY_FROM = r"^[ \t]*from[ \t]+\.*[\w.]*[ \t]+import[ \t]+(?:\([^)]*\)|[^\n#;(]+)"
_JS_REQUIRE = r"""(?:const|let|var)\s+(?:\w+|\{[^{};]++\})\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
_JS_IMPORT = r"""import\s+(?:\w+|(?:\*\s+as\s+\w+)|(?:\{[^{};]++\}))\s+from\s+['"]([^'"]+)['"]"""
_JS_BARE = r"""import\s+['"]([^'"]+)['"]"""
# A line after a blank one begins no match: the blank line has begun it already.
_AFTER_BLANK = r"(?<!\n[ \t\r\f\x0B]{0,200}\n)"
_JAVA_IMPORT = rf"(?md)^{_AFTER_BLANK}\s*+import\s+([\w.]+)\s*;"
_CPP_INCLUDE = rf"""(?md)^{_AFTER_BLANK}\s*+#include\s*[<"]([^>"\n]+)[>"]"""
_FACTORY = r"""(\w+)\s*\.\s*getInstance\s*\(\s*"([^"]+)\""""
_JAVA_RULES = [
    ("AES", "AES", "SYMMETRIC_CIPHER"), ("RSA", "RSA", "ASYMMETRIC_PKC"),
    ("SHA-?256", "SHA-256", "HASH_FUNCTION"), ("SHA-?512", "SHA-512", "HASH_FUNCTION"),
    ("SHA-?1", "SHA-1", "HASH_FUNCTION"), ("MD5", "MD5", "HASH_FUNCTION"), ("EC", "ECDSA", "DIGITAL_SIGNATURE"),
    ("DH", "DH", "KEY_EXCHANGE"), ("HMAC", "HMAC", "MAC"), ("PBKDF2", "PBKDF2", "KDF"),
    ("3DES", "3DES", "SYMMETRIC_CIPHER"), ("DES", "DES", "SYMMETRIC_CIPHER"),
]
_CONSTRUCTOR = r"(?iUd)\bEVP_(aes|des|chacha20|rc4)_?(\d*)_?(cbc|gcm|ctr|cfb|ofb|ecb|ccm)?\s*\(\)"
_RSA_KEY = r"^RSA_generate_key(?:_ex)?\s*\("
_SECOND_NUMBER = r"^[^,]+,\s*(\d+)"
# --- end of fixed values ----------------------------------------------------


def _names(language: str) -> str:
    return "|".join(dict.fromkeys(r["short_name"] for r in apis.api_rows() if r["language"] == language))


def _spread() -> list[dict]:
    """Patterns that may run over line ends."""
    return [r for r in patterns.pattern_rows() if r["pattern"] in patterns.MULTILINE]


#: kind: (analyzer, expression). Python imports are looked for around triple-quoted strings.
_KINDS = {
    "python_import": ("python", f"(?md){_TRIPLE}|{_PY_IMPORT}|{_PY_FROM}"),
    "require": ("javascript", _JS_REQUIRE), "import": ("javascript", _JS_IMPORT), "bare": ("javascript", _JS_BARE),
    "java_import": ("java", _JAVA_IMPORT), "include": ("cpp", _CPP_INCLUDE),
    "js_call": ("javascript", rf"(?iUd)\b(?:{_names('javascript')})\s*\("),
    "cpp_call": ("cpp", rf"(?Ud)\b(?:{_names('cpp')})\s*\("),
    "factory": ("java", _FACTORY), "constructor": ("cpp", _CONSTRUCTOR),
}
_IMPORT_KINDS = ("python_import", "require", "import", "bare", "java_import", "include")


def source_hits(src: DataFrame, kinds: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """All matches of the kinds, from one pass over (path, analyzer, text), with (unless only
    imports are looked for) the flags hash_comment and slash_comment of their lines, and known: whether a JavaScript text
    names a crypto module (or what the column of that name says, where there is one)."""
    known = F.col("known") if "known" in src.columns else F.col("text").rlike("crypto|jsonwebtoken").alias("known")
    df = src.select("path", "analyzer", known, "text")
    only = {k: F.col("analyzer") == _KINDS[k][0] for k in kinds}
    of: dict[str, list[str]] = {}
    for k in kinds:
        of.setdefault(_KINDS[k][0], []).append(k)
    slots = [[ks[i] for ks in of.values() if i < len(ks)] for i in range(max(map(len, of.values())))]  # a file has one analyzer
    flags = {"hash_comment": r"^\s*#", "slash_comment": r"^\s*(//|\*|/\*)"}
    return text_hits(df, {k: _KINDS[k][1] for k in kinds}, only, {} if set(kinds) <= set(_IMPORT_KINDS) else flags, slots=slots)


# --- imports ----------------------------------------------------------------


def _modules(hits: DataFrame) -> DataFrame:
    """path, analyzer, kind, line, place, snippet, module and symbol of import statements, each
    made in the row of its match: the matches are read once, whatever they are."""
    symbol, which, place = F.col("symbol"), F.col("which"), F.col("place")
    row = lambda kind, at, module, text: F.struct(kind.cast("int").alias("kind"), at.cast("long").alias("place"), module.alias("module"), text.alias("symbol"))
    names = F.split(F.regexp_replace(symbol, r"^\s*import\s+", ""), r"\s*,\s*")
    # A name takes two characters at least, so no two places coincide.
    plain = F.transform(names, lambda item, part: row(
        F.lit(0), place + part, F.regexp_extract(item, r"^([\w.]+)", 1), F.concat(F.lit("import "), F.regexp_replace(item, r"\s+", " "))))
    listed = F.regexp_replace(F.regexp_replace(F.regexp_extract("symbol", r"(?s)import[ \t]+(.*)$", 1), r"#[^\n]*|[()\\]", " "), r"\s+as\s+\w+", "")
    chosen = F.array_join(F.filter(F.split(listed, r"\s*,\s*"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""), ", ")
    module = F.regexp_extract("symbol", r"from[ \t]+\.*([\w.]*)", 1)
    selective = F.array(row(F.lit(0), place, module, F.concat(F.lit("from "), module, F.lit(" import "), F.trim(F.regexp_replace(chosen, r"\s+", " ")))))
    quoted = F.regexp_extract("symbol", r"""['"]([^'"]+)['"]\s*\)?$""", 1)
    other = F.array(row(
        lookup(which, {"require": 0, "import": 1, "bare": 2, "java_import": 0, "include": 0}), place,
        F.when(which == "java_import", F.regexp_extract("symbol", _JAVA_IMPORT, 1))
        .when(which == "include", F.regexp_extract("symbol", _CPP_INCLUDE, 1))
        .otherwise(F.replace(quoted, F.lit("node:"), F.lit(""))),
        F.when(which.isin("java_import", "include"), F.regexp_replace("symbol", r"^\s+|\s+$", "")).otherwise(symbol)))
    python = which == "python_import"
    found = hits.where(which.isin(*_IMPORT_KINDS) & ~(python & symbol.rlike("^['\"]")))
    found = bind(found, _each=F.when(python & ~symbol.rlike(r"^\s*from\s"), plain).when(python, selective).otherwise(other))
    return found.select("path", "analyzer", "line", "snippet", F.inline("_each"))


def matched_imports(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Import statements of known libraries. ``hits``: what ``source_hits`` found, if at hand."""
    hits = source_hits(analyzable(files), _IMPORT_KINDS) if hits is None else hits
    return match_library(_modules(hits).where(F.col("module") != ""), "module").where(F.col("library").isNotNull())


def scan_imports(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One LIBRARY finding per import of a known cryptographic library."""
    found = bind(matched_imports(files, hits), _score=detection_confidence("known_import", F.col("base_confidence")))
    return finding(
        found, "IMPORT_ANALYSIS", "LIBRARY", _scanner_of(), emission(_IMPORTS, F.col("kind"), F.col("place")),
        F.col("_score"), F.format_string("import of a known library | score=%.2f", "_score"), F.col("symbol"),
        library_hint=F.col("library"),
    )


# --- API calls --------------------------------------------------------------

_STRING = _TRIPLE + r'''|"(?:[^"\\\n]++|\\[\s\S])*+"''' + r"""|'(?:[^'\\\n]++|\\[\s\S])*+'"""


def _call_sites(src: DataFrame, name: str) -> DataFrame:
    """One row per call whose dotted name matches: path, analyzer, line, place, call, args,
    snippet and defines (the line begins a definition).

    The text is cut into tokens: strings, comments, opened calls, brackets and commas. Running
    sums give depths, offsets and lines; sorted by depth and position, an opening bracket is
    followed by its own commas and its closing bracket, whatever stands inside.
    """
    token = rf"{_STRING}|#[^\n]*+|{name}\s*+\(|[(\[{{]|[)\]}}]|,"
    text = F.col("text")
    df = src.where(text.rlike(rf"{name}\s*+\(")).select("path", "analyzer", "text")
    df = bind(df, _tok=F.regexp_extract_all(text, F.lit(token), F.lit(0)), _gap=F.split(text, token, -1), _lines=text_lines(text)).drop("text")
    first, last = lambda h: F.substring(h, 1, 1), lambda h: F.substring(h, -1, 1)
    kind = F.transform("_tok", lambda h: F.when(first(h).isin('"', "'", "#"), "text").when(h == ",", "comma").when(h.isin(")", "]", "}"), "close")
                       .when(F.length(h) == 1, "open").otherwise("call"))
    df = bind(
        df, _kind=kind, _heads=line_heads(F.col("_lines")), _defines=F.transform("_lines", lambda s: s.rlike(r"^\s*(?:async\s+)?(?:def|class)\s")),
        _chars=F.transform("_tok", lambda h, i: F.length(h) + F.length(F.get(F.col("_gap"), i))),
        _ends=F.transform("_tok", lambda h, i: line_ends(h) + line_ends(F.get(F.col("_gap"), i)))).drop("_lines")
    df = bind(df, _step=F.transform("_kind", lambda k: F.when(k.isin("open", "call"), 1).when(k == "close", -1).otherwise(0)))
    df = prefix_sums(df, _depth="_step", _at="_chars", _line="_ends").drop("_step", "_chars", "_ends")
    marks = F.filter(F.transform("_kind", lambda k, i: F.struct(
        (F.get(F.col("_depth"), i) + F.when(k.isin("open", "call"), 1).otherwise(0)).alias("level"), i.alias("i"), k.alias("kind"))), lambda m: m["kind"] != "text")
    df = bind(df, _sorted=F.array_sort(marks)).drop("_depth")
    df = bind(df, _brackets=F.filter(F.transform("_sorted", lambda m, k: F.struct(
        m["level"].alias("level"), m["i"].alias("i"), m["kind"].alias("kind"), k.alias("k"))), lambda m: m["kind"] != "comma"))
    calls = F.filter(F.transform("_brackets", lambda m, k: F.struct(m.alias("m"), F.get(F.col("_brackets"), k + 1).alias("next"))), lambda c: c["m"]["kind"] == "call")

    def between(lo: Column, hi: Column) -> Column:
        """The text from behind token lo up to token hi, without comments."""
        piece = lambda i: F.concat(F.get(F.col("_gap"), i), F.when((i < hi) & (first(F.get(F.col("_tok"), i)) != "#"), F.get(F.col("_tok"), i)).otherwise(""))
        return F.array_join(F.transform(F.sequence(lo + 1, hi), piece), "")

    def site(c: Column) -> Column:
        i, closed = c["m"]["i"], (c["next"]["kind"] == "close") & (c["next"]["level"] == c["m"]["level"])
        commas = F.transform(F.slice(F.col("_sorted"), c["m"]["k"] + 2, c["next"]["k"] - c["m"]["k"] - 1), lambda m: m["i"])
        bounds = F.concat(F.array(i), commas, F.array(c["next"]["i"]))
        args = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: between(F.get(bounds, k), F.get(bounds, k + 1)))
        gap = F.get(F.col("_gap"), i)
        line = (F.get(F.col("_line"), i) + line_ends(gap)).cast("int")
        return F.struct(
            (line + 1).alias("line"), (F.get(F.col("_at"), i) + F.length(gap)).alias("place"),
            F.regexp_extract(F.get(F.col("_tok"), i), r"^([\w.]+)", 1).alias("dotted"),
            F.when(F.coalesce(closed, F.lit(False)), args).otherwise(F.array().cast("array<string>")).alias("args"),
            F.get(F.col("_defines"), line).alias("defines"), snippet(F.col("_heads"), line + 1).alias("snippet"))

    df = bind(df, _calls=calls).drop("_brackets", "_kind")
    return df.select("path", "analyzer", F.inline(F.transform("_calls", site)))


def _argument(rule: Column, args: Column, named: Column) -> Column:
    """The literal, name or last attribute an argument rule points at, null for anything
    that is not one. Positional rules count arguments without a keyword first."""
    position = rule.try_cast("int")
    positional = F.get(args, position)
    positional = F.when(~positional.rlike(r"^\w+\s*=[^=]"), positional)
    keyword = F.try_element_at(named, rule)
    raw = strip(F.when(position.isNotNull(), positional).otherwise(keyword))
    literal = F.regexp_extract(raw, r"""^[rbuRBU]{0,2}(['"])(.*)\1$""", 2)
    return (
        F.when(literal != "", literal)
        .when(raw.rlike(r"^\d+$"), raw)
        .when(raw.rlike(r"^[A-Za-z_][\w.]*$"), F.substring_index(raw, ".", -1))
    )


def python_calls(files: DataFrame, qualified_only: bool = False) -> DataFrame:
    """Calls whose name or last part is registered, with library, algorithm and arguments.
    Strings, docstrings and comments hold no calls."""
    name = rf"(?i)(?<!\w)(?:[A-Za-z_]\w*+\.)*+(?:{_names('python')})"
    calls = _call_sites(files.where(F.col("analyzer") == "python"), name).where("not defines")
    dotted = F.split("dotted", r"\.")
    full = F.when(F.size(dotted) > 3, F.array_join(F.slice(dotted, -2, 2), ".")).otherwise(F.array_join(dotted, "."))
    calls = bind(calls, call=full, _language=F.lit("python"), _args=F.col("args"))
    calls = match_api(calls, "_language", "call", qualified_only).where(F.col("api_name").isNotNull())
    pairs = F.filter("_args", lambda a: a.rlike(r"^\s*\w+\s*=[^=]"))
    named = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(pairs, lambda a: strip(F.substring_index(a, "=", 1)))),
        lambda k: F.struct(k, F.get(F.transform(
            F.filter(pairs, lambda a: strip(F.substring_index(a, "=", 1)) == k),
            lambda a: F.regexp_extract(a, r"(?s)=\s*(.*)$", 1)), F.lit(0)))))
    calls = bind(calls, _named=named)
    get = lambda rule: _argument(F.col(rule), F.col("_args"), F.col("_named"))
    return bind(
        calls, key_size=get("key_arg").try_cast("int"), mode_value=get("mode_arg"), curve_value=get("curve_arg"),
        algorithm_value=get("algorithm_arg"),
    )


def _imported_libraries(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Distinct lower-cased modules of known libraries per file."""
    return matched_imports(files, hits).select("path", F.lower("module").alias("module")).distinct()


def import_corroboration(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds has_import: some module imported in the call's file contains the call's library
    name. A file imports a bounded number of known modules, which is what gets joined."""
    wanted = calls.select("path", F.lower("api_library").alias("_lib")).distinct()
    seen = (
        wanted.join(imports, "path").where(F.contains(F.col("module"), F.col("_lib")))
        .select("path", "_lib").distinct().withColumn("_seen", F.lit(True))
    )
    joined = calls.withColumn("_lib", F.lower("api_library")).join(seen, ["path", "_lib"], "left")
    return joined.withColumn("has_import", F.coalesce("_seen", F.lit(False))).drop("_lib", "_seen")


def scan_api_calls(
    files: DataFrame, qualified_only: bool = False, hits: DataFrame | None = None, imports: DataFrame | None = None,
) -> DataFrame:
    """Findings from calls of registered functions in Python, JavaScript and C/C++. ``imports``
    (path, module): modules that count as imported, if not those of the hits."""
    src = analyzable(files)
    hits = checkpointed(source_hits(src, (*_IMPORT_KINDS, "js_call", "cpp_call"))) if hits is None else hits
    calls = import_corroboration(checkpointed(python_calls(src, qualified_only)), _imported_libraries(files, hits) if imports is None else imports)
    has_args = F.coalesce(F.col("key_size").cast("string"), "mode_value", "curve_value", "algorithm_value").isNotNull()
    calls = bind(calls, _score=detection_confidence("ast_api_call", F.col("api_confidence"), F.col("has_import"), has_args, True))
    params = F.map_filter(
        F.create_map(
            F.lit("key_size"), F.col("key_size").cast("string"), F.lit("mode"), F.col("mode_value"),
            F.lit("curve"), F.col("curve_value"), F.lit("algorithm_arg"), F.col("algorithm_value"),
        ),
        lambda k, v: v.isNotNull(),
    )
    python = finding(
        calls, "AST", F.col("api_category"), _SCANNER["python"], emission(_CALLS, 0, F.col("place")),
        F.col("_score"), F.format_string("call of %s | score=%.2f", "api_name", "_score"), F.col("call"),
        suspected_algorithm=F.col("api_algorithm"), library_hint=F.col("api_library"), key_size_hint=F.col("key_size"),
        mode_hint=F.col("mode_value"), curve_hint=F.col("curve_value"), raw_parameters=F.when(has_args, params),
    )
    return union_all([python, _javascript_calls(hits), _cpp_calls(hits)])


def _api_dim(df: DataFrame, language: str, lower: bool) -> DataFrame:
    rows = [
        {"_name": r["short_name"].lower() if lower else r["short_name"], "api_name": r["api_name"],
         "api_algorithm": r["algorithm"], "api_category": r["category"], "api_index": r["api_ordinal"] % 100}
        for r in apis.api_rows() if r["language"] == language
    ]
    return small(df.sparkSession, rows)


def _javascript_calls(hits: DataFrame) -> DataFrame:
    hits = hits.where("which = 'js_call' and not slash_comment")
    dim = _api_dim(hits, "javascript", True)
    hits = hits.join(dim, F.lower(F.regexp_extract("symbol", r"^(\w+)", 1)) == dim["_name"])
    score = F.round(F.least(detection_confidence("regex_executable", has_import=F.col("known"), has_api=True) + 0.08, F.lit(0.82)), 4)
    hits = bind(hits, _score=score)
    return finding(
        hits, "API_CALL", F.col("api_category"), _SCANNER["javascript"],
        emission(_CALLS, F.col("api_index"), F.col("place")),
        F.col("_score"), F.format_string("call of %s | score=%.2f", "api_name", "_score"), F.col("symbol"),
        suspected_algorithm=F.col("api_algorithm"),
    )


def _cpp_calls(hits: DataFrame) -> DataFrame:
    """Key sizes are read from the arguments of the RSA key generation call itself."""
    hits = hits.where("which = 'cpp_call' and not slash_comment")
    dim = _api_dim(hits, "cpp", False)
    hits = hits.join(dim, F.regexp_extract("symbol", r"^(\w+)", 1) == dim["_name"])
    key = F.when(F.col("symbol").rlike(_RSA_KEY), F.regexp_extract("after", _SECOND_NUMBER, 1).try_cast("int"))
    hits = bind(hits, _score=F.round(F.least(detection_confidence("regex_executable", has_api=True) + 0.08, F.lit(0.88)), 4))
    return finding(
        hits, "API_CALL", F.col("api_category"), _SCANNER["cpp"],
        emission(_CALLS, F.col("api_index"), F.col("place")), F.col("_score"),
        F.format_string("call of %s | score=%.2f", "api_name", "_score"), F.col("symbol"),
        suspected_algorithm=F.col("api_algorithm"), key_size_hint=key,
    )


# --- Java factories, C cipher constructors ----------------------------------

def java_algorithm(transformation: Column) -> Column:
    """struct<algorithm, category> of a factory argument; the first rule that hits."""
    t = F.upper(transformation)
    pair = lambda a, c: F.struct(F.lit(a).cast("string").alias("algorithm"), F.lit(c).alias("category"))
    out = pair(None, "UNKNOWN")
    for regex, algorithm, category in reversed(_JAVA_RULES):
        out = F.when(t.rlike(regex), pair(algorithm, category)).otherwise(out)
    return out


def scan_java_factories(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Findings from ``X.getInstance("...")``; the transformation literal is kept."""
    hits = source_hits(analyzable(files), ("factory",)) if hits is None else hits
    hits = hits.where("which = 'factory' and not slash_comment")
    hits = bind(hits, _class=F.regexp_extract("symbol", _FACTORY, 1), transformation=F.regexp_extract("symbol", _FACTORY, 2))
    # The registry lists the method name, which no class name equals, so no API bonus applies.
    score = F.round(F.least(detection_confidence("regex_executable", has_argument=True) + 0.10, F.lit(0.90)), 4)
    hits = bind(hits, _java=java_algorithm(F.col("transformation")), _score=score)
    return finding(
        hits, "API_CALL", F.col("_java.category"), _SCANNER["java"], emission(_CALLS, 0, F.col("place")),
        F.col("_score"), F.format_string("factory %s(\"%s\") | score=%.2f", "_class", "transformation", "_score"),
        F.col("symbol"), suspected_algorithm=F.col("_java.algorithm"),
        raw_parameters=F.create_map(F.lit("transformation"), F.col("transformation")),
    )


def scan_evp_ciphers(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Findings from C cipher constructors; fixed score, mode from the name."""
    hits = (source_hits(analyzable(files), ("constructor",)) if hits is None else hits).where("which = 'constructor'")
    part = F.upper(F.regexp_extract("symbol", _CONSTRUCTOR, 1))
    mode = F.upper(F.regexp_extract("symbol", _CONSTRUCTOR, 3))
    return finding(
        hits, "API_CALL", "SYMMETRIC_CIPHER", _SCANNER["cpp"], emission(_CIPHERS, 0, F.col("place")),
        F.lit(0.92), F.lit("cipher constructor | score=0.92"), F.col("symbol"),
        suspected_algorithm=F.when(part == "CHACHA20", "ChaCha20").otherwise(part),
        mode_hint=F.when(mode != "", mode),
    )


# --- patterns ---------------------------------------------------------------

_PER_STEP = 8  # patterns tried per bound step; keeps the compiled methods small


def pattern_hits(files: DataFrame) -> DataFrame:
    """Every pattern match: path, analyzer, line, place, symbol, hash_comment, slash_comment,
    snippet and the pattern's columns. Input: path, analyzer, text.

    Single-line patterns are tried only on lines where one of the stems they all begin
    with occurs, and each only where the line holds what its matches hold (or characters beyond
    ASCII, of which some count as letters in another case); the six that may run over line ends are looked for in texts that hold an
    opening of theirs.
    """
    rows = patterns.pattern_rows()
    single = [r for r in rows if r["pattern"] not in patterns.MULTILINE]
    stems = pattern(r"\b(?:" + "|".join(patterns.STEMS) + ")")
    rest = [c for c in files.columns if c != "text"]
    df = bind(files.where(F.col("text").rlike(stems)), _lines=text_lines(F.col("text"))).drop("text")
    df = bind(df, _heads=line_heads(F.col("_lines")), _length=F.transform("_lines", lambda s: F.length(s) + 1))
    df = prefix_sums(df, _start="_length").drop("_length")
    candidates = F.filter(F.transform("_lines", lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda h: h["s"].rlike(stems))
    lines = df.select(*rest, F.inline(F.transform(candidates, lambda h: F.struct(
        (h["i"] + 1).cast("int").alias("line"), h["s"].alias("line_text"), F.get(F.col("_start"), h["i"]).alias("start"),
        h["s"].rlike(r"^\s*#").alias("hash_comment"), h["s"].rlike(r"^\s*(//|\*|/\*)").alias("slash_comment"),
        snippet(F.col("_heads"), h["i"] + 1).alias("snippet"),
    ))))
    own = [*rest, "line", "start", "hash_comment", "slash_comment", "snippet"]
    lines = bind(lines, _low=F.lower("line_text"), _wide=F.octet_length("line_text") != F.length("line_text"))
    tried = lambda r: reduce(lambda a, x: a | F.contains("_low", F.lit(x)), patterns.HOLDS[r["pattern"]], F.col("_wide"))
    steps = []
    for n in range(0, len(single), _PER_STEP):
        name = f"_m{n}"
        lines = bind(lines, **{name: F.filter(
            F.array(*[
                F.struct(F.lit(r["pattern_ordinal"]).alias("pattern_ordinal"),
                         F.when(tried(r), F.regexp_extract_all("line_text", F.lit(pattern(r["regex"])), F.lit(0))).alias("symbols"))
                for r in single[n:n + _PER_STEP]
            ]),
            lambda m: F.size(m["symbols"]) > 0,
        )})
        steps.append(name)
    found = lines.select(*own, F.inline(F.concat(*steps)))
    found = found.select(*own, "pattern_ordinal", F.posexplode("symbols").alias("ordinal", "symbol"))
    # A match takes a character at least, so no two places coincide.
    found = found.withColumn("place", F.col("start") + F.col("ordinal")).drop("start", "ordinal")
    opened = files.where(F.col("text").rlike(pattern(patterns.MULTILINE_OPENING)))
    spread = {str(r["pattern_ordinal"]): pattern(r["regex"]) for r in _spread()}
    blocks = text_hits(opened, spread, flags={"hash_comment": r"^\s*#", "slash_comment": r"^\s*(//|\*|/\*)"})
    blocks = blocks.withColumn("pattern_ordinal", F.col("which").cast("int")).drop("which", "ordinal", "after")
    dim = small(files.sparkSession, [{k: v for k, v in r.items() if k != "regex"} for r in rows])
    return union_all([found, blocks]).join(dim, "pattern_ordinal")


def scan_patterns(files: DataFrame) -> DataFrame:
    """Findings from all text patterns. A match on a comment line takes the comment score
    and is dropped below the language's floor."""
    hits = pattern_hits(analyzable(files).drop("known"))
    comment = F.when(F.col("analyzer") == "python", F.col("hash_comment")).otherwise(F.col("slash_comment"))
    hits = bind(hits, _comment=comment)
    hits = bind(hits, _score=F.when(F.col("_comment"), F.col("comment_confidence")).otherwise(F.col("base_confidence")))
    floor = lookup(F.col("analyzer"), patterns.COMMENT_FLOOR)
    hits = hits.where(~F.col("_comment") | (F.col("_score") >= floor))
    place = F.when(F.col("_comment"), "comment").otherwise("code")
    return finding(
        hits, "REGEX", F.col("category"), _scanner_of(),
        emission(_PATTERNS, F.col("pattern_ordinal"), F.col("place")),
        F.col("_score"), F.format_string("pattern %s in %s | score=%.2f", "pattern", place, "_score"), F.col("symbol"),
        suspected_algorithm=F.col("algorithm"),
    )


def scan_repository(files: DataFrame) -> DataFrame:
    """All findings of source files (path, language, text). What one pass finds is written
    once and read by all scans that use it."""
    hits = checkpointed(source_hits(analyzable(files)))
    return union_all([
        scan_imports(files, hits), scan_api_calls(files, hits=hits), scan_java_factories(files, hits), scan_evp_ciphers(files, hits), scan_patterns(files),
    ])
