"""Column functions over text: matches, lines, comments, snippets, paths, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.binding import bind

def pattern(regex: str, ignore_case: bool = True) -> str:
    """A Java regex with word and space classes over all of Unicode and only line feeds as
    line ends."""
    return ("(?iUd)" if ignore_case else "(?Ud)") + regex.replace("(?P<", "(?<")


def lookup(key: Column, mapping: dict[str, object]) -> Column:
    """Value of a small constant map, null when the key is absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def strip(c: Column) -> Column:
    """The text without white space at either end."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def nonempty(c: Column) -> Column:
    """Stripped text, null when nothing is left."""
    trimmed = strip(c)
    return F.when(trimmed != "", trimmed)


def all_matches(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_comment(line: Column, language: str) -> Column:
    opener = {"python": r"^\s*#"}.get(language, r"^\s*(//|\*|/\*)")
    return line.rlike(opener)


SNIPPET = 200


def line_heads(lines: Column, limit: int = SNIPPET) -> Column:
    """As much of each line as a snippet of ``limit`` characters can show."""
    return F.transform(lines, lambda s: F.substring(s, 1, limit + 1))


def snippet(lines: Column, line_no: Column, context: int = 2, limit: int = SNIPPET) -> Column:
    """The line and its neighbours for display, cut with an ellipsis beyond ``limit``
    characters. ``lines`` may hold only the heads of the lines."""
    first = F.greatest(F.lit(1), line_no - context)
    joined = F.array_join(F.slice(lines, first, line_no + context - first + 1), "\n")
    return F.when(F.length(joined) <= limit, joined).otherwise(
        F.concat(F.substring(joined, 1, limit), F.lit("..."))
    )


_BLOCK = 256


def prefix_sums(df: DataFrame, **steps: str) -> DataFrame:
    """Adds for each ``name=column`` the array of sums of all earlier elements of an array
    column. Sums run in blocks, so long arrays cost little more than linear time."""
    blocks = lambda c: F.sequence(F.lit(0), F.floor(F.size(c) / _BLOCK).cast("int"))
    part = lambda c, b: F.slice(c, b * _BLOCK + 1, F.lit(_BLOCK))
    none = F.array().cast("array<bigint>")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    df = bind(df, **{f"_sum_{n}": F.when(F.size(c) >= _BLOCK, F.transform(blocks(c), lambda b: total(part(c, b)))).otherwise(none) for n, c in steps.items()})  # noqa: B023
    df = bind(df, **{f"_sum_{n}": F.aggregate(
        f"_sum_{n}", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))) for n in steps})

    def within(name: str, column: str) -> Column:
        zero = lambda b: F.struct(F.get(F.col(f"_sum_{name}"), b).alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        # An array of one block needs no sums of blocks.
        return (
            F.when(F.size(column) == 0, none)
            .when(F.size(column) < _BLOCK, F.aggregate(column, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)["out"])
            .otherwise(F.flatten(F.transform(blocks(column), lambda b: F.aggregate(part(column, b), zero(b), step)["out"])))
        )

    return bind(df, **{n: within(n, c) for n, c in steps.items()}).drop(*(f"_sum_{n}" for n in steps))


def line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def text_hits(
    df: DataFrame, regexes: dict[str, str], only: dict[str, Column] | None = None, flags: dict[str, str] | None = None, text: str = "text",
    slots: list[list[str]] | None = None,
) -> DataFrame:
    """One row per match of each regex in the text column, from one pass over the table:
    which (the regex's name), line, place (offset of the match), ordinal (its number in the
    text), symbol, after (what follows up to the next match) and snippet replace the text;
    other columns stay. ``only`` limits a regex to rows; ``flags`` adds a boolean by name
    that says whether the line a match starts on matches a regex. ``slots``: groups of regexes
    of which ``only`` admits at most one to a row.

    A text is split at the matches; running sums over the lengths and line ends of gaps and
    matches give places and lines, so the work is close to linear in the text and no row
    carries more of it than its own match and the gap behind it.
    """
    only, flags, names = only or {}, flags or {}, list(regexes)
    rest = [c for c in df.columns if c != text]
    source = F.col(text)
    none = F.array().cast("array<string>")
    # Regexes that never look at the same row share a place, so a row has few arrays.
    slots = slots or [[n] for n in names]
    df = bind(df, **{f"_on{k}": _chosen(slot, {n: only.get(n, F.lit(True)) & source.rlike(regexes[n]) for n in slot}) for k, slot in enumerate(slots)})
    df = df.where(F.coalesce(*(F.col(f"_on{k}") for k in range(len(slots)))).isNotNull())
    arrays = {"_lines": text_lines(source)}
    for k, slot in enumerate(slots):
        on, found, gaps = F.col(f"_on{k}"), none, none
        for n in slot:
            found = F.when(on == n, all_matches(source, regexes[n])).otherwise(found)
            gaps = F.when(on == n, F.split(source, regexes[n], -1)).otherwise(gaps)
        arrays |= {f"_found{k}": found, f"_gaps{k}": gaps}
    df = bind(df, **arrays).drop(text)
    steps: dict[str, Column] = {"_heads": line_heads(F.col("_lines"))}
    steps |= {f"_flag_{f}": F.transform("_lines", lambda s: s.rlike(rx)) for f, rx in flags.items()}  # noqa: B023
    for k in range(len(slots)):
        gap = lambda i, k=k: F.get(F.col(f"_gaps{k}"), i)
        steps[f"_chars{k}"] = F.transform(f"_found{k}", lambda h, i: F.length(gap(i)) + F.length(h))  # noqa: B023
        steps[f"_ends{k}"] = F.transform(f"_found{k}", lambda h, i: line_ends(gap(i)) + line_ends(h))  # noqa: B023
    df = bind(df, **steps).drop("_lines")
    df = prefix_sums(df, **{f"_at{k}": f"_chars{k}" for k in range(len(slots))}, **{f"_line{k}": f"_ends{k}" for k in range(len(slots))})

    def hit(k: int):
        def of(h: Column, i: Column) -> Column:
            gap = F.get(F.col(f"_gaps{k}"), i)
            line = (F.get(F.col(f"_line{k}"), i) + line_ends(gap)).cast("int")
            return F.struct(
                F.col(f"_on{k}").alias("which"), (line + 1).alias("line"), (F.get(F.col(f"_at{k}"), i) + F.length(gap)).alias("place"),
                i.alias("ordinal"), h.alias("symbol"), F.get(F.col(f"_gaps{k}"), i + 1).alias("after"), snippet(F.col("_heads"), line + 1).alias("snippet"),
                *(F.get(F.col(f"_flag_{f}"), line).alias(f) for f in flags))

        return F.transform(f"_found{k}", of)

    return df.select(*rest, F.inline(F.concat(*(hit(k) for k in range(len(slots))))))


def _chosen(names: list[str], some: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(some[n], n).otherwise(out)
    return out


def norm_path(path: Column) -> Column:
    """Slashes forward, trimmed, one leading ./ removed, lower case."""
    return F.lower(F.regexp_replace(strip(F.replace(path, F.lit("\\"), F.lit("/"))), r"^\./", ""))


def glob_to_regex(glob: str) -> str:
    """A file-name glob (* ? [...]) as an anchored regex."""
    import fnmatch
    return "^" + fnmatch.translate(glob).replace("(?s:", "(?s:").replace("\\Z", "$").replace("\\z", "$")
