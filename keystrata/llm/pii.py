"""Personal data in whole texts, with column functions only.

Regular expressions propose spans, checksums and digit counts confirm them, and words near a
span adjust its score. Kinds: email, ip, card (Luhn), phone, iban (mod 97) and ssn (only
with a context word). Matches are leftmost and do not overlap within a kind; spans of
different kinds may. Offsets are code points, end exclusive.

Positions come without a second scan: a text is split at a pattern, and running sums over
the lengths of gaps and hits give the starts. The sums run in blocks of 64 hits, so the work
stays near linear in their number. Patterns are anchored at the start of a run of their
characters and do not backtrack into it, so long runs cost linear time.

Null and empty texts have no spans (and the digest of the empty string). Repeated rows are
scanned one by one. Columns other than the text pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.binding import bind

# Countries by the length of their IBANs.
_IBAN = {
    15: ["NO"],
    16: ["BE"],
    18: ["DK", "FI", "FO", "GL", "NL"],
    19: ["MK", "SI"],
    20: ["AT", "BA", "EE", "KZ", "LT", "LU", "XK"],
    21: ["CH", "HR", "LI", "LV"],
    22: ["BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"],
    23: ["AE", "GI", "IL", "IQ", "TL"],
    24: ["AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"],
    25: ["PT", "ST"],
    26: ["IS", "TR"],
    27: ["FR", "GR", "IT", "MC", "MR", "SM"],
    28: ["AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "PL", "SV"],
    29: ["BR", "EG", "PS", "QA", "UA"],
    30: ["JO", "KW", "MU"],
    31: ["MT", "SC"],
    32: ["LC"],
}


def _iban_pattern() -> str:
    forms = (f"(?:{'|'.join(c)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(_IBAN.items()))
    return f"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?+"

#: kind: (cheap test, pattern). The tests hold for every text with a match.
KINDS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    # Runs of under 13 digits fail anyway.
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{3}", _iban_pattern()),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
BASE = ("email", "ip", "card", "phone")
#: kind: (score without context, change by context, words that raise it, words that lower it)
CONTEXT = {
    "email": (0.8, 0.15, "mail|contact|write|reach|kontakt|correo", "example"),
    "ip": (0.5, 0.3, "ip|address|server|host|login|client", "version|release|section|chapter"),
    "card": (0.7, 0.25, "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta", "order|invoice|tracking"),
    "phone": (0.6, 0.3, "phone|call|tel|telefon|fax|mobile|cell|whatsapp", "order|invoice"),
    "iban": (0.9, 0.1, "iban|bank|account|konto|transfer", "example"),
    "ssn": (0.3, 0.5, "ssn|social|security|insurance", "order|part|isbn"),
}
#: Spans of the added kinds below this score are dropped; the base kinds always stay.
LEAST = 0.5
#: Code points of text on either side that count as context, up to the next span of the kind.
NEAR = 40
_BLOCK = 64


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _mod97(text: Column) -> Column:
    """Whether an IBAN passes the mod-97 check."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda total, c: F.when(c.between("0", "9"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x["hit"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(x["hit"])).between(13, 19) & _luhn(_digits(x["hit"]))
    if kind == "phone":
        return F.length(_digits(x["hit"])).between(9, 15)
    if kind == "iban":
        return _mod97(x["hit"])
    return F.lit(True)


def _score(kind: str, x: Column) -> Column:
    base, change, more, less = CONTEXT[kind]
    near = F.lower(F.concat(x["before"], F.lit(" "), x["after"]))
    up, down = near.rlike(rf"(?<![a-z])(?:{more})"), near.rlike(rf"(?<![a-z])(?:{less})")
    return F.round(F.lit(base) + F.when(up, change).otherwise(0.0) - F.when(down, change).otherwise(0.0), 3)


def with_spans(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """docs with the column ``to``: array of (kind, start, end, score) by kind and start."""
    kept = docs.columns
    own = {k: (f"__{k}_gaps", f"__{k}_hits", f"__{k}_base", f"__{k}") for k in KINDS}
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    found = {}
    for kind, (test, pattern) in KINDS.items():
        maybe = F.contains(t, F.lit(test)) if len(test) == 1 else t.rlike(test)
        found[own[kind][0]] = F.when(maybe, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>"))
        found[own[kind][1]] = F.when(maybe, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = bind(docs, **found)

    steps = {}
    for kind in KINDS:
        gaps, hits = F.col(own[kind][0]), F.col(own[kind][1])
        steps[own[kind][1]] = F.transform(hits, lambda h, i: F.struct(  # noqa: B023
            h.alias("hit"), F.length(gaps[i]).alias("gap"), F.length(h).alias("length"),  # noqa: B023
            F.right(gaps[i], F.lit(NEAR)).alias("before"), F.left(gaps[i + 1], F.lit(NEAR)).alias("after")))  # noqa: B023
    df = bind(df, **steps).drop(*(own[k][0] for k in KINDS))

    def blocks(hits: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.floor((F.size(hits) - 1) / _BLOCK).cast("int"), F.lit(0)))

    def part(hits: Column, b: Column) -> Column:
        return F.slice(hits, b * _BLOCK + 1, F.lit(_BLOCK))

    bases = {}
    for kind in KINDS:
        hits = F.col(own[kind][1])
        sums = F.transform(blocks(hits), lambda b: F.aggregate(part(hits, b), F.lit(0), lambda a, x: a + x["gap"] + x["length"]))  # noqa: B023
        bases[own[kind][2]] = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    df = bind(df, **bases)

    spans = {}
    for kind in KINDS:
        hits, base = F.col(own[kind][1]), F.col(own[kind][2])
        zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda a, x: F.struct((a["at"] + x["gap"] + x["length"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts"))
        starts = F.flatten(F.transform(blocks(hits), lambda b: F.aggregate(part(hits, b), zero(base[b]), step)["starts"]))  # noqa: B023
        placed = F.zip_with(hits, starts, lambda x, s: F.struct(x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"), s.alias("start"), (s + x["length"]).alias("end")))
        good = F.filter(placed, lambda x: _confirmed(kind, x))  # noqa: B023
        scored = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), _score(kind, x).alias("score")))  # noqa: B023
        spans[own[kind][3]] = F.when(F.size(hits) > 0, scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST)).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))
    df = bind(df, **spans)
    return df.select(*(F.col(f"`{c}`") for c in kept if c != to), F.concat(*(own[k][3] for k in KINDS)).alias(to))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn, max_score)
    for every row of docs."""
    df = with_spans(docs.select("doc_id", "text"), to="__pii").drop("text")
    count = lambda k: F.size(F.filter("__pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("__pii", lambda x: x["kind"].isin(*BASE))
    return df.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("__pii")).alias("spans"),
        count("iban"), count("ssn"), F.array_max(F.transform("__pii", lambda x: x["score"])).alias("max_score"))


def _merged(df: DataFrame, spans: str) -> DataFrame:
    """Replaces a column of spans by (prev, start, end, kind) in order, those that overlap as
    one; prev is where the one before ends. A span opens a new one where no earlier span
    reaches; the reach is a running maximum, taken in blocks."""
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    df = bind(df, **{spans: in_order}, __ends=F.transform(in_order, lambda x: x["end"]))
    n = F.size("__ends")
    df = bind(df, __most=F.transform(F.sequence(F.lit(0), F.floor(n / _BLOCK).cast("int")), lambda b: F.coalesce(F.array_max(F.slice("__ends", b * _BLOCK + 1, F.lit(_BLOCK))), F.lit(0))))
    df = bind(df, __most=F.transform("__most", lambda x, b: F.coalesce(F.array_max(F.slice("__most", F.lit(1), b)), F.lit(0))))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    reach = lambda i: F.greatest(F.get(F.col("__most"), block(i)), F.coalesce(F.array_max(F.slice("__ends", block(i) * _BLOCK + 1, i % _BLOCK)), F.lit(0)))
    heads = F.filter(F.transform(spans, lambda x, i: F.struct(reach(i).alias("prev"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["prev"])
    df = bind(df, **{spans: heads}, __last=F.array_max("__ends"))
    whole = F.transform(spans, lambda x, i: F.struct(x["prev"].alias("prev"), x["start"].alias("start"), F.coalesce(F.get(F.col(spans), i + 1)["prev"], F.col("__last")).alias("end"), x["kind"].alias("kind")))
    return bind(df, **{spans: whole}).drop("__ends", "__most", "__last")


def _cut(parts: Column, size: int) -> Column:
    """(text, base, spans) of ever fewer spans each: a part of a text that begins at base."""
    def split(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(x["spans"]) - 1) / size).cast("int"))
        own = lambda b: F.slice(x["spans"], b * size + 1, F.lit(size))
        low = lambda b: F.element_at(own(b), 1)["prev"]
        return F.transform(blocks, lambda b: F.struct(
            F.substring(x["text"], (low(b) - x["base"]).cast("int") + 1, (F.element_at(own(b), -1)["end"] - low(b)).cast("int")).alias("text"), low(b).alias("base"), own(b).alias("spans")))
    return F.flatten(F.transform(parts, split))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets (spans that overlap become one,
    named after the first) and n_chars following the text; texts without spans as they are.
    Texts are cut in two steps to parts of a block of spans each, so the work grows little
    faster than the text."""
    df = _merged(with_spans(docs, to="__pii"), "__pii")
    some, text = F.size("__pii") > 0, F.col("text")
    none = F.array().cast("array<struct<text:string,base:bigint,spans:array<struct<prev:bigint,start:bigint,end:bigint,kind:string>>>>")
    df = bind(df, __parts=F.when(some, F.array(F.struct(text, F.lit(0).cast("long").alias("base"), F.col("__pii").alias("spans")))).otherwise(none))
    for size in (_BLOCK * _BLOCK, _BLOCK):
        df = bind(df, __parts=_cut(F.col("__parts"), size))
    gap = lambda y, x: F.concat(F.substring(y["text"], (x["prev"] - y["base"]).cast("int") + 1, (x["start"] - x["prev"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    df = bind(df, __parts=F.transform("__parts", lambda y: F.array_join(F.transform(y["spans"], lambda x: gap(y, x)), "")))
    new = F.when(some, F.concat(F.array_join("__parts", ""), F.substring(text, F.element_at("__pii", -1)["end"].cast("int") + 1, F.length(text)))).otherwise(text)
    df = bind(df, text=new)
    out = {"n_chars": F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return df.withColumns(out).select(docs.columns)
