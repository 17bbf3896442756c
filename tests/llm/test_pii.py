"""Personal data against plain Python over the whole texts."""

import hashlib
import re
import time

import pytest

from keystrata.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "   ", "nothing here", "mail a.b@c.d and x@y-z.co.uk.", "é à a@b.c%x@y.z _q@r.s", "a@b.c-d@e.f a@@b.c @x.y a@b",
    "a@b.c" + ".d" * 3000, "x" * 60000, "1" * 30000, "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4 12.34.56",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111", "4111 1111 1111  1111 1-2-3 5500005555555559 1", "+1 (555) 123-4567 +12 +123456789 +1(2)3", "call +49 30 123456.. or +1 2 3 4 5 6 7 8 9)",
    "ü" * 50 + " +44 20 7946 0958 ü 10.0.0.1 ü", " ".join(f"u{i}@h{i}.org" for i in range(700)), "+" * 500 + "+1 234 567 890 1", "card 4111 1111 1111 1111\n\n10.1.1.1\t+4915112345678",
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + TEXTS[4:6])], "doc_id long, text string, kind string")
    return {r["doc_id"]: r for r in pii.report(df).collect()}


def test_base_spans(rows):
    for i, text in enumerate(TEXTS + TEXTS[4:6]):
        want = spans(text)
        got = [x for x in rows[i]["spans"].split(",") if x.split(":")[0] in BASE]
        assert got == want, (i, text)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert rows[i]["n_email"] == sum(x.startswith("email") for x in want)


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 NOW", "GB82 WEST 1234 5698 7654 33", "DE89370400440532013000", "ssn 123-45-6789", "part 123-45-6789", "123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_iban"], r["n_ssn"]) for r in pii.report(df).collect()}
    assert got == {0: (1, 0), 1: (0, 0), 2: (1, 0), 3: (0, 1), 4: (0, 0), 5: (0, 0)}


def test_context_adjusts_score(spark):
    df = spark.createDataFrame([(0, "server 10.0.0.1"), (1, "10.0.0.1"), (2, "version 10.0.0.1")], "doc_id long, text string")
    s = {r["doc_id"]: r["max_score"] for r in pii.report(df).collect()}
    assert s[0] > s[1] > s[2]


def test_redact(spark):
    docs = [(0, "mail a@b.c now", "en", 14), (1, "plain", "en", 5), (2, None, None, None), (3, "+4111111111111111.5 x@y.z", "en", 25), (4, "é 10.0.0.1 é +49 30 1234567", "de", 27)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long")
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert df.columns == list(out[0].asDict())
    assert out[0]["text"] == "mail [EMAIL] now" and out[0]["n_chars"] == 16
    assert out[1]["text"] == "plain" and out[2]["text"] is None
    assert "4111" not in out[3]["text"] and out[3]["text"].endswith("[EMAIL]")
    assert out[4]["text"] == "é [IP] é [PHONE]"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert pii.report(df).count() == 0 and pii.redact(df).count() == 0


def plain_redact(text, spans):
    out, last = [], 0
    merged = []
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join([*out, text[last:]])


def test_many_spans(spark):
    unit = "é a.b@c.de, 10.0.0.1 +49 30 1234 5678 4111 1111 1111 1111x@y.org; "
    texts = [unit * n for n in (1, 10, 22, 300)] + ["", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.report(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert [got[k] for k in range(len(texts))] == [plain_redact(t, found[k]) for k, t in enumerate(texts)]


def test_redaction_time_grows_with_the_text(spark):
    took = []
    for n in (4_000, 8_000):
        docs = spark.createDataFrame([(1, "mail a.b@c.de and 10.0.0.1 " * n)], "doc_id long, text string")
        start = time.time()
        assert docs and pii.redact(docs).selectExpr("length(text) as n").first()["n"] < 27 * n
        took.append(time.time() - start)
    assert took[1] < 3 * took[0] + 1
