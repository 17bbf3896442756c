"""HTML extraction on page shapes; WARC round trips."""

import base64
import hashlib
import time

import pytest

from keystrata.llm import extraction as X
from keystrata.llm import warc as W

LONG = "This paragraph has quite a few words, so that its block stands out among the short lines around it."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>short</p>", "short"),
    (f"<nav>a</nav><article><h1>T</h1><p>{LONG}<br>x &amp; y&nbsp;&lt;z&gt;</article><footer>f</footer>", f"T\n{LONG}\nx & y <z>"),
    (f"<div id='side-bar' class='sidebar'>s</div><div><p>{LONG}</p></div><div class='ad'>buy</div>", LONG),
    (f"<body class='has-sidebar'><main><form>f</form><p>{LONG}</p></main><section id=comments><article class=comment>{LONG}</article></section>", LONG),
    ("<article><p>one<script>if (a<b) x('</p>')</script><style>p{}</style> two<!-- no -->!</p></article>", "one two!"),
    ("<div class='ad'>open<article>story<p>line</article>", "story\nline"), ("<article>a<div class=cookie-notice>c</div>b</article>", "a\nb"),
    ("<article><b>bold<br><p>next", "bold\nnext"), ("<header>top</header><article><header><h1>Title</h1></header>text</article>", "Title\ntext"), ("a < b <", "a < b <"),
])
def test_main_text(page, want):
    assert X.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    # teasers beside a story
    (f"<div class=content><p>{LONG}</p><p>{LONG}</p></div><article><h3><a href=x>Next</a></h3></article>", f"{LONG}\n{LONG}"),
    (f"<div class=content><p>{LONG}</p></div><article><h3><a href=x>Next</a></h3><p>teaser</p></article><p>short</p>", f"{LONG}\nNext\nteaser"),
    # names and forms around everything
    (f"<div class='page has-sidebar'><div class=sidebar>s</div><p>{LONG}</p></div>", LONG),
    (f"<section id=header-wrap><div class=tags>t</div><div class='print-area'><p>{LONG}</p></div></section>", LONG),
    (f"<form id=aspnet><input name=x><div class=login>l</div><p>{LONG}</p><p>{LONG}</p></form>", f"{LONG}\n{LONG}"),
    # comments and hidden regions stay out even if they are long
    (f"<p>{LONG}</p><div class=comments><p>{LONG}</p><p>{LONG}</p></div><div hidden><p>{LONG}</p><p>{LONG}</p></div>", LONG),
    (f"<div class=comments-open><p>{LONG}</p><div id=comments><p>{LONG}</p><p>{LONG}</p></div></div>", LONG),
])
def test_text_outside_articles_and_in_named_wrappers(page, want):
    assert X.main_text(page) == want


def test_surge_and_dive():
    links = "".join(f"<li><a href=x>link {k}</a></li>" for k in range(9))
    assert X.main_text(f"<ul>{links}</ul><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><ul>{links}</ul>") == f"Head\n{LONG}\n{LONG}"


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", 5), (2, None, None, 5), (1, "u", "<p>x</p>", 5)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, X.extract(df).collect()), key=str) == [(1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0)]
    assert X.extract(df.limit(0)).count() == 0


def digest(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


@pytest.mark.parametrize("chunk", [1 << 20, 64, 7])
def test_round_trip(spark, chunk):
    rows = [(1, "http://a/ b", "same"), (5, "u", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 5000), (10, "u", "WARC/1.1\r\n\r\n\r\n\r\n"), (11, "u", "x"), (11, "u", "x"), (12, "u", "y"), (12, "u", "z"), (None, "u", "w"), (None, "u", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, chunk int").repartition(3)
    got = W.round_trip(df, chunk=chunk).collect()
    first = {}
    for page, _, html in rows:
        first[html or ""] = max(first.get(html or "", -1), -1 if page is None else page)
    want = []
    for page, _, html in rows:
        top = first[html or ""]
        response = page == top or top == -1
        want.append((page, len((html or "").encode()), digest(html), "response" if response else "revisit", None if response else top, True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_payloads_are_not_shared(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in W.round_trip(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_damage_is_seen(spark):
    df = spark.createDataFrame([(1, "u", "abc" * 100)], "page_id long, url string, html string")
    chunks = W.to_chunks(df, chunk=64)
    with pytest.raises(Exception, match="out of place|cut short"):
        W.read_records(chunks.where("chunk <> 2")).collect()
    assert W.round_trip(df.limit(0)).count() == 0


def seconds(call, argument):
    start = time.process_time()
    call(argument)
    return time.process_time() - start


@pytest.mark.parametrize("unit", ["<svg>", "<template><div>", "</section></div>", "<div>", "<div></p></div>", "<script x", "<a href='", "<!--", "<div class=ad>x", "</"])
def test_hostile_pages_take_linear_time(unit):
    small, large = (min(seconds(X.main_text, unit * n) for _ in range(2)) for n in (50_000, 100_000))
    assert large < 2.5 * small + 0.2
