"""Packing: token ids against the tokenizer itself, sequences rebuilt whole, and their number."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from keystrata.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.vocabulary())
    t.encode_special_tokens = True
    return t


def best_fit(lengths, size):
    """Sequences that sequential best fit in descending order needs."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


def unrolled(lengths, size):
    """Sequences as lists of (offset, length) by the steps."""
    steps, used = packing.supersteps(Counter(lengths), size)
    by_length, out = defaultdict(list), defaultdict(list)
    for length, rank, each, first, offset in sorted(steps):
        by_length[length].append((rank, each, first, offset))
    for length, n in Counter(lengths).items():
        for r in range(n):
            rank, each, first, offset = [s for s in by_length[length] if s[0] <= r][-1]
            out[first + (r - rank) // each].append((offset + (r - rank) % each * length, length))
    assert set(out) == set(range(used))
    return out


RNG = np.random.default_rng(3)


@pytest.mark.parametrize("size, lengths", [
    (100, []), (100, [1] * 1000), (100, [100] * 7 + [1]), (100, [51] * 30 + [49] * 30 + [50] * 5), (100, [33] * 301 + [1] * 17),
    (100, RNG.integers(1, 101, 700).tolist()), (100, RNG.integers(1, 20, 900).tolist()), (100, RNG.integers(20, 45, 700).tolist()),
    (100, [60] * 400 + RNG.integers(1, 41, 300).tolist()), (64, RNG.geometric(0.08, 900).clip(1, 64).tolist()),
])
def test_as_few_as_best_fit(size, lengths):
    found = unrolled(lengths, size)
    for held in found.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= size
    assert sorted(n for held in found.values() for _, n in held) == sorted(lengths)
    assert len(found) <= best_fit(lengths, size)


@pytest.mark.parametrize("text", [
    "", " ", "  two  spaces ", "don't it's we'll", "line\nbreak \n two\n\n\n", "Été à l'école — où? ñandú", "日本語 の テキスト 12 345", "<|endoftext|> a <|endoftext|>",
    "tab\tand\x0bvt\x85nel em space", "é combining \U0001f600 \U0001f468‍\U0001f469", "a 'quoted' \"text\" (x) [y]", "x" * 5000, "word, " * 3000,
])
def test_ids_of_the_tokenizer(tokenizer, text, monkeypatch):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    for part in (packing.PART, 7):
        monkeypatch.setattr(packing, "PART", part)
        encoder = packing.Encoder(packing.vocabulary())
        assert encoder.ranked is not None and np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_other_vocabularies_go_through_their_file():
    encoder = packing.Encoder(packing.vocabulary("word_bpe_49k.json"))
    want = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json")).encode("Some words, and more.", add_special_tokens=False).ids
    assert encoder.ranked is None and np.frombuffer(encoder.encode("Some words, and more."), "<u4").tolist() == want


def test_both_libraries_on_random_strings(tokenizer):
    rng, encoder = np.random.default_rng(8), packing.Encoder(packing.vocabulary())
    signs = [*"aeiou thTHE 's're 12 \n\t.,!?-", *(chr(int(c)) for c in rng.integers(0xA0, 0x3100, 200)), "\U0001f600", "\u200d", "\u3000", "<|endoftext|>"]
    texts = ["".join(signs[int(k)] for k in rng.integers(0, len(signs), 40)) for _ in range(3000)]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == e.ids, text


@pytest.mark.parametrize("text", [" " * 3_000_000 + "x", "\n" * 3_000_000, "x" * 1_000_000])
def test_long_runs(text):
    encode = packing.Encoder(packing.vocabulary()).encode
    half = len(encode(text[: len(text) // 2]))
    assert 0 < half < len(encode(text))


@pytest.mark.parametrize("n, size, want", [(1, 4, [(0, 1)]), (4, 4, [(0, 4)]), (5, 4, [(0, 1), (1, 4)]), (8, 4, [(0, 4), (4, 4)]), (11, 4, [(0, 3), (3, 4), (7, 4)])])
def test_cuts(n, size, want):
    assert packing.cuts(n, size) == want


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 5, "y") for i, t in texts], "doc_id long, text string, sequence_id string, length int, ids string")


def test_round_trip(spark, tokenizer):
    texts = [(None, "no id here"), (1, None), (2, ""), (2, ""), (3, "very long words " * 20_000)] + [(10 + i, "a tale of some words " * (i % 90)) for i in range(400)] + [(7, "one copy")] * 300
    docs, want = rows(spark, texts), Counter()
    for i, t in texts:
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    placed = packing.pack(docs).collect()
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r["sequence_id"]].append(r)
    built = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.sequences(docs).collect()}
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(map(len, built.values())) == total and max(map(len, built.values())) <= 2048
    assert len(by_sequence) == len(built) <= -(-total // 2048) + 1
    found = defaultdict(list)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            found[r["doc_id"], r["piece"], r["start"]].append((r["length"], r["ids_crc32"]))
    expected = defaultdict(list)
    for (i, ids), n in want.items():
        for k, (s, m) in enumerate(packing.cuts(len(ids), 2048)):
            expected[i, k, s] += [(m, zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes()))] * n
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_empty_table(spark):
    docs = rows(spark, [])
    assert packing.pack(docs).collect() == [] and packing.sequences(docs).collect() == []


def test_ranks_over_many_ranges(spark):
    lengths = spark.range(5000, numPartitions=37).selectExpr("id", "if(id % 3 = 0, 700L, 1 + id % 11) as length")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.place(lengths).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len({r["id"] for r in got}) == 5000
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) == max(o + n for o, n in v) <= 2048 for v in ends.values())
