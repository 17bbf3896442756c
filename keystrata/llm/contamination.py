"""Benchmark decontamination: n-gram windows of test items looked up in training texts.

Words are runs of letters, digits and non-ASCII characters with A-Z lowered. A window is 13
consecutive words of an item, or the whole item where it is shorter; an item without words
has none. The windows form a broadcast hash set whose size is counted first. Every window
of every training text is looked up, and a hit is verified word by word. Beyond
``max_broadcast`` windows the lookup is a join on the hash, with the same verification.

Null and empty texts have no words, no hits and are never contaminated. Repeated rows are
judged one by one, also those without an id. Only the id and text columns are read; others
pass through untouched. Items without an id count as one item; the digest has named ones only.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.batches import map_batches
from keystrata.llm.words import PLAIN, buffers, grams, lower, words
from keystrata.session import checkpointed

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
MAX_BROADCAST = 300_000  #: windows; a few hundred bytes each


def _item_windows(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out = {"item": [], "size": [], "hash": [], "window": []}
            data, at = buffers(texts)
            for part in words(texts, PLAIN):
                for k in range(part.first, part.last):
                    h = part.hashes[part.offsets[k - part.first] : part.offsets[k - part.first + 1]]
                    size = min(n, len(h))
                    if not size:
                        continue
                    own = _WORD.findall(lower(data[at[k] : at[k + 1]].tobytes()))
                    found = grams(h, size).astype(np.int64)
                    out["item"] += [ids[k]] * len(found)
                    out["size"] += [size] * len(found)
                    out["hash"] += found.tolist()
                    out["window"] += [b" ".join(own[i : i + size]).decode() for i in range(len(found))]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.string()), ("size", pa.int32()), ("hash", pa.int64()), ("window", pa.string())]))

    return run


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item, size, hash, window): every window of every item; item ids as text."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text")
    return map_batches(rows, _item_windows(n), "item string, size int, hash long, window string").distinct()


class WindowSet:
    """Windows by length, as sorted hashes behind a table of their leading bits."""

    def __init__(self, rows: Iterable[tuple[str, int, int, str]]):
        self.items: dict[tuple[int, bytes], set[str]] = defaultdict(set)
        by_size: dict[int, set[int]] = defaultdict(set)
        for item, size, h, window in rows:
            self.items[size, window.encode()].add(item)
            by_size[size].add(h)
        self.sizes = sorted(by_size)
        self.sorted, self.flags, self.shift = {}, {}, {}
        for size, found in by_size.items():
            h = np.sort(np.array(list(found), np.int64).view(np.uint64))
            bits = min(26, max(12, int(len(h)).bit_length() + 7))
            self.sorted[size], self.shift[size] = h, np.uint64(64 - bits)
            flags = np.zeros(1 << bits, bool)
            flags[(h >> self.shift[size]).astype(np.int64)] = True
            self.flags[size] = flags

    def positions(self, size: int, h: np.ndarray) -> np.ndarray:
        """Where h holds a window's hash."""
        maybe = np.flatnonzero(self.flags[size][(h >> self.shift[size]).astype(np.int64)])
        if not len(maybe):
            return maybe
        known, x = self.sorted[size], h[maybe]
        return maybe[known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x]


def verified(own: list[bytes], candidates: Iterable[tuple[int, int]], items: dict) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurring window, and the items with such windows."""
    edges, found = np.zeros(len(own) + 1, np.int64), set()
    for position, size in candidates:
        which = items.get((size, b" ".join(own[position : position + size])))
        if which:
            found |= which
            edges[position] += 1
            edges[position + size] -= 1
    return np.cumsum(edges[:-1]) > 0, found


def _verdict(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _without(text: bytes, hit: np.ndarray) -> str:
    """The text with every run of hit words, from first to last letter, taken out."""
    out, last, spans = [], 0, [m.span() for m in _WORD.finditer(lower(text))]
    for k in np.flatnonzero(hit):
        start = spans[k][0] if not k or not hit[k - 1] else last
        out.append(text[last:start])
        last = spans[k][1]
    return b"".join([*out, text[last:]]).decode()


def judged(texts: pa.Array, known: WindowSet) -> Iterator[tuple[int, int, np.ndarray | None, set[str]]]:
    """(row, words, hit words or None, items) for each text of a column."""
    data, at = buffers(texts)
    for part in words(texts, PLAIN):
        low = part.offsets[:-1]
        counts = np.diff(part.offsets)
        candidates: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size in known.sizes:
            found = known.positions(size, grams(part.hashes, size))
            if len(found):
                row = np.searchsorted(low, found, side="right") - 1
                row_end = part.offsets[row + 1]
                for p, r in zip(found[found + size <= row_end].tolist(), row[found + size <= row_end].tolist()):
                    candidates[r].append((p - int(low[r]), size))
        for r in range(part.last - part.first):
            if r in candidates:
                k = part.first + r
                own = _WORD.findall(lower(data[at[k] : at[k + 1]].tobytes()))
                yield k, int(counts[r]), *verified(own, candidates[r], known.items)
            else:
                yield part.first + r, int(counts[r]), None, set()


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _row(n: int, hit: np.ndarray | None, items: set[str]) -> tuple:
    n_hit = int(hit.sum()) if hit is not None else 0
    return n, n_hit, len(items), hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest(), _verdict(n, n_hit)


def window_set(benchmark: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> WindowSet | None:
    """The broadcastable set, or None if there are more than max_broadcast windows."""
    rows = item_windows(benchmark, n)
    if rows.count() > max_broadcast:
        return None
    return WindowSet(tuple(r) for r in rows.collect())


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    known = window_set(benchmark, n, max_broadcast)
    if known is None:
        return _scan_joined(docs, item_windows(benchmark, n))
    shared = spark.sparkContext.broadcast(known)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = [_row(c, hit, items) for _, c, hit, items in judged(batch.column(1), shared.value)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return map_batches(docs, run, f"doc_id long, {_RESULT}")


def _with_found(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs and a last column of the windows whose hash occurs in a row's text, for benchmarks
    too large to broadcast. Rows get a key of their own, written once."""
    rows = checkpointed(docs.withColumn("__row", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())

    def emit(batches):
        for batch in batches:
            ids = batch.column(0)
            for part in words(batch.column(1), PLAIN):
                for size in sizes:
                    h = grams(part.hashes, size)
                    row = np.searchsorted(part.offsets[:-1], np.arange(len(h)), side="right") - 1
                    good = np.arange(len(h)) + size <= part.offsets[row + 1]
                    row, h, where = row[good], h[good], np.flatnonzero(good)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + part.first)).cast(pa.int64()), pa.array(where - part.offsets[row], pa.int64()), pa.array(np.full(len(h), size, np.int32)), pa.array(h.astype(np.int64))], names=["__row", "position", "size", "hash"])

    found = map_batches(rows.select("__row", "text"), emit, "__row long, position long, size int, hash long").join(windows, ["size", "hash"])
    found = found.groupBy("__row", "position", "size", "window").agg(F.collect_set(F.struct("item")).alias("items"))
    per_row = found.groupBy("__row").agg(F.collect_list(F.struct("position", "size", "window", "items")).alias("__found"))
    return rows.join(per_row, "__row", "left").select(*docs.columns, "__found")


def _judged_found(texts: pa.Array, found: pa.Array) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """(words, hit words, items) for each text of a column."""
    for text, hits in zip(texts.to_pylist(), found.to_pylist()):
        own = _WORD.findall(lower((text or "").encode()))
        items: dict = defaultdict(set)
        for x in hits or []:
            items[x["size"], x["window"].encode()] |= {y["item"] for y in x["items"]}
        yield len(own), *verified(own, [(x["position"], x["size"]) for x in hits or [] if x["position"] + x["size"] <= len(own)], items)


def _scan_joined(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """As scan, for benchmarks too large to broadcast."""

    def decide(batches):
        for batch in batches:
            rows = [_row(*x) for x in _judged_found(batch.column(1), batch.column(2))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return map_batches(_with_found(docs, windows), decide, f"doc_id long, {_RESULT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without its contaminated documents (or, with remove="spans", with the hit words
    of those documents taken out); all columns as they are."""
    known, at, width = window_set(benchmark, n, max_broadcast), docs.columns.index("text"), len(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            if shared is not None:
                found = ((k, c, hit) for k, c, hit, _ in judged(texts, shared.value))
            else:
                found = ((k, c, hit) for k, (c, hit, _) in enumerate(_judged_found(texts, batch.column(width))))
                batch = batch.select(list(range(width)))
            bad = {k: hit for k, c, hit in found if hit is not None and _verdict(c, int(hit.sum()))}
            if remove == "documents":
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))
            else:
                new = [_without(x.encode(), bad[k]) if k in bad else x for k, x in enumerate(texts.to_pylist())]
                yield batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))

    return map_batches(docs if known is not None else _with_found(docs, item_windows(benchmark, n)), run, docs.schema)
