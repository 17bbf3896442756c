"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

1. Texts are tokenised in the tasks with a public vocabulary file and closed with id 0; longer
   documents than a sequence are cut into full pieces, the first of which may be shorter.
2. Pieces are range-sorted by length (and row, so that a frequent length spreads over many
   tasks), numbered in each range, and get their rank within their length from the ranges'
   counts. Gaps are kept sorted as well: as runs of consecutive sequences with equally much
   room. Pieces of one length, like sequences of one gap, can stand for each other, so a run
   (size, first rank, number) describes them all, and there are never more lengths than
   tokens in a sequence, however many documents there are.
3. Bulk-synchronous supersteps work on these runs. In a superstep every length looks up its
   successor, the smallest gap it fits in. Where several lengths have the same successor the
   longest has the first rank and the others wait for the next superstep; within the winner
   the pieces of lowest rank fill the sequences of lowest number, as many in each as fit. Then
   gaps are updated and the supersteps repeat. Lengths over half a sequence without a successor
   open sequences at once; others only when a superstep has placed nothing, longest first.
4. Every piece reads its sequence and offset off the steps by its length and rank, in one more
   distributed sweep; the steps are bounded by the sequence length, not by the documents.

The result needs as many sequences as sequential best fit in descending order on every
distribution tried (tests). Only the id and text columns are read. A null or empty text is a
document of one token. Every row is a document of its own, also repeated ids and null ids.
Texts are read whole, a part at a time; strings of special tokens count as ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keystrata.llm.batches import map_batches
from keystrata.session import checkpointed

LENGTH = 2048  #: tokens of a sequence
END = 0  #: the id that closes a document
PART = 1 << 20  #: characters tokenised at once
RANKS = 42  #: bits for a rank within a length

#: A single space between two characters that are certainly no white space. The splitting
#: pattern of byte-level files always starts a new unit there, so texts may be cut before it.
_CUT = re.compile(" (?<=[!-~À-ÖØ-öø-ÿ] )(?=[!-~À-ÖØ-öø-ÿ])")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: visible Latin-1
    characters stand for themselves, the other bytes for the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranked(path: str):
    """The vocabulary of a byte-level file as ranks, which encode in a third of the time, or
    None where ids are not in the order of the merges or texts are changed before. The ids
    are the same (compared over all code points, random strings and whole documents)."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    plain = not whole.get("normalizer") and not whole.get("post_processor") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    byte = byte_symbols()
    extra = {x["content"] for x in whole.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in extra}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"]["".join(m)] for m in merges]
    if order != sorted(order) or len(merges) + 256 != len(ranks):
        return None
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.path, self.ranked = path, ranked(path)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def _part(self, text: str) -> bytes:
        if self.ranked is not None:
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # its expressions give up at very long runs of white space
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > PART and self.ranked is not None:
            cut = _CUT.search(text, at + PART)
            if not cut:
                break
            out.append(self._part(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self._part(text[at:])])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    return Encoder(path)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def _pieces(path: str, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            rows, held = [], 0
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                ids = encode(text.as_py() or "") + END.to_bytes(4, "little")
                rows += [(doc, k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cuts(len(ids) // 4, size))]
                held += len(ids)
                if held > 1 << 23 or i + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    rows, held = [], 0

    return run


def pieces(docs: DataFrame, path: str | None = None, size: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids are 32-bit little-endian."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _pieces(path or vocabulary(), size), "doc_id long, piece int, start long, length long, ids binary")


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the running number within a length; rows come sorted."""
    here, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        length = batch.column("length").to_numpy()
        if not len(length):
            continue
        new = np.flatnonzero(np.r_[True, length[1:] != length[:-1]])
        run = np.arange(len(length)) - np.repeat(new, np.diff(np.r_[new, len(length)]))
        if length[0] == last:
            run[: new[1] if len(new) > 1 else len(run)] += count
        last, count = length[-1], int(run[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), here, np.int32)), pa.array(run.astype(np.int64))], names=[*batch.schema.names, "range", "place"])


class Gaps:
    """Sequences with room, as runs of consecutive numbers by the size of their gap."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, size: int, first: int, number: int) -> None:
        if size and number:
            if not self.runs[size]:
                insort(self.sizes, size)
            self.runs[size].append((first, number))

    def successor(self, length: int) -> int | None:
        at = bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, size: int, most: int) -> tuple[int, int]:
        """Up to ``most`` consecutive sequences of a gap."""
        first, number = self.runs[size].pop()
        if number > most:
            self.runs[size].append((first + most, number - most))
        elif not self.runs[size]:
            self.sizes.pop(bisect_left(self.sizes, size))
        return first, min(number, most)


def supersteps(lengths: dict[int, int], size: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, first rank, per sequence, first sequence, offset) that pack so many pieces
    of each length, and the number of sequences. Pieces from a step's first rank on go into its
    sequences, ``per sequence`` in each, up to the length's next step."""
    left, done, gaps = {x: n for x, n in lengths.items() if n}, defaultdict(int), Gaps()
    order, steps, used = sorted(left, reverse=True), [], 0

    def put(length: int, gap: int, first: int, number: int) -> list[tuple[int, int, int]]:
        """Fills up to ``number`` sequences with a gap; gives the gaps left."""
        each = gap // length
        placed = min(left[length], each * number)
        steps.append((length, done[length], each, first, size - gap))
        done[length] += placed
        left[length] -= placed
        full, rest = divmod(placed, each)
        return [(gap - each * length, first, full), *([(gap - rest * length, first + full, 1)] if rest else []),
                (gap, first + full + bool(rest), number - full - bool(rest))]

    def opened(length: int) -> list[tuple[int, int, int]]:
        nonlocal used
        number = -(-left[length] // (size // length))
        used += number
        return put(length, size, used - number, number)

    while order:
        fresh, matched = [], {}
        for length in order:
            gap = gaps.successor(length)
            if gap is not None:
                matched.setdefault(gap, length)  # the longest proposer ranks first
            elif 2 * length > size:
                fresh += opened(length)
        for gap, length in matched.items():
            while left[length] and gaps.runs[gap]:
                fresh += put(length, gap, *gaps.take(gap, -(-left[length] // (gap // length))))
        if not fresh:
            fresh = opened(order[0])
        for x in fresh:
            gaps.add(*x)
        order = [x for x in order if left[x]]
    return steps, used


def _placed(steps, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, each, first, offset = steps.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << RANKS) + rank, side="right") - 1
            n = (length << RANKS) + rank - key[at]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + n // each[at]), pa.array(offset[at] + n % each[at] * length)], names=[*names, "sequence_id", "offset"])

    return run


def place(table: DataFrame, size: int = LENGTH) -> DataFrame:
    """``table`` with sequence_id and offset for each row by its ``length`` (1 to size). It is
    written once, so that all passes see the same rows; columns called range, place or rank
    are not allowed."""
    spark, names = table.sparkSession, table.columns
    table = checkpointed(table)
    keys = [F.col("length").desc(), *(F.col(c) for c in names if c != "length")]
    ranged = table.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = StructType(table.schema.fields + StructType.fromDDL("range int, place long").fields)
    ranged = checkpointed(map_batches(ranged, _numbered, schema))
    counts = checkpointed(ranged.groupBy("range", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    totals = counts.groupBy("length").agg(F.sum("n"))  # at most ``size`` rows
    steps, _ = supersteps({r[0]: r[1] for r in totals.collect()}, size)
    steps = np.array(sorted(steps), np.int64).reshape(-1, 5)
    key = (steps[:, 0] << RANKS) + steps[:, 1]
    shared = spark.sparkContext.broadcast((key, steps[:, 2], steps[:, 3], steps[:, 4]))
    ranked = ranged.join(offsets, ["range", "length"]).select(*names, (F.col("place") + F.col("before")).alias("rank"))
    out = StructType(table.schema.fields + StructType.fromDDL("sequence_id long, offset long").fields)
    return map_batches(ranked, _placed(shared, names), out)


def pack(docs: DataFrame, path: str | None = None, size: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where every piece goes."""
    return place(pieces(docs, path, size).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), size)


def sequences(docs: DataFrame, path: str | None = None, size: int = LENGTH) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, ids 32-bit little-endian."""
    rows = checkpointed(pieces(docs, path, size).withColumn("row", F.monotonically_increasing_id()))
    placed = place(rows.select("row", "length"), size).drop("length")
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    out = rows.select("row", "length", "ids").join(placed, "row").groupBy("sequence_id").agg(held.alias("held"))
    return out.select("sequence_id", F.expr("aggregate(held.length, 0L, (a, x) -> a + x)").alias("length"), F.expr("aggregate(held.ids, X'', (a, x) -> a || x)").alias("ids"))
