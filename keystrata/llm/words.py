"""Word hashes of whole Arrow text columns, computed with array operations.

A batch of texts is one byte buffer with offsets, so words are found and hashed for many
texts at once. A word's hash is a polynomial over a fixed random table of byte values,
modulo 2**64, read off one running sum; A-Z share the entries of a-z. Buffers are handled in
pieces of ``PIECE`` bytes that end at a separator or at a text's end, so memory does not
depend on the length of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, _U), np.full(PIECE, base, _U)]).cumprod(dtype=_U)


_POW, _INV = _powers(_BASE), _powers(_INVERSE)
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES = _RANDOM[np.frombuffer(_LOWER, np.uint8)]
_SECOND = np.random.Generator(np.random.PCG64(577)).integers(1, 1 << 63, 256, dtype=np.uint64)[np.frombuffer(_LOWER, np.uint8)] * _U(2) + _U(1)
_MULT = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def _separators(inside) -> np.ndarray:
    return np.array([not inside(b) for b in range(256)])


#: Words of any bytes but ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = _separators(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of letters, digits and anything beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once in lower case.
PLAIN = _separators(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


def lower(data: bytes) -> bytes:
    """A-Z in lower case, everything else as it is."""
    return data.translate(_LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of each value over all of it (a bijection)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@dataclass
class Words:
    """Words of the texts ``first`` to ``last`` (exclusive) of a column."""

    first: int
    last: int
    offsets: np.ndarray  #: of each text's first word, with one more for the end
    hashes: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _bounds(b: np.ndarray, breaks: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in some bytes; breaks: where texts begin."""
    gap = sep[b]
    inside = ~gap
    before, after = np.empty(len(b), bool), np.empty(len(b), bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    cut = breaks[(breaks > 0) & (breaks < len(b))]
    before[cut] = True
    after[cut - 1] = True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def _values(b: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of the words of at most PIECE bytes."""
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum(table[b] * _POW[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _INV[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _hashed(b: np.ndarray, breaks: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in at most PIECE bytes; breaks: where texts begin."""
    start, end = _bounds(b, breaks, sep)
    return start, _values(b, start, end, _BYTES)


def _long(b: np.ndarray, sep: np.ndarray) -> np.ndarray:
    """Word hashes of one text over PIECE bytes."""
    out, at = [], 0
    while at < len(b):
        stop = min(at + PIECE, len(b))
        gaps = np.flatnonzero(sep[b[at:stop]])
        if stop < len(b):
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word of PIECE bytes or more
                while stop < len(b) and not sep[b[stop]]:
                    stop += 1
                word = lower(b[at:stop].tobytes())
                out.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), _U))
                at = stop
                continue
        out.append(_hashed(b[at:stop], np.zeros(0, np.int64), sep)[1])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, _U)


def words(column: pa.Array, sep: np.ndarray) -> Iterator[Words]:
    """Word hashes of a column, a run of texts at a time."""
    data, at = buffers(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1)
        last = min(last, n)
        b = data[at[first] : at[last]]
        if len(b) > PIECE:
            h = _long(b, sep)
            yield Words(first, last, np.array([0, len(h)]), h)
        elif not len(b):
            yield Words(first, last, np.zeros(last - first + 1, np.int64), np.zeros(0, _U))
        else:
            breaks = at[first : last + 1] - at[first]
            start, h = _hashed(b, breaks[:-1], sep)
            yield Words(first, last, np.searchsorted(start, breaks), h)
        first = last


@dataclass
class Located(Words):
    """Words with their places in the column's bytes and a second, independent hash."""

    start: np.ndarray
    end: np.ndarray
    second: np.ndarray


def _pieces(b: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(from, to, one long word) of the pieces of a text over PIECE bytes."""
    at = 0
    while at < len(b):
        stop, alone = min(at + PIECE, len(b)), False
        if stop < len(b):
            gaps = np.flatnonzero(sep[b[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                alone = True
                while stop < len(b) and not sep[b[stop]]:
                    stop += 1
        yield at, stop, alone
        at = stop


def located(column: pa.Array, sep: np.ndarray) -> Iterator[Located]:
    """As words(), with places and a second hash: two words with both hashes equal are taken
    for the same word (128 bits)."""
    data, at = buffers(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = min(max(first + 1, int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1), n)
        b, breaks = data[at[first] : at[last]], at[first : last + 1] - at[first]
        cuts = [(0, len(b), False)] if len(b) <= PIECE else _pieces(b, sep)
        parts = []
        for low, high, alone in cuts:
            if alone:
                digest = np.frombuffer(hashlib.blake2b(lower(b[low:high].tobytes()), digest_size=16).digest(), _U)
                parts.append((np.array([low]), np.array([high]), digest[:1], digest[1:]))
            elif high > low:
                x = b[low:high]
                start, end = _bounds(x, breaks[:-1] if len(b) <= PIECE else breaks[:0], sep)
                parts.append((start + low, end + low, _values(x, start, end, _BYTES), _values(x, start, end, _SECOND)))
        if parts:
            start, end, one, two = (np.concatenate(x) for x in zip(*parts))
        else:
            start, end, one, two = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
        yield Located(first, last, np.searchsorted(start, breaks), one, start + at[first], end + at[first], two)
        first = last


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words (empty if there are fewer)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = hashes[:m] * _MULT[0]
    for j in range(1, n):
        out += hashes[j : j + m] * _MULT[j % 64]
    out += _U(n * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    return mix(out)
