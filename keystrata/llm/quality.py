"""Document quality from a linear-chain conditional random field over lines.

Every line gets binned features of its own (length, word shape, symbols, case, digits,
repetition) and of its neighbours. A two-state chain, trained with each line carrying its
document's label, gives each line a marginal probability of being good by the
forward-backward recursion; their mean weighted by line length, passed through a logistic
fit on the training documents, is the document's score.

Training uses at most ``MAX_TRAIN`` labelled documents, chosen by a hash of the id among
those that are not held out; scoring reads every line of every text. Labels are the only
thing learned from besides the text. Null, empty and blank texts are one empty line.
Without labels of both kinds the score is the share of good labels (0.5 without any).
Repeated rows are scored one by one; repeated labels of an id count once (the smallest).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.batches import map_batches
from keystrata.llm.words import PIECE, SPACED, _hashed, _long, buffers, mix

MAX_TRAIN = 6000
_CELLS = 1 << 16  #: lines in one array of the training
FEATURES = ("words", "mean_word", "odd", "upper", "digit", "terminal", "echo", "variety", "wide", "marks")
NEIGHBOUR = (2, 3, 6, 7)
BINS = 8


def _table(*classes: bytes) -> np.ndarray:
    """Byte classes counted side by side in one 64-bit sum, 21 bits each."""
    out = np.zeros(256, np.int64)
    for k, chars in enumerate(classes):
        for b in chars:
            out[b] += 1 << 21 * k
    return out


_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
_FIRST = _table(_LETTER, _UPPER, b"0123456789")
_SECOND = _table(b"*&%$#@|<>{}[]_=+~^\\/`", b"!?.", bytes(range(0x80, 0xC0)))
_MASK = (1 << 21) - 1


def _of_piece(b: np.ndarray, line: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines that begin at ``line``; h and at: words and their lines."""
    n = len(line)
    length = np.diff(np.append(line, len(b)))
    filled = np.flatnonzero(length > 0)
    first, second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(filled):
        first[filled], second[filled] = (np.add.reduceat(t[b], line[filled]) for t in (_FIRST, _SECOND))
    letters, upper, digits = first & _MASK, first >> 21 & _MASK, first >> 42
    odd, stops, extra = second & _MASK, second >> 21 & _MASK, second >> 42
    words = np.bincount(at, minlength=n)
    chars = np.maximum(length - extra, 1)
    same = np.flatnonzero((h[1:] == h[:-1]) & (at[1:] == at[:-1])) + 1 if len(h) > 1 else np.zeros(0, int)
    echo = np.bincount(at[same], minlength=n)
    unlike = np.unique(mix(h ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    variety = np.bincount(at[unlike], minlength=n)
    w = np.maximum(words, 1)
    f = np.stack([np.log1p(words), chars / w, odd / chars, upper / np.maximum(letters, 1), digits / chars, stops / w, echo / w, variety / w, np.log1p(length), (chars - letters - digits - stops - odd) / chars], axis=1)
    return f.astype(np.float32), length


def line_features(column: pa.Array):
    """(row, features, lengths) of each text; pieces of very long texts are cut at line ends
    where there are any, so a line of over PIECE bytes counts as several."""
    data, at = buffers(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1))
        b = data[at[first] : at[last]]
        if last - first == 1 and len(b) > PIECE:
            parts, lo = [], 0
            while lo < len(b):
                hi = min(lo + PIECE, len(b))
                if hi < len(b) and len(ends := np.flatnonzero(b[lo:hi] == 10)):
                    hi = lo + int(ends[-1]) + 1
                parts.append(_lines(b[lo:hi], np.array([0, hi - lo])))
                lo = hi
            yield first, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        else:
            breaks = at[first : last + 1] - at[first]
            f, length, off = _lines(b, breaks)
            for k in range(last - first):
                yield first + k, f[off[k] : off[k + 1]], length[off[k] : off[k + 1]]
        first = last


def _lines(b: np.ndarray, breaks: np.ndarray):
    """Features, lengths and each text's first line; every text has one line at least."""
    ends = np.flatnonzero(b == 10) + 1
    # A text begins a line; so does what follows a line end, unless it is the text's own end.
    inner = ends[~np.isin(ends, breaks)] if len(ends) else ends
    texts = breaks[:-1]
    line = np.sort(np.concatenate([texts, inner]), kind="stable")
    off = np.append(np.searchsorted(inner, texts, side="left") + np.arange(len(texts)), len(line))
    if len(b):
        start, h = _hashed(b, texts, SPACED) if len(b) <= PIECE else (np.zeros(0, np.int64), _long(b, SPACED))
        at = np.searchsorted(line, start, side="right") - 1
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    f, length = _of_piece(b, line, h, at)
    return f, length, off


@dataclass
class Model:
    """edges: bin limits by feature; own, before, after: weights by feature and bin, of good
    against bad; bias; stay and change: log weights of the chain's steps; scale and shift of
    the last logistic. Without both labels only ``prior`` counts."""

    prior: float
    edges: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: np.ndarray | None = None
    last: tuple[float, float] = (1.0, 0.0)


WIDTH = len(FEATURES) * BINS + 2 * len(NEIGHBOUR) * (BINS + 1) + 1  # the bias comes last


def _score_lines(s: list[float], steps) -> list[float]:
    """Marginal probabilities of good along one chain."""
    gg, bb = steps
    n = len(s)
    egg, ebb = math.exp(gg), math.exp(bb)

    def pass_on(x: float) -> float:
        if x > 30:
            return gg + math.log1p(math.exp(-x - gg)) if x + gg < 700 else gg
        if x < -30:
            return -bb
        e = math.exp(x)
        return math.log((e * egg + 1.0) / (e + ebb))

    forward = [0.0] * n
    x = None
    for k in range(n):
        x = s[k] + (pass_on(x) if k else 0.0)
        forward[k] = x
    b = 0.0
    out = [0.0] * n
    for k in range(n - 1, -1, -1):
        m = forward[k] + b
        out[k] = 1.0 / (1.0 + math.exp(-m)) if m > -700 else 0.0
        b = pass_on(s[k] + b)
    return out


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _edges(flat: np.ndarray) -> np.ndarray:
    """Limits of the bins of each feature: quantiles, without repeats."""
    out = np.full((len(FEATURES), BINS - 1), np.inf)
    for k in range(len(FEATURES)):
        limits = np.unique(np.quantile(flat[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        out[k, : len(limits)] = limits
    return out


@dataclass
class _Part:
    """Training documents of about the same number of lines, as padded rows."""

    bins: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    live: np.ndarray
    y: np.ndarray
    weigh: np.ndarray


def _parts(bins: list[np.ndarray], y: np.ndarray) -> list[_Part]:
    size = np.array([len(x) for x in bins])
    order, out, k = np.argsort(size, kind="stable"), [], 0
    while k < len(order):
        end = k + 1  # few cells, little padding
        while end < len(order) and (end + 1 - k) * size[order[end]] <= _CELLS and size[order[end]] <= 1.3 * size[order[k]] + 2:
            end += 1
        own = order[k:end]
        n = size[own]
        out.append(_Part(
            np.concatenate([bins[i] for i in own]).astype(np.int16), np.repeat(np.arange(len(own)), n), np.concatenate([np.arange(m) for m in n]),
            np.arange(n.max())[None, :] < n[:, None], y[own], 1.0 / n))  # documents count alike, however many lines they have
        k = end
    return out


def _gradient(part: _Part, weights: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Of the log likelihood, by weight and step: observed less expected counts."""
    n, t = part.live.shape
    s = np.zeros((n, t))
    s[part.rows, part.places] = weights[part.bins].sum(axis=1) + weights[-1]
    live, y = part.live, part.y[:, None]
    forward, backward = np.zeros((n, t)), np.zeros((n, t))
    forward[:, 0] = s[:, 0]
    for k in range(1, t):
        x = forward[:, k - 1]
        forward[:, k] = s[:, k] + np.logaddexp(x + steps[0], 0.0) - np.logaddexp(x, steps[1])
    for k in range(t - 2, -1, -1):
        x = s[:, k + 1] + backward[:, k + 1]
        backward[:, k] = np.where(live[:, k + 1], np.logaddexp(x + steps[0], 0.0) - np.logaddexp(x, steps[1]), 0.0)
    p = 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))
    error = ((y - p) * part.weigh[:, None])[part.rows, part.places]
    out = np.zeros(WIDTH + 2)
    for c in range(part.bins.shape[1]):
        out[:WIDTH] += np.bincount(part.bins[:, c], weights=error, minlength=WIDTH)
    out[WIDTH - 1] += error.sum()
    if t > 1:
        nxt = live[:, 1:] * part.weigh[:, None]
        joint = np.stack([forward[:, :-1] + steps[0] + s[:, 1:] + backward[:, 1:], forward[:, :-1], s[:, 1:] + backward[:, 1:], np.full((n, t - 1), steps[1])])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        out[WIDTH] = ((y - joint[0]) * nxt).sum()
        out[WIDTH + 1] = ((1 - y - joint[3]) * nxt).sum()
    return out


def fit_model(lines: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 120) -> Model:
    """Trains on documents given as line features, line lengths and labels."""
    if not len(labels):
        return Model(0.5)
    if labels.min() == labels.max():
        return Model(float(labels.mean()))
    edges, y = _edges(np.concatenate(lines)), labels.astype(float)
    bins = [_bins(x, edges) for x in lines]
    parts = _parts(bins, y)
    params = np.concatenate([np.zeros(WIDTH), [1.0, 1.0]])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for turn in range(1, rounds + 1):
        g = sum(_gradient(p, params[:WIDTH], params[WIDTH:]) for p in parts) / len(y) - 1e-3 * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        params[WIDTH:] = np.clip(params[WIDTH:], 0, 4)
    model = Model(float(y.mean()), edges, params[:WIDTH].copy(), params[WIDTH:].copy())
    raw = _logit(np.array([_raw(b, length, model) for b, length in zip(bins, lengths)]))
    a, c = 1.0, 0.0
    for _ in range(30):  # Newton steps of the last logistic
        q = 1 / (1 + np.exp(-(a * raw + c)))
        r = q * (1 - q) + 1e-9
        h = np.array([[(r * raw * raw).sum() + 1e-3, (r * raw).sum()], [(r * raw).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([((y - q) * raw).sum(), (y - q).sum()]))
        a, c = a + step[0], c + step[1]
    model.last = (float(a), float(c))
    return model


def _raw(bins: np.ndarray, length: np.ndarray, model: Model) -> float:
    s = (model.weights[bins].sum(axis=1) + model.weights[-1]).tolist()
    p = _score_lines(s, model.steps)
    total = float(length.sum())
    return float(np.dot(p, length)) / total if total else sum(p) / len(p)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Score of every text of a column."""
    out = np.full(len(column), model.prior)
    if model.weights is None:
        return out
    a, c = model.last
    rows, parts, lengths, held = [], [], [], 0

    def flush():
        bounds = np.cumsum([0, *(len(x) for x in parts)])
        picked = _bins(np.concatenate(parts), model.edges, bounds)
        s = model.weights[picked].sum(axis=1) + model.weights[-1]
        for k, row in enumerate(rows):
            p, length = _score_lines(s[bounds[k] : bounds[k + 1]].tolist(), model.steps), lengths[k]
            total = float(length.sum())
            raw = float(np.dot(p, length)) / total if total else sum(p) / len(p)
            raw = min(max(raw, 1e-4), 1 - 1e-4)
            out[row] = 1 / (1 + math.exp(-(a * math.log(raw / (1 - raw)) + c)))

    for row, f, length in line_features(column):
        rows.append(row)
        parts.append(f)
        lengths.append(length)
        held += len(f)
        if held > 4096:
            flush()
            rows, parts, lengths, held = [], [], [], 0
    if rows:
        flush()
    return out


def _bins(f: np.ndarray, edges: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
    """The weights that the features of each line pick: own bins, then the neighbours' (the
    last bin of each: there is none). bounds: where texts begin and end among the lines."""
    bounds = np.array([0, len(f)]) if bounds is None else bounds
    own = np.stack([np.searchsorted(edges[k], f[:, k], side="right") for k in range(len(FEATURES))], axis=1)
    near, base = own[:, NEIGHBOUR], len(FEATURES) * BINS
    none = np.full((1, len(NEIGHBOUR)), BINS)
    before, after = np.concatenate([none, near[:-1]]), np.concatenate([near[1:], none])
    before[bounds[:-1]], after[bounds[1:] - 1] = BINS, BINS
    out = [own + np.arange(len(FEATURES)) * BINS]
    for k, x in enumerate((before, after)):
        out.append(x + base + (np.arange(len(NEIGHBOUR)) + k * len(NEIGHBOUR)) * (BINS + 1))
    return np.concatenate(out, axis=1)


def _features(batches):
    for batch in batches:
        f, lengths = [], []
        for _, x, length in line_features(batch.column(1)):
            f.append(x.astype(np.float32).tobytes())
            lengths.append(length.astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int64()), pa.array(f, pa.binary()), pa.array(lengths, pa.binary())], names=["doc_id", "label", "f", "lengths"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Learns from at most max_train labelled documents that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # Bounded by max_train, so it may be sent to every task.
    rows = map_batches(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), _features, "doc_id long, label long, f binary, lengths binary")
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("f", "ascending")])
    lines = [np.frombuffer(x.as_py(), np.float32).reshape(-1, len(FEATURES)) for x in got["f"]]
    lengths = [np.frombuffer(x.as_py(), np.int64) for x in got["lengths"]]
    return fit_model(lines, lengths, got["label"].to_numpy())


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores(batch.column(1), shared.value), pa.float64())], names=["doc_id", "score"])

    out = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores at least ``least``, all columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), shared.value) >= least))

    return map_batches(docs, run, docs.schema)
