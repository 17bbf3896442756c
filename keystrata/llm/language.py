"""Language of whole texts by interpolated Kneser-Ney character models.

Texts are lowered and every run of other characters than letters becomes one space. For each
language an order-4 model with Kneser-Ney discounting is built from its training documents:
counts, continuation counts, contexts and discounts are of all n-grams of the sample. The
models of ``BLOCK`` languages share sorted arrays of n-gram hashes, one per order, with one
column of log probabilities a language, and arrays of context hashes with back-off weights;
an n-gram unseen in all of them backs off to the next lower order. Size is in proportion to
the n-grams of the sample, however many languages there are. The language with the
lowest cross-entropy per symbol wins. On documents set aside from training, a limit on the
cross-entropy (above it a prediction counts as rejected and its score is halved) and the
logistic that turns margin and length into a score are fit.

Training uses at most ``MAX_TRAIN`` documents a language, chosen by a hash of the id among
those with a language that are not held out, and all their n-grams. Every fifth of them is
set aside, so a language with fewer than five has none there. Prediction reads every symbol.
Null texts and texts without letters are ``und`` with score 0; so is everything if no language
was learned. Of languages equally likely the first by name is predicted. Repeated rows are
predicted one by one and count once for each row in training; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.batches import map_batches
from keystrata.llm.quality import held_out
from keystrata.llm.words import mix
from keystrata.session import checkpointed

ORDER = 4
MAX_TRAIN = 400
BLOCK = 8  #: languages whose models share a table
_PIECE = 1 << 18
_SPACE = 32
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _folded(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters as they are, runs of others as one space; begins: where a text starts, whose
    first ORDER - 1 symbols (spaces) all stay. Returns the symbols and the begins among them."""
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for k in range(ORDER - 1):
        keep[begins + k] = True
    out = np.where(letter, codes, _SPACE)[keep].astype(np.uint64)
    return out, np.cumsum(keep)[begins] - 1


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of short texts one after another, and where each begins (with the end)."""
    pad = np.full(ORDER - 1, _SPACE, np.uint32)
    parts, begins, at = [], [], 0
    for text in texts:
        raw = _raw(text)
        begins.append(at)
        parts += [pad, raw, pad[:1]]
        at += len(raw) + ORDER
    out, first = _folded(np.concatenate(parts), np.array(begins))
    return out, np.append(first, len(out))


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    m = len(codes) - n + 1
    out = codes[:m] * _K[0]
    for k in range(1, n):
        out += codes[k : k + m] * _K[k]
    return mix(out + np.uint64(n))


@dataclass
class Block:
    """The models of a few languages (columns) over the n-grams that any of them knows."""

    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  #: order: hashes, log probabilities
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  #: order of the gram: hashes of its context, log weights


@dataclass
class Model:
    langs: list[str]
    blocks: list[Block] = field(default_factory=list)  #: BLOCK languages each, in the order of langs
    floor: float = 0.0  #: log probability of a symbol never seen
    limits: np.ndarray | None = None
    logistic: tuple[float, float, float] = (4.0, 0.5, 0.0)


def _codes(grams: pa.ChunkedArray, n: int) -> np.ndarray:
    text = "".join(grams.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(text, np.uint32).reshape(-1, n).astype(np.uint64)


def _keys(codes: np.ndarray) -> np.ndarray:
    """Hashes of rows of symbols, those of ``_hash``."""
    n = codes.shape[1]
    return mix((codes * _K[:n]).sum(axis=1, dtype=np.uint64) + np.uint64(n)) if n else np.zeros(len(codes), np.uint64)


def build_block(levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, floor: float) -> Block:
    """Interpolated Kneser-Ney from (language number, symbols, count) of all n-grams of each
    order; below the highest order, counts are of the distinct symbols before an n-gram."""
    out, below = Block(), (np.zeros(1, np.uint64), np.full((1, width), math.exp(floor)))
    for n in range(1, ORDER + 1):
        lang, codes, count = levels[n]
        context, at = np.unique(_keys(codes[:, :-1]), return_inverse=True)
        cell = at * width + lang
        total = np.bincount(cell, count, len(context) * width).reshape(-1, width)
        kinds = np.bincount(cell, minlength=len(context) * width).reshape(-1, width)
        ones, twos = (np.bincount(lang[count == c], minlength=width) for c in (1, 2))
        discount = np.where(ones > 0, np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95), 0.5)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        gram, first, which = np.unique(_keys(codes), return_index=True, return_inverse=True)
        own = np.zeros((len(gram), width))
        own[which, lang] = count
        at = at[first]
        own = np.maximum(own - discount, 0) / np.maximum(total[at], 1)
        lower = below[1][np.searchsorted(below[0], _keys(codes[first, 1:]))]
        now = own + weight[at] * lower
        out.grams[n] = gram, np.log(now).astype(np.float32)
        out.contexts[n] = context, np.log(weight).astype(np.float32)
        below = gram, now
    return out


def levels_of(grams: DataFrame) -> dict[int, DataFrame]:
    """(lang, gram, n) of each order from the counts of the highest: n counts the distinct
    n-grams one symbol longer."""
    out = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        shorter = out[order + 1].select("lang", F.expr(f"substring(gram, 2, {order})").alias("gram"))
        out[order] = shorter.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    return out


def build(grams: DataFrame) -> Model:
    """A model of all n-grams counted in (lang, gram, n). Levels are aggregated in Spark; the
    driver gets them as arrays, those of BLOCK languages at a time."""
    levels = {order: checkpointed(df) for order, df in levels_of(grams).items()}
    langs = sorted(r[0] for r in levels[1].select("lang").distinct().collect())
    floor = -math.log(levels[1].select("gram").distinct().count() + 1)
    model = Model(langs, floor=floor)
    for low in range(0, len(langs), BLOCK):
        own = langs[low : low + BLOCK]
        arrays = {}
        for order, df in levels.items():
            found = df.where(F.col("lang").isin(own)).toArrow()
            lang = np.searchsorted(np.array(own, object), np.array(found["lang"].to_pylist(), object)) if found.num_rows else np.zeros(0, np.int64)
            arrays[order] = lang, _codes(found["gram"], order), found["n"].to_numpy().astype(np.int64)
        model.blocks.append(build_block(arrays, len(own), floor))
    return model


def _found(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
    return at, hashes[at] == h if len(hashes) else np.zeros(len(h), bool)


def _log_probabilities(codes: np.ndarray, model: Model) -> np.ndarray:
    """Of each symbol from the ORDER-th on, in each language."""
    return np.concatenate([_in_block(codes, block, model.floor) for block in model.blocks], axis=1)


def _in_block(codes: np.ndarray, model: Block, floor: float) -> np.ndarray:
    m = len(codes) - ORDER + 1
    out = np.zeros((m, model.grams[1][1].shape[1]), np.float32)
    open_ = np.arange(m)
    for n in range(ORDER, 0, -1):
        h = _hash(codes[ORDER - n :], n)[open_]
        hashes, values = model.grams[n]
        at, hit = _found(hashes, h)
        out[open_[hit]] += values[at[hit]]
        open_ = open_[~hit]
        if not len(open_):
            return out
        hashes, values = model.contexts[n]
        if n > 1:
            at, hit = _found(hashes, _hash(codes[ORDER - n :], n - 1)[open_])
            out[open_[hit]] += values[at[hit]]
        else:
            out[open_] += values[0] + floor
    return out


def entropies(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per symbol in each language, number of symbols) of each text; 0 symbols
    for texts without letters."""
    sums, sizes = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    run, held = [], 0

    def flush():
        nonlocal run, held
        if not run:
            return
        codes, begins = symbols([texts[k] for k in run])
        size = np.diff(begins) - ORDER + 1
        p = _log_probabilities(codes, model)
        across = (begins[1:-1, None] - np.arange(1, ORDER)).ravel()  # windows over two texts
        p[across] = 0
        sums[run] = np.add.reduceat(p, begins[:-1], axis=0)
        letters = np.add.reduceat((codes != _SPACE).astype(np.int64), begins[:-1])
        sizes[run] = np.where(letters > 0, size, 0)
        run, held = [], 0

    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) > _PIECE:
            tail, seen = np.full(ORDER - 1, _SPACE, np.uint64), False
            for lo in range(0, len(text), _PIECE):
                raw = np.concatenate([tail.astype(np.uint32), _raw(text[lo : lo + _PIECE])])
                codes, _ = _folded(raw, np.zeros(1, np.int64))
                seen |= bool((codes[ORDER - 1 :] != _SPACE).any())
                if len(codes) >= ORDER:
                    sums[k] += _log_probabilities(codes, model).sum(axis=0, dtype=np.float64)
                    sizes[k] += len(codes) - ORDER + 1
                tail = codes[-(ORDER - 1) :]
            sizes[k] *= seen
            continue
        run.append(k)
        held += len(text) + ORDER
        if held > _PIECE:
            flush()
    flush()
    return -sums / np.maximum(sizes, 1)[:, None], sizes


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, scores, rejected)"""
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    e, n = entropies(texts, model)
    best = e.argmin(axis=1)
    rows = np.arange(len(texts))
    low = e[rows, best]
    if len(model.langs) > 1:
        rest = e.copy()
        rest[rows, best] = np.inf
        margin = rest.min(axis=1) - low
    else:
        margin = np.ones(len(texts))
    rejected = low > model.limits[best] if model.limits is not None else np.zeros(len(texts), bool)
    a, b, c = model.logistic
    score = 1 / (1 + np.exp(-np.clip(a * margin + b * np.log1p(n) + c, -50, 50)))
    score = np.where(n > 0, np.where(rejected, score / 2, score), 0.0)
    return [model.langs[k] if size else "und" for k, size in zip(best, n)], score, rejected | (n == 0)


def _count(batches):
    for batch in batches:
        out: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for lo in range(0, len(text or ""), _PIECE):
                codes, _ = symbols([text[lo : lo + _PIECE]])
                s = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                if any(c != " " for c in s):
                    out[lang].update(s[k : k + ORDER] for k in range(len(s) - ORDER + 1))
        rows = [(lang, gram, n) for lang, c in out.items() for gram, n in c.items()]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learns from docs (doc_id, text, lang) that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", F.col("lang").alias("of"), place.alias("place")).where(F.col("place") <= max_train)
    chosen = chosen.groupBy("doc_id", "of").agg(F.min("place").alias("place"))
    # At most max_train ids a language, so they may be sent to every task.
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").where("lang = of")
    aside = F.col("place") % 5 == 0  # never the only document of a language
    grams = map_batches(sample.where(~aside).select("lang", "text"), _count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = build(grams)
    if not model.langs:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches):
        for batch in batches:
            langs, e, n = batch.column(0).to_pylist(), *entropies(batch.column(1).to_pylist(), shared.value)
            good = [k for k in range(len(langs)) if n[k] and langs[k] in shared.value.langs]
            own = [shared.value.langs.index(langs[k]) for k in good]
            order = np.sort(e, axis=1)
            yield pa.RecordBatch.from_arrays([
                pa.array(own, pa.int64()), pa.array(e[good, own] if good else [], pa.float64()), pa.array((order[good, 1] - order[good, 0]) if good and e.shape[1] > 1 else np.ones(len(good))),
                pa.array(np.log1p(n[good]) if good else [], pa.float64()), pa.array(e[good].argmin(axis=1) == own if good else [], pa.bool_())], names=["own", "e", "margin", "n", "right"])

    rows = map_batches(sample.where(aside).select("lang", "text"), calibrate, "own long, e double, margin double, n double, right boolean").collect()
    rows.sort()
    limits = np.full(len(model.langs), np.inf)
    for k in range(len(model.langs)):
        e = np.array([r["e"] for r in rows if r["own"] == k])
        if len(e) >= 5:
            limits[k] = e.mean() + 4 * e.std() + 0.1
    model.limits = limits
    if rows:  # ridge-regularised logistic, starting from and drawn to the default
        x = np.array([[r["margin"], r["n"], 1.0] for r in rows])
        y = np.array([float(r["right"]) for r in rows])
        start = np.array(model.logistic)
        w = start.copy()
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(3)
            w = w + np.linalg.solve(h, x.T @ (y - q) - (w - start))
        model.logistic = tuple(float(v) for v in w)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, score, rejected = predict(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    out = map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
