"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence are its own features and those of its neighbours, and
neighbouring labels depend on each other; forward-backward gives each line's probability of being
good. Their mean, weighted by the lines' lengths, is the document's quality, mapped to a
probability by a logistic curve. Features are computed from byte buffers, messages for all
documents of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import STOP_WORDS
from .shared import keep_rows
from .textops import Slice, mix, slices

#: At most so many labelled documents are learned from (those with the smallest hashes of their ids).
SAMPLE = 4000
NEIGHBOURS = (-2, -1, 1, 2)

_UPPER, _LOWER_, _DIGIT, _SYMBOL, _SHOUT, _STOP, _PIPE, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:], _CLASS[0x30:0x3A] = _UPPER, _LOWER_, _LOWER_, _DIGIT
for _chars, _kind in (("#*$%&<>@^~=+\\/_{}[]", _SYMBOL), ("!?", _SHOUT), (".,;:", _STOP), ("|", _PIPE)):
    for _c in _chars:
        _CLASS[ord(_c)] = _kind
FEATURES = 8 + 9


def _stop_hashes() -> np.ndarray:
    s = next(slices(pa.array([" ".join(STOP_WORDS)])))
    return np.sort(s.word_hashes)


_STOPS = _stop_hashes()


def line_features(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, bytes per line, first line of each text); a text has one line at least."""
    data, offsets = s.data, s.offsets
    n = len(data)
    breaks = np.flatnonzero(data == 10) + 1
    # a break at the very end of a text opens no line
    inner = breaks[~np.isin(breaks, offsets[1:])]
    starts = np.sort(np.concatenate((offsets[:-1], inner)), kind="stable")
    lines = 1 + np.bincount(np.searchsorted(offsets, inner, "right") - 1, minlength=len(s))
    first = np.concatenate(([0], np.cumsum(lines)[:-1]))
    ends = np.concatenate((starts[1:], [n]))
    size = ends - starts
    count = len(starts)
    kinds = _CLASS[data]
    line_of = np.repeat(np.arange(count), size)
    by_class = np.bincount(line_of * 8 + kinds, minlength=count * 8).reshape(count, 8).astype(np.float64)
    w = np.searchsorted(s.word_starts, starts)
    w = np.concatenate((w, [len(s.word_starts)]))
    words = np.diff(w)
    hashes = s.word_hashes
    line_of_word = np.repeat(np.arange(count), words)
    per = np.maximum(words, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(line_of_word, weights=flag, minlength=count) / per

    def same(back: int) -> np.ndarray:
        out = np.zeros(len(hashes))
        if len(hashes) > back:
            out[back:] = (hashes[back:] == hashes[:-back]) & (line_of_word[back:] == line_of_word[:-back])
        return out

    stop = _STOPS[np.minimum(np.searchsorted(_STOPS, hashes), len(_STOPS) - 1)] == hashes
    body = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=body[1:])
    line_hash = mix((body[w[1:]] - body[w[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + words.astype(np.uint64))
    text_of = np.repeat(np.arange(len(s)), np.diff(np.concatenate((first, [count]))))
    key = line_hash ^ mix(text_of.astype(np.uint64))
    again = np.ones(count)
    again[np.unique(key, return_index=True)[1]] = 0
    again[words == 0] = 0
    last = np.zeros(count)
    full = size > 1
    ending = np.maximum(ends - 1 - (data[np.maximum(ends - 1, 0)] == 10) if n else ends - 1, 0)
    if n:
        last[full] = np.isin(data[ending[full]], np.frombuffer(b".!?", np.uint8))
    f = np.empty((count, FEATURES))
    f[:, :8] = by_class / np.maximum(size, 1)[:, None]
    f[:, 8] = np.log1p(size)
    f[:, 9] = np.log1p(words)
    f[:, 10] = np.log1p(by_class[:, :3].sum(1) / per)
    f[:, 11] = share(stop.astype(float))
    f[:, 12] = share(same(1))
    f[:, 13] = share(same(2))
    f[:, 14] = again
    f[:, 15] = last
    f[:, 16] = by_class[:, _UPPER] / np.maximum(by_class[:, _UPPER] + by_class[:, _LOWER_], 1)
    return f, np.maximum(size, 1), first


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of its neighbours (zero beyond the text) and a constant."""
    n = len(f)
    text_of = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [n]))))
    parts = [f]
    for d in NEIGHBOURS:
        at = np.arange(n) + d
        ok = (at >= 0) & (at < n)
        at = np.clip(at, 0, max(n - 1, 0))
        ok &= text_of[at] == text_of
        parts.append(f[at] * ok[:, None])
    return np.concatenate([*parts, np.ones((n, 1), f.dtype)], axis=1)


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) per line, pair marginals from each line to the next [n, 2, 2], log normaliser per text).

    emit: score of good over bad per line; trans[a, b]: score of label b after a. Texts advance
    together, longest first, so a step costs one numpy call however many there are.
    """
    n = len(emit)
    lengths = np.diff(np.concatenate((first, [n])))
    order = np.argsort(-lengths, kind="stable")
    start, size = first[order], lengths[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    unary = np.stack((np.zeros(n), emit), axis=1)
    fwd, back = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(steps):
        at = start[: active[t]] + t
        if t:
            x = fwd[at - 1][:, :, None] + trans
            fwd[at] = np.logaddexp(x[:, 0], x[:, 1]) + unary[at]
        else:
            fwd[at] = unary[at]
    for t in range(steps - 2, -1, -1):
        at = start[: active[t + 1]] + t
        x = trans + (unary[at + 1] + back[at + 1])[:, None, :]
        back[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    ends = np.concatenate((first[1:], [n])) - 1
    z = np.logaddexp(fwd[ends, 0], fwd[ends, 1])
    zl = np.repeat(z, lengths)
    good = np.exp(fwd[:, 1] + back[:, 1] - zl)
    pairs = np.zeros((n, 2, 2))
    inner = np.ones(n, bool)
    inner[ends] = False
    i = np.flatnonzero(inner)
    pairs[i] = np.exp(fwd[i][:, :, None] + trans + (unary[i + 1] + back[i + 1])[:, None, :] - zl[i][:, None, None])
    return good, pairs, z


@dataclass
class CrfModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def lines(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        x = with_neighbours((f - self.mean) / self.scale, first)
        return marginals(x @ self.weights, first, self.trans)[0]

    def score(self, f: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Quality of every text."""
        m = np.add.reduceat(self.lines(f, first) * size, first) / np.add.reduceat(size, first)
        return 1 / (1 + np.exp(-(self.slope * (m - 0.5) + self.shift)))


def train(f: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 120, penalty: float = 1e-3) -> CrfModel:
    """Fit by gradient ascent on the conditional likelihood; a line has its document's label."""
    lengths = np.diff(np.concatenate((first, [len(f)])))
    mean, scale = f.mean(0), f.std(0) + 1e-6
    x = with_neighbours(((f - mean) / scale).astype(np.float32), first)
    y = np.repeat(label, lengths).astype(float)
    # lines count by document, so that long ones do not decide alone
    weight = np.repeat(1 / lengths, lengths)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(f), bool)
    inner[np.concatenate((first[1:], [len(f)])) - 1] = False
    seen = np.zeros((2, 2))
    yi = y.astype(int)
    i = np.flatnonzero(inner)
    np.add.at(seen, (yi[i], yi[i + 1]), weight[i])
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    docs = len(first)
    for step in range(1, epochs + 1):
        good, pairs, _ = marginals(x @ w, first, trans)
        grads = [x.T @ ((y - good) * weight) / docs - penalty * w, (seen - (pairs * weight[:, None, None]).sum(0)) / docs - penalty * trans]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            move = 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if k:
                trans = trans + move
            else:
                w = w + move
    model = CrfModel(mean, scale, w, trans, 1.0, 0.0)
    q = np.add.reduceat(model.lines(f, first) * size, first) / np.add.reduceat(size, first) - 0.5
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * q + b)))
        d = p * (1 - p) + 1e-9
        g = np.array([((label - p) * q).sum() - 1e-2 * a, (label - p).sum()])
        h = np.array([[(d * q * q).sum() + 1e-2, (d * q).sum()], [(d * q).sum(), d.sum()]])
        move = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a + np.clip(move[0], -5, 5), b + np.clip(move[1], -5, 5)
    return CrfModel(mean, scale, w, trans, float(a), float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CrfModel | float:
    """Learn from ``labels`` (doc_id, quality); a constant where there are not both labels.

    Features are made on the executors; the driver gets those of at most ``sample`` documents. Of a
    doc_id with several rows the one with the smallest text counts, of several labels the largest.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text"), lower=True):
                f, size, first = line_features(s)
                ends = np.concatenate((first[1:], [len(f)]))
                yield pa.record_batch(
                    [b.column("doc_id").slice(s.first, len(s)), b.column("quality").slice(s.first, len(s)),
                     pa.array([f[i:j].astype("<f4").tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()), pa.array([size[i:j].astype("<i8").tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())],
                    ["doc_id", "quality", "f", "size"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int").alias("quality"))), "doc_id")
    one = joined.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = one.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, f binary, size binary").toArrow().sort_by("doc_id")
    label = rows["quality"].to_numpy()
    if len(set(label.tolist())) < 2:
        return float(label.mean()) if len(label) else 0.5
    f = np.frombuffer(b"".join(rows["f"].to_pylist()), "<f4").reshape(-1, FEATURES).astype(float)
    sizes = rows["size"].to_pylist()
    size = np.frombuffer(b"".join(sizes), "<i8")
    lengths = np.array([len(x) // 8 for x in sizes])
    return train(f, size, np.concatenate(([0], np.cumsum(lengths)[:-1])), label)


def _judged(model: CrfModel | float, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(score, bad lines) of texts."""
    out, bad = np.empty(len(texts)), np.zeros(len(texts), np.int64)
    for s in slices(texts):
        here = slice(s.first, s.first + len(s))
        if isinstance(model, float):
            out[here] = model
            continue
        f, size, first = line_features(s)
        f = f.astype(np.float32).astype(float)
        good = model.lines(f, first)
        m = np.add.reduceat(good * size, first) / np.add.reduceat(size, first)
        out[here] = 1 / (1 + np.exp(-(model.slope * (m - 0.5) + model.shift)))
        bad[here] = np.add.reduceat((good < 0.5).astype(np.int64), first)
    return out, bad


def score(docs: DataFrame, model: CrfModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, bad_lines) of every whole text; score is the probability of good quality.

    A null or empty text counts as one empty line. Repeated rows give equal results, an empty
    table gives none, a null doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, bad = _judged(model, b.column(1))
            yield pa.record_batch([b.column(0), pa.array(out), pa.array(bad)], ["doc_id", "score", "bad_lines"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, bad_lines long")


def keep_good(docs: DataFrame, model: CrfModel | float, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more. Each row is judged by its own text, whatever else has its doc_id."""
    return keep_rows(docs, lambda b: pa.array(_judged(model, b.column(text_col))[0] >= least))


def fold(parts: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts, F.lit(-1))
