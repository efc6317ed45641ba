"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (two and three bytes of lower-cased text, everything that
is no letter taken as one space), weighted by TF-IDF and scaled to length one. Each language has
several centroids from spherical k-means; the language of the nearest centroid by cosine wins, and
a text that is far from all of them, measured against the training texts' own distances, is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep_rows, unused
from .textops import Slice, slices

#: At most so many texts of known language are learned from (those with the smallest hashes of their ids).
SAMPLE = 4000
BINS = 4096
#: Texts whose counts are held at once.
ROWS = 256
CENTROIDS = 4
UNKNOWN = "und"
#: A text is rejected below this share of the 0.5 per cent quantile of the training texts' cosines.
REJECT = 0.25

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(s: Slice) -> np.ndarray:
    """Counts of hashed n-grams, a row per text."""
    out = np.zeros((len(s), BINS), np.float32)
    b = _FOLD[s.bytes_].astype(np.uint32)
    if len(b) < 2:
        return out
    text_of = np.repeat(np.arange(len(s)), np.diff(s.offsets))
    two = b[:-1] << 8 | b[1:]
    ok = (text_of[:-1] == text_of[1:]) & (two != 0x2020)
    flat = np.bincount(text_of[:-1][ok] * BINS + _bin(two[ok]), minlength=out.size)
    if len(b) > 2:
        three = two[:-1] << 8 | b[2:]
        ok = (text_of[:-2] == text_of[2:]) & ((three & 0xFFFF) != 0x2020) & ((three >> 8) != 0x2020)
        flat += np.bincount(text_of[:-2][ok] * BINS + _bin(three[ok] | 0x1000000), minlength=out.size)
    out[:] = flat.reshape(len(s), BINS)
    return out


def gram_parts(s: Slice) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts) of a slice in bounded pieces."""
    for p in s.parts(ROWS):
        yield p.first, grams(p)


def _bin(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray
    langs: list[str]
    floors: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts)
        v *= self.idf
        v /= np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v), 1e-24))[:, None]
        return v

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of each text."""
        cos = self.weigh(counts) @ self.vectors.T
        at = cos.argmax(1)
        return at, np.clip(cos[np.arange(len(at)), at], 0, 1)

    def nearest_texts(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of each text of a slice."""
        found = [self.nearest(g) for _, g in gram_parts(s)]
        return np.concatenate([a for a, _ in found]), np.concatenate([c for _, c in found])


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; fewer centroids where texts are alike."""
    picks = [0]
    near = v @ v[0]
    for _ in range(min(k, len(v)) - 1):
        i = int(near.argmin())
        if near[i] > 1 - 1e-6:
            break
        picks.append(i)
        near = np.maximum(near, v @ v[i])
    c = v[picks]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(counts: np.ndarray, langs: list[str]) -> Centroids:
    """Centroids of texts of known languages."""
    df = (counts > 0).sum(0)
    idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
    model = Centroids(idf, np.zeros((0, BINS), np.float32), [], np.zeros(0))
    v = model.weigh(counts)
    lang = np.array(langs)
    vectors, names, floors = [], [], []
    for name in sorted(set(langs)):
        own = v[lang == name]
        c = cluster(own, CENTROIDS)
        floor = REJECT * float(np.quantile((own @ c.T).max(1), 0.005))
        vectors.append(c)
        names += [name] * len(c)
        floors += [floor] * len(c)
    return Centroids(idf, np.concatenate(vectors).astype(np.float32), names, np.array(floors))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Centroids | None:
    """Learn from the text and non-null lang of ``docs`` (doc_id, text, lang); None where there are none."""
    counts, langs = sample_counts(docs, sample)
    return train(counts, langs) if langs else None


def sample_counts(docs: DataFrame, sample: int) -> tuple[np.ndarray, list[str]]:
    """(n-gram counts, lang) of at most ``sample`` texts with a letter and a language.

    Only the ids of the sample and then its counts come to the driver. Of rows with one doc_id and
    one language the one with the smallest text counts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    picked = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "lang").limit(sample).select("doc_id", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                for i, g in gram_parts(s):
                    at = [np.flatnonzero(x) for x in g]
                    yield pa.record_batch(
                        [b.column("doc_id").slice(s.first + i, len(g)), b.column("lang").slice(s.first + i, len(g)),
                         pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([x[a].astype("<f4").tobytes() for x, a in zip(g, at, strict=True)], pa.binary())],
                        ["doc_id", "lang", "at", "n"])

    one = known.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = one.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, at binary, n binary")
    rows = rows.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    counts = np.zeros((rows.num_rows, BINS), np.float32)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        counts[i, np.frombuffer(at.as_py(), "<u2")] = np.frombuffer(n.as_py(), "<f4")
    return counts, rows["lang"].to_pylist()


def _identified(model: Centroids | None, texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, cosine, rejected) of texts."""
    pred, score, out = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
    for s in slices(texts) if model is not None else ():
        at, cos = model.nearest_texts(s)
        here = np.flatnonzero(letters[s.first : s.first + len(s)])
        pred[s.first + here] = np.array(model.langs, object)[at[here]]
        score[s.first + here] = cos[here]
        out[s.first + here] = cos[here] < model.floors[at[here]]
    return pred, score, out


def _letter(text_col: str):
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text; score is the cosine to the nearest centroid.

    A null text, one without a letter, and any text where nothing was learned are ``und`` with
    score 0, and rejected. Repeated rows give equal results, an empty table gives none, a null
    doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, out = _identified(model, b.column(1), np.asarray(b.column(2).to_pylist(), bool))
            yield pa.record_batch([b.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(out)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _letter(text_col).alias("letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Centroids | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter and is near enough to a language. Each row is judged by its own text."""
    letter = unused(docs, "letter")
    judged = keep_rows(docs.withColumn(letter, _letter(text_col)), lambda b: pa.array(~_identified(model, b.column(text_col), np.asarray(b.column(letter).to_pylist(), bool))[2]))
    return judged.drop(letter)
