"""Chroma fingerprints of recordings, and their alignment.

A recording is cut into overlapping frames whose spectra are folded into the twelve pitch classes.
Over the integral image of these frames sixteen rectangle filters are evaluated at every place;
each gives two bits by three thresholds, and the sixteen make one packed integer a frame.
From FRAMES of them in a row some bits are taken, in four ways, each of which leaves one group of bits
out: these are a place's keys. A key has 64 other bits of the same integers with it, of which places that vote for one
another differ in NEAR at most: where keys agree by chance they mostly differ in more, and are not compared. All places with a key in common vote for offsets of their recordings. Every
offset that has a vote is checked by the share of differing bits over the whole overlap, and of a
pair's the one with the smallest share is kept.

A key with more than CROWD places (silence, held notes, many copies) lists no pairs. Its places vote with its
smallest one first. Then those that are not chained to one another by what was found are compared in
blocks, all of one class with all of the others. So classes are those of all pairs, and n copies give some n links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut
from .textops import mix

FRAME, HOP = 1024, 512
LOW_HZ, HIGH_HZ = 60.0, 2000.0
SPAN = 12
#: Bits that may differ, and frames that must overlap, for two recordings to be the same.
MAX_BIT_ERROR = 0.15
MIN_OVERLAP = 24
#: Bits that a key takes of each of so many integers in a row, in four ways: none of the j-th byte.
FRAMES, BITS = 8, 4
#: Bits of each of these integers beside the key's, and how many of all 64 may differ (25 per cent; overlaps may differ in 15).
OTHER, NEAR = 8, 16
#: Places of a key that are listed in pairs; of more, so many make a block.
CROWD, BLOCK = 32, 256
#: Votes of a task that are held to give each once.
VOTES = 1 << 20
_RNG = np.random.default_rng(11)
MASKS = [[sum(1 << int(b) for b in _RNG.choice([b for b in range(32) if b >> 3 != j], BITS, replace=False)) for _ in range(FRAMES)] for j in range(4)]
OTHERS = [[[int(b) for b in _RNG.choice([b for b in range(32) if not mask >> b & 1], OTHER, replace=False)] for mask in masks] for masks in MASKS]
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the sixteen filters, by rule."""
    return [(i % 4, (5 * i) % (12 - h), h, w) for i, (h, w) in enumerate((2 + 2 * (i % 5), 4 + 4 * (i % 3)) for i in range(16))]


FILTERS = _filters()
THRESHOLDS = np.array([-0.6, 0.0, 0.6])


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by pitch class, each frame scaled to length one; none if the recording is shorter than a frame."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if not n:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[:: HOP][:n] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    fold = np.zeros((len(hz), 12))
    ok = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    fold[ok, np.round(12 * np.log2(hz[ok] / 440.0)).astype(int) % 12] = 1
    c = power @ fold
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed 32-bit integers, one a place."""
    c = chroma(samples.astype(np.float32), rate)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        a, b = np.arange(n) + t, np.arange(n) + t + w
        return image[b, y + h] - image[a, y + h] - image[b, y] + image[a, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:
            p, q = area(0, w, y, h // 2), area(0, w, y + h // 2, h - h // 2)
        elif kind == 1:
            p, q = area(0, w // 2, y, h), area(w // 2, w - w // 2, y, h)
        elif kind == 2:
            p = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
            q = area(w // 2, w - w // 2, y, h // 2) + area(0, w // 2, y + h // 2, h - h // 2)
        else:
            p = area(w // 4, w // 2, y, h)
            q = area(0, w // 4, y, h) + area(w // 4 + w // 2, w - w // 4 - w // 2, y, h)
        out = out << np.uint32(2) | _GRAY[np.searchsorted(THRESHOLDS, np.log((0.05 + p) / (0.05 + q)))]
    return out


def tones(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rate: int = 8000, step: int = 512, takes: int = 1) -> DataFrame:
    """Render vectors as recordings (rec_id, take, pcm, rate): each component is a note. A stand-in for a table of audio.

    Take 0 is clean; later takes begin with some more notes and have noise, both by the id. Null
    vectors and ones with nulls, NaN or infinities in them give recordings without samples; a null
    id is 0 there. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                out, of, take = [], [], []
                for i, (key, v) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    for t in range(takes):
                        of.append(i)
                        take.append(t)
                        if not v or not np.isfinite(np.array([np.nan if x is None else x for x in v])).all():
                            out.append(b"")
                            continue
                        rng = np.random.default_rng([(key or 0) & 0xFFFFFFFF, t])
                        notes = np.round(18 * np.tanh(3 * np.array(v)))
                        if t:
                            notes = np.concatenate((rng.integers(-18, 19, rng.integers(1, 9)), notes))
                        wave = 12000 * np.sin(2 * np.pi * np.cumsum(np.repeat(440.0 * 2 ** (notes / 12), step)) / rate)
                        if t:
                            wave = wave + 300 * rng.standard_normal(len(wave), np.float32)
                        out.append(wave.astype("<i2").tobytes())
                yield pa.record_batch([part.column(0).take(pa.array(of, pa.int64())), pa.array(take, pa.int32()), pa.array(out, pa.binary()), pa.array(np.full(len(out), rate, np.int32))], ["rec_id", "take", "pcm", "rate"])

    return vectors.select(F.col(id_col).cast("long").alias("rec_id"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "rec_id long, take int, pcm binary, rate int")


def fingerprints(recordings: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", rate_col: str = "rate") -> DataFrame:
    """(rec_id, print binary) of recordings in 16-bit little-endian samples; null or short ones have an empty print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(np.frombuffer(p[: len(p) // 2 * 2], "<i2"), r).astype("<u4").tobytes() if p and r else b"" for p, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["rec_id", "print"])

    return recordings.select(F.col(id_col).cast("long").alias("rec_id"), pcm_col, F.col(rate_col).cast("int")).mapInArrow(run, "rec_id long, print binary")


def bit_error(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, frames) where place i of x meets place i - offset of y."""
    lo, hi = max(0, offset), min(len(x), len(y) + offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(x[lo:hi] ^ y[lo - offset : hi - offset]).mean()) / 32, hi - lo


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, place, other bits) for each of MASKS and each place with FRAMES integers from it on."""
    for b in batches:
        ids, prints = b.column(0).to_numpy(), b.column(1).to_pylist()
        for at in range(0, len(prints), 256):
            some = [np.frombuffer(p, "<u4") for p in prints[at : at + 256]]
            size = np.array([len(p) for p in some])
            many = np.maximum(size - FRAMES + 1, 0)
            place = np.concatenate([np.arange(n) for n in many])
            if not len(place):
                continue
            x, first = np.concatenate(some), np.repeat(np.cumsum(size) - size, many) + place
            for j, masks in enumerate(MASKS):
                key, other = np.full(len(place), j, np.uint64), np.zeros(len(place), np.uint64)
                for k, mask in enumerate(masks):
                    for n, bit in enumerate(OTHERS[j][k], k * OTHER):
                        other |= (x[first + k] >> np.uint32(bit) & np.uint32(1)).astype(np.uint64) << np.uint64(n)
                    key = mix(key * np.uint64(3) + (x[first + k] & np.uint32(mask)).astype(np.uint64) + np.uint64(k << 32))
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.repeat(ids[at : at + 256], many)), pa.array(place.astype(np.int32)), pa.array(other.view(np.int64))], ["key", "id", "place", "other"])


MET = "key long, a long, b long, offset int, place int"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _votes, each once of so many as VOTES in a row: a pair that is alike has votes for one offset all along."""
    held: list[pa.RecordBatch] = []
    for batch in _votes(batches):
        held.append(batch)
        if sum(b.num_rows for b in held) >= VOTES:
            yield from _once(held)
            held = []
    if held:
        yield from _once(held)


def _once(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes = pa.Table.from_batches(held)
    lists = votes.filter(pc.is_valid(votes["key"]))
    pairs = votes.filter(pc.is_null(votes["key"]))
    a, b, offset = (pairs[c].to_numpy() for c in ("a", "b", "offset"))
    by = np.lexsort((offset, b, a))
    new = np.ones(len(by), bool)
    new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]) | (offset[by][1:] != offset[by][:-1])
    yield from lists.to_batches()
    yield from pairs.take(pa.array(by[new])).to_batches()


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, id, place, other in this order -> MET: all votes of places with near other bits of keys with CROWD places at most (key is null); of others each place with its vote for the smallest one."""
    held = [np.zeros(0, np.int64)] * 4
    crowd = None  # the first row of the last key, if it is known to have more than CROWD places

    def settle(key: np.ndarray, ids: np.ndarray, place: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        first = np.repeat(edge[:-1], np.diff(edge))
        many = np.repeat(np.diff(edge), np.diff(edge)) > CROWD
        a, b = [], []
        for step in range(1, CROWD):
            i = np.flatnonzero((key[step:] == key[:-step]) & ~many[step:]) + step
            if not len(i):
                break
            i = i[np.bitwise_count((other[i] ^ other[i - step]).view(np.uint64)) <= NEAR]
            a.append(i)
            b.append(i - step)
        a, b = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b))
        a, b = a[ids[a] != ids[b]], b[ids[a] != ids[b]]
        return rows(a, b, key, ids, place, np.flatnonzero(many), ids[first[many]], place[first[many]])

    def rows(a, b, key, ids, place, i, least, at) -> pa.RecordBatch:  # noqa: ANN001
        keys = pa.array(np.concatenate((key[a], key[i])), mask=np.arange(len(a) + len(i)) < len(a))
        columns = [np.concatenate(v) for v in ((ids[a], ids[i]), (ids[b], least), (place[a] - place[b], place[i] - at), (place[a], place[i]))]
        return pa.record_batch([keys, *(pa.array(c).cast(k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True))], ["key", "a", "b", "offset", "place"])

    none = np.zeros(0, np.int64)
    for batch in batches:
        new = [batch.column(c).to_numpy().astype(np.int64) for c in range(4)]
        if crowd is not None and len(new[0]):
            n = int(np.sum(new[0] == crowd[0]))
            if n:
                yield rows(none, none, *(c[:n] for c in new[:3]), np.arange(n), np.full(n, crowd[1]), np.full(n, crowd[2]))
            new = [c[n:] for c in new]
            if len(new[0]):
                crowd = None
        held = [np.concatenate(v) for v in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        same = held[0] == held[0][-1]
        last = int(np.argmax(same))
        if len(held[0]) - last > CROWD:
            crowd = tuple(int(c[last]) for c in held[:3])
            last = len(held[0])
        if last:
            yield settle(*(c[:last] for c in held))
            held = [c[last:] for c in held]
    if len(held[0]):
        yield settle(*held)


LINK = "a long, b long, offset int, bit_error double, overlap long"


def _across(group: pa.Table) -> pa.Table:
    """Rows lo, hi, block, id, place, component, print of one key and two blocks (or one with itself): links that join all components of which a pair fits, the key's places being one another."""
    lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
    block, ids, place, of = (group[c].to_numpy().copy() for c in ("block", "id", "place", "component"))
    x = [np.frombuffer(p, "<u4") for p in group["print"].to_pylist()]
    left, right = int(place.max()), max(len(p) - int(q) for p, q in zip(x, place, strict=True))
    wide, there = np.zeros((len(x), left + right), np.uint32), np.zeros((len(x), left + right), bool)
    for p, w, h, q in zip(x, wide, there, left - place, strict=True):
        w[q : q + len(p)], h[q : q + len(p)] = p, True
    out = []
    for i in range(1, len(x)):
        j = np.flatnonzero((of[:i] != of[i]) & ((block[:i] != block[i]) | (lo == hi)))
        both = there[j] & there[i]
        n = both.sum(1)
        error = np.where(both, np.bitwise_count(wide[j] ^ wide[i]), 0).sum(1) / np.maximum(32 * n, 1)
        fit = (error <= MAX_BIT_ERROR) & (n >= MIN_OVERLAP)
        j, error, n = j[fit], error[fit], n[fit]
        while len(j):
            k = int(np.argmin(error))
            a, b = (i, int(j[k])) if ids[i] > ids[j[k]] else (int(j[k]), i)
            out.append((int(ids[a]), int(ids[b]), int(place[a] - place[b]), float(error[k]), int(n[k])))
            of[of == of[j[k]]] = of[i]
            keep = of[j] != of[i]
            j, error, n = j[keep], error[keep], n[keep]
    return pa.Table.from_batches([_linked(out)])


def _linked(rows: list[tuple]) -> pa.RecordBatch:
    out = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["a", "b", "offset", "bit_error", "overlap"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("a", "b", "offsets", "pa", "pb"))
        rows = []
        for a, o, offsets, x, y in zip(*columns, strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            tried = [(*bit_error(x, y, d), d) for d in offsets]
            fit = [(e, d, n) for e, n, d in tried if e <= MAX_BIT_ERROR and n >= MIN_OVERLAP]
            if fit:
                e, d, n = min(fit)
                rows.append((a, o, d, e, n))
        yield _linked(rows)


def align(prints: DataFrame) -> DataFrame:
    """(rec_id, n_frames, class_id, component_id, match_id, offset, bit_error) for every recording.

    class_id is the smallest rec_id with an equal print, component_id the smallest one that chains
    of matches reach; match_id, offset and bit_error tell the best match of the class with another among those
    compared (null if there is none). Empty prints match nothing; null ids are left out of matching; an empty
    table gives no rows.
    """
    prints = cut(prints, "prints")
    some = prints.where(F.length("print") > 0).where("rec_id is not null")
    classes = cut(some.groupBy("print").agg(F.min("rec_id").alias("id")), "classes")
    keys = classes.select("id", "print").mapInArrow(_values, "key long, id long, place int, other long")
    met = cut(keys.repartition("key").sortWithinPartitions("key", "id", "place").mapInArrow(_meetings, MET), "met")
    best = met.where("a <> b").select("a", "b", "offset").distinct().groupBy("a", "b").agg(F.collect_list("offset").alias("offsets"))
    with_a = best.join(classes.select(F.col("id").alias("a"), F.col("print").alias("pa")), "a")
    both = with_a.join(classes.select(F.col("id").alias("b"), F.col("print").alias("pb")), "b")
    links = cut(both.select("a", "b", "offsets", "pa", "pb").mapInArrow(_check, LINK), "links")
    crowds = met.where("key is not null").select("key", F.col("a").alias("id"), "place")
    if not crowds.isEmpty():
        of = connected_components(links).select("id", "component")
        crowds = cut(crowds.join(of, "id", "left").withColumn("component", F.coalesce("component", "id")), "crowds")
        # of a key whose places are of one component no pair is left to find
        sized = crowds.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        block = crowds.join(sized.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "key")
        block = block.withColumn("block", F.pmod(F.xxhash64("id", "place"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        block = block.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "place", "component").join(classes, "id")
        links = cut(links.unionByName(block.groupBy("key", "lo", "hi").applyInArrow(_across, LINK)), "links")
    found = connected_components(links)
    either = links.select("a", "b", "offset", "bit_error").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("offset")).alias("offset"), "bit_error"))
    match = either.groupBy("a").agg(F.min(F.struct("bit_error", "b", "offset")).alias("m"))
    of = classes.join(found, "id", "left").join(match, F.col("id") == F.col("a"), "left")
    of = of.select("print", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"), F.col("m.b").alias("match_id"), F.col("m.offset").alias("offset"), F.col("m.bit_error").alias("bit_error"))
    out = prints.join(of, "print", "left")
    return out.select("rec_id", (F.length("print") / 4).cast("long").alias("n_frames"), F.coalesce("class_id", "rec_id").alias("class_id"), F.coalesce("component_id", "rec_id").alias("component_id"), "match_id", "offset", "bit_error")
