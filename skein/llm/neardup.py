"""Near-duplicate documents by SetSketch registers.

A document's sketch holds ``BANDS * ROWS`` registers: the minimum of an exponential variate over
its shingles, truncated to a power of ``BASE`` close to one. Registers of a union are the smaller
of two registers, and two sets agree on one with a probability of about their Jaccard similarity,
so bands of registers are keys for a hash join. Candidates pass a joint maximum-likelihood
estimate of the similarity (set sizes known) and are then confirmed on the full shingle sets.

No pairs within a group are listed. Copies with one shingle set are one node, and each bucket first
links its members to its smallest member only. What that leaves open are buckets that span several
components. Documents there whose sketch is near one of another component are compared in blocks by
an upper bound of their intersection, from shingles counted in CELLS cells, which no link fails; the
few cross pairs that pass are confirmed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut
from .textops import distinct, mix, slices

BANDS, ROWS = 32, 4
BASE, RATE = 1.00005, 20.0
_REGISTERS = BANDS * ROWS
_LIMIT = (1 << 32) - 2
#: A pair is dropped unread only if its estimate lies this far below the threshold: six standard errors.
MARGIN = 0.2
BLOCK = 1024
CELLS = 8192

_rng = np.random.default_rng(99)
_XOR = _rng.integers(0, 1 << 32, _REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, _REGISTERS, dtype=np.uint32) | np.uint32(1)

SKETCH = "doc_id long, n_shingles long, set_id binary, registers binary"


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; mergeable by the element-wise maximum."""
    least = np.full(_REGISTERS, (1 << 32) - 1, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 1024):
        part = high[i : i + 1024]
        np.minimum(least, ((part[:, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, _LIMIT).astype(np.uint32)


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    a = mix(shingles).sum(dtype=np.uint64)
    b = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(shingles))], np.uint64).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ns, ids, regs = [], [], []
        for s in slices(batch.column(1)):
            for i in range(len(s)):
                u = distinct(s.shingles(i))
                ns.append(len(u))
                ids.append(set_id(u) if len(u) else None)
                regs.append(registers(u).tobytes() if len(u) else None)
        yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_id", "registers"])


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its set size, set name and registers (null for a text without words)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sketches, SKETCH)


def _likelihood(j: np.ndarray, equal: np.ndarray, above: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Log-likelihood of the similarity j given registers equal, above and below; u: the first set's share of both sizes."""
    k = (BASE - 1) / BASE
    hi, lo = (-np.log1p(-np.clip(x, 0, 1) * k) / np.log(BASE) for x in (u - (1 - u) * j, 1 - u - u * j))
    return above * np.log(np.maximum(hi, 1e-12)) + below * np.log(np.maximum(lo, 1e-12)) + equal * np.log(np.maximum(1 - hi - lo, 1e-12))


def estimate(equal: np.ndarray, above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the counts of registers and both set sizes, to 1/128."""
    u = n / (n + m)
    top = np.minimum(u / (1 - u), (1 - u) / u)
    best, out = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, 129):
        ll = _likelihood(top * step, equal, above, below, u)
        better = ll > best
        best[better], out[better] = ll[better], (top * step)[better]
    return out


def _likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes allow the similarity and its estimate is not far below: the likelihood, which has one peak, still rises there."""
    ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    got = np.flatnonzero(ok)
    if len(got):
        x, y = a[got], b[got]
        u = n[got] / (n[got] + m[got])
        counts = (x == y).sum(1), (x > y).sum(1), (x < y).sum(1)
        t = percent / 100 - MARGIN
        ok[got] = _likelihood(t + 1e-3, *counts, u) >= _likelihood(np.float64(t), *counts, u)
    return ok


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, _REGISTERS)


def _filter_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                keep = _likely(_matrix(t.column("ra")), _matrix(t.column("rb")), t.column("na").to_numpy(), t.column("nb").to_numpy(), percent)
                yield t.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verify(percent: int):
    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for s in slices(column):
            for i in range(len(s)):
                yield distinct(s.shingles(i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(sets(t.column("ta")), sets(t.column("tb")), strict=True):
                both = len(x) + len(y) - len(distinct(np.concatenate((x, y))))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough; texts meet the pairs through two hash joins."""
    one = pairs.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long")


def _near(key: tuple, t: pa.Table, percent: int) -> pa.Table:
    """The members of two blocks of a bucket whose sketch is near that of another component."""
    need = int(np.floor((percent / 100 - MARGIN) * _REGISTERS))
    block = t.column("block").to_numpy()
    n = t.column("n").to_numpy()
    # one byte of each register: equal registers stay equal
    short, ids, comp = _matrix(t.column("registers").combine_chunks()).astype(np.uint8), t.column("id").to_numpy(), t.column("component").to_numpy()
    left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
    near = np.zeros(len(ids), bool)
    for k in left.tolist():
        o = right[(comp[right] != comp[k]) & (100 * np.minimum(n[right], n[k]) >= percent * np.maximum(n[right], n[k]))]
        if len(o):
            o = o[(short[o] == short[k]).sum(1) >= need]
            near[o] = True
            near[k] |= len(o) > 0
    return pa.table({"id": pa.array(ids[near])})


def _cross(key: tuple, t: pa.Table, percent: int) -> pa.Table:
    """Pairs of different components whose shingles could be similar enough by their counts in cells."""
    block, n, ids, comp = (t.column(c).to_numpy() for c in ("block", "n", "id", "component"))
    cells = t.column("cells").to_pylist()
    left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
    out = [np.zeros((2, 0), np.int64)]
    if len(set(comp.tolist())) > 1:
        has = np.zeros((len(right), CELLS), np.float32)
        for i, k in enumerate(right.tolist()):
            has[i, np.frombuffer(cells[k], np.uint16)] = 1
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            counts = np.stack([np.bincount(np.frombuffer(cells[k], np.uint16), minlength=CELLS) for k in some.tolist()]).astype(np.float32)
            most = np.minimum(counts @ has.T, np.minimum(n[some][:, None], n[right][None, :]))
            ok = (comp[some][:, None] != comp[right][None, :]) & (100 * most >= percent * (n[some][:, None] + n[right][None, :] - most))
            a, b = np.nonzero(ok)
            out.append(np.stack((np.maximum(ids[some[a]], ids[right[b]]), np.minimum(ids[some[a]], ids[right[b]]))))
    a, b = np.concatenate(out, axis=1)
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(distinct(s.shingles(i)) % np.uint64(CELLS)).astype(np.uint16).tobytes() for s in slices(batch.column(1)) for i in range(len(s))]
        yield pa.record_batch([batch.column(0), pa.array(got, pa.binary())], ["id", "cells"])


def _in_blocks(rows: DataFrame, placed: DataFrame, work, percent: int, schema: str) -> DataFrame:
    """Let ``work`` see the members of buckets (key, id) that span several components, in pairs of blocks of bounded size."""
    of = rows.join(placed.select("id", "component"), "id")
    open_ = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi")
    open_ = open_.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"))
    dealt = rows.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("nb").cast("long")).cast("int"))
    dealt = dealt.select("key", "id", "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("key", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        return work(key, t, percent)

    return dealt.join(placed, "id").groupBy("key", "i", "j").applyInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every document.

    Documents are linked when 100 * intersection >= percent * union of their distinct five-word
    shingles; component_id is the smallest doc_id reachable, class_id the smallest doc_id with the
    same shingle set, kept is doc_id = component_id. Texts that are null, empty or without words
    have an empty set and are linked with nothing; a text of fewer than five words has one shingle;
    a null doc_id is linked with nothing, has null in component_id and is kept. Rows that repeat a
    doc_id give a row each; where their texts differ, the smallest text stands for the doc_id. An empty table gives no rows. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_ = cut(sketch(base), "sketch")
    some = all_.where("doc_id is not null and n_shingles > 0")
    classes = cut(
        some.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "classes"
    )
    texts = base.where("doc_id is not null")
    if _repeats(all_):
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    keys = F.array(*[
        F.xxhash64(F.lit(i), F.substring("registers", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(BANDS)
    ])
    members = cut(classes.select("id", F.explode(keys).alias("key")), "bands")
    leaders = members.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "b")
    stars = members.join(leaders, "key").where("id > b").select(F.col("id").alias("a"), "b").distinct()
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    likely = cut(stars.join(left, "a").join(right, "b").mapInArrow(_filter_pairs(percent), "a long, b long"), "stars")
    links = cut(_confirmed(likely, texts, percent), "links")
    found = connected_components(links)
    placed = cut(classes.join(found, "id", "left").select("id", "n", "registers", F.coalesce("component", "id").alias("component")), "placed")
    near = cut(_in_blocks(members, placed, _near, percent, "id long"), "near")
    cells = near.join(texts.withColumnRenamed("doc_id", "id"), "id").select("id", "text").mapInArrow(_cells, "id long, cells binary")
    cells = cut(cells.join(placed.select("id", "n", "component"), "id"), "cells")
    more = _in_blocks(members.join(near, "id"), cells, _cross, percent, "a long, b long").join(likely, ["a", "b"], "left_anti")
    more = cut(more, "cross")
    if not more.isEmpty():
        links = links.unionByName(_confirmed(more, texts, percent))
        found = connected_components(links)
    ids = classes.select("set_id", F.col("id").alias("class_id")).join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    ids = ids.select("set_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = all_.select("doc_id", "n_shingles", "set_id").join(ids, "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _repeats(rows: DataFrame) -> bool:
    """Whether a doc_id is held by more than one row."""
    return not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
