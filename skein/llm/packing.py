"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Only lengths matter for a plan, and there are no more of them than a sequence has tokens. So the
driver sees a histogram (at most ``capacity`` rows), plans with whole classes of equal pieces at
once, and each piece then finds its place by its rank within its length. Ranks come from counts per
task and length, so no length, however common, has to pass through one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import _texts
from .shared import cut

CAPACITY = 1024
#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids binary"


class ByteTokenizer:
    """A byte-level BPE file of the tokenizers library, run by tiktoken's core, which is faster on one thread.

    Ids of merges rise with their rank, so the vocabulary alone gives the order of merging; a file
    for which that does not hold is refused. Special tokens in a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level files are handled")
        # the format writes bytes that are no printable Latin-1 as characters from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if ids != sorted(ids):
            raise ValueError("ids do not follow the order of merges")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null is the empty text."""
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes() if text else b""


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer of a file, once in each Python worker."""
    return ByteTokenizer(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole sequences, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def tokenize(docs: DataFrame, path: str, end: int | None = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document with their ids, in order.

    Null is the empty text, which has the end id alone (or no piece at all without one).
    """
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for i, texts in _texts(batch.column(1)):
                names = batch.column(0).slice(i, len(texts)).to_pylist()
                rows: list[tuple] = []
                for name, text in zip(names, texts, strict=True):
                    ids = t.encode(text) + tail
                    rows += [(name, k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths of a sequence) by best-two-fit.

    A sequence starts with the longest piece left and takes the longest that fits until nothing
    does; then its smallest piece gives way to two unpacked ones while these fill more.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    out: list[tuple[int, list[int]]] = []
    while left.any():
        used = np.zeros(capacity + 1, np.int64)
        items: list[int] = []
        gap = capacity
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1] > used[1 : gap + 1])
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            # as many of this length as fit, before looking again
            k = int(min(gap // n, left[n] - used[n]))
            items += [n] * k
            used[n] += k
            gap -= n * k
        while gap and len(items) > 1:
            small = items[-1]
            used[small] -= 1
            two = _best_two(left - used, gap + small)
            if two is None or sum(two) <= small:
                used[small] += 1
                break
            items.pop()
            for n in two:
                used[n] += 1
            items += two
            items.sort(reverse=True)
            gap += small - sum(two)
        lengths = np.flatnonzero(used)
        times = int((left[lengths] // used[lengths]).min())
        left -= used * times
        out.append((times, items))
    return out


def _best_two(left: np.ndarray, gap: int) -> list[int] | None:
    """Two lengths with the largest sum up to gap, the longer one as long as it can be."""
    have = np.flatnonzero(left[: gap + 1] > 0)
    have = have[have > 0]
    if not len(have):
        return None
    at = np.searchsorted(have, gap - have, "right") - 1
    ok = at >= 0
    a, b = have[ok], have[at[ok]]
    single = (a == b) & (left[a] < 2)
    if single.any():
        # a length of which one is left pairs with the next shorter one
        k = at[ok]
        k = np.where(single, k - 1, k)
        keep = k >= 0
        a, b = a[keep], have[np.maximum(k, 0)][keep]
    if not len(a):
        return None
    best = int(np.lexsort((np.maximum(a, b), a + b))[-1])
    return sorted((int(a[best]), int(b[best])), reverse=True)


def places(patterns: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of its runs."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for times, items in patterns:
        offset = 0
        for n in items:
            runs.setdefault(n, []).append((taken.get(n, 0), first, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each length within the task."""
    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for b in batches:
        lengths = b.column("length").to_numpy()
        order = np.argsort(lengths, kind="stable")
        ranks = np.empty(len(lengths), np.int64)
        values, begin, counts = np.unique(lengths[order], return_index=True, return_counts=True)
        for v, s, c in zip(values.tolist(), begin.tolist(), counts.tolist(), strict=True):
            ranks[order[s : s + c]] = np.arange(c) + seen.get(v, 0)
            seen[v] = seen.get(v, 0) + c
        yield pa.record_batch([*b.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(ranks)], [*b.schema.names, "part", "rank"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``pieces`` (any columns, with length from 1 to capacity) its sequence_id and offset.

    Columns named part, rank, sequence_id and offset are the operator's own: a caller's are left out.
    Every row gets a place, equal rows too; the table is written once in between so that ranks stay
    what they were when an executor is lost. A row of another length raises an error. An empty
    table gives no rows.
    """
    kept = [c for c in pieces.columns if c not in ("part", "rank", "sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(kept).schema)
    checked = pieces.select(*[F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit("length out of range")).cast("long")).alias("length") if c == "length" else F.col(f"`{c}`") for c in kept])
    rows = cut(checked.mapInArrow(_ranked, f"{schema}, part int, rank long"), "pieces")
    counts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, begin, n = np.unique(lengths[order], return_index=True, return_counts=True)
            for v, s, c in zip(values.tolist(), begin.tolist(), n.tolist(), strict=True):
                rows_ = order[s : s + c]
                starts, first, offset = where[v]
                run = np.searchsorted(starts, ranks[rows_], "right") - 1
                seq[rows_] = first[run] + ranks[rows_] - starts[run]
                off[rows_] = offset[run]
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    ranked = rows.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).select(*[f"`{c}`" for c in kept], "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 in place of their ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))

