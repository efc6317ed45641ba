"""Language-model scores by prediction by partial matching over bytes.

A text is its lower-cased words with one space between them and an end. The model is a trie of byte
contexts: the ORDER bytes before a byte, over words' borders, and before a text's start as many ends.
A context that has not seen the next byte escapes to the next shorter one, and what the longer context
has seen is excluded there. How likely an escape is, is estimated from all contexts of the same order
with about as many bytes seen (n) and about as many different ones (d): each training byte is left out
once, and it counts whether the rest of its context has it; d / (n + d) is the estimate where there is
little to count.

The code length of a byte depends on it and the ORDER bytes before it, so each different string of
ORDER + 1 bytes is costed once and a document's score is the sum over its places. Strings are counted
by Spark. The trie is split by the last three bytes of the contexts: all contexts of three bytes or
more that escape to one another are in one part, the shorter ones (2**24 at most) are in all. What
strings cost is sent to the executors, in as many passes over the texts as its size asks for; order
and scores are the same at any size.

The base score needs the counts of words. A task gives the words of its documents numbers of its own
(a *part*, of bounded size) and each document becomes a bag of these; words are counted across parts,
and the counts go back to the parts that have them. No table of words reaches the driver or a broadcast.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textops import Slice, slices

ORDER = 5
#: Costs of strings that are sent to the executors at once (12 bytes each, 48 in a worker); more take more passes.
MOST_SENT = 4_000_000
#: Strings in one part of the trie, about.
PART_STRINGS = 50_000
PART_WORDS = 400_000
MARK, END = 0x20, 0x0A
_CLASSES, _PRIOR = 8 * 40 * 24, 20.0

_ROWS = "part long, doc_id long, digest long, held_out boolean, n_tokens long, bag binary, word binary, number int, train long"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, text, held_out, digest -> rows of documents (their words' numbers and how often) and rows of each part's words."""
    names = [x.split()[0] for x in _ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

    def rows(**cols: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.record_batch([cols.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds, strict=True)], names)

    part = TaskContext.get().partitionId() << 24

    def fresh() -> tuple[dict[int, int], list[bytes], np.ndarray]:
        return {}, [bytes([END])], np.zeros(1 << 16, np.int64)

    number, words, train = fresh()

    def flush() -> pa.RecordBatch:
        return rows(part=pa.array(np.full(len(words), part, np.int64)), word=pa.array(words, pa.binary()), number=pa.array(np.arange(len(words), dtype=np.int32)), train=pa.array(train[: len(words)].copy()))

    for batch in batches:
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for s in slices(batch.column(1)):
            per = np.diff(s.word_ranges)
            doc = np.repeat(np.arange(len(s)), per)
            uniq, at, inverse = np.unique(s.word_hashes, return_index=True, return_inverse=True)
            ids = np.empty(len(uniq), np.int64)
            data, starts, ends = s.bytes_.tobytes(), s.word_starts[at].tolist(), s.word_ends[at].tolist()
            for i, h in enumerate(uniq.tolist()):
                k = number.get(h)
                if k is None:
                    k = number[h] = len(words)
                    words.append(data[starts[i] : ends[i]])
                ids[i] = k
            if len(words) > len(train):
                train = np.concatenate((train, np.zeros(max(len(train), len(words)), np.int64)))
            here = held[s.first : s.first + len(s)]
            # the end of each document is a word too, number 0
            used, tf = np.unique(np.concatenate((doc << 32 | ids[inverse], np.arange(len(s)) << 32)), return_counts=True)
            number_of, doc_of = used & 0xFFFFFFFF, used >> 32
            np.add.at(train, number_of[~here[doc_of]], tf[~here[doc_of]])
            cuts = np.searchsorted(doc_of, np.arange(len(s) + 1))
            bags = []
            for i in range(len(s)):
                a, b = cuts[i], cuts[i + 1]
                step = np.diff(number_of[a:b], prepend=0)
                bags.append(zlib.compress(np.concatenate((step, tf[a:b])).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
            yield rows(part=pa.array(np.full(len(s), part, np.int64)), doc_id=batch.column(0).slice(s.first, len(s)), digest=batch.column(3).slice(s.first, len(s)), held_out=pa.array(here), n_tokens=pa.array(per.astype(np.int64) + 1), bag=pa.array(bags, pa.binary()))
            if len(words) >= PART_WORDS:
                yield flush()
                part += 1
                number, words, train = fresh()
    yield flush()


def _unbag(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.ascontiguousarray(np.frombuffer(zlib.decompress(bag), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    k = len(x) // 2
    return np.cumsum(x[:k]), x[k:]


def laid_out(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last one ends): words with one space between them, and an end."""
    starts, ends, ranges = s.word_starts, s.word_ends, s.word_ranges
    per = np.diff(ranges)
    # a text without words is one of no length, and its end
    items = np.maximum(per, 1)
    first = np.cumsum(items) - items
    size, begin = np.ones(items.sum(), np.int64), np.zeros(items.sum(), np.int64)
    doc = np.repeat(np.arange(len(s)), per)
    at = first[doc] + np.arange(len(starts)) - ranges[doc]
    size[at] += ends - starts
    begin[at] = starts
    stop = np.cumsum(size)
    source = np.repeat(begin - (stop - size), size) + np.arange(size.sum())
    data = np.append(s.bytes_, np.uint8(0))[np.minimum(source, len(s.bytes_))]
    data[stop - 1] = MARK
    last = stop[first + items - 1]
    data[last - 1] = END
    return data, np.concatenate((np.zeros(1, np.int64), last))


def strings(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each place's byte (low) and the ``order`` bytes before it, as one number."""
    n = np.diff(offsets)
    to = np.arange(len(data)) + np.repeat(np.arange(1, len(n) + 1) * order, n)
    wide = np.full(len(data) + order * len(n), END, np.uint64)
    wide[to] = data
    code = wide[to]
    for j in range(1, order + 1):
        code |= wide[to - j] << np.uint64(8 * j)
    return code


def _count(order: int, most: int = 1 << 20):
    """Rows doc_id, text, held_out -> strings and how often training has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            learn = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for s in slices(batch.column(1), most=1 << 21):
                data, offsets = laid_out(s)
                code = strings(data, offsets, order)
                mine = np.repeat(learn[s.first : s.first + len(s)], np.diff(offsets))
                code = code << np.uint64(1) | mine
                code.sort()
                string = code >> np.uint64(1)
                new = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1])))
                n = np.add.reduceat((code & np.uint64(1)).astype(np.int64), new)
                codes, counts = _merged(np.concatenate((codes, string[new])), np.concatenate((counts, n)))
                if len(codes) >= most:
                    yield pa.record_batch([pa.array(codes.view(np.int64)), pa.array(counts)], ["code", "n"])
                    codes, counts = codes[:0], counts[:0]
        if len(codes):
            yield pa.record_batch([pa.array(codes.view(np.int64)), pa.array(counts)], ["code", "n"])

    return run


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, sorted, with the sum of its counts."""
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by]
    new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[new], np.add.reduceat(counts, new) if len(new) else counts


def _of_order(code: np.ndarray, k: int) -> np.ndarray:
    """The order, and of each string the last k bytes before its last one."""
    return code & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64(k << 56)


class Trie:
    """Counts of (context, byte) of several orders, as sorted arrays."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes, self.counts = codes, counts.astype(np.float64)
        context = self.codes >> np.uint64(8)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.order_of = (self.contexts >> np.uint64(48)).astype(np.int64)
        self.context_of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.concatenate((first, [len(context)]))))
        self.n = np.bincount(self.context_of, weights=self.counts, minlength=len(first))
        self.d = np.bincount(self.context_of, minlength=len(first)).astype(float)
        # what a context's bytes amount to in the next shorter context
        k = self.codes >> np.uint64(56)
        shorter = np.where(k > 0, self.codes & ((np.uint64(1) << np.uint64(8) * k) - np.uint64(1)) | (k - np.uint64(1)) << np.uint64(56), np.uint64(0))
        found, pair = self._find(self.codes, shorter)
        self.excluded = np.bincount(self.context_of, weights=np.where((k > 0) & found, self.counts[pair] if len(pair) else 0, 0), minlength=len(first))
        self.novel, self.total = np.zeros(_CLASSES), np.zeros(_CLASSES)

    def leave_out(self, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """By class, of contexts of these orders: training bytes that the rest of their context has not, and all."""
        novel, total = np.zeros(_CLASSES), np.zeros(_CLASSES)
        once = np.bincount(self.context_of, weights=self.counts == 1, minlength=len(self.n))
        some = (self.n > 1) & (self.order_of >= least) & (self.order_of <= most)
        new, old = self._class(self.order_of, self.n - 1, self.d - 1), self._class(self.order_of, self.n - 1, self.d)
        for at, seen, w in ((new, novel, once), (new, total, once), (old, total, self.n - once)):
            np.add.at(seen, at[some], w[some])
        return novel, total

    @staticmethod
    def _class(order: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
        """A number for the order and the sizes of n and d in steps of a half and a third of an octave."""
        a = np.minimum((2 * np.log2(np.maximum(n, 1))).astype(np.int64), 39)
        b = np.minimum((3 * np.log2(np.maximum(d, 1))).astype(np.int64), 23)
        return (np.asarray(order) * 40 + a) * 24 + b

    def escape(self, order, n: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The probability that a context with n bytes seen, d of them different, meets another one."""
        at = self._class(order, n, d)
        return (self.novel[at] + _PRIOR * d / np.maximum(n + d, 1)) / (self.total[at] + _PRIOR)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return table[at] == keys, at

    def costs(self, code: np.ndarray, order: int) -> np.ndarray:
        """log10 of the probability of each string's last byte after the others."""
        above = np.full(len(code), -1)  # the context escaped from
        logp = np.zeros(len(code))
        rest = np.arange(len(code))
        for k in range(order, -1, -1):
            own = _of_order(code[rest], k)
            hit, pair = self._find(self.codes, own)
            known, node = hit.copy(), np.zeros(len(rest), np.int64)
            node[hit] = self.context_of[pair[hit]]
            miss = np.flatnonzero(~hit)
            known[miss], node[miss] = self._find(self.contexts, own[miss] >> np.uint64(8))
            go, node, hit, pair = rest[known], node[known], hit[known], pair[known]
            up = above[go]
            n = self.n[node] - np.where(up >= 0, self.excluded[up], 0) if len(go) else np.zeros(0)
            d = self.d[node] - np.where(up >= 0, self.d[up], 0) if len(go) else np.zeros(0)
            some = d > 0
            e = self.escape(k, n, d)
            logp[go[some & hit]] += np.log10((1 - e[some & hit]) * self.counts[pair[some & hit]] / n[some & hit])
            logp[go[some & ~hit]] += np.log10(e[some & ~hit])
            above[go[~hit]] = node[~hit]
            done = np.zeros(len(code), bool)
            done[go[hit]] = True
            rest = rest[~done[rest]]
        # none has seen it: all bytes that are not excluded are alike
        up = above[rest]
        logp[rest] -= np.log10(np.maximum(257 - np.where(up >= 0, self.d[up] if len(self.d) else 0, 0), 1))
        return logp


def string_costs(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, cost): log10 of the probability of the last byte of every string in ``rows`` (doc_id, text, held_out), learned from those not held out."""
    if not 3 <= order <= 6:
        raise ValueError("the order is from 3 to 6")
    counts = cut(rows.mapInArrow(_count(order), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "strings")
    many = counts.count()
    short = counts.where("n > 0").groupBy(F.col("code").bitwiseAND((1 << 24) - 1).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    code, n = short.column("code").to_numpy().view(np.uint64), short.column("n").to_numpy()
    levels = [_merged(_of_order(code, k), n) for k in range(3)]
    low, low_n = (np.concatenate(x) for x in zip(*levels, strict=True))
    parts = max(1, -(-many // PART_STRINGS))
    # contexts with the same last three bytes stay together
    dealt = counts.withColumn("part", F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND((1 << 24) - 1)), F.lit(parts)).cast("int"))

    def trie(t: pa.Table) -> tuple[Trie, np.ndarray]:
        code, n = t.column("code").to_numpy().view(np.uint64), t.column("n").to_numpy()
        seen, own = code[n > 0], n[n > 0]
        levels = [_merged(_of_order(seen, k), own) for k in range(3, order + 1)]
        return Trie(np.concatenate((low, *(c for c, _ in levels))), np.concatenate((low_n, *(m for _, m in levels)))), code

    def left_out(t: pa.Table) -> pa.Table:
        novel, total = trie(t)[0].leave_out(3, order)
        at = np.flatnonzero(total)
        return pa.table({"class": pa.array(at.astype(np.int32)), "novel": pa.array(novel[at]), "total": pa.array(total[at])})

    classes = dealt.groupBy("part").applyInArrow(left_out, "class int, novel double, total double").groupBy("class").agg(F.sum("novel").alias("novel"), F.sum("total").alias("total")).toArrow()
    novel, total = Trie(low, low_n).leave_out(0, 2)
    at = classes.column("class").to_numpy()
    novel[at] += classes.column("novel").to_numpy()
    total[at] += classes.column("total").to_numpy()

    def cost(t: pa.Table) -> pa.Table:
        own, code = trie(t)
        own.novel, own.total = novel, total
        return pa.table({"code": pa.array(code.view(np.int64)), "cost": pa.array(own.costs(code, order))})

    return cut(dealt.groupBy("part").applyInArrow(cost, "code long, cost double"), "costs")


class Lookup:
    """Costs by string in an open table of twice as many slots or more; 0 for a string that it does not have."""

    def __init__(self, codes: np.ndarray, costs: np.ndarray) -> None:
        self.bits = max(4, (2 * len(codes)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64).view(np.uint64), np.zeros(1 << self.bits)
        self.probes = 0
        rest = np.arange(len(codes))
        while len(rest):
            slot = self._slot(codes[rest], self.probes)
            free = self.keys[slot] == ~np.uint64(0)
            self.keys[slot[free]] = codes[rest[free]]
            won = self.keys[slot] == codes[rest]
            self.values[slot[won]] = costs[rest[won]]
            rest = rest[~won]
            self.probes += 1

    def _slot(self, codes: np.ndarray, probe: int) -> np.ndarray:
        return ((codes + np.uint64(probe << 57)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        rest = np.arange(len(codes))
        for probe in range(self.probes):
            slot = self._slot(codes[rest], probe)
            key = self.keys[slot]
            hit = key == codes[rest]
            out[rest[hit]] = self.values[slot[hit]]
            rest = rest[~hit & (key != ~np.uint64(0))]
            if not len(rest):
                break
        return out


_tables: dict[int, Lookup] = {}


def _lookup(key: int, sent) -> Lookup:  # noqa: ANN001
    """The table of a broadcast, once in each Python worker."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = Lookup(*sent.value)
    return _tables[key]


def _summed(rows: DataFrame, costs: DataFrame, order: int, most: int) -> DataFrame:
    """(doc_id, digest, score) of each different row: the costs of its strings, in as many passes as their number asks for."""
    passes = max(1, -(-costs.count() // most))
    out = None
    for i in range(passes):
        some = costs.where(F.pmod(F.xxhash64("code"), F.lit(passes)) == i).toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((some.column("code").to_numpy().view(np.uint64), some.column("cost").to_numpy()))
        key = hash(uuid.uuid4())

        def run(batches: Iterator[pa.RecordBatch], key: int = key, sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            table = _lookup(key, sent)
            for b in batches:
                got = np.zeros(b.num_rows)
                for s in slices(b.column(1)):
                    data, offsets = laid_out(s)
                    got[s.first : s.first + len(s)] = np.add.reduceat(table(strings(data, offsets, order)), offsets[:-1])
                yield pa.record_batch([b.column(0), b.column(3), pa.array(got)], ["doc_id", "digest", "score"])

        one = rows.mapInArrow(run, "doc_id long, digest long, score double").groupBy("doc_id", "digest").agg(F.min("score").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out if passes == 1 else out.groupBy("doc_id", "digest").agg(F.sum("score").alias("score"))


def score(docs: DataFrame, held_out, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_SENT) -> DataFrame:
    """Score every whole text by models of those that are not ``held_out`` (a Boolean column).

    Tokens are lower-cased words and one end per document. Gives doc_id, held_out, n_tokens, n_known
    (tokens that training has), train_tokens, base_score (log10 probability by single tokens with
    0.5 added to each count) and score (by the trie). A null or empty text has its end alone. Rows
    that repeat are scored each, and learned from each; an empty table gives no rows; a null
    ``held_out`` counts as true; other columns are ignored. ``most`` costs of strings are sent to the
    executors at once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("digest"))
    bags = cut(rows.mapInArrow(_bags, _ROWS), "bags")
    words = bags.where("word is not null").groupBy("word").agg(F.sum("train").alias("c"), F.collect_list(F.struct("part", "number")).alias("places"))
    words = cut(words, "words")
    n, v = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known = words.select("c", F.explode("places").alias("p")).select("p.part", "p.number", "c")
    base_of = np.log10(n + 0.5 * (v + 1))

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        c = np.zeros(len(number), np.int64)
        c[number] = right.column("c").to_numpy()
        base = np.log10(c + 0.5) - base_of
        known, b = [], []
        for bag in left.column("bag").to_pylist():
            at, tf = _unbag(bag)
            known.append(int(tf[c[at] > 0].sum()))
            b.append(float((tf * base[at]).sum()))
        return pa.table([*(left.column(x) for x in ("doc_id", "digest", "held_out", "n_tokens")), pa.array(known, pa.int64()), pa.array(np.full(len(known), n, np.int64)), pa.array(b, pa.float64())],
                        names=["doc_id", "digest", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"])

    texts = bags.where("bag is not null").select("part", "doc_id", "digest", "held_out", "n_tokens", "bag")
    based = texts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(add_up, "doc_id long, digest long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double")
    scored = _summed(rows, string_costs(rows.select("doc_id", "text", "held_out"), order), order, most).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "score")
    out = based.join(scored, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
