"""Phrases that occur more often together than their parts, by suffix automata of shards.

A shard is a slice of texts. Its generalised suffix automaton is cut off at the longest phrase and
built level by level: the substrings of m words that end at each place are numbered by their
transition (the number of the m - 1 words before, the last word), so equal substrings meet in one number
whose places are its endpos set. The suffix link of a substring leads to it without its first word;
where both have the same count they have the same endpos set and are one state. A shard hands out
one row a state, its longest substring and the length of its shortest; Spark
unfolds them, adds the counts of all shards and does the rest as joins.

Most substrings are rare, and what has a rare part is rare. So a first pass counts hashes of words, a second one
hashes of pairs of frequent words and a third one hashes of three words of which both pairs are frequent; what is
frequent in all shards together is set in a bitmap of fixed size, and the last pass leaves out what has a part that
is not set. A shard may have a frequent word in no frequent pair, so each shard hands out its frequent words too. Hashes
that share a bit let more through and lose nothing. A task sends its hashes in blocks, sorted, as the steps from one to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .textops import Slice, mix, slices

LONGEST, LEAST = 4, 30
#: Bits of a bitmap of what is frequent: 8 MB, however much there is; the fuller it is, the less it spares.
BITS = 1 << 26
#: Bits of a hash that are counted, of which the first ones (all but 32) say its range; hashes that a task holds before it sends them.
HASH_BITS, HELD = 44, 2_000_000
#: Bytes of text in a shard, as far as whole texts allow.
SHARD_BYTES = 4 << 20
#: Parts in which a language's phrases are ranked before they meet.
_PARTS = 64

_APART = np.zeros(256, bool)
_APART[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_APART
_SOLID[[0x20, 0x09]] = False
_LEFT, _RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Phrases(Slice):
    """A slice whose words are what white space, line ends and punctuation leave; the latter two also end a piece."""

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        solid = np.zeros(len(self.data) + 1, bool)
        solid[:-1] = _SOLID[self.data]
        # a text's first byte begins a word if it is part of one
        first = np.zeros(len(solid), bool)
        first[self.offsets] = True
        starts = np.flatnonzero(solid[:-1] & (first[:-1] | ~np.concatenate(([False], solid[:-2]))))
        ends = np.flatnonzero(solid[:-1] & (first[1:] | ~solid[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    @cached_property
    def begins(self) -> np.ndarray:
        """Whether each word is the first of its piece."""
        starts, _, ranges = self._bounds
        apart = np.concatenate(([0], np.cumsum(_APART[self.data])))[starts]
        out = np.ones(len(starts), bool)
        out[1:] = apart[1:] != apart[:-1]
        firsts = ranges[:-1]
        out[firsts[firsts < len(out)]] = True
        return out

    @cached_property
    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with a space after each, and where each one begins."""
        starts, ends, _ = self._bounds
        sizes = ends - starts + 1
        at = np.concatenate(([0], np.cumsum(sizes)))
        take = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
        out = self.bytes_[np.minimum(take, max(len(self.data) - 1, 0))] if at[-1] else np.zeros(0, np.uint8)
        out[at[1:] - 1] = 0x20
        return out.tobytes(), at


def gram_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """A hash of each word and the m - 1 before it; of the first words nothing that counts."""
    out = words
    for _ in range(1, m):
        more = np.zeros(len(words), np.uint64)
        more[1:] = mix(out[:-1] * _LEFT + words[1:] * _RIGHT)
        out = more
    return out


class Automaton:
    """The suffix automaton of runs of words, of substrings of ``depth`` words at most.

    ``ids[m][i]`` numbers the substring of m + 1 words that ends at word i (-1: none, or left out),
    ``counts[m]`` has the sizes of endpos sets, ``ends[m]`` an end of each and ``links[m]`` the
    number of its longest proper suffix. ``keep[m]`` says which substrings of m words, by their ends, are not left out;
    of a word that is left out only the count is there.
    """

    def __init__(self, words: np.ndarray, begins: np.ndarray, depth: int, keep: dict[int, np.ndarray]) -> None:
        _, first, ids, count = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
        if 1 in keep:
            ids = np.where(keep[1], ids, -1)
        self.ids, self.counts, self.ends, self.links = [ids], [count], [first], [np.full(len(count), -1)]
        n = len(count)
        for m in range(2, depth + 1):
            below = self.ids[-1]
            here = ~begins & keep[m] if m in keep else ~begins
            at = np.flatnonzero(here[1:] & (below[:-1] >= 0) & (below[1:] >= 0)) + 1
            _, first, found, count = np.unique(below[at - 1] * n + ids[at], return_index=True, return_inverse=True, return_counts=True)
            level = np.full(len(words), -1)
            level[at] = found
            ends = at[first]
            self.ids.append(level)
            self.counts.append(count)
            self.ends.append(ends)
            self.links.append(below[ends])

    def states(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ends, counts, length of the shortest) of the states whose longest substring has 1, 2, ... words."""
        shortest = [np.ones(len(self.counts[0]), np.int32)]
        longest = [np.ones(len(c), bool) for c in self.counts]
        for m in range(1, len(self.counts)):
            link = self.links[m]
            same = self.counts[m] == self.counts[m - 1][link]
            longest[m - 1][link[same]] = False
            shortest.append(np.where(same, shortest[m - 1][link], m + 1).astype(np.int32))
        return [(e[k], c[k], s[k]) for e, c, s, k in zip(self.ends, self.counts, shortest, longest, strict=True)]


@lru_cache(maxsize=4096)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Phrases, list[str], np.ndarray, np.ndarray]]:
    """(texts, their languages, language of each word by its place among them, hashes of the words in their language)."""
    for batch in batches:
        for s in slices(batch.column(0), most=SHARD_BYTES):
            texts = Phrases(s.first, s.data, s.offsets, True)
            langs = pc.dictionary_encode(batch.column(1).slice(s.first, len(s)))
            names = langs.dictionary.to_pylist()
            of = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(texts.word_ranges))
            salts = np.array([_salt(x) for x in names], np.uint64)
            yield texts, names, of, mix(texts.word_hashes + salts[of])


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes >> np.uint64(64 - HASH_BITS) & np.uint64(len(bits) * 64 - 1)
    return ((bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)).astype(bool)


def kept(words: np.ndarray, frequent: dict[int, Callable[[], np.ndarray]]) -> dict[int, np.ndarray]:
    return {m: is_set(bits(), gram_hashes(words, m)) for m, bits in frequent.items()}


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def pack(keys: np.ndarray, counts: np.ndarray, most: int) -> Iterator[tuple[int, bytes]]:
    """(range, block) of sorted hashes: the bytes of their steps and counts, the first bytes of all first. Counts from ``most`` on are alike."""
    cuts = np.flatnonzero(np.diff(keys >> np.uint64(32))) + 1
    for part, n in zip(np.split(keys, cuts), np.split(np.minimum(counts, most), cuts), strict=True):
        steps = np.diff(part & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype("<u4")
        yield int(part[0] >> np.uint64(32)), steps.view(np.uint8).reshape(-1, 4).T.tobytes() + n.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in their range, and their counts."""
    planes = np.frombuffer(block, np.uint8).reshape(6, -1)
    return np.cumsum(planes[:4].T.copy().view("<u4").ravel().astype(np.uint64)), planes[4:].T.copy().view("<u2").ravel().astype(np.int64)


def _grams(m: int, frequent: dict[int, Callable[[], np.ndarray]], least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            rows = list(pack(*added(*map(np.concatenate, zip(*held, strict=True))), least))
            held.clear()
            for i in range(0, len(rows), 256):
                yield pa.record_batch([pa.array([r[0] for r in rows[i : i + 256]], pa.int32()), pa.array([r[1] for r in rows[i : i + 256]], pa.binary())], ["range", "block"])

        for texts, _, _, words in _shards(batches):
            if len(words) < m:
                continue
            a = Automaton(words, texts.begins, m, kept(words, frequent))
            if len(a.ends[-1]):
                held.append((gram_hashes(words, m)[a.ends[-1]] >> np.uint64(64 - HASH_BITS), a.counts[-1]))
            if sum(len(k) for k, _ in held) > HELD:
                yield from blocks()
        if held:
            yield from blocks()

    return run


def frequent_grams(texts: DataFrame, m: int, frequent: dict[int, Callable[[], np.ndarray]], least: int) -> Callable[[], np.ndarray]:
    """The bitmap of what has m words and occurs ``least`` times, sent to all executors. A range of hashes is added up in one task: it has the same share of all, however often one of them occurs."""

    def add(group: pa.Table) -> pa.Table:
        places, counts = (np.concatenate(x) for x in zip(*map(unpack, group["block"].to_pylist()), strict=True))
        places, counts = added(places, counts)
        spots = (np.uint64(group["range"][0].as_py()) << np.uint64(32) | places[counts >= least]) & np.uint64(BITS - 1)
        at, inverse = np.unique(spots >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(at), np.uint64)
        np.bitwise_or.at(bits, inverse, np.uint64(1) << (spots & np.uint64(63)))
        return pa.table([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])

    found = texts.mapInArrow(_grams(m, frequent, least), "range int, block binary").groupBy("range").applyInArrow(add, "at long, bits long")
    found = found.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(out)
    return lambda: sent.value


def _states(frequent: dict[int, Callable[[], np.ndarray]], longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, phrase, shortest, words, n): the states of a shard, and a row without a phrase with the number of words a language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, names, of, words in _shards(batches):
            if not len(words):
                continue
            a = Automaton(words, texts.begins, longest, kept(words, frequent))
            buffer, at = texts.joined
            langs = pa.array(names, pa.string())
            total = np.bincount(of, minlength=len(names))
            yield pa.record_batch([langs, pa.array([""] * len(names)), pa.array(np.ones(len(names), np.int32)), pa.array(np.ones(len(names), np.int32)), pa.array(total)], _STATE)
            for m, (ends, counts, shortest) in enumerate(a.states(), 1):
                if m == 1:
                    k = a.ids[0][ends] >= 0
                    ends, counts, shortest = ends[k], counts[k], shortest[k]
                for i in range(0, len(ends), 50_000):
                    e = ends[i : i + 50_000]
                    phrases = [buffer[x:y] for x, y in zip(at[e - m + 1].tolist(), (at[e + 1] - 1).tolist(), strict=True)]
                    yield pa.record_batch(
                        [langs.take(pa.array(of[e])), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(shortest[i : i + 50_000]), pa.array(np.full(len(e), m, np.int32)), pa.array(counts[i : i + 50_000])], _STATE)

    return run


_STATE = ["lang", "phrase", "shortest", "words", "n"]


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f): exact counts of the phrases of 1 to ``longest`` words that occur ``least`` times, and of all words as the phrase ``''``."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    if not 1 <= least <= 0xFFFF:
        raise ValueError("least is from 1 to 65535")
    frequent: dict[int, Callable[[], np.ndarray]] = {}
    for m in range(1, min(longest, 3) + 1):
        frequent = frequent | {m: frequent_grams(texts, m, frequent, least)}
    states = texts.mapInArrow(_states(frequent, longest), "lang string, phrase string, shortest int, words int, n long")
    # the members of a state are its longest substring without its first words
    member = F.explode(F.sequence("shortest", "words")).alias("left")
    members = states.select("lang", "phrase", "n", member).select("lang", F.expr("substring_index(phrase, ' ', -left)").alias("phrase"), "n")
    return members.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, most: int = 2000, least: int = LEAST, longest: int = LONGEST, scale: int = 2_000_000, subsumed: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs.
    A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is cut in two where
    floor(scale * a / (l + r)) is lowest, l and r being the counts of its parts, and has that score; of equal cuts the
    first counts. It goes if a longer such phrase has it and occurs in at least ``subsumed`` per cent of its places.
    By score, then a, then the phrase's bytes.

    Null and empty texts have no words; a null language is ``und`` and joins rows that say so;
    repeated rows count each time; an empty table gives none. Texts of any length are counted whole. Other columns are ignored.
    """
    counted = cut(phrase_counts(docs, least, longest, text_col, lang_col), "phrases")
    parts = counted.where("phrase <> ''")
    found = parts.withColumn("words", F.size(F.split("phrase", " "))).where("words > 1").withColumnRenamed("f", "a")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"cast({scale} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)"))
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    ks = range(1, longest)
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min("score").alias("score"), *[at(c, k).alias(f"{c}{k}") for c in ("score", "l", "r") for k in ks])
    lowest = lambda c: F.coalesce(*[F.when(F.col(f"score{k}") == F.col("score"), F.col(f"{c}{k}")) for k in ks])
    scored = scored.select("lang", "phrase", "a", lowest("l").alias("l"), lowest("r").alias("r"), "score")
    # the longest suffix and the longest prefix of a phrase are phrases too, and occur no less than what is longer: one step is enough
    step = F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - words)"), F.expr("substring_index(phrase, ' ', words - 1)")))
    longer = found.where("words > 2").select("lang", step.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))
    best = whole.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    words = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(table: str = "documents") -> str:
    """The query of op13 as DuckDB SQL."""
    return rf"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from {table}),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from t),
totals as (select lang, sum(len(w))::bigint as n from p group by 1),
g as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m, count(*) as f
    from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from p, (values (1), (2), (3), (4)) as s(m)) group by all having count(*) >= {LEAST}),
c as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from g where m > 1),
k as (select c.lang, c.phrase, c.m, c.a, k, l.f as l, r.f as r, ((2000000::hugeint * c.a) // (l.f + r.f))::bigint as score
    from (select *, unnest(range(1, m)) as k from c) c join g l on l.lang = c.lang and l.phrase = array_to_string(w[1:k], ' ') and l.m = k
    join g r on r.lang = c.lang and r.phrase = array_to_string(w[k + 1:], ' ') and r.m = c.m - k),
s as (select * from k qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, m, a, array_to_string(w[i:i + size - 1], ' ') as phrase
    from (select *, unnest(range(1, m - size + 2)) as i from c, (values (2), (3)) as z(size) where size < m)),
b as (select s.* from s where not exists (select 1 from i where i.lang = s.lang and i.phrase = s.phrase and 100 * i.a >= 80 * s.a)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r, n, score from o join totals using (lang) where rank <= 2000
"""
