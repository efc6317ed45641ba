"""Token counts of every prefix of a text, by dynamic programming over SentencePiece merges.

A prefix of a valid sequence of tokens is valid, and a text has one valid sequence. So the tokens
of the prefix that ends at a character are those of some shorter prefix and one token more: the
only token ending there that fits the last token of that shorter prefix. One step a character
gives the last token and the count of every prefix; what a budget or a truncation asks is then read
from the counts, and nothing is encoded again. Spans that no merge crosses have their own tables,
which are remembered; a text's table is their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, PieceModel, _Spans, _texts, model


class PrefixTable:
    """The counts of all prefixes of texts under one model."""

    def __init__(self, pieces: PieceModel) -> None:
        self.pieces = pieces
        self.spans = _Spans(self._span)
        # the pieces that end at a character, each with its length and id
        self.ends = ahocorasick.Automaton()
        for p in pieces.known:
            self.ends.add_word(p, (len(p), pieces.id[p]))
        self.ends.make_automaton()

    def _run(self, run: str, out: list[int]) -> None:
        """Append what each character adds to the count of a run whose characters all have pieces; it can be less than nothing."""
        m = self.pieces
        fits, seen = m.fits, m._fits
        last, count = [-1] * (len(run) + 1), [0] * (len(run) + 1)
        done = 0
        for end, (size, token) in self.ends.iter(run):
            if end < done:  # its token is found already
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                pair = before << 32 | token
                ok = seen.get(pair)
                if not (fits(before, token) if ok is None else ok):
                    continue
            done = end + 1
            last[done], count[done] = token, count[start] + 1
            out.append(count[done] - count[end])
        if done != len(run):
            raise ValueError("no tokens cover this text")

    def _span(self, span: str) -> bytes:
        """What each character of a span adds, as little-endian signed 32-bit integers."""
        m, out, start = self.pieces, [], 0
        for i in range(1, len(span) + 1):
            if i < len(span) and span[i - 1 : i + 1] in m.beside:
                continue
            run = span[start:i]
            if len(run) == 1 and run not in m.known:
                out.append(len(run.encode()))
            else:
                self._run(run, out)
            start = i
        return np.array(out, "<i4").tobytes()

    def counts(self, text: str | None) -> np.ndarray:
        """Tokens of the first 0, 1, 2 ... characters of a text; null is the empty text."""
        m = self.pieces
        if not text:
            return np.zeros(1, np.int32)
        marked = (SPACE if m.dummy_prefix else "") + text.replace(" ", SPACE)
        steps = np.frombuffer(b"".join(map(self.spans.__getitem__, m.spans.findall(marked) if m.spans else [marked])), "<i4")
        out = np.cumsum(steps, dtype=np.int32)
        # the mark before the text belongs to every prefix but the empty one
        if m.dummy_prefix:
            out[0] = 0
            return out
        return np.concatenate((np.zeros(1, np.int32), out))


@lru_cache(maxsize=2)
def table(path: str) -> PrefixTable:
    """The tables of a model file, once in each Python worker."""
    return PrefixTable(model(path))


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The longest prefix (in characters) of at most ``budget`` tokens; counts can fall, so a longer prefix may fit where a shorter one does not."""
    if counts[-1] <= budget:
        return len(counts) - 1
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts array<int>) per row: element i is the exact number of tokens of the first i characters.

    The table to keep where budgets are asked for later: ``tokens_of`` and ``within_budget`` read it. A null or empty text has
    the counts [0]. Rows stay as they are in number: repeated ones give equal results, an empty
    table gives none, a null doc_id stays null. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for batch in batches:
            for i, texts in _texts(batch.column(1), 1 << 19):
                found = [t.counts(x) for x in texts]
                offsets = np.cumsum([0] + [len(x) for x in found], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.record_batch([batch.column(0).slice(i, len(texts)), lists], ["doc_id", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, counts array<int>")


def tokens_of(n_chars: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first ``n_chars`` characters by a table of prefixes; of the whole text where it is shorter."""
    at = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(counts) - 1)
    return F.get(F.col(counts), F.greatest(at, F.lit(0)).cast("int"))


def within_budget(budget: Column | int, counts: str = "counts") -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens by a table of prefixes."""
    return F.array_max(F.filter(F.transform(F.col(counts), lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull()))


def measure(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_chars) per row, read from the table of its prefixes inside the task.

    cut_chars: characters of the longest prefix of at most ``budget`` tokens, the whole text where
    it is not over the limit. A null or empty text has zeros. Rows stay as they are in number, as
    with ``prefix_counts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for batch in batches:
            for i, texts in _texts(batch.column(1)):
                rows = []
                for text in texts:
                    counts = t.counts(text)
                    rows.append((len(text.encode()) if text else 0, int(counts[-1]), longest_within(counts, budget)))
                n_bytes, n_tokens, chars = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.record_batch([batch.column(0).slice(i, len(texts)), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > budget), pa.array(chars)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
