"""SentencePiece BPE encoding by backtracking, and decoding.

A sequence of tokens is what merging would give exactly when merging each adjacent pair's text
alone gives that pair back. So the encoder walks left to right: it takes the longest token that
starts at a position (Aho-Corasick trie), checks it against the token before it by re-merging the
two, falls back to the next shorter token, and where none is left marks the position in a bitfield
of failed positions and steps back. Every position fails once at most, so the time is linear in
the text. Spans that no merge can cross (before a space mark, around characters without a piece)
are encoded by themselves and remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_REMEMBERED, _REMEMBERED_CHARS = 150_000, 64
_UNKNOWN_SURFACE = " ⁇ "


class _Spans(dict):
    """Span -> its ids as bytes; when it is full, the spans asked for again are taken over from the older half."""

    def __init__(self, encode) -> None:
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, span: str) -> bytes:
        ids = self.old.get(span)
        if ids is None:
            ids = self.encode(span)
        if len(span) <= _REMEMBERED_CHARS:
            if len(self) >= _REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[span] = ids
        return ids


class PieceModel:
    """A SentencePiece model of type BPE with an identity normaliser."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and an identity normaliser are handled")
        self.dummy_prefix = spec.add_dummy_prefix
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.surface: list[str] = []
        self.control: set[int] = set()
        self.byte_of: dict[int, int] = {}
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.id[p.piece], self.score[p.piece] = i, p.score
                self.surface.append(p.piece.replace(SPACE, " "))
            elif p.type == kinds.BYTE:
                self.byte_of[i] = int(p.piece[3:5], 16)
                self.surface.append(chr(self.byte_of[i]) if self.byte_of[i] < 128 else "")
            elif p.type in (kinds.CONTROL, kinds.UNKNOWN):
                self.surface.append("" if p.type == kinds.CONTROL else _UNKNOWN_SURFACE)
                if p.type == kinds.CONTROL:
                    self.control.add(i)
            else:
                raise ValueError(f"piece {p.piece!r}: user-defined and unused pieces are not handled")
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.high_bytes = np.array(sorted(i for i, b in self.byte_of.items() if b >= 128), np.uint32)
        self.trie = ahocorasick.Automaton()
        reachable = [p for p in self.score if self.merged(p) == [p]]
        for p in reachable:
            self.trie.add_word(p, len(p))
        self.trie.make_automaton()
        known = self.known = set(reachable)
        self.reach = max(map(len, known))
        self.text = {self.id[p]: p for p in reachable}
        self.size = {i: len(p) for i, p in self.text.items()}
        # the longest token that begins each path of the trie, and the next shorter one of each token
        self.best: dict[str, int] = {}
        for p in sorted(reachable, key=len):
            for n in range(1, len(p) + 1):
                if p[:n] not in self.best:
                    self.best[p[:n]] = self.id[p[:n]] if p[:n] in known else self.best[p[: n - 1]]
        self.shorter = {self.id[p]: self.best[p[:-1]] if len(p) > 1 else -1 for p in reachable}
        self._fits: dict[int, bool] = {}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            self.spans = None
        else:
            # a line feed that no piece holds is a barrier too
            stop = "" if any("\n" in p for p in self.score) else "\n"
            self.spans = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|{stop}" if stop else ""))
        self.beside = {p[i : i + 2] for p in known for i in range(len(p) - 1)}
        self.cache = _Spans(self._encode_span)
        self.runs = _Spans(self._encode_run)

    def merged(self, text: str) -> list[str]:
        """Merge from characters: always the pair with the best score, the leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of two tokens gives these two tokens."""
        key = a << 32 | b
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            x, y = self.text[a], self.text[b]
            found = self._fits[key] = self.merged(x + y) == [x, y]
        return found

    def backtrack(self, text: str) -> list[int]:
        """Tokens of a text whose characters all have pieces."""
        longest, best, shorter, size, seen, reach = self.trie.longest_prefix, self.best, self.shorter, self.size, self._fits, self.reach
        tokens: list[int] = []
        at, n, last = 0, len(text), -1
        # as long as no position has failed, the bitfield is all clear and need not be asked
        while at < n:
            token = best[text[at : at + longest(text[at : at + reach])]]
            if last >= 0:
                while token >= 0:
                    ok = seen.get(last << 32 | token)
                    if ok or ok is None and self.fits(last, token):
                        break
                    token = shorter[token]
                else:
                    return self._stepping_back(text, tokens, at)
            tokens.append(token)
            at += size[token]
            last = token
        return tokens

    def _stepping_back(self, text: str, tokens: list[int], at: int) -> list[int]:
        """Go on from a position at which no token fits the one before it."""
        longest, best, shorter, size = self.trie.longest_prefix, self.best, self.shorter, self.size
        failed = bytearray(len(text) + 1)
        token = -1
        while True:
            # the position failed: take the last token back and try what is shorter
            failed[at] = 1
            if not tokens:
                raise ValueError("no tokens cover this text")
            token = tokens.pop()
            at -= size[token]
            while True:
                while token >= 0 and (failed[at + size[token]] or tokens and not self.fits(tokens[-1], token)):
                    token = shorter[token]
                if token < 0:
                    break
                tokens.append(token)
                at += size[token]
                if at == len(text):
                    return tokens
                token = best[text[at : at + longest(text[at : at + self.reach])]]

    def _encode_span(self, span: str) -> bytes:
        """Ids of a span, cut where no piece holds the two characters side by side: no merge crosses there."""
        beside, cuts = self.beside, [0]
        cuts += [i for i in range(1, len(span)) if span[i - 1 : i + 1] not in beside]
        if len(cuts) == 1:
            return self._encode_run(span)
        cuts.append(len(span))
        return b"".join([self.runs[span[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)])

    def _encode_run(self, run: str) -> bytes:
        if len(run) == 1 and run not in self.known:
            return np.array([self.byte_id[b] for b in run.encode()], "<u4").tobytes()
        t = self.backtrack(run)
        return struct.pack(f"<{len(t)}I", *t)

    def encode(self, text: str | None, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is the empty text."""
        ids = b""
        if text:
            marked = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
            spans = self.spans.findall(marked) if self.spans else [marked]
            ids = b"".join(map(self.cache.__getitem__, spans))
        if ends:
            ids = np.array([self.bos], "<u4").tobytes() + ids + np.array([self.eos], "<u4").tobytes()
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each, and one leading space mark goes."""
        a = np.frombuffer(ids, "<u4")
        if not len(a):
            return ""
        got = a.tolist()
        first = next((i for i in got if i not in self.control), None)
        strip = self.dummy_prefix and first is not None and first not in self.byte_of and self.surface[first].startswith(" ") and first in self._spaced
        if len(self.high_bytes) and np.isin(a, self.high_bytes).any():
            out, run = [], bytearray()
            for i in got:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                else:
                    if run:
                        out.append(_utf8(run))
                        run = bytearray()
                    out.append(self.surface[i])
            out.append(_utf8(run))
            text = "".join(out)
        else:
            text = "".join(map(self.surface.__getitem__, got))
        return text[1:] if strip else text

    @property
    def _spaced(self) -> set[int]:
        if not hasattr(self, "_spaced_ids"):
            self._spaced_ids = {i for p, i in self.id.items() if p.startswith(SPACE)}
        return self._spaced_ids


def _utf8(run: bytearray) -> str:
    """UTF-8 with each byte that belongs to no character as U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                c = bytes(run[i : i + n]).decode()
                if len(c) == 1:
                    out.append(c)
                    i += n
                    break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of a file, once in each Python worker."""
    return PieceModel(path)


def _texts(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about ``most`` bytes each."""
    i, n = 0, len(column)
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    while i < n:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield i, column.slice(i, j - i).to_pylist()
        i = j


def transcode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """(doc_id, ids binary, decoded string) per row: the ids of the whole text and the text they decode to.

    ids holds little-endian unsigned 32-bit integers. A null or empty text has the begin and end ids
    only and decodes to the empty text. Rows stay as they are in number: repeated ones give equal
    results, an empty table gives none, a null doc_id stays null. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i, texts in _texts(batch.column(1)):
                ids = [m.encode(t, ends) for t in texts]
                yield pa.record_batch(
                    [batch.column(0).slice(i, len(texts)), pa.array(ids, pa.binary()), pa.array([m.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
