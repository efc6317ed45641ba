"""Unicode normal forms as Column expressions, from tables that Unicode's own rules give.

A character that another one stands for is translated; one that stands for several is looked up
where a text has such a one; and marks are put back on the characters before them, pair by pair.
What is plain ASCII is left as it is. Hangul in single letters is not composed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with forms of their own are below this one; Hangul syllables are composed by rule and stay.
_LAST, _HANGUL = 0x30000, range(0xAC00, 0xD7A4)
#: The combining marks that folding drops.
MARKS = (0x0300, 0x036F)


def _bare(text: str) -> str:
    return "".join(c for c in text if not MARKS[0] <= ord(c) <= MARKS[1])


def _kept(form: str) -> Callable[[str], str]:
    return lambda c: unicodedata.normalize(form, c)


def _without_marks(form: str) -> Callable[[str], str]:
    return lambda c: unicodedata.normalize("NFC", _bare(unicodedata.normalize(form, c)))


@lru_cache(maxsize=4)
def _tables(form: str, marks: bool) -> tuple[str, str, dict[str, str]]:
    """(characters, what each becomes, those that become several); what becomes nothing stands last, without a counterpart."""
    rule = _kept(form) if marks else _without_marks(form)
    one, gone, many = [], [], {}
    for code in range(0x80, _LAST):
        if code in _HANGUL or 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        to = rule(c)
        if to == c:
            continue
        if not to:
            gone.append(c)
        elif len(to) == 1:
            one.append((c, to))
        else:
            many[c] = to
    return "".join(a for a, _ in one) + "".join(gone), "".join(b for _, b in one), many


@lru_cache(maxsize=2)
def _pairs(marks: bool) -> dict[str, str]:
    """Character and mark -> the character that holds both."""
    out = {}
    for code in range(0x80, _LAST):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            a, b = (chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", a + b) == chr(code) and (marks or not MARKS[0] <= ord(b) <= MARKS[1]):
                out[a + b] = chr(code)
    return out


def _class(chars: str) -> str:
    """A pattern for one of some characters, as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, set(chars))):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _form(text: Column, form: str, marks: bool) -> Column:
    source, target, many = _tables(form, marks)
    pairs = _pairs(marks)
    several, second = _class("".join(many)), _class("".join(p[1] for p in pairs))

    def has(x: Column, pattern: str, chars: list[str]) -> Column:
        """Whether a text has one of the characters; most texts have none that lies as far up as the first of them."""
        return x.rlike(f"[\\x{{{ord(min(chars)):x}}}-\\x{{10ffff}}]") & x.rlike(pattern)

    held = F.create_map(*[x for k, v in many.items() for x in (F.lit(k), F.lit(v))])
    joined = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])

    def widened(t: Column) -> Column:
        wide = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.when(c.rlike(several), F.try_element_at(held, c)), c)), "")
        return F.when(has(t, several, list(many)), wide).otherwise(t)

    def put(done: Column, c: Column) -> Column:
        last = F.right(done, F.lit(1))
        both = F.when(c.rlike(second), F.try_element_at(joined, F.concat(last, c)))
        return F.when(both.isNotNull(), F.concat(F.left(done, F.length(done) - 1), both)).otherwise(F.concat(done, c))

    def composed(t: Column) -> Column:
        return F.when(has(t, second, [p[1] for p in pairs]), F.aggregate(F.split(t, ""), F.lit(""), put)).otherwise(t)

    return F.when(text.rlike(r"[^\x00-\x7F]"), bound(bound(F.translate(text, source, target), widened), composed)).otherwise(text)


def folded(text: Column) -> Column:
    """NFKD without the marks U+0300 to U+036F, composed again: accents go, other marks stay on their characters."""
    return _form(text, "NFKD", marks=False)


def unaccented(text: Column) -> Column:
    """NFD without the marks U+0300 to U+036F, composed again; compatible forms stay."""
    return _form(text, "NFD", marks=False)


def compatible(text: Column) -> Column:
    """NFKC."""
    return _form(text, "NFKC", marks=True)
