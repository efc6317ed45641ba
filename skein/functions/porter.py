"""The Porter stemmer as Column expressions, a step at a time over arrays of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of consonants and a run of vowels, where y is a vowel after a consonant; a word's first y is no vowel, and is written Y meanwhile.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURED, ONCE, TWICE = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxyY]$"
#: The published endings of the second, third and fourth step, and what becomes of them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words that are stemmed: these many letters of a to z.
LEAST, MOST = 3, 64


def _is(word: Column, pattern: str) -> Column:
    return word.rlike(pattern)


def _without(word: Column, ending: str) -> Column:
    return F.regexp_replace(word, f"(?:{ending})$", "")


def _replaced(endings: dict[str, str]) -> Callable[[Column], Column]:
    pattern = "^(.+?)(" + "|".join(endings) + ")$"
    to = F.create_map(*[x for k, v in endings.items() for x in (F.lit(k), F.lit(v))])

    def step(w: Column) -> Column:
        stem = F.regexp_extract(w, pattern, 1)
        return F.when(_is(w, pattern) & _is(stem, MEASURED), F.concat(stem, F.try_element_at(to, F.regexp_extract(w, pattern, 2)))).otherwise(w)

    return step


def _plural(w: Column) -> Column:
    return F.when(w.endswith("s"), F.when(_is(w, "^.+(?:ss|i)es$"), _without(w, "es")).when(_is(w, "^.+[^s]s$"), _without(w, "s")).otherwise(w)).otherwise(w)


def _past(w: Column) -> Column:
    """Endings in eed, ed and ing; what is to be mended afterwards gets a mark at its end."""
    eed = F.when(_is(_without(w, "eed"), MEASURED), _without(w, "d")).otherwise(w)
    cut = _without(w, "ed|ing")
    return F.when(_is(w, "^.+eed$"), eed).when(_is(w, "^.+(?:ed|ing)$"), F.when(_is(cut, VOWEL), F.concat(cut, F.lit("!"))).otherwise(w)).otherwise(w)


def _mended(w: Column) -> Column:
    bare = _without(w, "!")
    out = F.when(_is(bare, "(?:at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(_is(bare, r"([^aeiouylsz])\1$"), F.substring(bare, F.lit(1), F.length(bare) - 1)).when(_is(bare, SHORT), F.concat(bare, F.lit("e")))
    return F.when(w.endswith("!"), F.coalesce(out, bare)).otherwise(w)


def _y(w: Column) -> Column:
    return F.when(w.endswith("y") & _is(_without(w, "y"), VOWEL), F.concat(_without(w, "y"), F.lit("i"))).otherwise(w)


def _suffix(w: Column) -> Column:
    plain, ion = "^(.+?)(?:" + "|".join(FOURTH) + ")$", "^(.+?[st])ion$"
    one, two = F.regexp_extract(w, plain, 1), F.regexp_extract(w, ion, 1)
    return F.when(_is(w, plain), F.when(_is(one, TWICE), one).otherwise(w)).when(_is(w, ion) & _is(two, TWICE), two).otherwise(w)


def _e(w: Column) -> Column:
    bare = _without(w, "e")
    return F.when(_is(w, "^.+e$") & (_is(bare, TWICE) | (_is(bare, ONCE) & ~_is(bare, SHORT))), bare).otherwise(w)


def _ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & _is(w, TWICE), _without(w, "l")).otherwise(w)


def stems(words: Column) -> Column:
    """The stems of an array of words in lower case; words of other letters or of one or two stay as they are."""
    out = F.transform(words, lambda w: F.regexp_replace(w, "^y", "Y"))
    for step in (_plural, _past, _mended, _y, _replaced(SECOND), _replaced(THIRD), _suffix, _e, _ll):
        out = F.transform(out, step)
    fits = lambda w: w.rlike(f"^[a-z]{{{LEAST},{MOST}}}$")
    return F.zip_with(words, out, lambda w, s: F.when(fits(w), F.regexp_replace(s, "^Y", "y")).otherwise(w))


def sql(source: str) -> str:
    """CTEs of DuckDB that end in ``stems (term, stem)`` over a relation of distinct terms, for oracles."""
    m = lambda x, p: f"regexp_matches({x}, '{p}')"
    cut = lambda x, p: f"regexp_replace({x}, '(?:{p})$', '')"

    def mapped(endings: dict[str, str]) -> str:
        pattern = "^(.+?)(" + "|".join(endings) + ")$"
        to = "case regexp_extract(w, '{}', 2) {} end".format(pattern, " ".join(f"when '{k}' then '{v}'" for k, v in endings.items()))
        return f"case when {m('w', pattern)} and {m(f'regexp_extract(w, {chr(39)}{pattern}{chr(39)}, 1)', MEASURED)} then regexp_extract(w, '{pattern}', 1) || {to} else w end"

    bare, four, ion = cut("w", "!"), "^(.+?)(?:" + "|".join(FOURTH) + ")$", "^(.+?[st])ion$"
    doubled = "|".join(f"{c}{c}" for c in "bcdfghjkmnpqrtvwx")
    steps = [
        f"case when {m('w', '^.+(?:ss|i)es$')} then {cut('w', 'es')} when {m('w', '^.+[^s]s$')} then {cut('w', 's')} else w end",
        f"case when {m('w', '^.+eed$')} then case when {m(cut('w', 'eed'), MEASURED)} then {cut('w', 'd')} else w end when {m('w', '^.+(?:ed|ing)$')} and {m(cut('w', 'ed|ing'), VOWEL)} then {cut('w', 'ed|ing')} || '!' else w end",
        f"case when w not like '%!' then w when {m(bare, '(?:at|bl|iz)$')} then {bare} || 'e' when {m(bare, f'(?:{doubled})$')} then left({bare}, -1) when {m(bare, SHORT)} then {bare} || 'e' else {bare} end",
        f"case when w like '%y' and {m(cut('w', 'y'), VOWEL)} then {cut('w', 'y')} || 'i' else w end",
        mapped(SECOND),
        mapped(THIRD),
        f"case when {m('w', four)} then case when {m(f'regexp_extract(w, {chr(39)}{four}{chr(39)}, 1)', TWICE)} then regexp_extract(w, '{four}', 1) else w end when {m('w', ion)} and {m(f'regexp_extract(w, {chr(39)}{ion}{chr(39)}, 1)', TWICE)} then regexp_extract(w, '{ion}', 1) else w end",
        f"case when w like '_%e' and ({m(cut('w', 'e'), TWICE)} or ({m(cut('w', 'e'), ONCE)} and not {m(cut('w', 'e'), SHORT)})) then {cut('w', 'e')} else w end",
        f"case when w like '%ll' and {m('w', TWICE)} then {cut('w', 'l')} else w end",
    ]
    out = f"porter0 as (select distinct term, regexp_replace(term, '^y', 'Y') as w from {source} where regexp_matches(term, '^[a-z]{{{LEAST},{MOST}}}$'))"
    for i, step in enumerate(steps):
        out += f", porter{i + 1} as (select term, {step} as w from porter{i})"
    return out + f", stems as (select term, regexp_replace(w, '^Y', 'y') as stem from porter{len(steps)})"
