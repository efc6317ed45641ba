"""Quality rules: a table of thresholds compiled into one projection of counts and ratios.

Everything is a Spark SQL expression: no user function runs. A ratio is compared as integers
(100 * part > percent * whole), so the same table gives the same verdict in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Common function words of the languages that are kept.
STOP_WORDS = (
    "the be to of and that have with is in it for on as was at by an this from are or not "
    "der die und das ist nicht ein eine zu den von mit auf dem im sich "
    "le la les de des et un une en du est que qui dans pour pas au par sur ou avec "
    "el los las y que se del una por con para su al lo es como"
).split()
_SPACES = " \t\n\x0b\x0c\r"

#: name, part, whole, least and most per cent of the whole (None: no bound). A text is kept if all hold.
THRESHOLDS: list[tuple[str, str, str, int | None, int | None]] = [
    ("word length", "word_chars", "n_words", 200, 1200),
    ("symbols to words", "n_symbols", "n_words", None, 20),
    ("stop words", "n_stop_words", "n_words", 2, None),
    ("words with a letter", "n_letter_words", "n_words", 70, None),
    ("capitals to letters", "n_capitals", "word_chars", None, 40),
    ("repeated lines", "n_dup_lines", "n_lines", None, 50),
    ("bullet lines", "n_bullet_lines", "n_lines", None, 90),
    ("ellipsis lines", "n_ellipsis_lines", "n_lines", None, 30),
]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per text; null counts as the empty text. Steps are separate projections so that no array is made twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    d = d.select(
        "doc_id",
        F.array_remove(F.split(F.translate("text", _SPACES, " " * len(_SPACES)), " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
    )
    d = d.withColumn("n_words", F.size("words").cast("long"))
    n = F.greatest((F.col("n_words") - 2).cast("int"), F.lit(0))
    two = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(two, F.slice("words", F.lit(3), n), lambda a, b: F.concat(a, F.lit(" "), b))
    d = d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.sort_array(F.transform(three, lambda g, i: F.struct(g.alias("g"), i.alias("i")))).alias("windows"),
    )
    # equal windows are neighbours now: one that equals the window before or after it is repeated
    same = F.filter("windows", lambda w, k: F.coalesce(F.get("windows", k + 1)["g"] == w["g"], F.lit(False)) | F.coalesce(F.get("windows", k - 1)["g"] == w["g"], F.lit(False)))
    d = d.withColumn("at", F.sort_array(F.transform(same, lambda w: w["i"])))
    # a repeated window covers three words, of which those before the next repeated one are counted
    steps = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("long")).drop("windows", "at")


def _broken(rule: tuple[str, str, str, int | None, int | None]) -> Column:
    _, part, whole, least, most = rule
    out = F.lit(False)
    if least is not None:
        out = out | (100 * F.col(part) < least * F.col(whole))
    if most is not None:
        out = out | (100 * F.col(part) > most * F.col(whole))
    return out


def assess(docs: DataFrame, thresholds: list = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text, base_failed, the names of the rules it breaks, and kept.

    base_failed: fewer than 50 words, or over half of the words in three-word windows found twice
    or more in the text. kept is false if base_failed, else true if no rule of the table is broken.
    A null or empty text has zero counts, so it fails the base and breaks no ratio. Repeated rows
    give equal results; an empty table gives none; a null doc_id stays; other columns are ignored.
    """
    d = counts(docs, id_col, text_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(_broken(r), F.lit(r[0])) for r in thresholds])) if thresholds else F.array().cast("array<string>")
    d = d.withColumn("base_failed", base).withColumn("broken", broken)
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def sql(thresholds: list = THRESHOLDS, table: str = "documents") -> str:
    """The query of op3 as DuckDB SQL."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = []
    for _, part, whole, least, most in thresholds:
        rules += [f"100 * {part} < {least} * {whole}"] * (least is not None) + [f"100 * {part} > {most} * {whole}"] * (most is not None)
    white = r"[\x20\x09-\x0D]"
    return f"""
with t as (select doc_id, coalesce(text, '') as text from {table}),
a as (select doc_id, regexp_extract_all(text, '{WORD}') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
    length(regexp_replace(text, '{white}', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals from t),
b as (select doc_id, word_chars, n_symbols, n_capitals, len(words) as n_words, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) as n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){white}*$'))) as n_ellipsis_lines,
    len(list_filter(words, lambda x: lower(x) in ({stops}))) as n_stop_words,
    len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}'))) as n_letter_words from a),
w as (select doc_id, unnest(range(1, greatest(len(words) - 1, 1))) as i, words from a),
g as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram from w),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, count(distinct i + k) as n_repeat_words from r, (values (0), (1), (2)) as s(k) group by doc_id),
f as (select b.*, coalesce(c.n_repeat_words, 0) as n_repeat_words from b left join c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words{"".join(f" or {r}" for r in rules)}) as kept from f
"""
