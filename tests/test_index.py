"""The stemmer on its published examples, and the stored index against counting texts one by one."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skein.functions.porter import stems
from skein.operators import index

#: Words and their stems as published with the algorithm.
EXAMPLES = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall "
    "hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ "
    "vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl "
    "triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust "
    "defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler "
    "probate probat rate rate cease ceas controll control roll roll yes ye youth youth a a is is été été r2d2 r2d2"
).split()
TEXTS = [
    (1, "Running dogs", "the dog's runs and a well-known dog"), (2, "A cat", None), (3, "Known well", "dogs of the cats"), (4, "", ""), (5, "CAFÉ culture", "cafes and known, well dogs"), (6, "well", "known things"), (7, "nothing here", "at all"),
]

QUERIES = ["dog", "Running DOGS", "well-known", "well-known dogs", "cafe", "missing", " ", "--", "dog's"]


def test_stems(spark):
    words, want = EXAMPLES[::2], EXAMPLES[1::2]
    assert spark.createDataFrame([(words,)], "w array<string>").select(stems(F.col("w"))).first()[0] == want


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(TEXTS, "id long, title string, summary string")
    for part in ("id <= 2", "id between 3 and 5", "id > 5"):
        index.add(docs.where(part), path, "id", "title", "summary", buckets=8, files=2)
    return path


def words_of(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", bare)


@pytest.fixture(scope="module")
def stem(spark):
    words = sorted({w for t in [x for row in TEXTS for x in row[1:]] + QUERIES for w in words_of(t)})
    return dict(zip(words, spark.createDataFrame([(words,)], "w array<string>").select(stems(F.col("w"))).first()[0], strict=True))


def plain(stem, query, mode):
    def tokens(text):
        return [stem[w] for w in words_of(text)]

    phrases = [p for p in (tokens(q) for q in query.split()) if p]
    columns = {i: [tokens(a), tokens(b)] for i, a, b in TEXTS}
    n = {i: [sum(c[k : k + len(p)] == p for c in cs for k in range(len(c))) for p in phrases] for i, cs in columns.items()}
    length = {i: sum(map(len, cs)) for i, cs in columns.items()}
    mean = sum(length.values()) / len(length)
    out = {}
    for i in n:
        if phrases and (all if mode == "all" else any)(x > 0 for x in n[i]):
            score = 0.0
            for k in range(len(phrases)):
                df = sum(n[j][k] > 0 for j in n)
                idf = math.log((len(n) - df + 0.5) / (df + 0.5))
                score -= (idf if idf > 0 else 1e-6) * n[i][k] * 2.2 / (n[i][k] + 1.2 * (0.25 + 0.75 * length[i] / mean))
            out[i] = round(score, 9)
    return out


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("mode", ["all", "any"])
def test_search_equals_counting(spark, stored, stem, query, mode):
    got = index.search(spark, stored, query, mode, buckets=8).collect()
    want = plain(stem, query, mode)
    assert {r.id: pytest.approx(r.rank, abs=2e-9) for r in got} == want
    assert [(r.rank, r.id) for r in got] == sorted((r.rank, r.id) for r in got)


def test_facets_and_limits(spark, stored):
    kinds = spark.createDataFrame([(i, "odd" if i % 2 else "even", i % 3) for i, _, _ in TEXTS], "id long, kind string, feed_id long")
    assert {(r.kind, r.posts, r.feeds) for r in index.kind_counts(spark, stored, "dogs", kinds, buckets=8).collect()} == {("odd", 3, 3)}
    assert index.search(spark, stored, "dogs", limit=2, buckets=8).count() == 2
    assert index.kind_counts(spark, stored, "", kinds, buckets=8).count() == 0


def test_a_query_reads_the_buckets_of_its_terms(spark, stored):
    plan = index.hits(spark, stored, [["dog"]], buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan) and re.search(r"PushedFilters: \[[^\]]*(EqualTo\(term,dog\)|In\(term)", plan)


def test_a_word_is_stemmed_once(spark, tmp_path, monkeypatch):
    """Stems are asked for by word and not by place: of 40 texts with the same three words six words or so are stemmed a segment."""
    asked = spark.sparkContext.accumulator(0)

    def counted(words):
        def pass_on(ws):
            asked.add(len(ws))
            return ws

        return F.udf(pass_on, "array<string>")(words)

    monkeypatch.setattr(index, "stems", counted)
    texts = spark.createDataFrame([(i, "red green blue " * 5) for i in range(40)], "id long, text string")
    index.add(texts, str(tmp_path), "id", "text", buckets=2, files=1)
    assert 3 <= asked.value <= 12
    found = spark.read.parquet(f"{tmp_path}/postings")
    assert found.count() == 120 and found.where("id = 7 and term = 'green'").first().positions == [1, 4, 7, 10, 13]
