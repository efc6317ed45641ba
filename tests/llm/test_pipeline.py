"""Each stage against plain Python on the stage's own input, and on odd rows."""

import re
from collections import defaultdict

import corpus_pipeline as C
import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from skein.llm import neardup
from skein.llm.shared import cut, documents


def test_stages(spark, sf):
    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id")
    kept = {}
    for name, stage in C.STAGES:
        before = docs
        docs = cut(stage(spark, docs, sf), "stage")
        kept[name] = docs
        if name != C.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.schema == before.schema
        if name == "minhash near-dedup":
            expected = {r.doc_id for r in neardup.near_duplicates(before, 80).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == expected
    assert kept["language ID"].join(good, "doc_id", "left_semi").count() >= 0.95 * good.count()
    total = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert total <= 1024 and docs.select("doc_id").distinct().count() == kept["substring dedup"].count()


def test_stages_on_few_rows(spark, sf):
    docs = documents(spark, sf)
    for n in (0, 3):
        d = docs.limit(n)
        for _, stage in C.STAGES:
            d = cut(stage(spark, d, sf), "few")
        assert (d.count() == 0) == (n == 0)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_stages_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    stages = dict(C.STAGES)
    # near-duplicates at 80 per cent, all pairs, linked to the smallest reachable
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for i, w in ((i, words(t)) for i, t in texts.items())}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    kept = cut(stages["minhash near-dedup"](spark, docs, sf), "plain")
    assert {r.doc_id for r in kept.collect()} == {i for i in ids if root(i) == i}
    # substring dedup: no stretch of 50 words is left in two documents, and what no other document has stays
    after = {r.doc_id: r.text for r in stages["substring dedup"](spark, kept, sf).collect()}
    holders = defaultdict(set)
    before = {r.doc_id: r.text for r in kept.collect()}
    for i, t in before.items():
        w = words(t)
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    shared = {g for g, own in holders.items() if len(own) > 1}
    assert shared
    for i, t in after.items():
        w = words(t)
        assert all(min(holders[tuple(w[k : k + 50])], default=i) == i for k in range(len(w) - 49) if tuple(w[k : k + 50]) in shared)
    alone = {i for i, t in before.items() if not any(tuple(words(t)[k : k + 40]) in {g[j : j + 40] for g in shared for j in range(11)} for k in range(len(words(t)) - 39))}
    same = [after.get(i) == before[i] for i in alone]
    assert np.mean(same) >= 0.97
    # packing: every token once, in its order
    from tokenizers import Tokenizer

    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    parts = defaultdict(list)
    for r in stages["best-fit packing"](spark, docs, sf).collect():
        parts[r.doc_id].append(r)
    for i, t in texts.items():
        got = b"".join(r.ids for r in sorted(parts[i], key=lambda r: r.piece))
        assert np.frombuffer(got, "<u4").tolist() == [*lib.encode(t or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_on_odd_rows(spark, sf, name):
    """Nulls, empty and long texts, ties, repeated ids and columns that clash with the stages' own: a row each in, defined rows out."""
    text = [None if t is Ellipsis else t for t in ODD]
    rows = [(None if t is Ellipsis else i, t if t is not Ellipsis else None, "en" if i % 2 else None, "s", 1, 2, 3, 4) for i, t in enumerate(ODD)] + [(8, text[8], "en", "s", 1, 2, 3, 4), (8, "another text under an id", "en", "s", 1, 2, 3, 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hit long, gone long, letter long")
    out = dict(C.STAGES)[name](spark, d, sf)
    got = out.collect()
    assert len(got) <= len(rows) or name == "best-fit packing"
    if name == "best-fit packing":
        assert {r.doc_id for r in got} == {r[0] for r in rows} and max(r.length for r in got) <= 1024
    else:
        assert out.columns == d.columns and all(r.hit == 2 and r.gone == 3 and r.letter == 4 for r in got)
    if name == "minhash near-dedup":
        assert sum(r.doc_id is None for r in got) == 1 and {0, 1, 2, 3} <= {r.doc_id for r in got} and 9 not in {r.doc_id for r in got}
    if name == "language ID":
        assert not {0, 1, 2} & {r.doc_id for r in got}
