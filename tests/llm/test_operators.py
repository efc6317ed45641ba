"""The operators against libraries and brute force, and on odd rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from skein.llm import chroma, collocations, langid, manifest, neardup, packing, passages, pieces, ppm, prefixes, quality_crf, queries, rules, toolcalls
from skein.llm.components import connected_components
from skein.llm.textops import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = [w for w in "the quick brown fox jumps over lazy dog while seven wizards brew strong potions near misty rivers under pale moons and silent stars".split()]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed"]) + rng.choice(["", "", ","]) for _ in range(n))


# 1
def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    signs = [*"abcdetnis ▁\n\t<>0xA/*;\r\"'()é中", "\U0001F600", " ", "  ", "     ", "\x00", "</s>", "<0x0A>", "the", "ing", "tion", " {", "});\r\n"]
    texts = [None, "", " ", "▁"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [prose(rng, 300)] + [" " * n + "x" + " " * n for n in range(1, 40)]
    got = {r.doc_id: r for r in pieces.transcode(docs(texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded == lib.decode(ids)


def test_pieces_step_back():
    m = pieces.model(P.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    for _ in range(3000):
        run = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 14)))
        assert [m.text[i] for i in m.backtrack(run)] == m.merged(run)


# 2
def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    rng = random.Random(2)
    signs = [*"ab's 're\n\t 12!,é中", "\U0001F600", "  ", "\x1c", "\x85", "\xa0", "<|endoftext|>", "'ll", " I'm"]
    for _ in range(1500):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(packing.tokenizer(path).encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all(seed):
    rng = random.Random(seed)
    h = Counter(min(64, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(2000))
    plan = packing.plan(h, 64)
    used = Counter()
    for times, items in plan:
        assert sum(items) <= 64
        for n in items:
            used[n] += times
    assert used == h and sum(t for t, _ in plan) <= math.ceil(sum(n * c for n, c in h.items()) / 64) * 1.05 + 1


def test_best_two_fit_replaces_the_smallest():
    assert (1, [6, 3, 1]) in packing.plan({6: 1, 3: 1, 1: 1}, 10)
    # greedy takes 5 and 3, one short; 2 and 2 fill what 3 left
    assert sorted(packing.plan({5: 1, 3: 1, 2: 2}, 9)[0][1]) == [2, 2, 5]


def test_packing(spark, docs):
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([1, 10, 100, 900])) for _ in range(60)] + [None, ""] + ["copy of one text"] * 40
    d = docs(texts)
    path = P.path("byte_bpe_50k.json")
    got = packing.pack(packing.tokenize(d, path)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = packing.tokenizer(path).encode(t) + np.array([2], "<u4").tobytes()
        parts = sorted(by[i], key=lambda r: r.piece)
        assert b"".join(r.ids for r in parts) == ids and [r.length for r in parts[1:]] == [1024] * (len(parts) - 1)
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for s in rows.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s[:-1])]).tolist() and sum(n for _, n in s) <= 1024


# 3
def test_rules_equal_their_sql(spark, odd, docs):
    rng = random.Random(4)
    d = odd.where("doc_id is not null").unionByName(docs([prose(rng, n) + "\n" + prose(rng, 5) for n in (3, 60, 60, 400)] + ["a b c d a b c " * 30, "# * $ " * 80, "x\nx\nx\n\n \n" * 9], 100))
    con = duckdb.connect()
    documents = d.select("doc_id", "text").toArrow()  # noqa: F841
    con.register("documents", documents)
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    expected = sorted(con.sql(rules.sql()).select(*columns).fetchall())
    assert sorted(tuple(r) for r in rules.assess(d).select(*columns).collect()) == expected
    plan = rules.assess(d)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    one = {r.doc_id: r for r in rules.assess(d).collect()}
    for i, t in enumerate(ODD):
        if i in one and t is not ...:
            w = WORD.findall(t or "")
            g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
            hit = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
            assert (one[i].n_words, one[i].n_repeat_words) == (len(w), len(hit))


# 4
def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5])
    good, pairs, z = quality_crf.marginals(emit, first, trans)
    for a, b, zz in zip(first, [4, 5, 9], z, strict=True):
        n = b - a
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = math.exp(sum(emit[a + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            on += p * np.array(y)
        assert np.allclose(good[a:b], on / total) and np.isclose(zz, math.log(total))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op4_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() >= 0.95


# 5
def test_windows_are_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(0)
    mask = ~np.uint64((1 << 24) - 1)
    for _ in range(40):
        h = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        out, todo = [], [(0, len(h))]
        while todo:
            a, b = todo.pop()
            if b - a >= 10:
                c = a + int(np.argmin(h[a:b] & mask))
                out.append((max(a, c - 9), c, min(b - 1, c + 9)))
                todo += [(a, c), (c + 1, b)]
        got = passages.compact_windows(h, np.array([0]), np.array([len(h)]), 10)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(out)


def test_passages_are_found_and_cut(spark, docs):
    rng = random.Random(6)
    big = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    fresh = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    shared, other = " ".join(big[:60]), " ".join(big[100:180])
    edited = other.split()
    edited[40] = "changed"
    texts = [fresh(100) + " " + shared + " " + fresh(70), fresh(30), fresh(20) + "\n" + shared, other, fresh(5) + " " + " ".join(edited), " ".join(big[200:230]) + fresh(60), " ".join(big[200:230]) + fresh(60), None, "", shared]
    d = docs(texts)
    found = passages.shared_passages(d)
    got = {(r.doc_id, r.source_doc_id) for r in found.collect()}
    assert got == {(2, 0), (9, 0), (4, 3)}
    left = {r.doc_id: r.text for r in passages.without_passages(d, found).collect()}
    assert len(words(left[2])) == 20 and words(left[9]) == [] and left[0] == texts[0] and left[7] is None
    assert len(words(left[4])) <= 10


def test_exact_repeats_all_found(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, expected = {}, set()
    for r in sorted(d.collect(), key=lambda r: r.doc_id):
        w = words(r.text)
        for j in range(len(w) - 49):
            o = first.setdefault(tuple(w[j : j + 50]), r.doc_id)
            if o < r.doc_id:
                expected.add(r.doc_id)
    assert expected <= {r.doc_id for r in passages.shared_passages(d).collect()}


def test_passages_whose_leader_has_a_part_only(spark, docs):
    rng = random.Random(16)
    fresh = lambda n: [f"u{rng.randint(0, 10**9)}" for _ in range(n)]
    texts, expected = [], set()
    for _ in range(40):
        line = fresh(40)
        before, after = fresh(4), fresh(6)
        n = len(texts)
        # the first has the line alone, once or twice; the next two a passage of 50 words around it
        texts += [" ".join(x) for x in (fresh(30) + line + fresh(60) + line + fresh(9), fresh(25) + before + line + after + fresh(35), fresh(70) + before + line + after + fresh(15))]
        expected.add((n + 2, n + 1, 70, 120))
    # a leader that has the line first and the whole passage later
    texts += [" ".join(x) for x in (fresh(50) + line + fresh(70) + before + line + after + fresh(9), fresh(20) + before + line + after)]
    n = len(texts) - 2
    got = {(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in passages.shared_passages(docs(texts)).collect()}
    assert {g for g in got if g[0] < n} == expected
    assert any(g[0] == n + 1 and g[2] <= 20 and g[3] == 70 for g in got)


@pytest.mark.parametrize("crowd,block", [(8, 1024), (2, 1024), (1, 1)])
def test_edited_passages_whose_signature_leads_elsewhere(spark, docs, monkeypatch, crowd, block):
    """A smaller document that has a passage's line only hides no edited passage, in pairs as in blocks."""
    monkeypatch.setattr(passages, "CROWD", crowd, raising=False)
    monkeypatch.setattr(passages, "BLOCK", block, raising=False)
    rng = random.Random(3)
    texts, want = [], set()
    for _ in range(150):
        line, before, after = prose(rng, 52).split(), prose(rng, 4), prose(rng, 4)
        edited = [*line[:26], "edited", *line[27:]]
        texts += [f"{prose(rng, 40)} {' '.join(line[2:-2])} {prose(rng, 40)}"]
        texts += [f"{prose(rng, 40)} {before} {' '.join(w)} {after} {prose(rng, 40)}" for w in (line, edited)]
        want.add((len(texts) - 1, len(texts) - 2))
    assert len(want & {(r.doc_id, r.source_doc_id) for r in passages.shared_passages(docs(texts)).collect()}) >= 139


def test_edited_passages_with_a_run_in_common_are_all_found(spark, docs):
    """Of passages with one word of 50 replaced none is missed, wherever the word is."""
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randint(0, 10**9)}" for _ in range(n)]
    texts, want = [], set()
    for at in [*range(5, 45)] * 5:
        p = fresh(50)
        texts += [" ".join(fresh(20) + w + fresh(25)) for w in (p, [*p[:at], "edited", *p[at + 1 :]])]
        want.add((len(texts) - 1, len(texts) - 2))
    assert want <= {(r.doc_id, r.source_doc_id) for r in passages.shared_passages(docs(texts)).collect()}


@pytest.mark.parametrize("block", [2048, 16])
def test_near_copies_give_classes_and_words_in_rows_of_their_number(spark, docs, monkeypatch, block):
    """Many near copies of a passage: one class, all their words, and no row for each pair."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randint(0, 10**9)}" for _ in range(n)]
    groups, texts = [fresh(70) for _ in range(3)], []
    for i in range(120):
        p = list(groups[i % 3])
        if i >= 3:
            p[rng.randrange(8, 62)] = f"edit{i}"
        texts.append(" ".join(fresh(15) + p + fresh(15)))
    found = passages.with_classes(passages.shared_passages(docs(texts))).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i % 3 for i in range(3, 120)}
    covered = defaultdict(set)
    for r in found:
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert all(covered[i] >= set(range(15, 85)) for i in range(3, 120))
    if block > 120:
        assert len({(r.doc_id, r.source_doc_id) for r in found}) < 5 * 120


def crowd_rows(x, p):
    """One key's stretches as passages._crowd takes them, the first of document 0."""
    n = len(x)
    stretches = [np.ascontiguousarray(s.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for s in x]
    none = pa.array(np.zeros(n, np.int32))
    return pa.table({"lo": none, "hi": none, "block": none, "doc": pa.array(range(n), pa.int64()), "s": pa.array(np.full(n, p, np.int32)), "p": pa.array(np.full(n, p, np.int32)), "x": pa.array(stretches, pa.binary())})


def test_a_crowd_is_not_compared_in_all_pairs(monkeypatch):
    """A passage in many different surroundings, and many near copies: pairs compared grow with the stretches, classes and words are those of all pairs."""
    compared = []
    spans = passages._spans
    monkeypatch.setattr(passages, "_spans", lambda equal: compared.append(len(equal)) or spans(equal))
    rng = np.random.default_rng(8)
    passage = rng.integers(1, 1 << 24, 93)
    for kind in ("surroundings", "edits"):
        for n in (200, 800):
            compared.clear()
            x = np.tile(passage, (n, 1))
            for own in x[1:]:
                if kind == "surroundings":
                    own[:16], own[76:] = rng.integers(1, 1 << 24, 16), rng.integers(1, 1 << 24, 17)
                else:
                    at = rng.integers(0, 25)
                    own[at : at + 5] = rng.integers(1, 1 << 24, 5)
            got = passages._crowd(crowd_rows(x, 36)).to_pylist()
            covered = defaultdict(set)
            for r in got:
                assert r["source_doc_id"] < r["doc_id"]
                covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
            want = set(range(16, 80)) if kind == "surroundings" else set(range(30, 97))
            assert sum(compared) <= 20 * n and len(got) <= 3 * n
            assert sorted(covered) == list(range(1, n)) and all(c >= want for c in covered.values())


def test_passages_of_repeated_lines_in_a_crowd():
    """Stretches with fewer different shingles than a passage has in all are compared too: a line that comes again and again."""
    rng = np.random.default_rng(9)
    line = rng.integers(1, 1 << 24, 30)
    x = [np.tile(line, 3).copy() for _ in range(12)]
    for own in x[1:]:
        own[62:67] = rng.integers(1, 1 << 24, 5)
    got = passages._crowd(crowd_rows(x, 36)).to_pylist()
    assert {r["doc_id"] for r in got} == set(range(1, 12))


def test_common_counts_all_pairs(monkeypatch):
    monkeypatch.setattr(passages, "LIGHT", 3)
    rng = np.random.default_rng(4)
    x = [rng.integers(0, 40 + 3 * i, 30).astype(np.uint32) for i in range(300)]
    want = [[j for j in range(i) if len(set(x[i].tolist()) & set(x[j].tolist())) >= 6] for i in range(300)]
    assert [(i, found.tolist()) for i, found in passages._common(x, 6)] == list(enumerate(want))


def test_exact_repeats_are_covered_whole(spark):
    """Every word of a stretch of 50 that a smaller doc_id has is in a row of its document, or the document has the stretch earlier."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: words(r.text) for r in d.collect()}
    covered = defaultdict(set)
    for r in passages.shared_passages(d).collect():
        assert r.source_doc_id < r.doc_id
        if r.similarity == 1:
            assert texts[r.doc_id][r.start_word : r.end_word] == texts[r.source_doc_id][r.source_start : r.source_end]
        covered[r.doc_id] |= {i for i in range(r.start_word, r.end_word)}
    first = {}
    for i in sorted(texts):
        seen = set()
        for j in range(len(texts[i]) - 49):
            g = tuple(texts[i][j : j + 50])
            if first.setdefault(g, i) < i and g not in seen:
                assert covered[i] >= set(range(j, j + 50))
            seen.add(g)


EDITS = ["replace", "insert", "delete"]


@pytest.mark.parametrize("n", [50, 60, 80])
def test_recall_of_edited_passages(spark, docs, n):
    """Pairs of passages at similarity 0.8 or more in fresh surroundings: nine of ten are found, by edit and length."""
    rng = random.Random(17 + n)
    fresh = lambda k: [f"u{rng.randint(0, 10**9)}" for _ in range(k)]
    texts, of = [], []
    while len(of) < 360:
        kind = EDITS[len(of) % 3]
        p = fresh(n)
        q = list(p)
        for _ in range(rng.choice([1, 1, 2, 3])):
            at = rng.randrange(len(q))
            q[at : at + (kind != "insert")] = [] if kind == "delete" else fresh(1)
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (p, q))
        if len(x & y) < 0.8 * len(x | y) or min(len(p), len(q)) < 50:
            if kind == "delete" and n == 50:  # it leaves fewer than 50 words: nothing to find
                of.append(None)
            continue
        texts += [" ".join(t) for t in (fresh(20) + p + fresh(25), fresh(10) + q + fresh(40))]
        of.append((kind, len(texts) - 1, 10, 10 + len(q)))
    found = defaultdict(list)
    for r in passages.shared_passages(docs(texts)).collect():
        assert r.similarity >= 0.8 and r.end_word - r.start_word >= 50 and r.source_end - r.source_start >= 50
        found[r.doc_id].append((r.start_word, r.end_word))
    for kind in EDITS:
        some = [x for x in of if x and x[0] == kind]
        hit = [any(min(e, z) - max(s, a) >= 45 for s, e in found[i]) for _, i, a, z in some]
        assert not some or np.mean(hit) >= 0.9, (kind, np.mean(hit), len(some))


def test_periodic_and_repeated_texts(spark, docs):
    """Texts of one word or one line over and over give few rows, and go whole where a smaller document has the same."""
    rng = random.Random(18)
    line = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(60))
    d = docs(["lorem " * 400, "lorem " * 900, (line + "\n") * 40, "start " + (line + "\n") * 70, "end " + line])
    found = passages.shared_passages(d)
    assert {(r.doc_id, r.source_doc_id) for r in found.collect()} == {(1, 0), (3, 2), (4, 2)} and found.count() < 40
    left = {r.doc_id: words(r.text) for r in passages.without_passages(d, found).collect()}
    assert (len(left[0]), left[1], len(left[2]), left[3], left[4]) == (400, [], 2400, ["start"], ["end"])


def test_passages_of_odd_columns(spark, docs):
    d = docs([WORDS[0] + " " + " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(60)), None, ""]).withColumns({"of": F.lit(1), "_of": F.lit(2), "ranges": F.lit(3), "key": F.lit(4)})
    found = passages.shared_passages(d)
    assert [(r.doc_id, r.start_word, r.end_word) for r in found.collect()] == [(1, 0, 60)]
    out = passages.without_passages(d, found)
    assert out.columns == d.columns and {r.doc_id: (r.of, r.ranges) for r in out.collect()} == {i: (1, 3) for i in range(4)}
    assert passages.shared_passages(d.limit(0)).count() == 0 and passages.without_passages(d.limit(0), found).count() == 0


def test_runs_are_joined_from_each():
    x = np.arange(1, 78, dtype=np.uint64)
    y = x.copy()
    y[22:27] = y[47:52] = 999
    # runs of 22, 20 and 25
    got = passages.aligned(x, y, 10, 10)
    assert {g[:2] for g in got} == {(0, 51), (27, 81)}


# 6
def as_bytes(text, order):
    return b"\n" * order + " ".join(words(text)).encode() + b"\n"


def naive_counts(texts, order):
    """Counts of bytes by context."""
    counts = defaultdict(Counter)
    for t in texts:
        s = as_bytes(t, order)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    return counts


def naive_escape(counts):
    """Left out once, does the rest of its context have a byte? By order and sizes."""
    novel, total = Counter(), Counter()
    for context, c in counts.items():
        n, d = sum(c.values()), len(c)
        for m in c.values():
            if n > 1:
                at = int(ppm.Trie._class(len(context), np.array(n - 1), np.array(d - (m == 1))))
                total[at] += m
                novel[at] += m == 1 and 1

    def escape(order, n, d):
        at = int(ppm.Trie._class(order, np.array(n), np.array(d)))
        return (novel[at] + 20 * d / (n + d)) / (total[at] + 20)

    return escape


def naive_ppm(counts, escape, text, order):
    total, s = 0.0, as_bytes(text, order)
    for i in range(order, len(s)):
        out: set = set()
        for k in range(order, -1, -1):
            c = counts.get(s[i - k : i])
            if not c:
                continue
            open_ = {b: n for b, n in c.items() if b not in out}
            if not open_:
                continue
            n = sum(open_.values())
            e = escape(k, n, len(open_))
            if s[i] in open_:
                total += math.log10((1 - e) * open_[s[i]] / n)
                break
            total += math.log10(e)
            out |= set(c)
        else:
            total += math.log10(1 / max(257 - len(out), 1))
    return total


@pytest.mark.parametrize("order,most,part", [(3, 10**6, 10**6), (5, 10**6, 100), (5, 500, 10**6)])
def test_ppm_equals_a_plain_one(spark, odd, docs, monkeypatch, order, most, part):
    """Whatever the parts of the trie and the passes over the texts."""
    monkeypatch.setattr(ppm, "PART_STRINGS", part)
    rng = random.Random(8)
    d = docs([prose(rng, 40) for _ in range(12)] + [" ".join(f"{rng.choice('xyz')}{rng.randint(0, 99)}" for _ in range(30)) for _ in range(8)], 100).unionByName(odd.where("length(text) < 1000 or text is null"))
    rows = d.collect()
    got = ppm.score(d, F.col("doc_id") % 3 == 1, order, most=most).collect()
    learned = [r.text for r in rows if r.doc_id is not None and r.doc_id % 3 != 1]
    training = Counter(x for t in learned for x in [*words(t), "\n"])
    counts = naive_counts(learned, order)
    escape = naive_escape(counts)
    n, v = sum(training.values()), len(training)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for r in rows:
        w = [*words(r.text), "\n"]
        g = by[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(training[x] > 0 for x in w), n)
        assert math.isclose(g.base_score, sum(math.log10((training[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(g.score, naive_ppm(counts, escape, r.text, order), rel_tol=1e-6)


def test_ppm_hears_the_order_of_words(spark, docs):
    rng = random.Random(9)
    known = [prose(rng, 60) for _ in range(30)]
    mixed = []
    for t in known:
        w = t.split()
        rng.shuffle(w)
        mixed.append(" ".join(w))
    got = {r.doc_id: r for r in ppm.score(docs(known + mixed), F.col("doc_id") >= 30).collect()}
    assert all(math.isclose(got[i].base_score, got[i + 30].base_score) and got[i].score > got[i + 30].score for i in range(30))


def test_ppm_repeated_rows_and_no_training(spark, docs):
    d = docs(["one text", "one text", None, "", Ellipsis, Ellipsis]).unionByName(docs(["one text", "other text"], 0))
    assert ppm.score(d, F.lit(False)).count() == 8
    none = ppm.score(d, F.lit(True)).collect()
    assert len(none) == 8 and all(r.n_known == 0 and r.score < 0 for r in none)
    assert ppm.score(d.limit(0), F.lit(False)).count() == 0


# 7
def test_chroma_aligns_shifted_recordings(spark):
    rng = np.random.default_rng(1)

    def play(notes):
        hz = 440 * 2 ** (np.array(notes) / 12)
        return 9000 * np.sin(2 * np.pi * np.cumsum(np.repeat(hz, 1024)) / 8000)

    a, b = rng.integers(-12, 12, 80), rng.integers(-12, 12, 80)
    x, y = play(a), play(b)
    noisy = x + rng.normal(0, 200, len(x))
    pcm = {1: x, 2: noisy, 3: x[1024 * 10 :], 4: y, 5: x, 6: np.zeros(100), 7: np.zeros(0)}
    rows = [(k, bytearray(v.astype("<i2").tobytes()), 8000) for k, v in pcm.items()] + [(8, None, 8000)]
    got = {r.rec_id: r for r in chroma.align(chroma.fingerprints(spark.createDataFrame(rows, "rec_id long, pcm binary, rate int"))).collect()}
    assert {k: r.component_id for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8}
    assert got[5].class_id == 1 and abs(got[3].offset) == 20 and got[6].n_frames == 0


def test_chroma_checks_every_offset_with_votes(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(1, 1 << 32, 60, dtype=np.uint32)
    b = rng.integers(1, 1 << 32, 60, dtype=np.uint32)
    # alike at offset 0 in all places but for a bit, and equal in few; more places are equal at offset 30
    b[:] = a ^ np.uint32(1)
    b[:4] = a[:4]
    b[20:28] = a[50:58]
    prints = [(1, bytearray(a.astype("<u4").tobytes())), (2, bytearray(b.astype("<u4").tobytes()))]
    got = {r.rec_id: r for r in chroma.align(spark.createDataFrame(prints, "rec_id long, print binary")).collect()}
    assert got[2].component_id == 1 and got[2].offset == 0 and got[2].match_id == 1


def test_chroma_against_all_pairs_and_offsets(spark):
    """Components of shifted and noisy prints that hold silence in common, against every pair at every offset."""
    rng = np.random.default_rng(4)
    prints = {}
    for g in range(25):
        base = rng.integers(1, 1 << 32, 90, dtype=np.uint32)
        for _ in range(4):
            n = int(rng.integers(0, 40))
            own = base[n : n + 50].copy()
            for bit in range(32):
                own[rng.random(len(own)) < 0.03] ^= np.uint32(1 << bit)
            quiet = np.full(int(rng.integers(0, 12)), 77, np.uint32)
            prints[len(prints) * 3 + 1] = np.concatenate((quiet, own, quiet))
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    best = {}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = prints[i], prints[j]
            fits = [(*chroma.bit_error(x, y, d), d) for d in range(-len(y) + 24, len(x) - 23)]
            fits = [(e, d) for e, n, d in fits if e <= chroma.MAX_BIT_ERROR and n >= chroma.MIN_OVERLAP]
            if fits:
                best[i, j] = min(fits)
                a, b = sorted((root(i), root(j)))
                up[b] = a
    rows = [(int(i), bytearray(x.astype("<u4").tobytes())) for i, x in prints.items()]
    got = {r.rec_id: r for r in chroma.align(spark.createDataFrame(rows, "rec_id long, print binary")).collect()}
    assert len(best) > 60
    assert np.mean([got[i].component_id == root(i) for i in ids]) >= 0.97
    pairs = {(max(r.rec_id, r.match_id), min(r.rec_id, r.match_id)): r for r in got.values() if r.match_id}
    assert set(pairs) <= set(best) and all(math.isclose(r.bit_error, best[k][0], abs_tol=1e-12) for k, r in pairs.items())


@pytest.mark.parametrize("flipped", [0.03, 0.04, 0.05, 0.06])
def test_chroma_finds_noisy_pairs_inside_its_threshold(spark, flipped):
    """Pairs of 60 frames with flipped bits in both, of which every offset that fits is known: nine of ten are found."""
    rng = np.random.default_rng(int(1000 * flipped))
    prints, pairs = {}, []
    while len(pairs) < 80:
        base = rng.integers(1, 1 << 32, 60, dtype=np.uint32)
        x, y = base.copy(), base.copy()
        for own in (x, y):
            for bit in range(32):
                own[rng.random(60) < flipped] ^= np.uint32(1 << bit)
        if chroma.bit_error(x, y, 0)[0] <= chroma.MAX_BIT_ERROR:
            k = len(prints)
            prints[k], prints[k + 1] = x, y
            pairs.append((k, k + 1))
    rows = [(i, bytearray(x.astype("<u4").tobytes())) for i, x in prints.items()]
    got = {r.rec_id: r.component_id for r in chroma.align(spark.createDataFrame(rows, "rec_id long, print binary")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 72
    assert len(set(got.values())) >= 80


@pytest.mark.parametrize("crowd,block", [(32, 256), (2, 3)])
def test_chroma_pairs_behind_crowded_values(spark, monkeypatch, crowd, block):
    """Noisy pairs that meet only where many other recordings have the same values are found."""
    monkeypatch.setattr(chroma, "CROWD", crowd)
    monkeypatch.setattr(chroma, "BLOCK", block)
    rng = np.random.default_rng(9)
    hum = rng.integers(1, 1 << 32, 12, dtype=np.uint32)
    prints, pairs = {}, []
    for g in range(30):
        base = rng.integers(1, 1 << 32, 30, dtype=np.uint32)
        # a bit of each byte differs, and the hum that all have is all that is equal
        other = base ^ np.uint32(0x01010101)
        for own in (base, other):
            prints[len(prints)] = np.concatenate((own[:15], hum, own[15:]))
        pairs.append((2 * g, 2 * g + 1))
    rows = [(i, bytearray(x.astype("<u4").tobytes())) for i, x in prints.items()]
    got = {r.rec_id: r for r in chroma.align(spark.createDataFrame(rows, "rec_id long, print binary")).collect()}
    assert all(got[a].component_id == got[b].component_id == a and got[b].match_id == a and got[b].offset == 0 for a, b in pairs)


def test_chroma_votes_tell_chance_from_likeness():
    """Recordings that are alike meet once for their offset, noisy ones too; one that has a key's bits by chance does not meet them."""
    rng = np.random.default_rng(10)
    x = rng.integers(1, 1 << 32, 60, dtype=np.uint32)
    noisy, chance = x.copy(), rng.integers(1, 1 << 32, 60, dtype=np.uint32)
    for bit in range(32):
        noisy[rng.random(60) < 0.06] ^= np.uint32(1 << bit)
    for k, mask in enumerate(chroma.MASKS[0]):
        chance[k] = x[k] & np.uint32(mask) | chance[k] & ~np.uint32(mask)
    prints = [p.astype("<u4").tobytes() for p in (x, x ^ np.uint32(1 << 31), noisy, chance)]
    keys = pa.Table.from_batches(chroma._values(iter([pa.record_batch([pa.array(range(4), pa.int64()), pa.array(prints, pa.binary())], ["id", "print"])])))
    keys = keys.sort_by([("key", "ascending"), ("id", "ascending"), ("place", "ascending")])
    met = pa.Table.from_batches(chroma._meetings(iter(keys.to_batches())))
    assert sorted(zip(*(met[c].to_pylist() for c in ("a", "b", "offset")), strict=True)) == [(1, 0, 0), (2, 0, 0), (2, 1, 0)]


def test_fingerprint_is_a_sum_over_frames():
    """The integral image gives what plain sums over rectangles give."""
    rng = np.random.default_rng(5)
    x = (9000 * np.sin(2 * np.pi * np.cumsum(np.repeat(440 * 2 ** (rng.integers(-12, 12, 20) / 12), 1024)) / 8000)).astype(np.float32)
    c = chroma.chroma(x, 8000)
    got = chroma.fingerprint(x, 8000)
    for t in range(0, len(got), 5):
        bits = 0
        for kind, y, h, w in chroma.FILTERS:
            box = c[t : t + w, y : y + h]
            sign = np.zeros((w, h))
            if kind == 0:
                sign[:, : h // 2], sign[:, h // 2 :] = 1, -1
            elif kind == 1:
                sign[: w // 2], sign[w // 2 :] = 1, -1
            elif kind == 2:
                sign[: w // 2, : h // 2] = sign[w // 2 :, h // 2 :] = 1
                sign[w // 2 :, : h // 2] = sign[: w // 2, h // 2 :] = -1
            else:
                sign[:] = -1
                sign[w // 4 : w // 4 + w // 2] = 1
            p, q = box[sign > 0].sum(), box[sign < 0].sum()
            level = int(np.searchsorted(chroma.THRESHOLDS, np.log((0.05 + p) / (0.05 + q))))
            bits = bits << 2 | [0, 1, 3, 2][level]
        assert int(got[t]) == bits


def test_tones_in_takes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 64)]) for i in range(20)] + [(30, None), (31, [1.0, None]), (32, [float("nan")] * 64), (None, [0.1] * 64)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    takes = chroma.tones(v, takes=2)
    got = chroma.align(chroma.fingerprints(takes.withColumn("rec_id", F.col("rec_id") * 2 + F.col("take")))).collect()
    assert len(got) == 48
    of = {r.rec_id: r for r in got if r.rec_id is not None}
    assert sum(of[2 * i + 1].component_id == 2 * i for i in range(20)) >= 18
    assert all(of[2 * i].n_frames == 0 and of[2 * i].match_id is None for i in (30, 31, 32))
    assert chroma.align(chroma.fingerprints(chroma.tones(v.limit(0), takes=2))).count() == 0


# 8
def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 1, "a", "add", '{"y": 2, "x": 1}', []), (1, 2, "b", "add", '{"x": "1"}', ["a"]), (1, 3, "c", "find", '{"q": "t\\u00e9"}', ["b", "zz"]), (2, 1, "d", "add", "nope", None),
        (3, 1, "e", "find", "{}", ["f"]), (3, 2, "f", "find", '{"q": "q", "z": 0}', []), (4, 1, "g", "find", '{"q": "1"}', ["h"]), (4, 2, "h", "find", '{"q": "1"}', ["g"]), (None, None, None, None, None, None),
    ], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([("a", "3"), ("a", "4"), ("zzz", "lost"), (None, "x")], "call_id string, content string")
    schemas = {"add": {"x": ("integer", True), "y": ("integer", False)}, "find": {"q": ("string", True)}}
    out = toolcalls.link_calls(calls, results, schemas)
    got = {r.call_id: r for r in out.collect()}
    assert len(got) == 9
    assert got["a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3"}' and got["a"].errors == [] and got["a"].linked
    assert got["b"].errors == ["x is no integer"] and got["c"].errors == ["waits for unknown: zz"] and got["d"].errors == ["not JSON"] and got["d"].json is None
    assert got["e"].errors == ["q is missing"] and got["f"].errors == ["unknown: z"]
    assert (got["f"].level, got["e"].level, got["g"].level, got["h"].level) == (0, 1, None, None)
    assert got["a"].level < got["b"].level < got["c"].level
    assert json.loads(got["c"].json)["arguments"] == {"q": "té"}
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_tool_calls_wait_across_conversations(spark):
    calls = spark.createDataFrame([
        # waits for a later turn, which waits for another conversation
        (1, 5, "a", ["b"]), (1, 6, "b", ["c3"]), (2, 1, "c1", []), (2, 3, "c3", ["c1"]),
        # an earlier turn of another conversation, with a greater level there
        (3, 9, "d9", ["d8"]), (3, 8, "d8", []), (4, 10, "e", ["d9"]), (4, 11, "e2", ["e"]),
        # an identifier that two conversations have
        (5, 1, "f", []), (6, 7, "f", []), (6, 8, "g", ["f"]),
        (7, 1, "h1", []), (7, 3, "h3", ["h1"]),
    ], "conv_id long, turn long, call_id string, after array<string>").selectExpr("*", "'t' as name", "'{}' as arguments")
    results = spark.createDataFrame([], "call_id string, content string")
    got = {r.call_id: r.level for r in toolcalls.link_calls(calls, results, {"t": {}}).collect()}
    assert got == {"c1": 0, "c3": 1, "b": 2, "a": 3, "d8": 0, "d9": 1, "e": 2, "e2": 3, "f": 0, "g": 1, "h1": 0, "h3": 1}


def test_tool_calls_in_levels(spark, monkeypatch):
    """Against plain recursion: chains, forks, cycles, what stands behind them, repeated and unknown identifiers; rounds are few on chains."""
    rng = random.Random(21)
    waits = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(100)}
    waits |= {f"r{i}": [f"r{i + rng.choice([2, 3, 5, 7]) * rng.choice([1, 1, 1, -1])}" for _ in range(rng.choice([0, 1, 1, 2]))] for i in range(60)}
    waits |= {"own": ["own"], "p": ["q"], "q": ["s"], "s": ["p"], "behind": ["q", "c5"], "both": ["c99", "c3", "c99"]}

    def level(x, path=()):
        if x in path:
            return None
        below = [level(y, (*path, x)) for y in waits[x] if y in waits]
        return None if None in below else max([b + 1 for b in below], default=0)

    rows = [(1, i, k, v) for i, (k, v) in enumerate(waits.items())] + [(2, 1, "c7", [])]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after array<string>").selectExpr("*", "'t' as name", "'{}' as arguments")
    out = toolcalls.link_calls(calls, spark.createDataFrame([], "call_id string, content string"), {"t": {}}).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.level == level(r.call_id), r
        lost = sorted({w for w in waits[r.call_id] if w not in waits})
        assert r.errors == (["waits for unknown: " + ",".join(lost)] if lost else [])
    rounds = []
    made = toolcalls.cut
    monkeypatch.setattr(toolcalls, "cut", lambda df, name: rounds.append(name) or made(df, name))
    chain = spark.createDataFrame([(f"k{i}", f"k{i - 1}") for i in range(1, 64)], "call_id string, after string")
    assert {r.call_id: r.level for r in toolcalls._levels(chain).collect()} == {f"k{i}": i for i in range(64)} and rounds.count("met") <= 7


def test_tool_calls_of_odd_turns(spark, sf):
    rows = [(1, 1, "assistant", None), (1, 2, "user", None), (1, 3, "assistant", "x" * 13), (1, 5, "assistant", "x" * 26), (1, 7, "assistant", "seven ."), (1, 8, "tool", "b"), (1, 8, "user", "a"),
            (2, 1, "assistant", "é\"\\\n"), (2, 3, "assistant", "é" * 91), (None, 1, "assistant", "n"), (3, None, "assistant", "n"), (None, None, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", d.toArrow())
    names = ["conv_id", "turn", "call_id", "copies", "linked", "level", "errors", "json"]
    expected = con.sql(queries.ORACLE_SQL["op8_toolcalls"]).select(*names).fetchall()
    calls, results = toolcalls.of_turns(d)
    got = toolcalls.link_calls(calls, results, toolcalls.RESPOND).withColumn("errors", F.array_join("errors", "; ")).select(*names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    calls, results = toolcalls.of_turns(d.limit(0))
    assert toolcalls.link_calls(calls, results, toolcalls.RESPOND).count() == 0


# 9
def brute_components(rows, percent):
    sets = {r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and both:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, docs, odd):
    rng = random.Random(9)
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    d = docs(texts + [prose(rng, 80) for _ in range(20)] + ["short text"] * 3 + texts[:3], 100).unionByName(odd)
    rows = d.collect()
    expected, sizes = brute_components(rows, 85)
    got = neardup.near_duplicates(d, 85).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], sizes[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_cross_pairs_in_blocks(spark, docs, monkeypatch):
    # with few bands buckets stay open after the first links, and blocks of two hold little
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(11)
    base = [f"v{i}" for i in range(100)]
    chain = []
    for step in range(12):
        w = list(base)
        for k in range(step):
            w[8 * k % 100] = f"c{k}"
        chain.append(" ".join(w))
    rng.shuffle(chain)
    d = docs(chain)
    expected, _ = brute_components(d.collect(), 85)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d, 85).collect()} == expected


def test_estimate():
    rng = np.random.default_rng(2)
    for j in (0.3, 0.6, 0.85):
        n = 2000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        x, y = neardup.registers(pool[:n]), neardup.registers(pool[n - both :])
        est = neardup.estimate(*(np.array([c]) for c in ((x == y).sum(), (x > y).sum(), (x < y).sum())), np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(est - j) < 0.15
        assert (neardup.registers(pool) == np.maximum(x, y)).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    assert {r.id: r.component for r in connected_components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


# 10
def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op10_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() >= 0.95 and out.score.between(0, 1).all()


def plain_grams(text):
    """Counts of the hashed pairs and triples of bytes of a text: letters folded, all else of ASCII a space."""
    b = bytes(c if 0x61 <= c < 0x7B or c >= 0x80 else 0x20 for c in (text or "").translate(LOWER).encode())
    out = np.zeros(langid.BINS)
    place = lambda code: (code * 2654435761 & 0xFFFFFFFF) >> 20
    for i in range(len(b) - 1):
        if b[i : i + 2] != b"  ":
            out[place(b[i] << 8 | b[i + 1])] += 1
    for i in range(len(b) - 2):
        if b[i : i + 2] != b"  " and b[i + 1 : i + 3] != b"  ":
            out[place((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) | 0x1000000)] += 1
    return out


def test_language_by_plain_cosine(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(d)
    some = d.orderBy("doc_id").limit(40).select("doc_id", "text").unionByName(odd.where("length(text) < 1000").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in langid.identify(some, model).collect():
        if not re.search(r"[^\W\d_]", texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        v = np.log1p(plain_grams(texts[r.doc_id])) * model.idf
        cos = model.vectors @ (v / max(np.linalg.norm(v), 1e-12))
        k = int(cos.argmax())
        assert math.isclose(r.score, min(1, max(0, cos[k])), abs_tol=1e-5) and r.rejected == bool(cos[k] < model.floors[k])
        assert r.lang_pred == model.langs[k] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-5


def test_samples_of_repeated_ids(spark):
    rows = [(1, "ein deutscher Text", "de"), (1, "an English text", "en"), (2, "un texto", "es"), (2, "otro texto", "es"), (3, "12", "fr"), (None, "text", "en"), (4, "text", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, langs = langid.sample_counts(d, 100)
    assert langs == ["de", "en", "es"]
    for c, t in zip(counts, ["ein deutscher Text", "an English text", "otro texto"], strict=True):
        assert (c == plain_grams(t)).all()
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, 1), (4, 7)], "doc_id long, quality int")
    model = quality_crf.fit(d, labels)
    assert isinstance(model, quality_crf.CrfModel) and all(0 <= r.score <= 1 for r in quality_crf.score(d, model).collect())


# all
def test_odd_rows(spark, odd):
    n = odd.count()
    model = quality_crf.train(*(lambda f, size, first: (f, size, first, np.array([0, 1])))(*quality_crf.line_features(next(slices(__import__("pyarrow").array(["BAD!! BAD!!\nBAD", "good text.\nmore of it."]))))))
    s = quality_crf.score(odd, model).collect()
    assert len(s) == n and all(0 <= r.score <= 1 for r in s)
    centroids = langid.fit(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    out = {r.doc_id: r for r in langid.identify(odd, centroids).collect()}
    assert len(out) == n and all(out[i].lang_pred == "und" and out[i].rejected for i in (0, 1, 2))
    assert langid.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert {r.doc_id: r.decoded for r in pieces.transcode(odd, P.path("piece_bpe_32k.model")).collect()}[4] == ODD[4]
    assert rules.assess(odd).count() == n and passages.shared_passages(odd).count() >= 0
    d = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    assert d[9].component_id == 8 and d[0].n_shingles == 0


def test_empty_tables(spark, docs):
    none = docs(["x"]).limit(0)
    path = P.path("byte_bpe_50k.json")
    assert pieces.transcode(none, P.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack(packing.tokenize(none, path)).count() == 0
    assert rules.assess(none).count() == 0 and neardup.near_duplicates(none).count() == 0 and passages.shared_passages(none).count() == 0
    assert ppm.score(none, F.lit(False)).count() == 0
    assert quality_crf.fit(none, none.select("doc_id", F.lit(1).alias("quality"))) == 0.5
    assert quality_crf.score(none, 0.5).count() == 0 and langid.identify(none, langid.fit(none)).count() == 0
    assert chroma.align(chroma.fingerprints(spark.createDataFrame([], "rec_id long, pcm binary, rate int"))).count() == 0


def test_word_kernels():
    import pyarrow as pa

    texts = ["Ab  cd\u000b\tÉx", "", None, "one", "x" * 5000 + " y", "Ab cd"]
    seen = {}
    for s in slices(pa.array(texts), most=8):
        for i in range(len(s)):
            a, b = s.word_ranges[i], s.word_ranges[i + 1]
            w = words(texts[s.first + i])
            assert b - a == len(w)
            for word, h in zip(w, s.word_hashes[a:b].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_digest_queries(spark, sf):
    one = queries.QUERIES["op1_pieces"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in one)
    two = queries.QUERIES["op2_packing"](spark, sf).collect()
    path = P.path("byte_bpe_50k.json")
    for r in two[:20]:
        ids = packing.tokenizer(path).encode(texts[r.doc_id]) + np.array([2], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])


# 11
def test_prefix_counts_equal_the_library_at_every_prefix(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(11)
    signs = [*"abcdetnis ▁\n\t<>0xA/*;\r\"'()é中", "\U0001F600", "  ", "     ", "\x00", "</s>", "<0x0A>", "the", "ing", "tion", " {", "});\r\n"]
    texts = [None, "", " ", "▁", "x" * 300, " " * 90] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [prose(rng, 60)]
    got = {r.doc_id: r.counts for r in prefixes.prefix_counts(docs(texts), path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [len(lib.encode((t or "")[:n])) for n in range(len(t or "") + 1)], t


def test_budgets_read_the_prefix_table(spark, docs):
    path = P.path("piece_bpe_32k.model")
    rng = random.Random(12)
    texts = [None, "", "é\U0001F600 中"] + [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    tables = prefixes.prefix_counts(docs(texts), path)
    counts = {r.doc_id: r.counts for r in tables.collect()}
    for budget in (0, 1, 7, 40, 10_000):
        got = {r.doc_id: r for r in prefixes.measure(docs(texts), path, budget).collect()}
        asked = {r.doc_id: r for r in tables.select("doc_id", prefixes.within_budget(budget).alias("cut"), prefixes.tokens_of(9).alias("nine")).collect()}
        for i, t in enumerate(texts):
            want = max(n for n, c in enumerate(counts[i]) if c <= budget)
            assert (got[i].cut_chars, asked[i].cut) == (want, want)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), counts[i][-1], counts[i][-1] > budget)
            assert asked[i].nine == counts[i][min(9, len(t or ""))]


def test_prefix_counts_on_odd_rows(spark, docs, odd):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = prefixes.measure(odd, path, 4096)
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    texts = [t for t in ODD if t is not Ellipsis]
    assert [r.n_tokens for r in rows] == [len(lib.encode(t or "")) for t in texts] + [0]
    assert [r.over_limit for r in rows] == [len(lib.encode(t or "")) > 4096 for t in texts] + [False]
    assert prefixes.measure(docs([]), path, 5).count() == prefixes.prefix_counts(docs([]), path).count() == 0
    assert prefixes.measure(odd.union(odd), path, 5).count() == 2 * len(ODD)


# 12
def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(hashes):
    """All levels of a tree, the leaves first."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([_hash(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _climb(tree, i, own):
    """Siblings of a leaf level by level, and the root over ``own`` in its place."""
    siblings = []
    for level in tree[:-1]:
        first = i // 16 * 16
        run = level[first : first + 16]
        siblings += run[: i - first] + run[i - first + 1 :]
        own, i = _hash(*run[: i - first], own, *run[i - first + 1 :]), i // 16
    return siblings, own


def _manifest(rows):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    digest = lambda r, text: _hash(*map(value, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((digest(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        trees.append(_tree([h for h, _ in groups[s]]))
    top = _tree([t[-1][0] for t in trees])
    for g, s in enumerate(names):
        for i, (own, r) in enumerate(groups[s]):
            now = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                now = digest(r, None if r["text"] is None else r["text"].translate(LOWER))
            below, sub = _climb(trees[g], i, now)
            above, root = _climb(top, g, sub)
            yield (r["doc_id"], own, trees[g][-1][0], top[-1][0], _hash(*below, *above), root, root == top[-1][0])


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int, index int, size int, path int"


def _rows(rng, sizes):
    out = []
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Some Text", "no capitals", "É\U0001F600", prose(rng, 5)])
            out.append({"doc_id": len(out) + 1, "text": text, "lang": rng.choice([None, "en"]), "source": s, "n_chars": rng.choice([None, 7])})
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 16}, {"a": 17}, {"a": 1, None: 2, "": 3, "é": 16, "z": 33, "hot": 600}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_equals_brute_force(spark, sizes):
    rows = _rows(random.Random(12), sizes)
    out = manifest.documents_manifest(spark.createDataFrame([(*r.values(), "x", 1, 2, 3, 4) for r in rows], DOCUMENT).repartition(5))
    assert sorted(map(tuple, out.collect())) == sorted(_manifest(rows))


def test_manifest_on_odd_rows(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text")).drop("n")
    rows = [r.asDict() for r in docs.collect()]
    for d, r in ((docs, rows), (docs.union(docs), rows + rows)):
        assert sorted(str(tuple(x)) for x in manifest.documents_manifest(d).collect()) == sorted(map(str, _manifest(r)))
    assert manifest.documents_manifest(docs.limit(0)).count() == 0


def test_frontiers_meet_after_tasks_that_see_parts():
    """Events of one tree dealt out at random: what tasks leave open is whole after they meet, whatever their order."""
    import pyarrow as pa

    rng = random.Random(5)
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(700)]
    events = [("t", 700, 0, i, h) for i, h in enumerate(leaves)]
    rng.shuffle(events)
    batch = lambda rows: pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["tree", "size", "level", "index", "digest"])
    whole, left = [], []
    for part in range(3):
        for b in manifest.combine(iter([batch(events[part::3])])):
            for r in b.to_pylist():
                (whole if r["children"] else left).append((r["tree"], r["size"], r["level"], r["index"], r["digest"]))
    found = [r for b in manifest.combine(iter([batch(left[:100]), batch(left[100:])])) for r in b.to_pylist()]
    assert all(r["children"] for r in found)
    want = _tree([h.hex() for h in leaves])
    got = {(r["level"], r["index"]): r["digest"].hex() for r in found} | {(x[2], x[3]): x[4].hex() for x in whole}
    assert got == {(k, i): h for k, level in enumerate(want) if k for i, h in enumerate(level)}


# 13
def _collocations(rows, most=2000, least=30):
    """By counting every phrase of every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if 100 * inside[lang, w] < 80 * a:
            parts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(parts))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, best in out.items() for i, (s, a, p, l, r) in enumerate(sorted(best)[:most], 1)]


def _phrase_rows(seed):
    rng = random.Random(seed)
    words = [*"abcdefg", "É", "B", "x\x00y", "\x1f", "c\x0bd"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(rng.randint(0, 60)))
    fixed = ["new york city hall", "new york", "of the day"]
    return [(rng.choice([None, "en", "de", "und"]), rng.choice([None, "", text(), text(), text() + " " + rng.choice(fixed), rng.choice(fixed)])) for _ in range(1500)]


@pytest.mark.parametrize("most", [2000, 7])
def test_collocations_equal_brute_force(spark, most):
    rows = _phrase_rows(13)
    docs = spark.createDataFrame([(i, t, x, 1, 2) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, f long, phrase int").repartition(7)
    got = collocations.collocations(docs, most=most)
    want = _collocations(rows, most)
    assert len(want) > 20 and {r[0] for r in want} == {"en", "de", "und"}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_words_of_shards_without_their_frequent_pairs(spark):
    """A part counts in every shard, also where the shard has it in no frequent pair."""
    rows = [("en", "new york. " * 40)] * 2 + [("en", f"new{i} york, york x{i}. y{i} new z{i}") for i in range(50)] + [(None, "york; new")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(9, "doc_id")
    got = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert got == sorted(_collocations(rows)) == [("en", 1, "new york", 80, 130, 180, 510, 516_129)]


def test_collocations_on_odd_rows(spark, odd, docs):
    got = collocations.collocations(odd)
    assert sorted(map(tuple, got.collect())) == sorted(_collocations([(r.lang, r.text) for r in odd.collect()]))
    assert collocations.collocations(docs([])).count() == collocations.collocations(docs([None, "", "one word"])).count() == 0
    many = docs(["to be or not"] * 20)
    assert collocations.collocations(many).count() == 0
    assert [tuple(r)[2:] for r in collocations.collocations(many.union(many)).collect()] == [("to be or not", 40, 40, 40, 160, 1_000_000)]


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = _phrase_rows(14)
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    monkeypatch.setattr(collocations, "BITS", 64)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == sorted(_collocations(rows))


def test_the_automaton_equals_one_built_word_by_word():
    """States, endpos counts and suffix links against the online construction, whose substrings are cut off at four words."""
    rng = random.Random(15)
    for _ in range(60):
        runs = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 6))]
        places = defaultdict(set)
        at = 0
        for run in runs:
            for i in range(len(run)):
                for m in range(1, min(4, i + 1) + 1):
                    places[tuple(run[i + 1 - m : i + 1])].add(at + i)
            at += len(run)
        classes = defaultdict(list)
        for w, p in places.items():
            classes[frozenset(p)].append(w)
        want = sorted((max(ws, key=len), min(map(len, ws)), len(p)) for p, ws in classes.items())
        flat = [w for run in runs for w in run]
        begins = np.array([i == 0 for run in runs for i in range(len(run))])
        a = collocations.Automaton(np.array(flat, np.uint64), begins, 4, {})
        got = [(tuple(flat[e + 1 - m : e + 1]), int(s), int(c)) for m, level in enumerate(a.states(), 1) for e, c, s in zip(*level, strict=True)]
        assert sorted(got) == want
        for m in range(1, 4):
            for e, link in zip(a.ends[m], a.links[m], strict=True):
                assert link == a.ids[m - 1][e]
