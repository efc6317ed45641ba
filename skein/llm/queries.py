"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chroma, collocations, langid, manifest, neardup, packing, passages, pieces, ppm, prefixes, quality_crf, rules, toolcalls
from .shared import documents

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op9_minhash(spark, sf_dir):
    """Near-duplicate classes at 85 per cent of the union."""
    return neardup.near_duplicates(documents(spark, sf_dir), 85)


@_query
def op1_pieces(spark, sf_dir):
    """Ids of every whole text by the 32k piece model and the text they decode to, as digests."""
    out = pieces.transcode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@_query
def op2_packing(spark, sf_dir):
    """All documents, tokenised, in sequences of 1,024 tokens."""
    cut_up = packing.tokenize(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(packing.digests(cut_up)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op3_rules(spark, sf_dir):
    """Counts and verdict of the quality rules for every whole text."""
    out = rules.assess(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL["op3_rules"] = rules.sql()


@_query
def op4_quality(spark, sf_dir):
    """Quality of every whole text, learned from the labelled rows of two folds of three."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_crf.fit(docs, labels.where(quality_crf.fold(3) != 1))
    out = quality_crf.score(docs, model)
    return out.select("doc_id", (quality_crf.fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op10_language(spark, sf_dir):
    """Language of every whole text, learned from four folds of five."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(quality_crf.fold(5) != 0))
    return langid.identify(docs, model).select("doc_id", (quality_crf.fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@_query
def op5_passages(spark, sf_dir):
    """Passages of 50 or more words that documents share, each with a smaller document that has it (of equal passages the smallest), and the class of both: the smallest document that chains of passages reach."""
    return passages.with_classes(passages.shared_passages(documents(spark, sf_dir)))


@_query
def op6_ppm(spark, sf_dir):
    """Scores of every whole text, learned from four folds of five."""
    return ppm.score(documents(spark, sf_dir), quality_crf.fold(5) == 1)


@_query
def op7_chroma(spark, sf_dir):
    """Fingerprints of the vectors rendered as tones in two takes, the second later and noisy, aligned with one another."""
    takes = chroma.tones(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), takes=2)
    out = chroma.align(chroma.fingerprints(takes.withColumn("rec_id", F.col("rec_id") * 2 + F.col("take"))))
    of = lambda c: F.shiftright(c, 1)
    return out.select(
        of("rec_id").alias("vec_id"), F.pmod("rec_id", F.lit(2)).cast("int").alias("take"), "n_frames", of("class_id").alias("class_id"), of("component_id").alias("component_id"),
        of("match_id").alias("match_id"), "offset", "bit_error")


@_query
def op8_toolcalls(spark, sf_dir):
    """Every assistant turn as a call, with the turn after it as its result."""
    calls, results = toolcalls.of_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = toolcalls.link_calls(calls, results, toolcalls.RESPOND)
    return out.select("conv_id", "turn", "call_id", "name", "copies", "linked", "level", F.array_join("errors", "; ").alias("errors"), "json")


@_query
def op11_prefix_counts(spark, sf_dir):
    """Tokens of every whole text by the 32k piece model, and where a text over 4,096 tokens would be cut."""
    return prefixes.measure(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@_query
def op12_manifest(spark, sf_dir):
    """A Merkle tree per source and one over the sources; each row's proof, checked against the rows as they are found now."""
    return manifest.documents_manifest(documents(spark, sf_dir))


ORACLE_SQL["op12_manifest"] = manifest.sql()

@_query
def op13_collocations(spark, sf_dir):
    """The 2,000 best phrases of each language."""
    return collocations.collocations(documents(spark, sf_dir))


ORACLE_SQL["op13_collocations"] = collocations.sql()

ORACLE_SQL["op8_toolcalls"] = """
with recursive c as (select *, length(text) as n, conv_id::varchar || '-' || turn::varchar as call_id,
    case when length(text) % 13 = 0 then conv_id::varchar || '-' || (turn + 2)::varchar when turn >= 3 then conv_id::varchar || '-' || (turn - 2)::varchar end as after
    from conversations where role = 'assistant'),
r as (select conv_id::varchar || '-' || (turn - 1)::varchar as call_id, min(text) as result
    from conversations where role <> 'assistant' and conv_id is not null and turn is not null group by 1),
n as (select call_id, count(*) as copies from c group by 1),
e as (select distinct c.call_id, c.after, c.conv_id from c where c.call_id is not null and c.after in (select call_id from c where call_id is not null)),
size as (select conv_id, count(*) as calls from e group by 1),
walk as (select call_id, after as at, conv_id, 1 as steps from e
    union select w.call_id, e.after, w.conv_id, w.steps + 1 from walk w join e on e.call_id = w.at join size s on s.conv_id = w.conv_id where w.steps <= s.calls),
depth as (select call_id, max(steps) as level, max(steps) > any_value(calls) as endless from walk join size using (conv_id) group by 1)
select c.conv_id, c.turn, c.call_id, 'respond' as name, coalesce(n.copies, 1) as copies, r.result is not null as linked,
    case when c.call_id is null or endless then null else coalesce(level, 0) end as level,
    concat_ws('; ', case when c.text is null then 'chars is missing' when c.n % 7 = 0 then 'chars is no integer' end, case when c.text is null then 'text is missing' end,
        case when c.after is not null and c.call_id is not null and c.after not in (select call_id from c where call_id is not null) then 'waits for unknown: ' || c.after end) as errors,
    '{"arguments":' || case when c.text is null then '{}' else '{"chars":' || case when c.n % 7 = 0 then '"' || c.n::varchar || '"' else c.n::varchar end || ',"text":' || to_json(c.text)::varchar || '}' end
        || ',"id":' || coalesce('"' || c.call_id || '"', 'null') || ',"name":"respond","result":' || coalesce(to_json(r.result)::varchar, 'null') || '}' as json
from c left join n using (call_id) left join r using (call_id) left join depth using (call_id)
"""
