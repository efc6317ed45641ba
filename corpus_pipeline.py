"""Documents to packed training sequences in stages, each a table that the next one reads.

Every stage but the last returns the columns of documents. A stage judges what its predecessor
kept: models are fitted on these rows, copies are found among them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from skein.llm import langid, packing, passages, quality_crf
from skein.llm.neardup import near_duplicates
from skein.llm.shared import cut, documents, unused

#: Line labels, centroids, sketches, passages and token ids are beyond SQL.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents that the classifier takes for bad go. It learns from the labels of the documents that are there; without labels all stay."""
    model = quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs if isinstance(model, float) else quality_crf.keep_good(docs, model)


def language(spark, docs, sf_dir):
    """Documents without a letter or far from every known language go; where no language is known all stay."""
    model = langid.fit(docs)
    return docs if model is None else langid.keep_known(docs, model)


def minhash(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, the one with the smallest doc_id. Rows with a null doc_id stay, rows that repeat a doc_id stay or go together."""
    gone = unused(docs, "gone")
    ids = near_duplicates(docs, 80).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, docs["doc_id"] == ids[gone], "left_anti")


def substring(spark, docs, sf_dir):
    """Passages that a smaller doc_id has too are cut out; n_chars follows the text. Documents of which no word is left go."""
    found = cut(passages.shared_passages(docs), "passages")
    hit = unused(docs, "hit")
    out = passages.without_passages(docs.withColumn(hit, F.lit(False)), found, hit_col=hit)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hit), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.where(~F.coalesce(F.col(hit) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(docs.columns)


def pack(spark, docs, sf_dir):
    """Sequences of 1,024 tokens: a row per piece of a document with its ids, its sequence and its place there."""
    cut_up = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut_up).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("minhash near-dedup", minhash),
    ("substring dedup", substring),
    ("best-fit packing", pack),
]


def run(spark, sf_dir):
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
