"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.  A null text counts as empty in every stage; the substring stage writes it as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortkit.llm import bpe, jaccard, mixing, substrings, toxicity
from sortkit.llm.common import crc_mod, ensure_checkpoint_dir, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, *(F.col(c) for c in COLUMNS[1:]))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    placed = jaccard.near_duplicates(docs)
    gone = placed.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut; a document with nothing left goes."""
    cleaned = substrings.cover(docs, with_text=True, carry=("lang", "source"))
    kept = cleaned.where("n_removed < n_words or n_words = 0")
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to tempered source, language and topic marginals."""
    return mixing.sample(docs, mixing.document_margins()).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of the decoded text."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Nearest neighbours can't be told in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
