"""Thin queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortkit.llm import ann, embdedup, jaccard, lm, mixing, sharding, substrings
from sortkit.llm.common import crc_mod, read_table


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sortkit.llm import bpe

    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), mixing.document_margins())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cover(read_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortkit.llm import langid

    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, langid.fit(docs.where(crc_mod("doc_id", 4) != 2)), "doc_id", "text", held_out)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortkit.llm import toxicity

    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))


def op8_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_substrings": op3_substrings,
    "op4_langid": op4_langid,
    "op5_bpe": op5_bpe,
    "op6_lm": op6_lm,
    "op7_jaccard": op7_jaccard,
    "op8_embdedup": op8_embdedup,
    "op9_toxicity": op9_toxicity,
    "op10_ann": op10_ann,
}

#: DuckDB SQL, for those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.oracle_sql(),
    "op2_sharding": sharding.ORACLE_SQL,
    "op3_substrings": substrings.ORACLE_SQL,
}
