"""The queries of this subpackage: thin, each over its whole tables; SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, itq, langid, lines, lsh, minhash, mixing, shard, tokenfile, toxic
from .shared import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_prediction(table(spark, sf_dir, "documents"))


def op2_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("rid", "comp")


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, of every document."""
    return lines.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_multiprobe_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.sharded(table(spark, sf_dir, "documents"), shards=8)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op9_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_minmax_hash, op3_fuzzy_lines, op4_itq_near_vectors, op5_multiprobe_nearest, op6_byte_bpe, op7_feistel_shards, op8_token_files, op9_water_filling, op10_toxicity)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_minmax_hash": minhash.ORACLE, "op4_itq_near_vectors": itq.ORACLE, "op9_water_filling": mixing.ORACLE}
