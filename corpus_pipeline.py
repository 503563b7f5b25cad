"""A corpus pipeline of five stages: language, repeated lines, near-duplicates, source mix, token ids.

Each stage gets what its predecessor kept, written as Parquet and read again; all but the last return the columns of
``documents``. ``run`` applies them to a whole table.

Defined results: documents of null or empty text, or without a letter, go in the first stage; null ids, languages and sources are values like
others; rows that repeat id and text lose no line to each other but are near-duplicates, of which one stays; extra columns are kept, whatever
their names, until the last stage; an empty table gives an empty result of the last stage's columns. The stages' tables are in the shared folder
until the last stage is read; those of the others are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewise.llm import bpe, langid, lines, minhash, mixing
from tidewise.llm.shared import delete, shared_dir, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language that holds two fifths of their words, go."""
    return langid.keep_identified(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzily repeated lines go but for one occurrence; a document of nothing else goes."""
    return lines.dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity of 0.8 or more) the one of the smallest id stays."""
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that the sources meet their target weights."""
    return mixing.mix_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the encoded and decoded text of each row."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", identified),
    ("line dedup", without_repeated_lines),
    ("minhash near-dedup", one_of_each_group),
    ("source mix", mixed),
    ("byte bpe", encoded),
]

#: Learned models, connected components and token ids aren't expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        after.write.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
        docs = spark.read.schema(after.schema).parquet(f"{folder}/{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
