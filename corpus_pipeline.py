"""A corpus from raw documents: quality, near copies, benchmark passages, personal data, packing. Each stage works on all that the one before kept.

| stage | operator | what it does to `documents` |
|---|---|---|
| quality | quality classifier | rejected documents go |
| near_copies | fingerprints searched by BK-trees in shards; five-word shingles, Jaccard similarity of 0.8 or more | one document of each group stays, that of the smallest doc_id |
| decontaminate | spaced-seed hashing | documents that hold a benchmark passage go |
| pii | patterns, checksums, context | spans of personal data are masked in the text |
| pack | pattern packing | the places of all token pieces in sequences |

All stages but the last return the columns of `documents`. Null and empty texts go through every stage like any other text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import decontam, packing, pii, quality, resemblance
from tapeloom.llm.common import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resemblance.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good), ("near_copies", drop_copies), ("decontaminate", decontaminate), ("pii", mask_personal_data), ("pack", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over `documents`; between stages the documents are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
