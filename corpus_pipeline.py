"""The corpus pipeline: five operators of quireworks.llm, one after another over `documents`.

Quality rules drop junk, exact and near copies go but for one document of each group, secrets are masked in the texts that
stay, and the rest is tokenised and packed. Each stage's rows are written and read again, so a stage starts from a table
and a lost executor never costs an earlier stage.

Defined cases: a null or empty text is too short for the quality rules and goes; of equal texts and of rows repeated with one doc_id one row stays;
a row with a null doc_id stays unless an equal text has a doc_id, takes no part in the join of near copies, and is packed under a null
doc_id; an empty table gives no pieces. Extra columns, whatever their names, are carried up to the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quireworks.llm import exact_dedup, hilbert_packing, jaccard_join, quality_rules, secret_scan
from quireworks.llm.common import materialised, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.filter_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.fitted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("secret scans", secrets), ("packing", packing)]

#: Neither the forest of the secret scan nor the tokenizer can be put in SQL; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialised(docs, "stage")
    return docs
