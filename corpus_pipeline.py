"""A training-data pipeline in five stages, each an operator of reportloom.llm over all that the stage before kept.

Every stage takes an empty table and returns one, keeps all columns of documents whatever their names (the last returns its own), and treats rows that
repeat an id and a text alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from reportloom.llm.common import cut, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy (v2) rejects go; null and empty texts are among them. A row is judged by itself, so repeated rows go or stay together."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go from the texts, and documents of which no word is left. The first place by id stays; null ids come last. A null text stays as it is."""
    return line_dedup.drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, with rows that repeat its id and text; documents without a word all stay."""
    return jaccard_join.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null texts and an empty benchmark contaminate nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and a hash of the bytes they decode to. A null text has none."""
    coded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near), ("benchmark decontamination", benchmark), ("byte-level BPE", encode)]

#: Near copies and byte-pair merges are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again. The result reads those tables: once it is written, reportloom.llm.common.release deletes them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not encode:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
