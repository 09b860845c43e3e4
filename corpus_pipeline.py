"""From raw documents to packed training sequences, in five stages.

Toxic documents go, then exact copies, then near copies (one of each group stays); secrets are masked in what is left, and that is
tokenised and packed. Each stage is written as Parquet and read again as the next one's input.

All stages take null and empty texts, nulls in any column, repeated rows, empty tables and further columns of any name (but for the columns that packing
adds); what becomes of them is said with each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm.common import documents, written
from factorloom.llm.exact import keep_first_copies
from factorloom.llm.neardup import keep_one_of_each
from factorloom.llm.packing import pack_documents
from factorloom.llm.queries import tokenizer_file
from factorloom.llm.secrets import redact_secrets
from factorloom.llm.toxicity import fit, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents graded toxic by a model fitted on the labelled ones; null labels teach nothing, and without usable labels none goes."""
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 similarity of five-word shingles the one with the least doc_id stays."""
    return keep_one_of_each(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The toxicity model, the MinHash tables and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
