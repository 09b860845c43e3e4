"""One query for each text operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip_report
from .centroids import cluster_report, cluster_sql
from .common import documents
from .exact import exact_dedup
from .language import language_report
from .lines import line_report
from .middles import SQL as MIDDLE_SQL
from .middles import middle_report
from .neardup import near_dedup
from .packing import pack_documents
from .prints import fingerprint_edits
from .secrets import secret_report
from .substrings import repeat_report
from .tokenfile import token_report
from .toxicity import toxicity_report


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda spark, sf_dir: language_report(documents(spark, sf_dir)),
        "op2_secret_scan": lambda spark, sf_dir: secret_report(documents(spark, sf_dir)),
        "op3_exact_dedup": lambda spark, sf_dir: exact_dedup(documents(spark, sf_dir)),
        "op4_bpe_round_trip": lambda spark, sf_dir: round_trip_report(documents(spark, sf_dir), tokenizer_file()),
        "op5_suffix_dedup": lambda spark, sf_dir: repeat_report(documents(spark, sf_dir)),
        "op6_toxicity": lambda spark, sf_dir: toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op7_line_dedup": lambda spark, sf_dir: line_report(documents(spark, sf_dir)),
        "op8_best_fit_packing": lambda spark, sf_dir: pack_documents(documents(spark, sf_dir), tokenizer_file()),
        "op9_minhash_near_dedup": lambda spark, sf_dir: near_dedup(documents(spark, sf_dir), width=4, percent=80),
        "op10_fingerprints": lambda spark, sf_dir: fingerprint_edits(documents(spark, sf_dir)),
        "op11_token_output": lambda spark, sf_dir: token_report(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json")),
        "op12_centroid_clustering": lambda spark, sf_dir: cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op13_fill_in_middle": lambda spark, sf_dir: middle_report(documents(spark, sf_dir)),
    }


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": EXACT_SQL, "op12_centroid_clustering": cluster_sql(), "op13_fill_in_middle": MIDDLE_SQL}
