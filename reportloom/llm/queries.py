"""The training-data queries, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from . import bpe, decontaminate, hilbert, jaccard_join, language_id, license_scan, line_dedup, merkle, packing, quality_model, quality_rules, secret_scan, whitening
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def queries() -> dict:
    return {
        "op1_secret_scan": lambda spark, d: secret_scan.secret_digest(table(spark, d, "documents")),
        "op2_decontaminate": lambda spark, d: decontaminate.contamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op3_license_scan": lambda spark, d: license_scan.license_digest(table(spark, d, "documents")),
        "op4_line_dedup": lambda spark, d: line_dedup.dedup_digest(table(spark, d, "documents")),
        "op5_hilbert_shards": lambda spark, d: hilbert.shard_documents(table(spark, d, "documents")),
        "op6_bpe": lambda spark, d: bpe.token_digest(table(spark, d, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN),
        "op7_quality_rules": lambda spark, d: quality_rules.quality_verdicts(table(spark, d, "documents")),
        "op8_language_id": lambda spark, d: language_id.language_predictions(table(spark, d, "documents")),
        "op9_quality_model": lambda spark, d: quality_model.quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_jaccard_join": lambda spark, d: jaccard_join.near_digest(table(spark, d, "documents")),
        "op11_whitening": lambda spark, d: whitening.whitening_digest(table(spark, d, "embeddings")),
        "op12_packing": lambda spark, d: packing.packing_digest(table(spark, d, "documents"), public_tokenizers.path(WORDS)),
        "op13_merkle_manifest": lambda spark, d: merkle.manifest_digest(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.DIGEST_SQL, "op4_line_dedup": line_dedup.DIGEST_SQL, "op7_quality_rules": quality_rules.VERDICTS_SQL, "op13_merkle_manifest": merkle.DIGEST_SQL}
