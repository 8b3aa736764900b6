"""The queries of this package, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, langid, license, media, mixing, ngram_join, pii, quality, substring, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1,
    "op2_media_chunks": media.op2,
    "op3_token_counts": token_counts.op3,
    "op4_line_dedup": substring.op4,
    "op4_passage_dedup": substring.op4_passages,
    "op5_license_scan": license.op5,
    "op6_pii_pseudonyms": pii.op6,
    "op7_language_id": langid.op7,
    "op8_quality_resampling": quality.op8,
    "op9_ngram_jaccard_join": ngram_join.op9,
    "op9_jaccard_pairs": ngram_join.op9_pairs,
    "op10_benchmark_decontamination": decontam.op10,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op4_line_dedup": substring.OP4_SQL,
}
