"""Registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadcast.llm import chat, jaccard, licenses, lines, lloyd, mixing, packing, pipeline, quality, sharding, spelling, topk, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline.run,
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_curriculum_mix": mixing.op5_curriculum_mix,
    "op6_embedding_near_dedup": vectors.op6_embedding_near_dedup,
    "op7_balanced_shards": sharding.op7_balanced_shards,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_site_line_dedup": lines.op9_site_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_centroid_clustering": lloyd.op11_centroid_clustering,
    "op12_chat_formatting": chat.op12_chat_formatting,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op1_license_scan": licenses.op1_sql(),
    "op4_exact_top_k": topk.op4_sql(),
    "op9_site_line_dedup": lines.op9_sql(),
    "op11_centroid_clustering": lloyd.op11_sql(),
    "op12_chat_formatting": chat.op12_sql(),
    "op13_spelling_variants": spelling.op13_sql(),
}
