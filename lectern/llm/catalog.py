"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroid_clusters, decontaminate, jaccard_join, language_id, license_scan, mixing, periodic_runs, quality_classifier, quality_rules, secret_scan, suffix_dedup, super_minhash, token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_language_id": language_id.op2_language_id,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_shards": token_shards.op4_token_shards,
    "op5_mixing": mixing.op5_mixing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_super_minhash": super_minhash.op11_super_minhash,
    "op12_centroid_clusters": centroid_clusters.op12_centroid_clusters,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_license_scan": license_scan.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_secret_scan": secret_scan.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_super_minhash": super_minhash.SQL,
    "op12_centroid_clusters": centroid_clusters.SQL,
    "op13_periodic_runs": periodic_runs.SQL,
}
