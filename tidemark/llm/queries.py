"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    alignment,
    decontaminate,
    katz,
    lengths,
    near_join,
    packing,
    quality,
    secret_scan,
    shard_shuffle,
    site_tree,
    spelling,
    substring_dedup,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_benchmark_decontamination": lambda s, d: decontaminate.report(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op2_url_filter": lambda s, d: url_filter.report(_table(s, d, "pages")),
    "op3_quality_rules": lambda s, d: quality.report(_table(s, d, "documents"), _table(s, d, "labels")),
    "op4_secret_scan": lambda s, d: secret_scan.report(_table(s, d, "documents")),
    "op5_external_shuffle": lambda s, d: shard_shuffle.report(_table(s, d, "documents")),
    "op6_chosen_path_join": lambda s, d: near_join.report(_table(s, d, "documents")),
    "op7_katz_scores": lambda s, d: katz.report(_table(s, d, "documents")),
    "op8_site_style_tree": lambda s, d: site_tree.report(_table(s, d, "pages")),
    "op9_length_histogram": lambda s, d: lengths.report(_table(s, d, "documents")),
    "op10_bin_slack_packing": lambda s, d: packing.report(_table(s, d, "documents")),
    "op11_reduced_alphabet": lambda s, d: spelling.report(_table(s, d, "documents")),
    "op12_fixed_block_anchors": lambda s, d: substring_dedup.report(_table(s, d, "documents")),
    "op13_cross_tokenizer_alignment": lambda s, d: alignment.report(_table(s, d, "documents")),
}

ORACLES: dict[str, str] = {}
