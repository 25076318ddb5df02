"""The registered training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import (
    byte_bpe, exact_dedup, fill_middle, html_text, near_dup, packing, periodic, quality, quality_model, secret_scan, token_counts, toxicity, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_text": html_text.op3_html_text,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_quality_model": quality_model.op12_quality_model,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
SQL: dict[str, str] = {"op4_url_filter": url_filter.SQL, "op10_exact_dedup": exact_dedup.SQL, "op13_fill_middle": fill_middle.SQL}
