"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import token_alignment
from .bpe import bpe_documents
from .common import load
from .divergence import divergence_sql, source_divergence
from .fingerprints import fingerprints
from .media import media_columns
from .mixing import mixing_rates
from .pivots import top_scores, top_scores_sql
from .quality import quality, train
from .rollups import token_counts
from .secrets import secret_spans
from .simhash import near_duplicates
from .substrings import substring_dedup
from .urls import url_filter, url_sql


def _quality(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return quality(docs, train(docs, load(spark, sf_dir, "labels")))


def queries() -> dict:
    return {
        "op1_bpe": lambda spark, sf_dir: bpe_documents(load(spark, sf_dir, "documents")),
        "op2_substring_dedup": lambda spark, sf_dir: substring_dedup(load(spark, sf_dir, "documents"), with_text=False).drop("kept"),
        "op3_url_filters": lambda spark, sf_dir: url_filter(load(spark, sf_dir, "pages")),
        "op4_fingerprints": lambda spark, sf_dir: fingerprints(load(spark, sf_dir, "documents")),
        "op5_token_counts": lambda spark, sf_dir: token_counts(load(spark, sf_dir, "documents")),
        "op6_secret_scan": lambda spark, sf_dir: secret_spans(load(spark, sf_dir, "documents")),
        "op7_media_columns": lambda spark, sf_dir: media_columns(load(spark, sf_dir, "documents")),
        "op8_quality_classifier": _quality,
        "op9_mixing": lambda spark, sf_dir: mixing_rates(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")),
        "op10_simhash_dedup": lambda spark, sf_dir: near_duplicates(load(spark, sf_dir, "documents")),
        "op11_pivot_search": lambda spark, sf_dir: top_scores(load(spark, sf_dir, "embeddings")),
        "op12_token_alignment": lambda spark, sf_dir: token_alignment(load(spark, sf_dir, "documents")),
        "op13_source_divergence": lambda spark, sf_dir: source_divergence(load(spark, sf_dir, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": url_sql(), "op11_pivot_search": top_scores_sql(), "op13_source_divergence": divergence_sql()}
