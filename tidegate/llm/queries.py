"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ball_tree, bpe, html_template, jaccard_join, language_id, lm_score, mixing, mpeg, oracles, phrases, quality, suffix_dedup, token_count, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_bpe_encoding(spark, sf_dir):
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_lm_scoring(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_media_columns(spark, sf_dir):
    out = mpeg.media_digests(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.to_json(c) for c in ("frame_offsets", "tags")})


def op7_warc_fixity(spark, sf_dir):
    return warc.fixity(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark, sf_dir):
    return html_template.main_text(table(spark, sf_dir, "pages"))


def op9_mixing_sources(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op11_token_counts(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_centroid_clustering(spark, sf_dir):
    return ball_tree.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    return {
        "op2_ngram_jaccard_join": oracles.JACCARD, "op5_quality_rules": oracles.quality_sql(), "op6_media_columns": oracles.media_sql(), "op7_warc_fixity": oracles.fixity_sql(), "op9_mixing_sources": mixing.ORACLE,
        "op10_suffix_array_dedup": oracles.PASSAGES, "op12_centroid_clustering": oracles.clusters_sql(),
        "op13_phrase_collocations": phrases.ORACLE
    }
