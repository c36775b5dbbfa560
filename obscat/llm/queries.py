"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bloom_lm, curriculum_mix, exact_fingerprint, partenum_join, pii_bootstrap, prefix_fingerprint, rank_bpe, subword_quality, suffix_dedup, warc_segments
from .common import table


def op1_pii_bootstrap(spark, sf_dir):
    return pii_bootstrap.personal_data(table(spark, sf_dir, "documents"))


def op2_subword_quality(spark, sf_dir):
    return subword_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_segments(spark, sf_dir):
    return warc_segments.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark, sf_dir):
    return exact_fingerprint.exact_dedup(table(spark, sf_dir, "documents"))


def op5_curriculum_mix(spark, sf_dir):
    return curriculum_mix.mix_report(table(spark, sf_dir, "documents"))


def op6_prefix_fingerprint(spark, sf_dir):
    return prefix_fingerprint.document_fingerprints(table(spark, sf_dir, "documents"))


def op7_partenum_join(spark, sf_dir):
    return partenum_join.similar_documents(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_bloom_lm(spark, sf_dir):
    return bloom_lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_rank_bpe(spark, sf_dir):
    return rank_bpe.bpe_digests(table(spark, sf_dir, "documents"), rank_bpe.vocabulary("word_bpe_49k.json"))


QUERIES = {
    "op1_pii_bootstrap": op1_pii_bootstrap,
    "op2_subword_quality": op2_subword_quality,
    "op3_warc_segments": op3_warc_segments,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_curriculum_mix": op5_curriculum_mix,
    "op6_prefix_fingerprint": op6_prefix_fingerprint,
    "op7_partenum_join": op7_partenum_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_bloom_lm": op9_bloom_lm,
    "op10_rank_bpe": op10_rank_bpe,
}
ORACLE = {
    "op3_warc_segments": warc_segments.ORACLE,
    "op4_exact_dedup": exact_fingerprint.ORACLE,
    "op5_curriculum_mix": curriculum_mix.ORACLE,
}
