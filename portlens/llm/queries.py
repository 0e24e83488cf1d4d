"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portlens.llm import ann, bpe, interaction, langid, licenses, linededup, lm, packing, quality, simhash, toxicity, urls, whitening
from portlens.llm.common import read_table, stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone and together: the ledger is stored once and counted by its bits."""
    return quality.ablation(stored(quality.ledger(read_table(spark, sf_dir, "documents")), "ledger"))


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_report(read_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, langid.train_rows()))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = interaction.failure_masks(read_table(spark, sf_dir, "documents"))
    return interaction.audit(interaction.mask_counts(masks, read_table(spark, sf_dir, "labels"))).drop("nodes")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), urls.fit(urls.labelled_urls(spark))).drop("score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_ledger, op2_license_digests, op3_bpe_automaton, op4_packing, op5_simhash_near_dedup, op6_line_dedup, op7_cross_polytope_ann, op8_language_id, op9_toxicity, op10_lm_score, op11_whitening, op12_filter_audit, op13_url_filters, pipeline, quality_ablation)}

#: DuckDB SQL where SQL expresses the operator over whole tables.
ORACLE_SQL = {"quality_ablation": quality.ablation_sql(), "op2_license_digests": licenses.scan_sql(), "op12_filter_audit": interaction.audit_sql(), "op13_url_filters": urls.judge_sql()}
