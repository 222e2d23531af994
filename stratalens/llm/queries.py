"""The registered queries of the corpus operators: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import html, infill, lengths, lm, mixing, packing, pii, quality, resampling, simhash, spotsigs, suffixes, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op2_suffix_array_dedup(spark, sf_dir):
    found = suffixes.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("first").alias("first_copy"), "text_hash")


def op3_best_fit_packing(spark, sf_dir):
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op4_quality_rules(spark, sf_dir):
    judged = quality.host_verdicts(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), *quality.MEASURES, F.col("failed").alias("base_failed"), "kept")


def op5_mix_sources(spark, sf_dir):
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_html_extraction(spark, sf_dir):
    return html.visible_text(_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text")


def op7_token_counts(spark, sf_dir):
    return lengths.limits(lengths.histogram(_table(spark, sf_dir, "documents")))


def op8_personal_data(spark, sf_dir):
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.RULED)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_lm_scoring(spark, sf_dir):
    scored = lm.score(_table(spark, sf_dir, "documents"))
    return scored.withColumnRenamed("id", "doc_id")


def op10_exact_top_k(spark, sf_dir):
    found = topk.top_k(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")


def op11_importance_resampling(spark, sf_dir):
    drawn = resampling.importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_document_fingerprints(spark, sf_dir):
    found = spotsigs.compared_with_next(_table(spark, sf_dir, "documents"))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *hexed, "near_edited", "near_next")


def op13_fill_in_middle(spark, sf_dir):
    written = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    text = infill.restored(F.col("output"), F.col("form"))
    return written.select(F.col("id").alias("doc_id"), "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_suffix_array_dedup, op3_best_fit_packing, op4_quality_rules, op5_mix_sources, op6_html_extraction, op7_token_counts, op8_personal_data, op9_lm_scoring, op10_exact_top_k, op11_importance_resampling, op12_document_fingerprints, op13_fill_in_middle)}
ORACLES = {"op4_quality_rules": quality.ORACLE, "op5_mix_sources": mixing.ORACLE, "op10_exact_top_k": topk.ORACLE, "op11_importance_resampling": resampling.ORACLE, "op13_fill_in_middle": infill.ORACLE}
