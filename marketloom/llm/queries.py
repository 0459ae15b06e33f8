"""Queries of the pipeline's operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, contamination, jaccard, licenses, mixing, negatives, quality, repeats, secrets, spelling, sql, topk, urls, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir)).drop("blocks")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_docs(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_pages(spark, sf_dir)).drop("via")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "domain", "lang", "source", "n_tokens", "epochs")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "n_near", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(_docs(spark, sf_dir))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("findings", lambda s: s["ord"] < len(secrets.BASE))
    counts = [F.expr(f"cast(size(filter(findings, s -> s.kind = '{k}')) as long) AS n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown("findings").alias("spans"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return classifier.score(docs, classifier.fit(docs))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    noisy = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    found = negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec_id % 50 == 0, noisy, scale=256)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long"), F.col("negative_score").cast("long"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5, scale=256)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_license_scan, op3_jaccard_join, op4_quality_rules, op5_url_filter, op6_warc_round_trip, op7_source_mix, op8_decontamination,
        op9_secret_scan, op10_quality_classifier, op11_spelling_variants, op12_hard_negatives, op13_exact_top_k,
    )
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": sql.OP1, "op2_license_scan": sql.OP2, "op3_jaccard_join": sql.OP3, "op4_quality_rules": sql.OP4, "op6_warc_round_trip": sql.OP6,
    "op8_decontamination": sql.OP8, "op9_secret_scan": sql.OP9, "op11_spelling_variants": sql.OP11, "op12_hard_negatives": sql.OP12,
    "op13_exact_top_k": sql.OP13,
}
