"""A training corpus from raw documents: each stage works on all that the one before it kept.

Handling: stages decide by row, told by doc_id and a hash of the text (the first also by language and source). Null doc_ids are one id. Rows
without words go in the first stage. Rows that repeat both id and text are judged alike; the second stage keeps one of them, as of any
group. An empty table passes through. Columns beyond doc_id, text, lang, source and n_chars are kept as they are, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import contamination, jaccard, mixing, quality, secrets
from marketloom.llm.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links join stays: the one with the smallest id."""
    return jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth or more is benchmark text go."""
    found = contamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=0, with_row=True)
    return found.where("NOT contaminated").select("row.*")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are put out of texts; rows stay."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows chosen to the target weights, with how often each is taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", source_mix),
]

#: The last stage's order is by Spark's own hash, which SQL can't state; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
