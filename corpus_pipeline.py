"""The corpus pipeline: documents through five of the operators, each stage stored before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontamination, near_dups, queries, secret_scans, toxicity
from trackloom.llm.common import free, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts stay, repeated rows go or stay together, and all columns stay as they are."""
    out = free("toxicity", docs.columns)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs, model, out=out)
    return judged.where(F.col(out)["score"] < toxicity.Settings().threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest id; rows without words stay, those with a null text too.

    Rows go, not ids: a text of its own stays though its id also names a copy. Of rows that are equal throughout one stays.
    """
    return near_dups.survivors(docs, near_dups.Settings(words=5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay, repeated rows go or stay together, and all columns stay as they are."""
    out = free("leaks", docs.columns)
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.where(F.size(out) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; n_chars, if there is such a column, follows a text that changes. No row goes; null texts stay null."""
    out = free("secret_spans", docs.columns)
    found = secret_scans.redact(secret_scans.scan_secrets(docs, out=out), spans=out)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(out) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_ids and round_trip, in place of columns of these names. No row goes; null texts have no ids."""
    return queries.encoded(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("sentencepiece", encoding_stage),
]
#: SQL can express neither the learned scores nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
