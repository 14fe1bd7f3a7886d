"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import centroids, chat_format, decontamination, hard_negatives, license_scans, near_dups, oracles, pieces, quality_rules, secret_scans, sharding, toxicity, url_filters, vector_dups
from trackloom.llm.common import shared_dir, table

QUERIES: dict = {}
ORACLES: dict = dict(oracles.ORACLES)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*[r.kind for r in secret_scans.RULES if r.base]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scans.joined(base), 256).alias("base_sha256"), secret_scans.joined(spans).alias("spans"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored map of 16 shards, dealt in turn at first, is edited for the documents' bytes; its second version places them."""
    placed, _ = sharding.assign(table(spark, sf_dir, "documents"), path=f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}", shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scans.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license_digest", "license", F.array_join("notices", ",").alias("notices"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))
    best = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_leaks"), best.alias("item_ids"), "leaks")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "chars_distance", "words_distance")


#: The vocabulary that the encoding query and the pipeline use, unless the environment's TRACKLOOM_PIECES or an argument names another.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def encoded(docs: DataFrame, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The input's columns, or those of ``keep``, and ids, n_ids, round_trip: whether decoding the ids gives the text."""
    return pieces.round_trips(docs, pieces.load(vocabulary or os.environ.get("TRACKLOOM_PIECES", VOCABULARY)), keep=keep)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_pairs(chat_format.branches(table(spark, sf_dir, "conversations")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs, model).withColumn("score", F.col("toxicity.score"))
    predicted = (F.col("score") >= toxicity.Settings().threshold).cast("int")
    return judged.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), F.size("toxicity.passages").alias("n_passages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; where the id is divisible by 7, the label is the next one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(table(spark, sf_dir, "embeddings")).drop("class_size")


QUERIES |= {
    f.__name__: f
    for f in (
        op1_url_filters, op2_minhash_near_dedup, op3_secret_scans, op4_sharding, op5_license_scans,
        op6_sentencepiece, op7_benchmark_decontamination, op8_chat_formatting, op9_quality_rules, op10_toxicity,
        op11_centroid_clustering, op12_hard_negatives, op13_vector_near_dedup,
    )
}
