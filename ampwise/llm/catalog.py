"""Queries of this package, each with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampwise.llm import decontam, licenses, merkle, minhash, mixing, phrases, quality, sharding, suffix_dedup, url_rules, warc, whitening, wrappers
from ampwise.llm.checks import CHECKS
from ampwise.llm.url_rules import LOWER, UPPER

Query = Callable[[SparkSession, str], DataFrame]

__all__ = ["CHECKS", "QUERIES"]

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


@query
def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    drawn = mixing.draw_mix(docs, F.col("words"))
    shards = F.transform("copies", lambda c: c["shard"]).alias("shards")
    return drawn.select("row.doc_id", "size", "source_size", "target", "taken", shards)


@query
def op3_license_sentences(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op5_warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select(
        "metadata.page_id",
        "capture.payload_bytes",
        "capture.payload_digest",
        "capture.record_type",
        F.col("original.page_id").alias("refers_to"),
        F.coalesce("capture.digest_ok", F.lit(True)).alias("digest_ok"),
    )


@query
def op6_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


@query
def op7_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


@query
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), words=4).drop("text_key")


@query
def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), url_rules.rule_table(spark))


@query
def op10_exact_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.shard(docs, carried=[]).select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op11_phrase_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.fingerprints(table(spark, folder, "documents"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle.verify(table(spark, folder, "documents"), {"text": tampered})


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
