"""Queries p6 to p8 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.llm import abuse, mix, tokens
from tidepath.sources.tables import read


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(read(spark, d, "documents", ("doc_id", "text")))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Per document whether decoding its ids gives its text back, and how many ids it has."""
    x = read(spark, d, "documents", ("doc_id", "text")).withColumn("ids", tokens.encode(F.col("text")))
    return x.select("doc_id", F.size("ids").alias("n_ids"), (tokens.decode_ids(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix.mix(read(spark, d, "documents", ("doc_id", "text", "source")), read(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(read(spark, d, "documents", ("doc_id", "text", "source")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("score >= 1").select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("doc_id", "score", "kind")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scores(spark, d))


QUERIES = {f.__name__: f for f in (p6_ids, p6_decoded, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)}
SQL: dict[str, str] = {}
