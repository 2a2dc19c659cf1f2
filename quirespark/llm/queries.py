"""The queries op1 to op10: each operator with its production parameters over its whole table."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import classify
from .decontaminate import contamination
from .line_dedup import repeated_units
from .mixing import mix
from .near_dedup import near_duplicates
from .oracles import line_dedup_sql, quality_rules_sql
from .quality_rules import quality_rules
from .sharding import shard
from .surrogates import pseudonymise
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files
from .common import Workspace

QUERIES: dict = {}
ORACLES: dict = {"op1_quality_rules": quality_rules_sql(), "op9_line_dedup": line_dedup_sql()}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(table(spark, sf_dir, "documents"))
    return d.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Workspace(spark, "op3").path("files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder, manifest)


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without a configured key, surrogates of one run cannot be linked with those of another
    key = spark.conf.get("spark.quirespark.surrogates.key", None) or secrets.token_hex(16)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
