"""Stored intermediate tables: they cut lineage, so that a long chain of passes is planned and run step by step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


class Stages:
    """Tables as Parquet in the folder of spark.checkpoint.dir (beside the warehouse where that is unset)."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        self.spark, self.root, self.n = spark, f"{shared}/{name}-{uuid.uuid4().hex}", 0

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
