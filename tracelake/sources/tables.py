"""Parquet tables of an input folder; paths are only ever opened by Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.sources.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
