"""Lookup tables from delimited text, for merging into events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_lookup(spark: SparkSession, path: str, sep: str = ",", **options) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep, **options)
