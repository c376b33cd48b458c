"""Keyed collections from Spark's readers and from Python values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.view import View


def table(spark: SparkSession, path: str, key: str | list[str], order: str | list[str] | None = None, kind: str = "parquet", **options) -> View:
    """A view over files of any kind that Spark reads (parquet, json, csv, orc, text)."""
    return View.over(spark.read.format(kind).options(**options).load(path), key, order)


def objects(spark: SparkSession, rows: dict, schema: str, key: str = "key") -> View:
    """{key: row dict}: keys keep to their rows."""
    data = [{key: k, **v, "_at": i} for i, (k, v) in enumerate(rows.items())]
    return View.over(spark.createDataFrame(data, f"{schema}, _at int"), key, "_at")


def array(spark: SparkSession, rows: list, schema: str) -> View:
    """[row dict]: keys are places."""
    return View.over(spark.createDataFrame([{"pos": i, **r} for i, r in enumerate(rows)], f"pos int, {schema}"), "pos")


def change_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_a_batch: int = 1) -> DataFrame:
    """A stream of change-log files, one write a batch by default, so that each write's delta shows."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)
