"""Stored synthetic tables and fitted models: folders of Parquet tables with a checked description."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "tallyveil-model", 1


def store_synthetic(df: DataFrame, path: str, experiment_id: str, meta: Mapping[str, str | float | int], mode: str = "append") -> None:
    """m synthetic tables partitioned by experiment and data set, next to one row per meta field."""
    df.withColumn("experiment_id", F.lit(experiment_id)).write.mode(mode).partitionBy("experiment_id", "dataset_id").parquet(f"{path}/rows")
    rows = [(experiment_id, k, str(v)) for k, v in meta.items()]
    df.sparkSession.createDataFrame(rows, "experiment_id string, field string, value string").write.mode(mode).parquet(f"{path}/meta")


def load_synthetic(spark: SparkSession, path: str, experiment_id: str, dataset_id: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """One experiment's tables (or one of them); the filters prune partitions."""
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("experiment_id") == experiment_id)
    if dataset_id is not None:
        rows = rows.filter(F.col("dataset_id") == dataset_id)
    meta = spark.read.parquet(f"{path}/meta").filter(F.col("experiment_id") == experiment_id).collect()
    return rows.drop("experiment_id"), {r["field"]: r["value"] for r in meta}


def store_model(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], meta: Mapping[str, str | float | int]) -> None:
    """The tables of a fitted model and its description; an existing path is an error."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}")
    rows = [("format", FORMAT), ("version", str(VERSION)), ("tables", ",".join(tables)), *[(k, str(v)) for k, v in meta.items()]]
    spark.createDataFrame(rows, "field string, value string").coalesce(1).write.mode("error").parquet(f"{path}/meta")


def _read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["field"]: r["value"] for r in spark.read.schema("field string, value string").parquet(f"{path}/meta").collect()}


def is_stored_model(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a model of this kind."""
    try:
        return _read_meta(spark, path).get("format") == FORMAT
    except Exception:  # no such folder, or not a table
        return False


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables and description of a stored model; another format or version raises."""
    meta = _read_meta(spark, path)
    if meta.get("format") != FORMAT:
        raise ValueError(f"{path} holds no model of format {FORMAT}")
    if meta.get("version") != str(VERSION):
        raise ValueError(f"model version {meta.get('version')} is not {VERSION}")
    return {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"].split(",")}, meta
