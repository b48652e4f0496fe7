"""Scans (S1-S4): parquet, column-pruned parquet, metrics CSV, full table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One driver table; ``columns`` prunes at the scan (ReadSchema)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def normalise_names(df: DataFrame) -> DataFrame:
    """strip, lower-case, spaces to underscores."""
    return df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])


def scan_parquet(spark: SparkSession, path: str, nrows: int | None = None,
                 order_key: str | None = None) -> DataFrame:
    """Read parquet with lower-cased names; ``nrows`` keeps the first rows by key.

    A bare ``limit`` is storage-order; ordering by the key first makes the
    row set deterministic (a top-n, planned as TakeOrderedAndProject).
    """
    df = normalise_names(spark.read.parquet(path))
    if nrows is not None:
        if order_key is None:
            raise ValueError("nrows needs an order_key for a deterministic row set")
        df = df.orderBy(order_key).limit(nrows)
    return df


def scan_parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Column-pruned read; the scan's ReadSchema holds only ``columns``."""
    return spark.read.parquet(path).select(*columns)


# Column aliases of the metrics CSV loader.
METRIC_ALIASES = {"model_name": "model", "modelname": "model",
                  "f1_weighted": "f1", "f1_score": "f1"}

METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
])


def scan_csv_metrics(spark: SparkSession, path: str) -> DataFrame:
    """S3: metrics CSV with snake_case names, ``unnamed*`` dropped, aliases applied."""
    raw = spark.read.option("header", True).csv(path)
    df = normalise_names(raw)
    keep = [c for c in df.columns if not c.startswith("unnamed") and c != "_c0"]
    df = df.select(*keep)
    df = df.toDF(*[METRIC_ALIASES.get(c, c) for c in df.columns])
    if "model" not in df.columns:
        raise ValueError("metrics file has no model column")
    numeric = [c for c in df.columns if c != "model"]
    return df.select("model", *[F.col(c).try_cast("double").alias(c) for c in numeric])


def scan_table_full(spark: SparkSession, name: str) -> DataFrame:
    """Full catalog table scan."""
    return spark.table(name)
