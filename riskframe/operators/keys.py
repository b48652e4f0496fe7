"""Joins and scans on keys that may be NULL or hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL, as in GROUP BY and window
    partitions; the keys appear once, from the left side."""
    other = [c for c in right.columns if c not in keys]
    r = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *other)
    same = reduce(Column.__and__, [left[k].eqNullSafe(r[f"_r{i}"]) for i, k in enumerate(keys)])
    return left.join(r, same, how).drop(*[f"_r{i}" for i in range(len(keys))])


def range_pieces(df: DataFrame, order: list[str], piece: str) -> DataFrame:
    """Cut ``df`` into pieces of similar size that follow each other in ``order``.

    The cut points are sampled, so neither a hot key nor a burst nor an outlier
    fills a piece; ``piece`` numbers them.  The cut is written (checkpoint) before
    use, because every consumer must see the same one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(piece, F.spark_partition_id()))
