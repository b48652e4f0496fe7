"""Sorting, top-k, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col = F.col


def champion_top1(metrics: DataFrame, metric: str = "f1_score", name: str = "model_name",
                  gate: float | None = 0.70) -> DataFrame:
    """O2: best model by metric (name breaks ties); ``approved`` is the
    registration gate (best >= gate)."""
    best = metrics.agg(F.max_by(F.struct(col(name), col(metric)), F.struct(col(metric), col(name))).alias("b"))
    out = best.select(col("b")[name].alias("champion"), col("b")[metric].alias("metric_value"))
    if gate is not None:
        out = out.withColumn("approved", col("metric_value") >= gate)
    return out


def top_k_per_row(values: Column, names: list[str], k: int) -> Column:
    """O3: per row, the k (name, value) pairs with the largest |value|."""
    arr = F.array(*[F.struct(F.abs(values[i]).alias("a"), F.lit(n).alias("name"), values[i].alias("value"))
                    for i, n in enumerate(names)])
    srt = F.array_sort(arr, lambda x, y: F.when(x["a"] > y["a"], -1).when(x["a"] < y["a"], 1)
                       .otherwise(F.when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0)))
    return F.transform(F.slice(srt, 1, k), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value")))


def seeded_sample(df: DataFrame, n: int, key: str | list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, reproducible: the n smallest hashes of (seed, key).

    A top-n (TakeOrderedAndProject), not ``df.sample`` whose size varies.
    """
    keys = [key] if isinstance(key, str) else key
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def stratified_split(df: DataFrame, label: str, key: str, train_frac: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """Deterministic stratified split; adds ``split`` = train / test.

    Within each class, rows are ordered by hash(seed, key) and the first
    ``round(n_class * (1 - train_frac))`` go to test.  The rank is computed
    per class through ``percent_rank``-free arithmetic: a class's rows are
    ranked by a window partitioned by (class, hash bucket) plus bucket
    offsets, so one class never sorts in one task.
    """
    from riskframe.operators.monitoring import with_prefix
    h = (F.pmod(F.xxhash64(F.lit(seed), col(key)), F.lit(1 << 52)).cast("double") / float(1 << 52))
    # a NULL label is its own stratum; join keys must not be NULL
    x = df.withColumn("_u", h).withColumn("_s", F.coalesce(col(label).cast("string"), F.lit("\u0000null")))
    counts = x.groupBy("_s", "_u").agg(F.count("*").alias("cnt"))
    pre = with_prefix(counts, ["_s"], "_u", ["cnt"]).select("_s", "_u", "cnt_lt", "cnt_tot")
    j = x.join(pre, ["_s", "_u"]).drop("_s")
    n_test = F.round(col("cnt_tot") * (1 - train_frac))
    return j.withColumn("split", F.when(col("cnt_lt") < n_test, "test").otherwise("train")) \
            .drop("_u", "cnt_lt", "cnt_tot")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Deterministic stratified ``fold`` 0..folds-1: every class is dealt out in the order of
    hash(seed, key), ranked by prefix counts, so a class never sorts in one task."""
    from riskframe.operators.monitoring import with_prefix
    x = df.withColumn("_u", F.xxhash64(F.lit(seed), col(key))).withColumn("_s", F.coalesce(col(label).cast("string"), F.lit("\u0000null")))
    counts = x.groupBy("_s", "_u").agg(F.count("*").alias("cnt"))
    ranked = with_prefix(counts, ["_s"], "_u", ["cnt"]).select("_s", "_u", F.pmod("cnt_lt", F.lit(folds)).cast("int").alias("fold"))
    return x.join(ranked, ["_s", "_u"]).drop("_s", "_u")


def max_score_row(df: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    """The row with the largest score (per group), via max_by (partial aggregation)."""
    keys = keys or []
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), col(score)).alias("_r"))
    return g.select(*keys, *[col(f"_r.{c}").alias(c) for c in cols])


def first_row_per_key(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """First writer wins within a batch (earliest ``order`` per key).

    ``min_by`` over a struct is a hash aggregate with partial aggregation,
    so a key holding a third of the batch is combined map-side.
    """
    keys = [key] if isinstance(key, str) else key
    orders = [order] if isinstance(order, str) else order
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min(F.struct(*[col(o).alias(f"_o{i}") for i, o in enumerate(orders)],
                                            F.struct(*cols).alias("_r"))).alias("_m"))
    return g.select(*keys, *[col(f"_m._r.{c}").alias(c) for c in cols])
