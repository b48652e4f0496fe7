"""Data-preparation and significance statistics.

Wide per-column statistics are computed by unpivoting to (column, value)
so one grouped plan serves every column; exact quantiles reuse the
two-level prefix sums of ``operators.monitoring``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.keys import range_pieces
from riskframe.operators.monitoring import _keys, exact_quantiles

col = F.col


def to_long(df: DataFrame, cols: list[str], id_cols: list[str] | None = None) -> DataFrame:
    """(id..., column_name, value DOUBLE): one row per cell, map-only."""
    ids = id_cols or []
    return df.select(*ids, *[col(c).cast("double").alias(c) for c in cols]) \
             .unpivot(ids, cols, "column_name", "value")


def numeric_profile(df: DataFrame, cols: list[str],
                    percentiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """A10: count, mean, sample std, min, exact percentiles, max per column."""
    long = to_long(df, cols)
    base = long.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    qv = exact_quantiles(long, "column_name", "value", list(percentiles))
    piv = qv.groupBy("column_name").pivot("q_idx", list(range(len(percentiles)))).agg(F.first("value"))
    names = {str(i): f"p{int(round(p * 100))}" for i, p in enumerate(percentiles)}
    piv = piv.select("column_name", *[col(k).alias(v) for k, v in names.items()])
    return base.join(piv, "column_name", "left")


def bulk_quantile(df: DataFrame, cols: list[str], q: float = 0.95) -> DataFrame:
    """One exact quantile of every column."""
    return exact_quantiles(to_long(df, cols), "column_name", "value", [q]) \
        .select("column_name", col("value").alias(f"q{int(round(q * 100))}"))


def crosstab(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    """Contingency table; ``values`` fixes the pivot columns."""
    g = df.groupBy(a)
    piv = g.pivot(b, values) if values is not None else g.pivot(b)
    out = piv.count()
    return out.fillna(0, [c for c in out.columns if c != a])


# ------------------------------------------------------------------ chi-square


def _chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q(k/2, x/2))."""
    if x is None or k is None or k <= 0 or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:  # series for P
        term = 1.0 / a
        s = term
        n = 1
        while abs(term) > abs(s) * 1e-16 and n < 100000:
            term *= z / (a + n)
            s += term
            n += 1
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    # continued fraction for Q (Lentz)
    tiny = 1e-300
    b = z + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-16:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Arrow-batched chi-square p-value (only ever applied to one row per feature)."""
    return pd.Series([_chi2_sf(float(s), float(d)) for s, d in zip(stat, dof)])


def chi_square_test(df: DataFrame, features: list[str], target: str, alpha: float = 0.05) -> DataFrame:
    """Chi-square statistic, dof, p-value of each categorical feature
    against the target; Yates correction when dof == 1 (as scipy)."""
    long = df.select(col(target).cast("string").alias("_t"),
                     *[col(c).cast("string").alias(c) for c in features]) \
             .unpivot(["_t"], features, "feature", "level")
    long = long.where(col("level").isNotNull() & col("_t").isNotNull())
    obs = long.groupBy("feature", "level", "_t").agg(F.count("*").alias("o"))
    row_t = obs.groupBy("feature", "level").agg(F.sum("o").alias("r"))
    col_t = obs.groupBy("feature", "_t").agg(F.sum("o").alias("c"))
    tot = obs.groupBy("feature").agg(F.sum("o").alias("n"))
    dims = row_t.groupBy("feature").agg(F.count("*").alias("nr")) \
        .join(col_t.groupBy("feature").agg(F.count("*").alias("nc")), "feature") \
        .join(tot, "feature")
    # Uncorrected: sum over all cells of (o-e)^2/e = sum over observed cells
    # of o^2/e - n, so empty cells never need to be enumerated.
    seen = obs.join(row_t, ["feature", "level"]).join(col_t, ["feature", "_t"]).join(dims, "feature")
    e = col("r") * col("c") / col("n")
    plain = seen.groupBy("feature").agg((F.sum(col("o") * col("o") / e) - F.first("n")).alias("chi2_plain"))
    # Yates (dof == 1, a 2x2 table): the four cells are enumerated, bounded.
    two = dims.where((col("nr") == 2) & (col("nc") == 2))
    cells = (row_t.join(two, "feature").join(col_t, "feature")
             .join(obs, ["feature", "level", "_t"], "left").fillna(0, ["o"]))
    diff = F.abs(col("o") - e)
    adj = diff - F.least(F.lit(0.5), diff)
    yates = cells.groupBy("feature").agg(F.sum(adj * adj / e).alias("chi2_yates"))
    out = dims.join(plain, "feature").join(yates, "feature", "left")
    dof = (col("nr") - 1) * (col("nc") - 1)
    stat = out.select("feature", F.when(dof == 1, col("chi2_yates")).otherwise(col("chi2_plain")).alias("chi2"),
                      dof.alias("dof"))
    return stat.select("feature", "chi2", "dof", chi2_pvalue(col("chi2"), col("dof").cast("double")).alias("p_value")) \
               .withColumn("keep", col("p_value") < alpha)


def correlation_matrix(df: DataFrame, cols: list[str], target: str, k: int = 10) -> DataFrame:
    """M16 matrix: Pearson r between the ``k`` columns that correlate most with the target (by
    absolute value, then name): ``feature, other, corr``, every ordered pair."""
    strength = target_correlation(df, cols, target).where(col("corr").isNotNull())
    top = [r["feature"] for r in strength.orderBy(F.abs(col("corr")).desc(), "feature").limit(k).collect()]    # k names
    pairs = [(a, b) for a in top for b in top]
    wide = df.agg(*[F.corr(col(a).cast("double"), col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("feature"), F.lit(b).alias("other"), col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(each))


def target_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Pearson r of every column with the target (pairwise non-null), one pass."""
    wide = df.agg(*[F.corr(col(c).cast("double"), col(target).cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "corr")


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Uncentred VIF (no intercept): VIF_i = (X'X)_ii * ((X'X)^-1)_ii.

    X'X is d x d, built by one distributed aggregate; only that bounded
    matrix is inverted on the driver.  Rows with a NULL are dropped.
    """
    x = df.select(*[col(c).cast("double").alias(c) for c in cols]).dropna()
    aggs = [F.sum(col(a) * col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols)
            for j, b in enumerate(cols) if j >= i]
    row = x.agg(*aggs).first()
    d = len(cols)
    g = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            g[i, j] = g[j, i] = row[f"{i}_{j}"] or 0.0
    inv = np.linalg.pinv(g)
    vals = [(c, float(g[i, i] * inv[i, i])) for i, c in enumerate(cols)]
    spark = df.sparkSession
    out = spark.createDataFrame(vals, "feature string, vif double")
    return out.withColumn("high", col("vif") > 10)


def iqr_fences(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Q1 - k*IQR, Q3 + k*IQR per column (exact linear quantiles)."""
    qv = exact_quantiles(to_long(df, cols), "column_name", "value", [0.25, 0.75])
    f = qv.groupBy("column_name").agg(F.max(F.when(col("q_idx") == 0, col("value"))).alias("q1"),
                                      F.max(F.when(col("q_idx") == 1, col("value"))).alias("q3"))
    iqr = col("q3") - col("q1")
    return f.select("column_name", "q1", "q3", (col("q1") - k * iqr).alias("lower"),
                    (col("q3") + k * iqr).alias("upper"))


def _fence_map(fences: DataFrame) -> dict[str, tuple[float, float]]:
    # one row per column: bounded by the number of columns
    return {r["column_name"]: (r["lower"], r["upper"]) for r in fences.collect()}


def iqr_clip(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """M18 clip: bound each column to its fences (NULL stays NULL)."""
    fm = _fence_map(iqr_fences(df, cols, k))
    out = df
    for c in cols:
        lo, hi = fm.get(c, (None, None))
        if lo is None:
            continue
        out = out.withColumn(c, F.when(col(c).isNull(), None).otherwise(F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))))
    return out


def iqr_remove(df: DataFrame, cols: list[str], k: float = 1.5, sequential: bool = True) -> DataFrame:
    """M18 remove: drop rows outside the fences, column by column, with the next
    column's fences computed on the survivors.  ``sequential=False``: fences of
    all columns from the same input (one job)."""
    if not sequential:
        fm = _fence_map(iqr_fences(df, cols, k))
        cond = F.lit(True)
        for c in cols:
            lo, hi = fm[c]
            cond = cond & ((col(c) >= lo) & (col(c) <= hi))
        return df.where(cond)
    out = df
    for c in cols:
        lo, hi = _fence_map(iqr_fences(out, [c], k))[c]
        out = out.where((col(c) >= lo) & (col(c) <= hi))
    return out


def skew_report(df: DataFrame, cols: list[str], threshold: float = 1.0) -> DataFrame:
    """Bias-corrected skewness (pandas), flagged when |skew| > threshold.

    Spark's ``skewness`` is the population g1; G1 = g1 * sqrt(n(n-1))/(n-2).
    """
    long = to_long(df, cols)
    g = long.groupBy("column_name").agg(F.skewness("value").alias("g1"), F.count("value").alias("n"))
    n = col("n").cast("double")
    g1c = F.when(n > 2, col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    return g.select("column_name", g1c.alias("skew"), (F.abs(g1c) > threshold).alias("skewed"))


def mean_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill NULLs with the column mean (one global aggregate, applied as literals)."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    out = df.select(*[col(c).cast("double").alias(c) if c in cols else col(c) for c in df.columns])
    return out.fillna({c: float(v) for c, v in means.items() if v is not None})


def regression_metrics(df: DataFrame, y: str, yhat: str, baseline: float | Column | None = None) -> DataFrame:
    """MAPE (%), MAE, R^2; with ``baseline`` (train mean) the naive MAPE
    and the improvement.  Rows with y = 0 are left out of MAPE."""
    yc, pc = col(y).cast("double"), col(yhat).cast("double")
    ape = F.when(yc != 0, F.abs((yc - pc) / yc))
    aggs = [(F.avg(ape) * 100).alias("mape"), F.avg(F.abs(yc - pc)).alias("mae"),
            F.sum((yc - pc) * (yc - pc)).alias("_sse"), F.sum(yc * yc).alias("_syy"),
            F.sum(yc).alias("_sy"), F.count(yc).alias("_n")]
    if baseline is not None:
        b = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
        aggs.append((F.avg(F.when(yc != 0, F.abs((yc - b) / yc))) * 100).alias("baseline_mape"))
    g = df.agg(*aggs)
    sst = col("_syy") - col("_sy") * col("_sy") / col("_n")
    out = g.withColumn("r2", 1 - col("_sse") / sst).drop("_sse", "_syy", "_sy", "_n")
    if baseline is not None:
        out = out.withColumn("improvement", col("baseline_mape") - col("mape"))
    return out


# ------------------------------------------------------------------ champion pairs / bootstrap

def champion_pairs(pred: DataFrame, champion: str, model: str = "model", key: str = "row_id",
                   value: str = "pred", label: str = "y") -> DataFrame:
    """Every challenger's rows paired with the champion's on the row id
    (equi-join on the key; both sides shuffle on it once)."""
    champ = pred.where(col(model) == champion).select(key, label, col(value).alias("pred_a"))
    chal = pred.where(col(model) != champion).select(key, col(model).alias("challenger"),
                                                     col(value).alias("pred_b"))
    return champ.join(chal, key)


def _resample(seeds, counts, n_boot: int) -> np.ndarray:
    """Weights of cells (rows) in every replicate (columns): the sum of a cell's
    rows' Poisson(1) weights, drawn exactly at any count from the cell's own stream."""
    out = np.empty((len(counts), n_boot))
    for i, (s, c) in enumerate(zip(seeds, counts)):
        out[i] = np.random.Generator(np.random.Philox(key=int(s) & (2 ** 64 - 1))).poisson(int(c), n_boot)
    return out


def _replicate_aucs(cells: DataFrame, keys: list[str], score: str, label: str, n_boot: int) -> DataFrame:
    """(keys, aucs, positives): AUC of every replicate, NULL where it has one class only, and
    the weight of its positives.

    ``cells`` (keys, score, label, c, _seed) are put in score order once, in range
    pieces; a piece sums, for all replicates at once, its positives, negatives and
    concordant pairs; the pieces of a group (one row each) are then chained.
    """
    pieces = range_pieces(cells.where(col(score).isNotNull() & ~F.isnan(score) & col(label).isNotNull()),
                          [*keys, score], "_b")
    arr = "array<double>"
    own = ", ".join(f"{cells.schema[k].name} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def piece(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(score, kind="stable")
        step = 4096                              # rows whose weights are held at once
        pos, neg, u = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        values = pdf[score].to_numpy()
        lo = 0
        while lo < len(pdf):
            hi = min(len(pdf), lo + step)
            while hi < len(pdf) and values[hi] == values[hi - 1]:
                hi += 1                          # equal scores stay together
            part = pdf.iloc[lo:hi]
            w = _resample(part["_seed"], part["c"], n_boot)
            y = (part[label].to_numpy() == 1)[:, None]
            first = np.flatnonzero(np.append(True, values[lo + 1:hi] != values[lo:hi - 1]))
            p, n = np.add.reduceat(w * y, first, axis=0), np.add.reduceat(w * ~y, first, axis=0)
            below = neg + np.cumsum(n, axis=0) - n
            u += (p * (below + n / 2)).sum(axis=0)
            pos, neg, lo = pos + p.sum(axis=0), neg + n.sum(axis=0), hi
        return pd.DataFrame([(*key, pos.tolist(), neg.tolist(), u.tolist())])

    def chain(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pos, neg, u = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        for p, n, v in pdf.sort_values("_b")[["_pos", "_neg", "_u"]].itertuples(index=False):
            p, n = np.asarray(p), np.asarray(n)
            u += np.asarray(v) + p * neg
            pos, neg = pos + p, neg + n
        auc = [a / b if b > 0 else None for a, b in zip(u, pos * neg)]
        return pd.DataFrame([(*key, auc, pos.tolist())])

    summed = pieces.groupBy(*keys, "_b").applyInPandas(
        piece, ", ".join(filter(None, [own, f"_b int, _pos {arr}, _neg {arr}, _u {arr}"])))
    if not keys:
        return summed.groupBy(F.lit(0).alias("_all")).applyInPandas(
            lambda key, pdf: chain((), pdf), f"aucs {arr}, positives {arr}")
    return summed.groupBy(*keys).applyInPandas(chain, f"{own}, aucs {arr}, positives {arr}")


def _one_vs_rest(cells: DataFrame, keys: list[str], probs: str, label: str, n_boot: int) -> DataFrame:
    """(keys, rep, auc): support-weighted one-vs-rest AUC of every replicate.

    ``cells`` (keys, label, probs, c, _seed) weigh the same in every class of a
    replicate, because a cell's stream depends on its seed alone.  A replicate that lacks a
    class has no AUC.
    """
    long = cells.select(*keys, F.posexplode(probs).alias("_cls", "_p"), label, "c", "_seed")
    long = long.withColumn("_hit", (col(label) == col("_cls")).cast("int"))
    per = _replicate_aucs(long, [*keys, "_cls"], "_p", "_hit", n_boot)
    each = per.select(*keys, F.posexplode(F.arrays_zip("aucs", "positives")).alias("rep", "v"))
    return each.groupBy(*keys, "rep").agg(
        F.when(F.count("v.aucs") == F.count("*"), F.sum(col("v.aucs") * col("v.positives")) / F.sum("v.positives")).alias("auc"))


def _weighted_f1(confusion: np.ndarray) -> np.ndarray:
    """Support-weighted F1 (zero division 0) of confusion weights (actual, predicted, replicate)."""
    support, guessed, hit = confusion.sum(axis=1), confusion.sum(axis=0), np.einsum("iir->ir", confusion)
    both = support + guessed
    f1 = np.divide(2 * hit, both, out=np.zeros_like(hit), where=both > 0)
    total = support.sum(axis=0)
    return np.divide((f1 * support).sum(axis=0), total, out=np.full_like(total, np.nan), where=total > 0)


def bootstrap_f1(counts: DataFrame, model: str, n_boot: int, seed: int) -> DataFrame:
    """(model, rep, f1) from confusion counts ``(model, y, pred, n)``: a few rows per model."""
    kind = counts.schema[model].dataType.simpleString()
    seeded = counts.withColumn("_seed", F.xxhash64(F.lit(seed), model, "y", "pred"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(max(pdf["y"].max(), pdf["pred"].max())) + 1
        weights = np.zeros((top, top, n_boot))
        weights[pdf["y"], pdf["pred"]] = _resample(pdf["_seed"], pdf["n"], n_boot)
        return pd.DataFrame({model: key[0], "rep": np.arange(n_boot, dtype=np.int32), "f1": _weighted_f1(weights)})

    return seeded.groupBy(model).applyInPandas(run, f"{model} {kind}, rep int, f1 double")


def bootstrap_weighted(pred: DataFrame, model: str = "model", probs: str = "probs", label: str = "y",
                       n_boot: int = 300, seed: int = 42) -> DataFrame:
    """M12 for several classes: mean and 2.5 / 97.5 % of weighted one-vs-rest AUC and of weighted F1
    (of the arg max) per model.  Equal rows are one cell, whose replicate weights come
    from its own stream; see ``bootstrap_auc``."""
    rows = pred.where(col(label).isNotNull() & col(probs).isNotNull())
    cells = rows.groupBy(model, label, probs).agg(F.count("*").alias("c"))
    cells = cells.withColumn("_seed", F.xxhash64(F.lit(seed), model, label, probs))
    auc = _one_vs_rest(cells, [model], probs, label, n_boot)
    arg = F.array_position(probs, F.array_max(probs)).cast("int") - 1
    counts = cells.groupBy(model, col(label).cast("int").alias("y"), arg.alias("pred")).agg(F.sum("c").alias("n"))
    reps = auc.join(bootstrap_f1(counts, model, n_boot, seed), [model, "rep"])
    spread = lambda m: [F.avg(m).alias(f"{m}_mean"), F.percentile(m, 0.025).alias(f"{m}_lo"),
                        F.percentile(m, 0.975).alias(f"{m}_hi")]
    return reps.groupBy(model).agg(*spread("auc"), *spread("f1"), F.count("auc").alias("n_valid"))


def paired_deltas(pred: DataFrame, champion: str, model: str = "model", key: str = "row_id", probs: str = "probs",
                  label: str = "y", n_boot: int = 300, seed: int = 42) -> DataFrame:
    """(challenger, rep, delta): weighted AUC of the champion less the challenger's, both over the same
    row weights."""
    a = pred.where(col(model) == champion).select(key, label, col(probs).alias("_a"))
    b = pred.where(col(model) != champion).select(key, col(model).alias("challenger"), col(probs).alias("_b"))
    rows = a.join(b, key).where(col(label).isNotNull() & col("_a").isNotNull() & col("_b").isNotNull())
    cells = rows.groupBy("challenger", label, "_a", "_b").agg(F.count("*").alias("c"))
    cells = cells.withColumn("_seed", F.xxhash64(F.lit(seed), "challenger", label, "_a", "_b"))
    sides = cells.select("challenger", label, "c", "_seed", F.explode(F.array(
        F.struct(F.lit(1.0).alias("sign"), col("_a").alias("p")), F.struct(F.lit(-1.0).alias("sign"), col("_b").alias("p")))).alias("s"))
    auc = _one_vs_rest(sides.select("challenger", "s.sign", col("s.p").alias("p"), label, "c", "_seed"), ["challenger", "sign"], "p", label, n_boot)
    return auc.groupBy("challenger", "rep").agg(F.when(F.count("auc") == 2, F.sum(col("sign") * col("auc"))).alias("delta"))


def paired_pvalues(pred: DataFrame, champion: str, **more) -> DataFrame:
    """M13 for several classes: every challenger against the champion - one-sided p = share of
    replicates with delta <= 0, mean delta, significant if p < .05 and delta > 0."""
    d = paired_deltas(pred, champion, **more).where("delta IS NOT NULL")
    g = d.groupBy("challenger").agg(F.avg(F.when(col("delta") <= 0, 1.0).otherwise(0.0)).alias("p_value"),
                                    F.avg("delta").alias("auc_delta"), F.count("*").alias("n_valid"))
    return g.withColumn("significant_at_5pct", (col("p_value") < 0.05) & (col("auc_delta") > 0))


def bootstrap_auc(pred: DataFrame, keys, score: str = "p", label: str = "y", n_boot: int = 300,
                  seed: int = 42) -> DataFrame:
    """Bootstrap distribution of AUC per group: mean and 2.5 / 97.5 %.

    Resampling is Poisson(1) per row; rows are first reduced to (score, label)
    cells, whose weights in all replicates are one array drawn from a hash of
    (seed, cell): deterministic, and neither the data nor its cells are copied
    per replicate.
    """
    keys = _keys(keys)
    cells = pred.groupBy(*keys, score, label).agg(F.count("*").alias("c"))
    cells = cells.withColumn("_seed", F.xxhash64(F.lit(seed), *keys, score, label))
    per = _replicate_aucs(cells, keys, score, label, n_boot).select(*keys, F.explode("aucs").alias("auc"))
    return per.groupBy(*keys).agg(
        F.avg("auc").alias("auc_mean"),
        F.percentile(col("auc"), 0.025).alias("auc_lo"),
        F.percentile(col("auc"), 0.975).alias("auc_hi"),
        F.count("auc").alias("n_valid"))


def auc_delta_pvalue(pairs: DataFrame, label: str, score_a: str, score_b: str,
                     n_boot: int = 300, seed: int = 42) -> DataFrame:
    """Paired bootstrap of AUC(a) - AUC(b): one-sided p = share of
    replicates with delta <= 0, mean delta, significant if p < .05 and delta > 0.
    Both scores of a row share its replicate weight (cells of (a, b, label))."""
    cells = pairs.groupBy(score_a, score_b, label).agg(F.count("*").alias("c"))
    cells = cells.withColumn("_seed", F.xxhash64(F.lit(seed), score_a, score_b, label))
    a = _replicate_aucs(cells, [], score_a, label, n_boot).select(F.posexplode("aucs").alias("rep", "auc_a"))
    b = _replicate_aucs(cells, [], score_b, label, n_boot).select(F.posexplode("aucs").alias("rep", "auc_b"))
    d = a.join(b, "rep").select((col("auc_a") - col("auc_b")).alias("delta")).where("delta IS NOT NULL")
    g = d.agg(F.avg(F.when(col("delta") <= 0, 1.0).otherwise(0.0)).alias("p_value"),
              F.avg("delta").alias("auc_delta"), F.count("*").alias("n_valid"))
    return g.withColumn("significant_at_5pct", (col("p_value") < 0.05) & (col("auc_delta") > 0))


def seed_stability_cv(metrics: DataFrame, keys, metric_cols: list[str]) -> DataFrame:
    """100 * std (ddof 0) / max(mean, 1e-9) of each metric over seeds."""
    keys = _keys(keys)
    return metrics.groupBy(*keys).agg(*[
        (100 * F.stddev_pop(m) / F.greatest(F.avg(m), F.lit(1e-9))).alias(f"{m}_cv_pct") for m in metric_cols])
