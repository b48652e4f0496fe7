"""Loan-book and decision statistics.

All are single-pass grouped aggregates; results are bounded by the number
of groups (vintages, bands, buckets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col = F.col


def npf_by_vintage(port: DataFrame, dpd_col: str = "dpd30_flag") -> DataFrame:
    """Loans and mean default flag per vintage."""
    return port.groupBy("vintage").agg(F.count("*").alias("loans"), F.avg(dpd_col).alias("npf"))


def fpd30(port: DataFrame, flag: str = "first_payment_miss") -> DataFrame:
    """Mean first-payment-miss flag."""
    return port.agg(F.avg(flag).alias("fpd30"))


def band_outcomes(port: DataFrame, band: str = "approved_flag") -> DataFrame:
    """Loans, npf, fpd30 per decision band."""
    return port.groupBy(band).agg(F.count("*").alias("loans"), F.avg("dpd30_flag").alias("npf"),
                                  F.avg("first_payment_miss").alias("fpd30"))


def vendor_backtest(bt: DataFrame, cost: float = 2.5, loss: float = 500.0, gain: float = 40.0,
                    bad: str = "observed_bad", flag: str = "vendor_flag") -> DataFrame:
    """Both policies from one pass of conditional sums, stacked to two rows.

    no_vendor approves everyone; with_vendor approves rows with flag 0 and
    pays ``cost`` per row; ROI = delta / max(vendor cost, 1e-9).
    """
    g = bt.agg(F.count("*").alias("n"),
               F.count_if(col(bad) == 0).alias("nv_good"), F.count_if(col(bad) == 1).alias("nv_bad"),
               F.count_if((col(flag) == 0) & (col(bad) == 0)).alias("v_good"),
               F.count_if((col(flag) == 0) & (col(bad) == 1)).alias("v_bad"))
    nv_net = col("nv_good") * gain - col("nv_bad") * loss
    v_cost = col("n") * cost
    v_net = col("v_good") * gain - col("v_bad") * loss - v_cost
    rows = F.array(
        F.struct(F.lit("no_vendor").alias("policy"), col("nv_good").alias("approved_good"),
                 col("nv_bad").alias("approved_bad"), F.lit(0.0).alias("vendor_cost"), nv_net.alias("net"),
                 F.lit(0.0).alias("delta_vs_no_vendor")),
        F.struct(F.lit("with_vendor").alias("policy"), col("v_good").alias("approved_good"),
                 col("v_bad").alias("approved_bad"), v_cost.cast("double").alias("vendor_cost"),
                 v_net.alias("net"), (v_net - nv_net).alias("delta_vs_no_vendor")))
    out = g.select(F.inline(rows))
    return out.withColumn("roi", col("delta_vs_no_vendor") / F.greatest(col("vendor_cost"), F.lit(1e-9)))


def histogram_fixed_bins(df: DataFrame, value: str, nbins: int = 40) -> DataFrame:
    """Equal-width bins between min and max (last bin closed)."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()  # two scalars
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, count long")
    width = (hi - lo) / nbins if hi > lo else 1.0
    b = F.least(F.floor((col(value) - F.lit(lo)) / F.lit(width)), F.lit(nbins - 1)).cast("int")
    g = df.where(col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    return g.select("bin", (F.lit(lo) + col("bin") * width).alias("bin_lo"),
                    (F.lit(lo) + (col("bin") + 1) * width).alias("bin_hi"), "count")


# The cumulative latency / score histogram edges (0 .. 1 by 0.1).
LE_BUCKETS = [round(0.1 * i, 1) for i in range(11)]


def histogram_cumulative(df: DataFrame, value: str, keys: list[str] | None = None,
                         buckets: list[float] | None = None) -> DataFrame:
    """Prometheus-style cumulative buckets ``le`` (+Inf last), sum and count."""
    keys = keys or []
    bks = buckets or LE_BUCKETS
    aggs = [F.count_if(col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bks)]
    g = df.groupBy(*keys).agg(*aggs, F.count(value).alias("count"), F.sum(value).alias("sum"))
    entries = [F.struct(F.lit(str(b)).alias("le"), col(f"le_{i}").alias("bucket_count")) for i, b in enumerate(bks)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), col("count").alias("bucket_count")))
    return g.select(*keys, "count", "sum", F.inline(F.array(*entries)))


def run_provider_counts(decisions: DataFrame, cols: tuple[str, ...] = ("decision_route", "provider")) -> DataFrame:
    """Counts per (route, provider) and the share of each route."""
    g = decisions.groupBy(*cols).agg(F.count("*").alias("n"))
    from pyspark.sql import Window
    return g.withColumn("share", col("n") / F.sum("n").over(Window.partitionBy()))


def distinct_sorted(df: DataFrame, c: str) -> DataFrame:
    """Sorted distinct values (a distinct aggregate, then a sort)."""
    return df.select(c).where(col(c).isNotNull()).distinct().orderBy(c)


def device_sharing_count(edges: DataFrame, device: str = "device_id", customer: str = "customer_id",
                         approx: bool = False) -> DataFrame:
    """Distinct customers per device (exact, or HyperLogLog++ at scale)."""
    agg = F.approx_count_distinct(customer) if approx else F.count_distinct(customer)
    return edges.groupBy(device).agg(agg.alias("n_customers"))


def fraud_label_rule(df: DataFrame, flag: str = "approved_flag", score: str = "credit_score",
                     pl6: str = "pl_enq_l6m", cc6: str = "cc_enq_l6m", pl12: str = "pl_enq_l12m",
                     cc12: str = "cc_enq_l12m", secured: str = "secured_account") -> Column:
    """Rule-based fraud label (sentinel -99999 read as 0 first).

    Arm A: approved P1/P2 with non-negative enquiry counts and secured flag;
    arm B: P3/P4 with score <= 750, at least one CC enquiry in 12 months and
    a secured-account flag of 1.  After cleaning, the >= 0 tests always hold,
    so arm A reduces to the flag test (kept in full form, tested reduced).
    """
    def clean(c):
        return F.when(col(c) == -99999, F.lit(0)).otherwise(col(c)) if c in df.columns else F.lit(0)
    v_pl6, v_cc6, v_pl12, v_cc12 = clean(pl6), clean(cc6), clean(pl12), clean(cc12)
    sec = col(secured)
    arm_a = (col(flag).isin("P1", "P2") & (v_pl6 >= 0) & (v_cc6 >= 0) & (v_pl12 >= 0) & (v_cc12 >= 0)
             & (sec >= 0))
    arm_b = (col(flag).isin("P3", "P4") & (col(score) <= 750) & (v_cc6 >= 0) & (v_pl6 >= 0)
             & (v_cc12 >= 1) & (v_pl12 >= 0) & (sec == 1))
    return F.when(F.coalesce(arm_a, F.lit(False)) | F.coalesce(arm_b, F.lit(False)), 1).otherwise(0)


def facts_payload(n_rows: DataFrame, class_counts: DataFrame, metrics: DataFrame, champion: str,
                  as_of: str, thresholds: dict) -> DataFrame:
    """One nested record (as_of, rows, class map, champion, metrics, thresholds).

    Each input is a bounded aggregate (one row, one row per class, one row
    per model); they are combined without a join by aggregating each to a
    single row and placing the pieces in one struct.
    """
    cls = class_counts.agg(F.map_from_entries(F.collect_list(F.struct(
        col("cls").cast("string"), col("n").cast("long")))).alias("class_distribution"))
    mets = metrics.agg(F.sort_array(F.collect_list(F.struct(*[
        (F.round(col(c), 4) if c != "model" else col(c)).alias(c) for c in metrics.columns]))).alias("model_metrics"))
    base = n_rows.select(F.lit(as_of).alias("as_of"), col("n").alias("rows"))
    # all three are single-row aggregates: zip them with an equi-join on a
    # constant key (1 x 1 x 1 rows)
    k = F.lit(1).alias("_k")
    j = (base.select("*", k).join(cls.select("*", k), "_k").join(mets.select("*", k), "_k")).drop("_k")
    out = j.select(
        "as_of", "rows", "class_distribution", F.lit(champion).alias("champion"), "model_metrics",
        F.struct(*[F.lit(v).alias(kk) for kk, v in thresholds.items()]).alias("thresholds"))
    return out.select("*", F.to_json(F.struct(*out.columns)).alias("json"))
