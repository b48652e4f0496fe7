"""Portfolio SQL, views and scoreboards (P1-P3, P24-P27, A1-A9, A17-A18, A21,
A27, J1-J3, W1-W3, O1, O4, M25).

Aggregates are hash aggregates with map-side partial aggregation, so a key
holding a third of all rows is combined before the shuffle.  Windows that
look unpartitioned (share of total, scoreboard ranks) run only on grouped
results whose size is bounded by the number of groups / models.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import expressions as X

col = F.col

# The portfolio snapshot columns of the v_portfolio view.
PORTFOLIO_COLUMNS = ["prospectid", "approved_flag", "credit_score", "netmonthlyincome", "age",
                     "gender", "education", "maritalstatus", "first_prod_enq2", "last_prod_enq2",
                     "cc_utilization", "pl_utilization", "tot_missed_pmnt", "num_times_delinquent",
                     "max_delinquency_level", "created_at"]


def portfolio_projection(app: DataFrame) -> DataFrame:
    """16-column snapshot (pruned down to the scan)."""
    return app.select(*PORTFOLIO_COLUMNS)


def _sort(df: DataFrame, order: bool, *keys: Column) -> DataFrame:
    return df.orderBy(*keys) if order else df


# Postgres: NULLs last on ASC, first on DESC.
def high_risk_filter_v1(app: DataFrame, order: bool = True) -> DataFrame:
    """OR of seven risk predicates, riskiest first."""
    cond = ((col("credit_score") < 600) | (col("tot_missed_pmnt") >= 3)
            | (col("num_times_60p_dpd") >= 1) | (col("num_times_delinquent") >= 3)
            | (col("cc_utilization") >= 75) | (col("pl_utilization") >= 75) | (col("tot_enq") >= 10))
    out = app.where(cond).select(
        "prospectid", "credit_score", "netmonthlyincome", "tot_active_tl", "unsecured_tl",
        "tot_missed_pmnt", "num_times_delinquent", "num_times_30p_dpd", "num_times_60p_dpd",
        "cc_utilization", "pl_utilization", "tot_enq", "approved_flag")
    return _sort(out, order, col("credit_score").asc_nulls_last(),
                 col("tot_missed_pmnt").desc_nulls_first(), col("num_times_60p_dpd").desc_nulls_first())


def high_risk_filter_v2(app: DataFrame, score_below: int = 610, util_at: float = 75,
                        order: bool = True) -> DataFrame:
    """Variant without the enquiry predicate."""
    cond = ((col("credit_score") < score_below) | (col("num_times_delinquent") >= 3)
            | (col("num_times_60p_dpd") > 0) | (col("tot_missed_pmnt") >= 3)
            | (col("cc_utilization") >= util_at) | (col("pl_utilization") >= util_at))
    out = app.where(cond).select(
        "prospectid", "credit_score", "num_times_delinquent", "num_times_60p_dpd",
        "tot_missed_pmnt", "cc_utilization", "pl_utilization", "tot_enq", "approved_flag")
    return _sort(out, order, col("credit_score").asc_nulls_last())


def with_bands(app: DataFrame) -> DataFrame:
    """P4-P9 as columns (one projection, no join)."""
    return app.select(
        "prospectid", "credit_score", "approved_flag", "num_times_delinquent",
        X.score_band_5().alias("score_band_5"),
        X.score_segment_risk().alias("score_segment"),
        X.score_band_6().alias("score_band_6"),
        X.score_band_mislabelled().alias("score_band_reference"),
        X.score_band_mislabelled(labels="corrected").alias("score_band_corrected"),
        X.delinquency_segment().alias("delinquency_segment"),
        X.dpd_segment().alias("dpd_segment"))


def portfolio_overview(app: DataFrame) -> DataFrame:
    """A1: global counts and rounded averages (one partial+final aggregate)."""
    return app.agg(
        F.count("*").alias("total_applicants"),
        F.count("approved_flag").alias("applicants_with_decision"),
        F.round(F.avg("age"), 2).alias("avg_age"),
        F.round(F.avg("netmonthlyincome"), 2).alias("avg_monthly_income"),
        F.round(F.avg("credit_score"), 2).alias("avg_credit_score"),
        F.round(F.avg("tot_active_tl"), 2).alias("avg_active_accounts"),
        F.round(F.avg("tot_missed_pmnt"), 2).alias("avg_missed_payments"))


def _share(count_col: str) -> Column:
    # The window runs over the grouped result (one row per group), never over
    # applicant rows, so its single partition is bounded by the group count.
    return F.round(100.0 * col(count_col) / F.sum(count_col).over(Window.partitionBy()), 2)


def approval_distribution(app: DataFrame, order: bool = True) -> DataFrame:
    """A2 (analysis query): count and percentage per approval class."""
    g = app.groupBy("approved_flag").agg(F.count("*").alias("applicant_count"))
    out = g.select("approved_flag", "applicant_count",
                   _share("applicant_count").alias("portofolio_percentage"))
    return _sort(out, order, col("applicant_count").desc())


def approval_distribution_view(app: DataFrame) -> DataFrame:
    """A2 (view form): plus unrounded average score and income."""
    g = app.groupBy("approved_flag").agg(
        F.count("*").alias("applications"),
        F.avg("credit_score").alias("avg_credit_score"),
        F.avg("netmonthlyincome").alias("avg_income"))
    return g.select("approved_flag", "applications", _share("applications").alias("pct"),
                    "avg_credit_score", "avg_income")


def score_stats_by_class(app: DataFrame, order: bool = True) -> DataFrame:
    """A3."""
    out = app.groupBy("approved_flag").agg(
        F.count("*").alias("applicants"),
        F.round(F.avg("credit_score"), 2).alias("avg_credit_score"),
        F.min("credit_score").alias("min_credit_score"),
        F.max("credit_score").alias("max_credit_score"))
    return _sort(out, order, col("avg_credit_score").desc_nulls_first())


def score_band_summary(app: DataFrame, order: bool = True) -> DataFrame:
    """A4: band rollup ordered by the band's minimum score (not projected)."""
    g = (app.groupBy(X.score_band_5().alias("credit_score_band"))
         .agg(F.count("*").alias("applicants"),
              F.round(F.avg("netmonthlyincome"), 2).alias("avg_income"),
              F.round(F.avg("tot_missed_pmnt"), 2).alias("avg_missed_payment"),
              F.round(F.avg("tot_active_tl"), 2).alias("avg_active_accounts"),
              F.min("credit_score").alias("_min_score")))
    return _sort(g, order, col("_min_score").asc_nulls_last()).drop("_min_score")


def band_class_pivot(app: DataFrame, labels: str = "reference", order: bool = True) -> DataFrame:
    """A5: conditional counts per band (COUNT(*) FILTER (WHERE ...))."""
    flag = col("approved_flag")
    g = (app.select(X.score_band_mislabelled(labels=labels).alias("score_credit"), "approved_flag")
         .groupBy("score_credit")
         .agg(F.count("*").alias("applicants"),
              F.count_if(flag == "P1").alias("p1_auto_approved"),
              F.count_if(flag == "P2").alias("p2_standard_approved"),
              F.count_if(flag == "P3").alias("p3_conditional_approved"),
              F.count_if(flag == "P4").alias("p4_direct_reject_approved")))
    out = g.withColumn("p1_rate", F.round(100.0 * X.nullif_divide("p1_auto_approved", "applicants"), 2))
    return _sort(out, order, X.band_sort_key("score_credit").asc_nulls_last())


def dpd_summary(app: DataFrame, order: bool = True) -> DataFrame:
    """A6."""
    out = (app.groupBy(X.dpd_segment().alias("dpd_segment"))
           .agg(F.count("*").alias("applicants"),
                F.round(F.avg("credit_score"), 2).alias("avg_credit_score"),
                F.sum("tot_missed_pmnt").alias("sum_missed_payments"),
                F.round(F.avg("netmonthlyincome"), 2).alias("avg_income")))
    return _sort(out, order, col("applicants").desc())


def score_band_by_class(app: DataFrame) -> DataFrame:
    """Two-key count (v_score_band)."""
    return (app.groupBy("approved_flag", X.score_band_6().alias("score_band"))
            .agg(F.count("*").alias("applications")))


def value_counts(df: DataFrame, column: str, normalize: bool = False,
                 dropna: bool = True) -> DataFrame:
    """Counts per value; nulls dropped unless ``dropna=False``; with
    ``normalize`` the share x100 rounded to 2."""
    src = df.where(col(column).isNotNull()) if dropna else df
    g = src.groupBy(column).agg(F.count("*").alias("count"))
    if normalize:
        total = src.count()                     # one number; a window would gather all values in one task
        g = g.withColumn("percent", F.round(100.0 * col("count") / F.lit(total), 2))
    return g


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass, unpivoted to (column, null_count)."""
    cols = df.columns
    wide = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def approval_share_by_class(app: DataFrame) -> DataFrame:
    """A2/W3 (second analysis query): count + percentage ordered by class."""
    g = app.groupBy("approved_flag").agg(F.count("*").alias("applicants"))
    return g.select("approved_flag", "applicants", _share("applicants").alias("percentage")) \
            .orderBy(col("approved_flag").asc_nulls_last())


def merge_sources_inner(left: DataFrame, right: DataFrame, key: str = "prospectid") -> DataFrame:
    """Inner equi-join on the key; any shared non-key column is an error
    (after a join, case-insensitive resolution would make it ambiguous)."""
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    extra = sorted(shared - {key.lower()})
    if extra:
        raise ValueError(f"columns present on both sides besides the key: {extra}")
    return left.join(right, key, "inner")


def segment_inner_join(app: DataFrame, one_pass: bool = False, order: bool = True) -> DataFrame:
    """Applicants joined with their score segment on the key.

    ``one_pass=True`` computes the label in the projection (no self-join),
    which is the plan to use at scale; both forms give the same rows.
    """
    d = app.select("prospectid", "credit_score", "approved_flag", "netmonthlyincome")
    if one_pass:
        out = d.select("prospectid", "credit_score", X.score_segment_risk().alias("score_segment"),
                       "approved_flag", "netmonthlyincome")
    else:
        s = app.select("prospectid", X.score_segment_risk().alias("score_segment"))
        out = d.join(s, "prospectid", "inner").select(
            "prospectid", "credit_score", "score_segment", "approved_flag", "netmonthlyincome")
    return _sort(out, order, col("credit_score").asc_nulls_last())


def segment_left_join(app: DataFrame, one_pass: bool = False, order: bool = True) -> DataFrame:
    """Applicants left-joined with their delinquency segment."""
    d = app.select("prospectid", "credit_score", "approved_flag", "num_times_delinquent")
    if one_pass:
        out = d.withColumn("delinquency_segment", X.delinquency_segment())
    else:
        s = app.select("prospectid", X.delinquency_segment().alias("delinquency_segment"))
        out = d.join(s, "prospectid", "left")
    return _sort(out, order, col("num_times_delinquent").desc_nulls_first())


# ------------------------------------------------------------ monitoring views

MON_COLUMNS = ["model_name", "scored_at", "gini", "ks", "psi", "gini_min", "ks_min", "psi_max"]


def latest_per_model(mon: DataFrame) -> DataFrame:
    """One row per model with the latest ``scored_at`` plus status.

    DISTINCT ON (model) ... ORDER BY scored_at DESC: Postgres sorts NULL
    first on DESC, so a NULL ``scored_at`` would win.  Planned as a hash
    aggregate of ``max(struct(...))`` (partial aggregation absorbs a hot
    model) instead of a per-model sort; remaining columns break ties
    deterministically.
    """
    key = F.struct(col("scored_at").isNull().alias("k0"), col("scored_at").alias("k1"),
                   *[col(c).alias(c) for c in MON_COLUMNS if c not in ("model_name", "scored_at")])
    best = mon.groupBy("model_name").agg(F.max(key).alias("b"))
    return best.select(
        "model_name", col("b.k1").alias("scored_at"),
        *[col(f"b.{c}").alias(c) for c in MON_COLUMNS if c not in ("model_name", "scored_at")]
    ).select(*MON_COLUMNS, X.monitor_status().alias("status"), X.is_healthy().alias("is_healthy"))


def alerts_latest(mon: DataFrame) -> DataFrame:
    """Latest status per model where status <> 'OK'."""
    return latest_per_model(mon).where(col("status") != "OK").select(
        "model_name", "scored_at", "status", "gini", "gini_min", "ks", "ks_min", "psi", "psi_max")


def monitoring_trend(mon: DataFrame, order: bool = True) -> DataFrame:
    """Metric history ordered by time."""
    return _sort(mon.select(*MON_COLUMNS), order, col("scored_at").asc_nulls_last())


def monitoring_recent(mon: DataFrame, as_of: datetime | str, days: int = 30,
                      thresholds: dict | None = None, order: bool = True) -> DataFrame:
    """Status over the last ``days`` before ``as_of`` with bound thresholds.

    ``as_of`` is a parameter (the reference uses NOW()), which keeps the
    query testable; the filter is a plain range predicate and is pushed
    to the scan when ``mon`` is a parquet table.
    """
    t = X.thresholds(thresholds)
    stamp = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else str(as_of)
    lo = F.lit(stamp).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    out = mon.where(col("scored_at") >= lo).select(
        "model_name", "gini", "ks", "psi",
        X.monitor_status(gini_min=t["gini_min"], ks_min=t["ks_min"], psi_max=t["psi_max"]).alias("status"),
        "scored_at")
    out = _sort(out, order, col("scored_at").desc_nulls_first())
    return out.drop("scored_at")


def threshold_checks(metrics: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """gini_ok, ks_ok, psi_ok per model."""
    t = X.thresholds(thresholds)
    return metrics.select(
        "model_name", "gini", (col("gini") >= t["gini_min"]).alias("gini_ok"),
        "ks", (col("ks") >= t["ks_min"]).alias("ks_ok"),
        "psi", (col("psi") <= t["psi_max"]).alias("psi_ok"))


def alerts_any_breach(metrics: DataFrame, thresholds: dict | None = None,
                      dashboard: bool = False) -> DataFrame:
    """P25: rows breaching any threshold.  ``dashboard=True``: gini derived
    as 2*auc-1, missing ks treated as 1 and missing psi as 0."""
    t = X.thresholds(thresholds)
    m = metrics
    if dashboard:
        m = m.withColumn("gini", 2 * col("roc_auc") - 1)
        ks, psi = F.coalesce(col("ks"), F.lit(1.0)), F.coalesce(col("psi"), F.lit(0.0))
    else:
        ks, psi = col("ks"), col("psi")
    cond = (col("gini") < t["gini_min"]) | (ks < t["ks_min"]) | (psi > t["psi_max"])
    return m.where(cond)


def monthly_metric_by_model(mon: DataFrame) -> DataFrame:
    """AVG(gini), AVG(ks) by month and model."""
    return (mon.groupBy(F.date_trunc("month", "scored_at").alias("month"), "model_name")
            .agg(F.avg("gini").alias("avg_gini"), F.avg("ks").alias("avg_ks")))


def psi_heatmap_view(mon: DataFrame) -> DataFrame:
    """A18 (view): month (DATE) x model x psi, unaggregated."""
    return mon.select(X.month_trunc_date("scored_at").alias("month"), "model_name", "psi")


def psi_heatmap(mon: DataFrame, models: list[str] | None = None) -> DataFrame:
    """A18 (chart): month x model matrix of average psi.

    ``models`` fixes the pivot columns; without it Spark first runs a
    distinct job over the (model-sized) key set.
    """
    v = psi_heatmap_view(mon)
    g = v.groupBy("month")
    return (g.pivot("model_name", models) if models else g.pivot("model_name")).avg("psi")


def model_scoreboard_rank(metrics: DataFrame) -> DataFrame:
    """Two independent ranks with gaps.  One row per model, so the
    single-partition window is bounded by the number of models."""
    w_auc = Window.orderBy(col("roc_auc").desc_nulls_first())
    w_f1 = Window.orderBy(col("f1_score").desc_nulls_first())
    return metrics.select("model_name", "accuracy", "precision", "recall", "f1_score", "roc_auc",
                          F.rank().over(w_auc).alias("roc_auc_rank"),
                          F.rank().over(w_f1).alias("f1_rank"))


def leaderboard_sort(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """O1: models by metric DESC, name as tie-breaker, with a 0-based position."""
    w = Window.orderBy(col(metric).desc_nulls_last(), col("model_name"))
    return metrics.withColumn("position", F.row_number().over(w) - 1).orderBy("position")


def scoreboard_best(metrics: DataFrame) -> DataFrame:
    """Max AUC and max F1."""
    return metrics.agg(F.max("roc_auc").alias("best_auc"), F.max("f1_score").alias("best_f1"))


def row_limit(df: DataFrame, n: int, key: str | list[str], descending: bool = False) -> DataFrame:
    """First n rows by key (TakeOrderedAndProject: a per-partition top-n
    then one merge of n rows per partition)."""
    keys = [key] if isinstance(key, str) else key
    order = [col(k).desc_nulls_last() if descending else col(k).asc_nulls_last() for k in keys]
    return df.orderBy(*order).limit(n)


def class_labels(df: DataFrame, target: str) -> DataFrame:
    """Sorted distinct target values (bounded by the class count)."""
    return df.agg(F.sort_array(F.collect_set(target)).alias("classes"))


def select_by_type(df: DataFrame, target: str | None = None) -> dict[str, list[str]]:
    """Numeric / categorical column lists from the schema, target excluded."""
    from pyspark.sql.types import NumericType, StringType
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, StringType):
            cat.append(f.name)
    return {"numeric": num, "categorical": cat}
