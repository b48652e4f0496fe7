"""Tier-1 queries: scans, portfolio SQL, bands, monitoring views, scoreboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import expressions as X
from riskframe.operators import portfolio as P
from riskframe.plans import fixtures_sql as S
from riskframe.plans import sql_parts as Q
from riskframe.plans.catalog import edge, query
from riskframe.sources import adapters as A
from riskframe.sources import tables as TB

col = F.col
APP = S.APPLICANTS
R2 = "ROUND(CAST({} AS DOUBLE), 2)"

# ------------------------------------------------------------------ scans


@query("scan_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_scan_parquet(spark, sf):
    return TB.scan_parquet(spark, f"{sf}/customer.parquet")


@query("scan_parquet_columns", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def q_scan_parquet_columns(spark, sf):
    return TB.scan_parquet_columns(spark, f"{sf}/lineitem.parquet",
                                   ["l_orderkey", "l_quantity", "l_returnflag"])


@query("scan_table_full", S.with_(APP, "SELECT prospectid, credit_score, approved_flag FROM applicants"))
def q_scan_table_full(spark, sf):
    A.applicants(spark, sf).createOrReplaceTempView("credit_risk_data")
    return TB.scan_table_full(spark, "credit_risk_data").select("prospectid", "credit_score", "approved_flag")


# ------------------------------------------------------------------ projections / filters

@query("portfolio_projection", S.with_(APP, f"SELECT {', '.join(P.PORTFOLIO_COLUMNS)} FROM applicants"))
def q_portfolio_projection(spark, sf):
    return P.portfolio_projection(A.applicants(spark, sf))


# The columns shown and the limits of the two high-risk lists.
_RISK_1 = [("credit_score", "<", 600), ("tot_missed_pmnt", ">=", 3), ("num_times_60p_dpd", ">=", 1),
           ("num_times_delinquent", ">=", 3), ("cc_utilization", ">=", 75), ("pl_utilization", ">=", 75), ("tot_enq", ">=", 10)]
_RISK_2 = [("credit_score", "<", 610), ("num_times_delinquent", ">=", 3), ("num_times_60p_dpd", ">", 0),
           ("tot_missed_pmnt", ">=", 3), ("cc_utilization", ">=", 75), ("pl_utilization", ">=", 75)]
_SHOWN_1 = ["prospectid", "credit_score", "netmonthlyincome", "tot_active_tl", "unsecured_tl", "tot_missed_pmnt",
            "num_times_delinquent", "num_times_30p_dpd", "num_times_60p_dpd", "cc_utilization", "pl_utilization", "tot_enq",
            "approved_flag"]
_SHOWN_2 = ["prospectid", "credit_score", "num_times_delinquent", "num_times_60p_dpd", "tot_missed_pmnt", "cc_utilization",
            "pl_utilization", "tot_enq", "approved_flag"]


@query("high_risk_filter_v1", S.with_(APP, f"SELECT {', '.join(_SHOWN_1)} FROM applicants WHERE {Q.any_of(_RISK_1)}"))
def q_high_risk_v1(spark, sf):
    return P.high_risk_filter_v1(A.applicants(spark, sf))


@query("high_risk_filter_v2", S.with_(APP, f"SELECT {', '.join(_SHOWN_2)} FROM applicants WHERE {Q.any_of(_RISK_2)}"))
def q_high_risk_v2(spark, sf):
    return P.high_risk_filter_v2(A.applicants(spark, sf))


_BAND5 = Q.bands("credit_score", Q.SCORE_LEVEL)
_SEG = Q.bands("credit_score", Q.SCORE_RISK)
_BAND6 = Q.bands("credit_score", Q.SCORE_RANGE)
_BAND_REF = Q.bands("credit_score", Q.SCORE_MISLABELLED)
_DELQ = Q.bands("num_times_delinquent", Q.DELINQUENCY)
# Labels of the days-past-due segments.
_DPD = "IF(num_times_60p_dpd > 0, '60+ DPD', IF(num_times_30p_dpd > 0, '30+ DPD', 'No Serious DPD'))"


def _band_query(name, fn, sql, src_cols):
    @query(name, S.with_(APP, f"SELECT prospectid, {', '.join(src_cols)}, {sql} AS {name} FROM applicants"))
    def q(spark, sf):
        return A.applicants(spark, sf).select("prospectid", *src_cols, fn().alias(name))
    return q


_band_query("score_band_5", X.score_band_5, _BAND5, ["credit_score"])
_band_query("score_segment_risk", X.score_segment_risk, _SEG, ["credit_score"])
_band_query("score_band_6", X.score_band_6, _BAND6, ["credit_score"])
_band_query("score_band_mislabelled", X.score_band_mislabelled, _BAND_REF, ["credit_score"])
_band_query("delinquency_segment", X.delinquency_segment, _DELQ, ["num_times_delinquent"])
_band_query("dpd_segment", X.dpd_segment, _DPD, ["num_times_30p_dpd", "num_times_60p_dpd"])


_DERIVED_SQL = """
  CASE WHEN (COALESCE(num_deliq_12mts, 0) + 1) = 0 OR num_deliq_6mts IS NULL THEN 0.0
       ELSE CAST(num_deliq_6mts AS DOUBLE) / (COALESCE(num_deliq_12mts, 0) + 1) END AS delinq_velocity,
  CASE WHEN (COALESCE(enq_l12m, 0) + 1) = 0 OR enq_l3m IS NULL THEN 0.0
       ELSE CAST(enq_l3m AS DOUBLE) / (COALESCE(enq_l12m, 0) + 1) END AS enq_velocity,
  CASE WHEN (COALESCE(total_tl, 0) + 1) = 0 OR unsecured_tl IS NULL THEN 0.0
       ELSE CAST(unsecured_tl AS DOUBLE) / (COALESCE(total_tl, 0) + 1) END AS unsecured_ratio,
  CASE WHEN (COALESCE(total_tl, 0) + 1) = 0 OR tot_active_tl IS NULL THEN 0.0
       ELSE CAST(tot_active_tl AS DOUBLE) / (COALESCE(total_tl, 0) + 1) END AS active_ratio,
  CASE WHEN (COALESCE(total_tl, 0) + 1) = 0 OR total_tl_opened_l6m IS NULL THEN 0.0
       ELSE CAST(total_tl_opened_l6m AS DOUBLE) / (COALESCE(total_tl, 0) + 1) END AS recent_open_ratio,
  CAST(COALESCE(num_times_30p_dpd, 0) + 2 * COALESCE(num_times_60p_dpd, 0) AS DOUBLE) AS dpd_score,
  CAST(COALESCE(num_sub, 0) + 2 * COALESCE(num_dbt, 0) + 3 * COALESCE(num_lss, 0) AS DOUBLE) AS asset_class_score"""


@query("derived_features", S.with_(APP, f"""
SELECT prospectid, {', '.join(f'ROUND({c}, 6) AS {c}' for c in ['delinq_velocity', 'enq_velocity', 'unsecured_ratio', 'active_ratio', 'recent_open_ratio', 'dpd_score', 'asset_class_score'])}
FROM (SELECT prospectid, {_DERIVED_SQL} FROM applicants)"""))
def q_derived_features(spark, sf):
    app = A.applicants(spark, sf)
    feats = X.derived_features(app.columns)
    return edge(app.select("prospectid", *[c.alias(n) for n, c in feats.items()]))


@query("normalize_missing", S.with_(APP, """
SELECT prospectid,
  CASE WHEN cc_utilization = -99999 OR isnan(cc_utilization) OR isinf(cc_utilization) THEN NULL ELSE cc_utilization END AS cc_util_null,
  COALESCE(CASE WHEN cc_utilization = -99999 THEN NULL ELSE cc_utilization END, 0.0) AS cc_util_zero,
  ROUND(COALESCE(CASE WHEN cc_utilization = -99999 THEN NULL ELSE cc_utilization END,
        AVG(CASE WHEN cc_utilization = -99999 THEN NULL ELSE cc_utilization END) OVER ()), 6) AS cc_util_mean
FROM applicants"""))
def q_normalize_missing(spark, sf):
    app = A.applicants(spark, sf)
    clean = X.normalize_missing("cc_utilization")
    # Mean fill: one global aggregate fetched as a single scalar (as Spark ML's
    # Imputer does), then applied as a literal in a map-only projection.
    mean = app.agg(F.avg(clean)).first()[0]
    out = app.select(
        "prospectid", clean.alias("cc_util_null"),
        X.normalize_missing("cc_utilization", fill=0.0).alias("cc_util_zero"),
        X.normalize_missing("cc_utilization", fill=F.lit(mean).cast("double")).alias("cc_util_mean"))
    return edge(out)


@query("screen_bits", S.with_(APP, """
SELECT prospectid,
  (CASE WHEN COALESCE(netmonthlyincome, 0) < 20000 THEN 1 ELSE 0 END)
  | (CASE WHEN COALESCE(num_deliq_6mts, 0) > 0 THEN 2 ELSE 0 END)
  | (CASE WHEN CAST(COALESCE(unsecured_tl, 0) AS DOUBLE)
               / GREATEST(CASE WHEN COALESCE(total_tl, 0) = 0 THEN 1.0 ELSE CAST(total_tl AS DOUBLE) END, 1.0) > 0.7
          THEN 4 ELSE 0 END)
  | (CASE WHEN lower(COALESCE(last_prod_enq2, 'None')) = 'al' THEN 8 ELSE 0 END) AS screen_bits
FROM applicants"""))
def q_screen_bits(spark, sf):
    return A.applicants(spark, sf).select("prospectid", X.screen_bits().alias("screen_bits"))


@query("screen_high_risk", S.with_(APP, """
SELECT prospectid, COALESCE(num_deliq_6mts, 0) > 0 AS high_risk FROM applicants"""))
def q_screen_high_risk(spark, sf):
    return (A.applicants(spark, sf).select("prospectid", X.screen_bits().alias("b"))
            .select("prospectid", X.screen_high_risk("b").alias("high_risk")))


# ------------------------------------------------------------------ routing

def _route_cols(d: dict) -> list:
    return [c.alias(n) for n, c in d.items()]


@query("policy_route_credit", S.with_(S.SCORED, """
SELECT row_id, model,
  CASE WHEN p < 0.30 THEN 'AUTO_REJECT' WHEN p > 0.90 THEN 'AUTO_APPROVE' ELSE 'RAG_LLM' END AS decision_route,
  ROUND(p, 6) AS risk_score,
  ROUND(round_even(p * 100, 2), 6) AS risk_score_100,
  CASE WHEN p < 0.30 THEN p < 0.6 WHEN p > 0.90 THEN false ELSE true END AS needs_human_review
FROM scored"""))
def q_policy_route_credit(spark, sf):
    r = X.policy_route_credit("p")
    return edge(A.scored(spark, sf).select("row_id", "model", r["decision_route"].alias("decision_route"),
                                           r["risk_score"].alias("risk_score"),
                                           r["risk_score_100"].alias("risk_score_100"),
                                           r["needs_human_review"].alias("needs_human_review")))


@query("policy_route_manual", S.with_(S.SCORED, """
SELECT row_id, model,
  CASE WHEN p < 0.30 THEN 'AUTO_REJECT' WHEN p > 0.80 THEN 'AUTO_APPROVE' ELSE 'MANUAL_REVIEW' END AS decision_route,
  CASE WHEN p < 0.30 OR p > 0.80 THEN 'ML_Policy_Engine' ELSE 'Rule_Engine (Human review)' END AS provider
FROM scored"""))
def q_policy_route_manual(spark, sf):
    r = X.policy_route_credit("p", approve_above=0.80, middle="MANUAL_REVIEW")
    return A.scored(spark, sf).select("row_id", "model", r["decision_route"].alias("decision_route"),
                                      r["provider"].alias("provider"))


@query("policy_route_fraud", S.with_(S.SCORED, """
SELECT row_id, model,
  CASE WHEN p < 0.10 THEN 'AUTO_ALLOW' WHEN p > 0.85 THEN 'AUTO_BLOCK' ELSE 'RAG_LLM' END AS decision_route,
  CASE WHEN p < 0.10 THEN 'Low' WHEN p > 0.85 THEN 'Critical' END AS fraud_band,
  CASE WHEN p < 0.10 THEN 'allow' WHEN p > 0.85 THEN 'block' END AS recommended_action,
  CASE WHEN p < 0.10 THEN NOT (p > 0.6) WHEN p > 0.85 THEN p < 0.6 ELSE true END AS needs_human_review
FROM scored"""))
def q_policy_route_fraud(spark, sf):
    r = X.policy_route_fraud("p")
    return A.scored(spark, sf).select("row_id", "model", *[r[k].alias(k) for k in (
        "decision_route", "fraud_band", "recommended_action", "needs_human_review")])


# ------------------------------------------------------------------ monitoring views

_MON_COLS = "model_name, scored_at, gini, ks, psi, gini_min, ks_min, psi_max"
_STATUS = Q.monitor_status()
_HEALTHY = Q.monitor_passes()


@query("monitor_status", S.with_(S.MONITORING, f"""
SELECT model_name, scored_at, {_STATUS} AS status, ({_HEALTHY}) AS is_healthy FROM monitoring"""))
def q_monitor_status(spark, sf):
    return A.monitoring(spark, sf).select("model_name", "scored_at", X.monitor_status().alias("status"),
                                          X.is_healthy().alias("is_healthy"))


# the row of a model with no later one; a missing time counts as the latest
_LATEST = f"""latest AS (
  SELECT {', '.join('m.' + c for c in _MON_COLS.split(', '))}, {_STATUS} AS status, ({_HEALTHY}) AS is_healthy
  FROM monitoring AS m
  WHERE NOT EXISTS (SELECT 1 FROM monitoring AS o WHERE o.model_name = m.model_name
    AND COALESCE(o.scored_at, TIMESTAMP '9999-01-01') > COALESCE(m.scored_at, TIMESTAMP '9999-01-01')))"""


@query("latest_per_model", S.with_(S.MONITORING + ",\n" + _LATEST, "SELECT * FROM latest"))
def q_latest_per_model(spark, sf):
    return P.latest_per_model(A.monitoring(spark, sf))


@query("alerts_latest", S.with_(S.MONITORING + ",\n" + _LATEST, """
SELECT model_name, scored_at, status, gini, gini_min, ks, ks_min, psi, psi_max
FROM latest WHERE status <> 'OK'"""))
def q_alerts_latest(spark, sf):
    return P.alerts_latest(A.monitoring(spark, sf))


@query("monitoring_trend", S.with_(S.MONITORING, f"SELECT {_MON_COLS} FROM monitoring"))
def q_monitoring_trend(spark, sf):
    return P.monitoring_trend(A.monitoring(spark, sf))


@query("monitoring_recent", S.with_(S.MONITORING, f"""
SELECT model_name, gini, ks, psi, {Q.monitor_status(own_bounds=False)} AS status
FROM monitoring WHERE scored_at >= TIMESTAMP '2001-09-01' - INTERVAL 400 DAY"""))
def q_monitoring_recent(spark, sf):
    return P.monitoring_recent(A.monitoring(spark, sf), as_of="2001-09-01 00:00:00", days=400)


@query("threshold_checks", S.with_(S.MONITORING, "SELECT model_name, " + ", ".join(
    f"{m}, NOT ({m} {op} {bound}) AS {m}_ok" for m, op, bound, _ in Q.MONITOR_RULES) + " FROM monitoring"))
def q_threshold_checks(spark, sf):
    return P.threshold_checks(A.monitoring(spark, sf))


@query("alerts_any_breach", S.with_(S.MONITORING, f"SELECT {_MON_COLS} FROM monitoring WHERE " + Q.any_of(
    [(m, op, bound) for m, op, bound, _ in Q.MONITOR_RULES])))
def q_alerts_any_breach(spark, sf):
    return P.alerts_any_breach(A.monitoring(spark, sf))


@query("alerts_dashboard", S.with_(S.MODEL_METRICS, """
SELECT model_name, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision,
       ROUND(recall, 6) AS recall, ROUND(f1_score, 6) AS f1_score, ROUND(roc_auc, 6) AS roc_auc,
       CAST(NULL AS DOUBLE) AS ks, CAST(NULL AS DOUBLE) AS psi, ROUND(2 * roc_auc - 1, 6) AS gini
FROM model_metrics WHERE 2 * roc_auc - 1 < 0.30"""))
def q_alerts_dashboard(spark, sf):
    m = (A.model_metrics(spark, sf).withColumn("ks", F.lit(None).cast("double"))
         .withColumn("psi", F.lit(None).cast("double")))
    return edge(P.alerts_any_breach(m, dashboard=True))


@query("monthly_metric_by_model", S.with_(S.MONITORING, """
SELECT CAST(date_trunc('month', scored_at) AS TIMESTAMP) AS month, model_name,
       ROUND(AVG(gini), 6) AS avg_gini, ROUND(AVG(ks), 6) AS avg_ks
FROM monitoring GROUP BY 1, 2"""))
def q_monthly_metric(spark, sf):
    out = P.monthly_metric_by_model(A.monitoring(spark, sf))
    return edge(out.withColumn("month", col("month").cast("timestamp_ntz")))


@query("psi_heatmap", S.with_(S.MONITORING, """
SELECT CAST(date_trunc('month', scored_at) AS DATE) AS month,
  ROUND(AVG(CASE WHEN model_name = 'logreg' THEN psi END), 6) AS logreg,
  ROUND(AVG(CASE WHEN model_name = 'forest' THEN psi END), 6) AS forest,
  ROUND(AVG(CASE WHEN model_name = 'knn' THEN psi END), 6) AS knn
FROM monitoring GROUP BY 1"""))
def q_psi_heatmap(spark, sf):
    return edge(P.psi_heatmap(A.monitoring(spark, sf), models=[m[0] for m in A.MODELS]))


# ------------------------------------------------------------------ scoreboard

_MM = "model_name, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision, " \
      "ROUND(recall, 6) AS recall, ROUND(f1_score, 6) AS f1_score, ROUND(roc_auc, 6) AS roc_auc"


@query("model_scoreboard_rank", S.with_(S.MODEL_METRICS, f"""
SELECT {_MM}, rank() OVER (ORDER BY roc_auc DESC NULLS FIRST) AS roc_auc_rank,
       rank() OVER (ORDER BY f1_score DESC NULLS FIRST) AS f1_rank
FROM model_metrics"""))
def q_scoreboard_rank(spark, sf):
    return edge(P.model_scoreboard_rank(A.model_metrics(spark, sf)))


@query("leaderboard_sort", S.with_(S.MODEL_METRICS, f"""
SELECT {_MM}, row_number() OVER (ORDER BY roc_auc DESC NULLS LAST, model_name) - 1 AS position
FROM model_metrics"""))
def q_leaderboard(spark, sf):
    return edge(P.leaderboard_sort(A.model_metrics(spark, sf)))


@query("scoreboard_best", S.with_(S.MODEL_METRICS, """
SELECT ROUND(MAX(roc_auc), 6) AS best_auc, ROUND(MAX(f1_score), 6) AS best_f1 FROM model_metrics"""))
def q_scoreboard_best(spark, sf):
    return edge(P.scoreboard_best(A.model_metrics(spark, sf)))


# ------------------------------------------------------------------ aggregations


# Averaged columns and their output names.
_OVERVIEW = [("age", "avg_age"), ("netmonthlyincome", "avg_monthly_income"), ("credit_score", "avg_credit_score"),
             ("tot_active_tl", "avg_active_accounts"), ("tot_missed_pmnt", "avg_missed_payments")]


@query("portfolio_overview", S.with_(APP, "SELECT " + ", ".join([
    "COUNT(*) AS total_applicants", Q.count_if("approved_flag IS NOT NULL", "applicants_with_decision"),
    *[Q.mean(c, n) for c, n in _OVERVIEW]]) + " FROM applicants"))
def q_portfolio_overview(spark, sf):
    return P.portfolio_overview(A.applicants(spark, sf))


_CLASS = [("approved_flag", "approved_flag")]


@query("approval_distribution", S.with_(APP, Q.counted("applicants", _CLASS, "applicant_count", share="portofolio_percentage")))
def q_approval_distribution(spark, sf):
    return P.approval_distribution(A.applicants(spark, sf))


@query("approval_distribution_view", S.with_(APP, Q.counted(
    "applicants", _CLASS, "applications", [Q.mean("credit_score", "avg_credit_score", 6), Q.mean("netmonthlyincome", "avg_income", 6)],
    share="pct")))
def q_approval_distribution_view(spark, sf):
    return edge(P.approval_distribution_view(A.applicants(spark, sf)))


@query("share_of_total", S.with_(APP, Q.counted("applicants", _CLASS, "applicants", share="percentage")))
def q_share_of_total(spark, sf):
    return P.approval_share_by_class(A.applicants(spark, sf))


@query("score_stats_by_class", S.with_(APP, Q.counted("applicants", _CLASS, "applicants", [
    Q.mean("credit_score", "avg_credit_score"), *[f"{f}(credit_score) AS {f.lower()}_credit_score" for f in ("MIN", "MAX")]])))
def q_score_stats(spark, sf):
    return P.score_stats_by_class(A.applicants(spark, sf))


@query("score_band_summary", S.with_(APP, Q.counted("applicants", [(_BAND5, "credit_score_band")], "applicants", [
    Q.mean("netmonthlyincome", "avg_income"), Q.mean("tot_missed_pmnt", "avg_missed_payment"),
    Q.mean("tot_active_tl", "avg_active_accounts")])))
def q_score_band_summary(spark, sf):
    return P.score_band_summary(A.applicants(spark, sf))


# Class and output column of its count.
_CLASS_COUNTS = [("P1", "p1_auto_approved"), ("P2", "p2_standard_approved"), ("P3", "p3_conditional_approved"),
                 ("P4", "p4_direct_reject_approved")]


@query("band_class_pivot", S.with_(APP, "SELECT *, ROUND(p1_auto_approved * 100.0 / applicants, 2) AS p1_rate FROM (" + Q.counted(
    "applicants", [(_BAND_REF, "score_credit")], "applicants",
    [Q.count_if(f"approved_flag = '{c}'", n) for c, n in _CLASS_COUNTS]) + ")"))
def q_band_class_pivot(spark, sf):
    return P.band_class_pivot(A.applicants(spark, sf))


@query("dpd_summary", S.with_(APP, Q.counted("applicants", [(_DPD, "dpd_segment")], "applicants", [
    Q.mean("credit_score", "avg_credit_score"), "SUM(tot_missed_pmnt) AS sum_missed_payments", Q.mean("netmonthlyincome", "avg_income")])))
def q_dpd_summary(spark, sf):
    return P.dpd_summary(A.applicants(spark, sf))


@query("score_band_by_class", S.with_(APP, Q.counted("applicants", [*_CLASS, (_BAND6, "score_band")], "applications")))
def q_score_band_by_class(spark, sf):
    return P.score_band_by_class(A.applicants(spark, sf))


@query("value_counts", S.with_(APP, Q.counted(
    "applicants", [("education", "education")], "count", share="percent", where="education IS NOT NULL")))
def q_value_counts(spark, sf):
    return P.value_counts(A.applicants(spark, sf), "education", normalize=True)


@query("value_counts_dropna_false", S.with_(APP, Q.counted("applicants", [("last_prod_enq2", "last_prod_enq2")], "count")))
def q_value_counts_nulls(spark, sf):
    return P.value_counts(A.applicants(spark, sf), "last_prod_enq2", dropna=False)


_APP_COLS = ["prospectid", "age", "gender", "maritalstatus", "education", "netmonthlyincome",
             "credit_score", "approved_flag", "total_tl", "tot_closed_tl", "tot_active_tl",
             "total_tl_opened_l6m", "secured_tl", "unsecured_tl", "tot_missed_pmnt",
             "num_times_delinquent", "num_times_30p_dpd", "num_times_60p_dpd", "num_deliq_6mts",
             "num_deliq_12mts", "num_std", "num_sub", "num_dbt", "num_lss", "tot_enq", "enq_l3m",
             "enq_l12m", "cc_enq_l6m", "pl_enq_l6m", "max_delinquency_level", "cc_utilization",
             "pl_utilization", "first_prod_enq2", "last_prod_enq2", "created_at"]


@query("null_profile", S.with_(APP, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM applicants"
    for c in _APP_COLS)))
def q_null_profile(spark, sf):
    return P.null_profile(A.applicants(spark, sf))


@query("class_labels", S.with_(APP, """
SELECT list_sort(list(DISTINCT approved_flag) FILTER (WHERE approved_flag IS NOT NULL)) AS classes FROM applicants"""))
def q_class_labels(spark, sf):
    return P.class_labels(A.applicants(spark, sf), "approved_flag")


# ------------------------------------------------------------------ joins

@query("merge_sources_inner", S.with_(APP, """
SELECT a.prospectid, a.credit_score, a.approved_flag, a.total_tl, c.c_acctbal, c.c_mktsegment
FROM applicants a JOIN customer c ON a.prospectid = c.c_custkey"""))
def q_merge_sources_inner(spark, sf):
    internal = A.applicants(spark, sf).select("prospectid", "credit_score", "approved_flag", "total_tl")
    external = TB.table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"]) \
        .withColumnRenamed("c_custkey", "prospectid")
    return P.merge_sources_inner(internal, external)


@query("segment_inner_join", S.with_(APP, f"""
SELECT prospectid, credit_score, {_SEG} AS score_segment, approved_flag, netmonthlyincome FROM applicants"""))
def q_segment_inner_join(spark, sf):
    # prospectid is the table's key, so the self-join keeps every row once
    return P.segment_inner_join(A.applicants(spark, sf))


@query("segment_left_join", S.with_(APP, f"""
SELECT prospectid, credit_score, approved_flag, num_times_delinquent, {_DELQ} AS delinquency_segment FROM applicants"""))
def q_segment_left_join(spark, sf):
    return P.segment_left_join(A.applicants(spark, sf))


@query("row_limit", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_row_limit(spark, sf):
    o = TB.table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return P.row_limit(o.withColumn("negated", -col("o_totalprice")), 20, ["negated", "o_orderkey"]).drop("negated")
