"""Tier-2/3 queries: data preparation, loan book, selection, significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import expressions as X
from riskframe.operators import loanbook as LB
from riskframe.operators import monitoring as M
from riskframe.operators import selection as SEL
from riskframe.operators import stats as ST
from riskframe.plans import fixtures_sql as S
from riskframe.plans.catalog import edge, query
from riskframe.sources import adapters as A
from riskframe.sources import tables as TB

col = F.col
APP = S.APPLICANTS
NUM = ["credit_score", "netmonthlyincome", "total_tl", "age", "tot_missed_pmnt"]


def roc_sql(keys: list[str], source: str, label: str = "y", score: str = "p") -> str:
    """Single-level (DuckDB) AUC/KS per ``keys`` over ``source`` rows."""
    k = ", ".join(keys)
    return f"""rc AS (SELECT {k}, {score} AS p, CAST(SUM({label}) AS BIGINT) AS pos,
                 CAST(COUNT(*) - SUM({label}) AS BIGINT) AS neg FROM {source} GROUP BY {k}, {score}),
rw AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_lt,
         SUM(pos) OVER (PARTITION BY {k}) AS ptot, SUM(neg) OVER (PARTITION BY {k}) AS ntot FROM rc),
rr AS (SELECT {k}, SUM(CAST(pos AS DOUBLE) * (neg_lt + neg / 2.0)) / (CAST(MAX(ptot) AS DOUBLE) * MAX(ntot)) AS auc
       FROM rw GROUP BY {k})"""


# ------------------------------------------------------------------ profiles

def _profile_sql(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    qs = ", ".join(f"ROUND(quantile_cont({x}, {q}), 6) AS p{int(round(q * 100))}"
                   for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    return (f"SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG({x}), 6) AS mean, "
            f"ROUND(STDDEV_SAMP({x}), 6) AS std, ROUND(MIN({x}), 6) AS min, ROUND(MAX({x}), 6) AS max, {qs} FROM applicants")


@query("numeric_profile", S.with_(APP, "\nUNION ALL\n".join(_profile_sql(c) for c in NUM)))
def q_numeric_profile(spark, sf):
    return edge(ST.numeric_profile(A.applicants(spark, sf), NUM))


@query("bulk_quantile", S.with_(APP, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.95), 6) AS q95 FROM applicants" for c in NUM)))
def q_bulk_quantile(spark, sf):
    return edge(ST.bulk_quantile(A.applicants(spark, sf), NUM, 0.95))


_FLAGS = ["P1", "P2", "P3", "P4"]


@query("crosstab", S.with_(APP, "SELECT education, " + ", ".join(
    f"COUNT(*) FILTER (WHERE approved_flag = '{f}') AS {f}" for f in _FLAGS)
    + " FROM applicants GROUP BY education"))
def q_crosstab(spark, sf):
    return ST.crosstab(A.applicants(spark, sf), "education", "approved_flag", _FLAGS)


# ------------------------------------------------------------------ loan book

@query("npf_by_vintage", S.with_(S.PORTFOLIO, """
SELECT vintage, COUNT(*) AS loans, ROUND(AVG(dpd30_flag), 6) AS npf FROM portfolio GROUP BY vintage"""))
def q_npf(spark, sf):
    return edge(LB.npf_by_vintage(A.portfolio(spark, sf)))


@query("fpd30", S.with_(S.PORTFOLIO, "SELECT ROUND(AVG(first_payment_miss), 6) AS fpd30 FROM portfolio"))
def q_fpd30(spark, sf):
    return edge(LB.fpd30(A.portfolio(spark, sf)))


@query("band_outcomes", S.with_(S.PORTFOLIO, """
SELECT decision_band, COUNT(*) AS loans, ROUND(AVG(dpd30_flag), 6) AS npf, ROUND(AVG(first_payment_miss), 6) AS fpd30
FROM portfolio GROUP BY decision_band"""))
def q_band_outcomes(spark, sf):
    return edge(LB.band_outcomes(A.portfolio(spark, sf), "decision_band"))


def _bt(spark, sf):
    p = A.portfolio(spark, sf)
    return p.select(col("dpd30_flag").alias("observed_bad"),
                    F.when((col("loan_id") * 11) % 100 < 8, 1).otherwise(0).alias("vendor_flag"))


@query("vendor_backtest", S.with_(S.PORTFOLIO + """,
bt AS (SELECT dpd30_flag AS observed_bad, CASE WHEN (loan_id * 11) % 100 < 8 THEN 1 ELSE 0 END AS vendor_flag FROM portfolio),
g AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE observed_bad = 0) AS nv_good, COUNT(*) FILTER (WHERE observed_bad = 1) AS nv_bad,
        COUNT(*) FILTER (WHERE vendor_flag = 0 AND observed_bad = 0) AS v_good,
        COUNT(*) FILTER (WHERE vendor_flag = 0 AND observed_bad = 1) AS v_bad FROM bt)""", """
SELECT 'no_vendor' AS policy, nv_good AS approved_good, nv_bad AS approved_bad, 0.0::DOUBLE AS vendor_cost,
       ROUND(nv_good * 40.0 - nv_bad * 500.0, 6) AS net, 0.0::DOUBLE AS delta_vs_no_vendor, 0.0::DOUBLE AS roi FROM g
UNION ALL
SELECT 'with_vendor', v_good, v_bad, n * 2.5, ROUND(v_good * 40.0 - v_bad * 500.0 - n * 2.5, 6),
       ROUND((v_good * 40.0 - v_bad * 500.0 - n * 2.5) - (nv_good * 40.0 - nv_bad * 500.0), 6),
       ROUND(((v_good * 40.0 - v_bad * 500.0 - n * 2.5) - (nv_good * 40.0 - nv_bad * 500.0)) / GREATEST(n * 2.5, 1e-9), 6) FROM g"""))
def q_vendor(spark, sf):
    return edge(LB.vendor_backtest(_bt(spark, sf)))


@query("histogram_fixed_bins", S.with_(APP + """,
mm AS (SELECT MIN(netmonthlyincome) AS lo, MAX(netmonthlyincome) AS hi FROM applicants),
hb AS (SELECT LEAST(FLOOR((netmonthlyincome - lo) / ((hi - lo) / 40.0)), 39) AS bin, lo, (hi - lo) / 40.0 AS w
       FROM applicants, mm WHERE netmonthlyincome IS NOT NULL)""", """
SELECT CAST(bin AS INTEGER) AS bin, ROUND(MAX(lo + bin * w), 6) AS bin_lo, ROUND(MAX(lo + (bin + 1) * w), 6) AS bin_hi,
       COUNT(*) AS count FROM hb GROUP BY bin"""))
def q_hist(spark, sf):
    return edge(LB.histogram_fixed_bins(A.applicants(spark, sf), "netmonthlyincome", 40))


@query("histogram_cumulative", S.with_(S.SCORED + """,
g AS (SELECT model, COUNT(p) AS count, ROUND(SUM(p), 6) AS sum, """ + ", ".join(
    f"COUNT(*) FILTER (WHERE p <= {b}) AS le_{i}" for i, b in enumerate(LB.LE_BUCKETS)) + " FROM scored GROUP BY model)", "\nUNION ALL\n".join(
    [f"SELECT model, count, sum, '{b}' AS le, le_{i} AS bucket_count FROM g" for i, b in enumerate(LB.LE_BUCKETS)]
    + ["SELECT model, count, sum, '+Inf' AS le, count AS bucket_count FROM g"])))
def q_hist_cum(spark, sf):
    return edge(LB.histogram_cumulative(A.scored(spark, sf), "p", ["model"]))


@query("run_provider_counts", S.with_(S.SCORED + """,
d AS (SELECT CASE WHEN p < 0.30 THEN 'AUTO_REJECT' WHEN p > 0.80 THEN 'AUTO_APPROVE' ELSE 'MANUAL_REVIEW' END AS decision_route,
             CASE WHEN p < 0.30 OR p > 0.80 THEN 'ML_Policy_Engine' ELSE 'Rule_Engine (Human review)' END AS provider
      FROM scored)""", """
SELECT decision_route, provider, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
FROM d GROUP BY 1, 2"""))
def q_run_provider(spark, sf):
    r = X.policy_route_credit("p", approve_above=0.80, middle="MANUAL_REVIEW")
    d = A.scored(spark, sf).select(r["decision_route"].alias("decision_route"), r["provider"].alias("provider"))
    return edge(LB.run_provider_counts(d))


@query("distinct_sources", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def q_distinct_sources(spark, sf):
    return LB.distinct_sorted(TB.table(spark, sf, "documents", ["source"]), "source")


@query("device_sharing_count", S.with_(S.REQUESTS, """
SELECT device_id, COUNT(DISTINCT customer_id) AS n_customers FROM requests GROUP BY device_id"""))
def q_device_sharing(spark, sf):
    return LB.device_sharing_count(A.requests(spark, sf))


@query("facts_payload")
def q_facts(spark, sf):
    mc = M.predicted_class(A.multiclass_scored(spark, sf))
    n = mc.where(col("model") == "logreg").agg(F.count("*").alias("n"))
    cls = mc.where(col("model") == "logreg").groupBy(col("y").alias("cls")).agg(F.count("*").alias("n"))
    mets = M.weighted_prf(mc, "model")
    return LB.facts_payload(n, cls, mets, "logreg", "2001-09-01", {"gini_min": 0.3, "ks_min": 0.2, "psi_max": 0.25})


# ------------------------------------------------------------------ feature rules

@query("secured_account_flag", S.with_(APP, """
SELECT prospectid, CASE WHEN secured_tl - unsecured_tl > 1 THEN 1 ELSE 0 END AS secured_account FROM applicants"""))
def q_secured(spark, sf):
    return A.applicants(spark, sf).select("prospectid", X.secured_account_flag().alias("secured_account"))


def _fraud_df(spark, sf):
    app = A.applicants(spark, sf).withColumn("secured_account", X.secured_account_flag())
    return app.select("prospectid", LB.fraud_label_rule(app, cc12="enq_l12m", pl12="tot_enq").alias("fraud"))


_FRAUD_SQL = APP + """,
fr AS (SELECT prospectid,
  CASE WHEN (approved_flag IN ('P1', 'P2') AND secured_tl - unsecured_tl > 1 OR approved_flag IN ('P1', 'P2') AND NOT (secured_tl - unsecured_tl > 1))
         OR (approved_flag IN ('P3', 'P4') AND credit_score <= 750 AND enq_l12m >= 1 AND secured_tl - unsecured_tl > 1)
       THEN 1 ELSE 0 END AS fraud FROM applicants)"""


@query("fraud_label_rule", S.with_(_FRAUD_SQL, "SELECT prospectid, fraud FROM fr"))
def q_fraud(spark, sf):
    return _fraud_df(spark, sf)


@query("fraud_value_counts", S.with_(_FRAUD_SQL, """
SELECT fraud, COUNT(*) AS count, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS rate FROM fr GROUP BY fraud"""))
def q_fraud_counts(spark, sf):
    from pyspark.sql import Window
    g = _fraud_df(spark, sf).groupBy("fraud").agg(F.count("*").alias("count"))
    return edge(g.withColumn("rate", col("count") / F.sum("count").over(Window.partitionBy())))


@query("propensity_label", S.with_(APP, """
SELECT prospectid, CASE WHEN lower(trim(last_prod_enq2)) IS NULL THEN 1
  WHEN lower(trim(last_prod_enq2)) IN ('none', 'others', 'nan', '') THEN 0 ELSE 1 END AS propensity FROM applicants"""))
def q_propensity(spark, sf):
    return A.applicants(spark, sf).select("prospectid", X.propensity_label().alias("propensity"))


@query("positive_income_mask", S.with_(APP, "SELECT prospectid, netmonthlyincome FROM applicants WHERE netmonthlyincome > 0"))
def q_pos_income(spark, sf):
    return A.applicants(spark, sf).where(col("netmonthlyincome") > 0).select("prospectid", "netmonthlyincome")


@query("first_product_remap", S.with_(APP, """
SELECT prospectid, CASE first_prod_enq2 WHEN 'PL' THEN 'P1' WHEN 'CC' THEN 'P2' WHEN 'ConsumerLoan' THEN 'P3' ELSE 'P4' END AS first_prod
FROM applicants"""))
def q_first_prod(spark, sf):
    return A.applicants(spark, sf).select("prospectid", X.first_product_remap().alias("first_prod"))


@query("align_features", """
SELECT event_id, COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -99999.0) AS k,
       -99999.0 AS income FROM events""")
def q_align(spark, sf):
    from riskframe.operators.features import align_features
    e = TB.table(spark, sf, "events", ["event_id", "props"])
    payload = e.select("event_id", F.from_json("props", "map<string,string>").alias("payload"))
    return align_features(payload, "payload", ["k", "income"], fill=-99999.0, keep=["event_id"])


@query("class_decision_flag", S.with_(S.MC_PRED, """
SELECT row_id, model, pred, CASE WHEN pred = 0 THEN 'APPROVED' ELSE 'REVIEW' END AS decision,
       ROUND(list_max(probs), 6) AS confidence FROM mcp"""))
def q_class_flag(spark, sf):
    mc = M.predicted_class(A.multiclass_scored(spark, sf))
    return edge(mc.select("row_id", "model", "pred", X.class_decision_flag("pred").alias("decision"),
                          F.array_max("probs").alias("confidence")))


@query("argmax_class", S.with_(S.MC_PRED, "SELECT row_id, model, pred FROM mcp"))
def q_argmax(spark, sf):
    mc = A.multiclass_scored(spark, sf)
    return mc.select("row_id", "model", X.argmax_class("probs").alias("pred"))


# ------------------------------------------------------------------ selection

@query("champion_top1", S.with_(S.MODEL_METRICS, """
SELECT model_name AS champion, ROUND(f1_score, 6) AS metric_value, f1_score >= 0.70 AS approved
FROM model_metrics ORDER BY f1_score DESC, model_name DESC LIMIT 1"""))
def q_champion(spark, sf):
    return edge(SEL.champion_top1(A.model_metrics(spark, sf)))


_FEATS7 = ["delinq_velocity", "enq_velocity", "unsecured_ratio", "active_ratio", "recent_open_ratio", "dpd_score",
           "asset_class_score"]


def _topk_sql() -> str:
    from riskframe.plans.portfolio_queries import _DERIVED_SQL
    items = ", ".join(f"{{'neg': -abs({c}), 'name': '{c}', 'value': {c}}}" for c in _FEATS7)
    return S.with_(APP + f",\nd AS (SELECT prospectid, {_DERIVED_SQL} FROM applicants)", f"""
SELECT prospectid, list_transform(top, lambda s: s.name) AS top3_names,
       list_transform(top, lambda s: ROUND(s.value, 6)) AS top3_values
FROM (SELECT prospectid, list_slice(list_sort([{items}]), 1, 3) AS top FROM d)""")


@query("top_k_features", _topk_sql())
def q_topk(spark, sf):
    app = A.applicants(spark, sf)
    feats = X.derived_features(app.columns)
    names = list(feats)
    arr = F.array(*[feats[n] for n in names])
    top = SEL.top_k_per_row(arr, names, 3)
    return app.select("prospectid", F.transform(top, lambda s: s["name"]).alias("top3_names"),
                      F.transform(top, lambda s: F.round(s["value"], 6)).alias("top3_values"))


@query("seeded_sample", S.with_(APP, """
SELECT prospectid, credit_score FROM applicants ORDER BY md5('42:' || CAST(prospectid AS VARCHAR)), prospectid LIMIT 100"""))
def q_sample(spark, sf):
    return SEL.seeded_sample(A.applicants(spark, sf).select("prospectid", "credit_score"), 100, "prospectid")


@query("stratified_split", S.with_(APP + """,
n AS (SELECT approved_flag, COUNT(*) AS n FROM applicants GROUP BY approved_flag)""", """
SELECT * FROM (
  SELECT approved_flag, 'test' AS split, CAST(ROUND(n * 0.19999999999999996) AS BIGINT) AS n FROM n
  UNION ALL
  SELECT approved_flag, 'train', n - CAST(ROUND(n * 0.19999999999999996) AS BIGINT) FROM n)
WHERE n > 0"""))
def q_split(spark, sf):
    s = SEL.stratified_split(A.applicants(spark, sf).select("prospectid", "approved_flag"),
                             "approved_flag", "prospectid")
    return s.groupBy("approved_flag", "split").agg(F.count("*").alias("n"))


@query("max_score_applicant", S.with_(S.SCORED, """
SELECT model, arg_max(row_id, (p, row_id)) AS row_id, ROUND(MAX(p), 6) AS p FROM scored GROUP BY model"""))
def q_max_score(spark, sf):
    s = A.scored(spark, sf).select("model", "row_id", "p")
    g = s.groupBy("model").agg(F.max(F.struct("p", "row_id")).alias("m"))
    return edge(g.select("model", col("m.row_id").alias("row_id"), col("m.p").alias("p")))


@query("first_row_per_key", S.with_(S.REQUESTS, """
SELECT customer_id, ts, event_id, bucket FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS rn FROM requests) WHERE rn = 1"""))
def q_first_row(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "ts", "event_id", "bucket")
    return SEL.first_row_per_key(r, "customer_id", ["ts", "event_id"])


# ------------------------------------------------------------------ tests of association

_CAT = ["gender", "maritalstatus", "education"]


def _chi_sql(f: str) -> str:
    return f"""SELECT '{f}' AS feature, level, t, o, r, c, n, nr, nc FROM (
  SELECT lv.level, tv.t, COALESCE(ob.o, 0) AS o, lv.r, tv.c, tot.n, tot.nr, tot.nc
  FROM (SELECT {f} AS level, COUNT(*) AS r FROM applicants WHERE {f} IS NOT NULL AND approved_flag IS NOT NULL GROUP BY 1) lv
  CROSS JOIN (SELECT approved_flag AS t, COUNT(*) AS c FROM applicants WHERE {f} IS NOT NULL AND approved_flag IS NOT NULL GROUP BY 1) tv
  CROSS JOIN (SELECT COUNT(*) AS n, COUNT(DISTINCT {f}) AS nr, COUNT(DISTINCT approved_flag) AS nc FROM applicants
              WHERE {f} IS NOT NULL AND approved_flag IS NOT NULL) tot
  LEFT JOIN (SELECT {f} AS level, approved_flag AS t, COUNT(*) AS o FROM applicants
             WHERE {f} IS NOT NULL AND approved_flag IS NOT NULL GROUP BY 1, 2) ob
    ON ob.level = lv.level AND ob.t = tv.t)"""


@query("chi_square_test", S.with_(APP + ",\ncells AS (" + "\nUNION ALL\n".join(_chi_sql(f) for f in _CAT) + """),
adj AS (SELECT feature, (nr - 1) * (nc - 1) AS dof, CAST(r AS DOUBLE) * c / n AS e,
          CASE WHEN (nr - 1) * (nc - 1) = 1 THEN ABS(o - CAST(r AS DOUBLE) * c / n) - LEAST(0.5, ABS(o - CAST(r AS DOUBLE) * c / n))
               ELSE ABS(o - CAST(r AS DOUBLE) * c / n) END AS d FROM cells)""", """
SELECT feature, ROUND(SUM(d * d / e), 6) AS chi2, MAX(dof) AS dof FROM adj GROUP BY feature"""))
def q_chi2(spark, sf):
    t = ST.chi_square_test(A.applicants(spark, sf), _CAT, "approved_flag")
    return edge(t.select("feature", "chi2", "dof"))


@query("chi_square_pvalue")
def q_chi2_p(spark, sf):
    return edge(ST.chi_square_test(A.applicants(spark, sf), _CAT, "approved_flag"))


_TARGET = "CAST(substr(approved_flag, 2, 1) AS INTEGER) - 1"


@query("target_correlation", S.with_(APP, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, ROUND(corr(CAST({c} AS DOUBLE), CAST({_TARGET} AS DOUBLE)), 6) AS corr FROM applicants"
    for c in NUM if c != "credit_score")))
def q_corr(spark, sf):
    app = A.applicants(spark, sf).withColumn("target", F.substring("approved_flag", 2, 1).cast("int") - 1)
    return edge(ST.target_correlation(app, [c for c in NUM if c != "credit_score"], "target"))


_STRONGEST = 10
_MANY = ["netmonthlyincome", "total_tl", "tot_active_tl", "tot_closed_tl", "secured_tl", "unsecured_tl", "tot_missed_pmnt",
         "num_times_delinquent", "num_times_30p_dpd", "num_std", "tot_enq", "enq_l12m", "age", "pl_utilization"]


@query("correlation_matrix", S.with_(APP + ",\nlong AS (" + "\nUNION ALL\n".join(
    f"SELECT prospectid, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, CAST({_TARGET} AS DOUBLE) AS t FROM applicants"
    for c in _MANY) + f"""),
strongest AS (SELECT feature FROM long GROUP BY feature HAVING corr(v, t) IS NOT NULL
              ORDER BY ABS(corr(v, t)) DESC, feature LIMIT {_STRONGEST})""", """
SELECT x.feature, y.feature AS other, ROUND(corr(x.v, y.v), 6) AS corr
FROM long x JOIN long y ON x.prospectid = y.prospectid
WHERE x.feature IN (FROM strongest) AND y.feature IN (FROM strongest) GROUP BY ALL"""))
def q_corr_matrix(spark, sf):
    """Correlations among the ten features that correlate most with the target."""
    app = A.applicants(spark, sf).withColumn("target", F.substring("approved_flag", 2, 1).cast("int") - 1)
    return edge(ST.correlation_matrix(app, _MANY, "target", _STRONGEST))


_VIF = ["credit_score", "total_tl", "tot_active_tl", "age"]


def _vif_sql() -> str:
    """1 / (1 - R^2) without intercept, R^2 of each column on the others by Cramer's rule."""
    cols = _VIF

    def minor(rows: list[int], cs: list[int]) -> str:
        if len(rows) == 1:
            return f"g{min(rows[0], cs[0])}{max(rows[0], cs[0])}"
        return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'} g{min(rows[0], c)}{max(rows[0], c)} * {minor(rows[1:], cs[:j] + cs[j + 1:])}"
                              for j, c in enumerate(cs)) + ")"

    every = list(range(len(cols)))
    sums = ", ".join(f"SUM(CAST({cols[i]} AS DOUBLE) * {cols[j]}) AS g{i}{j}" for i in every for j in every if j >= i)
    some = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    # (X'X)_ii times the i-th diagonal entry of the inverse, a ratio of determinants
    rows = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, g{i}{i} * {minor([k for k in every if k != i], [k for k in every if k != i])} / {minor(every, every)} AS v FROM g"
        for i, c in enumerate(cols))
    return S.with_(APP + f",\ng AS (SELECT {sums} FROM applicants WHERE {some})",
                   f"SELECT feature, ROUND(v, 6) AS vif, v > 10 AS high FROM ({rows})")


@query("vif", _vif_sql())
def q_vif(spark, sf):
    return edge(ST.vif(A.applicants(spark, sf), _VIF))


@query("iqr_outliers", S.with_(APP, "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower,
       ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
       quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM applicants)""" for c in NUM)))
def q_iqr(spark, sf):
    return edge(ST.iqr_fences(A.applicants(spark, sf), NUM))


@query("iqr_clip_rows", S.with_(APP + ",\nf AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_q3"
    for c in NUM) + " FROM applicants)", "SELECT prospectid, " + ", ".join(
    f"ROUND(CASE WHEN {c} IS NULL THEN NULL ELSE LEAST(GREATEST(CAST({c} AS DOUBLE), {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)), "
    f"{c}_q3 + 1.5 * ({c}_q3 - {c}_q1)) END, 6) AS {c}" for c in NUM) + " FROM applicants, f"))
def q_iqr_clip(spark, sf):
    return edge(ST.iqr_clip(A.applicants(spark, sf).select("prospectid", *NUM), NUM))


#: A long-tailed column beside the others, so that one is flagged.
_TAIL = "power(netmonthlyincome / 1000.0D, 6)"


@query("skew_report", S.with_(APP, "\nUNION ALL\n".join(
    f"SELECT '{n}' AS column_name, ROUND(skewness(CAST({c} AS DOUBLE)), 6) AS skew, ABS(skewness(CAST({c} AS DOUBLE))) > 1 AS skewed FROM applicants"
    for n, c in [*((c, c) for c in NUM), ("income_tail", _TAIL.replace("D", "")) ])))
def q_skew(spark, sf):
    return edge(ST.skew_report(A.applicants(spark, sf).withColumn("income_tail", F.expr(_TAIL)), [*NUM, "income_tail"]))


@query("mean_impute", S.with_(APP, """
SELECT prospectid, ROUND(COALESCE(CAST(age AS DOUBLE), AVG(age) OVER ()), 6) AS age,
       ROUND(COALESCE(CAST(credit_score AS DOUBLE), AVG(credit_score) OVER ()), 6) AS credit_score,
       ROUND(COALESCE(CAST(max_delinquency_level AS DOUBLE), AVG(max_delinquency_level) OVER ()), 6) AS max_delinquency_level
FROM applicants"""))
def q_mean_impute(spark, sf):
    cols = ["age", "credit_score", "max_delinquency_level"]
    return edge(ST.mean_impute(A.applicants(spark, sf).select("prospectid", *cols), cols))


_REG = """li AS (SELECT l_orderkey, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS yhat FROM lineitem GROUP BY l_orderkey),
rg AS (SELECT o_totalprice AS y, yhat FROM orders JOIN li ON o_orderkey = l_orderkey),
bm AS (SELECT AVG(o_totalprice) AS b FROM orders)"""


@query("regression_metrics", S.with_(_REG, """
SELECT ROUND(AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100, 6) AS mape, ROUND(AVG(ABS(y - yhat)), 6) AS mae,
  ROUND(AVG(CASE WHEN y <> 0 THEN ABS((y - b) / y) END) * 100, 6) AS baseline_mape,
  ROUND(1 - SUM((y - yhat) * (y - yhat)) / (SUM(y * y) - SUM(y) * SUM(y) / COUNT(y)), 6) AS r2,
  ROUND(AVG(CASE WHEN y <> 0 THEN ABS((y - b) / y) END) * 100 - AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100, 6) AS improvement
FROM rg, bm"""))
def q_regression(spark, sf):
    li = TB.table(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_tax"])
    o = TB.table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    yhat = li.groupBy("l_orderkey").agg(
        F.sum(col("l_extendedprice") * (1 - col("l_discount")) * (1 + col("l_tax"))).alias("yhat"))
    j = o.join(yhat, o.o_orderkey == yhat.l_orderkey).select(col("o_totalprice").alias("y"), "yhat")
    b = o.agg(F.avg("o_totalprice")).first()[0]
    return edge(ST.regression_metrics(j, "y", "yhat", baseline=b))


@query("seed_stability_cv", S.with_(S.SCORED + ",\nsf AS (SELECT *, row_id % 4 AS seed FROM scored WHERE split = 'test'),\n"
                                    + roc_sql(["model", "seed"], "sf"), """
SELECT model, ROUND(100 * STDDEV_POP(auc) / GREATEST(AVG(auc), 1e-9), 6) AS auc_cv_pct FROM rr GROUP BY model"""))
def q_seed_cv(spark, sf):
    t = A.scored(spark, sf).where(col("split") == "test").withColumn("seed", col("row_id") % 4)
    per = M.roc_summary(t, ["model", "seed"])
    return edge(ST.seed_stability_cv(per, "model", ["auc"]))


@query("bootstrap_ci")
def q_bootstrap(spark, sf):
    t = A.scored(spark, sf).where(col("split") == "test")
    return ST.bootstrap_auc(t, "model", n_boot=300)


@query("auc_delta_pvalue")
def q_delta(spark, sf):
    """The champion (logreg) against every other model."""
    s = A.scored(spark, sf).where(col("split") == "test")
    a = s.where(col("model") == "logreg").select("row_id", "y", col("p").alias("p_a"))
    out = None
    for name in [m[0] for m in A.MODELS if m[0] != "logreg"]:
        b = s.where(col("model") == name).select("row_id", col("p").alias("p_b"))
        one = ST.auc_delta_pvalue(a.join(b, "row_id"), "y", "p_a", "p_b", n_boot=300).withColumn("challenger", F.lit(name))
        out = one if out is None else out.union(one)
    return out


@query("bootstrap_ci_weighted")
def q_bootstrap_weighted(spark, sf):
    """Intervals of weighted one-vs-rest AUC and weighted F1 per model."""
    return ST.bootstrap_weighted(A.multiclass_scored(spark, sf), n_boot=300)


@query("auc_delta_pvalue_weighted")
def q_delta_weighted(spark, sf):
    """The champion (logreg) against every challenger on weighted one-vs-rest AUC."""
    return ST.paired_pvalues(A.multiclass_scored(spark, sf), "logreg", n_boot=300)


_REMOVE = ["credit_score", "netmonthlyincome", "tot_missed_pmnt"]


def _remove_sql() -> str:
    steps, last = [], "applicants"
    for i, c in enumerate(_REMOVE):
        steps.append(f"""f{i} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {last}),
s{i} AS (SELECT t.* FROM {last} t, f{i} WHERE {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))""")
        last = f"s{i}"
    return S.with_(",\n".join([APP, *steps]), f"SELECT prospectid, {', '.join(_REMOVE)} FROM {last}")


@query("iqr_remove_rows", _remove_sql())
def q_iqr_remove(spark, sf):
    return ST.iqr_remove(A.applicants(spark, sf).select("prospectid", *_REMOVE), _REMOVE)
