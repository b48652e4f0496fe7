"""Tier-2/3 monitoring statistics: AUC, Gini, KS, PSI, PR, multi-class metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import monitoring as M
from riskframe.plans import fixtures_sql as S
from riskframe.plans.catalog import edge, query
from riskframe.sources import adapters as A

col = F.col

# Shared oracle CTEs: distinct-score counts and single-level prefix sums
# (DuckDB runs these in one process; the Spark side uses two levels).
_ROC_BODY = """c AS (SELECT model, p, CAST(SUM(y) AS BIGINT) AS pos, CAST(COUNT(*) - SUM(y) AS BIGINT) AS neg
      FROM scored WHERE split = 'test' GROUP BY model, p),
w AS (SELECT model, p, pos, neg,
        COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_lt,
        COALESCE(SUM(pos) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_lt,
        SUM(pos) OVER (PARTITION BY model) AS ptot, SUM(neg) OVER (PARTITION BY model) AS ntot
      FROM c),
roc AS (SELECT model, CAST(MAX(ptot) AS BIGINT) AS n_pos, CAST(MAX(ntot) AS BIGINT) AS n_neg,
          SUM(CAST(pos AS DOUBLE) * (neg_lt + neg / 2.0)) / (CAST(MAX(ptot) AS DOUBLE) * MAX(ntot)) AS auc,
          MAX(ABS(CAST(neg_lt AS DOUBLE) / ntot - CAST(pos_lt AS DOUBLE) / ptot)) AS ks
        FROM w GROUP BY model)"""
_ROC = S.SCORED + ",\n" + _ROC_BODY


def _test(spark, sf):
    return A.scored(spark, sf).where(col("split") == "test")


@query("auc_binary", S.with_(_ROC, "SELECT model, n_pos, n_neg, ROUND(auc, 6) AS auc FROM roc"))
def q_auc(spark, sf):
    return edge(M.roc_summary(_test(spark, sf), "model").select("model", "n_pos", "n_neg", "auc"))


@query("gini", S.with_(_ROC, "SELECT model, ROUND(2 * auc - 1, 6) AS gini FROM roc"))
def q_gini(spark, sf):
    return edge(M.roc_summary(_test(spark, sf), "model").select("model", "gini"))


@query("ks", S.with_(_ROC, "SELECT model, ROUND(ks, 6) AS ks FROM roc"))
def q_ks(spark, sf):
    return edge(M.roc_summary(_test(spark, sf), "model").select("model", "ks"))


@query("cumulative_class_curve", S.with_(_ROC, """
SELECT model, p, pos, neg, ptot - pos_lt AS cum_pos, ntot - neg_lt AS cum_neg,
       ROUND(CAST(ptot - pos_lt AS DOUBLE) / ptot, 6) AS tpr, ROUND(CAST(ntot - neg_lt AS DOUBLE) / ntot, 6) AS fpr
FROM w"""))
def q_curve(spark, sf):
    out = M.cumulative_class_curve(_test(spark, sf), "model")
    return edge(out.withColumn("cum_pos", col("cum_pos").cast("long")).withColumn("cum_neg", col("cum_neg").cast("long")))


@query("average_precision", S.with_(_ROC, """
SELECT model, ROUND(SUM(CAST(pos AS DOUBLE) / ptot * (CAST(ptot - pos_lt AS DOUBLE) / ((ptot - pos_lt) + (ntot - neg_lt)))), 6) AS average_precision,
       ROUND(MAX(CAST(ptot AS DOUBLE) / (ptot + ntot)), 6) AS base_rate
FROM w GROUP BY model"""))
def q_ap(spark, sf):
    return edge(M.average_precision(_test(spark, sf), "model"))


@query("pr_curve", S.with_(_ROC, """
SELECT model, p AS threshold, ROUND(CAST(ptot - pos_lt AS DOUBLE) / ((ptot - pos_lt) + (ntot - neg_lt)), 6) AS precision,
       ROUND(CAST(ptot - pos_lt AS DOUBLE) / ptot, 6) AS recall
FROM w"""))
def q_pr(spark, sf):
    return edge(M.pr_curve(_test(spark, sf), "model"))


def _lin(bins=10):
    return ", ".join(repr(x) for x in M._linspace(bins))


_PSIQ_BODY = f"""edges AS (SELECT model, list_sort(list_distinct(quantile_cont(p, [{_lin()}]))) AS e
          FROM scored WHERE split = 'train' GROUP BY model),
tagged AS (
  SELECT s.model, s.split, e,
    CASE WHEN p < e[1] OR p > e[len(e)] THEN NULL WHEN p = e[len(e)] THEN len(e) - 2
         ELSE len(list_filter(e, lambda x: x <= p)) - 1 END AS bin
  FROM scored s JOIN edges USING (model)),
bins AS (SELECT model, len(e) AS k, unnest(range(0, len(e) - 1)) AS bin FROM edges),
cnt AS (SELECT model, bin, COUNT(*) FILTER (WHERE split = 'train') AS e_cnt,
               COUNT(*) FILTER (WHERE split = 'test') AS a_cnt
        FROM tagged WHERE bin IS NOT NULL GROUP BY model, bin),
j AS (SELECT b.model, b.k, b.bin, COALESCE(e_cnt, 0) AS e_cnt, COALESCE(a_cnt, 0) AS a_cnt
      FROM bins b LEFT JOIN cnt USING (model, bin)),
pct AS (SELECT model, k,
          GREATEST(e_cnt / GREATEST(SUM(e_cnt) OVER (PARTITION BY model), 1), 1e-6) AS ep,
          GREATEST(a_cnt / GREATEST(SUM(a_cnt) OVER (PARTITION BY model), 1), 1e-6) AS ap
        FROM j),
psi AS (SELECT model, CASE WHEN MAX(k) < 3 THEN 0.0 ELSE SUM((ap - ep) * ln(ap / ep)) END AS psi
        FROM pct GROUP BY model)"""
_PSIQ = S.SCORED + ",\n" + _PSIQ_BODY


@query("psi_quantile", S.with_(_PSIQ, "SELECT model, ROUND(psi, 6) AS psi FROM psi"))
def q_psi_quantile(spark, sf):
    s = A.scored(spark, sf)
    return edge(M.psi_quantile(s.where(col("split") == "train"), s.where(col("split") == "test"), "model", "p"))


_PSIF = S.SCORED + f""",
fe AS (SELECT [{_lin()}] AS e),
t AS (SELECT model, split,
        CASE WHEN p < 0 OR p > 1 THEN NULL WHEN p = 1.0 THEN 9
             ELSE len(list_filter(e, lambda x: x <= p)) - 1 END AS bin
      FROM scored, fe),
n AS (SELECT model, COUNT(*) FILTER (WHERE split = 'train') AS en, COUNT(*) FILTER (WHERE split = 'test') AS an
      FROM scored GROUP BY model),
b AS (SELECT model, unnest(range(0, 10)) AS bin FROM n),
c AS (SELECT model, bin, COUNT(*) FILTER (WHERE split = 'train') AS ec, COUNT(*) FILTER (WHERE split = 'test') AS ac
      FROM t WHERE bin IS NOT NULL GROUP BY model, bin),
r AS (SELECT b.model, COALESCE(ec, 0) / en AS ep0, COALESCE(ac, 0) / an AS ap0
      FROM b JOIN n USING (model) LEFT JOIN c USING (model, bin))"""


@query("psi_fixed", S.with_(_PSIF, """
SELECT model, ROUND(SUM((CASE WHEN ap0 = 0 THEN 1e-4 ELSE ap0 END - CASE WHEN ep0 = 0 THEN 1e-4 ELSE ep0 END)
   * ln(CASE WHEN ap0 = 0 THEN 1e-4 ELSE ap0 END / CASE WHEN ep0 = 0 THEN 1e-4 ELSE ep0 END)), 6) AS psi
FROM r GROUP BY model"""))
def q_psi_fixed(spark, sf):
    s = A.scored(spark, sf)
    return edge(M.psi_fixed(s.where(col("split") == "train"), s.where(col("split") == "test"), "model", "p"))


@query("monitoring_row", S.with_(S.SCORED + ",\n" + _ROC_BODY + ",\n" + _PSIQ_BODY, """
SELECT r.model AS model_name, TIMESTAMP '2001-09-01 00:00:00' AS scored_at,
  ROUND(2 * auc - 1, 6) AS gini, ROUND(ks, 6) AS ks, ROUND(psi, 6) AS psi,
  0.3 AS gini_min, 0.2 AS ks_min, 0.25 AS psi_max,
  CASE WHEN 2 * auc - 1 < 0.3 THEN 'GINI_LOW' WHEN ks < 0.2 THEN 'KS_LOW' WHEN psi > 0.25 THEN 'PSI_HIGH' ELSE 'OK' END AS status
FROM roc r JOIN psi USING (model)"""))
def q_monitoring_row(spark, sf):
    return edge(M.monitoring_rows(A.scored(spark, sf)))


# ------------------------------------------------------------------ multi-class

def _mcp(spark, sf):
    return M.predicted_class(A.multiclass_scored(spark, sf))


_REPORT = S.MC_PRED + """,
cc AS (SELECT model, y, pred, COUNT(*) AS n FROM mcp GROUP BY model, y, pred),
pt AS (SELECT model, y AS cls, SUM(n) AS support, SUM(CASE WHEN y = pred THEN n END) AS tp FROM cc GROUP BY model, y),
pp AS (SELECT model, pred AS cls, SUM(n) AS predicted FROM cc GROUP BY model, pred),
rep0 AS (SELECT COALESCE(pt.model, pp.model) AS model, COALESCE(pt.cls, pp.cls) AS cls,
           COALESCE(support, 0) AS support, COALESCE(tp, 0) AS tp, COALESCE(predicted, 0) AS predicted
         FROM pt FULL JOIN pp ON pt.model = pp.model AND pt.cls = pp.cls),
rep1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM rep0),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
        FROM rep1)"""


@query("classwise_report", S.with_(_REPORT, """
SELECT model, cls, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted FROM rep"""))
def q_classwise(spark, sf):
    return edge(M.classwise_report(_mcp(spark, sf), "model"))


@query("classwise_macro", S.with_(_REPORT, """
SELECT model, ROUND(AVG(precision), 6) AS precision, ROUND(AVG(recall), 6) AS recall, ROUND(AVG(f1), 6) AS f1,
       CAST(SUM(support) AS BIGINT) AS support FROM rep GROUP BY model"""))
def q_macro(spark, sf):
    return edge(M.macro_avg(M.classwise_report(_mcp(spark, sf), "model"), "model"))


@query("weighted_prf", S.with_(_REPORT, """
SELECT model, ROUND(SUM(tp) / SUM(support), 6) AS accuracy,
  ROUND(SUM(precision * support) / SUM(support), 6) AS precision,
  ROUND(SUM(recall * support) / SUM(support), 6) AS recall,
  ROUND(SUM(f1 * support) / SUM(support), 6) AS f1 FROM rep GROUP BY model"""))
def q_weighted_prf(spark, sf):
    return edge(M.weighted_prf(_mcp(spark, sf), "model"))


@query("confusion_matrix", S.with_(S.MC_PRED, """
SELECT model, y, COUNT(*) FILTER (WHERE pred = 0) AS pred_0, COUNT(*) FILTER (WHERE pred = 1) AS pred_1,
       COUNT(*) FILTER (WHERE pred = 2) AS pred_2, COUNT(*) FILTER (WHERE pred = 3) AS pred_3
FROM mcp GROUP BY model, y"""))
def q_confusion(spark, sf):
    return M.confusion_matrix(_mcp(spark, sf), "model", [0, 1, 2, 3])


@query("auc_ovr_weighted", S.with_(S.MC_LONG + """,
c AS (SELECT model, cls, p, CAST(SUM(CASE WHEN y = cls THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(SUM(CASE WHEN y = cls THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM mcl GROUP BY model, cls, p),
w AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model, cls ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_lt,
        SUM(pos) OVER (PARTITION BY model, cls) AS ptot, SUM(neg) OVER (PARTITION BY model, cls) AS ntot FROM c),
pc AS (SELECT model, cls, MAX(ptot) AS n_pos,
         SUM(CAST(pos AS DOUBLE) * (neg_lt + neg / 2.0)) / (CAST(MAX(ptot) AS DOUBLE) * MAX(ntot)) AS auc
       FROM w GROUP BY model, cls)""", """
SELECT model, ROUND(SUM(auc * n_pos) / SUM(n_pos), 6) AS auc_ovr FROM pc GROUP BY model"""))
def q_auc_ovr(spark, sf):
    long = M.long_probs(A.multiclass_scored(spark, sf), ["row_id", "model", "y"])
    return edge(M.auc_ovr_weighted(long, "model"))


@query("champion_vs_challenger", S.with_(S.MC_PRED, """
SELECT c.model AS challenger, COUNT(*) AS n_rows,
  COUNT(*) FILTER (WHERE c.pred = k.pred) AS n_agree
FROM mcp k JOIN mcp c ON k.row_id = c.row_id AND k.model = 'logreg' AND c.model <> 'logreg'
GROUP BY c.model"""))
def q_champion_vs_challenger(spark, sf):
    from riskframe.operators.stats import champion_pairs
    pairs = champion_pairs(_mcp(spark, sf), "logreg")
    return pairs.groupBy("challenger").agg(F.count("*").alias("n_rows"),
                                           F.count_if(col("pred_a") == col("pred_b")).alias("n_agree"))


@query("cohen_kappa", S.with_(S.MC_PRED + """,
pairs AS (SELECT c.model AS challenger, k.pred AS a, c.pred AS b
          FROM mcp k JOIN mcp c ON k.row_id = c.row_id AND k.model = 'logreg' AND c.model <> 'logreg'),
cnt AS (SELECT challenger, a, b, COUNT(*) AS n FROM pairs GROUP BY ALL),
tot AS (SELECT challenger, SUM(n) AS tot, SUM(CASE WHEN a = b THEN n ELSE 0 END) AS agree FROM cnt GROUP BY challenger),
ma AS (SELECT challenger, a AS c, SUM(n) AS na FROM cnt GROUP BY ALL),
mb AS (SELECT challenger, b AS c, SUM(n) AS nb FROM cnt GROUP BY ALL),
pe AS (SELECT challenger, SUM(COALESCE(na, 0) * COALESCE(nb, 0) / (tot * tot)) AS pe
       FROM ma FULL JOIN mb USING (challenger, c) JOIN tot USING (challenger) GROUP BY challenger)""", """
SELECT challenger, ROUND(agree / tot, 6) AS agreement, ROUND((agree / tot - pe) / (1 - pe), 6) AS kappa
FROM tot JOIN pe USING (challenger)"""))
def q_kappa(spark, sf):
    from riskframe.operators.stats import champion_pairs
    pairs = champion_pairs(_mcp(spark, sf), "logreg")
    return edge(M.cohen_kappa(pairs, "challenger"))
