"""Sinks and table maintenance round trips.

Each query writes real output to a fresh folder under the shared checkpoint
location and returns what a reader of that table sees.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import loanbook as LB
from riskframe.operators import portfolio as P
from riskframe.operators import selection as SEL
from riskframe.operators import stateful as SF
from riskframe.plans import fixtures_sql as S
from riskframe.plans.catalog import edge, query
from riskframe.sources import adapters as A
from riskframe.sources import sinks as K
from riskframe.sources import tables as TB

col = F.col
APP = S.APPLICANTS


@query("sink_replace", S.with_(APP, "SELECT prospectid, credit_score, approved_flag, netmonthlyincome FROM applicants"))
def q_sink_replace(spark, sf):
    path = K.new_location(spark, "applicants")
    K.sink_replace(A.applicants(spark, sf).select("prospectid", "credit_score", "approved_flag", "netmonthlyincome"), path)
    return spark.read.parquet(path)


@query("sink_append", S.with_(S.MONITORING, """
SELECT strftime(scored_at, '%Y-%m') AS run_id, model_name, scored_at, gini, ks, psi FROM monitoring"""))
def q_sink_append(spark, sf):
    path = K.new_location(spark, "model_monitoring")
    rows = A.monitoring(spark, sf).select(F.date_format("scored_at", "yyyy-MM").alias("run_id"),
                                          "model_name", "scored_at", "gini", "ks", "psi")
    K.sink_append(rows, path)
    K.sink_append(rows, path)   # re-run: every run_id is present, nothing is appended
    return spark.read.parquet(path)


def _staged(spark, sf):
    a = A.applicants(spark, sf).select("prospectid", "credit_score", "approved_flag")
    return a.unionByName(a)  # every key staged twice


@query("sink_insert_ignore", S.with_(APP, """
SELECT 2 * COUNT(*) AS attempted, COUNT(*) FILTER (WHERE NOT COALESCE(credit_score >= 700, false)) AS inserted
FROM applicants"""))
def q_insert_ignore(spark, sf):
    path = K.new_location(spark, "target")
    a = A.applicants(spark, sf).select("prospectid", "credit_score", "approved_flag")
    a.where(col("credit_score") >= 700).write.parquet(path)
    return K.sink_insert_ignore(_staged(spark, sf), path, "prospectid")


@query("anti_join_insert", S.with_(APP, """
SELECT prospectid, credit_score, approved_flag FROM applicants WHERE NOT COALESCE(credit_score >= 700, false)"""))
def q_anti_join(spark, sf):
    a = A.applicants(spark, sf).select("prospectid", "credit_score", "approved_flag")
    return K.insert_ignore(_staged(spark, sf), a.where(col("credit_score") >= 700), "prospectid")


def _fraud_stage(spark, sf):
    from riskframe.functions import expressions as X
    app = A.applicants(spark, sf).withColumn("secured_account", X.secured_account_flag())
    lab = app.select("prospectid", "credit_score",
                     LB.fraud_label_rule(app, cc12="enq_l12m", pl12="tot_enq").alias("fraud"))
    return lab


_FRAUD = APP + """,
fr AS (SELECT prospectid, credit_score,
  CASE WHEN approved_flag IN ('P1', 'P2')
         OR (approved_flag IN ('P3', 'P4') AND credit_score <= 750 AND enq_l12m >= 1 AND secured_tl - unsecured_tl > 1)
       THEN 1 ELSE 0 END AS fraud FROM applicants)"""


@query("sink_update_from", S.with_(_FRAUD, """
SELECT a.prospectid, a.approved_flag, f.fraud FROM applicants a
LEFT JOIN (SELECT prospectid, fraud FROM fr WHERE credit_score IS NOT NULL) f USING (prospectid)"""))
def q_update_from(spark, sf):
    target = A.applicants(spark, sf).select("prospectid", "approved_flag").withColumn("fraud", F.lit(None).cast("int"))
    staging = _fraud_stage(spark, sf).where(col("credit_score").isNotNull()).select("prospectid", "fraud")
    path = K.new_location(spark, "with-fraud")
    K.update_from(target, staging, "prospectid", "fraud").write.parquet(path)
    return spark.read.parquet(path)


@query("update_from_join", S.with_(_FRAUD, """
SELECT a.prospectid, f.fraud FROM applicants a
LEFT JOIN (SELECT prospectid, fraud FROM fr WHERE credit_score IS NOT NULL) f USING (prospectid)"""))
def q_update_from_join(spark, sf):
    target = A.applicants(spark, sf).select("prospectid")
    staging = _fraud_stage(spark, sf).where(col("credit_score").isNotNull()).select("prospectid", "fraud")
    return K.update_from(target, staging, "prospectid", "fraud")


@query("index_aligned_assign", S.with_(_FRAUD, """
SELECT a.prospectid, a.approved_flag, f.fraud FROM applicants a JOIN fr f USING (prospectid)"""))
def q_index_aligned(spark, sf):
    a = A.applicants(spark, sf).select("prospectid", "approved_flag")
    return a.join(_fraud_stage(spark, sf).select("prospectid", "fraud"), "prospectid")


_MON_BODY = S.MONITORING[len(S.SCORED) + 2:]   # the monitoring CTE without its scored input
_LOOKUP = S.MODEL_METRICS + ",\n" + _MON_BODY + """,
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY scored_at DESC) AS rn
                          FROM monitoring) WHERE rn = 1)"""


@query("metric_lookup_join", S.with_(_LOOKUP, """
SELECT l.model_name, l.scored_at, ROUND(l.gini, 6) AS gini, ROUND(m.roc_auc, 6) AS roc_auc, ROUND(m.f1_score, 6) AS f1_score
FROM latest l JOIN model_metrics m USING (model_name)"""))
def q_metric_lookup(spark, sf):
    latest = P.latest_per_model(A.monitoring(spark, sf)).select("model_name", "scored_at", "gini")
    mets = A.model_metrics(spark, sf).select("model_name", "roc_auc", "f1_score")
    return edge(latest.join(mets, "model_name"))


_DEC = """SELECT row_id, model, CASE WHEN p < 0.30 THEN 'AUTO_REJECT' WHEN p > 0.80 THEN 'AUTO_APPROVE' ELSE 'MANUAL_REVIEW' END AS decision_route,
       ROUND(p, 6) AS p FROM scored"""


@query("sink_csv_decisions", S.with_(S.SCORED, _DEC))
def q_sink_csv(spark, sf):
    from riskframe.functions import expressions as X
    r = X.policy_route_credit("p", approve_above=0.80, middle="MANUAL_REVIEW")
    d = A.scored(spark, sf).select("row_id", "model", r["decision_route"].alias("decision_route"), "p")
    path = K.new_location(spark, "decisions-csv")
    K.sink_csv(d, path)
    return edge(spark.read.schema("row_id long, model string, decision_route string, p double")
                .option("header", True).csv(path))


@query("scan_csv_metrics", S.with_(S.MODEL_METRICS, """
SELECT model_name AS model, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(f1_score, 6) AS f1, ROUND(roc_auc, 6) AS roc_auc FROM model_metrics"""))
def q_scan_csv(spark, sf):
    m = A.model_metrics(spark, sf)
    # header as the training job writes it: mixed case, spaces, an index column
    out = m.select(F.monotonically_increasing_id().alias("Unnamed: 0"), col("model_name").alias("Model Name"),
                   col("accuracy").alias("Accuracy"), col("precision").alias("Precision"),
                   col("recall").alias("Recall"), col("f1_score").alias("F1 Score"), col("roc_auc").alias("ROC AUC"))
    path = K.new_location(spark, "metrics-csv")
    out.write.option("header", True).csv(path)
    return edge(TB.scan_csv_metrics(spark, path))


@query("export_schema_stats", S.with_(APP, """
SELECT COUNT(*) AS rows, 35 AS columns FROM applicants"""))
def q_export_stats(spark, sf):
    st = K.export_stats(A.applicants(spark, sf), "approved_flag")
    return st.select(col("rows").cast("long"), col("columns"))


_DTYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}


@query("export_schema", S.with_(S.APPLICANTS, "SELECT column_name, CASE column_type " + " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in _DTYPES.items()) + " END AS dtype FROM (DESCRIBE SELECT * FROM applicants)"))
def q_export_schema(spark, sf):
    """schema.json of the applicant table, written and read back."""
    path = K.new_location(spark, "schema")
    K.export_schema(A.applicants(spark, sf)).write.json(path)
    return spark.read.schema("column_name string, dtype string").json(path)


@query("export_class_distribution", S.with_(S.APPLICANTS, """
SELECT CAST(SUM(n) AS BIGINT) AS rows,
       map_from_entries(list((cls, n) ORDER BY cls) FILTER (WHERE cls IS NOT NULL)) AS class_distribution,
       (SELECT CAST(COUNT(*) AS INTEGER) FROM (DESCRIBE SELECT * FROM applicants)) AS columns
FROM (SELECT CAST(approved_flag AS VARCHAR) AS cls, COUNT(*) AS n FROM applicants GROUP BY 1)"""))
def q_export_classes(spark, sf):
    return K.export_stats(A.applicants(spark, sf), "approved_flag")


@query("monthly_report_tables", S.with_(S.MODEL_METRICS + S.MONITORING.removeprefix(S.SCORED), """
SELECT 'metrics' AS report, model_name, NULL AS scored_at, ROUND(f1_score, 6) AS value, '2001-09' AS report_month FROM model_metrics
UNION ALL SELECT 'monitoring', model_name, scored_at, ROUND(gini, 6), '2001-09' FROM monitoring"""))
def q_monthly_report(spark, sf):
    """Both tables of the month, read back from their partition."""
    out = K.new_location(spark, "report")
    m = A.model_metrics(spark, sf).select("model_name", "f1_score")
    K.monthly_report_tables(m, A.monitoring(spark, sf), out, "2001-09")
    month = lambda name: spark.read.parquet(f"{out}/{name}").where(col("report_month") == "2001-09")
    metrics = month("metrics").select(F.lit("metrics").alias("report"), "model_name", F.lit(None).cast("timestamp_ntz").alias("scored_at"),
                                      col("f1_score").alias("value"), "report_month")
    return edge(metrics.unionByName(month("monitoring").select(
        F.lit("monitoring").alias("report"), "model_name", "scored_at", col("gini").alias("value"), "report_month")))


@query("sink_holdout", S.with_(APP + """,
n AS (SELECT approved_flag, COUNT(*) AS n FROM applicants GROUP BY approved_flag)""", """
SELECT approved_flag, CAST(ROUND(n * 0.19999999999999996) AS BIGINT) AS n FROM n
WHERE ROUND(n * 0.19999999999999996) > 0"""))
def q_holdout(spark, sf):
    s = SEL.stratified_split(A.applicants(spark, sf).select("prospectid", "approved_flag", "credit_score"),
                             "approved_flag", "prospectid")
    path = K.new_location(spark, "holdout")
    s.where(col("split") == "test").drop("split").write.parquet(path)
    return spark.read.parquet(path).groupBy("approved_flag").agg(F.count("*").alias("n"))


@query("sink_jsonl_parquet_bundle", """
SELECT COUNT(*) AS parquet_rows, COUNT(*) AS jsonl_rows, 3 AS parquet_columns, 2 AS jsonl_columns FROM embeddings""")
def q_bundle(spark, sf):
    return K.sink_bundle(TB.table(spark, sf, "embeddings"), K.new_location(spark, "bundle"))


@query("sink_audit_payload")
def q_audit_payload(spark, sf):
    path = K.new_location(spark, "audit")
    K.sink_audit_payload(A.model_metrics(spark, sf), path, run_at="2001-09-01 00:00:00")
    return spark.read.parquet(path)


_PAYLOAD = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


@query("sink_audit_payload_values", S.with_(S.MODEL_METRICS, "SELECT TIMESTAMP '2001-09-01 00:00:00' AS run_at, model_name, " + ", ".join(
    f"ROUND({c}, 6) AS {c}" for c in _PAYLOAD) + " FROM model_metrics"))
def q_audit_payload_values(spark, sf):
    """The appended payloads, parsed again."""
    schema = "model_name string, " + ", ".join(f"{c} double" for c in _PAYLOAD)
    return edge(q_audit_payload(spark, sf).select("run_at", F.from_json("payload", schema).alias("p")).select("run_at", "p.*"))


@query("sink_profile_upsert", """
SELECT user_id, json_object('event_type', arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IS NOT NULL),
                            'value', arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL))::VARCHAR AS profile
FROM events GROUP BY user_id""")
def q_profile_upsert(spark, sf):
    e = TB.table(spark, sf, "events", ["user_id", "ts", "event_id", "event_type", "value"])
    prof = SF.latest_profile(e, "user_id", ["event_type", "value"], order=["event_id"])
    path = K.new_location(spark, "profiles")
    K.sink_profile_upsert(prof.drop("last_update"), "user_id", path)
    return spark.read.parquet(path)


@query("sink_wal_append", "WITH RECURSIVE " + S.EXPOSURE_EVENTS + """,
ev AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS rn FROM exposure_events),
st AS (
  SELECT customer_id, rn, ts, event_id, kind, amount,
    CASE WHEN kind = 'approve' THEN amount ELSE 0.0 END AS lim,
    CASE WHEN kind = 'draw' AND amount <= 0.0 THEN amount ELSE 0.0 END AS drawn,
    CASE WHEN kind = 'approve' THEN amount WHEN amount > 0.0 THEN -1.0 ELSE amount END AS result
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.customer_id, e.rn, e.ts, e.event_id, e.kind, e.amount,
    CASE WHEN e.kind = 'approve' THEN s.lim + e.amount ELSE s.lim END,
    CASE WHEN e.kind = 'draw' AND s.drawn + e.amount <= s.lim THEN s.drawn + e.amount ELSE s.drawn END,
    CASE WHEN e.kind = 'approve' THEN s.lim + e.amount WHEN s.drawn + e.amount > s.lim THEN -1.0 ELSE s.drawn + e.amount END
  FROM st s JOIN ev e ON e.customer_id = s.customer_id AND e.rn = s.rn + 1)
SELECT customer_id AS cid, ROUND(amount, 6) AS amount, ROUND(result, 6) AS new_drawn, ts AS at
FROM st WHERE kind = 'draw' AND result >= 0""")
def q_wal_append(spark, sf):
    path = K.new_location(spark, "exposure-wal")
    SF.wal_rows(SF.check_and_draw(A.exposure_events(spark, sf))).write.mode("append").parquet(path)
    return edge(spark.read.parquet(path))
