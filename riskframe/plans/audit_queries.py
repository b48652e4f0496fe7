"""M24 / A24 over all eight checks, each one aggregate of its own query's result; T10
over all label sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import expressions as X
from riskframe.operators import loanbook as LB
from riskframe.operators import stateful as SF
from riskframe.plans import fixtures_sql as S
from riskframe.plans import function_queries, monitoring_queries, prep_queries, text_queries
from riskframe.plans.catalog import ORACLES, edge, query
from riskframe.sources import adapters as A

col = F.col


def _check(df: DataFrame, name: str, criterion: str, passed) -> DataFrame:
    """One row; no input row at all fails the check."""
    return df.agg(F.coalesce(passed, F.lit(False)).alias("passed")).select(
        F.lit(name).alias("check"), F.lit(criterion).alias("criterion"), "passed")


@query("audit_eight_checks")
def q_audit_eight(spark, sf):
    """The audit table; the importance-stability entry is a fixed pass by definition."""
    kappa = monitoring_queries.q_kappa(spark, sf)
    ground = text_queries.q_grounding(spark, sf)
    clean = (F.size("missing") == 0) & (F.size("extra") == 0) & ~col("too_few_actions")
    rows = [
        _check(prep_queries.q_delta(spark, sf), "ab_test", "champion's AUC edge is significant at p < 0.05",
               F.bool_or("significant_at_5pct")),
        _check(kappa, "disagreement", "champion against best challenger: kappa > 0.4", F.max("kappa") > 0.4),
        _check(kappa.limit(1), "importance_stability", "fixed entry", F.lit(True)),
        _check(function_queries.q_feature_overlap(spark, sf), "feature_overlap", "at least 5 of 10 top features in common",
               F.bool_and("passed")),
        _check(ground, "faithfulness", "no invented numbers", F.sum("n_invented") == 0),
        _check(ground, "citations", "all citations resolve", F.sum("n_unresolved") == 0),
        _check(ground, "schema", "exactly the required keys", F.bool_and(clean)),
        _check(prep_queries.q_seed_cv(spark, sf), "determinism", "AUC varies less than 5 % over seeds",
               F.max("auc_cv_pct") < 5.0),
    ]
    return reduce(DataFrame.union, rows)


@query("audit_eight_passed")
def q_audit_eight_passed(spark, sf):
    return q_audit_eight(spark, sf).agg(F.bool_and("passed").alias("all_passed"), F.count_if(col("passed")).alias("n_passed"),
                                        F.count("*").alias("n_checks"))


@query("facts_payload_values", S.with_(S.MULTICLASS + f",\nscores AS (FROM ({ORACLES['weighted_prf']}))", """
SELECT 'rows' AS section, '' AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM mc WHERE model = 'logreg'
UNION ALL SELECT 'class', CAST(y AS VARCHAR), COUNT(*) FROM mc WHERE model = 'logreg' GROUP BY y
UNION ALL SELECT 'f1', model, ROUND(f1, 4) FROM scores"""))
def q_facts_values(spark, sf):
    """The record's counts and scores, read from its JSON."""
    record = "rows long, class_distribution map<string,long>, model_metrics array<struct<model:string,f1:double>>"
    p = prep_queries.q_facts(spark, sf).select(F.from_json("json", record).alias("p")).select("p.*")
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    return p.select(F.inline(F.concat(
        F.array(row("rows", F.lit(""), col("rows"))),
        F.transform(F.map_entries("class_distribution"), lambda e: row("class", e["key"], e["value"])),
        F.transform("model_metrics", lambda m: row("f1", m["model"], m["f1"])))))


# ------------------------------------------------------------------ T10, all label sets

_CALLS = S.REQUESTS + """,
calls AS (SELECT ts, amount / 100.0 AS latency, bucket AS endpoint, IF(event_id % 4 = 0, 'GET', 'POST') AS method,
                 CASE WHEN event_id % 50 = 0 THEN '500' WHEN event_id % 17 = 0 THEN '422' ELSE '200' END AS status FROM requests)"""


def _calls(spark, sf):
    """Service calls: the requests with a method and a response status."""
    n = col("event_id")
    return A.requests(spark, sf).select(
        "ts", (col("amount") / 100.0).alias("latency"), col("bucket").alias("endpoint"),
        F.when(n % 4 == 0, "GET").otherwise("POST").alias("method"),
        F.when(n % 50 == 0, "500").when(n % 17 == 0, "422").otherwise("200").alias("status"))


def _buckets(value: str) -> str:
    return ", ".join(f"CAST(SUM(IF({value} <= {b}, 1, 0)) AS BIGINT) AS le_{str(b).replace('.', '_')}" for b in LB.LE_BUCKETS)


@query("request_metrics_by_status", S.with_(_CALLS, f"""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, endpoint, method, status, COUNT(*) AS requests,
       ROUND(SUM(latency), 6) AS latency_sum, {_buckets("latency")}
FROM calls GROUP BY ALL"""))
def q_metrics_by_status(spark, sf):
    return edge(SF.request_metrics(_calls(spark, sf), ["endpoint", "method", "status"], "latency"))


_ROUTE = "IF(p < 0.10, 'AUTO_ALLOW', IF(p > 0.85, 'AUTO_BLOCK', 'RAG_LLM'))"


@query("prediction_metrics", S.with_(S.SCORED, f"""
SELECT model, {_ROUTE} AS route, COUNT(*) AS predictions,
       CAST(SUM(IF({_ROUTE} = 'RAG_LLM' AND row_id % 10 = 0, 1, 0)) AS BIGINT) AS fallbacks, {_buckets("p")}
FROM scored GROUP BY ALL"""))
def q_prediction_metrics(spark, sf):
    """Predictions by model and route, provider fallbacks and the score histogram."""
    s = A.scored(spark, sf).withColumn("route", X.policy_route_fraud("p")["decision_route"])
    fallback = (col("route") == "RAG_LLM") & (col("row_id") % 10 == 0)
    return s.groupBy("model", "route").agg(
        F.count("*").alias("predictions"), F.count_if(fallback).alias("fallbacks"),
        *[F.count_if(col("p") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in LB.LE_BUCKETS])
