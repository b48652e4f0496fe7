"""Scalar functions (F1-F23), label fields (P20), output coercion (P28),
type selection (P29) and audit roll-ups (A24, A26, M24, U3) over the driver
tables, each with a DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import expressions as X
from riskframe.operators import portfolio as P
from riskframe.plans import fixtures_sql as S
from riskframe.plans import monitoring_queries, stateful_queries  # noqa: F401  (oracles reused below)
from riskframe.plans.catalog import ORACLES, edge, query
from riskframe.sources import adapters as A
from riskframe.sources.tables import normalise_names, table

col = F.col


@query("round_half_up_2", """
SELECT l_orderkey, l_linenumber, ROUND(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4)), 2) AS disc_amount
FROM lineitem""")
def q_round_half_up(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"])
    amt = (col("l_extendedprice") * col("l_discount")).cast("decimal(18,4)")
    return li.select("l_orderkey", "l_linenumber", X.round_half_up(amt, 2).alias("disc_amount"))


@query("round_half_even", """
SELECT l_orderkey, l_linenumber, round_even(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4)), 2) AS disc_amount
FROM lineitem""")
def q_round_half_even(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"])
    amt = (col("l_extendedprice") * col("l_discount")).cast("decimal(18,4)")
    return li.select("l_orderkey", "l_linenumber", X.round_half_even(amt, 2).alias("disc_amount"))


@query("nullif_guard", """
SELECT o_orderpriority, ROUND(100.0 * COUNT(*) FILTER (WHERE o_orderstatus = 'F')
                              / NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'P'), 0), 6) AS f_per_100_p
FROM orders GROUP BY o_orderpriority""")
def q_nullif_guard(spark, sf):
    o = table(spark, sf, "orders", ["o_orderpriority", "o_orderstatus"])
    g = o.groupBy("o_orderpriority").agg(F.count_if(col("o_orderstatus") == "F").alias("nf"),
                                         F.count_if(col("o_orderstatus") == "P").alias("np"))
    return edge(g.select("o_orderpriority", X.nullif_divide(100.0 * col("nf"), col("np")).alias("f_per_100_p")))


@query("month_trunc_date", """
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, COUNT(*) AS n FROM events GROUP BY 1""")
def q_month_trunc(spark, sf):
    e = table(spark, sf, "events", ["ts"])
    return e.groupBy(X.month_trunc_date("ts").alias("month")).agg(F.count("*").alias("n"))


@query("hour_key", """
SELECT strftime(ts, '%Y-%m-%dT%H') AS hour_key, COUNT(*) AS n FROM events GROUP BY 1""")
def q_hour_key(spark, sf):
    e = table(spark, sf, "events", ["ts"])
    return e.groupBy(X.hour_key("ts").alias("hour_key")).agg(F.count("*").alias("n"))


@query("vintage_key", """
SELECT strftime(o_orderdate, '%Y-%m') AS vintage, COUNT(*) AS n FROM orders GROUP BY 1""")
def q_vintage_key(spark, sf):
    o = table(spark, sf, "orders", ["o_orderdate"])
    return o.groupBy(X.vintage_key("o_orderdate").alias("vintage")).agg(F.count("*").alias("n"))


@query("safe_div", """
SELECT c_custkey, ROUND(CASE WHEN c_nationkey = 0 THEN 0.0 ELSE c_acctbal / c_nationkey END, 6) AS bal_per_nation
FROM customer""")
def q_safe_div(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    return edge(c.select("c_custkey", X.safe_div("c_acctbal", "c_nationkey").alias("bal_per_nation")))


@query("log1p_transform", """
SELECT c_custkey, ROUND(CASE WHEN c_acctbal / 500.0 > -1 THEN ln(1 + c_acctbal / 500.0) END, 6) AS log_bal
FROM customer""")
def q_log1p(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    return edge(c.select("c_custkey", X.log1p_transform(col("c_acctbal") / 500.0).alias("log_bal")))


@query("clip", """
SELECT c_custkey, ROUND(CASE WHEN c_acctbal IS NULL THEN NULL ELSE GREATEST(LEAST(c_acctbal, 5000.0), 0.0) END, 6)
       AS clipped FROM customer""")
def q_clip(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    return edge(c.select("c_custkey", X.clip("c_acctbal", 0.0, 5000.0).alias("clipped")))


@query("column_name_normalise", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def q_colnames(spark, sf):
    # the mixed-case export (D2) read back: ' C_CustKey ' -> 'c_custkey'
    c = table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    messy = c.toDF(*[f" {n.upper()} " for n in c.columns])
    return normalise_names(messy)


@query("payload_fingerprint", """
SELECT c_custkey, substr(sha256(json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment,
                                             'c_nationkey', c_nationkey)::VARCHAR), 1, 16) AS fingerprint
FROM customer""")
def q_fingerprint(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return c.select("c_custkey", X.payload_fingerprint(["c_custkey", "c_nationkey", "c_mktsegment"])
                    .alias("fingerprint"))


@query("json_sanitize", """
SELECT event_id, ROUND(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END, 6) AS value
FROM events""")
def q_json_sanitize(spark, sf):
    e = table(spark, sf, "events", ["event_id", "value"])
    raw = (F.when(col("event_id") % 7 == 0, F.lit(float("nan")))
           .when(col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(col("value")))
    return edge(e.select("event_id", X.json_sanitize(raw).alias("value")))


@query("parse_vector_text", """
SELECT vec_id, list_transform(embedding, lambda x: ROUND(CAST(x AS DOUBLE), 6)) AS vector FROM embeddings""")
def q_parse_vector(spark, sf):
    v = table(spark, sf, "embeddings", ["vec_id", "embedding"])
    parsed = X.parse_vector_text(F.to_json(col("embedding")))
    return v.select("vec_id", F.transform(parsed, lambda x: F.round(x.cast("double"), 6)).alias("vector"))


@query("percent_format", S.with_(S.SCORED, """
SELECT model, row_id, round_even(CAST(p AS DECIMAL(18, 6)) * 100, 2) AS risk_score_100 FROM scored"""))
def q_percent(spark, sf):
    s = A.scored(spark, sf)
    return s.select("model", "row_id", X.percent_100(col("p").cast("decimal(18,6)")).alias("risk_score_100"))


@query("bit_pack_test", """
SELECT l_orderkey, l_linenumber, flags, (flags & 2) <> 0 AS returned, (flags & 8) <> 0 AS big_qty FROM (
  SELECT l_orderkey, l_linenumber,
    (CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)
    | ((CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) << 1)
    | ((CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) << 2)
    | ((CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) << 3) AS flags
  FROM lineitem)""")
def q_bit_pack(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag",
                                       "l_linestatus", "l_quantity"])
    bits = [col("l_discount") > 0.05, col("l_returnflag") == "R", col("l_linestatus") == "F",
            col("l_quantity") > 40]
    flags = F.lit(0)
    for i, b in enumerate(bits):
        flags = flags.bitwiseOR(F.shiftleft(b.cast("int"), i))
    x = li.select("l_orderkey", "l_linenumber", flags.alias("flags"))
    return x.select("*", (col("flags").bitwiseAND(2) != 0).alias("returned"),
                    (col("flags").bitwiseAND(8) != 0).alias("big_qty"))


@query("missing_default", """
SELECT doc_id, COALESCE(lang, 'unknown') AS lang, 'policy' AS doc_type FROM documents""")
def q_missing_default(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "lang", "source"])
    meta = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array(col("lang"), col("source")))
    return d.select("doc_id", X.missing_default(meta, "lang", "unknown").alias("lang"),
                    X.missing_default(meta, "doc_type", "policy").alias("doc_type"))


# ------------------------------------------------------------------ P20

@query("predicted_label_fields", S.with_(S.MULTICLASS, """
SELECT row_id, model,
  map_from_entries([('class_' || (i - 1), round_even(CAST(probs[i] AS DECIMAL(18, 8)), 4))
                    FOR i IN range(1, len(probs) + 1)]) AS probabilities,
  round_even(CAST(CASE WHEN len(probs) > 1 THEN probs[2] ELSE probs[1] END AS DECIMAL(18, 8)), 4) AS primary_p
FROM mc"""))
def q_label_fields(spark, sf):
    mc = A.multiclass_scored(spark, sf)
    p4 = F.transform("probs", lambda p: F.bround(p.cast("decimal(18,8)"), 4))
    names = F.transform(F.sequence(F.lit(0), F.size("probs") - 1), lambda i: F.concat(F.lit("class_"), i.cast("string")))
    primary = F.when(F.size("probs") > 1, F.element_at("probs", 2)).otherwise(F.element_at("probs", 1))
    return mc.select("row_id", "model", F.map_from_arrays(names, p4).alias("probabilities"),
                     F.bround(primary.cast("decimal(18,8)"), 4).alias("primary_p"))


# ------------------------------------------------------------------ P28

# Allowed typologies and actions, and the default of every
# required key of the fraud-analysis output.
ALLOWED_TYPOLOGIES = ["application_fraud", "account_takeover", "synthetic_identity", "first_party_fraud",
                      "friendly_fraud", "money_mule", "card_not_present", "unknown"]
ALLOWED_ACTIONS = ["allow", "step_up_auth", "manual_review", "block", "report_sar"]
FORCE_REVIEW = ["block", "report_sar"]
OUTPUT_SCHEMA = T.StructType([
    T.StructField("fraud_band", T.StringType()), T.StructField("typology", T.StringType()),
    T.StructField("red_flags", T.ArrayType(T.StringType())), T.StructField("key_drivers", T.ArrayType(T.StringType())),
    T.StructField("recommended_action", T.StringType()), T.StructField("policy_refs", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.DoubleType()), T.StructField("needs_human_review", T.BooleanType())])


def coerce_fraud_output(json_text) -> list:
    """Parse the generated JSON; unknown typology -> 'unknown', unknown
    or missing action -> 'manual_review'; block / report_sar force human
    review; missing keys take their defaults."""
    o = F.from_json(json_text, OUTPUT_SCHEMA)
    typ = F.when(o["typology"].isin(*ALLOWED_TYPOLOGIES), o["typology"]).otherwise(F.lit("unknown"))
    act = F.when(o["recommended_action"].isin(*ALLOWED_ACTIONS), o["recommended_action"]) \
           .otherwise(F.lit("manual_review"))
    empty = F.array().cast("array<string>")
    review = F.when(act.isin(*FORCE_REVIEW), F.lit(True)).otherwise(F.coalesce(o["needs_human_review"], F.lit(True)))
    return [F.coalesce(o["fraud_band"], F.lit("Medium")).alias("fraud_band"), typ.alias("typology"),
            F.coalesce(o["red_flags"], empty).alias("red_flags"),
            F.coalesce(o["key_drivers"], empty).alias("key_drivers"),
            act.alias("recommended_action"), F.coalesce(o["policy_refs"], empty).alias("policy_refs"),
            F.coalesce(o["confidence"], F.lit(0.5)).alias("confidence"), review.alias("needs_human_review")]


# The generated texts are derived from the events table: event type and the
# props value choose typology / action, some keys are left out.
_RAW_SQL = """raw AS (
  SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type FROM events),
gen AS (
  SELECT event_id, k,
    CASE WHEN event_type = 'purchase' THEN 'card_not_present' WHEN event_type = 'signup' THEN 'synthetic_identity'
         ELSE event_type END AS typology,
    CASE k % 7 WHEN 0 THEN 'allow' WHEN 1 THEN 'step_up_auth' WHEN 2 THEN 'block' WHEN 3 THEN 'report_sar'
               WHEN 4 THEN 'escalate' ELSE NULL END AS action,
    CASE WHEN k % 3 = 0 THEN 'High' END AS band,
    CASE WHEN k % 4 = 0 THEN false END AS review,
    CASE WHEN k % 5 = 0 THEN ['velocity', 'new device'] END AS flags,
    CASE WHEN k % 2 = 0 THEN [event_type, 'amount'] END AS drivers,
    CASE WHEN k % 3 = 1 THEN ['aml.pdf p' || CAST(k AS VARCHAR)] END AS refs
  FROM raw)"""


@query("llm_output_coerce", "WITH " + _RAW_SQL + """
SELECT event_id, COALESCE(band, 'Medium') AS fraud_band,
  CASE WHEN typology IN ('""" + "', '".join(ALLOWED_TYPOLOGIES) + """') THEN typology ELSE 'unknown' END AS typology,
  COALESCE(flags, []) AS red_flags, COALESCE(drivers, []) AS key_drivers,
  CASE WHEN action IN ('""" + "', '".join(ALLOWED_ACTIONS) + """') THEN action ELSE 'manual_review' END
    AS recommended_action,
  COALESCE(refs, []) AS policy_refs, ROUND(k / 100.0, 6) AS confidence,
  CASE WHEN action IN ('block', 'report_sar') THEN true ELSE COALESCE(review, true) END AS needs_human_review
FROM gen""")
def q_llm_output_coerce(spark, sf):
    e = table(spark, sf, "events", ["event_id", "event_type", "props"])
    k = F.get_json_object("props", "$.k").cast("int")
    typology = (F.when(col("event_type") == "purchase", "card_not_present")
                .when(col("event_type") == "signup", "synthetic_identity").otherwise(col("event_type")))
    action = F.try_element_at(F.array(*[F.lit(a) for a in ["allow", "step_up_auth", "block", "report_sar", "escalate"]]),
                          (k % 7) + 1)
    gen = F.to_json(F.struct(typology.alias("typology"), action.alias("recommended_action"),
                             F.when(k % 3 == 0, F.lit("High")).alias("fraud_band"),
                             F.when(k % 4 == 0, F.lit(False)).alias("needs_human_review"),
                             F.when(k % 5 == 0, F.array(F.lit("velocity"), F.lit("new device"))).alias("red_flags"),
                             F.when(k % 2 == 0, F.array(col("event_type"), F.lit("amount"))).alias("key_drivers"),
                             F.when(k % 3 == 1, F.array(F.concat(F.lit("aml.pdf p"), k.cast("string")))).alias("policy_refs"),
                             (k / 100.0).alias("confidence")))
    return edge(e.select("event_id", *coerce_fraud_output(gen)))


# ------------------------------------------------------------------ P29

@query("select_by_type", S.with_(S.APPLICANTS, """
SELECT column_name, CASE WHEN column_type IN ('VARCHAR') THEN 'categorical' ELSE 'numeric' END AS kind
FROM (DESCRIBE SELECT * FROM applicants)
WHERE column_name <> 'approved_flag'
  AND (column_type = 'VARCHAR' OR column_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'HUGEINT', 'SMALLINT', 'TINYINT')
       OR column_type LIKE 'DECIMAL%')"""))
def q_select_by_type(spark, sf):
    kinds = P.select_by_type(A.applicants(spark, sf), target="approved_flag")
    rows = [(c, "numeric") for c in kinds["numeric"]] + [(c, "categorical") for c in kinds["categorical"]]
    return spark.createDataFrame(rows, "column_name string, kind string")


# ------------------------------------------------------------------ A24 / M24

_MON = "(" + ORACLES["monitoring_row"] + ")"


def audit_checks(mon):
    """Named pass/fail checks over the monitoring rows, one row each."""
    checks = {
        "gini_min_all_models": F.min("gini") >= 0.30,
        "ks_min_all_models": F.min("ks") >= 0.20,
        "psi_max_all_models": F.max("psi") <= 0.25,
        "champion_gini_above_0_5": F.max("gini") >= 0.50,
        "no_status_alerts": F.sum(F.when(col("status") != "OK", 1).otherwise(0)) == 0,
    }
    one = mon.agg(*[c.alias(n) for n, c in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), col(n).alias("passed"))
                                         for n in checks])))


@query("audit_table", f"""
SELECT * FROM (
  SELECT 'gini_min_all_models' AS "check", MIN(gini) >= 0.30 AS passed FROM {_MON} m UNION ALL
  SELECT 'ks_min_all_models', MIN(ks) >= 0.20 FROM {_MON} m UNION ALL
  SELECT 'psi_max_all_models', MAX(psi) <= 0.25 FROM {_MON} m UNION ALL
  SELECT 'champion_gini_above_0_5', MAX(gini) >= 0.50 FROM {_MON} m UNION ALL
  SELECT 'no_status_alerts', SUM(CASE WHEN status <> 'OK' THEN 1 ELSE 0 END) = 0 FROM {_MON} m)""")
def q_audit_table(spark, sf):
    from riskframe.operators import monitoring as M
    return audit_checks(edge(M.monitoring_rows(A.scored(spark, sf))))


@query("audit_all_passed", f"""
SELECT bool_and(passed) AS all_passed, COUNT(*) FILTER (WHERE passed) AS n_passed, COUNT(*) AS n_checks FROM (
  SELECT MIN(gini) >= 0.30 AS passed FROM {_MON} m UNION ALL
  SELECT MIN(ks) >= 0.20 FROM {_MON} m UNION ALL
  SELECT MAX(psi) <= 0.25 FROM {_MON} m UNION ALL
  SELECT MAX(gini) >= 0.50 FROM {_MON} m UNION ALL
  SELECT SUM(CASE WHEN status <> 'OK' THEN 1 ELSE 0 END) = 0 FROM {_MON} m)""")
def q_audit_all_passed(spark, sf):
    from riskframe.operators import monitoring as M
    t = audit_checks(edge(M.monitoring_rows(A.scored(spark, sf))))
    return t.agg(F.bool_and("passed").alias("all_passed"), F.count_if(col("passed")).alias("n_passed"),
                 F.count("*").alias("n_checks"))


# ------------------------------------------------------------------ A26

@query("profile_audit", "SELECT COUNT(*) AS n_profiles, MIN(n_fields) AS min_fields, MAX(n_fields) AS max_fields "
       "FROM (SELECT (last_type IS NOT NULL)::INT + (last_value IS NOT NULL)::INT + 1 AS n_fields FROM ("
       + ORACLES["latest_profile"] + ") p)")
def q_profile_audit(spark, sf):
    """Stored profiles and fields per profile (over every profile, not a sample)."""
    prof = stateful_queries.q_latest_profile(spark, sf)
    fields = F.size(F.map_filter(F.map_from_arrays(
        F.array(F.lit("last_type"), F.lit("last_value"), F.lit("last_update")),
        F.array(col("last_type"), col("last_value").cast("string"), col("last_update").cast("string"))),
        lambda k, v: v.isNotNull()))
    return prof.agg(F.count("*").alias("n_profiles"), F.min(fields).alias("min_fields"),
                    F.max(fields).alias("max_fields"))


# ------------------------------------------------------------------ U3

_U3_FEATS = ["netmonthlyincome", "total_tl", "tot_active_tl", "unsecured_tl", "tot_missed_pmnt",
             "num_times_delinquent", "num_times_30p_dpd", "num_times_60p_dpd", "tot_enq", "enq_l12m", "age",
             "cc_utilization", "pl_utilization"]


def _u3_sql() -> str:
    def ranked(target: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), CAST({target} AS DOUBLE))) AS r FROM applicants"
            for c in _U3_FEATS)
    return S.with_(S.APPLICANTS, f"""
SELECT CAST(COUNT(*) AS INTEGER) AS n_common, COUNT(*) >= 5 AS passed FROM (
  SELECT feature FROM ({ranked('credit_score')}) ORDER BY r DESC NULLS LAST, feature LIMIT 10) a
JOIN (
  SELECT feature FROM ({ranked('netmonthlyincome')}) WHERE feature <> 'netmonthlyincome'
  ORDER BY r DESC NULLS LAST, feature LIMIT 10) b USING (feature)""")


@query("feature_overlap", _u3_sql())
def q_feature_overlap(spark, sf):
    """Overlap of two top-10 feature rankings (|corr| with the score and
    with income); five or more common names pass."""
    app = A.applicants(spark, sf)

    def top10(target: str, feats: list[str], side: str):
        corr = app.agg(*[F.abs(F.corr(col(c).cast("double"), col(target).cast("double"))).alias(c) for c in feats])
        pairs = corr.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), col(c).alias("r"))
                                               for c in feats])))
        return pairs.orderBy(col("r").desc_nulls_last(), "feature").limit(10).select("feature", F.lit(side).alias("side"))

    both = top10("credit_score", _U3_FEATS, "a").unionByName(
        top10("netmonthlyincome", [c for c in _U3_FEATS if c != "netmonthlyincome"], "b"))
    common = both.groupBy("feature").agg(F.count_distinct("side").alias("n")).where(col("n") == 2)
    n = F.count("*").cast("int")
    return common.agg(n.alias("n_common"), (n >= 5).alias("passed"))
