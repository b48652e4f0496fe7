"""Adapters: credit-shaped inputs derived from the driver's TPC-H-like tables.

The driver tables carry no credit data, so each operator input is derived by
integer arithmetic over real columns (never random numbers), so the same
definition can be written again in plain SQL for the DuckDB oracle
(``riskframe.plans.oracle``).  Every adapter reads whole tables; its work grows
with the data.

Plan shape of ``applicants`` at scale: lineitem is pre-aggregated to one row
per order (map-side partial aggregation), joined to orders on the order key
(both sides hash-partitioned on it), aggregated per customer, and joined to
customer.  The large table is scanned once, with only the needed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.tables import table

col = F.col


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _pick(key: Column, values: list[str | None]) -> Column:
    """CASE key WHEN 0 THEN v0 ... ; a None entry yields NULL."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(key == i, lit) if expr is None else expr.when(key == i, lit)
    return expr


# Fixed values of the adapters (category domains used by the credit data).
EDUCATION = ["SSC", "12TH", "GRADUATE", "UNDER GRADUATE", "POST-GRADUATE"]
PRODUCTS = ["PL", "CC", "ConsumerLoan", "AL", "HL", "others", None]


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicant table (D1 subset): one row per customer, key ``prospectid``."""
    cust = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    orders = table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    li = table(spark, sf_dir, "lineitem",
               ["l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount"])

    q, rf, ls, disc = col("l_quantity"), col("l_returnflag"), col("l_linestatus"), col("l_discount")
    per_order = li.groupBy("l_orderkey").agg(
        _cnt((rf == "A") & (q >= 45)).alias("m_missed"),
        _cnt((ls == "O") & (q >= 45)).alias("m_delinq"),
        _cnt((rf == "R") & (q >= 40)).alias("m_30p"),
        _cnt((rf == "R") & (q >= 48)).alias("m_60p"),
        _cnt((ls == "O") & (q >= 49)).alias("m_d6"),
        _cnt((ls == "O") & (q >= 47)).alias("m_d12"),
        F.max(F.when(ls == "O", q)).alias("m_maxdel"),
        _cnt(disc <= 0.02).alias("m_std"),
        _cnt((disc >= 0.09) & (rf == "N")).alias("m_sub"),
        _cnt((disc >= 0.1) & (rf == "A")).alias("m_dbt"),
        _cnt((disc >= 0.1) & (rf == "R")).alias("m_lss"),
    )
    od = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
    pr, st, ok = col("o_orderpriority"), col("o_orderstatus"), col("o_orderkey")
    per_cust = od.groupBy("o_custkey").agg(
        F.count("*").alias("total_tl"),
        _cnt(st == "F").alias("tot_closed_tl"),
        _cnt(st != "F").alias("tot_active_tl"),
        _cnt(col("o_orderdate") >= F.lit("2001-02-01").cast("timestamp_ntz")).alias("total_tl_opened_l6m"),
        _cnt(pr.isin("1-URGENT", "2-HIGH", "3-MEDIUM")).alias("secured_tl"),
        _cnt(pr.isin("4-NOT SPECIFIED", "5-LOW")).alias("unsecured_tl"),
        _cnt(pr.isin("1-URGENT", "2-HIGH")).alias("tot_enq"),
        _cnt((pr == "1-URGENT") & (ok % 4 == 0)).alias("enq_l3m"),
        _cnt(pr == "1-URGENT").alias("enq_l12m"),
        _cnt((pr == "2-HIGH") & (ok % 3 == 0)).alias("cc_enq_l6m"),
        _cnt((pr == "3-MEDIUM") & (ok % 3 == 0)).alias("pl_enq_l6m"),
        F.sum("m_missed").alias("tot_missed_pmnt"),
        F.sum("m_delinq").alias("num_times_delinquent"),
        F.max("m_maxdel").alias("max_delinquency_level"),
        F.sum("m_30p").alias("num_times_30p_dpd"),
        F.sum("m_60p").alias("num_times_60p_dpd"),
        F.sum("m_d6").alias("num_deliq_6mts"),
        F.sum("m_d12").alias("num_deliq_12mts"),
        F.sum("m_std").alias("num_std"),
        F.sum("m_sub").alias("num_sub"),
        F.sum("m_dbt").alias("num_dbt"),
        F.sum("m_lss").alias("num_lss"),
        F.max("o_orderdate").alias("created_at"),
    )
    k = col("c_custkey")
    base_score = F.lit(469) + (k * 37) % 343
    latent = base_score + (k * 13) % 61 - 30
    counts = ["total_tl", "tot_closed_tl", "tot_active_tl", "total_tl_opened_l6m", "secured_tl",
              "unsecured_tl", "tot_missed_pmnt", "num_times_delinquent", "num_times_30p_dpd",
              "num_times_60p_dpd", "num_deliq_6mts", "num_deliq_12mts", "num_std", "num_sub",
              "num_dbt", "num_lss", "tot_enq", "enq_l3m", "enq_l12m", "cc_enq_l6m", "pl_enq_l6m"]
    j = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
    return j.select(
        k.alias("prospectid"),
        F.when(k % 101 == 0, F.lit(None)).otherwise(F.lit(21) + (k * 7) % 45).cast("int").alias("age"),
        F.when(k % 2 == 0, "M").otherwise("F").alias("gender"),
        F.when(col("c_nationkey") % 3 == 0, "Single").otherwise("Married").alias("maritalstatus"),
        _pick(col("c_nationkey") % 5, EDUCATION).alias("education"),
        F.floor(col("c_acctbal") * 5).cast("int").alias("netmonthlyincome"),
        F.when(k % 97 == 0, F.lit(None)).otherwise(base_score).cast("int").alias("credit_score"),
        F.when(k % 89 == 0, F.lit(None).cast("string"))
         .when(latent > 701, "P1").when(latent > 668, "P2").when(latent > 637, "P3")
         .otherwise("P4").alias("approved_flag"),
        *[F.coalesce(col(c), F.lit(0)).cast("int").alias(c) for c in counts],
        F.col("max_delinquency_level").cast("int").alias("max_delinquency_level"),
        F.when(k % 53 == 0, F.lit(-99999.0)).when(k % 59 == 0, F.lit(None))
         .otherwise(((k * 53) % 101).cast("double")).alias("cc_utilization"),
        ((k * 29) % 97).cast("double").alias("pl_utilization"),
        _pick((k * 5) % 7, PRODUCTS).alias("first_prod_enq2"),
        _pick((k * 11) % 7, PRODUCTS).alias("last_prod_enq2"),
        col("created_at"),
    )


# The three scored models of the predictions adapter and the
# integer score recipe (multiplier, modulus, label lift, denominator).
MODELS = [("logreg", 31, 1009, 400, 1409.0), ("forest", 17, 1009, 150, 1159.0),
          ("knn", 7, 11, 3, 14.0)]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-format binary predictions ``(row_id, model, y, p, split, scored_at)``.

    One row per (order, model); the model axis is an explode of a literal
    array (no join).  Scores are integer-derived with many ties.
    """
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    y = F.when(col("o_orderstatus") == "F", 1).otherwise(0)
    k = col("o_orderkey")
    per_model = F.array(*[
        F.struct(F.lit(name).alias("model"),
                 (((k * mult) % mod + y * lift).cast("double") / F.lit(den)).alias("p"))
        for name, mult, mod, lift, den in MODELS])
    return (o.select(k.alias("row_id"), y.alias("y"), col("o_orderdate").alias("scored_at"),
                     F.when(k % 5 == 0, "test").otherwise("train").alias("split"),
                     F.inline(per_model))
             .select("row_id", "model", "y", "p", "split", "scored_at"))


def multiclass_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide 4-class predictions ``(row_id, model, y, probs array<double>)``.

    ``y`` = order priority rank 1..4 (5 folded to 4) minus one; class
    weights are integer-derived and normalised per row.  Wide form keeps
    arg-max a map-only expression; ``long_probs`` explodes it when needed.
    """
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    k = col("o_orderkey")
    y = F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4)) - 1
    # class weights are computed once per row in their own projection, so the
    # probability arrays reference columns instead of repeating expressions
    wcols = {f"_w{m}_{c}": ((k * (mult + c)) % 7 + F.when(y == c, F.lit(6)).otherwise(F.lit(0)) + 1).cast("double")
             for m, (_, mult) in enumerate(MC_MODELS) for c in range(4)}
    base = o.select(k.alias("row_id"), y.alias("y"), *[e.alias(n) for n, e in wcols.items()])
    per_model = []
    for m, (name, _) in enumerate(MC_MODELS):
        w = [col(f"_w{m}_{c}") for c in range(4)]
        tot = w[0] + w[1] + w[2] + w[3]
        per_model.append(F.struct(F.lit(name).alias("model"), F.array(*[x / tot for x in w]).alias("probs")))
    return (base.select("row_id", "y", F.inline(F.array(*per_model)))
                .select("row_id", "model", "y", "probs"))


# Multi-class models of the adapter (name, multiplier).
MC_MODELS = [("logreg", 31), ("forest", 17), ("knn", 5)]


def monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_monitoring`` rows (D5): one per (model, month) of ``scored``.

    Metric values are integer-derived summaries (a fixture, not real
    metrics; the real ones are ``operators.monitoring.monitoring_rows``).
    Some psi values are NULL to exercise NULL status semantics.
    """
    s = scored(spark, sf_dir)
    month = F.date_trunc("month", col("scored_at"))
    g = s.groupBy("model", month.alias("m")).agg(
        F.expr("max(scored_at) - make_dt_interval(ascii(model) % 7)").alias("scored_at"),
        F.count("*").alias("n"),
        F.sum(col("row_id") * F.ascii("model") % 13).alias("s13"),
        F.sum(col("row_id") * F.ascii("model") % 11).alias("s11"),
        F.sum(col("row_id") * F.ascii("model") % 17).alias("s17"),
    )
    return g.select(
        col("model").alias("model_name"), "scored_at",
        (((col("s13") * 7 + col("n")) % 100).cast("double") / 100.0).alias("gini"),
        (((col("s11") * 3 + col("n") * 7) % 100).cast("double") / 100.0).alias("ks"),
        F.when(F.month("m") == 2, F.lit(None).cast("double"))
         .otherwise(((col("s17") + col("n")) % 40).cast("double") / 100.0).alias("psi"),
        F.lit(0.30).alias("gini_min"), F.lit(0.20).alias("ks_min"), F.lit(0.25).alias("psi_max"),
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_metrics`` (D4): one row per model from ``scored`` at cut 0.5."""
    s = scored(spark, sf_dir)
    pred = (col("p") >= 0.5).cast("int")
    g = s.groupBy("model").agg(
        F.count("*").alias("n"),
        _cnt(pred == col("y")).alias("correct"),
        _cnt((pred == 1) & (col("y") == 1)).alias("tp"),
        _cnt(pred == 1).alias("pp"),
        _cnt(col("y") == 1).alias("ap"),
    )
    prec = F.when(col("pp") > 0, col("tp") / col("pp")).otherwise(0.0)
    rec = F.when(col("ap") > 0, col("tp") / col("ap")).otherwise(0.0)
    return g.select(
        col("model").alias("model_name"),
        (col("correct") / col("n")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1_score"),
        # balanced accuracy at the cut (a one-threshold ROC area)
        ((col("tp") / F.greatest(col("ap"), F.lit(1))
          + (col("n") - col("pp") - col("ap") + col("tp")) / F.greatest(col("n") - col("ap"), F.lit(1)))
         / 2).alias("roc_auc"),
    )


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan book (D17): one loan per order; vintage = order month."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"])
    k = col("o_orderkey")
    return o.select(
        k.alias("loan_id"), col("o_custkey").alias("customer_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("vintage"),
        ((k * 7) % 24 + 1).cast("int").alias("mob"),
        F.when((k * 13) % 100 < 6, 1).otherwise(0).alias("dpd30_flag"),
        F.when((k * 17) % 100 < 3, 1).otherwise(0).alias("first_payment_miss"),
        F.when(col("o_orderstatus") == "F", 1).otherwise(0).alias("approved_flag"),
        F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C").alias("decision_band"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request stream (D10, D12): one request per event, keyed by customer."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(
        col("user_id").alias("customer_id"),
        col("event_type").alias("bucket"),
        col("ts"), col("event_id"), col("value").alias("amount"),
        ((col("user_id") * 7) % 41).alias("device_id"),
    )


def exposure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure ledger input (D13): 'approve' adds to the limit, 'draw' draws."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    kind = F.when(col("event_type").isin("purchase", "view"), "approve").otherwise("draw")
    return e.select(col("user_id").alias("customer_id"), "ts", "event_id",
                    kind.alias("kind"), col("value").alias("amount"))


def generated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated report texts, one per document, as the audits receive them."""
    from riskframe.plans.fixtures_sql import REPORT_TEXT
    return table(spark, sf_dir, "documents", ["doc_id"]).select("doc_id", F.expr(REPORT_TEXT).alias("text"))
