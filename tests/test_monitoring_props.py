"""Closed-form properties of the monitoring statistics."""

import math
import random

from pyspark.sql import functions as F

from riskframe.operators import monitoring as M


def _pred(spark, rows):
    return spark.createDataFrame(rows, "g string, p double, y int")


def _auc_brute(rows):
    pos = [p for _, p, y in rows if y == 1]
    neg = [p for _, p, y in rows if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _ks_brute(rows):
    pos = [p for _, p, y in rows if y == 1]
    neg = [p for _, p, y in rows if y == 0]
    best = 0.0
    for t in sorted({p for _, p, _ in rows}):
        best = max(best, abs(sum(p < t for p in pos) / len(pos) - sum(p < t for p in neg) / len(neg)))
    return best


def test_auc_and_ks_match_brute_force_with_ties(spark):
    rnd = random.Random(7)
    rows = [("a", rnd.randint(0, 20) / 20.0, rnd.randint(0, 1)) for _ in range(400)]
    r = M.roc_summary(_pred(spark, rows), "g").first()
    assert math.isclose(r["auc"], _auc_brute(rows), abs_tol=1e-12)
    assert math.isclose(r["gini"], 2 * _auc_brute(rows) - 1, abs_tol=1e-12)
    assert math.isclose(r["ks"], _ks_brute(rows), abs_tol=1e-12)
    assert 0.0 <= r["auc"] <= 1.0 and 0.0 <= r["ks"] <= 1.0


def test_auc_of_negated_score_is_complement(spark):
    rnd = random.Random(3)
    rows = [("a", rnd.random(), rnd.randint(0, 1)) for _ in range(300)]
    df = _pred(spark, rows)
    a = M.roc_summary(df, "g").first()["auc"]
    b = M.roc_summary(df.withColumn("p", -F.col("p")), "g").first()["auc"]
    assert math.isclose(a + b, 1.0, abs_tol=1e-12)


def test_one_class_group_has_null_auc_and_nan_scores_are_dropped(spark):
    rows = [("one", 0.1, 1), ("one", 0.2, 1), ("two", 0.3, 1), ("two", 0.1, 0), ("two", float("nan"), 0)]
    out = {r["g"]: r for r in M.roc_summary(_pred(spark, rows), "g").collect()}
    assert out["one"]["auc"] is None and out["one"]["ks"] is None
    assert out["two"]["auc"] == 1.0 and out["two"]["n_neg"] == 1


def test_skewed_group_is_exact(spark):
    # one group holds most rows: the two-level prefix sums must stay exact
    rnd = random.Random(11)
    rows = [("hot", rnd.randint(0, 500) / 500.0, rnd.randint(0, 1)) for _ in range(3000)]
    rows += [("cold", rnd.random(), i % 2) for i in range(20)]
    out = {r["g"]: r for r in M.roc_summary(_pred(spark, rows), "g").collect()}
    hot = [r for r in rows if r[0] == "hot"]
    assert math.isclose(out["hot"]["auc"], _auc_brute(hot), abs_tol=1e-12)
    assert math.isclose(out["hot"]["ks"], _ks_brute(hot), abs_tol=1e-12)


def test_psi_of_identical_samples_is_zero_and_shift_is_positive(spark):
    rnd = random.Random(5)
    vals = [(rnd.random(),) for _ in range(2000)]
    e = spark.createDataFrame(vals, "v double").withColumn("g", F.lit("m"))
    same = M.psi_quantile(e, e, "g", "v").first()["psi"]
    shifted = M.psi_quantile(e, e.withColumn("v", F.col("v") * 0.5), "g", "v").first()["psi"]
    assert abs(same) < 1e-12
    assert shifted > 0.1


def test_psi_with_fewer_than_three_breakpoints_is_zero(spark):
    e = spark.createDataFrame([(1.0,)] * 50, "v double").withColumn("g", F.lit("m"))
    a = spark.createDataFrame([(2.0,)] * 50, "v double").withColumn("g", F.lit("m"))
    assert M.psi_quantile(e, a, "g", "v").first()["psi"] == 0.0


def test_psi_fixed_bins_nonnegative(spark):
    rnd = random.Random(9)
    e = spark.createDataFrame([(rnd.random(), "m") for _ in range(500)], "v double, g string")
    a = spark.createDataFrame([(rnd.random() ** 2, "m") for _ in range(500)], "v double, g string")
    assert M.psi_fixed(e, a, "g", "v").first()["psi"] >= 0.0


def test_kappa_of_identical_raters_is_one(spark):
    rows = [("m", i % 4, i % 4) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, pred_a int, pred_b int")
    r = M.cohen_kappa(df, "g").first()
    assert r["agreement"] == 1.0 and math.isclose(r["kappa"], 1.0)


def test_kappa_hand_computed(spark):
    # 2x2 table [[20, 5], [10, 15]]: po = 0.7, pe = 0.5*0.6 + 0.5*0.4 = 0.5, kappa = 0.4
    rows = [("m", 0, 0)] * 20 + [("m", 0, 1)] * 5 + [("m", 1, 0)] * 10 + [("m", 1, 1)] * 15
    df = spark.createDataFrame(rows, "g string, pred_a int, pred_b int")
    r = M.cohen_kappa(df, "g").first()
    assert math.isclose(r["agreement"], 0.7) and math.isclose(r["kappa"], 0.4)


def test_null_group_is_a_group(spark):
    rows = [(None, 0.1, 0, "test"), (None, 0.9, 1, "test"), (None, 0.2, 0, "train"), (None, 0.8, 1, "train"), ("a", 0.9, 0, "test"),
            ("a", 0.1, 1, "test"), ("a", 0.5, 1, "train")]
    df = spark.createDataFrame(rows, "model string, p double, y int, split string")
    roc = {r.model: r.auc for r in M.roc_summary(df.where("split = 'test'"), "model").collect()}
    assert roc == {None: 1.0, "a": 0.0}
    psi = {r.model for r in M.psi_quantile(df.where("split = 'train'"), df.where("split = 'test'"), "model", "p").collect()}
    assert psi == {None, "a"}
    assert {r.model_name: r.gini for r in M.monitoring_rows(df).collect()} == {None: 1.0, "a": -1.0}
    ap = {r.model: r.average_precision for r in M.average_precision(df.where("split = 'test'"), "model").collect()}
    assert ap == {None: 1.0, "a": 0.5}
    q = {r.model: r.p for r in M.exact_quantiles(df, "model", "p", [0.5]).collect()}
    assert q == {None: 0.5, "a": 0.5}


def test_outlier_does_not_crowd_a_piece(spark):
    """99.9 % of the values lie in a thousandth of the range."""
    from pyspark.sql import functions as F
    from riskframe.operators.keys import range_pieces
    df = spark.range(8000).select(F.lit("g").alias("g"), (F.col("id") / 8000).alias("v")).union(
        spark.range(5).select(F.lit("g"), F.lit(-99999.0) - F.col("id")))
    n = [r["count"] for r in range_pieces(df, ["g", "v"], "_b").groupBy("_b").count().collect()]
    assert len(n) > 1 and max(n) <= 2 * sum(n) / len(n)
