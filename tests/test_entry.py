"""Driver contract, and every query without an oracle checked for what it must hold."""

import math

import numpy as np
import pytest

import __spark_entry__ as E
from riskframe.operators import retrieval as RT
from riskframe.operators import stats as ST
from riskframe.sources import adapters as A
from tests.conftest import SF_SMALL

LLM = {n for n in E.queries() if n == "pipeline" or n.startswith("op")}
ROWS_ONLY = sorted(set(E.queries()) - set(E.oracle_sql()) - LLM)


MODELS = {"logistic_regression", "random_forest", "decision_tree", "gradient_boosting", "second_order_boosting"}


def rows(spark, name):
    return E.queries()[name](spark, SF_SMALL).collect()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[0] == "credit_score_band"
    assert df.count() > 0


def test_every_query_without_an_oracle_is_checked_below():
    import inspect
    import sys
    source = inspect.getsource(sys.modules[__name__])
    assert [n for n in ROWS_ONLY if f'"{n}"' not in source] == []


def test_train_and_evaluate(spark):
    got = {r.model: r for r in rows(spark, "train_and_evaluate")}
    assert set(got) == MODELS
    for r in got.values():
        assert 0.4 < r.accuracy <= 1 and 0 < r.f1 <= 1 and 0.5 < r.auc_ovr <= 1
    assert got["second_order_boosting"].auc_ovr >= got["gradient_boosting"].auc_ovr - 0.02


def test_batch_score_all_models(spark):
    got = rows(spark, "batch_score_all_models")
    total, seen = {}, set()
    for r in got:
        assert (r.row_id, r.model, r.cls) not in seen and 0 <= r.p <= 1
        seen.add((r.row_id, r.model, r.cls))
        total[r.row_id, r.model] = total.get((r.row_id, r.model), 0) + r.p
    assert all(abs(t - 1) < 1e-9 for t in total.values())
    assert {m for _, m in total} == MODELS and len(total) == len(MODELS) * len({i for i, _ in total})


def test_batch_score_covers_every_applicant(spark, monkeypatch):
    """Rows learned from, held back and without a decision are all scored, by every model."""
    from riskframe.operators import mlops as ML
    build = ML.build_models
    monkeypatch.setattr(ML, "build_models", lambda **kw: build(names=["logistic_regression", "decision_tree"]))
    want = {r.prospectid: r.approved_flag for r in A.applicants(spark, SF_SMALL).select("prospectid", "approved_flag").collect()}
    got = {}
    for r in rows(spark, "batch_score_all_models"):
        got.setdefault((r.row_id, r.model), set()).add(r.cls)
        assert (r.y is None) == (want[r.row_id] is None) and math.isfinite(r.p)
    assert set(got) == {(i, m) for i in want for m in ("logistic_regression", "decision_tree")}
    assert None in want.values() and all(len(c) == len(set(want.values()) - {None}) for c in got.values())


def test_evaluate_bundle(spark):
    got = rows(spark, "evaluate_bundle")
    assert {r.model for r in got} == MODELS
    for m in {r.model for r in got}:
        mine = [r for r in got if r.model == m]
        assert sum(r.support for r in mine) == sum(r.predicted for r in mine) > 0
        assert all(r.tp <= min(r.support, r.predicted) for r in mine)


def test_champion_gate(spark):
    got = rows(spark, "champion_gate")
    assert len(got) == 1 and got[0].approved == (got[0].metric_value >= 0.70)


def test_random_search_cv(spark):
    from riskframe.operators.search import GRIDS
    got = rows(spark, "random_search_cv")
    assert {f: sum(r.family == f for r in got) for f in GRIDS} == {f: 8 if f == "k_nearest_neighbours" else 10 for f in GRIDS}
    n = {r.rows for r in got}
    assert len(n) == 1 and all(len(r.fold_f1) == 5 and 0 < r.mean_f1 <= 1 for r in got)
    for f in GRIDS:
        best = [r for r in got if r.family == f and r.best]
        assert len(best) == 1 and best[0].mean_f1 >= max(r.mean_f1 for r in got if r.family == f) - 1e-9 and best[0].test_f1 > 0.3


def test_seed_stability_models(spark):
    got = rows(spark, "seed_stability_models")
    assert len(got) == 4 and all(0 < r.auc_cv_pct < 30 and 0 < r.f1_cv_pct < 60 for r in got)


def test_payload_rows_fail_as_values(spark):
    """Planted bad payloads come back with their reason; all others are scored."""
    errors = {r.prospectid: r.error for r in rows(spark, "payload_errors")}
    for k, e in errors.items():
        want = ([] if k % 43 else ["age: missing"]) + ([] if k % 41 else ["credit_score: not a number"])
        assert (e or "") == ("malformed payload" if k % 37 == 0 else "; ".join(sorted(want, reverse=True)))
    assert len(set(errors.values())) >= 4
    scored = rows(spark, "score_payloads")
    assert {r.row_id for r in scored} == set(errors) and len(scored) == 2 * len(errors)
    decided = rows(spark, "batch_decide")
    assert sorted(r.row_id for r in decided) == sorted(errors)
    for r in scored:
        p = [r.p_class_0, r.p_class_1, r.p_class_2, r.p_class_3]
        assert r.error == errors[r.row_id]
        assert p == [None] * 4 and r.predicted_class is None if r.error else abs(sum(p) - 1) < 1e-9 and r.confidence == max(p)
    for r in decided:
        assert r.error == errors[r.row_id] and (r.decision_route is None) == (r.error is not None)
    assert {r.decision_route for r in decided} <= {"AUTO_APPROVE", "MANUAL_REVIEW", "AUTO_REJECT", None}


def test_income_and_propensity_models(spark):
    income = rows(spark, "income_model")
    assert len(income) == 1 and all(v is None or math.isfinite(v) for v in income[0] if not isinstance(v, str))
    prop = rows(spark, "propensity_model")
    assert 0 <= prop[0].auc <= 1 and prop[0].average_precision >= prop[0].base_rate * 0.9


def test_linear_contributions_and_importances(spark):
    from riskframe.plans.ml_queries import FEATURES
    got = rows(spark, "linear_contributions")
    assert got and all(math.isfinite(v) for r in got for v in r) and {r.cls for r in got} == {0, 1, 2, 3}
    mean = {(r.cls, r.feature): r.mean_abs for r in rows(spark, "linear_contributions_global")}
    assert len(mean) == 4 * len(FEATURES)
    for c in range(4):
        for f in FEATURES:
            assert math.isclose(mean[c, f], np.mean([abs(r[f]) for r in got if r.cls == c]), rel_tol=1e-6, abs_tol=1e-12)
    top = rows(spark, "feature_importance_fallback")
    assert len(top) == 5 and all(0 <= r.importance <= 1 for r in top)
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)


def test_chi_square_pvalue(spark):
    assert all(0 <= r[c] <= 1 for r in rows(spark, "chi_square_pvalue") for c in r.asDict() if c.startswith("p_value"))


def test_bootstrap(spark):
    ci = {r.model: r for r in rows(spark, "bootstrap_ci")}
    t = A.scored(spark, SF_SMALL).where("split = 'test'")
    from riskframe.operators.monitoring import roc_summary
    auc = {r.model: r.auc for r in roc_summary(t, "model").collect()}
    for m, r in ci.items():
        assert r.n_valid == 300 and r.auc_lo < r.auc_mean < r.auc_hi
        assert abs(r.auc_mean - auc[m]) < (r.auc_hi - r.auc_lo) / 2 and r.auc_lo < auc[m] < r.auc_hi
    assert {r.challenger for r in rows(spark, "auc_delta_pvalue")} == set(auc) - {"logreg"}


def test_bootstrap_replicates_equal_weighted_auc(spark):
    """Pieces chained over the range cut give each replicate's plain weighted AUC."""
    rng = np.random.default_rng(3)
    data = [(float(rng.integers(0, 40)) / 40, int(rng.integers(0, 2))) for _ in range(900)]
    cells = spark.createDataFrame(data, "p double, y int").groupBy("p", "y").count().withColumnRenamed("count", "c")
    from pyspark.sql import functions as F
    cells = cells.withColumn("_seed", F.xxhash64(F.lit(1), "p", "y"))
    got = ST._replicate_aucs(cells, [], "p", "y", 20).first().aucs
    local = cells.collect()
    w = ST._resample([r["_seed"] for r in local], [r.c for r in local], 20)
    for k in range(20):
        pos = [(r.p, w[i, k]) for i, r in enumerate(local) if r.y]
        neg = [(r.p, w[i, k]) for i, r in enumerate(local) if not r.y]
        u = sum(a * b * ((x > y) + 0.5 * (x == y)) for x, a in pos for y, b in neg)
        assert math.isclose(got[k], u / (sum(a for _, a in pos) * sum(b for _, b in neg)), rel_tol=1e-9)


def _plain_auc(score, hit, w):
    pos, neg = [(s, v) for s, h, v in zip(score, hit, w) if h], [(s, v) for s, h, v in zip(score, hit, w) if not h]
    total = sum(v for _, v in pos) * sum(v for _, v in neg)
    return sum(a * b * ((x > y) + 0.5 * (x == y)) for x, a in pos for y, b in neg) / total if total else None


def _multiclass(n=140):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        y = int(rng.integers(0, 3))
        for m, lift in (("champ", 3), ("other", 1), ("third", 0)):
            p = rng.integers(1, 4, 3) + lift * (np.arange(3) == y)
            out.append((i, m, y, [float(v) for v in p / p.sum()]))
    return out


def test_weighted_bootstrap_equals_brute_force_per_replicate(spark):
    from pyspark.sql import functions as F
    data = _multiclass()
    df = spark.createDataFrame(data, "row_id long, model string, y int, probs array<double>")
    n = 12
    cells = df.where("model = 'other'").groupBy("model", "y", "probs").agg(F.count("*").alias("c")).withColumn(
        "_seed", F.xxhash64(F.lit(42), "model", "y", "probs"))
    got = {r.rep: r.auc for r in ST._one_vs_rest(cells, ["model"], "probs", "y", n).collect()}
    local = cells.collect()
    w = ST._resample([r["_seed"] for r in local], [r.c for r in local], n)
    for k in range(n):
        aucs = [_plain_auc([r.probs[c] for r in local], [r.y == c for r in local], w[:, k]) for c in range(3)]
        support = [sum(w[i, k] for i, r in enumerate(local) if r.y == c) for c in range(3)]
        assert math.isclose(got[k], sum(a * s for a, s in zip(aucs, support)) / sum(support), rel_tol=1e-9)
    counts = spark.createDataFrame([("m", y, p, 3 + y + 2 * p) for y in range(3) for p in range(3)], "model string, y int, pred int, n long")
    seeded = counts.withColumn("_seed", F.xxhash64(F.lit(1), "model", "y", "pred")).collect()
    w = ST._resample([r["_seed"] for r in seeded], [r.n for r in seeded], n)
    f1 = {r.rep: r.f1 for r in ST.bootstrap_f1(counts, "model", n, 1).collect()}
    for k in range(n):
        at = {(r.y, r.pred): w[i, k] for i, r in enumerate(seeded)}
        total = score = 0.0
        for c in range(3):
            support, guessed = sum(at[c, p] for p in range(3)), sum(at[y, c] for y in range(3))
            score += support * (2 * at[c, c] / (support + guessed) if support + guessed else 0)
            total += support
        assert math.isclose(f1[k], score / total, rel_tol=1e-9)


def test_paired_deltas_share_their_weights(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(_multiclass(), "row_id long, model string, y int, probs array<double>")
    same = df.unionByName(df.where("model = 'champ'").withColumn("model", F.lit("twin")))
    deltas = ST.paired_deltas(same, "champ", n_boot=20).collect()
    assert all(r.delta == 0 for r in deltas if r.challenger == "twin") and len(deltas) == 60
    p = {r.challenger: r for r in ST.paired_pvalues(same, "champ", n_boot=60).collect()}
    assert p["twin"].p_value == 1 and not p["twin"].significant_at_5pct
    assert p["third"].significant_at_5pct and p["third"].auc_delta > p["other"].auc_delta > 0


def test_weighted_bootstrap_queries(spark):
    got = rows(spark, "bootstrap_ci_weighted")
    assert len(got) == 3 and all(r.n_valid == 300 and r.auc_lo <= r.auc_mean <= r.auc_hi and r.f1_lo <= r.f1_mean <= r.f1_hi for r in got)
    assert {r.challenger for r in rows(spark, "auc_delta_pvalue_weighted")} == {r.model for r in got} - {"logreg"}


def test_resampling_is_one_method_at_every_count():
    for c in (1, 50, 500, 2_000_000):
        w = ST._resample(range(400), [c] * 400, 50)
        assert abs(w.mean() / c - 1) < 5 / math.sqrt(c * 400 * 50) and abs(w.var() / c - 1) < 0.1


def test_payloads(spark):
    import json
    assert all(json.loads(r.payload) for r in rows(spark, "sink_audit_payload"))
    assert len(rows(spark, "facts_payload")) == 1


def test_retrieval(spark):
    hits = rows(spark, "ann_search")
    assert hits and all(r["rank"] >= 1 and -1 - 1e-9 <= r.score <= 1 + 1e-9 for r in hits)
    recall = [r[c] for r in rows(spark, "ann_recall") for c in r.asDict() if "recall" in c]
    assert recall and np.mean(recall) >= 0.9


def test_ann_recall_over_many_cells(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 32)) + 0.5 * rng.standard_normal((4, 32))[rng.integers(0, 4, 6000)]
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    asked = e.where("vec_id % 20 = 0")
    assigned, cent = RT.ivf_index(e, "vec_id", n_cells=250)
    hits = RT.ann_search(asked, "vec_id", assigned, cent, k=5, exclude_self=True)
    exact = RT.knn_topk(asked, e, "vec_id", "vec_id", k=5, exclude_self=True)
    assert RT.recall_at_k(hits, exact).first().recall_at_k >= 0.9


def test_chunkers(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in rows(spark, "chunk_recursive"):
        assert len(r.text) <= 700 or " " not in r.text
        assert r.text.split()[0] in texts[r.doc_id]
    assert {r.doc_id for r in rows(spark, "chunk_by_keywords")} <= set(texts)
    assert {r.doc_id for r in rows(spark, "chunk_by_score_ranges")} <= set(texts)
    assert {r.doc_type for r in rows(spark, "union_chunks")} >= {"policy", "fraud"}
    levels = {r.class_level for r in rows(spark, "chunk_reports_by_keywords")}
    assert {"sub-standard", "doubtful", "unknown"} <= levels
    ranges = rows(spark, "chunk_reports_by_score_ranges")
    assert (500, 650) in {(r.min_score, r.max_score) for r in ranges}


def test_streamed_batch_scoring(spark):
    """Every payload is scored exactly once, over several micro-batches, bad ones as errors."""
    got = rows(spark, "streamed_batch_scoring")
    errors = {r.prospectid: r.error for r in rows(spark, "payload_errors")}
    assert sorted(r.row_id for r in got) == sorted(errors) and len({r["_batch"] for r in got}) > 1
    assert all(r.error == errors[r.row_id] and (r.confidence is None) == (r.error is not None) for r in got)


def test_queue_is_drained_once_across_restarts(spark, tmp_path):
    """A run that failed half way and a restart give every request once; later requests follow."""
    from pyspark.sql import functions as F
    from riskframe.streaming import stateful_stream as SS
    queue, out, ckpt = (str(tmp_path / d) for d in ("queue", "out", "checkpoint"))
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(queue)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(queue)
    calls = []

    def score(batch):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return batch.select("id", (F.col("id") * 2).alias("score"))

    with pytest.raises(Exception, match="lost"):
        SS.drain_queue(stream(), score, out, ckpt)
    SS.drain_queue(stream(), score, out, ckpt)
    spark.range(40, 45).coalesce(1).write.mode("append").parquet(queue)
    SS.drain_queue(stream(), score, out, ckpt)
    assert sorted((r.id, r.score) for r in spark.read.parquet(out).collect()) == [(k, 2 * k) for k in range(45)]


def test_cells_are_fitted_on_a_sample_and_hold_every_vector(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5000, 8))
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(RT, "FIT_ROWS", 10)
    assigned, cent = RT.ivf_index(e, "vec_id")
    assert cent.count() == math.ceil(RT.CELL_FACTOR * math.sqrt(5000)) and assigned.count() == 5000
    asked = e.where("vec_id % 50 = 0")
    exact = RT.knn_topk(asked, e, "vec_id", "vec_id", k=5, exclude_self=True)
    assert RT.recall_at_k(RT.ann_search(asked, "vec_id", assigned, cent, k=5, exclude_self=True), exact).first().recall_at_k >= 0.9


def test_audit_of_eight_checks(spark):
    table = {r.check: r.passed for r in rows(spark, "audit_eight_checks")}
    assert len(table) == 8 and table["importance_stability"]
    ground = rows(spark, "grounding_audit")
    assert table["faithfulness"] == (sum(r.n_invented for r in ground) == 0)
    assert table["citations"] == (sum(r.n_unresolved for r in ground) == 0)
    assert table["schema"] == all(not r.missing and not r.extra and not r.too_few_actions for r in ground)
    assert table["determinism"] == (max(r.auc_cv_pct for r in rows(spark, "seed_stability_cv")) < 5)
    assert table["ab_test"] == any(r.significant_at_5pct for r in rows(spark, "auc_delta_pvalue"))
    assert rows(spark, "audit_eight_passed")[0].n_passed == sum(table.values())


def test_cells_are_fitted_without_all_pairs_of_centres(spark):
    """No iteration of the fit sends the distances between all cells to the driver."""
    import numpy as np
    from riskframe.operators import retrieval as RT
    r = np.random.default_rng(2)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 64)))], "vec_id long, embedding array<double>")
    sc = spark.sparkContext
    sc.setJobGroup("cells", "cells")
    try:
        assigned, centroids = RT.ivf_index(e, "vec_id", n_cells=130)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("cells") for s in tracker.getJobInfo(j).stageIds]
    names = [s.name for s in stages if s is not None]
    assert any("KMeans" in n for n in names) and not any("DistanceMeasure" in n for n in names)
    assert assigned.count() == 400 and centroids.count() == 130
