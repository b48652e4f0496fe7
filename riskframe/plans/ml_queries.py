"""Training / scoring queries (L1-L14).  Model fits are checked by our own
tests (rows-only for the oracle); the encoders have SQL oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import expressions as X
from riskframe.operators import encoding as E
from riskframe.operators import features as FE
from riskframe.operators import mlops as ML
from riskframe.operators import monitoring as M
from riskframe.operators import search as SR
from riskframe.operators import selection as SEL
from riskframe.operators import stats as ST
from riskframe.operators import trees as T
from riskframe.plans import fixtures_sql as S
from riskframe.plans.catalog import edge, query
from riskframe.session import cut_lineage
from riskframe.sources import adapters as A
from riskframe.sources import sinks as K

col = F.col

NUMERIC = ["credit_score", "netmonthlyincome", "total_tl", "tot_active_tl", "unsecured_tl", "tot_missed_pmnt",
           "num_times_delinquent", "num_times_30p_dpd", "num_times_60p_dpd", "tot_enq", "enq_l12m", "age",
           "cc_utilization", "pl_utilization"]
CATEGORICAL = ["education", "maritalstatus", "gender"]


#: Columns that the stages of ``prepare`` read.
RAW = NUMERIC + CATEGORICAL
SCALED = NUMERIC + list(E.ApplicantFeatures.DERIVED)
FEATURES = SCALED + CATEGORICAL


def raw_split(spark, sf):
    """Applicants with a decision, split by stratified hash; ``label`` is the sorted-class code."""
    app = A.applicants(spark, sf).where(col("approved_flag").isNotNull())
    split = cut_lineage(SEL.stratified_split(app, "approved_flag", "prospectid"))
    codes = E.fit_vocabulary(split.where("split = 'train'"), ["approved_flag"])
    classes = [r["value"] for r in codes.orderBy("code").collect()]          # one row per class
    coded = E.apply_vocabulary(split, codes, ["approved_flag"]).withColumnRenamed("approved_flag", "label")
    return coded.where("split = 'train'"), coded.where("split = 'test'"), classes


def preparation(train):
    """Fitted stages from raw applicants to encoded, scaled features (fitted on the training rows only)."""
    return Pipeline(stages=[E.ApplicantFeatures(), E.OrdinalEncoder(CATEGORICAL), E.ColumnScaler(SCALED)]).fit(train)


def training_frame(spark, sf):
    """Prepared training and test rows, feature names, class labels and the preparation."""
    train, test, classes = raw_split(spark, sf)
    prepare = preparation(train)
    # model fitting re-reads its input once per iteration: materialise both
    # splits in the shared checkpoint folder instead of replaying the lineage
    return cut_lineage(prepare.transform(train)), cut_lineage(prepare.transform(test)), FEATURES, classes, prepare


@query("label_encode", S.with_(S.APPLICANTS, """
SELECT prospectid, CAST(DENSE_RANK() OVER (ORDER BY COALESCE(education, 'None')) - 1 AS INTEGER) AS education_code
FROM applicants"""))
def q_label_encode(spark, sf):
    app = A.applicants(spark, sf)
    codes = E.fit_vocabulary(app, ["education"])
    return E.apply_vocabulary(app.select("prospectid", "education"), codes, ["education"]) \
        .select("prospectid", col("education").cast("int").alias("education_code"))


@query("standard_scale", S.with_(S.APPLICANTS, """
SELECT prospectid, ROUND((credit_score - AVG(credit_score) OVER ()) / STDDEV_POP(credit_score) OVER (), 6) AS credit_score,
       ROUND((netmonthlyincome - AVG(netmonthlyincome) OVER ()) / STDDEV_POP(netmonthlyincome) OVER (), 6) AS netmonthlyincome
FROM applicants"""))
def q_standard_scale(spark, sf):
    app = A.applicants(spark, sf).select("prospectid", "credit_score", "netmonthlyincome")
    p = ML.fit_standard_scaler(app, ["credit_score", "netmonthlyincome"])
    return edge(ML.apply_standard_scaler(app, p))


def _trained(spark, sf, names=None):
    train, test, feats, classes, prepare = training_frame(spark, sf)
    models = ML.train_models(train, feats, models=ML.build_models(names=names))
    return models, train, test, feats


@query("train_and_evaluate")
def q_train_eval(spark, sf):
    models, train, test, feats = _trained(spark, sf)
    scored = ML.score_long(models, test, "prospectid")
    prf = M.weighted_prf(scored, "model")
    auc = M.auc_ovr_weighted(ML.long_probabilities(scored), "model")
    return prf.join(auc, "model")


@query("batch_score_all_models")
def q_batch_score(spark, sf):
    """Every applicant by every model; ``y`` is NULL where there is no decision."""
    train, test, feats, classes, prepare = training_frame(spark, sf)
    models = ML.train_models(train, feats)
    undecided = A.applicants(spark, sf).where(col("approved_flag").isNull()).withColumn("label", F.lit(None).cast("double"))
    every = [df.select("prospectid", "label", *feats) for df in (train, test, cut_lineage(prepare.transform(undecided)))]
    return ML.long_probabilities(ML.score_long(models, reduce(DataFrame.unionByName, every), "prospectid"))


@query("evaluate_bundle")
def q_eval_bundle(spark, sf):
    """The saved bundle, loaded again, scores raw test applicants."""
    train, test, classes = raw_split(spark, sf)
    prepare = preparation(train)
    models = ML.train_models(cut_lineage(prepare.transform(train)), FEATURES)
    path = K.new_location(spark, "bundle")
    ML.save_bundle(models, path, FEATURES, classes, prepare)
    scored = ML.score_long(ML.load_bundle(path), test.select("prospectid", "label", *RAW), "prospectid")
    return M.classwise_report(scored, "model")


@query("champion_gate")
def q_champion_gate(spark, sf):
    models, train, test, feats = _trained(spark, sf)
    prf = M.weighted_prf(ML.score_long(models, test, "prospectid"), "model")
    return SEL.champion_top1(prf.withColumnRenamed("model", "model_name"), metric="f1", gate=0.70)


@query("random_search_cv")
def q_random_search(spark, sf):
    """Every draw of every family with its fold scores; each family's best is fitted again on
    all training rows and scored on the test rows."""
    train, test, feats, classes, prepare = training_frame(spark, sf)
    found = SR.random_search(train, feats, "label", "prospectid", n_draws=10, folds=5)
    refitted = SR.refit(train, feats, "label", found.best)
    scored = ML.score_long(refitted, test, "prospectid")
    f1 = M.weighted_prf(scored, "model").select(col("model").alias("family"), F.lit(True).alias("best"), col("f1").alias("test_f1"))
    return found.table.join(f1, ["family", "best"], "left")


@query("seed_stability_models")
def q_seed_stability(spark, sf):
    """AUC and F1 of models fitted and scored under four seeded splits."""
    train, test, feats, classes, prepare = training_frame(spark, sf)
    every = train.unionByName(test)
    specs = {"gradient_boosting": T.gradient_boosting(**ML.FIRST_ORDER), "second_order_boosting": T.newton_boosting(**ML.SECOND_ORDER),
             "random_forest": T.random_forest(trees=100, depth=ML.TREE_DEPTH), "decision_tree": T.decision_tree(depth=ML.TREE_DEPTH)}
    return SR.seed_stability(every, feats, "label", "prospectid", specs)


# ------------------------------------------------------------------ payloads

#: A payload per applicant as a client sends it, in SQL that both engines run; every 37th is cut
#: off, every 41st has text for a score, every 43rd lacks the age.
_FIELDS = " || ', ' || ".join(
    [f"""'"{c}": ' || coalesce(CAST({c} AS STRING), 'null')""" for c in NUMERIC if c not in ("age", "credit_score")]
    + [f"""'"{c}": "' || {c} || '"'""" for c in CATEGORICAL])
PAYLOAD = f"""CASE WHEN prospectid % 37 = 0 THEN '{{"credit_score": 7' ELSE '{{' || {_FIELDS}
  || ', "credit_score": ' || CASE WHEN prospectid % 41 = 0 THEN '"n/a"' ELSE coalesce(CAST(credit_score AS STRING), 'null') END
  || CASE WHEN prospectid % 43 = 0 THEN '' ELSE ', "age": ' || coalesce(CAST(age AS STRING), 'null') END || '}}' END"""


def _payload_error_sql() -> str:
    """The error of a payload, by JSON functions."""
    tests = ", ".join(
        f"CASE WHEN NOT json_exists(payload, '$.{c}') THEN '{c}: missing'"
        + (f" WHEN payload ->> '$.{c}' IS NOT NULL AND TRY_CAST(payload ->> '$.{c}' AS DOUBLE) IS NULL THEN '{c}: not a number'"
           if c in NUMERIC else "") + " END" for c in NUMERIC + CATEGORICAL)
    return f"CASE WHEN NOT json_valid(payload) THEN 'malformed payload' ELSE nullif(concat_ws('; ', {tests}), '') END"


def sent_payloads(spark, sf):
    """Payloads of the applicants with a decision, as text."""
    return A.applicants(spark, sf).where(col("approved_flag").isNotNull()).select("prospectid", F.expr(PAYLOAD).alias("payload"))


def read(payloads):
    """Typed columns and errors of payloads."""
    return FE.read_payloads(payloads, "payload", NUMERIC, CATEGORICAL, "prospectid")


def payloads(spark, sf):
    return read(sent_payloads(spark, sf))


@query("payload_errors", S.with_(S.APPLICANTS + f""",
sent AS (SELECT prospectid, {PAYLOAD} AS payload FROM applicants WHERE approved_flag IS NOT NULL)""",
                                 f"SELECT prospectid, {_payload_error_sql()} AS error FROM sent"))
def q_payload_errors(spark, sf):
    return payloads(spark, sf).select("prospectid", "error")


def payload_models(spark, sf, names):
    train, test, classes = raw_split(spark, sf)
    prepare = preparation(train)
    fitted = ML.train_models(cut_lineage(prepare.transform(train)), FEATURES, models=ML.build_models(names=names))
    return {n: PipelineModel(stages=[*prepare.stages, *m.stages]) for n, m in fitted.items()}


@query("score_payloads")
def q_score_payloads(spark, sf):
    """Every applicant's payload by two models; a bad one returns its error."""
    models = payload_models(spark, sf, ["logistic_regression", "second_order_boosting"])
    out = ML.score_payloads(models, payloads(spark, sf), "prospectid")
    return out.select("row_id", "model", "predicted_class", "confidence",
                      *[F.try_element_at("probs", F.lit(c + 1)).alias(f"p_class_{c}") for c in range(4)], "error")


@query("batch_decide")
def q_batch_decide(spark, sf):
    """Decision of every applicant's payload; a bad one has an error and no decision."""
    models = payload_models(spark, sf, ["logistic_regression"])
    sc = ML.score_payloads(models, payloads(spark, sf), "prospectid")
    # primary probability: class code 1 when present (the reference's rule)
    p1 = F.try_element_at("probs", F.lit(2))
    r = X.policy_route_credit(p1, approve_above=0.80, middle="MANUAL_REVIEW")
    good = col("error").isNull()
    return sc.select("row_id", "model", col("predicted_class").alias("pred"), *[F.when(good, c).alias(n) for n, c in r.items()], "error")


@query("income_model")
def q_income(spark, sf):
    app = A.applicants(spark, sf).where(col("netmonthlyincome") > 0).fillna(0, NUMERIC)
    split = SEL.stratified_split(app, "approved_flag", "prospectid")
    train, test = split.where(col("split") == "train"), split.where(col("split") == "test")
    feats = [c for c in NUMERIC if c != "netmonthlyincome"]
    m = ML.train_regressor(train, feats, "netmonthlyincome")
    base = train.agg(F.avg("netmonthlyincome")).first()[0]
    pred = m.transform(test).select(col("netmonthlyincome").alias("y"), col("prediction").alias("yhat"))
    return ST.regression_metrics(pred, "y", "yhat", baseline=base)


@query("propensity_model")
def q_propensity(spark, sf):
    app = A.applicants(spark, sf).withColumn("label", X.propensity_label()).fillna(0, NUMERIC)
    split = SEL.stratified_split(app, "label", "prospectid")
    train, test = split.where(col("split") == "train"), split.where(col("split") == "test")
    m = ML.train_binary(train, NUMERIC, "label")
    t = m.transform(test).select("label", F.element_at(vector_to_array("probability"), 2).alias("p"))
    ap = M.average_precision(t.withColumn("g", F.lit("propensity")), "g", "p", "label")
    roc = M.roc_summary(t.withColumn("g", F.lit("propensity")), "g", "p", "label")
    return ap.join(roc.select("g", "auc"), "g")


def _logistic(spark, sf):
    models, train, test, feats = _trained(spark, sf, ["logistic_regression"])
    means = train.agg(*[F.avg(f).alias(f) for f in feats]).first().asDict()
    return models["logistic_regression"], test.select("prospectid", *feats), feats, means


@query("linear_contributions")
def q_linear(spark, sf):
    """Contribution of every feature to every class, per applicant."""
    model, test, feats, means = _logistic(spark, sf)
    out = None
    for c in range(model.stages[-1].numClasses):
        one = ML.linear_contributions(model, test, feats, c, means).withColumn("cls", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


@query("linear_contributions_global")
def q_linear_global(spark, sf):
    model, test, feats, means = _logistic(spark, sf)
    return ML.mean_contributions(model, test, feats, means)


@query("feature_importance_fallback")
def q_importance(spark, sf):
    models, train, test, feats = _trained(spark, sf, ["random_forest"])
    top = ML.feature_importances(models["random_forest"], feats, 5)
    return spark.createDataFrame(top, "feature string, importance double")
