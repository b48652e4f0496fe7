"""Model monitoring statistics (M1-M10, M22, M23, W4) as grouped aggregates.

Input is a long predictions table; every statistic is computed for all
groups (models, classes, replicates) in one plan, never in a Python loop.

Ranking statistics (AUC, KS, average precision, exact quantiles) need prefix
sums over sorted scores.  A single window per model would sort all of a
model's distinct scores in one task, and one model may hold a third of the
rows, so prefix sums are computed in two levels:

1. rows are reduced to one row per (group, distinct score) by a hash
   aggregate (map-side partial aggregation absorbs hot groups);
2. those rows are range partitioned by (group, score) at sampled cut points, so
   outliers and crowded scores fill no piece; piece totals (at most groups +
   partitions rows) give every piece its offset through a small window;
3. a window partitioned by (group, piece) adds the prefix inside the piece.

A NULL group is a group like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.keys import join_on, range_pieces

col = F.col


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def with_prefix(counts: DataFrame, keys, value: str, measures: list[str]) -> DataFrame:
    """Add ``<m>_lt`` (sum of ``m`` over rows of the same group with a
    strictly smaller ``value``) and ``<m>_tot`` for every measure.

    ``counts`` must hold one row per (keys, value).  A NULL key is a group.
    """
    keys = _keys(keys)
    c = range_pieces(counts, [*keys, value], "_b")
    totals = c.groupBy(*keys, "_b").agg(*[F.sum(m).alias(f"_bt_{m}") for m in measures])
    w_before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_bt_{m}").over(w_before), F.lit(0)).alias(f"_bo_{m}") for m in measures],
        *[F.sum(f"_bt_{m}").over(w_all).alias(f"{m}_tot") for m in measures])
    w_in = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = c.select("*", *[F.coalesce(F.sum(m).over(w_in), F.lit(0)).alias(f"_in_{m}") for m in measures])
    j = join_on(inner, offsets, keys + ["_b"])
    return j.select(*[x for x in counts.columns],
                    *[(col(f"_bo_{m}") + col(f"_in_{m}")).alias(f"{m}_lt") for m in measures],
                    *[col(f"{m}_tot") for m in measures])


def score_counts(pred: DataFrame, keys, score: str = "p", label: str | Column = "y",
                 weight: str | Column | None = None) -> DataFrame:
    """One row per (keys, score): positive and negative (weighted) counts.

    NULL / NaN scores are dropped (the reference's scorer would fail on them).
    """
    keys = _keys(keys)
    lab = col(label) if isinstance(label, str) else label
    w = F.lit(1) if weight is None else (col(weight) if isinstance(weight, str) else weight)
    valid = col(score).isNotNull() & ~F.isnan(col(score)) & lab.isNotNull()
    return (pred.where(valid)
            .groupBy(*keys, score)
            .agg(F.sum(F.when(lab == 1, w).otherwise(0)).alias("pos"),
                 F.sum(F.when(lab == 1, 0).otherwise(w)).alias("neg")))


def cumulative_class_curve(pred: DataFrame, keys, score: str = "p", label: str = "y") -> DataFrame:
    """Per distinct score, positives/negatives at scores >= it
    (the curve swept by descending thresholds), with TPR and FPR."""
    keys = _keys(keys)
    pre = with_prefix(score_counts(pred, keys, score, label), keys, score, ["pos", "neg"])
    cum_pos = col("pos_tot") - col("pos_lt")
    cum_neg = col("neg_tot") - col("neg_lt")
    return pre.select(*keys, score, "pos", "neg", cum_pos.alias("cum_pos"), cum_neg.alias("cum_neg"),
                      F.try_divide(cum_pos, col("pos_tot")).alias("tpr"),
                      F.try_divide(cum_neg, col("neg_tot")).alias("fpr"))


def roc_summary(pred: DataFrame, keys, score: str = "p", label: str | Column = "y",
                weight: str | Column | None = None) -> DataFrame:
    """M1-M3: exact tie-aware AUC (Mann-Whitney), Gini = 2*AUC-1 and KS per group.

    AUC = sum over scores of pos * (neg below + neg/2) / (P*N).  KS is the
    largest |TPR - FPR| over distinct thresholds.  Groups with one class
    only get NULL (AUC is undefined there).
    """
    keys = _keys(keys)
    pre = with_prefix(score_counts(pred, keys, score, label, weight), keys, score, ["pos", "neg"])
    pn = col("pos_tot").cast("double") * col("neg_tot").cast("double")
    diff = F.abs(col("neg_lt") / col("neg_tot") - col("pos_lt") / col("pos_tot"))
    g = pre.groupBy(*keys).agg(
        F.first("pos_tot").alias("n_pos"), F.first("neg_tot").alias("n_neg"),
        F.sum(col("pos").cast("double") * (col("neg_lt") + col("neg") / 2.0)).alias("_u"),
        F.max(F.when(pn > 0, diff)).alias("_ks"),
        F.first(pn).alias("_pn"))
    auc = F.when(col("_pn") > 0, col("_u") / col("_pn"))
    return g.select(*keys, "n_pos", "n_neg", auc.alias("auc"), (2 * auc - 1).alias("gini"),
                    F.when(col("_pn") > 0, col("_ks")).alias("ks"))


def average_precision(pred: DataFrame, keys, score: str = "p", label: str = "y") -> DataFrame:
    """AP = sum over distinct thresholds (descending) of
    (R_t - R_prev) * P_t, plus the positive base rate."""
    keys = _keys(keys)
    pre = with_prefix(score_counts(pred, keys, score, label), keys, score, ["pos", "neg"])
    tp = col("pos_tot") - col("pos_lt")
    fp = col("neg_tot") - col("neg_lt")
    prec = tp / (tp + fp)
    g = pre.groupBy(*keys).agg(
        F.sum(F.when(col("pos_tot") > 0, col("pos") / col("pos_tot") * prec)).alias("average_precision"),
        F.first(col("pos_tot") / (col("pos_tot") + col("neg_tot"))).alias("base_rate"))
    return g


def pr_curve(pred: DataFrame, keys, score: str = "p", label: str = "y") -> DataFrame:
    """Precision and recall at every distinct threshold."""
    keys = _keys(keys)
    pre = with_prefix(score_counts(pred, keys, score, label), keys, score, ["pos", "neg"])
    tp = col("pos_tot") - col("pos_lt")
    fp = col("neg_tot") - col("neg_lt")
    return pre.select(*keys, col(score).alias("threshold"),
                      (tp / (tp + fp)).alias("precision"),
                      F.try_divide(tp, col("pos_tot")).alias("recall"))


# ------------------------------------------------------------------ exact quantiles

def exact_quantiles(df: DataFrame, keys, value: str, qs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group (numpy's default).

    Works on (group, distinct value) counts and prefix counts, so no group's
    values are ever gathered in one place.  Returns (keys, q_idx, q, value).
    """
    keys = _keys(keys)
    return quantiles_from_counts(distinct_value_counts(df, keys, value), keys, value, qs)


def distinct_value_counts(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys, value, cnt) over non-NULL, non-NaN values (map-side combined)."""
    keys = _keys(keys)
    v = df.where(col(value).isNotNull() & ~F.isnan(col(value)))
    return v.groupBy(*keys, value).agg(F.count("*").alias("cnt"))


def quantiles_from_counts(counts: DataFrame, keys, value: str, qs: list[float]) -> DataFrame:
    """``exact_quantiles`` on a (keys, value, cnt) table."""
    keys = _keys(keys)
    pre = with_prefix(counts, keys, value, ["cnt"])
    # numpy: virtual index = n*q - q ; lo = floor ; hi = min(lo+1, n-1)
    targets = []
    for j, q in enumerate(qs):
        h = col("cnt_tot") * F.lit(q) - F.lit(q)
        lo = F.floor(h)
        hi = F.least(lo + 1, col("cnt_tot") - 1)
        targets.append(F.struct(F.lit(j).alias("j"), F.lit(q).alias("q"), (h - lo).alias("_frac"),
                                lo.alias("lo"), hi.alias("hi")))
    arr = F.array(*targets)
    hit = pre.select(*keys, value, "cnt", "cnt_lt", F.explode(arr).alias("t"))
    inside = lambda idx: (col("cnt_lt") <= idx) & (idx < col("cnt_lt") + col("cnt"))
    hit = hit.where(inside(col("t.lo")) | inside(col("t.hi")))
    per = hit.groupBy(*keys, col("t.j").alias("q_idx"), col("t.q").alias("q")).agg(
        F.max(F.when(inside(col("t.lo")), col(value))).alias("_qa"),
        F.max(F.when(inside(col("t.hi")), col(value))).alias("_qb"),
        F.first("t._frac").alias("_frac"))
    a, b, g = col("_qa"), col("_qb"), col("_frac")
    lerp = F.when(g >= 0.5, b - (b - a) * (1 - g)).otherwise(a + (b - a) * g)
    return per.select(*keys, "q_idx", "q", lerp.alias(value))


def _linspace(bins: int) -> list[float]:
    step = 1.0 / bins
    return [j * step for j in range(bins)] + [1.0]


def _bin_of(x: Column, edges: Column) -> Column:
    """Histogram bin with bins [e_i, e_i+1), the last one closed; NULL
    when x is outside [e_0, e_k]."""
    n = F.size(edges)
    le = F.size(F.filter(edges, lambda e: e <= x))
    return (F.when((x < F.element_at(edges, 1)) | (x > F.element_at(edges, -1)), F.lit(None))
            .when(x == F.element_at(edges, -1), n - 2)
            .otherwise(le - 1))


def psi_quantile(expected: DataFrame, actual: DataFrame, keys, value: str,
                 bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """M4: PSI with breakpoints at the unique quantiles of ``expected``.

    Fewer than 3 unique breakpoints -> 0.0; values of ``actual`` outside the
    breakpoint range are dropped; proportions of in-range counts are clipped
    at ``floor``; PSI = sum (a - e) * ln(a / e).
    """
    keys = _keys(keys)
    qs = _linspace(bins)
    e_counts = distinct_value_counts(expected, keys, value)
    qv = quantiles_from_counts(e_counts, keys, value, qs)
    # one row per group (at most bins + 1 edges): a small, bounded table
    edges = qv.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("edges"))

    def binned(counts: DataFrame, tag: str) -> DataFrame:
        # bin distinct values, not rows: the join input is the count table
        j = join_on(counts, edges, keys)
        b = j.select(*keys, _bin_of(col(value), col("edges")).alias("bin"), "cnt").where(col("bin").isNotNull())
        return b.groupBy(*keys, "bin").agg(F.sum("cnt").alias(tag))

    all_bins = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"),
                            F.size("edges").alias("n_edges"))
    t = join_on(all_bins, binned(e_counts, "e_cnt"), keys + ["bin"], "left")
    t = join_on(t, binned(distinct_value_counts(actual, keys, value), "a_cnt"), keys + ["bin"], "left")
    t = t.fillna(0, ["e_cnt", "a_cnt"])
    w = Window.partitionBy(*keys)
    e_pct = F.greatest(col("e_cnt") / F.greatest(F.sum("e_cnt").over(w), F.lit(1)), F.lit(floor))
    a_pct = F.greatest(col("a_cnt") / F.greatest(F.sum("a_cnt").over(w), F.lit(1)), F.lit(floor))
    term = (a_pct - e_pct) * F.log(a_pct / e_pct)
    per = t.select(*keys, "n_edges", term.alias("term"))
    out = per.groupBy(*keys).agg(F.sum("term").alias("_s"), F.first("n_edges").alias("_k"))
    # Groups whose expected side yields no edges at all still get 0.0.
    return out.select(*keys, F.when(col("_k") < 3, F.lit(0.0)).otherwise(col("_s")).alias("psi"))


def psi_fixed(expected: DataFrame, actual: DataFrame, keys, value: str, bins: int = 10,
              zero: float = 1e-4) -> DataFrame:
    """M5: ten equal bins on [0, 1]; proportions over the full sample size;
    empty bins replaced by ``zero``."""
    keys = _keys(keys)
    edges = F.array(*[F.lit(e) for e in _linspace(bins)])

    def binned(df: DataFrame, tag: str) -> DataFrame:
        x = df.select(*keys, value)
        return x.groupBy(*keys).agg(
            F.count("*").alias(f"{tag}_n"),
            *[F.count_if(_bin_of(col(value), edges) == i).alias(f"{tag}_{i}") for i in range(bins)])

    j = join_on(binned(expected, "e"), binned(actual, "a"), keys)
    terms = []
    for i in range(bins):
        e = col(f"e_{i}") / col("e_n")
        a = col(f"a_{i}") / col("a_n")
        e = F.when(e == 0, F.lit(zero)).otherwise(e)
        a = F.when(a == 0, F.lit(zero)).otherwise(a)
        terms.append((a - e) * F.log(a / e))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return j.select(*keys, total.alias("psi"))


def monitoring_rows(pred: DataFrame, model: str = "model", score: str = "p", label: str = "y",
                    split: str = "split", scored_at: str = "2001-09-01 00:00:00",
                    thresholds: dict | None = None) -> DataFrame:
    """M6: one monitoring row per model: gini and ks on the test split, psi
    of train scores vs test scores, thresholds and status (D5 layout)."""
    from riskframe.functions.expressions import monitor_status, thresholds as bounds
    t = bounds(thresholds)
    test = pred.where(col(split) == "test")
    train = pred.where(col(split) == "train")
    roc = roc_summary(test, model, score, label)
    psi = psi_quantile(train, test, model, score)
    # a model of only one split still has its row; NULL is a model like any other
    models = roc.select(model).union(psi.select(model)).distinct()
    j = join_on(join_on(models, roc, [model], "left"), psi, [model], "left")
    return j.select(
        col(model).alias("model_name"),
        F.lit(scored_at).cast("timestamp_ntz").alias("scored_at"),
        "gini", "ks", "psi",
        F.lit(t["gini_min"]).alias("gini_min"), F.lit(t["ks_min"]).alias("ks_min"),
        F.lit(t["psi_max"]).alias("psi_max"),
    ).withColumn("status", monitor_status())


# ------------------------------------------------------------------ multi-class

def predicted_class(wide: DataFrame, probs: str = "probs") -> DataFrame:
    """O7 on a wide table: first arg max of the probability array."""
    p = col(probs)
    return wide.withColumn("pred", F.array_position(p, F.array_max(p)) - 1)


def long_probs(wide: DataFrame, keys: list[str], probs: str = "probs") -> DataFrame:
    """Wide (array) probabilities -> one row per class (map-only posexplode)."""
    return wide.select(*keys, F.posexplode(probs).alias("cls", "p"))


def confusion_counts(pred: DataFrame, keys, actual: str = "y", predicted: str = "pred") -> DataFrame:
    keys = _keys(keys)
    return pred.groupBy(*keys, actual, predicted).agg(F.count("*").alias("n"))


def confusion_matrix(pred: DataFrame, keys, classes: list[int], actual: str = "y",
                     predicted: str = "pred") -> DataFrame:
    """M9: counts by (actual, predicted) with one column per predicted class."""
    keys = _keys(keys)
    return (pred.groupBy(*keys, actual).pivot(predicted, classes).count()
            .fillna(0, [str(c) for c in classes])
            .select(*keys, actual, *[col(str(c)).alias(f"pred_{c}") for c in classes]))


def classwise_report(pred: DataFrame, keys, actual: str = "y", predicted: str = "pred") -> DataFrame:
    """Per-class precision, recall, f1, support (zero_division = 0)."""
    return classwise_of_counts(confusion_counts(pred, keys, actual, predicted), keys, actual, predicted)


def classwise_of_counts(cc: DataFrame, keys, actual: str = "y", predicted: str = "pred") -> DataFrame:
    """``classwise_report`` of confusion counts ``(keys, actual, predicted, n)``."""
    keys = _keys(keys)
    per_true = cc.groupBy(*keys, col(actual).alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(col(actual) == col(predicted), col("n"))).alias("tp"))
    per_pred = cc.groupBy(*keys, col(predicted).alias("cls")).agg(F.sum("n").alias("predicted"))
    every = per_true.select(*keys, "cls").union(per_pred.select(*keys, "cls")).distinct()
    j = join_on(join_on(every, per_true, keys + ["cls"], "left"), per_pred, keys + ["cls"], "left")
    j = j.fillna(0, ["support", "tp", "predicted"])
    prec = F.when(col("predicted") > 0, col("tp") / col("predicted")).otherwise(0.0)
    rec = F.when(col("support") > 0, col("tp") / col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.select(*keys, "cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    "support", "tp", "predicted")


def weighted_prf(pred: DataFrame, keys, actual: str = "y", predicted: str = "pred") -> DataFrame:
    """M7: accuracy and support-weighted precision / recall / F1."""
    return weighted_prf_of_counts(confusion_counts(pred, keys, actual, predicted), keys, actual, predicted)


def weighted_prf_of_counts(cc: DataFrame, keys, actual: str = "y", predicted: str = "pred") -> DataFrame:
    """``weighted_prf`` of confusion counts ``(keys, actual, predicted, n)``."""
    keys = _keys(keys)
    rep = classwise_of_counts(cc, keys, actual, predicted)
    return rep.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(col("precision") * col("support")) / F.sum("support")).alias("precision"),
        (F.sum(col("recall") * col("support")) / F.sum("support")).alias("recall"),
        (F.sum(col("f1") * col("support")) / F.sum("support")).alias("f1"))


def macro_avg(rep: DataFrame, keys) -> DataFrame:
    """M10 macro average over classes with support or predictions."""
    keys = _keys(keys)
    return rep.groupBy(*keys).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                  F.avg("f1").alias("f1"), F.sum("support").alias("support"))


def auc_ovr_weighted(long: DataFrame, keys, actual: str = "y", cls: str = "cls",
                     score: str = "p") -> DataFrame:
    """M8: one-vs-rest AUC per class, averaged with class-support weights."""
    keys = _keys(keys)
    lab = F.when(col(actual) == col(cls), 1).otherwise(0)
    per = roc_summary(long.withColumn("_lab", lab), keys + [cls], score, "_lab")
    return per.groupBy(*keys).agg(
        (F.sum(col("auc") * col("n_pos")) / F.sum(F.when(col("auc").isNotNull(), col("n_pos")))).alias("auc_ovr"))


def cohen_kappa(pairs: DataFrame, keys, a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    """(po - pe) / (1 - pe) and plain agreement, from two-way counts.

    One linear chain over the (small) two-way count table: each count cell
    feeds rater A's marginal of class ``a`` and rater B's marginal of class
    ``b``; per (group, class) the marginals multiply, per group they sum.
    The input is read and shuffled once.
    """
    keys = _keys(keys)
    cc = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    n = col("n")
    sides = F.array(
        F.struct(col(a).alias("c"), n.alias("na"), F.lit(0).cast("long").alias("nb"),
                 F.when(col(a) == col(b), n).otherwise(F.lit(0)).cast("long").alias("agree")),
        F.struct(col(b).alias("c"), F.lit(0).cast("long").alias("na"), n.alias("nb"),
                 F.lit(0).cast("long").alias("agree")))
    per_class = (cc.select(*keys, F.inline(sides))
                 .groupBy(*keys, "c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"),
                                          F.sum("agree").alias("agree")))
    g = per_class.groupBy(*keys).agg(F.sum("na").alias("tot"), F.sum("agree").alias("agree"),
                                     F.sum(col("na").cast("double") * col("nb")).alias("_s"))
    po = col("agree") / col("tot")
    pe = col("_s") / (col("tot").cast("double") * col("tot"))
    return g.select(*keys, po.alias("agreement"),
                    F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(math.nan)).alias("kappa"))
