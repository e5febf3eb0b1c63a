"""Models, scoring, comparison, CV and attributions.

Training is Spark ML (distributed tree / linear learners); features are
assembled into a vector only at the model edge. Scores come back as a
``(row id, y, score, pred)`` table that the metric operators consume.
Attributions are an array per row: linear ones as column expressions, those of
tree ensembles by TreeSHAP over the node table (``operators.trees``).
"""

from __future__ import annotations

import time
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import land
from ..session import checkpoint_dir
from . import metrics as M
from . import trees
from .oversampling import adasyn, smote


def gbt(max_iter=300, step=0.05, depth=6, subsample=0.8, colsample="0.8", seed=42, weight_col=None):
    """M1 / M2 / M3 / M5: gradient-boosted trees (one family in Spark ML)."""
    kw = dict(maxIter=max_iter, stepSize=step, maxDepth=depth, subsamplingRate=subsample,
              featureSubsetStrategy=colsample, seed=seed)
    if weight_col:
        kw["weightCol"] = weight_col
    return GBTClassifier(**kw)


def random_forest(trees=200, depth=15, min_leaf=2, seed=42):
    """M4 (Spark ML has no minimum-split option; leaf minimum kept)."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)


def logistic(max_iter=1000, reg=None, n=None, tol=1e-4):
    """M6: L2 logistic regression, C = 1 summed loss -> regParam 1 / n on Spark's
    mean loss; features standardised beforehand (no internal scaling); the
    stopping tolerance of the original solver (1e-4)."""
    return LogisticRegression(maxIter=max_iter, regParam=(reg if reg is not None else (1.0 / n if n else 0.0)),
                              elasticNetParam=0.0, standardization=False, tol=tol)


def decision_tree(depth=15, min_leaf=5, seed=42):
    """M7."""
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)


# The models that are compared, with the original's parameters.
MODEL_ZOO = {
    "gradient_boosting_xgb_params": lambda n: gbt(300, 0.05, 6, 0.8, "0.8"),
    "gradient_boosting": lambda n: gbt(200, 0.1, 5, 1.0, "all"),
    "random_forest": lambda n: random_forest(),
    "decision_tree": lambda n: decision_tree(),
    "logistic_regression": lambda n: logistic(n=n),
}


def fit(df: DataFrame, features: list[str], label: str, estimator, scale: bool = False):
    """Assemble (and optionally standardise with L12's means and population deviations, zero counting
    as 1) and fit; returns the fitted pipeline, which holds the scaling constants in its stages."""
    stages, fcol = [VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")], "_features"
    if scale:
        one = df.agg(*[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(features)]).first()
        inverse = [1.0 / (one[f"s{i}"] or 1.0) for i in range(len(features))]
        stages += [StandardScaler(inputCol="_features", outputCol="_centred", withMean=True, withStd=False),
                   ElementwiseProduct(scalingVec=Vectors.dense(inverse), inputCol="_centred", outputCol="_scaled")]
        fcol = "_scaled"
    stages.append(estimator.copy().setFeaturesCol(fcol).setLabelCol(label))
    return Pipeline(stages=stages).fit(df)


def score(model, df: DataFrame, label: str, key: str = "hash", threshold: float = 0.5) -> DataFrame:
    """Probability of class 1 and the label above ``threshold`` (a tie is class 0)."""
    out = model.transform(df)
    return out.select(F.col(key), F.col(label).cast("int").alias("y"),
                      vector_to_array("probability")[1].alias("score")) \
        .withColumn("pred", (F.col("score") > threshold).cast("int"))


def evaluation_row(scored: DataFrame) -> dict:
    """One evaluation as a dict: precision, recall, F1, accuracy, rates,
    confusion counts, ROC-AUC, PR-AUC, average precision (one row reaches the
    driver)."""
    cls = M.classification_scores(scored)
    pts = M.curve_points(scored).persist()  # shared by both areas
    _, roc_auc = M.roc(scored, points=pts)
    pr = M.pr_auc(scored, points=pts)
    row = cls.crossJoin(roc_auc).crossJoin(pr).collect()[0].asDict()
    pts.unpersist()
    return row


def evaluate(scored: DataFrame) -> DataFrame:
    """Evaluation as a one-row DataFrame. Computed eagerly: a lazy metric plan
    embeds the scoring lineage several times, and unions of such plans (model
    comparison, CV folds) grow beyond what the optimizer handles quickly."""
    row = evaluation_row(scored)
    return scored.sparkSession.createDataFrame([row])


def feature_importance(model, features: list[str]) -> DataFrame:
    """M11, Spark ML's own normalised importances of a fitted tree model, descending (see ``trees.importances`` for
    weight, gain and cover)."""
    last = model.stages[-1]
    rows = sorted(zip(features, last.featureImportances.toArray().tolist()), key=lambda t: (-t[1], t[0]))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def weighted(df: DataFrame, label: str, out: str = "_weight") -> DataFrame:
    """Add L10's positive-class weight (negatives / positives; 1 without positives) as a column."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    w = n["neg"] / n["pos"] if n["pos"] else 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))


#: Positive scores (rows x rounds) that a broadcast of ``round_scores`` holds: 64 MB.
ROUND_VALUES = 8_000_000


def round_scores(df: DataFrame, nodes: DataFrame, features: list[str], label: str) -> DataFrame:
    """E6 after every boosting round, ``(round, pr_auc)`` from 1 (the margin orders rows as the probability does).

    Recall only moves at scores of positive rows, so of the negative rows only their number at and between these counts:
    tasks count them against the positives' sorted margins, which are broadcast for as many rounds as ``ROUND_VALUES`` allows,
    and one count for each score or gap leaves a task. Rows below all positives end no step of the curve. Should the positives be
    too many for one round, every row's margins are ordered instead."""
    rows = df.select(F.col(label).cast("int").alias("y"), *[F.col(f"`{c}`") for c in features])
    n_rounds = nodes.agg(F.max("tree")).first()[0]
    n_rounds = 0 if n_rounds is None else n_rounds + 1
    hits = trees.staged_margins(rows.where("y = 1"), nodes, features).select("margins")
    hits = land(hits)
    n_pos = hits.count()
    if not 0 < n_pos <= ROUND_VALUES or not n_rounds:
        d = trees.staged_margins(rows, nodes, features)
        d = d.select("y", F.posexplode("margins").alias("round", "score")).withColumn("round", F.col("round") + 1)
        return M.pr_auc(d, by=("round",)).select("round", "pr_auc")
    step = max(1, ROUND_VALUES // n_pos)
    parts = []
    for first in range(0, n_rounds, step):
        last = min(n_rounds, first + step)
        got = hits.select(F.slice("margins", first + 1, last - first).alias("m")).toArrow().column("m").combine_chunks()
        scores = [np.unique(c) for c in got.flatten().to_numpy(zero_copy_only=False).reshape(n_pos, -1).T]
        shared = df.sparkSession.sparkContext.broadcast(scores)

        def count(batches, shared=shared, first=first, last=last):
            """Per round and score or gap above it: the number of negatives."""
            at = [np.zeros(2 * len(s), np.int64) for s in shared.value]
            for b in batches:
                if not len(b):
                    continue
                m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                for n, s, x in zip(at, shared.value, m.T):
                    i = np.searchsorted(s, x, "right") - 1
                    i, x = i[i >= 0], x[i >= 0]
                    n += np.bincount(2 * i + (x > s[i]), minlength=len(n))
            for r, (n, s) in enumerate(zip(at, shared.value), first + 1):
                some = np.flatnonzero(n)
                if len(some):
                    score = np.where(some % 2 == 1, np.nextafter(s[some // 2], np.inf), s[some // 2])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r, np.int32)), pa.array(score), pa.array(n[some])], names=["round", "threshold", "neg"])

        upto = trees.staged_margins(rows.where("y = 0"), trees.prefix(nodes, last), features)
        parts.append(upto.select(F.slice("margins", first + 1, last - first)).mapInArrow(count, "round int, threshold double, neg long"))
    neg = parts[0]
    for d in parts[1:]:
        neg = neg.unionByName(d)
    pos = hits.select(F.posexplode("margins").alias("round", "threshold")).select((F.col("round") + 1).alias("round"), "threshold", F.lit(1).cast("bigint").alias("pos"))
    g = land(neg.withColumn("pos", F.lit(0).cast("bigint")).unionByName(pos.withColumn("neg", F.lit(0).cast("bigint")))
             .groupBy("round", "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    tot = g.groupBy("round").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return M.pr_auc(None, points=M.counted_points(g, tot, ("round",)), by=("round",)).select("round", "pr_auc")


def stopping_round(curve: list[tuple[int, float]], patience: int) -> int:
    """M1's early stop: training ends once ``patience`` rounds bring no better value; the best round so far
    (the first of equal ones) counts. ``curve``: (round, value) in order."""
    best, at = None, 0
    for r, v in curve:
        if best is None or v > best:
            best, at = v, r
        elif r - at >= patience:
            break
    return at


def boosted(train: DataFrame, validation: DataFrame, features: list[str], label: str, estimator=None, patience: int = 10):
    """M1 / M2 / M5: boosted trees with the positive-class weight, cut to the round that early stopping on the
    validation rows' PR-AUC chooses. Returns (node table of the rounds kept, curve of all rounds, chosen round).

    Spark ML cannot stop on PR-AUC, so all rounds are fitted once and the prefix is chosen from their node table."""
    est = (estimator or gbt()).copy().setWeightCol("_weight")
    model = fit(weighted(train, label), features, label, est)
    nodes = trees.node_table(model)
    curve = round_scores(validation, nodes, features, label).checkpoint()  # as many rows as rounds
    rows = sorted((r["round"], r["pr_auc"]) for r in curve.collect())
    chosen = stopping_round(rows, patience)
    return trees.prefix(nodes, chosen), curve, chosen


def score_nodes(df: DataFrame, nodes: DataFrame, features: list[str], label: str, threshold: float = 0.5) -> DataFrame:
    """M10 for a boosted node table, beside the row's own columns: ``y``, ``score`` = 1 / (1 + exp(-2 margin)), ``pred``."""
    d = trees.margins(df, nodes, features, "_margin")
    return d.withColumn("y", F.col(label).cast("int")).withColumn("score", 1 / (1 + F.exp(-2 * F.col("_margin")))) \
        .withColumn("pred", (F.col("score") > threshold).cast("int")).drop("_margin")


#: Rows worth a task of their own in a fit, which makes a job per tree level.
FIT_TASK_ROWS = 10_000


def all_rows(df: DataFrame) -> DataFrame:
    """All rows for a fit, without an exchange in as few partitions as they are worth."""
    return df.coalesce(max(1, df.count() // FIT_TASK_ROWS))


def fit_rows(df: DataFrame, id_cols: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows, the first in hash order (L13), in few partitions: for a try only, registered fits take ``all_rows``."""
    from .sampling import hash_sample
    return hash_sample(df, id_cols, limit).coalesce(max(1, limit // 10_000)).checkpoint()


def compare_models(train: DataFrame, test: DataFrame, features: list[str], label: str,
                   key: str = "hash", names: list[str] | None = None) -> DataFrame:
    """Train each model, time training and inference, evaluate on the
    test split; one row per model sorted by PR-AUC. (Times are wall-clock of
    the Spark jobs; the score table is materialised once per model.)"""
    n = train.count()
    rows = []
    for name in names or list(MODEL_ZOO):
        est = MODEL_ZOO[name](n)
        t0 = time.time()
        model = fit(train, features, label, est, scale=(name == "logistic_regression"))
        t_train = time.time() - t0
        t0 = time.time()
        sc = score(model, test, label, key).persist()
        n_test = sc.count()
        t_inf = time.time() - t0
        ev = evaluation_row(sc)
        sc.unpersist()
        rows.append(dict(model=name, precision=ev["precision"], recall=ev["recall"], f1=ev["f1"],
                         roc_auc=ev["roc_auc"], pr_auc=ev["pr_auc"], tp=ev["tp"], fp=ev["fp"],
                         fn=ev["fn"], tn=ev["tn"], train_seconds=t_train, inference_seconds=t_inf,
                         rows_per_second=(n_test / t_inf if t_inf > 0 else None)))
    spark = train.sparkSession
    schema = ("model string, precision double, recall double, f1 double, roc_auc double, pr_auc double, "
              "tp bigint, fp bigint, fn bigint, tn bigint, train_seconds double, inference_seconds double, "
              "rows_per_second double")
    return spark.createDataFrame(rows, schema).orderBy(F.col("pr_auc").desc())


def efficiency(results: DataFrame) -> DataFrame:
    """PR-AUC per training second, best model by arg-max, and ranks by
    PR-AUC, efficiency and throughput (the results table has one row per model)."""
    d = results.withColumn("efficiency", F.col("pr_auc") / F.col("train_seconds"))
    for c in ("pr_auc", "efficiency", "rows_per_second"):
        d = d.withColumn(f"rank_{c}", F.row_number().over(Window.orderBy(F.col(c).desc(), "model")))
    return d


def resampled(train: DataFrame, features: list[str], label: str, key: str, resample) -> DataFrame:
    """The training rows, all of them, oversampled by ``resample`` (None: as they are), landed: the count and every pass of the fit read them."""
    rows = train.select(key, label, *[F.col(f"`{c}`") for c in features])
    if resample is not None:
        rows = land(resample(rows, label, key, features).select(label, *[F.col(f"`{c}`") for c in features]))
    return rows


def _fit_resampled(train: DataFrame, features: list[str], label: str, estimator_factory, key: str, scale: bool, resample):
    """Oversample the training rows only (``resample`` None: take them as they are) and fit."""
    rows = resampled(train, features, label, key, resample)
    n = rows.count()
    return fit(rows.coalesce(max(1, n // FIT_TASK_ROWS)), features, label, estimator_factory(n), scale=scale)


def time_series_cv(df: DataFrame, features: list[str], label: str, estimator_factory,
                   key: str = "hash", n_splits: int = 5, ts: str = "ts", scale: bool = True, resample=adasyn) -> DataFrame:
    """M8: expanding-window folds (L4); per fold, oversample the rows before the
    fold (ADASYN), fit on them and score the untouched fold; one metric row per
    fold (E10 summarises them)."""
    from .sampling import time_series_folds
    d = time_series_folds(df, ts, key, n_splits).persist()
    n = d.count()
    t = n // (n_splits + 1)
    first = n - n_splits * t
    rows = []
    for i in range(n_splits):
        start = first + i * t
        train = d.where(F.col("row_idx") < start)
        test = d.where(F.col("test_fold") == i)
        model = _fit_resampled(train, features, label, estimator_factory, key, scale, resample)
        ev = evaluation_row(score(model, test, label, key))
        rows.append((i, ev["pr_auc"], ev["f1"], ev["recall"], ev["precision"]))
    d.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "fold int, pr_auc double, f1 double, recall double, precision double")


def kfold_cv(df: DataFrame, features: list[str], label: str, estimator_factory, key: str = "hash", k: int = 5,
             scale: bool = True, seed: int = 42, resample=partial(smote, sampling_ratio=0.35)) -> DataFrame:
    """M9: stratified folds (L5); per fold, oversample the other folds' rows (SMOTE
    to 0.35 of the majority), fit and score the untouched fold; its ROC-AUC."""
    from .sampling import stratified_kfold
    d = stratified_kfold(df, label, [key], k, seed).persist()
    rows = []
    for i in range(k):
        model = _fit_resampled(d.where(F.col("fold") != i), features, label, estimator_factory, key, scale, resample)
        rows.append((i, evaluation_row(score(model, d.where(F.col("fold") == i), label, key))["roc_auc"]))
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, roc_auc double")


# ---------------------------------------------------------------- attributions
#
# An explained table is the rows with three more columns: ``base_value`` and the arrays ``values`` and
# ``contributions`` in the order of the features. Nothing is exploded or joined before a result needs it, so
# rows need no key and repeated keys are harmless. ``trees.tree_attributions`` gives the same columns.


def linear_contributions(df: DataFrame, terms: list[tuple[str, float, float, float]], intercept: float) -> DataFrame:
    """X1 (linear form) from (feature, coefficient, mean, deviation) terms: the contribution of a feature is
    ``coefficient * (x - mean) / deviation``, the base value the intercept; they add up to the margin.
    A missing value contributes nothing."""
    x = [F.col(f"`{f}`").cast("double") for f, _, _, _ in terms]
    return df.withColumn("base_value", F.lit(float(intercept))) \
        .withColumn("values", F.array(*x)) \
        .withColumn("contributions", F.array(*[F.coalesce(F.lit(float(b)) * (v - F.lit(float(m))) / F.lit(float(d)), F.lit(0.0))
                                               for v, (_, b, m, d) in zip(x, terms)]))


def linear_terms(model, features: list[str]) -> tuple[list[tuple[str, float, float, float]], float]:
    """Terms and intercept of a fitted (loaded) logistic pipeline; the scaling constants are its own stages'.
    Without scaling the mean is 0 and the deviation 1."""
    lr = model.stages[-1]
    mean, deviation = [0.0] * len(features), [1.0] * len(features)
    for stage in model.stages:
        if isinstance(stage, StandardScalerModel):
            mean = stage.mean.toArray().tolist()
        elif isinstance(stage, ElementwiseProduct):
            deviation = [1.0 / w for w in stage.getScalingVec().toArray().tolist()]
    return list(zip(features, lr.coefficients.toArray().tolist(), mean, deviation)), float(lr.intercept)


def linear_attributions(model, df: DataFrame, features: list[str]) -> DataFrame:
    """X1 (linear form): explained rows; contributions are measured from the training means."""
    return linear_contributions(df, *linear_terms(model, features))


def with_score(model, df: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """M10 beside the row's own columns: ``y``, ``score``, ``pred`` (which replace columns of these names)."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("y", "score", "pred")]
    return model.transform(df).select(*own, F.col(label).cast("int").alias("y"),
                                      vector_to_array("probability")[1].alias("score")) \
        .withColumn("pred", (F.col("score") > threshold).cast("int"))


def _names(features: list[str]):
    return F.array(*[F.lit(f) for f in features])


def _largest(features: list[str], n: int):
    """The n largest |contribution| of a row as structs (size, feature, value, contribution), ties by feature."""
    parts = F.arrays_zip(F.transform("contributions", lambda c: -F.abs(c)).alias("size"), _names(features).alias("feature"),
                         F.col("values").alias("value"), F.col("contributions").alias("contribution"))
    named = F.transform(parts, lambda p: F.struct(p["size"].alias("size"), p["feature"].alias("feature"),
                                                  p["value"].alias("value"), p["contribution"].alias("contribution")))
    return F.slice(F.array_sort(named), 1, n)


def attribution_table(explained: DataFrame, features: list[str], key: str = "hash") -> DataFrame:
    """One row per (row, feature) with value, contribution, base value, actual label, prediction and
    probability; rows must carry ``y``, ``score``, ``pred``."""
    parts = F.arrays_zip(_names(features).alias("feature"), F.col("values").alias("value"), F.col("contributions").alias("contribution"))
    return explained.select(key, "base_value", F.col("y").alias("actual_label"), F.col("pred").alias("predicted_label"),
                            F.col("score").alias("predicted_proba"), F.inline(parts).alias("feature", "value", "contribution")) \
        .withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def global_importance(explained: DataFrame, features: list[str]) -> DataFrame:
    """Mean |contribution| per feature, descending (one pass, one row, then as many rows as features)."""
    one = explained.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"_{i}") for i in range(len(features))])
    parts = F.arrays_zip(_names(features).alias("feature"), F.array(*[F.col(f"_{i}") for i in range(len(features))]).alias("m"))
    return one.select(F.inline(parts).alias("feature", "mean_abs_contribution")) \
        .orderBy(F.col("mean_abs_contribution").desc(), "feature")


def top_features_per_row(explained: DataFrame, features: list[str], key: str = "hash", n: int = 5) -> DataFrame:
    """The n largest |contribution| of every row with direction (0 counts as 'decreases'); no shuffle."""
    d = explained.select(key, "base_value", F.posexplode(_largest(features, n)).alias("rank", "p"))
    return d.select(key, (F.col("rank") + 1).alias("rank"), "p.feature", F.nanvl("p.value", F.lit(None).cast("double")).alias("value"),
                    "p.contribution", "base_value",
                    F.when(F.col("p.contribution") > 0, F.lit("increases")).otherwise(F.lit("decreases")).alias("direction"))


def waterfall(explained: DataFrame, features: list[str], row_key, key: str = "hash", n: int = 15) -> DataFrame:
    """The top-n contributions by |value| of the row(s) with this key, with the running total from the base value."""
    d = explained.where(F.col(key) == F.lit(row_key)).withColumn("_top", _largest(features, n))
    d = d.select(key, "base_value", "_top", F.posexplode("_top").alias("rank", "p"))
    total = F.aggregate(F.slice("_top", F.lit(1), F.col("rank") + 1), F.col("base_value"), lambda a, p: a + p["contribution"])
    return d.select(key, (F.col("rank") + 1).alias("rank"), "p.feature", F.nanvl("p.value", F.lit(None).cast("double")).alias("value"),
                    "p.contribution", "base_value", total.alias("cumulative"))


def dependence(explained: DataFrame, features: list[str], feature: str, key: str = "hash") -> DataFrame:
    """(value, contribution) of one feature with the interaction feature whose value correlates most (|corr|,
    ties to the greater name) with this feature's contribution; all correlations in one pass."""
    at = features.index(feature)
    c = F.col("contributions")[at]
    others = [i for i in range(len(features)) if i != at]
    aggs = []
    for i in others:
        v = F.nanvl(F.col("values")[i], F.lit(None).cast("double"))
        both = F.when(v.isNotNull(), c)
        # try_divide: a constant feature has no correlation (null), not an error
        aggs.append(F.struct(F.coalesce(F.abs(F.try_divide(F.covar_samp(both, v), F.stddev_samp(both) * F.stddev_samp(v))), F.lit(-1.0)).alias("r"),
                             F.lit(features[i]).alias("name"), F.lit(i).alias("i")).alias(f"_{i}"))
    best = explained.agg(*aggs).select(F.greatest(*[F.col(f"_{i}") for i in others]).alias("_best")) if len(others) > 1 \
        else explained.agg(*aggs).select(F.col(f"_{others[0]}").alias("_best"))
    none = F.lit(None).cast("double")
    return explained.crossJoin(F.broadcast(best)).select(
        key, F.nanvl(F.col("values")[at], none).alias("value"), c.alias("contribution"),
        F.col("_best.name").alias("interaction_feature"), F.nanvl(F.element_at("values", F.col("_best.i") + 1), none).alias("interaction_value"))
