"""Evaluation metrics as queries over a score table ``(y int, score double)``
(E1-E11).

Curves are cumulative counts over *distinct* scores in descending order. The
running sums are distributed: scores are cut into range buckets by an
approximate quantile sketch (any cut is correct, the sketch only balances
them), per-bucket totals give each bucket its offset (a table of at most
``buckets`` rows), and the running sum inside a bucket is a window partitioned
by bucket. No step orders all rows in one task.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import bucket_count

from ..functions.exprs import flag


def with_predictions(scores: DataFrame, threshold: float = 0.5, score: str = "score",
                     out: str = "pred") -> DataFrame:
    """Label at a threshold: 1 when score > threshold (a tie goes to class 0)."""
    return scores.withColumn(out, flag(F.col(score) > threshold))


def confusion(scored: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """One row tn, fp, fn, tp (zeros kept), with ``by`` one per group."""
    return scored.groupBy(*by).agg(
        F.count_if((F.col(y) == 0) & (F.col(pred) == 0)).alias("tn"),
        F.count_if((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"),
        F.count_if((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn"),
        F.count_if((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"))


def _z(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_scores(scored: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """E2 + E3: precision, recall, F1 (0 when undefined), accuracy, FPR, FNR."""
    c = confusion(scored, y, pred, by)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    p, r = _z(tp, tp + fp), _z(tp, tp + fn)
    return c.select("*", p.alias("precision"), r.alias("recall"),
                    _z(2 * p * r, p + r).alias("f1"),
                    _z(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    _z(fp, fp + tn).alias("false_positive_rate"),
                    _z(fn, fn + tp).alias("false_negative_rate"))


def classification_report(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per-class precision / recall / F1 / support, then accuracy, macro and
    support-weighted averages (rows ``0``, ``1``, ``accuracy``, ``macro avg``,
    ``weighted avg``)."""
    c = confusion(scored, y, pred)
    rows = []
    for cls, tp_, fp_, fn_ in (("0", "tn", "fn", "fp"), ("1", "tp", "fp", "fn")):
        tp, fp, fn = F.col(tp_), F.col(fp_), F.col(fn_)
        p, r = _z(tp, tp + fp), _z(tp, tp + fn)
        rows.append(c.select(F.lit(cls).alias("label"), p.alias("precision"), r.alias("recall"),
                             _z(2 * p * r, p + r).alias("f1_score"),
                             (tp + fn).cast("bigint").alias("support")))
    per = rows[0].unionByName(rows[1])
    tot = per.agg(F.sum("support").alias("n"))
    acc = c.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   _z(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
                   .alias("f1_score"),
                   (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).cast("bigint").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                    F.sum("support").cast("bigint").alias("support"))
    w = per.crossJoin(tot)
    weighted = w.agg(F.lit("weighted avg").alias("label"),
                     _z(F.sum(F.col("precision") * F.col("support")), F.first("n")).alias("precision"),
                     _z(F.sum(F.col("recall") * F.col("support")), F.first("n")).alias("recall"),
                     _z(F.sum(F.col("f1_score") * F.col("support")), F.first("n")).alias("f1_score"),
                     F.sum("support").cast("bigint").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def cumulative_by_order(df: DataFrame, order: str, sums: list[str], descending: bool = True,
                        buckets: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running sums of ``sums`` in ``order`` (ties: one row per value is
    expected; no nulls) as a distributed prefix sum over range buckets; with ``by``
    one running sum per group (no null groups), all cut by the same buckets."""
    buckets = buckets or bucket_count(df.sparkSession)
    rel_err = min(0.001, 0.5 / buckets)
    qs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(v for v in df.approxQuantile(order, qs, rel_err) if v is not None))
    splits = [-float("inf")] + (cuts or [0.0]) + [float("inf")]
    d = df.withColumn("_o", F.col(order).cast("double"))
    d = Bucketizer(splits=splits, inputCol="_o", outputCol="_bk", handleInvalid="keep").transform(d)
    sign = -1 if descending else 1
    d = d.withColumn("_bk", (F.col("_bk") * sign).cast("int"))
    tot = d.groupBy(*by, "_bk").agg(*[F.sum(c).alias("_t_" + c) for c in sums])
    ow = (Window.partitionBy(*by) if by else Window).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    tot = tot.select(*by, "_bk", *[F.coalesce(F.sum("_t_" + c).over(ow), F.lit(0)).alias("_o_" + c)
                                   for c in sums])
    ordcol = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy(*by, "_bk").orderBy(ordcol).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(tot if by else F.broadcast(tot), [*by, "_bk"])
    for c in sums:
        d = d.withColumn("cum_" + c, F.col("_o_" + c) + F.sum(c).over(w))
    return d.drop("_o", "_bk", *["_o_" + c for c in sums])


def curve_points(scores: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative tp / fp at every distinct score (descending), with the counts
    just before it, and totals P / N: the basis of E5-E8. Rows without a score
    or a label are left out of all of these. With ``by`` one curve per group."""
    scores = scores.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    counts = [F.sum(F.col(y)).cast("bigint"), (F.count(F.lit(1)) - F.sum(F.col(y))).cast("bigint")]
    g = scores.groupBy(*by, F.col(score).alias("threshold")).agg(counts[0].alias("pos"), counts[1].alias("neg"))
    return counted_points(g, scores.groupBy(*by).agg(counts[0].alias("P"), counts[1].alias("N")), by)


def counted_points(g: DataFrame, tot: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``curve_points`` from the positives and negatives of every distinct score (``threshold``, ``pos``, ``neg``) and the totals P / N."""
    c = cumulative_by_order(g, "threshold", ["pos", "neg"], by=by)
    return ((c.join(tot, list(by)) if by else c.crossJoin(F.broadcast(tot)))
            .select(*by, "threshold", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    (F.col("cum_pos") - F.col("pos")).alias("tp_prev"),
                    (F.col("cum_neg") - F.col("neg")).alias("fp_prev"), "P", "N"))


def _prec(tp, fp, empty):
    return F.when(tp + fp == 0, F.lit(empty)).otherwise(tp / (tp + fp))


def pr_curve(scores: DataFrame, **kw) -> DataFrame:
    """E5: (threshold, precision, recall) at distinct scores, plus the end point
    (threshold null, precision 1, recall 0)."""
    c = curve_points(scores, **kw)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    pts = c.select("threshold", _prec(tp, fp, 1.0).alias("precision"),
                   _z(F.col("tp"), F.col("P")).alias("recall"))
    end = scores.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                              F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def pr_auc(scores: DataFrame, points: DataFrame | None = None, by: tuple[str, ...] = (), **kw) -> DataFrame:
    """E6 + E7: trapezoidal area under the PR curve starting at (0, 1), and
    average precision (step sum of delta recall times precision). One row, with
    ``by`` one per group. ``points``: a precomputed ``curve_points`` table to reuse."""
    c = points if points is not None else curve_points(scores, by=by, **kw)
    tp, fp, tpp, fpp = (F.col(x).cast("double") for x in ("tp", "fp", "tp_prev", "fp_prev"))
    P = F.col("P").cast("double")
    p, pp = _prec(tp, fp, 1.0), _prec(tpp, fpp, 1.0)
    r, rp = _z(tp, P), _z(tpp, P)
    return c.groupBy(*by).agg(F.sum((r - rp) * (p + pp) / 2).alias("pr_auc"),
                              F.sum((r - rp) * p).alias("average_precision"))


def roc(scores: DataFrame, points: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """ROC points (threshold, fpr, tpr) incl. the (0, 0) start, and the
    trapezoidal ROC-AUC as one row."""
    c = points if points is not None else curve_points(scores, **kw)
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    tpr, fpr = _z(F.col("tp"), P), _z(F.col("fp"), N)
    tprp, fprp = _z(F.col("tp_prev"), P), _z(F.col("fp_prev"), N)
    pts = c.select("threshold", fpr.alias("fpr"), tpr.alias("tpr"))
    start = scores.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                                F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    auc = c.agg(F.sum((fpr - fprp) * (tpr + tprp) / 2).alias("roc_auc"))
    return pts.unionByName(start), auc


def detection_summary(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Fraud detection rate (recall on the positives) and accuracy."""
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(y) == 1).alias("n_fraud"),
        _z(F.count_if((F.col(y) == 1) & (F.col(pred) == 1)), F.count_if(F.col(y) == 1))
        .alias("detection_rate"),
        _z(F.count_if(F.col(y) == F.col(pred)), F.count(F.lit(1))).alias("accuracy"))


def with_correct_flag(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """E9 row form: the ``correct`` boolean."""
    return scored.withColumn("correct", F.col(y) == F.col(pred))


def fold_summary(per_fold: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population std of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.agg(*aggs)


def hardest_cases(scored: DataFrame, key: str = "hash", y: str = "y", pred: str = "pred",
                  score: str = "score") -> DataFrame:
    """Highest-scored true positive, highest-scored false positive and
    lowest-scored false negative (ties broken by key), as one row each."""
    tp = scored.where((F.col(y) == 1) & (F.col(pred) == 1)).agg(
        F.lit("true_positive").alias("case"),
        F.max_by(F.col(key), F.struct(F.col(score), F.col(key))).alias(key),
        F.max(score).alias(score))
    fp = scored.where((F.col(y) == 0) & (F.col(pred) == 1)).agg(
        F.lit("false_positive").alias("case"),
        F.max_by(F.col(key), F.struct(F.col(score), F.col(key))).alias(key),
        F.max(score).alias(score))
    fn = scored.where((F.col(y) == 1) & (F.col(pred) == 0)).agg(
        F.lit("false_negative").alias("case"),
        F.min_by(F.col(key), F.struct(F.col(score), F.col(key))).alias(key),
        F.min(score).alias(score))
    return tp.unionByName(fp).unionByName(fn)
