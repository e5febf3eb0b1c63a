"""Registered fits take every training row and the original's number of rounds."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models as ML
from ledgerlens.operators import sampling as L
from ledgerlens.plans import model_queries as Q

ROWS = 12_000
FEATS = ["a", "b"]


@pytest.fixture
def fits(spark, monkeypatch):
    """Per fit its rows of either class and its rounds; the fit itself is made with small trees."""
    a, b = (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(20)).cast("double") for s in (1, 2))
    d = spark.range(ROWS).select(F.format_string("h%05d", "id").alias("hash"), F.col("id").alias("ts"), a.alias("a"), b.alias("b"),
                                 F.pmod(F.col("id"), F.lit(10)).alias("_m")).withColumn("is_fraud", (F.col("_m") == 0).cast("int")).drop("_m")
    monkeypatch.setattr(Q, "model_data", lambda *_: (L.temporal_split(d.coalesce(2).cache()), FEATS))
    monkeypatch.setattr(Q, "_DONE", {})
    seen, real = [], ML.fit

    def fit(df, features, label, estimator, scale=False):
        n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
        small = estimator.copy()
        rounds = next((small.getOrDefault(p) for p in ("maxIter", "numTrees") if small.hasParam(p)), None)
        seen.append((n[0], n[1], rounds))
        small._set(**{p: v for p, v in (("maxIter", 1), ("numTrees", 1), ("maxDepth", 2)) if small.hasParam(p)})
        return real(df, features, label, small, scale)

    monkeypatch.setattr(ML, "fit", fit)
    return seen


def test_boosted_queries_fit_every_training_row(spark, fits):
    Q.q_boosted_rounds(spark, "whole").collect()
    assert fits == [(6912, 768, 300)]  # 0.8 of the first 0.8 of the rows


def test_boosted_smote_fits_every_training_row(spark, fits):
    Q.q_model_boosted_smote(spark, "whole").collect()
    assert fits == [(8640, int(8640 * 0.35), 400)]


def test_comparison_fits_every_training_row(spark, fits):
    assert Q.q_model_efficiency(spark, "whole").count() == 5
    assert fits == [(8640, 960, n) for n in (300, 200, 200, None, 1000)]


def test_folds_of_the_time_series_fit_every_row_before(spark, fits):
    Q.q_ts_cv(spark, "whole").collect()
    assert [n for n, _, _ in fits] == [1800 * i for i in range(1, 6)] and all(r == 300 for _, _, r in fits)
    assert all(p > 200 * (i + 1) for i, (_, p, _) in enumerate(fits))


def test_stratified_folds_fit_every_other_row(spark, fits):
    Q.q_kfold_cv(spark, "whole").collect()
    assert fits == [(8640, int(8640 * 0.35), 400)] * 5
