"""Sinks (K1, K3, K4): tables, run-result JSON and persisted models."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> str:
    """K1: write a stage table. Parquet by default; CSV with a header row when
    asked (the original format of every stage)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def run_result(spark: SparkSession, metrics: DataFrame, params: dict | None = None,
               importance: DataFrame | None = None, top_n: int = 20) -> DataFrame:
    """K3: one-row run result: metric row as a struct, parameters, and the
    ``top_n`` features by importance as an ordered array of structs."""
    d = metrics.select(F.struct(*metrics.columns).alias("metrics"))
    d = d.withColumn("parameters", F.lit(json.dumps(params or {}, sort_keys=True)))
    d = d.withColumn("created_at", F.lit(time.strftime("%Y%m%d_%H%M%S")))
    if importance is not None:
        top = (importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(top_n)
               .agg(F.sort_array(F.collect_list(F.struct(
                   (-F.col("importance")).alias("neg"), "feature", "importance"))).alias("_t")))
        top = top.select(F.transform("_t", lambda s: F.struct(s["feature"].alias("feature"),
                                                              s["importance"].alias("importance")))
                         .alias("top_features"))
        d = d.crossJoin(top)
    return d


def write_run_result(result: DataFrame, path: str) -> str:
    """K3 writer: the run result as JSON."""
    result.coalesce(1).write.mode("overwrite").json(path)
    return path


def save_model(model, path: str, feature_names: list[str] | None = None) -> str:
    """K4: persist a fitted Spark ML model (or pipeline) under a time-stamped
    path, with its feature names and every stage's parameters as JSON beside it."""
    stamp = time.strftime("%Y%m%d_%H%M%S")
    out = f"{path.rstrip('/')}/model_{stamp}"
    model.write().overwrite().save(out)
    params = {f"{type(s).__name__}.{p.name}": str(v) for s in getattr(model, "stages", [model]) for p, v in s.extractParamMap().items()}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(feature_names or [], params)], "feature_names array<string>, parameters map<string,string>") \
        .coalesce(1).write.mode("overwrite").json(out + "_info")
    return out
