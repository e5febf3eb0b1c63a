"""Profiling / EDA aggregates (D1-D17). Each is one or two aggregation passes;
results are small tables (one row per column, class, bin, day ...)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import numeric_columns
from ..functions.quantiles import exact_quantile_expr_table, group_key, grouped_quantiles
from ..session import checkpoint_dir


#: Most classes whose statistics are broadcast to the rows.
CLASS_ROWS = 10_000


def _q(c: str) -> str:
    return f"`{c}`"


def null_profile(df: DataFrame, top: int | None = None) -> DataFrame:
    """Per column null count and percent (one aggregation pass, unpivoted);
    ``top`` keeps the columns with most nulls."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(_q(c)).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c.replace(chr(39), '')}', c{i}" for i, c in enumerate(cols))
    long = row.selectExpr("_n", f"stack({len(cols)}, {stack}) AS (column_name, null_count)")
    long = long.select("column_name", F.col("null_count").cast("bigint"),
                       (F.col("null_count") * 100.0 / F.col("_n")).alias("null_pct"))
    if top:
        long = long.orderBy(F.col("null_count").desc(), "column_name").limit(top)
    return long


def class_distribution(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Count and percent per class."""
    tot = df.agg(F.count(F.lit(1)).alias("_n"))
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
            .crossJoin(F.broadcast(tot))
            .select(label, "count", (F.col("count") * 100.0 / F.col("_n")).alias("percent")))


def crosstab_normalized(df: DataFrame, row: str = "is_fraud", col: str = "suspected_drainer") -> DataFrame:
    """D3: two-way counts normalised per row value."""
    c = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))
    tot = c.groupBy(row).agg(F.sum("count").alias("_row"))
    return c.join(tot, row).select(row, col, "count", (F.col("count") / F.col("_row")).alias("share"))


def duplicate_count(df: DataFrame, key: str = "hash") -> DataFrame:
    """Rows beyond the first per key (null keys count as one value)."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.col(key))
                   - F.max(F.col(key).isNull().cast("int"))).alias("duplicates"))


def time_range(df: DataFrame, ts: str = "ts") -> DataFrame:
    """D6."""
    return df.agg(F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"))


def daily_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Transactions per day and the running total (the window runs over
    the per-day table, one row per day)."""
    d = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_tx"))
    return d.withColumn("cumulative_tx", F.sum("n_tx").over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def hourly_histogram(df: DataFrame, ts: str = "ts") -> DataFrame:
    """24 hour bins."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n_tx"))


def day_hour_matrix(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Weekday (Monday 0) x hour counts, hours as columns h0..h23."""
    return (df.withColumn("_h", F.hour(ts)).groupBy(F.weekday(ts).alias("day_of_week"))
            .pivot("_h", list(range(24))).agg(F.count(F.lit(1))).na.fill(0)
            .select("day_of_week", *[F.col(str(h)).cast("bigint").alias(f"h{h}") for h in range(24)]))


def equal_width_histogram(df: DataFrame, col: str, bins: int, where=None,
                          transform=None) -> DataFrame:
    """``bins`` equal-width bins over [min, max]; the last bin is closed
    (numpy rule). Bounds come from a one-row aggregate joined by broadcast."""
    x = F.col(col).cast("double") if transform is None else transform(F.col(col))
    d = df.select(x.alias("x"))
    if where is not None:
        d = d.where(where(F.col("x")))
    d = d.where(F.col("x").isNotNull())
    mm = d.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    h = d.crossJoin(F.broadcast(mm)).groupBy(idx.alias("bin"), "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("count"))
    return h.select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("lower"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("upper"),
                    "count")


def describe_by_class(df: DataFrame, value: str, label: str) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of ``value`` per class
    (quartiles exact, linear, scale-safe)."""
    base = df.groupBy(label).agg(F.count(value).alias("count"), F.avg(value).alias("mean"),
                                 F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
                                 F.max(value).alias("max"))
    q = grouped_quantiles(df, label, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumnRenamed(label, "_label")
    return base.join(q, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def box_stats(df: DataFrame, value: str, label: str, k: float = 1.5) -> DataFrame:
    """Quartiles, IQR and whiskers (furthest values within k IQR) per class; rows without a label are a class.
    The table of classes is broadcast while it has at most ``CLASS_ROWS`` rows."""
    checkpoint_dir(df.sparkSession)
    q = grouped_quantiles(df, label, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).checkpoint()
    few = q.count() <= CLASS_ROWS
    q = q.select(group_key(label).alias("_g"), "q1", "median", "q3")
    q = F.broadcast(q) if few else q
    j = df.select(label, group_key(label).alias("_g"), F.col(value).alias("_v")).join(q, "_g").drop("_g")
    iqr = F.col("q3") - F.col("q1")
    return j.groupBy(label, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= F.col("q1") - k * iqr, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= F.col("q3") + k * iqr, F.col("_v"))).alias("whisker_high"),
        F.count_if((F.col("_v") < F.col("q1") - k * iqr) | (F.col("_v") > F.col("q3") + k * iqr))
        .alias("n_outliers")).withColumn("iqr", F.col("q3") - F.col("q1"))


def top_counterparties(df: DataFrame, n: int = 10) -> DataFrame:
    """Top-n senders and receivers by transaction count (ties by address)."""
    s = (df.groupBy(F.col("from_addr").alias("address")).agg(F.count(F.lit(1)).alias("n_tx"))
         .orderBy(F.col("n_tx").desc(), "address").limit(n).withColumn("role", F.lit("sender")))
    r = (df.groupBy(F.col("to_addr").alias("address")).agg(F.count(F.lit(1)).alias("n_tx"))
         .orderBy(F.col("n_tx").desc(), "address").limit(n).withColumn("role", F.lit("receiver")))
    return s.unionByName(r)


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair (upper triangle, both
    orders emitted) in one aggregation pass, pairwise-complete rows."""
    cols = cols or numeric_columns(df)
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(F.col(_q(a)).cast("double"), F.col(_q(b)).cast("double")).alias(f"p{i}")
                   for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', p{i}" for i, (a, b) in enumerate(pairs))
    long = row.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, corr)")
    return long.unionByName(long.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr"))


def label_correlation(df: DataFrame, label: str, cols: list[str] | None = None) -> DataFrame:
    """Correlation of each feature with the label, ranked by |corr|."""
    cols = cols or [c for c in numeric_columns(df) if c != label]
    row = df.agg(*[F.corr(F.col(_q(c)).cast("double"), F.col(label).cast("double")).alias(f"c{i}")
                   for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    long = row.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, corr)")
    return long.withColumn("rank", F.row_number().over(
        Window.orderBy(F.abs(F.col("corr")).desc_nulls_last(), "feature")))


def summary_line(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Totals, fraud rate, unique senders / receivers, mean value, median gas."""
    base = df.agg(F.count(F.lit(1)).alias("n_tx"), F.sum(label).cast("bigint").alias("n_fraud"),
                  F.avg(label).alias("fraud_rate"),
                  F.count_distinct("from_addr").alias("unique_senders"),
                  F.count_distinct("to_addr").alias("unique_receivers"),
                  (F.sum(F.col("value_eth").cast("decimal(20,6)")).cast("double") / F.count("value_eth"))
                  .alias("mean_value"))
    med = exact_quantile_expr_table(df, [("median_gas_price", "gas_price", 0.5)])
    return base.crossJoin(med)


def pca_projection(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """Projection on the first ``k`` principal components (Spark ML PCA on
    standardised features)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep"),
        StandardScaler(inputCol="_x", outputCol="_xs", withMean=True, withStd=True),
        PCA(k=k, inputCol="_xs", outputCol="_pc")])
    model = pipe.fit(df)
    out = model.transform(df).withColumn("_a", vector_to_array("_pc"))
    return out.select("*", *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)]).drop(
        "_x", "_xs", "_pc", "_a")
