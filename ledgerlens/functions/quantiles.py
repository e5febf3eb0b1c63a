"""Exact, distributed quantiles with linear interpolation.

``percentile`` in Spark is exact but keeps every distinct value of the column in
one aggregation buffer, which does not survive a continuous column at scale.
Here the exact answer is found lazily, inside one Spark plan, for any number
of (column, probability) specs at once:

1. the columns are stacked into a long ``(cname, v)`` table and reduced to a
   frequency table ``(cname, v, c)`` (partial aggregation: a value held by a
   third of all rows is still one row);
2. per spec, a narrow value band around the target rank from an approximate
   quantile sketch, verified by counting: rows below the band must be at most
   ``k`` and the band must reach rank ``k + 1``; when the check fails (small
   inputs, where the sketch rounds) the band is the whole value range;
3. ranks inside the band by a distributed prefix sum: equal-width sub-buckets
   of the band, one offset per sub-bucket from a table of at most
   ``specs x (buckets + 2)`` rows, then a running sum inside each sub-bucket.

Linear rule: position ``p = (n - 1) q``; ``v[floor p] + (p - floor p) *
(v[floor p + 1] - v[floor p])`` (the same as DuckDB ``quantile_cont``,
numpy ``percentile`` and pandas ``quantile``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .ranking import bucket_count

DEFAULT_ACCURACY = 100_000
DEFAULT_BUCKETS = 1024


def exact_quantile_expr_table(df: DataFrame, specs: list[tuple[str, str, float]],
                              accuracy: int = DEFAULT_ACCURACY,
                              buckets: int | None = None,
                              by: list[str] | None = None) -> DataFrame:
    """``specs`` = [(out_name, column, q), ...] -> one row with one double column
    per spec (null on empty input). With ``by``: one row per group instead."""
    by = list(by or [])
    spark = df.sparkSession
    buckets = buckets or max(DEFAULT_BUCKETS, bucket_count(spark))
    cnames = list(dict.fromkeys(c for _, c, _ in specs))
    delta = 3.0 / accuracy
    probs: list[float] = []
    for _, _, q in specs:
        probs += [max(0.0, q - delta), min(1.0, q + delta)]
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("cname"), F.col(c).cast("double").alias("v")) for c in cnames
    ])).alias("_x")).select(*by, "_x.cname", "_x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    freq = long.groupBy(*by, "cname", "v").agg(F.count(F.lit(1)).alias("c"))
    st = long.groupBy(*by, "cname").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"),
        F.percentile_approx("v", probs, accuracy).alias("approx"))
    spec_rows = [(i, name, c, float(q)) for i, (name, c, q) in enumerate(specs)]
    spec_df = spark.createDataFrame(spec_rows, "sid int, name string, cname string, q double")
    sp = (st.join(F.broadcast(spec_df), "cname")
          .withColumn("pos", (F.col("n") - 1).cast("double") * F.col("q"))
          .withColumn("k", F.floor("pos").cast("bigint"))
          .withColumn("k1", F.least(F.col("k") + 1, F.col("n") - 1))
          .withColumn("frac", F.col("pos") - F.col("k"))
          .withColumn("alo", F.element_at("approx", 2 * F.col("sid") + 1))
          .withColumn("ahi", F.element_at("approx", 2 * F.col("sid") + 2))
          .drop("approx"))
    keys = [*by, "cname"]
    chk = (freq.join(F.broadcast(sp.select(*keys, "sid", "alo", "ahi")), keys)
           .groupBy(*by, "sid").agg(
               F.sum(F.when(F.col("v") < F.col("alo"), F.col("c")).otherwise(0)).alias("below"),
               F.sum(F.when(F.col("v").between(F.col("alo"), F.col("ahi")), F.col("c"))
                     .otherwise(0)).alias("within")))
    ok = (F.col("below") <= F.col("k")) & (F.col("below") + F.col("within") >= F.col("k1") + 1)
    eff = sp.join(chk, [*by, "sid"]).select(
        *keys, "sid", "name", "n", "k", "k1", "frac",
        F.when(ok, F.col("alo")).otherwise(F.col("vmin")).alias("lo"),
        F.when(ok, F.col("ahi")).otherwise(F.col("vmax")).alias("hi"),
        F.when(ok, F.col("below")).otherwise(F.lit(0)).alias("base"))
    band = (freq.join(F.broadcast(eff.select(*keys, "sid", "lo", "hi")), keys)
            .where(F.col("v").between(F.col("lo"), F.col("hi")))
            .withColumn("bk", F.coalesce(
                F.when(F.col("hi") > F.col("lo"),
                       F.width_bucket(F.col("v"), F.col("lo"), F.col("hi"), F.lit(buckets))),
                F.lit(0).cast("bigint")))
            .select(*by, "sid", "bk", "v", "c"))
    # at most (buckets + 2) rows per spec and group
    per_bk = band.groupBy(*by, "sid", "bk").agg(F.sum("c").alias("bc"))
    per_bk = per_bk.withColumn("off", F.sum("bc").over(
        Window.partitionBy(*by, "sid").orderBy("bk").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("bc")).drop("bc")
    wb = Window.partitionBy(*by, "sid", "bk").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (band.join(per_bk, [*by, "sid", "bk"])
              .withColumn("cum", F.col("off") + F.sum("c").over(wb))
              .select(*by, "sid", "v", (F.col("cum") - F.col("c")).alias("r_lo"),
                      (F.col("cum") - 1).alias("r_hi")))
    ranked = ranked.join(F.broadcast(eff.select(*by, "sid", "base", "k", "k1")), [*by, "sid"])
    r_lo = F.col("r_lo") + F.col("base")
    r_hi = F.col("r_hi") + F.col("base")
    picked = ranked.groupBy(*by, "sid").agg(
        F.max(F.when((r_lo <= F.col("k")) & (F.col("k") <= r_hi), F.col("v"))).alias("vk"),
        F.max(F.when((r_lo <= F.col("k1")) & (F.col("k1") <= r_hi), F.col("v"))).alias("vk1"))
    res = (eff.select(*by, "sid", "name", "frac").join(picked, [*by, "sid"])
           .select(*by, "name", (F.col("vk") + F.col("frac") * (F.col("vk1") - F.col("vk"))).alias("val")))
    wide = res.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("val"))).alias(name)
                                  for name, _, _ in specs])
    if by:
        return wide
    # keep one row (with nulls) even when the input is empty
    one = spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n, _, _ in specs])
    return wide.unionByName(one).agg(*[F.max(n).alias(n) for n, _, _ in specs])


#: Rows of a group whose quantiles are taken from one aggregation buffer.
BUFFER_ROWS = 100_000


def group_key(col: str):
    """A group's key as a string that is never null (a null group is a group)."""
    c = F.col(f"`{col}`")
    return F.concat(F.when(c.isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(c.cast("string"), F.lit("")))


def grouped_quantiles(df: DataFrame, by: str, col: str, probs: dict[str, float], bound: int | None = None,
                      count: str | None = None) -> DataFrame:
    """One row per group with exact linear quantiles of ``col`` (NaN and null left out; null without values): ``by`` and
    one column per entry of ``probs``, with ``count`` also the group's rows. A null group is a group.

    Groups of at most ``bound`` rows take one buffer each. The larger ones - fewer than rows / bound, so their
    table is broadcast - go on together by ranks inside value bands (``exact_quantile_expr_table``), where no group
    is held by one task."""
    bound = BUFFER_ROWS if bound is None else bound
    v = F.nanvl(F.col(f"`{col}`").cast("double"), F.lit(None).cast("double"))
    d = df.select(F.col(f"`{by}`").alias(by), group_key(by).alias("_g"), v.alias("_v"))

    def buffered(rows: DataFrame) -> DataFrame:
        n = [F.count(F.lit(1)).alias(count)] if count else []
        return rows.groupBy(by).agg(*[F.percentile("_v", q).alias(name) for name, q in probs.items()], *n)

    sizes = d.groupBy("_g").agg(F.first(by).alias(by), F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= bound:
        return buffered(d)
    checkpoint_dir(df.sparkSession)
    big = sizes.where(F.col("_n") > bound).select("_g", by, F.col("_n").alias(count or "_n")).checkpoint()
    side = F.broadcast(big.select("_g"))
    got = exact_quantile_expr_table(d.join(side, "_g", "left_semi").select("_g", "_v"),
                                    [(name, "_v", q) for name, q in probs.items()], by=["_g"])
    got = big.join(got, "_g", "left").select(by, *probs, *([count] if count else []))
    return buffered(d.join(side, "_g", "left_anti")).unionByName(got)


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float], **kw) -> DataFrame:
    """One-row DataFrame, one double column per entry of ``probs``."""
    return exact_quantile_expr_table(df, [(n, col, q) for n, q in probs.items()], **kw)


def _long(df: DataFrame, cnames: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("cname"), F.col(c).cast("double").alias("v")) for c in cnames
    ])).alias("_x")).select("_x.cname", "_x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))


def quantile_values(df: DataFrame, specs: list[tuple[str, str, float]],
                    accuracy: int = DEFAULT_ACCURACY, buckets: int | None = None) -> dict:
    """Eager form: exact linear quantiles as ``{name: float | None}``.

    Three small jobs, whatever the size and the number of specs: (1) per column ``n``, min,
    max and an approximate sketch; (2) counts below / inside each candidate
    band, which proves the band holds the target ranks (else the band is the
    whole value range); (3) ranks inside the bands by a distributed prefix sum
    over equal-width sub-buckets. Only a handful of rows reach the driver.
    Operators use the results as literals, which keeps their plans small.
    """
    if not specs:
        return {}
    buckets = buckets or max(DEFAULT_BUCKETS, bucket_count(df.sparkSession))
    cnames = list(dict.fromkeys(c for _, c, _ in specs))
    delta = 3.0 / accuracy
    probs: list[float] = []
    for _, _, q in specs:
        probs += [max(0.0, q - delta), min(1.0, q + delta)]
    long = _long(df, cnames)
    st = {r["cname"]: r for r in long.groupBy("cname").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"),
        F.percentile_approx("v", probs, accuracy).alias("approx")).collect()}
    approx = {c: r["approx"] for c, r in st.items()}
    info = {}
    for i, (name, c, q) in enumerate(specs):
        r = st.get(c)
        if r is None or r["n"] == 0:
            continue
        n = r["n"]
        pos = (n - 1) * float(q)
        k = int(pos // 1)
        lo, hi = r["vmin"], r["vmax"]
        if c in approx:
            lo, hi = approx[c][2 * i], approx[c][2 * i + 1]
        info[i] = dict(name=name, c=c, n=n, k=k, k1=min(k + 1, n - 1), frac=pos - k,
                       lo=lo, hi=hi, vmin=r["vmin"], vmax=r["vmax"], base=0)
    if info:
        check = {i: d for i, d in info.items() if d["c"] in approx}
        if check:
            row = long.agg(*[F.count_if((F.col("cname") == d["c"]) & (F.col("v") < d["lo"]))
                             .alias(f"b{i}") for i, d in check.items()],
                           *[F.count_if((F.col("cname") == d["c"])
                                        & F.col("v").between(d["lo"], d["hi"])).alias(f"w{i}")
                             for i, d in check.items()]).collect()[0]
            for i, d in check.items():
                below, within = row[f"b{i}"], row[f"w{i}"]
                if below <= d["k"] and below + within >= d["k1"] + 1:
                    d["base"] = below
                else:  # the sketch missed: rank over the whole range
                    d["lo"], d["hi"], d["base"] = d["vmin"], d["vmax"], 0
        picks = _band_ranks(long, info, buckets)
        for i, d in info.items():
            vk, vk1 = picks.get((i, "k")), picks.get((i, "k1"))
            d["val"] = None if vk is None or vk1 is None else vk + d["frac"] * (vk1 - vk)
    return {name: (info[i]["val"] if i in info else None) for i, (name, _, _) in enumerate(specs)}


def _band_ranks(long: DataFrame, info: dict, buckets: int) -> dict:
    """Values at ranks k and k1 of every spec. Specs of one column whose band is
    the same share one ranking (bands are keyed by column and bounds)."""
    bands: dict = {}
    for i, d in info.items():
        bands.setdefault((d["c"], d["lo"], d["hi"], d["base"]), []).append(i)
    bid_of = {b: n for n, b in enumerate(bands)}
    bid = F.explode(F.array(*[
        F.when((F.col("cname") == c) & F.col("v").between(lo, hi), F.lit(bid_of[(c, lo, hi, base)]))
        for (c, lo, hi, base) in bands])).alias("bid")
    band = long.select(bid, "v").where(F.col("bid").isNotNull())
    freq = band.groupBy("bid", "v").agg(F.count(F.lit(1)).alias("c"))

    def per_band(fn):
        e = None
        for b, n in bid_of.items():
            e = F.when(F.col("bid") == n, F.lit(fn(b))) if e is None else e.when(F.col("bid") == n, F.lit(fn(b)))
        return e
    lo, hi = per_band(lambda b: b[1]).cast("double"), per_band(lambda b: b[2]).cast("double")
    freq = freq.withColumn("bk", F.coalesce(
        F.when(hi > lo, F.width_bucket(F.col("v"), lo, hi, F.lit(buckets))), F.lit(0).cast("bigint")))
    per_bk = freq.groupBy("bid", "bk").agg(F.sum("c").alias("bc"))
    # at most (buckets + 2) rows per band: the offset window is bounded
    per_bk = per_bk.select("bid", "bk", (F.sum("bc").over(
        Window.partitionBy("bid").orderBy("bk").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("bc")).alias("off"))
    wb = Window.partitionBy("bid", "bk").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (freq.join(F.broadcast(per_bk), ["bid", "bk"])
              .withColumn("cum", per_band(lambda b: b[3]) + F.col("off") + F.sum("c").over(wb))
              .withColumn("r_lo", F.col("cum") - F.col("c"))
              .withColumn("r_hi", F.col("cum") - 1))
    wanted = None
    for b, n in bid_of.items():
        for i in bands[b]:
            for k in {info[i]["k"], info[i]["k1"]}:
                cond = (F.col("bid") == n) & (F.col("r_lo") <= k) & (F.col("r_hi") >= k)
                wanted = cond if wanted is None else (wanted | cond)
    rows = ranked.where(wanted).select("bid", "v", "r_lo", "r_hi").collect()
    out = {}
    for b, n in bid_of.items():
        got = [(r["r_lo"], r["r_hi"], r["v"]) for r in rows if r["bid"] == n]
        for i in bands[b]:
            for which in ("k", "k1"):
                k = info[i][which]
                for r_lo, r_hi, v in got:
                    if r_lo <= k <= r_hi:
                        out[(i, which)] = v
    return out


def small_domain_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Exact linear quantile of a column with few distinct values (scores,
    labels): the value histogram is aggregated in Spark and only its rows (one
    per distinct value) reach the driver."""
    hist = sorted((r[0], r[1]) for r in df.where(F.col(col).isNotNull())
                  .groupBy(col).count().collect())
    n = sum(c for _, c in hist)
    if n == 0:
        return None
    pos = (n - 1) * q
    k = int(pos // 1)
    k1 = min(k + 1, n - 1)
    frac = pos - k

    def at(idx):
        acc = 0
        for v, c in hist:
            acc += c
            if idx < acc:
                return float(v)
        return float(hist[-1][0])
    vk, vk1 = at(k), at(k1)
    return vk + frac * (vk1 - vk)
