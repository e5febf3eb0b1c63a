"""Per-key sequence windows that do not put one key into one task.

A plain ``Window.partitionBy(sender)`` sends every row of a sender to one task;
a sender holding a third of all rows would stall the whole job. The helpers
here partition by ``(key, time bucket)`` instead:

* range frames (trailing counts, forward maxima) see rows of the neighbouring
  bucket through *context copies*: a row within ``back_us`` of the end of its
  bucket is also placed in the next bucket, a row within ``fwd_us`` of the start
  of its bucket also in the previous one. Only owned rows are kept afterwards;
* ``lag`` over the same partitions is exact for every row that has an earlier
  row in its bucket (or in the context copies); the first row of a bucket takes
  its predecessor from a small table with the last row of every
  ``(key, bucket)`` (one row per bucket, so even a hot key is a short series).

All frames must be no longer than the bucket (checked). Keys whose rows all fit into one
task (``cell_bound``) need none of this: their windows are partitioned by the key alone, one
exchange for lag, frames and totals; only ``busy_keys`` are bucketed.

A key may hold very many rows inside one bucket. ``adaptive_cells`` splits such
(key, bucket) cells by time, again and again, until none holds more than a bound
(or it is one instant); ``lag`` and running sums work on these cells as on buckets.
Frames do not fit into them, so for keys with a split cell ``trailing_counts``
and ``within`` answer frame questions from running sums, maxima and minima over
the key's distinct instants, without copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

DAY_US = 86_400_000_000
WEEK_US = 7 * DAY_US
#: Rows that a (key, bucket) cell may hold, whatever the number of tasks; parts into which a larger one is split.
MIN_CELL_ROWS = 50_000
FAN = 64
#: Rows of an exchange by key that a task should sort, on average: several sorts of a stage hold them at once.
TASK_ROWS = 400_000


def cell_bound(df: DataFrame, key: str) -> tuple[int, int]:
    """(rows that a cell may hold, rows of the largest key): half a task's share of all rows, MIN_CELL_ROWS at least."""
    r = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNotNull()) \
        .agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(MIN_CELL_ROWS, (r["total"] or 0) // (2 * tasks)), r["most"] or 0


def row_counts(df: DataFrame, key: str) -> tuple[int, int]:
    """(rows, rows without a key)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("none")).first()
    return r["n"], r["none"]


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (so many ``rows``) exchanged by ``keys``. If the session's partitions would each get more than TASK_ROWS rows,
    there are more of them, so that sorts fit into a task's memory whatever the table's size; spilled bytes do not grow with it."""
    tasks = -(-rows // TASK_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")):
        return df.repartition(tasks, *keys)
    return df.repartition(*keys)


def busy_keys(df: DataFrame, key: str, bound: int) -> DataFrame:
    """Keys with more than ``bound`` rows: fewer than rows / bound. All rows of any other key fit into one task."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > bound) & F.col(key).isNotNull()).select(key)


class Cells:
    """Time cells of the rows of ``df``: buckets, of which those with more than ``bound`` rows of one key are split into
    FAN parts of equal length, and these again. A level's split cells are fewer than rows / bound: they are broadcast."""

    def __init__(self, df: DataFrame, key: str, t: str, bound: int, bucket_us: int = WEEK_US, weight: str | None = None):
        self.key, self.bucket_us, self.levels = key, bucket_us, []
        checkpoint_dir(df.sparkSession)
        rows = df.select(key, F.col(t).alias("_ct"), (F.col(weight) if weight else F.lit(1)).alias("_cn"))
        cells = self._start(rows, "_ct")
        while True:
            heavy = cells.groupBy(key, "_cell", "_len").agg(F.sum("_cn").alias("n")) \
                .where((F.col("n") > bound) & (F.col("_len") > 1)).select(key, "_cell", "_len").checkpoint()
            if heavy.isEmpty():
                return
            self.levels.append(heavy)
            cells = self._split(cells.join(F.broadcast(heavy), [key, "_cell", "_len"], "left_semi"), "_ct")

    def _start(self, df: DataFrame, t: str) -> DataFrame:
        return df.withColumn("_cell", F.floor(F.col(t) / F.lit(self.bucket_us)) * F.lit(self.bucket_us)) \
            .withColumn("_len", F.lit(self.bucket_us).cast("bigint"))

    def _split(self, df: DataFrame, t: str) -> DataFrame:
        part = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_len") / FAN))
        return df.withColumn("_cell", F.col("_cell") + F.floor((F.col(t) - F.col("_cell")) / part) * part).withColumn("_len", part)

    def keys(self) -> DataFrame | None:
        """Keys with a split cell; None if there are none."""
        return self.levels[0].select(self.key).distinct() if self.levels else None

    def assign(self, df: DataFrame, t: str, out: str = "_cell") -> DataFrame:
        """Add the first instant of each row's cell. The instants need not be those the cells were made from."""
        d = self._start(df, t)
        for heavy in self.levels:
            d = d.join(F.broadcast(heavy.withColumn("_heavy", F.lit(1))), [self.key, "_cell", "_len"], "left")
            part = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_len") / FAN))
            inside = F.col("_cell") + F.floor((F.col(t) - F.col("_cell")) / part) * part
            d = d.withColumn("_cell", F.when(F.col("_heavy") == 1, inside).otherwise(F.col("_cell"))) \
                .withColumn("_len", F.when(F.col("_heavy") == 1, part).otherwise(F.col("_len"))).drop("_heavy")
        d = d.drop("_len")
        return d if out == "_cell" else d.withColumnRenamed("_cell", out)


def _carried(df: DataFrame, key: str, t: str, value: Column, how, out: str, forward: bool) -> DataFrame:
    """Add ``how`` (a sum, maximum or minimum) of ``value`` over the key's strictly earlier (``forward``: later) instants:
    inside the cell by a range frame, over the other cells by a frame over one row a cell."""
    side = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    d = df.withColumn("_v", value)
    inside = how("_v").over(Window.partitionBy(key, "_cell").orderBy(t).rangeBetween(*side))
    per = d.groupBy(key, "_cell").agg(how("_v").alias("_c"))
    per = per.withColumn("_o", how("_c").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(*side))).drop("_c")
    d = d.withColumn("_i", inside).join(per, [key, "_cell"], "left")
    both = {F.sum: lambda: F.coalesce("_i", F.lit(0)) + F.coalesce("_o", F.lit(0)), F.max: lambda: F.greatest("_i", "_o"),
            F.min: lambda: F.least("_i", "_o")}[how]()
    return d.withColumn(out, both).drop("_v", "_i", "_o")


def trailing_counts(df: DataFrame, key: str, t: str, windows: dict[str, int], bound: int) -> DataFrame:
    """(key, t, one count per window) for every distinct instant: rows in ``[t - w, t]``. The count up to an instant less
    the count before another one; the latter is asked by a row without weight at ``t - w``."""
    checkpoint_dir(df.sparkSession)
    times = df.groupBy(key, F.col(t).alias("_at")).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    asks = [times.select(key, F.col("_at").alias("_for"), F.lit(name).alias("_name"), (F.col("_at") - w).alias("_at"), F.lit(0).cast("bigint").alias("_n"))
            for name, w in windows.items()]
    points = times.select(key, F.col("_at").alias("_for"), F.lit(None).cast("string").alias("_name"), "_at", "_n")
    for a in asks:
        points = points.unionByName(a)
    cells = Cells(points, key, "_at", bound)
    counted = _carried(cells.assign(points, "_at"), key, "_at", F.col("_n"), F.sum, "_before", False)
    before = counted.where(F.col("_name").isNotNull()).groupBy(key, "_for").agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_before"))).alias(f"_w{i}") for i, name in enumerate(windows)])
    upto = counted.where(F.col("_name").isNull()).select(key, "_for", (F.col("_before") + F.col("_n")).alias("_upto"))
    got = upto.join(before, [key, "_for"])
    return got.select(key, F.col("_for").alias(t), *[(F.col("_upto") - F.col(f"_w{i}")).cast("bigint").alias(name) for i, name in enumerate(windows)])


def within(df: DataFrame, key: str, t: str, event: Column, window: int, then: Column, bound: int) -> DataFrame:
    """(key, t, _leads, _follows) for every distinct instant. ``_leads``: an ``event`` row of the key lies in ``(t, t + window]``;
    ``_follows``: a row with ``then`` that leads lies in ``[t - window, t)``. ``event`` and ``then`` are conditions on rows."""
    checkpoint_dir(df.sparkSession)
    times = df.groupBy(key, F.col(t).alias("_at")).agg(F.max(event.cast("int")).alias("_event"), F.max(then.cast("int")).alias("_then"),
                                                       F.count(F.lit(1)).alias("_n"))
    times = times.checkpoint()
    d = Cells(times, key, "_at", bound).assign(times, "_at")
    d = _carried(d, key, "_at", F.when(F.col("_event") == 1, F.col("_at")), F.min, "_next", True)
    d = d.withColumn("_leads", F.coalesce((F.col("_next") <= F.col("_at") + window).cast("int"), F.lit(0)))
    d = d.drop("_next").checkpoint()
    d = _carried(d, key, "_at", F.when((F.col("_leads") == 1) & (F.col("_then") == 1), F.col("_at")), F.max, "_last", False)
    return d.select(key, F.col("_at").alias(t), "_leads",
                    F.coalesce((F.col("_last") >= F.col("_at") - window).cast("int"), F.lit(0)).alias("_follows"))


@dataclass
class BucketedSequence:
    """Rows of ``df`` spread over (key, bucket) partitions with context copies.

    ``t`` is a bigint microsecond column; ``order`` the total order of a key's
    rows (it must start with the time column or an equivalent).
    """

    df: DataFrame                 # exploded: own rows + context copies, with _pb, _own
    base: DataFrame               # original rows with _b (bucket), for tails
    key: tuple[str, ...]
    t: str
    order: tuple[str, ...]
    bucket_us: int

    @classmethod
    def build(cls, df: DataFrame, key, t: str, order, bucket_us: int = WEEK_US,
              back_us: int = 0, fwd_us: int = 0) -> "BucketedSequence":
        if back_us > bucket_us or fwd_us > bucket_us:
            raise ValueError("frame longer than the time bucket; raise bucket_us")
        key = tuple([key] if isinstance(key, str) else key)
        order = tuple([order] if isinstance(order, str) else order)
        b = F.floor(F.col(t) / F.lit(bucket_us))
        base = df.withColumn("_b", b)
        start = F.col("_b") * F.lit(bucket_us)
        copies = [F.struct(F.col("_b").alias("pb"), F.lit(True).alias("own"))]
        if back_us > 0:
            copies.append(F.when(F.col(t) >= start + F.lit(bucket_us - back_us),
                                 F.struct((F.col("_b") + 1).alias("pb"), F.lit(False).alias("own"))))
        if fwd_us > 0:
            copies.append(F.when(F.col(t) < start + F.lit(fwd_us),
                                 F.struct((F.col("_b") - 1).alias("pb"), F.lit(False).alias("own"))))
        if len(copies) == 1:
            ex = base.withColumn("_pb", F.col("_b")).withColumn("_own", F.lit(True))
        else:
            ex = (base.withColumn("_c", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
                  .withColumn("_pb", F.col("_c.pb")).withColumn("_own", F.col("_c.own"))
                  .drop("_c"))
        return cls(ex, base, key, t, order, bucket_us)

    @classmethod
    def in_cells(cls, df: DataFrame, key: str, t: str, order, bound: int, most: int, bucket_us: int = WEEK_US) -> "BucketedSequence":
        """Sequences without frames (lag, running sums): rows over buckets, heavy cells split (``cell_bound``)."""
        order = tuple([order] if isinstance(order, str) else order)
        if most > bound:
            base = Cells(df, key, t, bound, bucket_us).assign(df, t, "_b")
        else:
            base = df.withColumn("_b", F.floor(F.col(t) / F.lit(bucket_us)))
        return cls(base.withColumn("_pb", F.col("_b")).withColumn("_own", F.lit(True)), base, (key,), t, order, bucket_us)

    # window specs over the bucketed partitions
    def rows(self) -> Window:
        return Window.partitionBy(*self.key, "_pb").orderBy(*self.order)

    def range(self, lo: int, hi: int) -> Window:
        return Window.partitionBy(*self.key, "_pb").orderBy(self.t).rangeBetween(lo, hi)

    def with_columns(self, cols: dict[str, Column]) -> "BucketedSequence":
        d = self.df
        for k, v in cols.items():
            d = d.withColumn(k, v)
        return BucketedSequence(d, self.base, self.key, self.t, self.order, self.bucket_us)

    def lag_columns(self, cols: list[str], prefix: str = "prev_") -> "BucketedSequence":
        """Add ``prev_<c>``: value of ``c`` on the key's previous row in ``order``."""
        w = self.rows()
        d = self.df.withColumn("_first", F.lag(F.lit(1)).over(w).isNull())
        for c in cols:
            d = d.withColumn(prefix + c, F.lag(c).over(w))
        ob = F.struct(*[F.col(c) for c in self.order])
        tails = (self.base.groupBy(*self.key, "_b")
                 .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), ob).alias("_last")))
        tails = tails.withColumn(
            "_tail", F.lag("_last").over(Window.partitionBy(*self.key).orderBy("_b")))
        tails = tails.select(*self.key, F.col("_b").alias("_pb"), "_tail")
        d = d.join(tails, [*self.key, "_pb"], "left")
        for c in cols:
            d = d.withColumn(prefix + c, F.when(F.col("_first"), F.col(f"_tail.{c}"))
                             .otherwise(F.col(prefix + c)))
        d = d.drop("_first", "_tail")
        return BucketedSequence(d, self.base, self.key, self.t, self.order, self.bucket_us)

    def prefix_sums(self, exprs: dict[str, Column], inclusive: bool = False) -> "BucketedSequence":
        """Add running sums of ``exprs`` over the key's earlier rows in ``order``
        (``inclusive``: also the row itself). Distributed prefix sum: per
        (key, bucket) totals, an exclusive prefix over buckets (a short series
        per key), plus the running sum inside the bucket partition."""
        hi = 0 if inclusive else -1
        w = self.rows().rowsBetween(Window.unboundedPreceding, hi)
        d = self.df
        for name, e in exprs.items():
            d = d.withColumn("_in_" + name,
                             F.coalesce(F.sum(F.when(F.col("_own"), e)).over(w), F.lit(0)))
        tot = self.base.groupBy(*self.key, "_b").agg(
            *[F.sum(e).alias("_tot_" + n) for n, e in exprs.items()])
        pw = Window.partitionBy(*self.key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        tot = tot.select(*self.key, F.col("_b").alias("_pb"),
                         *[F.coalesce(F.sum("_tot_" + n).over(pw), F.lit(0)).alias("_pre_" + n)
                           for n in exprs])
        d = d.join(tot, [*self.key, "_pb"], "left")
        for n in exprs:
            d = d.withColumn(n, F.col("_pre_" + n) + F.col("_in_" + n)).drop("_pre_" + n, "_in_" + n)
        return BucketedSequence(d, self.base, self.key, self.t, self.order, self.bucket_us)

    def owned(self) -> DataFrame:
        """Own rows only, helper columns dropped."""
        return self.df.where(F.col("_own")).drop("_own", "_pb", "_b")
