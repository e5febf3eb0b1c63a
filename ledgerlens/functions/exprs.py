"""Small column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """Division that yields null instead of raising (ANSI mode) on a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite_or_zero(c) -> Column:
    """null, NaN and +-inf -> 0.0 (the matrix cleaning rule)."""
    x = col(c).cast("double")
    return (F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0))
            .otherwise(x))


def nan_to_null(c) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def flag(cond: Column) -> Column:
    """Boolean -> int 0/1 with null as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def half_up(c, places: int = 6) -> Column:
    """Round half up by explicit arithmetic, ``floor(x * 10^p + 0.5) / 10^p``.

    Used on query outputs: unlike ``round`` (which rounds the exact binary value)
    this expression gives bit-identical results in any engine that evaluates
    IEEE doubles, so results compare across engines even on exact halves.
    Magnitudes of 1e12 and above are returned unchanged (no fractional digits
    left to round at double precision)."""
    x = col(c).cast("double")
    m = float(10 ** places)
    return F.when(F.abs(x) < F.lit(1e12), F.floor(x * F.lit(m) + F.lit(0.5)) / F.lit(m)).otherwise(x)


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double/float column (used by the registered queries so the
    value hash does not depend on the last bits of a sum's evaluation order)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(half_up(f.name, places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
