"""Null, NaN and rounding rules: NaN is turned into null on the way in, and three-valued logic does the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countflow.functions.common import col


def finite(c: str | Column) -> Column:
    """The value as a double; null for NaN and infinities."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def clean(df: DataFrame) -> DataFrame:
    """Every floating column of df with NaN and infinities as null."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: finite(c) for c in real}) if real else df


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def strict_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b with 0 / 0 as 0 and anything else over 0 as null."""
    x, y = col(a).cast("double"), col(b).cast("double")
    return F.when((x == 0) & (y == 0), 0.0).otherwise(F.try_divide(x, y))


def larger(a: str | Column, b: str | Column) -> Column:
    """The larger value; null if either is null."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.greatest(col(a), col(b)))


def half_even(c: str | Column) -> Column:
    return F.bround(col(c), 0)
