"""Column expressions shared by the operators. Division by zero and undefined values are NULL, never NaN."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def zscore(x: Column, over: Window | None = None) -> Column:
    """(x - mean) / sample deviation; NULL for constants."""
    over = over or Window.partitionBy()
    return ratio(x - F.avg(x).over(over), F.stddev_samp(x).over(over))


def clamp_low(x: Column, least: float) -> Column:
    """max(x, least), NULL for NULL (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(least))))


def as_number(x: Column) -> Column:
    """Numbers in text as doubles; anything else NULL."""
    return x.try_cast("double")


def maf_weight(maf: Column, alpha: float = -0.25) -> Column:
    """(maf (1 - maf)) ** (1 + alpha), before normalisation to a sum of one."""
    return F.pow(maf * (1 - maf), F.lit(1.0 + alpha))


def chi_squared_1_tail(x: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom. Neither SQL dialect has erfc, so this is an Arrow UDF over the
    result rows of a regression, not over genotypes."""

    @F.pandas_udf(T.DoubleType())
    def erfc(v: pd.Series) -> pd.Series:
        return v.map(lambda z: None if z is None or z != z else math.erfc(z))

    return erfc(F.sqrt(x / 2))


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None, int]]:
    """Mean, sample deviation and count of several columns in one aggregate."""
    row = df.agg(*[f(c).alias(f"{k}{n}") for n, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))]).first()
    return {c: (row[f"m{n}"], row[f"s{n}"], row[f"n{n}"]) for n, c in enumerate(columns)}
