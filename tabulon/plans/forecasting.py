"""Seasonal-naive forecasts and their backtest, for any number of series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seasonal_naive(df: DataFrame, keys: Sequence[str], month: str, value: str, steps: int) -> DataFrame:
    """The mean of the same month of the year, for the ``steps`` months after a series' last one."""
    last = df.groupBy(*keys).agg(F.max(month).alias("_last"))
    future = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_k"), "_last").select(*keys, F.add_months("_last", F.col("_k")).alias(month))
    means = df.groupBy(*keys, F.month(month).alias("_m")).agg(F.avg(value).alias("forecast"))
    return future.withColumn("_m", F.month(month)).join(means, [*keys, "_m"]).select(*keys, month, "forecast")


def one_step(df: DataFrame, keys: Sequence[str], month: str, value: str) -> DataFrame:
    """Each value with that of twelve rows before, or of the row before where there is none."""
    w = Window.partitionBy(*keys).orderBy(month)
    return df.select(*keys, month, value, F.coalesce(F.lag(value, 12).over(w), F.lag(value).over(w)).alias("forecast"))


def backtest(df: DataFrame, keys: Sequence[str], month: str, value: str, folds: int) -> DataFrame:
    """Mean absolute error and bias of the last ``folds`` one-step forecasts of each series."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(month)))
    out = one_step(df, keys, month, value).withColumn("_rn", newest).where((F.col("_rn") <= folds) & F.col("forecast").isNotNull())
    return out.groupBy(*keys).agg(F.avg(F.abs(F.col("forecast") - F.col(value))).alias("mae"), F.avg(F.col("forecast") - F.col(value)).alias("bias"), F.count("*").alias("folds"))


def weekday_forecast(daily: DataFrame, keys: Sequence[str], day: str, value: str, steps: int = 30, history: int = 56) -> DataFrame:
    """For the ``steps`` days after a series' last one, the mean of the same weekday in its last ``history`` days."""
    last = daily.groupBy(*keys).agg(F.max(day).alias("_last"))
    recent = daily.join(last, list(keys)) if keys else daily.crossJoin(F.broadcast(last))  # one row without keys
    means = recent.where(F.datediff("_last", day) < history).groupBy(*keys, F.dayofweek(day).alias("_w")).agg(F.avg(value).alias("forecast"))
    future = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_k"), "_last").select(*keys, F.date_add("_last", F.col("_k")).alias(day))
    return future.withColumn("_w", F.dayofweek(day)).join(means, [*keys, "_w"]).select(*keys, day, "forecast")
