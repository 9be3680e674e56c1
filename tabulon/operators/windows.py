"""Analytic window functions, ranking and set operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.ranks import running


def latest_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row a key, the one with the greatest ``order`` values: a maximum of structs, so one row a key and task is shuffled."""
    best = F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*df.columns).alias("_row")))
    return df.groupBy(*keys).agg(best.alias("_b")).select("_b._row.*")


def top_n_per(df: DataFrame, keys: Sequence[str], by: str, n: int, tie: str, dense: bool = False) -> DataFrame:
    """The first ``n`` of each group; with ``dense``, all that share the first ``n`` values."""
    order = [F.desc(by)] if dense else [F.desc(by), tie]
    rank = (F.dense_rank() if dense else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def _with_group(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``df`` with aggregates of each row's group, nulls among the keys equal; partial sums and a join, so that no task holds a group."""
    names = {k: f"_g{i}" for i, k in enumerate(keys)}
    groups = df.groupBy(*[F.col(k).alias(g) for k, g in names.items()]).agg(*aggregates)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(g)) for k, g in names.items()])
    return df.join(groups, same).drop(*names.values())


def share_within(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return _with_group(df, keys, F.sum(value).alias("_sum")).withColumn("share", F.try_divide(F.col(value), F.col("_sum"))).drop("_sum")


def rank_by(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Rank within a selection, greatest first, with gaps after ties."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(by))))


def pareto(df: DataFrame, key: str, value: str, cut: float = 0.8) -> DataFrame:
    """Rank with gaps, cumulative share (ties together) and whether a key is within the first ``cut`` of the total."""
    by = df.groupBy(key).agg(F.sum(value).alias("value"))
    levels = by.groupBy((-F.col("value")).alias("_v")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    placed = running(levels, "_v", "n", "s").select((-F.col("_v")).alias("value"), (F.col("before_n") + 1).cast("int").alias("rank"), ((F.col("before_s") + F.col("s")) / F.col("all_s")).alias("share"))
    return by.join(placed, "value").select(key, F.col("value").cast("double"), "rank", F.col("share").cast("double").alias("cumulative"), (F.col("share") <= cut).alias("within"))


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, min_periods: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn("rolling", F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w)))


def trailing_day_avg(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(1 - days, 0)
    return df.withColumn("trailing", F.avg(value).over(w))


def year_over_year(daily: DataFrame, day: str, value: str) -> DataFrame:
    """A day's value with the one twelve months before."""
    before = daily.select(F.add_months(day, 12).alias(day), F.col(value).alias("before")).groupBy(day).agg(F.max("before").alias("before"))
    return daily.join(before, day, "left").withColumn("yoy", F.try_divide(F.col(value) - F.col("before"), F.col("before")))


def flag_ties(df: DataFrame, keys: Sequence[str], ranked: str | None = None) -> DataFrame:
    """Whether other rows have the same keys; rows without a value of ``ranked`` are no ties."""
    tied = F.col("_n") > 1
    if ranked is not None:
        tied &= F.col(ranked).isNotNull()
    return _with_group(df, keys, F.count("*").alias("_n")).withColumn("tied", tied).drop("_n")


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, value: str, max_lag: int) -> DataFrame:
    """r[j] = sum of x[k] x[k + j] per series."""
    w = Window.partitionBy(*keys).orderBy(order)
    terms = df.select(*keys, *[(F.col(value) * F.lead(value, j).over(w)).alias(f"t{j}") for j in range(max_lag + 1)])
    sums = terms.groupBy(*keys).agg(*[F.sum(f"t{j}").alias(f"t{j}") for j in range(max_lag + 1)])
    return sums.select(*keys, F.expr(f"stack({max_lag + 1}, {', '.join(f'{j}, t{j}' for j in range(max_lag + 1))}) as (lag, r)"))


def pct_change(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("change_pct", F.try_divide((F.col(value) - before) * 100.0, before))


def sort_by(df: DataFrame, *order: str | Column) -> DataFrame:
    """Sorted by several keys; each is a column, or a name, with ``-`` in front for descending."""
    return df.orderBy(*[F.desc(o[1:]) if isinstance(o, str) and o.startswith("-") else o for o in order])


def top_k(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def missing_values(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.select(F.col(child_key).alias("value")).where("value is not null").distinct().join(parent.select(F.col(parent_key).alias("value")), "value", "left_anti")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are in both, in the first alone, in the second alone."""
    one, two = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    both = one.join(two, key, "full")
    return both.agg(F.count_if(F.expr("a is not null and b is not null")).alias("both"), F.count_if(F.expr("b is null")).alias("only_a"), F.count_if(F.expr("a is null")).alias("only_b"))


def mask_outside(flag: Column, value: Column) -> Column:
    return F.when(flag, value)
