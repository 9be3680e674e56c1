"""Mergeable sketches of a day, kept as a table, and longer periods from them: the detail is read once.

Distinct counts are HyperLogLog sketches (12 bits: a relative standard error of 1.6 %), quantiles KLL sketches of 2,000 (a rank error of about 0.2 %). Both
merge without further error, and partial ones are merged before a shuffle. A day that is written again replaces what it had.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.snapshots import merge, read_snapshot, replace_keys

HLL_BITS, KLL_SIZE = 12, 2000


def daily_sketches(df: DataFrame, time: str, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """(day, keys, n, distinct_sketch, value_sketch)."""
    sketches = [F.hll_sketch_agg(distinct, HLL_BITS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("value_sketch")]
    return df.groupBy(F.to_date(time).alias("day"), *keys).agg(F.count("*").alias("n"), *sketches)


def write_sketches(sketches: DataFrame, root: str, buckets: int = 16) -> int:
    """Publish days of sketches; all rows of a day that was there before go."""
    return merge(sketches, root, replace_keys(["day"]), ["day"], buckets)


def read_sketches(spark: SparkSession, root: str, first: str, last: str) -> DataFrame:
    return read_snapshot(spark, root).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def roll_up(sketches: DataFrame, period: Column, keys: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """(period, keys, n, distinct, and the named quantiles) of merged days."""
    merged = sketches.groupBy(period.alias("period"), *keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("value_sketch").alias("v"))
    values = [F.kll_sketch_get_quantile_double("v", F.lit(q)).alias(name) for name, q in quantiles.items()]
    return merged.select("period", *keys, "n", F.hll_sketch_estimate("d").alias("distinct"), *values)
