"""Exact quantiles of groups and windows against plain Python, where Spark's bounded summaries differ."""

import math
import random

from pyspark.sql import functions as F

from tabulon.operators import aggregates as A
from tabulon.operators import ranks


def at(values, p):
    values = sorted(v for v in values if v is not None)
    return values[max(math.ceil(p * len(values)), 1) - 1] if values else None


def test_quartiles_are_exact_in_large_groups(spark):
    df = spark.range(90_000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 90_001).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 2.0), (5, None)], "g long, v double"))
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.v)
    got = {r.g: (r.q1, r.median, r.q3) for r in A.quartiles(df, ["g"], "v").collect()}
    assert got == {g: tuple(at(v, p) for p in (0.25, 0.5, 0.75)) for g, v in groups.items()}


def test_quantiles_of_windows(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), rng.randint(0, 40), rng.choice([None, 1.0, 2.0, rng.random() * 9])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    asked = {"low": 0.1, "half": 0.5, "top": 1.0}
    found = ranks.grouped_quantiles(df, ["g"], "v", asked, F.col("t"), [F.lit(k) for k in range(3)]).collect()
    want = {}
    for g, t, v in rows:
        for k in range(3):
            want.setdefault((g, t - k), []).append(v)
    assert {(r.g, r.window_start): (r.low, r.half, r.top) for r in found} == {k: tuple(at(v, p) for p in asked.values()) for k, v in want.items()}
