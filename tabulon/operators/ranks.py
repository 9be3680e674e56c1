"""Global ranks, running totals and exact quantiles without a task that holds all rows.

Values are first counted (equal ones are one row), then dealt into ranges between approximate quantiles. Ranges are ranked
each on its own, and start where the ranges below them end: the sums of at most ``RANGES`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import cut

RANGES = 200


def _ranges(values: DataFrame, column: str, source: DataFrame | None = None) -> DataFrame:
    """``values`` with ``_range``: ascending ranges of about as many rows each, of ``source`` if that has the same column."""
    ends = (source or values).agg(F.percentile_approx(F.col(column).cast("double"), [k / RANGES for k in range(1, RANGES)]).alias("_ends"))
    below = F.size(F.filter("_ends", lambda e: e < F.col(column).cast("double")))
    return values.join(F.broadcast(ends)).withColumn("_range", F.coalesce(below, F.lit(0))).drop("_ends")  # one row


def running(values: DataFrame, column: str, *sums: str) -> DataFrame:
    """``values`` (distinct ``column``, numeric) with ``before_<s>`` and ``all_<s>`` of each of ``sums``: the totals of smaller values and of all."""
    dealt = _ranges(values, column)
    totals = dealt.groupBy("_range").agg(*[F.sum(s).alias(s) for s in sums])
    order = Window.orderBy("_range")  # at most RANGES rows
    starts = totals.select("_range", *[(F.sum(s).over(order) - F.col(s)).alias(f"_start_{s}") for s in sums], *[F.sum(s).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"all_{s}") for s in sums])
    own = Window.partitionBy("_range").orderBy(column)
    inside = dealt.select("*", *[(F.sum(s).over(own) - F.col(s)).alias(f"_in_{s}") for s in sums])
    out = inside.join(F.broadcast(starts), "_range")
    return out.select(*values.columns, *[(F.col(f"_start_{s}") + F.col(f"_in_{s}")).alias(f"before_{s}") for s in sums], *[f"all_{s}" for s in sums])


def quantiles(df: DataFrame, column: str, asked: Mapping[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles by name; nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = running(counts, "v", "n")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col("v")))

    out = {}
    for name, p in asked.items():
        exact = F.lit(p) * (F.col("all_n") - 1)
        low, high = at(F.floor(exact)), at(F.ceil(exact))
        out[name] = low + (high - low) * F.max(exact - F.floor(exact))
    return placed.agg(*[c.alias(n) for n, c in out.items()])


def grouped_quantiles(df: DataFrame, keys: Sequence[Column | str], value: str, asked: Mapping[str, float], pane: Column | None = None, steps: Sequence[Column] = ()) -> DataFrame:
    """(keys, and each of ``asked``) of every group: the least value that at least this share of the group's values doesn't exceed; nulls don't count.

    With ``pane`` the groups are windows as well, named ``window_start``: a row is in those that begin at its pane and one of ``steps`` before it. Equal values of a
    pane are counted and dealt into ranges. Counts of ranges add up to those of windows and tell in which range a quantile lies; only rows of this range
    are ranked. So no row is repeated for its windows, and no task holds a group.
    """
    rows = df.select(F.struct(*keys).alias("_g"), (F.lit(0) if pane is None else pane).alias("_pane"), F.col(value).alias("_v"))
    steps = list(steps) or [F.lit(0)]
    counts = rows.groupBy("_g", "_pane", "_v").agg(F.count("_v").alias("_n"))
    dealt = cut(_ranges(counts, "_v", rows))
    cells = dealt.groupBy("_g", "_pane", "_range").agg(F.sum("_n").alias("_n")).repartition("_g", "_range")
    spread = cells.select("_g", "_range", "_n", F.explode(F.array(*[F.col("_pane") - s for s in steps])).alias("_window"))
    found = spread.groupBy("_g", "_range", "_window").agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy("_g", "_window")  # at most RANGES rows
    up_to = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumns({"_before": F.sum("_n").over(up_to) - F.col("_n"), "_all": F.sum("_n").over(whole)})
    places = [F.struct(F.lit(i).alias("_ask"), (F.greatest(F.ceil(F.col("_all") * p), F.lit(1)) - F.col("_before")).alias("_place")) for i, p in enumerate(asked.values())]
    none = F.col("_all") == 0
    hits = cut(placed.select("_g", "_window", "_range", "_n", "_all", F.inline(F.array(*places))).where(F.col("_place").between(1, F.col("_n")) | none).drop("_n"))
    held = hits.select("*", F.explode(F.array(*[F.col("_window") + s for s in steps])).alias("_pane")).join(dealt, ["_g", "_pane", "_range"])
    inside = F.sum("_n").over(Window.partitionBy("_g", "_window", "_ask").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = held.withColumn("_upto", inside).where(((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place"))) | none)
    out = at.groupBy("_g", "_window").agg(*[F.max(F.when(F.col("_ask") == i, F.col("_v"))).alias(name) for i, name in enumerate(asked)])
    return out.select("_g.*", *([] if pane is None else [F.col("_window").alias("window_start")]), *asked)


def equal_bins(df: DataFrame, value: Column, tie: str, bins: int, name: str) -> DataFrame:
    """``df`` with the bin (from 1) of each row in the order of ``value`` and ``tie``; the first bins have a row more where they don't divide."""
    return equal_bins_of(df, {name: value}, tie, bins)


def equal_bins_of(df: DataFrame, values: Mapping[str, Column], tie: str, bins: int) -> DataFrame:
    """``equal_bins`` of several values by the names of their bins: rows are dealt by their tie and written once for all of them."""
    rows = df.withColumns({f"_v_{name}": value.cast("double") for name, value in values.items()})
    placed = parts = cut(_ranges(rows, tie).withColumnRenamed("_range", "_part"))  # rows of one value are dealt by their tie
    for name in values:
        placed = _binned(placed, parts, f"_v_{name}", tie, bins, name)
    return placed.select(*df.columns, *values)


def _binned(placed: DataFrame, parts: DataFrame, value: str, tie: str, bins: int, name: str) -> DataFrame:
    """``placed`` with the bin of ``value`` as ``name``; ``parts`` is the written table that it comes from, whose counts give each row's place."""
    sizes = parts.groupBy(value, "_part").agg(F.count("*").alias("n"))
    starts = running(sizes.groupBy(value).agg(F.sum("n").alias("n")), value, "n").select(value, F.col("before_n").alias("_before"), F.col("all_n").alias("_all"))
    inside = Window.partitionBy(value).orderBy("_part")  # at most RANGES rows
    offsets = sizes.select(value, "_part", (F.sum("n").over(inside) - F.col("n")).alias("_inside")).join(starts, value)
    place = F.row_number().over(Window.partitionBy(value, "_part").orderBy(tie)) - 1
    at = F.col("_place") + F.col("_before") + F.col("_inside")
    out = placed.withColumn("_place", place).join(offsets, [value, "_part"]).withColumn("_place", at)
    size, more = F.floor(F.col("_all") / bins), F.col("_all") % bins
    first = more * (size + 1)
    bin_ = F.when(F.col("_place") < first, F.floor(F.col("_place") / (size + 1))).otherwise(more + F.floor(F.try_divide(F.col("_place") - first, size)))
    return out.withColumn(name, (bin_ + 1).cast("int")).drop("_place", "_before", "_inside", "_all")
