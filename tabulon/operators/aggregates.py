"""Aggregations: each is one pass with partial sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.ranks import equal_bins_of, grouped_quantiles, quantiles
from tabulon.session import cut, spread

DOUBLE = "double"


def total(column: str) -> Column:
    """The exact sum of a decimal column, as double."""
    return F.sum(column).cast(DOUBLE)


def top_groups(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def bucket_counts(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def average_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("average"), F.count(value).alias("n"))


def catalog_kpis(df: DataFrame) -> DataFrame:
    """All figures of a catalogue in one aggregate."""
    return df.agg(F.count("*").alias("products"), F.count_distinct("brand").alias("brands"), F.count_distinct("category").alias("categories"), F.round(F.avg("price"), 4).alias("avg_price"), F.round(F.avg("size"), 4).alias("avg_size"))


def product_reference(inventory: DataFrame) -> DataFrame:
    """Latest name and category (ties: the greater value), average cost."""
    latest = F.max(F.struct("inventory_date", "product_name", "category"))
    return inventory.groupBy("product_id").agg(latest.alias("m"), F.avg(F.col("unit_cost").cast(DOUBLE)).alias("avg_cost")).select("product_id", "m.product_name", "m.category", "avg_cost")


def inventory_levels(inventory: DataFrame) -> DataFrame:
    """Per product: units, value, latest day and the stock by warehouse as an ordered array."""
    value = F.sum(F.col("quantity_on_hand").cast("decimal(18,2)") * F.col("unit_cost")).cast(DOUBLE)
    parts = F.array_sort(F.collect_list(F.struct("warehouse", "quantity_on_hand")))
    return inventory.groupBy("product_id").agg(F.sum("quantity_on_hand").alias("units"), value.alias("stock_value"), F.max("inventory_date").alias("latest"), parts.alias("warehouse_breakdown"))


def sales_by_warehouse_product(sales: DataFrame) -> DataFrame:
    return sales.groupBy("warehouse", "product_id").agg(F.sum("quantity").alias("sold"), F.max("event_time").alias("last_sale"), F.sum("amount").alias("revenue"))


def sales_trend(sales: DataFrame, days: int, newest: DataFrame | None = None) -> DataFrame:
    """Units and revenue of each of the last ``days`` days, zero where nothing was sold.

    ``newest`` gives the latest time in its first column, as in ``trailing``: pass it from the base table where ``sales`` is a costly view.
    """
    last = newest if newest is not None else sales.select(F.max("event_time"))
    first = F.date_sub(F.to_date(last.scalar()), days - 1)
    recent = sales.where(F.col("event_time") >= first.cast(sales.schema["event_time"].dataType))
    daily = recent.groupBy(F.to_date("event_time").alias("day")).agg(F.sum("quantity").alias("units"), F.sum("amount").alias("revenue"))
    day = F.to_date(F.col(last.columns[0]))
    calendar = last.select(F.explode(F.sequence(F.date_sub(day, days - 1), day)).alias("day"))
    return calendar.join(daily, "day", "left").select("day", F.coalesce("units", F.lit(0.0)).alias("units"), F.coalesce(F.col("revenue").cast(DOUBLE), F.lit(0.0)).alias("revenue"))


def inventory_summary(inventory: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """Units and value of the latest snapshot: in all, by warehouse, by category (grouping sets). ``newest`` as in ``sales_trend``."""
    last = newest if newest is not None else inventory.select(F.max("inventory_date"))
    now = inventory.where(F.col("inventory_date") == F.to_date(last.scalar()))
    sets = now.groupingSets([["warehouse"], ["category"], []], "warehouse", "category")
    value = F.sum(F.col("quantity_on_hand").cast("decimal(18,2)") * F.col("unit_cost")).cast(DOUBLE)
    return sets.agg(F.sum("quantity_on_hand").alias("units"), value.alias("stock_value"), F.grouping_id().cast("long").alias("level"))


def supplier_summary(suppliers: DataFrame, focus: DataFrame) -> DataFrame:
    """Average balance, number of suppliers and the distinct categories they supply, by nation."""
    areas = focus.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("areas"))
    by = suppliers.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("avg_balance"))
    return by.join(areas, "s_nationkey", "left")


def order_totals(sales: DataFrame, *more: str) -> DataFrame:
    return sales.groupBy("order_id", "warehouse", *more).agg(F.max("event_time").alias("last_time"), F.sum("quantity").alias("units"), total("amount").alias("order_total"))


def quartiles(df: DataFrame, keys: Sequence[Column | str], value: str, approximate: bool = False) -> DataFrame:
    """Quartiles: values of the group, exact ones of any number of rows; with ``approximate``, and on a stream, from Spark's bounded summaries."""
    if not (approximate or df.isStreaming):
        return grouped_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = F.percentile_approx(value, [0.25, 0.5, 0.75])
    return df.groupBy(*keys).agg(q.alias("q")).select("*", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).drop("q")


def distinct_orders(sales: DataFrame, keys: Sequence[str], approximate: bool = False) -> DataFrame:
    return sales.groupBy(*keys).agg((F.approx_count_distinct("order_id") if approximate else F.count_distinct("order_id")).alias("orders"))


def totals_with_all(df: DataFrame, key: str, sub: str, value: str) -> DataFrame:
    """Sums by (key, sub) and by key alone, as sub 'ALL'."""
    sets = df.groupingSets([[key, sub], [key]], key, sub).agg(F.sum(value).alias("total"), F.grouping(sub).alias("g"))
    return sets.select(key, F.when(F.col("g") == 1, "ALL").otherwise(F.col(sub).cast("string")).alias(sub), "total")


def weekly_product(sales: DataFrame, promo: Column) -> DataFrame:
    """Per product and Monday week: units, mean price, share of promoted sales."""
    return sales.groupBy("product_id", F.to_date(F.date_trunc("week", "event_time")).alias("week")).agg(F.sum("quantity").alias("units"), F.avg("unit_price").alias("price"), F.avg(promo.cast("int")).alias("promo_share"))


def category_week_means(weekly: DataFrame, products: DataFrame) -> DataFrame:
    return weekly.join(products.select("product_id", "category"), "product_id").groupBy("category", "week").agg(F.avg("units").alias("units"), F.avg("price").alias("price"))


def elasticity(weekly: DataFrame, key: str, min_obs: int) -> DataFrame:
    """Slope and R2 of log units on log price per key with at least ``min_obs`` weeks."""
    x, y = F.ln("price"), F.ln("units")
    out = weekly.where("price > 0 and units > 0").groupBy(key).agg(F.regr_slope(y, x).alias("elasticity"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    return out.where(F.col("n") >= min_obs)


def promo_uplift(weekly: DataFrame, key: str) -> DataFrame:
    """Mean units of weeks with any promotion over those of weeks without one, less 1."""
    on, off = F.avg(F.when(F.col("promo_share") > 0, F.col("units"))), F.avg(F.when(F.col("promo_share") == 0, F.col("units")))
    return weekly.groupBy(key).agg((F.try_divide(on, off) - 1).alias("uplift"))


def bi_measures(sales: DataFrame, cost: Column, by: Sequence[str]) -> DataFrame:
    """Measures by keys; orders are dealt to tasks, which count their own."""
    out = spread(sales, "order_id").groupBy(*by).agg(total("amount").alias("sales"), F.sum("quantity").alias("units"), F.sum((F.col("quantity") * cost).cast("decimal(18,4)")).cast(DOUBLE).alias("cogs"), F.count_distinct("order_id").alias("orders"))
    margin = F.col("sales") - F.col("cogs")
    return out.withColumns({"gross_margin": margin, "margin_share": F.try_divide(margin, F.col("sales")), "average_order": F.try_divide(F.col("sales"), F.col("orders"))})


def sales_matrix(sales: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Sales and units over the roll-up of ``levels``; ``level`` is Spark's grouping id."""
    return sales.rollup(*levels).agg(total("amount").alias("sales"), F.sum("quantity").alias("units"), F.grouping_id().cast("long").alias("level"))


def waterfall(sales: DataFrame, cost: Column) -> DataFrame:
    """Gross sales, discount, cost of goods and margin as rows."""
    one = sales.agg(F.sum("gross").alias("g"), F.sum("amount").alias("a"), F.sum((F.col("quantity") * cost).cast("decimal(18,4)")).alias("c"))
    return one.selectExpr("stack(4, 1, 'gross', cast(g as double), 2, 'discount', cast(a - g as double), 3, 'cogs', cast(-c as double), 4, 'margin', cast(a - c as double)) as (step, name, value)")


def rfm(sales: DataFrame, bins: int = 5) -> DataFrame:
    """Recency in days, frequency and monetary value per customer, with bins of equal sizes by rank (ties by id)."""
    by = cut(sales.groupBy("customer_id").agg(F.max("order_time").alias("latest"), F.count_distinct("order_id").alias("frequency"), total("amount").alias("monetary")))
    last = by.select(F.max("latest"))  # of all sales
    by = by.select("customer_id", F.datediff(last.scalar(), "latest").alias("recency"), "frequency", "monetary")
    binned = equal_bins_of(by, {"r_bin": -F.col("recency"), "f_bin": F.col("frequency")}, "customer_id", bins)
    return binned.select("customer_id", "recency", "frequency", "monetary", "r_bin", "f_bin")


def rfm_heatmap(binned: DataFrame) -> DataFrame:
    """Customers and their mean value in each pair of bins."""
    return binned.groupBy("r_bin", "f_bin").agg(F.count("*").alias("customers"), F.avg("monetary").alias("monetary"))


def cohort_retention(sales: DataFrame) -> DataFrame:
    """Customers of each first-order month still ordering in later months."""
    first = sales.groupBy("customer_id").agg(F.date_trunc("month", F.min("order_time")).alias("cohort"))
    active = sales.select("customer_id", F.date_trunc("month", "order_time").alias("month")).distinct()
    age = (F.year("month") - F.year("cohort")) * 12 + F.month("month") - F.month("cohort")
    counts = active.join(first, "customer_id").groupBy(F.to_date("cohort").alias("cohort"), age.alias("age")).agg(F.count("*").alias("customers"))
    size = first.groupBy(F.to_date("cohort").alias("cohort")).agg(F.count("*").alias("size"))
    return counts.join(size, "cohort").withColumn("retention", F.col("customers") / F.col("size"))


def funnel(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """How many users reach each step, having done all before it."""
    flags = events.groupBy("user_id").agg(*[F.max((F.col("event_type") == s).cast("int")).alias(f"s{i}") for i, s in enumerate(steps)])
    reached = [F.sum(F.when(F.least(*[F.col(f"s{j}") for j in range(i + 1)], F.lit(1)) == 1, 1).otherwise(0)).alias(f"n{i}") for i in range(len(steps))]
    pairs = ", ".join(f"{i}, '{s}', n{i}" for i, s in enumerate(steps))
    return flags.agg(*reached).selectExpr(f"stack({len(steps)}, {pairs}) as (step, name, users)")


def category_share(df: DataFrame, key: str, value: str) -> DataFrame:
    by = df.groupBy(key).agg(F.count("*").alias("n"), total(value).alias("revenue"))
    rows = by.agg(F.sum("n").alias("rows"))
    return by.join(F.broadcast(rows)).withColumn("share", F.col("n") * 100.0 / F.col("rows")).drop("rows")  # one row


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of each column, as rows."""
    names = ("count", "mean", "std", "min", "max")
    one = df.agg(*[F.struct(*[x.cast(DOUBLE).alias(n) for n, x in zip(names, (F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)), strict=True)]).alias(c) for c in columns])
    rows = one.selectExpr(f"stack({len(columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in columns)}) as (name, s)").select("name", "s.*")
    found = [quantiles(df, c, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn("name", F.lit(c)) for c in columns]
    return rows.join(reduce(DataFrame.unionByName, found), "name", "left").select("name", "count", "mean", "std", "min", "q1", "median", "q3", "max")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {rows}) as (a, b, r)")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of ``bins`` equal bins from the minimum to the maximum, which the last bin holds."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    both = df.where(F.col(column).isNotNull()).join(F.broadcast(ends))  # one row
    at = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return both.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def collapse_dim(df: DataFrame, key: str, order: str, texts: str | Sequence[str], number: str, numbers: DataFrame | None = None) -> DataFrame:
    """First non-blank texts and median number per key. The median comes from the counts of equal numbers, so that no task holds a key's rows.

    ``numbers`` (key, number, n) gives numbers that are counted already.
    """
    names = [texts] if isinstance(texts, str) else list(texts)

    def first(text: str) -> Column:
        blank = F.trim(F.coalesce(text, F.lit(""))) == ""
        return F.min_by(F.when(~blank, F.col(text)), F.when(~blank, F.col(order))).alias(text)

    out = df.groupBy(key).agg(*[first(t) for t in names])
    given, n = (df, F.count("*")) if numbers is None else (numbers, F.sum("n"))
    counts = given.where(F.col(number).isNotNull()).groupBy(key, F.col(number).cast(DOUBLE).alias("v")).agg(n.alias("n"))
    up_to = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(up_to), "every": F.sum("n").over(Window.partitionBy(key))})
    middle = (F.col("upto") * 2 >= F.col("every")) & ((F.col("upto") - F.col("n")) * 2 <= F.col("every"))
    medians = placed.where(middle).groupBy(key).agg(((F.min("v") + F.max("v")) / 2).alias(number))
    return out.join(medians, key, "left")


def regatta_measures(fact: DataFrame) -> DataFrame:
    """Figures of results (regatta, race, boat, rank, points, elapsed); the median is one of the points."""
    missing = F.count_if(F.col("elapsed").isNull()) * 100.0 / F.count("*")
    return fact.agg(F.count_distinct("boat").alias("boats"), F.count_distinct("race").alias("races"), F.count_distinct("regatta").alias("regattas"), F.count_if(F.col("rank") == 1).alias("winners"), F.avg("points").alias("avg_points"), F.percentile_approx("points", 0.5).alias("median_points"), missing.alias("missing_pct"))


def cost_review(costs: DataFrame, budget: float, days: int = 7) -> DataFrame:
    """Per service: total, share over 40 %, last week over 1.2 times the mean, use of the budget over 80 %."""
    last = costs.agg(F.max("day").alias("last"))
    by = costs.join(F.broadcast(last)).groupBy("service").agg(F.sum("cost").alias("total"), F.avg("cost").alias("mean"), F.avg(F.when(F.datediff("last", "day") < days, F.col("cost"))).alias("recent"))  # one row
    every = costs.agg(F.sum("cost").alias("every"))
    share = F.try_divide(F.col("total"), F.col("every"))
    return by.join(F.broadcast(every)).select("service", F.col("total").cast(DOUBLE), share.cast(DOUBLE).alias("share"), (share > 0.4).alias("dominant"), (F.coalesce("recent", F.lit(0)) > F.col("mean") * 1.2).alias("spike"), (F.col("total") > budget * 0.8).alias("over_budget"))


def cost_projection(costs: DataFrame, days: int = 7) -> DataFrame:
    """The mean day of the last ``days`` days times 30, and 10 % more."""
    daily = costs.groupBy("day").agg(F.sum("cost").alias("cost"))
    last = daily.agg(F.max("day").alias("last"))
    recent = daily.join(F.broadcast(last)).where(F.datediff("last", "day") < days)  # one row
    return recent.agg((F.avg("cost").cast(DOUBLE) * 30).alias("projected")).withColumn("padded", F.col("projected") * 1.1)


def latency_summary(df: DataFrame, column: str, ok: Column) -> DataFrame:
    one = df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 6).alias("avg"), F.try_divide(F.count_if(ok), F.count("*")).alias("success_rate"))
    return one.join(F.broadcast(quantiles(df, column, {"p50": 0.5, "p95": 0.95, "p99": 0.99})))  # one row each


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits of a column's values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    both = counts.agg(F.sum(F.col("n") * F.log2("n")).alias("s"), F.sum("n").alias("t"))
    return both.select((F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def coverage_score(inventory: DataFrame, threshold: float) -> DataFrame:
    low = F.sum(F.when(F.col("quantity_on_hand") <= threshold, F.col("quantity_on_hand")).otherwise(0))
    return inventory.agg((100 - F.try_divide(low, F.sum("quantity_on_hand")) * 100).alias("score"))


def monitoring_series(events: DataFrame, seconds: int, dead_letters: DataFrame | None = None, score: str | None = None) -> DataFrame:
    """Per window and type: rate, approximate quantiles of the value, mean of the quality ``score`` if there is one, share of errors in the window, and its dead letters."""
    w = F.window("ts", f"{seconds} seconds")["start"]
    by = events.groupBy(w.alias("window_start"), "event_type").agg(F.count("*").alias("n"), (F.count("*") / seconds).alias("rate"), F.percentile_approx("value", 0.5).alias("p50"), F.percentile_approx("value", 0.95).alias("p95"), *([F.avg(score).alias("mean_quality")] if score else []))
    errors = by.groupBy("window_start").agg(F.try_divide(F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)), F.sum("n")).alias("error_rate"))
    out = by.join(errors, "window_start").drop("n")
    if dead_letters is None:
        return out.withColumn("dlq", F.lit(0).cast("long"))
    dead = dead_letters.groupBy(w.alias("window_start")).agg(F.count("*").alias("dlq"))
    return out.join(dead, "window_start", "left").fillna(0, "dlq")


def period_kpis(sales: DataFrame) -> DataFrame:
    """Total, average order, units and customers of a period."""
    return sales.agg(total("amount").alias("total"), (total("amount") / F.count_distinct("order_id")).alias("average_order"), F.sum("quantity").alias("units"), F.count_distinct("customer_id").alias("customers"))


def qc_totals(sales: DataFrame) -> DataFrame:
    return sales.agg(total("amount").alias("total"), F.count_distinct("customer_id").alias("clients"))


def promo_table(sales: DataFrame, campaigns: DataFrame, period: Column) -> DataFrame:
    """Per campaign (campaign_id, campaign_name, is_promo) and period: rows, sales, and the discount as a share of gross sales."""
    by = sales.join(campaigns, "campaign_id").groupBy("campaign_name", "is_promo", period.alias("period"))
    sums = by.agg(F.count("*").alias("n"), total("amount").alias("sales"), total("gross").alias("_g"))
    return sums.withColumn("discount_share", 1 - F.try_divide(F.col("sales"), F.col("_g"))).drop("_g")


def log_summary(lines: DataFrame, parsed: Column, class_of: Column, method: Column, endpoint: Column, status: Column) -> DataFrame:
    """(kind, key, n) in one pass over all lines: totals, and counts by status class, method and endpoint of what ``parsed`` gave.

    ``totals`` has lines, parsed and errors; parse success and error rate follow from them.
    """
    error = (status >= 400) & (status < 600)
    kinds = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("lines").alias("key")),
        F.when(parsed.isNotNull(), F.struct(F.lit("total").alias("kind"), F.lit("parsed").alias("key"))),
        F.when(error, F.struct(F.lit("total").alias("kind"), F.lit("errors").alias("key"))),
        *[F.when(parsed.isNotNull(), F.struct(F.lit(k).alias("kind"), c.alias("key"))) for k, c in (("class", class_of), ("method", method), ("endpoint", endpoint))],
    )
    return lines.select(F.inline(F.array_compact(kinds))).groupBy("kind", "key").agg(F.count("*").alias("n"))


def sums_by(df: DataFrame, keys: Sequence[str | Column], value: str) -> DataFrame:
    """Totals of an amount: operating expenses by category, sales by region, product or month."""
    return df.groupBy(*keys).agg(total(value).alias("total"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted values for a slicer."""
    return df.select(column).distinct().orderBy(column)


def app_log_stats(logs: DataFrame, as_of: Column) -> DataFrame:
    """Per hour and level of parsed log lines (ts, level): entries, and those of the last hour before ``as_of``."""
    recent = (F.col("ts") > as_of - F.expr("interval 1 hour")) & (F.col("ts") <= as_of)
    return logs.groupBy("level", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(recent).alias("last_hour"))


def pipeline_health(views: DataFrame) -> DataFrame:
    """Per hour: rows, products, and mean rows a product."""
    by = views.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("products"))
    return by.withColumn("avg_views", F.try_divide(F.col("n"), F.col("products")))


def best_days(sales: DataFrame, n: int = 7) -> DataFrame:
    """The days of most revenue, with their average order."""
    by = sales.groupBy(F.to_date("event_time").alias("day")).agg(total("amount").alias("revenue"), F.count_distinct("order_id").alias("orders"))
    return by.select("day", "revenue", F.try_divide(F.col("revenue"), F.col("orders")).alias("average_order")).orderBy(F.desc("revenue"), "day").limit(n)
