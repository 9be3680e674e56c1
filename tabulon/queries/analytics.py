"""Queries of aggregates, business measures, statistics and scalar functions, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulon.functions import scalars as S
from tabulon.operators import aggregates as A
from tabulon.operators import cleaning as P
from tabulon.operators import sketches as K
from tabulon.operators.ranks import grouped_quantiles
from tabulon.plans import views as V
from tabulon.queries.relational import _with
from tabulon.registry import register
from tabulon.session import shared_dir, table

D = "double"
WEEKLY = "weekly AS (SELECT product_id, CAST(date_trunc('week', event_time) AS DATE) AS week, sum(quantity) AS units, avg(unit_price) AS price, avg(CAST(discount > 0.05 AS INTEGER)) AS promo_share FROM sales GROUP BY ALL)"
INV = ("sales", "products", "inventory")
COSTS = "costs AS (SELECT priority AS service, CAST(order_time AS DATE) AS day, sum(amount) AS cost FROM sales GROUP BY ALL)"


def _weekly(spark, sf):
    return A.weekly_product(V.sales(spark, sf), F.col("discount") > 0.05)


def _costs(spark, sf):
    return V.sales(spark, sf).groupBy(F.col("priority").alias("service"), F.to_date("order_time").alias("day")).agg(F.sum("amount").alias("cost"))


@register("a1_top_groups", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(spark, sf):
    return A.top_groups(table(spark, sf, "part"), "p_brand", 10)


@register("a2_bucket_counts", "SELECT CASE WHEN v < 10 THEN '< $10' WHEN v < 50 THEN '$10-$49' WHEN v < 100 THEN '$50-$99' WHEN v < 500 THEN '$100-$499' ELSE '$500+' END AS bucket, count(*) AS n FROM (SELECT o_totalprice / 1000 AS v FROM orders) GROUP BY 1")
def _(spark, sf):
    return A.bucket_counts(table(spark, sf, "orders"), P.price_bucket(F.col("o_totalprice") / 1000))


@register("a2_rating_counts", "SELECT CASE WHEN v >= 4.5 THEN '4.5-5.0' WHEN v >= 4.0 THEN '4.0-4.4' WHEN v >= 3.5 THEN '3.5-3.9' WHEN v >= 3.0 THEN '3.0-3.4' ELSE '< 3.0' END AS bucket, count(*) AS n FROM (SELECT l_quantity / 10 AS v FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return A.bucket_counts(table(spark, sf, "lineitem"), P.rating_bucket(F.col("l_quantity") / 10))


@register("a3_average_by", "SELECT p_type, avg(p_size) AS average, count(p_size) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return A.average_by(table(spark, sf, "part"), "p_type", "p_size")


@register("a4_catalog_kpis", _with("SELECT count(*) AS products, count(DISTINCT brand) AS brands, count(DISTINCT category) AS categories, round(avg(price), 4) AS avg_price, round(avg(size), 4) AS avg_size FROM products", views=("products",)))
def _(spark, sf):
    return A.catalog_kpis(V.products(spark, sf))


@register("a5_product_reference", _with("SELECT product_id, arg_max(product_name, inventory_date) AS product_name, arg_max(category, inventory_date) AS category, avg(CAST(unit_cost AS DOUBLE)) AS avg_cost FROM inventory GROUP BY 1", views=INV))
def _(spark, sf):
    return A.product_reference(V.inventory(spark, sf))


@register("a6_inventory_levels", _with("SELECT product_id, sum(quantity_on_hand) AS units, CAST(sum(CAST(quantity_on_hand AS DECIMAL(18,2)) * unit_cost) AS DOUBLE) AS stock_value, max(inventory_date) AS latest, string_agg(warehouse || ':' || CAST(quantity_on_hand AS BIGINT), ',' ORDER BY warehouse, quantity_on_hand) AS parts FROM inventory GROUP BY 1", views=INV))
def _(spark, sf):
    out = A.inventory_levels(V.inventory(spark, sf))
    parts = F.array_join(F.transform("warehouse_breakdown", lambda x: F.concat(x["warehouse"], F.lit(":"), x["quantity_on_hand"].cast("long").cast("string"))), ",")
    return out.select("product_id", "units", "stock_value", "latest", parts.alias("parts"))


@register("a7_sales_by_warehouse_product", _with("SELECT warehouse, product_id, sum(quantity) AS sold, max(event_time) AS last_sale, CAST(sum(amount) AS DOUBLE) AS revenue FROM sales GROUP BY ALL"))
def _(spark, sf):
    return A.sales_by_warehouse_product(V.sales(spark, sf)).withColumn("revenue", F.col("revenue").cast(D))


@register("a8_sales_trend", _with("SELECT CAST(d AS DATE) AS day, coalesce(units, 0) AS units, coalesce(CAST(revenue AS DOUBLE), 0) AS revenue FROM (SELECT unnest(generate_series(CAST(max(event_time) AS DATE) - INTERVAL 89 DAYS, max(event_time), INTERVAL 1 DAY)) AS d FROM sales) LEFT JOIN (SELECT CAST(event_time AS DATE) AS day, sum(quantity) AS units, sum(amount) AS revenue FROM sales GROUP BY 1) ON CAST(d AS DATE) = day"))
def _(spark, sf):
    return A.sales_trend(V.sales(spark, sf), 90, V.newest_sale(spark, sf))


@register("a9_inventory_summary", _with("SELECT warehouse, category, sum(quantity_on_hand) AS units, CAST(sum(CAST(quantity_on_hand AS DECIMAL(18,2)) * unit_cost) AS DOUBLE) AS stock_value, grouping(warehouse, category) AS level FROM inventory WHERE inventory_date = (SELECT max(inventory_date) FROM inventory) GROUP BY GROUPING SETS ((warehouse), (category), ())", views=INV))
def _(spark, sf):
    return A.inventory_summary(V.inventory(spark, sf), V.newest_sale(spark, sf))


@register("a10_supplier_summary", "WITH f AS (SELECT DISTINCT s_nationkey, p_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), a AS (SELECT s_nationkey, string_agg(p_type, ',' ORDER BY p_type) AS areas FROM f GROUP BY 1) SELECT s.s_nationkey, count(*) AS suppliers, round(avg(s_acctbal), 4) AS avg_balance, areas FROM supplier s LEFT JOIN a ON s.s_nationkey = a.s_nationkey GROUP BY ALL")
def _(spark, sf):
    s, li, p = table(spark, sf, "supplier"), table(spark, sf, "lineitem"), table(spark, sf, "part")
    focus = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey).select("s_nationkey", F.col("p_type").alias("category"))
    return A.supplier_summary(s, focus)


@register("a11_order_totals", _with("SELECT order_id, warehouse, max(event_time) AS last_time, sum(quantity) AS units, CAST(sum(amount) AS DOUBLE) AS order_total FROM sales GROUP BY ALL"))
def _(spark, sf):
    return A.order_totals(V.sales(spark, sf))


@register("a12_quartiles", "SELECT event_type, CAST(ts AS DATE) AS day, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS q3 FROM events GROUP BY ALL")
def _(spark, sf):
    return A.quartiles(table(spark, sf, "events"), ["event_type", F.to_date("ts").alias("day")], "value")


@register("a13_distinct_orders", _with("SELECT warehouse, count(DISTINCT order_id) AS orders FROM sales GROUP BY 1"))
def _(spark, sf):
    return A.distinct_orders(V.sales(spark, sf), ["warehouse"])


@register("a12_a13_rollup", "SELECT CAST(date_trunc('week', ts) AS DATE) AS period, event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close, true AS p95_close FROM events GROUP BY ALL")
def _(spark, sf):
    """Weeks from sketches of days that are kept as a table: users within 8 % (and 2), quantiles within 2 % of the ranks of the exact ones."""
    e = table(spark, sf, "events")
    root = f"{shared_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    K.write_sketches(K.daily_sketches(e, "ts", ["event_type"], "user_id", "value"), root)
    week = F.to_date(F.date_trunc("week", "day"))
    rolled = K.roll_up(K.read_sketches(spark, root, "0001-01-01", "9999-12-31"), week, ["event_type"], {"median": 0.5, "p95": 0.95})
    weekly = e.select(F.to_date(F.date_trunc("week", "ts")).alias("period"), "event_type", "user_id", "value")
    users = weekly.groupBy("period", "event_type").agg(F.count_distinct("user_id").alias("users"))
    ranks = grouped_quantiles(weekly, ["period", "event_type"], "value", {"q0": 0.48, "q1": 0.52, "q2": 0.93, "q3": 0.97})
    both = rolled.join(users, ["period", "event_type"]).join(ranks, ["period", "event_type"])
    close = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.col("users") * 0.08, F.lit(2))
    return both.select("period", "event_type", "n", "users", close.alias("users_close"), F.col("median").between(F.col("q0"), F.col("q1")).alias("median_close"), F.col("p95").between(F.col("q2"), F.col("q3")).alias("p95_close"))


@register("a14_period_kpis", _with("SELECT CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(amount) AS DOUBLE) / count(DISTINCT order_id) AS average_order, sum(quantity) AS units, count(DISTINCT customer_id) AS customers FROM sales WHERE event_time >= (SELECT max(event_time) FROM sales) - INTERVAL 30 DAYS"))
def _(spark, sf):
    return A.period_kpis(P.trailing(V.sales(spark, sf), "event_time", 30, newest=V.newest_sale(spark, sf)))


@register("a15_qc_totals", _with("SELECT CAST(sum(amount) AS DOUBLE) AS total, count(DISTINCT customer_id) AS clients FROM sales"))
def _(spark, sf):
    return A.qc_totals(V.sales(spark, sf))


@register("a16_totals_with_all", _with("SELECT product_id, CASE WHEN grouping(warehouse) = 1 THEN 'ALL' ELSE warehouse END AS warehouse, sum(quantity) AS total FROM sales GROUP BY GROUPING SETS ((product_id, warehouse), (product_id))"))
def _(spark, sf):
    return A.totals_with_all(V.sales(spark, sf), "product_id", "warehouse", "quantity")


@register("a17_weekly_product", _with("SELECT product_id, week, units, round(price, 9) AS price, promo_share FROM weekly", WEEKLY))
def _(spark, sf):
    return _weekly(spark, sf).withColumn("price", F.round("price", 9))


@register("a18_category_week_means", _with("SELECT category, week, round(avg(units), 6) AS units, round(avg(weekly.price), 9) AS price FROM weekly JOIN products USING (product_id) GROUP BY ALL", WEEKLY))
def _(spark, sf):
    out = A.category_week_means(_weekly(spark, sf), V.products(spark, sf))
    return out.select("category", "week", F.round("units", 6).alias("units"), F.round("price", 9).alias("price"))


@register("a19_elasticity", _with("SELECT product_id, round(regr_slope(ln(units), ln(price)), 6) AS elasticity, round(regr_r2(ln(units), ln(price)), 6) AS r2, CAST(regr_count(ln(units), ln(price)) AS BIGINT) AS n FROM weekly GROUP BY 1 HAVING count(*) >= 12", WEEKLY))
def _(spark, sf):
    return A.elasticity(_weekly(spark, sf), "product_id", 12).select("product_id", F.round("elasticity", 6).alias("elasticity"), F.round("r2", 6).alias("r2"), "n")


@register("a20_promo_uplift", _with("SELECT product_id, round(avg(units) FILTER (promo_share > 0) / avg(units) FILTER (promo_share = 0) - 1, 6) AS uplift FROM weekly GROUP BY 1", WEEKLY))
def _(spark, sf):
    return A.promo_uplift(_weekly(spark, sf), "product_id").withColumn("uplift", F.round("uplift", 6))


BI = "SELECT {by} sum(amount)::DOUBLE AS sales, sum(quantity) AS units, sum(CAST(quantity * price AS DECIMAL(18,4)))::DOUBLE AS cogs, count(DISTINCT order_id) AS orders FROM sales JOIN products USING (product_id)"


@register("a21_bi_measures", _with("SELECT *, sales - cogs AS gross_margin, round((sales - cogs) / sales, 8) AS margin_share, sales / orders AS average_order FROM (" + BI.format(by="warehouse,") + " GROUP BY warehouse)"))
def _(spark, sf):
    s = V.sales(spark, sf).join(V.products(spark, sf), "product_id")
    return A.bi_measures(s, F.col("price"), ["warehouse"]).withColumn("margin_share", F.round("margin_share", 8))


@register("a22_sales_matrix", _with("SELECT category, brand, CAST(sum(amount) AS DOUBLE) AS sales, sum(quantity) AS units, grouping(category, brand) AS level FROM sales JOIN products USING (product_id) GROUP BY ROLLUP (category, brand)"))
def _(spark, sf):
    return A.sales_matrix(V.sales(spark, sf).join(V.products(spark, sf), "product_id"), ["category", "brand"])


@register("a22_waterfall", _with("SELECT unnest([1, 2, 3, 4]) AS step, unnest(['gross', 'discount', 'cogs', 'margin']) AS name, unnest([g, a - g, -c, a - c])::DOUBLE AS value FROM (SELECT sum(gross)::DECIMAL(28,4) AS g, sum(amount)::DECIMAL(28,4) AS a, sum(CAST(quantity * price AS DECIMAL(18,4)))::DECIMAL(28,4) AS c FROM sales JOIN products USING (product_id))"))
def _(spark, sf):
    return A.waterfall(V.sales(spark, sf).join(V.products(spark, sf), "product_id"), F.col("price"))


@register("a23_promo_table", _with("SELECT 'campaign ' || k AS campaign_name, k > 0 AS is_promo, CAST(date_trunc('year', event_time) AS DATE) AS period, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS sales, round(1 - sum(amount)::DOUBLE / sum(gross)::DOUBLE, 8) AS discount_share FROM (SELECT *, CAST(round(discount * 100) AS BIGINT) % 4 AS k FROM sales) GROUP BY ALL"))
def _(spark, sf):
    s = V.sales(spark, sf).withColumn("campaign_id", F.round(F.col("discount") * 100).cast("long") % 4)
    campaigns = spark.range(4).select(F.col("id").alias("campaign_id"), F.concat(F.lit("campaign "), F.col("id").cast("string")).alias("campaign_name"), (F.col("id") > 0).alias("is_promo"))
    return A.promo_table(s, campaigns, F.to_date(F.date_trunc("year", "event_time"))).withColumn("discount_share", F.round("discount_share", 8))


@register("a24_rfm", _with("SELECT customer_id, recency, frequency, monetary, CAST(ntile(5) OVER (ORDER BY recency DESC, customer_id) AS INTEGER) AS r_bin, CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS INTEGER) AS f_bin FROM (SELECT customer_id, CAST(date_diff('day', CAST(max(order_time) AS DATE), (SELECT CAST(max(order_time) AS DATE) FROM sales)) AS INTEGER) AS recency, count(DISTINCT order_id) AS frequency, CAST(sum(amount) AS DOUBLE) AS monetary FROM sales GROUP BY 1)"))
def _(spark, sf):
    return A.rfm(V.sales(spark, sf))


@register("a24_rfm_heatmap", _with("SELECT r_bin, f_bin, count(*) AS customers, round(avg(monetary), 1) AS monetary FROM (SELECT customer_id, recency, frequency, monetary, CAST(ntile(5) OVER (ORDER BY recency DESC, customer_id) AS INTEGER) AS r_bin, CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS INTEGER) AS f_bin FROM (SELECT customer_id, CAST(date_diff('day', CAST(max(order_time) AS DATE), (SELECT CAST(max(order_time) AS DATE) FROM sales)) AS INTEGER) AS recency, count(DISTINCT order_id) AS frequency, CAST(sum(amount) AS DOUBLE) AS monetary FROM sales GROUP BY 1)) GROUP BY ALL"))
def _(spark, sf):
    return A.rfm_heatmap(A.rfm(V.sales(spark, sf))).withColumn("monetary", F.round("monetary", 1))


@register("a25_cohort_retention", _with("SELECT cohort, CAST(date_diff('month', cohort, month) AS INTEGER) AS age, count(*) AS customers, any_value(size) AS size, count(*) / any_value(size)::DOUBLE AS retention FROM (SELECT DISTINCT customer_id, CAST(date_trunc('month', order_time) AS DATE) AS month FROM sales) JOIN first USING (customer_id) JOIN (SELECT cohort, count(*) AS size FROM first GROUP BY 1) USING (cohort) GROUP BY ALL", "first AS (SELECT customer_id, CAST(date_trunc('month', min(order_time)) AS DATE) AS cohort FROM sales GROUP BY 1)"))
def _(spark, sf):
    return A.cohort_retention(V.sales(spark, sf))


@register("a26_funnel", "WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'click') AS b, bool_or(event_type = 'purchase') AS c FROM events GROUP BY 1) SELECT 0 AS step, 'view' AS name, count(*) FILTER (a) AS users FROM u UNION ALL SELECT 1, 'click', count(*) FILTER (a AND b) FROM u UNION ALL SELECT 2, 'purchase', count(*) FILTER (a AND b AND c) FROM u")
def _(spark, sf):
    return A.funnel(table(spark, sf, "events"), ["view", "click", "purchase"])


@register("a28_category_share", _with("SELECT category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS revenue, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM sales JOIN products USING (product_id) GROUP BY 1"))
def _(spark, sf):
    return A.category_share(V.sales(spark, sf).join(V.products(spark, sf), "product_id"), "category", "amount").withColumn("share", F.col("share").cast(D))


@register("a29_opex", "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer GROUP BY 1")
def _(spark, sf):
    return A.sums_by(table(spark, sf, "customer").withColumn("cost", F.col("c_acctbal").cast("decimal(18,2)")), ["c_mktsegment"], "cost")


DESCRIBE = "SELECT '{c}' AS name, count({c})::DOUBLE AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, quantile_cont({c}, 0.25)::DOUBLE AS q1, median({c})::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q3, max({c})::DOUBLE AS max FROM lineitem"


@register("a30_describe", " UNION ALL ".join(DESCRIBE.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, sf):
    out = A.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@register("a31_corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def _(spark, sf):
    return A.corr_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 8))


@register("a32_histogram", "SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def _(spark, sf):
    return A.histogram(table(spark, sf, "orders"), "o_totalprice", 30)


@register("a33_collapse_dim", "SELECT p_brand, arg_min(p_name, p_partkey) FILTER (p_size > 25) AS p_name, median(p_size) AS p_size FROM part GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("p_name", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(" "))
    return A.collapse_dim(p, "p_brand", "p_partkey", "p_name", "p_size")


@register("a34_regatta_measures", "SELECT count(DISTINCT l_suppkey) AS boats, count(DISTINCT l_orderkey) AS races, count(DISTINCT l_partkey) AS regattas, count(*) FILTER (l_linenumber = 1) AS winners, avg(l_quantity) AS avg_points, quantile_disc(l_quantity, 0.5) AS median_points, count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*) AS missing_pct FROM lineitem")
def _(spark, sf):
    fact = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("boat"), F.col("l_orderkey").alias("race"), F.col("l_partkey").alias("regatta"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").alias("points"), F.when(F.col("l_returnflag") != "R", 1).alias("elapsed"))
    return A.regatta_measures(fact).withColumn("missing_pct", F.col("missing_pct").cast(D))


@register("a35_cost_review", _with("SELECT service, total::DOUBLE AS total, round(total::DOUBLE / (sum(total) OVER ())::DOUBLE, 8) AS share, total > 0.4 * (sum(total) OVER ()) AS dominant, coalesce(recent, 0) > mean * 1.2 AS spike, total > 80000000 AS over_budget FROM (SELECT service, sum(cost) AS total, avg(cost) AS mean, avg(cost) FILTER (date_diff('day', day, (SELECT max(day) FROM costs)) < 7) AS recent FROM costs GROUP BY 1)", COSTS))
def _(spark, sf):
    return A.cost_review(_costs(spark, sf), 100_000_000).withColumn("share", F.round("share", 8))


@register("a36_cost_projection", _with("SELECT round(avg(c)::DOUBLE * 30, 2) AS projected, round(avg(c)::DOUBLE * 33, 2) AS padded FROM (SELECT day, sum(cost) AS c FROM costs GROUP BY 1) WHERE date_diff('day', day, (SELECT max(day) FROM costs)) < 7", COSTS))
def _(spark, sf):
    return A.cost_projection(_costs(spark, sf)).select(F.round("projected", 2).alias("projected"), F.round("padded", 2).alias("padded"))


@register("a37_latency_summary", "SELECT min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS success_rate FROM events")
def _(spark, sf):
    return A.latency_summary(table(spark, sf, "events"), "value", F.col("event_type") != "error")


@register("a40_entropy", "SELECT round(-sum(p * log2(p)), 8) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM part)::DOUBLE AS p FROM part GROUP BY p_name)")
def _(spark, sf):
    return A.entropy(table(spark, sf, "part"), "p_name").select(F.round("entropy", 8).alias("entropy"))


@register("a41_distinct_values", "SELECT DISTINCT p_type FROM part ORDER BY 1")
def _(spark, sf):
    return A.distinct_values(table(spark, sf, "part"), "p_type")


@register("a42_coverage_score", _with("SELECT 100 - sum(CASE WHEN quantity_on_hand <= 20 THEN quantity_on_hand ELSE 0 END) / sum(quantity_on_hand) * 100 AS score FROM inventory", views=INV))
def _(spark, sf):
    return A.coverage_score(V.inventory(spark, sf), 20)


@register("a43_sales_kpis", _with("SELECT region_id, CAST(date_trunc('month', event_time) AS DATE) AS month, CAST(sum(amount) AS DOUBLE) AS total FROM sales GROUP BY ALL"))
def _(spark, sf):
    return A.sums_by(V.sales(spark, sf), ["region_id", F.to_date(F.date_trunc("month", "event_time")).alias("month")], "amount")


@register("a44_app_log_stats", "SELECT upper(event_type) AS level, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (date_trunc('millisecond', ts) > (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 1 HOUR) AS last_hour FROM events WHERE event_id % 9 <> 0 GROUP BY ALL")
def _(spark, sf):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), F.upper("event_type"), F.lit(" - user "), F.col("user_id").cast("string"))
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 9 == 0, "no log line").otherwise(line).alias("line"))
    parsed = lines.select(S.parse_app_log(F.col("line")).alias("r")).where("r is not null").select("r.*")
    newest = table(spark, sf, "events").select(F.max(F.date_trunc("millisecond", "ts")))
    return A.app_log_stats(parsed, newest.scalar())


@register("a45_pipeline_health", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS products, count(*) / count(DISTINCT json_extract_string(props, '$.k'))::DOUBLE AS avg_views FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def _(spark, sf):
    return A.pipeline_health(P.trailing(V.events(spark, sf), "ts", 1))


@register("a46_monitoring_series", "WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, * FROM events), w AS (SELECT window_start, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS error_rate, count(*) FILTER (value > 150) AS dlq FROM e GROUP BY 1) SELECT window_start, event_type, count(*) / 3600.0::DOUBLE AS rate, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, avg(100.0 - value % 10) AS mean_quality, any_value(error_rate) AS error_rate, any_value(dlq) AS dlq FROM e JOIN w USING (window_start) GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events")
    return A.monitoring_series(e.withColumn("quality", 100.0 - F.col("value") % 10), 3600, e.where("value > 150"), "quality")


@register("a47_best_days", _with("SELECT day, revenue::DOUBLE AS revenue, revenue::DOUBLE / orders AS average_order FROM (SELECT CAST(event_time AS DATE) AS day, sum(amount) AS revenue, count(DISTINCT order_id) AS orders FROM sales GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 7"))
def _(spark, sf):
    return A.best_days(V.sales(spark, sf))


# ---- scalar functions ----

CLF_RE = r"'^(\S+) (\S+) (\S+) \[([^\]]+)\] \"([^\"]*)\" (\d{3}) (\d+|-)'"
CLF_CTE = V.SQL["log_lines"] + f""", parsed AS (SELECT event_id, regexp_extract(line, {CLF_RE}, 1) AS client_ip, regexp_extract(line, {CLF_RE}, 3) AS usr, CAST(strptime(regexp_extract(line, {CLF_RE}, 4), '%d/%b/%Y:%H:%M:%S %z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS "timestamp", regexp_extract(line, {CLF_RE}, 5) AS request_line, CAST(regexp_extract(line, {CLF_RE}, 6) AS INTEGER) AS status_code, CAST(regexp_extract(line, {CLF_RE}, 7) AS BIGINT) AS response_size FROM log_lines WHERE line NOT LIKE 'broken%')"""


@register("f1_parse_clf", "WITH " + CLF_CTE + ' SELECT event_id, client_ip, usr, "timestamp", status_code, response_size FROM parsed')
def _(spark, sf):
    r = V.logs(spark, sf).withColumn("r", S.parse_clf(F.col("line"))).where("r is not null")
    return r.select("event_id", "r.client_ip", F.col("r.user").alias("usr"), "r.timestamp", "r.status_code", "r.response_size")


@register("f2_f4_request_parts", "WITH " + CLF_CTE + " SELECT event_id, split_part(request_line, ' ', 1) AS method, split_part(split_part(request_line, ' ', 2), '?', 1) AS endpoint, (status_code // 100) || 'xx' AS class, status_code BETWEEN 400 AND 599 AS error, status_code >= 500 AS server_error FROM parsed")
def _(spark, sf):
    r = V.logs(spark, sf).withColumn("r", S.parse_clf(F.col("line"))).where("r is not null")
    q, c = F.col("r.request_line"), F.col("r.status_code")
    return r.select("event_id", S.http_method(q).alias("method"), S.endpoint(q).alias("endpoint"), S.status_class(c).alias("class"), S.is_error(c).alias("error"), S.is_server_error(c).alias("server_error"))


@register("f5_strip_control", "SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x1F]', '', 'g')) AS h FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.strip_control(F.col("text"))).alias("h"))


@register("f6_f9_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts) AS parsed, make_timestamp(event_id * 1000000) AS from_ms, CAST(date_trunc('week', ts) AS DATE) AS week FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("iso", S.format_iso(F.col("ts")))
    return e.select("event_id", "iso", S.parse_iso(F.col("iso")).alias("parsed"), S.from_millis(F.col("event_id") * 1000).alias("from_ms"), S.week_start(F.col("ts")).alias("week"))


@register("f10_f11_durations", "SELECT event_id, CAST(event_id AS DOUBLE) AS seconds, (event_id // 3600) || ':' || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS hms FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("hms", S.to_hms(F.col("event_id")))
    return e.select("event_id", S.to_seconds(F.col("hms")).alias("seconds"), "hms")


DURATIONS = {0: "05:30.7", 1: "1.5", 2: "-5", 3: "0.25", 4: "1:00:00", 5: "a:b", 6: "", 7: "90", 8: "1:2:3:4", 9: "0"}


@register("f10_duration_forms", "SELECT event_id, CASE event_id % 10 WHEN 0 THEN 330.0 WHEN 3 THEN 21600.0 WHEN 4 THEN 3600.0 WHEN 7 THEN 90.0 WHEN 9 THEN 0.0 END AS seconds FROM events")
def _(spark, sf):
    """Forms that are times, and others that are none: fractions of seconds don't count, numbers that are neither whole nor below 1 are no times."""
    text = F.element_at(F.create_map(*[F.lit(x) for pair in DURATIONS.items() for x in pair]), (F.col("event_id") % 10).cast("int"))
    return table(spark, sf, "events").select("event_id", S.to_seconds(text).alias("seconds"))


@register("f12_normalize_name", "SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS h FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.normalize_name(F.col("text"))).alias("h"))


@register("f12_nfkd", "SELECT doc_id, md5(strip_accents(lower(text))) AS h FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.nfkd(F.col("text"))).alias("h"))


@register("f13_canonical_gtin", "SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR || '12345678') IN (8, 12, 13, 14) THEN lpad(p_partkey::VARCHAR || '12345678', 14, '0') END AS gtin FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.canonical_gtin(F.concat(F.col("p_partkey").cast("string"), F.lit("-1234 5678"))).alias("gtin"))


@register("f14_f16_tokens", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['small', 'ring'])) / len(list_distinct(list_concat(string_split(p_name, ' '), ['small', 'ring'])))::DOUBLE AS similarity, 'x' || p_size || 'b' AS model FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("model", F.concat(F.col("p_name"), F.lit(" X"), F.col("p_size").cast("string"), F.lit("b")))
    return p.select("p_partkey", S.jaccard(S.tokens(F.col("p_name")), F.array(F.lit("small"), F.lit("ring"))).alias("similarity"), F.get(S.model_tokens(F.col("model")), F.lit(0)).alias("model"))


@register("f15_stable_uid", "SELECT p_partkey, left(sha1(p_brand || '|' || p_name), 16) AS uid FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.stable_uid(F.concat_ws("|", "p_brand", "p_name")).alias("uid"))


@register("f17_edit_ratio", "SELECT p_partkey, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE AS ratio FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.edit_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


#: The longest common block of each piece is the greatest of all (length, first place in a, first place in b); what is left and right of it are two more pieces.
RATIO = """ratio_of(a, b, ratio) AS (
  WITH RECURSIVE piece(a, b, a0, a1, b0, b1, best) AS (
    SELECT a, b, 0, length(a), 0, length(b), 0::BIGINT FROM names
    UNION ALL SELECT a, b, side[1], side[2], side[3], side[4], best FROM (
      SELECT a, b, found AS best, unnest([[a0, i, b0, j], [i + n, a1, j + n, b1]]) AS side FROM (
        SELECT *, found // 1000000 AS n, 999 - found // 1000 % 1000 AS i, 999 - found % 1000 AS j FROM (
          SELECT *, coalesce(list_max(flatten(list_transform(range(a0, a1), lambda i: list_transform(range(b0, b1), lambda j: 1000000 * coalesce(list_max(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda k: substr(a, (i + 1)::BIGINT, k) = substr(b, (j + 1)::BIGINT, k))), 0) + 1000 * (999 - i) + 999 - j)))), 0) AS found FROM piece WHERE a0 < a1 AND b0 < b1
        )) WHERE n > 0)
  ) SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE sum(best // 1000000)::DOUBLE / (length(a) + length(b)) END FROM piece GROUP BY a, b)"""


@register("f17_seq_ratio", "WITH names AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part), " + RATIO + " SELECT p_partkey, ratio FROM part JOIN ratio_of ON a = p_name AND b = p_type")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.seq_ratio("p_name", "p_type").alias("ratio"))


@register("f18_parse_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("f19_explode_structs", _with("SELECT warehouse, sum(quantity_on_hand) AS units FROM inventory GROUP BY 1", views=INV))
def _(spark, sf):
    levels = A.inventory_levels(V.inventory(spark, sf)).select(F.inline("warehouse_breakdown"))
    return levels.groupBy("warehouse").agg(F.sum("quantity_on_hand").alias("units"))


@register("f20_math", "SELECT l_orderkey, l_partkey, l_suppkey, round(ln(l_extendedprice), 8) AS ln, abs(l_quantity - 25) AS away, greatest(l_quantity, 30) AS most, l_extendedprice / nullif(l_quantity - 1, 0) AS ratio FROM lineitem")
def _(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.round(F.ln("l_extendedprice"), 8).alias("ln"), F.abs(q - 25).alias("away"), F.greatest(q, F.lit(30.0)).alias("most"), F.try_divide(F.col("l_extendedprice"), q - 1).alias("ratio"))


@register("f22_dup_key", "SELECT event_id, md5(user_id || '|' || event_type || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.dup_key(F.col("user_id"), F.col("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("event_type"))).alias("k"))


ADVICE = "CASE WHEN e IS NULL THEN 'Keep price; insufficient data' WHEN e > -0.8 THEN 'Candidate +2–5% price (inelastic)' WHEN e < -1.2 AND u < 0.05 THEN 'Reduce discounts; focus on value' ELSE 'Monitor price; A/B small steps' END"


@register("f23_recommend", _with("SELECT product_id, " + ADVICE + " AS advice FROM (SELECT product_id, CASE WHEN count(*) >= 12 THEN round(regr_slope(ln(units), ln(price)), 6) END AS e, round(avg(units) FILTER (promo_share > 0) / avg(units) FILTER (promo_share = 0) - 1, 6) AS u FROM weekly GROUP BY 1)", WEEKLY))
def _(spark, sf):
    w = _weekly(spark, sf)
    both = A.promo_uplift(w, "product_id").join(A.elasticity(w, "product_id", 12), "product_id", "left")
    return both.select("product_id", S.recommend(F.round("elasticity", 6), F.round("uplift", 6)).alias("advice"))


@register("f24_parse_app_log", "SELECT event_id, date_trunc('millisecond', ts) AS ts, upper(event_type) AS level, 'user ' || user_id AS message FROM events")
def _(spark, sf):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), F.upper("event_type"), F.lit(" - user "), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", S.parse_app_log(line).alias("r")).select("event_id", "r.*")
