"""Queries of quality rules, windowed metrics (batch form), matching and composite pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions import scalars as S
from tabulon.operators import aggregates as A
from tabulon.operators import cleaning as P
from tabulon.operators import joins as J
from tabulon.operators import quality as Q
from tabulon.operators import windows as W
from tabulon.operators.graph import connected_components
from tabulon.plans import forecasting, matching, pipelines
from tabulon.plans import views as V
from tabulon.queries.analytics import CLF_CTE, COSTS, INV, RATIO, WEEKLY
from tabulon.queries.relational import STAGED, STAGED_DIM, STAGED_FACT, STOCK, _with, staged_products, staged_transactions
from tabulon.registry import register
from tabulon.session import table
from tabulon.streaming import metrics as R

D = "double"


def _transactions(spark, sf):
    """Line items as transactions, some of them wrong on purpose."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey") + F.col("l_partkey")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", F.when(k % 10 != 0, F.lit("P1")).alias("product"), F.when(k % 17 == 0, "x").otherwise("store 1").alias("store"), F.col("l_quantity").alias("quantity"), F.lit(2.5).alias("price"), F.when(k % 13 == 0, F.lit(5000.0)).otherwise(F.col("l_quantity") * 2.5).alias("total"), F.when(k % 3 == 0, "credit_card").otherwise("cash").alias("payment"))


def _rules():
    return [*Q.required("product"), *Q.short_text("store"), *Q.transaction_rules("quantity", "price", "total", "payment")]


TX = """tx AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_orderkey + l_partkey) % 10 = 0 AS r1, (l_orderkey + l_partkey) % 17 = 0 AS r2, (l_orderkey + l_partkey) % 13 = 0 AND l_quantity <> 2000 AS r3,
(l_orderkey + l_partkey) % 13 = 0 AND (l_orderkey + l_partkey) % 3 <> 0 AS r4 FROM lineitem)"""


@register("q4_q10_validate", "WITH " + TX + " SELECT l_orderkey, l_partkey, l_suppkey, concat_ws(',', CASE WHEN r1 THEN 'product_required' END, CASE WHEN r2 THEN 'store_short' END, CASE WHEN r3 THEN 'transaction_amount_calculation' END, CASE WHEN r4 THEN 'high_value_transaction_payment' END) AS errors, NOT (r1 OR r3) AS is_valid FROM tx")
def _(spark, sf):
    v = Q.validate(_transactions(spark, sf), _rules())
    return v.select("l_orderkey", "l_partkey", "l_suppkey", F.array_join(F.transform("validation_errors", lambda e: e["rule_name"]), ",").alias("errors"), "is_valid")


@register("q11_route", "WITH " + TX + " SELECT CASE WHEN NOT (r1 OR r3) THEN 'valid' WHEN r1 THEN 'dead' ELSE 'invalid' END AS route, count(*) AS n FROM tx GROUP BY 1")
def _(spark, sf):
    parts = Q.route(Q.validate(_transactions(spark, sf), _rules()))
    named = [p.select(F.lit(n).alias("route")) for p, n in zip(parts, ("valid", "dead", "invalid"), strict=True)]
    return W.union_all(*named).groupBy("route").agg(F.count("*").alias("n"))


@register("q2_expect_or_drop", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def _(spark, sf):
    return Q.expect_or_drop(table(spark, sf, "orders"), "price", F.col("o_totalprice") > 100000)[0].select("o_orderkey")


@register("q1_expect_or_fail", "SELECT o_orderkey FROM orders")
def _(spark, sf):
    return Q.expect_or_fail(table(spark, sf, "orders"), "key", F.col("o_orderkey") >= 0).select("o_orderkey")


@register("q3_violations", "SELECT 'orders' AS \"table\", 'cheap' AS expectation, count(*) FILTER (NOT o_totalprice < 100000) AS violations FROM orders UNION ALL SELECT 'orders', 'final', count(*) FILTER (o_orderstatus <> 'F') FROM orders")
def _(spark, sf):
    return Q.violations(table(spark, sf, "orders"), "orders", {"cheap": F.col("o_totalprice") < 100000, "final": F.col("o_orderstatus") == "F"})


@register("q6_duplicates", "SELECT l_orderkey, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_duplicate FROM lineitem")
def _(spark, sf):
    return Q.duplicate_rule(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_suppkey", "is_duplicate")


def _typed_events(spark, sf):
    """Events as texts of three types and an unknown one, some of them wrong on purpose."""
    k, n = F.col("event_id"), F.col("event_id").cast("string")
    kind = F.element_at(F.array(F.lit("click"), F.lit("transaction"), F.lit("stock"), F.lit("other")), (k % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", "ts", kind.alias("event_type"), F.when(k % 7 == 0, F.concat(F.lit("item "), n)).otherwise(F.concat(F.lit("product_"), n)).alias("product_id"), F.when(k % 5 != 0, F.concat(F.lit("user_"), n)).alias("user_id"),
        F.concat(F.lit("store_"), n).alias("store_id"), F.lit("warehouse_1").alias("warehouse_id"), F.when(k % 3 == 0, "x").otherwise((k % 1500).cast("string")).alias("quantity"), F.lit("2.5").alias("unit_price"),
        F.when(k % 3 != 1, (k % 30 * 1000 - 15000).cast("string")).alias("quantity_change"), F.when(k % 6 == 0, "").otherwise("EUR").alias("currency"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
    )


TYPED = """te AS (SELECT event_id, ts, event_id % 4 AS t, event_id % 7 = 0 AS bad_product, event_id % 5 = 0 AS no_user, event_id % 3 = 0 AS no_number, event_id % 1500 AS q, event_id % 30 * 1000 - 15000 AS c, event_id % 3 <> 1 AS has_c, event_id % 6 = 0 AS no_currency FROM events)"""


@register("q4_schema_rules", "WITH " + TYPED + """ SELECT event_id, concat_ws(',', CASE WHEN t = 3 THEN 'valid_event_type:event_type' END, CASE WHEN t = 0 AND no_user THEN 'required_field:user_id' END, CASE WHEN t = 0 AND bad_product THEN 'field_pattern:product_id' END,
CASE WHEN t = 1 AND no_number THEN 'field_type:quantity' END, CASE WHEN t = 1 AND bad_product THEN 'field_pattern:product_id' END, CASE WHEN t = 1 AND no_currency THEN 'field_pattern:currency' END, CASE WHEN t = 1 AND NOT no_number AND q NOT BETWEEN 1 AND 1000 THEN 'field_range:quantity' END,
CASE WHEN t = 2 AND NOT has_c THEN 'required_field:quantity_change' END, CASE WHEN t = 2 AND bad_product THEN 'field_pattern:product_id' END, CASE WHEN t = 2 AND has_c AND c NOT BETWEEN -10000 AND 10000 THEN 'field_range:quantity_change' END) AS errors FROM te""")
def _(spark, sf):
    e = _typed_events(spark, sf)
    named = F.transform("validation_errors", lambda x: F.concat(x["rule_name"], F.lit(":"), x["field"]))
    return Q.validate(e, Q.schema_rules(e.columns)).select("event_id", F.array_join(named, ",").alias("errors"))


@register("q5_completeness_rules", "WITH " + TYPED + " SELECT event_id, concat_ws(',', CASE WHEN no_currency THEN 'data_completeness:currency' END, CASE WHEN no_number OR q < 10 THEN 'data_completeness:quantity' END, CASE WHEN t = 0 THEN 'important_field_missing:session_id' END, CASE WHEN t = 0 THEN 'important_field_missing:page_type' END, CASE WHEN t = 1 AND no_currency THEN 'important_field_missing:currency' END, CASE WHEN t = 1 THEN 'important_field_missing:payment_method' END, CASE WHEN t = 2 THEN 'important_field_missing:reason' END) AS errors, true AS is_valid FROM te")
def _(spark, sf):
    e = _typed_events(spark, sf)
    named = F.transform("validation_errors", lambda x: F.concat(x["rule_name"], F.lit(":"), x["field"]))
    return Q.validate(e, Q.completeness_rules(e.columns, ["currency", "quantity"])).select("event_id", F.array_join(named, ",").alias("errors"), "is_valid")


@register("q6_window_duplicates", "SELECT event_id, event_type IN ('click', 'view') AND count(*) OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts), event_type IN ('click', 'view'), user_id % 20, event_type) > 1 AS is_duplicate FROM events")
def _(spark, sf):
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "stock").otherwise("other")
    u = (F.col("user_id") % 20).cast("string")
    e = table(spark, sf, "events").select("event_id", "ts", kind.alias("event_type"), u.alias("user_id"), u.alias("product_id"), F.lit("w").alias("warehouse_id"), F.lit("t").alias("timestamp"))
    return Q.window_duplicates(e, "ts", "1 hour").select("event_id", "is_duplicate")


@register("q8_stock_rules", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'large_stock_change_reason,negative_stock_reason' WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN 'negative_stock_reason' ELSE 'large_stock_change_reason' END AS errors, true AS is_valid FROM events")
def _(spark, sf):
    m = F.col("event_id") % 4
    e = table(spark, sf, "events").select("event_id", F.when(m == 0, -2000).when(m == 1, -5).when(m == 2, -6).otherwise(1001).alias("change"), F.when(m == 1, "damaged").when(m == 2, "restock").when(m == 3, "transfer").alias("reason"))
    return Q.validate(e, Q.stock_rules("change", "reason")).select("event_id", F.array_join(F.transform("validation_errors", lambda x: x["rule_name"]), ",").alias("errors"), "is_valid")


@register("q9_click_rules", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 OR user_id = 0 THEN 'session_id_range' ELSE '' END AS errors, true AS is_valid FROM events")
def _(spark, sf):
    m = F.col("event_id") % 5
    e = table(spark, sf, "events").select("event_id", F.when(m == 0, "session_abc").when(m == 1, "session_1000001").otherwise(F.concat(F.lit("session_"), F.col("user_id").cast("string"))).alias("session"))
    return Q.validate(e, Q.click_rules("session")).select("event_id", F.array_join(F.transform("validation_errors", lambda x: x["rule_name"]), ",").alias("errors"), "is_valid")


@register("q12_table_gates", _with("SELECT 'product_price' AS gate, count(*) FILTER (NOT price > 0) AS n, count(*) FILTER (NOT price > 0) = 0 AS passed FROM products UNION ALL SELECT 'sale_quantity', count(*) FILTER (NOT quantity > 0), count(*) FILTER (NOT quantity > 0) = 0 FROM sales UNION ALL SELECT 'sale_orphan', count(*), count(*) = 0 FROM sales WHERE product_id NOT IN (SELECT product_id FROM products)"))
def _(spark, sf):
    return Q.table_gates(V.products(spark, sf), V.sales(spark, sf))


@register("q13_check_unique", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 10")
def _(spark, sf):
    return Q.check_unique(table(spark, sf, "lineitem"), "l_orderkey")


@register("q14_check_fk", "SELECT count(*) AS orphans, count(DISTINCT l_partkey) AS orphan_keys FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def _(spark, sf):
    return Q.check_fk(table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_size > 5"), "l_partkey", "p_partkey")


@register("q15_completeness", "SELECT 'text' AS name, avg(CASE WHEN text IS NOT NULL THEN 100 ELSE 0 END)::DOUBLE AS percent, avg(CASE WHEN text IS NOT NULL THEN 100 ELSE 0 END) >= 95 AS passed FROM documents UNION ALL SELECT 'toxic', count(toxic) * 100.0 / count(*), count(toxic) * 100.0 / count(*) >= 95 FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return Q.completeness(both, ["text", "toxic"])


@register("q17_audit_cash", "SELECT o_orderkey, abs(100 + o_totalprice - o_totalprice - CASE WHEN o_orderkey % 50 = 0 THEN 90 ELSE 100 END) < 0.01 AS ok FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.lit(100.0).alias("begin_balance"), F.col("o_totalprice").alias("inflows"), F.col("o_totalprice").alias("outflows"), F.when(F.col("o_orderkey") % 50 == 0, 90.0).otherwise(100.0).alias("end_balance"))
    return Q.audit_cash(o).select("o_orderkey", "ok")


@register("q18_audit_cost_of_sales", "SELECT l_orderkey, l_partkey, l_suppkey, abs(l_extendedprice / l_quantity * l_quantity - CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_extendedprice END) < 0.01 AS ok FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"unit_cost": F.col("l_extendedprice") / F.col("l_quantity"), "units_sold": F.col("l_quantity"), "total_cost": F.when(F.col("l_partkey") % 9 == 0, 0.0).otherwise(F.col("l_extendedprice"))})
    return Q.audit_cost_of_sales(li).select("l_orderkey", "l_partkey", "l_suppkey", "ok")


@register("q19_audit_ppe", "SELECT p_partkey, p_partkey % 6 <> 0 AS ok FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("acquisition_cost"), F.lit(10.0).alias("accum_depreciation"), (F.col("p_retailprice") - F.when(F.col("p_partkey") % 6 == 0, 11.0).otherwise(10.0)).alias("net_book_value"))
    return Q.audit_ppe(p).select("p_partkey", "ok")


@register("q20_alert_thresholds", """WITH c AS (SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS w, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1), cal AS (SELECT unnest(generate_series((SELECT min(w) FROM c), (SELECT max(w) FROM c), INTERVAL 10 MINUTES)) AS w)
SELECT cal.w AS window_start, coalesce(n, 0) AS n, coalesce(e, 0) AS errors, coalesce(n, 0) / 600.0 < 0.003 AS low_volume, CASE WHEN e / n::DOUBLE > 0.5 THEN 'critical' WHEN e / n::DOUBLE > 0.1 THEN 'warning' ELSE 'ok' END AS error_level FROM cal LEFT JOIN c ON cal.w = c.w""")
def _(spark, sf):
    return Q.alert_thresholds(table(spark, sf, "events"), 600, 0.003)


@register("q21_check_fresh", "SELECT count(*) FILTER (ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 MINUTES) > 0 AS fresh FROM events")
def _(spark, sf):
    return Q.check_fresh(table(spark, sf, "events"), "ts", 30, F.lit("2024-01-20").cast("timestamp"))


@register("a38_dq_counters", "WITH " + TX + " SELECT count(*) AS total, count(*) FILTER (NOT (r1 OR r3)) AS valid, count(*) FILTER (r1 OR r3) AS invalid, sum(d::INT)::BIGINT AS duplicates, count(*) FILTER (r1) AS missing, sum(r1::INT + r2::INT + r3::INT + r4::INT)::BIGINT AS rule_violations FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1 AS d FROM tx)")
def _(spark, sf):
    return Q.dq_counters(Q.duplicate_rule(Q.validate(_transactions(spark, sf), _rules()), ["l_orderkey", "l_partkey"]))


# ---- windowed metrics, on the batch form of their streams ----


def _logs(spark, sf):
    return R.parse_logs(V.logs(spark, sf))


MINUTE = 'time_bucket(INTERVAL 1 MINUTE, "timestamp")'


@register("r1_requests_per_minute", f"WITH {CLF_CTE} SELECT {MINUTE} AS window_start, {MINUTE} + INTERVAL 1 MINUTE AS window_end, count(*) AS requests FROM parsed GROUP BY 1, 2")
def _(spark, sf):
    return R.requests_per_minute(_logs(spark, sf))


@register("r2_errors_per_minute", f"WITH {CLF_CTE} SELECT {MINUTE} AS window_start, {MINUTE} + INTERVAL 1 MINUTE AS window_end, count(*) AS errors FROM parsed WHERE status_code >= 500 GROUP BY 1, 2")
def _(spark, sf):
    return R.errors_per_minute(_logs(spark, sf))


@register("r3_status_distribution", f"WITH {CLF_CTE} SELECT {MINUTE} AS window_start, {MINUTE} + INTERVAL 1 MINUTE AS window_end, (status_code // 100) || 'xx' AS status, count(*) AS n FROM parsed GROUP BY ALL")
def _(spark, sf):
    return R.status_distribution(_logs(spark, sf))


@register("r4_top_endpoints", f"WITH {CLF_CTE}, e AS (SELECT split_part(split_part(request_line, ' ', 2), '?', 1) AS endpoint, {MINUTE} - INTERVAL 1 MINUTE * k AS w FROM parsed, range(5) t(k)) SELECT w AS window_start, w + INTERVAL 5 MINUTES AS window_end, endpoint, count(*) AS hits FROM e GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return R.top_endpoints(_logs(spark, sf), 1)


@register("r5_gmv_per_minute", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS gmv, count(*) AS orders FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def _(spark, sf):
    return R.gmv_per_minute(table(spark, sf, "events").where("event_type = 'purchase'"))


@register("r6_orders_per_minute", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, count(*) AS orders FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def _(spark, sf):
    return R.orders_per_minute(table(spark, sf, "events").where("event_type = 'purchase'"))


@register("r8_product_views", "WITH " + V.SQL["ev"] + " SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, product_id, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY ALL")
def _(spark, sf):
    return R.product_counts(V.events(spark, sf).where("event_type = 'view'"), "1 minute")


@register("r7_top_products", "WITH " + V.SQL["ev"] + ", c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS window_start, product_id, count(*) AS n FROM ev, range(6) t(k) WHERE event_type = 'purchase' GROUP BY ALL) SELECT *, window_start + INTERVAL 6 HOURS AS window_end, CAST(row_number() OVER (PARTITION BY window_start ORDER BY n DESC, product_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 5")
def _(spark, sf):
    counts = R.product_counts(V.events(spark, sf).where("event_type = 'purchase'"), "6 hours", "1 hour")
    return W.top_n_per(counts, ["window_start", "window_end"], "n", 5, "product_id")


@register("r9_windowed_sums", "WITH " + V.SQL["ev"] + " SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end, product_id, s AS store_id, CAST(count(*) AS BIGINT) AS total FROM ev, unnest([CAST(store_id AS VARCHAR), 'ALL']) u(s) WHERE event_type = 'purchase' GROUP BY ALL")
def _(spark, sf):
    return R.windowed_sums(V.events(spark, sf).where("event_type = 'purchase'"), "store_id", F.lit(1), 300)


COUNTRIES = {"NATION_1": "Romania", "NATION_2": "Germany", "NATION_3": "France"}
COUNTRY_SQL = "CASE warehouse WHEN 'NATION_1' THEN 'Romania' WHEN 'NATION_2' THEN 'Germany' WHEN 'NATION_3' THEN 'France' ELSE 'Unknown' END"
ENRICHED = f"e AS (SELECT sales.*, category, {COUNTRY_SQL} AS country, CAST(amount - CAST(quantity AS DECIMAL(18,4)) * CAST(price AS DECIMAL(18,4)) AS DECIMAL(18,2)) AS margin FROM sales JOIN products USING (product_id) WHERE size > 2)"


def _country():
    return P.lookup(F.col("warehouse"), COUNTRIES, "Unknown")


def _reference(spark, sf):
    """Products of which the reference table knows name and cost."""
    return V.products(spark, sf).where("size > 2").select("product_id", "product_name", "category", F.col("price").alias("avg_cost"))


def _enriched(spark, sf):
    return R.enrich_stream(V.sales(spark, sf).withColumn("country", _country()), _reference(spark, sf))


SLIDING = "SELECT w AS window_start, w + INTERVAL 3 DAYS AS window_end, warehouse, country, CAST(sum(amount) AS DOUBLE) AS revenue, sum(quantity) AS units, CAST(sum(margin) AS DOUBLE) AS margin, count(DISTINCT order_id) AS orders FROM (SELECT *, CAST(event_time AS DATE) - INTERVAL 1 DAY * k AS w FROM e, range(3) t(k)) GROUP BY ALL"


@register("r11_sales_performance", _with(SLIDING, ENRICHED))
def _(spark, sf):
    return R.sales_performance(_enriched(spark, sf)[0], "3 days", "1 day")


@register("r14_unknown_products", _with("SELECT order_id, line_no, product_id, warehouse, CAST(amount AS DOUBLE) AS amount FROM sales WHERE product_id NOT IN (SELECT product_id FROM products WHERE size > 2)"))
def _(spark, sf):
    return _enriched(spark, sf)[1].select("order_id", "line_no", "product_id", "warehouse", F.col("amount").cast(D).alias("amount"))


@register("r12_order_anomalies", _with("SELECT window_start, window_start + INTERVAL 30 DAYS AS window_end, order_id, warehouse, country, units, order_total, q1, q3, q3 - q1 AS iqr, q3 <> q1 AND (order_total < q1 - 1.5 * (q3 - q1) OR order_total > q3 + 1.5 * (q3 - q1)) AS is_anomalous FROM w JOIN q USING (window_start, warehouse)", f"t AS (SELECT order_id, warehouse, {COUNTRY_SQL} AS country, max(event_time) AS last_time, sum(quantity) AS units, CAST(sum(amount) AS DOUBLE) AS order_total FROM sales GROUP BY ALL), w AS (SELECT t.*, time_bucket(INTERVAL 15 DAYS, last_time, TIMESTAMP '1970-01-01') - INTERVAL 15 DAY * k AS window_start FROM t, range(2) r(k)), q AS (SELECT window_start, warehouse, quantile_disc(order_total, 0.25) AS q1, quantile_disc(order_total, 0.75) AS q3 FROM w GROUP BY ALL)", views=("sales",)))
def _(spark, sf):
    totals = A.order_totals(V.sales(spark, sf).withColumn("country", _country()), "country")
    return R.order_anomalies(totals, 1.5, "30 days", "15 days", accuracy=10_000).drop("last_time")


@register("r15_parse_events", "SELECT event_id % 6 AS kind, CASE WHEN event_id % 6 = 0 THEN 'malformed' WHEN event_id % 6 = 1 THEN 'missing: qty' END AS error, CASE WHEN event_id % 6 > 1 THEN 2 END AS qty, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    m = F.col("event_id") % 6
    raw = table(spark, sf, "events").select(m.alias("kind"), F.when(m == 0, "oops").when(m == 1, '{"product_id": "P1"}').otherwise('{"product_id": "P1", "qty": 2}').alias("value"))
    return R.parse_events(raw, "product_id string, qty int", ["product_id", "qty"], keep=["kind"]).groupBy("kind", "error", "qty").agg(F.count("*").alias("n"))


@register("r21_inspect_dlq", "SELECT 'malformed' AS error, count(*) AS n, 'oops' AS example FROM events WHERE event_id % 6 = 0")
def _(spark, sf):
    raw = table(spark, sf, "events").select(F.when(F.col("event_id") % 6 == 0, "oops").otherwise('{"product_id": "P1"}').alias("value"))
    return R.inspect_dlq(R.dead_letters(R.parse_events(raw, "product_id string", ["product_id"])), 10)


@register("k7_serving_rows", "WITH " + V.SQL["ev"] + ", c AS (SELECT product_id, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS e, count(*) AS n FROM ev GROUP BY ALL) SELECT product_id AS row_key, 'stats' AS family, 'view_count' AS qualifier, CAST(arg_max(n, e) AS VARCHAR) AS value, max(e) AS cell_ts FROM c GROUP BY product_id")
def _(spark, sf):
    return R.to_serving_rows(R.product_counts(V.events(spark, sf), "1 hour"))


@register("j14_error_rate", f"WITH {CLF_CTE}, q AS (SELECT {MINUTE} AS window_start, count(*) AS requests, count(*) FILTER (status_code >= 500) AS errors FROM parsed GROUP BY 1) SELECT window_start, requests, errors, errors * 100.0::DOUBLE / requests AS error_rate FROM q")
def _(spark, sf):
    return R.error_rate(_logs(spark, sf)).select("window_start", "requests", "errors", "error_rate")


@register("a27_log_summary", f"WITH {CLF_CTE} SELECT 'total' AS kind, 'lines' AS key, count(*) AS n FROM log_lines UNION ALL SELECT 'total', 'parsed', count(*) FROM parsed UNION ALL SELECT 'total', 'errors', count(*) FROM parsed WHERE status_code >= 400 UNION ALL SELECT 'class', (status_code // 100) || 'xx', count(*) FROM parsed GROUP BY 2 UNION ALL SELECT 'method', split_part(request_line, ' ', 1), count(*) FROM parsed GROUP BY 2 UNION ALL SELECT 'endpoint', split_part(split_part(request_line, ' ', 2), '?', 1), count(*) FROM parsed GROUP BY 2")
def _(spark, sf):
    r = V.logs(spark, sf).withColumn("r", S.parse_clf(F.col("line")))
    q, c = F.col("r.request_line"), F.col("r.status_code")
    return A.log_summary(r, F.col("r"), S.status_class(c), S.http_method(q), S.endpoint(q), c)


# ---- composite pipelines ----


@register("c5_connected_components", "SELECT n_nationkey AS id, n_nationkey AS component FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) UNION ALL SELECT c_custkey + 1000, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_orderkey + 1000000000, c_nationkey FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    """Nations, customers and orders: each customer hangs on a nation, a customer's orders are a chain from it."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("k"), "o_custkey").distinct()
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))
    chain = o.withColumn("before", F.lag("k").over(Window.partitionBy("o_custkey").orderBy("k"))).join(c, F.col("o_custkey") == F.col("c_custkey"))
    steps = chain.select(F.col("k").alias("src"), F.coalesce("before", F.col("c_custkey") + 1000).alias("dst"))
    return connected_components(steps.union(chain.select((F.col("c_custkey") + 1000).alias("src"), F.col("nation").alias("dst"))))


@register("c4_deduplicate")
def _(spark, sf):
    p = V.products(spark, sf)
    return matching.deduplicate(p.withColumn("name", F.col("product_name")), "product_id")


MODELS = """item AS (SELECT p_partkey AS id, p_brand AS brand, name, string_split(name, ' ') AS words, list_sort(string_split(name, ' ')) AS ordered, 'mx' || p_partkey % 40 || 'b' AS model
  FROM (SELECT *, p_name || ' mx' || p_partkey % 40 || 'b' || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' large' ELSE ' larger' END AS name FROM part)),
block AS (SELECT id, '3' || words[1] || ':' || words[2] || ':' || words[3] AS k FROM item UNION ALL SELECT id, 't' || brand || ':' || model FROM item UNION ALL SELECT id, 'x' || array_to_string(ordered[1:5], ':') FROM item),
pair AS (SELECT DISTINCT x.id AS a, y.id AS b FROM block x JOIN block y ON x.k = y.k AND x.id < y.id),
rest AS (SELECT p.a, p.b, x.name AS na, y.name AS nb, 0.4::DOUBLE * len(list_intersect(x.words, y.words)) / len(list_distinct(x.words || y.words)) + CASE WHEN x.model = y.model THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN x.brand = y.brand THEN 0.1::DOUBLE ELSE 0 END AS rest FROM pair p JOIN item x ON x.id = p.a JOIN item y ON y.id = p.b),
names AS (SELECT DISTINCT na AS a, nb AS b FROM rest WHERE rest > 0.599), """ + RATIO + """,
linked AS (SELECT rest.a, rest.b, rest + 0.2::DOUBLE * ratio AS score FROM rest JOIN ratio_of r ON r.a = na AND r.b = nb WHERE rest + 0.2::DOUBLE * ratio >= 0.8)"""


def _models(spark, sf):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" mx"), (k % 40).cast("string"), F.lit("b"), F.when(k % 3 == 0, "").when(k % 3 == 1, " large").otherwise(" larger"))
    return table(spark, sf, "part").select(k.alias("id"), name.alias("name"), F.col("p_brand").alias("brand"))


@register("c4_similar_pairs", "WITH " + MODELS + " SELECT a, b, round(score, 6) AS score FROM linked")
def _(spark, sf):
    rows = matching.prepared(_models(spark, sf), "id")
    return matching.every_similar_pair(rows, 0.8).select("a", "b", F.round("score", 6).alias("score"))


@register("c4_components", "WITH RECURSIVE " + MODELS + ", edge AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked), reach AS (SELECT id AS a, id AS b FROM item UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b) SELECT a AS id, min(b) AS component FROM reach GROUP BY a")
def _(spark, sf):
    return matching.deduplicate(_models(spark, sf), "id")


@register("c6_canonical_records", """WITH r AS (SELECT p_brand AS component, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_type, p_retailprice AS price, CASE WHEN p_partkey % 4 = 0 THEN '1234567' || p_partkey % 2 END AS gtin, 'u' || p_size AS url FROM part),
n AS (SELECT component, lower(name) AS norm, count(*) AS c, max(length(name)) AS l, arg_max(name, (length(name), name)) AS t FROM r GROUP BY ALL), best AS (SELECT component, arg_max(t, (c, l, t)) AS name FROM n GROUP BY 1)
SELECT component, any_value(best.name) AS name, count(*) AS size, min(price) AS price_min, max(price) AS price_max, median(price) AS price_median, min(gtin) AS gtin, array_to_string(list_sort(list_distinct(list(url))), ',') AS urls,
left(sha1(coalesce(lpad(min(gtin), 14, '0'), regexp_replace(trim(lower(component)), '[^a-z0-9]+', ' ', 'g') || '|')), 16) AS uid FROM r JOIN best USING (component) GROUP BY 1""")
def _(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("component"), F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
        F.when(k % 4 == 0, F.concat(F.lit("1234567"), (k % 2).cast("string"))).alias("gtin"), F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("url"),
    )
    return matching.canonical_records(p).withColumn("urls", F.array_join("url_list", ",")).select("component", "name", "size", "price_min", "price_max", "price_median", "gtin", "urls", "uid")


@register("a39_dedup_summary", "SELECT count(*) AS records, count(DISTINCT p_brand || p_name) AS clusters, (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_brand || p_name HAVING count(*) > 1)) AS multi, count(*) / count(DISTINCT p_brand || p_name)::DOUBLE AS mean_size FROM part")
def _(spark, sf):
    return matching.dedup_summary(V.products(spark, sf).withColumn("component", F.concat("brand", "product_name")))


@register("a39_dedup_report", """WITH c AS (SELECT p_brand || p_name AS component, any_value(p_brand) AS brand, count(*) AS size FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY size DESC, component LIMIT 25), b AS (SELECT brand, count(*) AS n FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25)
SELECT 'size' AS section, CAST(size AS VARCHAR) AS label, count(*) AS value FROM c GROUP BY size UNION ALL SELECT 'cluster', component, size FROM t UNION ALL SELECT 'brand', brand, n FROM b""")
def _(spark, sf):
    p = V.products(spark, sf).withColumn("component", F.concat("brand", "product_name"))
    return matching.dedup_report(p.groupBy("component").agg(F.first("brand").alias("brand"), F.count("*").alias("size")))


STOCKED = """inv AS (SELECT warehouse, product_id, arg_max(quantity_on_hand, inventory_date) AS q, max(inventory_date) AS inventory_date FROM inventory WHERE product_id % 5 <> 0 GROUP BY ALL),
so AS (SELECT warehouse, product_id, sum(quantity) AS sold, max(event_time) AS new_sale, CAST(sum(amount) AS DOUBLE) AS revenue FROM sales WHERE event_time >= (SELECT max(event_time) FROM sales) - INTERVAL 365 DAYS GROUP BY ALL)"""


def _stock(spark, sf):
    inventory = V.inventory(spark, sf).where("product_id % 5 <> 0").withColumns({"last_sale": F.lit(None).cast("timestamp"), "lifetime_revenue": F.lit(None).cast(D)})
    return pipelines.update_stock(inventory, V.sales(spark, sf), 365, V.newest_sale(spark, sf))


@register("c3_update_stock", _with("SELECT warehouse, product_id, inventory_date, CASE WHEN sold IS NULL THEN q ELSE greatest(q - sold, 0) END AS quantity_on_hand, new_sale AS last_sale, revenue AS lifetime_revenue FROM inv LEFT JOIN so USING (warehouse, product_id)", STOCKED, views=INV))
def _(spark, sf):
    return _stock(spark, sf)["inventory"].select("warehouse", "product_id", "inventory_date", "quantity_on_hand", "last_sale", "lifetime_revenue")


@register("c3_rejected_sales", _with("SELECT warehouse, product_id, sold, 'unknown product' AS reason FROM so WHERE NOT EXISTS (SELECT 1 FROM inv WHERE inv.warehouse = so.warehouse AND inv.product_id = so.product_id)", STOCKED, views=INV))
def _(spark, sf):
    return _stock(spark, sf)["rejected"].select("warehouse", "product_id", "sold", "reason")


@register("q16_check_stock", _with("SELECT count(*) AS rows, count(*) FILTER (greatest(before - coalesce(sold, 0), 0) <> after) AS inconsistent, count(*) FILTER (after < 0) AS negative FROM prev JOIN cur USING (warehouse, product_id) LEFT JOIN sold USING (warehouse, product_id)", STOCK))
def _(spark, sf):
    s = V.sales(spark, sf)
    by = lambda cond: s.where(cond).groupBy("warehouse", "product_id").agg(F.sum("quantity").alias("quantity"))
    return Q.check_stock(J.reconcile_stock(by("channel <> 'R'"), by("channel = 'N'"), by("channel = 'A'")))


ADVISED = """own AS (SELECT product_id, regr_slope(ln(units), ln(price)) AS e, count(*) AS n FROM weekly GROUP BY 1 HAVING count(*) >= 12), cat AS (SELECT category, regr_slope(ln(units), ln(weekly.price)) AS e FROM weekly JOIN products USING (product_id) GROUP BY 1 HAVING count(*) >= 50),
up AS (SELECT product_id, avg(units) FILTER (promo_share > 0) / nullif(avg(units) FILTER (promo_share = 0), 0) - 1 AS uplift FROM weekly GROUP BY 1),
f AS (SELECT products.product_id, products.category, coalesce(own.e, cat.e) AS e, own.n AS n, up.uplift FROM products LEFT JOIN own USING (product_id) LEFT JOIN cat ON products.category = cat.category LEFT JOIN up ON up.product_id = products.product_id)"""


@register("c9_price_elasticity", _with("SELECT product_id, category, round(e, 5) AS elasticity, n, round(uplift, 5) AS uplift, CASE WHEN e IS NULL THEN 'Keep price; insufficient data' WHEN e > -0.8 THEN 'Candidate +2–5% price (inelastic)' WHEN e < -1.2 AND n IS NOT NULL AND uplift < 0.05 THEN 'Reduce discounts; focus on value' ELSE 'Monitor price; A/B small steps' END AS advice FROM f", WEEKLY, ADVISED))
def _(spark, sf):
    w = A.weekly_product(V.sales(spark, sf), F.col("discount") > 0.05)
    return pipelines.price_elasticity(w, V.products(spark, sf)).select("product_id", "category", F.round("elasticity", 5).alias("elasticity"), "n", F.round("uplift", 5).alias("uplift"), "advice")


MONTHLY = "m AS (SELECT region_id, CAST(date_trunc('month', event_time) AS DATE) AS month, CAST(sum(amount) AS DOUBLE) AS v FROM sales GROUP BY ALL)"


def _monthly(spark, sf):
    return V.sales(spark, sf).groupBy("region_id", F.to_date(F.date_trunc("month", "event_time")).alias("month")).agg(A.total("amount").alias("v"))


@register("c10_seasonal_naive", _with("SELECT region_id, CAST(last + INTERVAL 1 MONTH * k AS DATE) AS month, round(avg(v), 2) AS forecast FROM (SELECT region_id, max(month) AS last FROM m GROUP BY 1) l CROSS JOIN range(1, 4) t(k) JOIN m USING (region_id) WHERE month(m.month) = month(last + INTERVAL 1 MONTH * k) GROUP BY ALL", MONTHLY))
def _(spark, sf):
    return forecasting.seasonal_naive(_monthly(spark, sf), ["region_id"], "month", "v", 3).withColumn("forecast", F.round("forecast", 2))


@register("c11_backtest", _with("SELECT region_id, round(avg(abs(f - v)), 2) AS mae, round(avg(f - v), 2) AS bias, count(*) AS folds FROM (SELECT region_id, v, coalesce(lag(v, 12) OVER w, lag(v) OVER w) AS f, row_number() OVER (PARTITION BY region_id ORDER BY month DESC) AS rn FROM m WINDOW w AS (PARTITION BY region_id ORDER BY month)) WHERE rn <= 6 AND f IS NOT NULL GROUP BY 1", MONTHLY))
def _(spark, sf):
    out = forecasting.backtest(_monthly(spark, sf), ["region_id"], "month", "v", 6)
    return out.select("region_id", F.round("mae", 2).alias("mae"), F.round("bias", 2).alias("bias"), "folds")


@register("c10_weekday_forecast", _with("SELECT region_id, CAST(last + INTERVAL 1 DAY * k AS DATE) AS day, round(avg(v), 4) AS forecast FROM (SELECT region_id, max(day) AS last FROM d GROUP BY 1) l CROSS JOIN range(1, 31) t(k) JOIN d USING (region_id) WHERE date_diff('day', d.day, last) < 56 AND dayofweek(d.day) = dayofweek(last + INTERVAL 1 DAY * k) GROUP BY ALL", "d AS (SELECT region_id, CAST(event_time AS DATE) AS day, sum(quantity) AS v FROM sales GROUP BY ALL)", views=("sales",)))
def _(spark, sf):
    daily = V.sales(spark, sf).groupBy("region_id", F.to_date("event_time").alias("day")).agg(F.sum("quantity").alias("v"))
    return forecasting.weekday_forecast(daily, ["region_id"], "day", "v").withColumn("forecast", F.round("forecast", 4))


@register("j12_forecast_compare", _with("SELECT region_id, month, round(v, 1) AS v, round(f, 1) AS forecast, round(f - v, 1) AS error, round(abs((f - v) / v), 5) AS ape FROM (SELECT region_id, month, v, coalesce(lag(v, 12) OVER (PARTITION BY region_id ORDER BY month), lag(v) OVER (PARTITION BY region_id ORDER BY month)) AS f FROM m) WHERE month(month) <> 6", MONTHLY))
def _(spark, sf):
    monthly = _monthly(spark, sf)
    predicted = forecasting.one_step(monthly, ["region_id"], "month", "v").where(F.month("month") != 6).drop("v")
    out = J.merge_on_month(monthly, predicted, "month", "v", "forecast", ["region_id"])
    return out.select("region_id", "month", *[F.round(c, d).alias(c) for c, d in (("v", 1), ("forecast", 1), ("error", 1), ("ape", 5))])


RACES = """races AS (SELECT o_custkey % 50 AS regatta, l_linenumber AS race, CASE WHEN l_suppkey % 2 = 0 THEN 'cruising' ELSE 'CLUB' END AS division, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS rank, 'fr' || l_suppkey AS sail, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'boat ' || l_suppkey END AS boat, 'club' AS club,
l_extendedprice AS rating, l_discount AS points, CASE WHEN l_partkey % 3 <> 0 THEN '1:' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':05' END AS elapsed FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _star(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("o_custkey") % 50).alias("regatta"), F.col("l_linenumber").alias("race"), F.when(F.col("l_suppkey") % 2 == 0, "cruising").otherwise("CLUB").alias("division"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("rank"), F.concat(F.lit("fr"), F.col("l_suppkey").cast("string")).alias("sail"),
        F.when(F.col("l_partkey") % 2 == 0, "").otherwise(F.concat(F.lit("boat "), F.col("l_suppkey").cast("string"))).alias("boat"), F.lit("c1").alias("class"), F.lit("club").alias("club"), F.col("l_extendedprice").alias("rating"), F.col("l_discount").alias("points"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("1:"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":05"))).alias("elapsed"), F.lit(None).cast("string").alias("corrected"),
    )
    return pipelines.build_star(rows)


FACT = """fact AS (SELECT regatta, race, regatta || '-' || race AS race_key, regatta || '-' || race || '-Fr' || substr(sail, 3) AS fact_key, CASE WHEN division = 'CLUB' THEN 'Club' ELSE 'Cruising' END AS division, 'Fr' || substr(sail, 3) AS sail,
nullif(upper(left(boat, 1)) || substr(boat, 2), '') AS boat, 'C1' AS class, 'Club' AS club, CAST(rank AS BIGINT) AS rank, points, CASE WHEN elapsed IS NOT NULL THEN 3605.0 + 60 * race END AS elapsed, rank IS NOT NULL AND count(*) OVER (PARTITION BY regatta, race, division, rank) > 1 AS tied, rating FROM races)"""


@register("c12_fact_results", "WITH " + RACES + ", " + FACT + " SELECT *, CASE WHEN elapsed IS NOT NULL THEN '1:' || lpad(CAST(race AS VARCHAR), 2, '0') || ':05' END AS elapsed_hms, NULL::VARCHAR AS corrected_hms, NULL::DOUBLE AS corrected, true AS corrected_missing FROM fact")
def _(spark, sf):
    return _star(spark, sf)["fact_results"]


@register("c12_backfill", "WITH " + RACES + ", " + FACT + """, raw AS (SELECT sail, regatta, race, min(3605.0 + 60 * race + sec) AS e, min(race * 60.0) AS c FROM (SELECT upper(sail) AS sail, regatta, race, CAST(points * 100 AS BIGINT) % 7 AS sec FROM races) GROUP BY ALL)
SELECT fact_key, f.race, coalesce(elapsed, e) AS elapsed, c AS corrected, '0:' || lpad(CAST(f.race AS VARCHAR), 2, '0') || ':00' AS corrected_hms, c IS NULL AS corrected_missing FROM fact f LEFT JOIN raw r ON upper(f.sail) = r.sail AND f.regatta = r.regatta AND f.race = r.race""")
def _(spark, sf):
    """Times from a second copy of the results with other spelling of sails."""
    fact = _star(spark, sf)["fact_results"]
    seconds = 3605 + 60 * F.col("race") + (F.col("points") * 100).cast("long") % 7
    raw = fact.select(F.concat(F.lit(" "), F.upper("sail")).alias("sail"), F.col("regatta").cast("string").alias("regatta"), F.col("race").cast("double").alias("race"), seconds.cast("string").alias("elapsed"), F.concat(F.col("race").cast("string"), F.lit(":00")).alias("corrected"))
    return pipelines.backfill_times(fact, raw)[0].select("fact_key", "race", "elapsed", "corrected", "corrected_hms", "corrected_missing")


@register("c12_dim_boat", "WITH " + RACES + " SELECT 'Fr' || substr(sail, 3) AS sail, any_value(upper(left(boat, 1)) || substr(boat, 2)) FILTER (boat <> '') AS boat, median(rating) AS rating, 'C1' AS class, 'Club' AS club FROM races GROUP BY 1")
def _(spark, sf):
    return _star(spark, sf)["dim_boat"]


@register("c12_report", "WITH " + RACES + " SELECT 'rows' AS name, count(*) AS n FROM races UNION ALL SELECT 'missing_elapsed', count(*) FILTER (elapsed IS NULL) FROM races UNION ALL SELECT 'missing_corrected', count(*) FROM races UNION ALL SELECT 'missing_sail', 0 UNION ALL SELECT 'tie_groups', (SELECT count(*) FROM (SELECT 1 FROM races WHERE rank IS NOT NULL GROUP BY regatta, race, division, rank HAVING count(*) > 1)) UNION ALL SELECT 'boats', count(DISTINCT sail) FROM races UNION ALL SELECT 'races', count(DISTINCT regatta || '-' || race) FROM races UNION ALL SELECT 'divisions', 2")
def _(spark, sf):
    return _star(spark, sf)["report"]


def _ledgers(spark, sf):
    o, p, li = table(spark, sf, "orders"), table(spark, sf, "part"), table(spark, sf, "lineitem")
    price, k = F.col("p_retailprice"), F.col("p_partkey")
    return {
        "cash": o.select(F.lit(100.0).alias("begin_balance"), F.col("o_totalprice").alias("inflows"), F.col("o_totalprice").alias("outflows"), F.when(F.col("o_orderkey") % 50 == 0, 90.0).otherwise(100.0).alias("end_balance")),
        "payable": li.select(F.col("l_extendedprice").alias("invoice_amount"), F.col("l_quantity").alias("paid_amount")),
        "receivable": o.select(F.col("o_totalprice").alias("invoice_amount"), (F.col("o_custkey") * 1.0).alias("received_amount")),
        "cost_of_sales": li.select((F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cost"), F.col("l_quantity").alias("units_sold"), F.when(F.col("l_partkey") % 9 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("total_cost")),
        "operating_expenses": table(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_acctbal").cast("decimal(18,2)").alias("monthly_cost")),
        "ppe": p.select(price.alias("acquisition_cost"), F.lit(10.0).alias("accum_depreciation"), (price - F.when(k % 6 == 0, 11.0).otherwise(10.0)).alias("net_book_value")),
    }


@register("c13_audit_counts", "SELECT 'cash' AS ledger, count(*) AS n, count(*) FILTER (o_orderkey % 50 <> 0) AS ok FROM orders UNION ALL SELECT 'cost_of_sales', count(*), count(*) FILTER (l_partkey % 9 <> 0) FROM lineitem UNION ALL SELECT 'ppe', count(*), count(*) FILTER (p_partkey % 6 <> 0) FROM part")
def _(spark, sf):
    return pipelines.audit_counts(pipelines.run_audit(_ledgers(spark, sf)))


LEDGER = "SELECT '{l}' AS ledger, '{n}' AS name, count({e})::DOUBLE AS count, round(avg({e}), 4) AS mean, round(stddev_samp({e}), 4) AS std, min({e})::DOUBLE AS min, round(quantile_cont({e}, 0.25)::DOUBLE, 6) AS q1, round(median({e})::DOUBLE, 6) AS median, round(quantile_cont({e}, 0.75)::DOUBLE, 6) AS q3, max({e})::DOUBLE AS max FROM {t}"
LEDGERS = [("payable", "invoice_amount", "l_extendedprice", "lineitem"), ("payable", "paid_amount", "l_quantity", "lineitem"), ("payable", "total", "(l_extendedprice + l_quantity)", "lineitem"), ("receivable", "invoice_amount", "o_totalprice", "orders"), ("receivable", "received_amount", "(o_custkey * 1.0::DOUBLE)", "orders"), ("receivable", "total", "(o_totalprice + o_custkey)", "orders")]


@register("c13_invoices", " UNION ALL ".join(LEDGER.format(l=a, n=b, e=c, t=d) for a, b, c, d in LEDGERS))
def _(spark, sf):
    audited = pipelines.run_audit(_ledgers(spark, sf))
    out = W.union_all(*[audited[n].withColumn("ledger", F.lit(n)) for n in ("payable", "receivable")])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")} | {c: F.round(c, 6) for c in ("q1", "median", "q3")})


@register("c13_expenses", "SELECT c_mktsegment AS category, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer GROUP BY 1")
def _(spark, sf):
    return pipelines.run_audit(_ledgers(spark, sf))["operating_expenses"]


@register("c7_recommendations", "WITH " + ", ".join([STAGED, STAGED_DIM, STAGED_FACT]) + " SELECT * FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY region ORDER BY units DESC) AS INTEGER) AS rank FROM (SELECT region, product_id, sum(quantity) AS units FROM fact WHERE sale_date >= (SELECT max(sale_date) FROM fact) - INTERVAL 365 DAYS GROUP BY ALL)) WHERE rank <= 10")
def _(spark, sf):
    return pipelines.run_fashion(staged_products(spark, sf), staged_transactions(spark, sf), 365)["recommendations"]


@register("c7_gates", "WITH " + ", ".join([STAGED, STAGED_DIM, STAGED_FACT]) + " SELECT unnest(['product_price', 'sale_quantity', 'sale_orphan']) AS gate, 0 AS n, true AS passed")
def _(spark, sf):
    return pipelines.run_fashion(staged_products(spark, sf), staged_transactions(spark, sf))["gates"]


ELT_SALES = "(SELECT l_orderkey, l_linenumber, o_custkey AS customer_id, l_partkey, CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _elt(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    sales = li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("product_id"), F.col("o_custkey").alias("customer_id"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("unit_price"))
    customers = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("c_id"), "c_name")
    return pipelines.run_retail_elt(sales, customers, table(spark, sf, "part").select(F.col("p_partkey").alias("p_id"), "p_name"))


@register("c8_retail_elt", "SELECT l_orderkey, l_linenumber, l_partkey AS product_id, customer_id, c_name, p_name, CAST(total AS DOUBLE) AS total FROM " + ELT_SALES + " LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON customer_id = c_custkey LEFT JOIN part ON l_partkey = p_partkey")
def _(spark, sf):
    return _elt(spark, sf)[0].select("l_orderkey", "l_linenumber", "product_id", "customer_id", "c_name", "p_name", F.col("total").cast(D).alias("total"))


@register("c8_control_totals", "SELECT CAST(sum(total) AS DOUBLE) AS total, count(DISTINCT customer_id) AS clients FROM " + ELT_SALES)
def _(spark, sf):
    return _elt(spark, sf)[1].withColumn("total", F.col("total").cast(D))


LAKE = f"""flipped AS (SELECT * REPLACE (CASE WHEN quantity > 5 THEN quantity ELSE -quantity END AS quantity), {COUNTRY_SQL} AS country FROM sales), latest AS (SELECT DISTINCT ON (order_id, product_id, warehouse) * FROM flipped ORDER BY order_id, product_id, warehouse, event_time DESC, line_no DESC, quantity DESC, amount DESC), silver AS (SELECT * FROM latest WHERE quantity > 0 AND amount > 0)"""


@register("c2_lakehouse_gold", _with("SELECT warehouse, products.category, CAST(sum(amount) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM silver JOIN products USING (product_id) WHERE size > 2 GROUP BY ALL", LAKE))
def _(spark, sf):
    sales = V.sales(spark, sf).withColumn("quantity", F.when(F.col("quantity") > 5, F.col("quantity")).otherwise(-F.col("quantity")))
    return pipelines.build_lakehouse(sales, _reference(spark, sf), _country())["gold_category"]


@register("c2_lakehouse_rejected", _with("SELECT order_id, line_no, product_id FROM latest WHERE quantity <= 0 OR amount <= 0", LAKE, views=("sales",)))
def _(spark, sf):
    sales = V.sales(spark, sf).withColumn("quantity", F.when(F.col("quantity") > 5, F.col("quantity")).otherwise(-F.col("quantity")))
    return pipelines.build_lakehouse(sales, _reference(spark, sf), _country())["rejected"].select("order_id", "line_no", "product_id")
