"""The roles that the operators expect (sales, products, inventory, events, logs), as views of the given tables.

Every view has a DataFrame form and, in ``SQL``, the same view as a named SQL query for the oracles.
Money is kept in decimals, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import spread, table

MONEY = "decimal(18,4)"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item, with its order and the nation of its supplier as warehouse; tasks by order."""
    l, o = spread(table(spark, sf_dir, "lineitem"), "l_orderkey"), table(spark, sf_dir, "orders")
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("product_id"), F.col("n_name").alias("warehouse"),
        F.col("n_regionkey").alias("region_id"), F.col("o_custkey").alias("customer_id"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_discount").alias("discount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(MONEY).alias("amount"), F.col("l_extendedprice").cast(MONEY).alias("gross"),
        F.col("l_shipdate").alias("event_time"), F.col("o_orderdate").alias("order_time"), F.col("o_orderpriority").alias("priority"),
        F.col("l_returnflag").alias("channel"),
    )


def newest_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest time of a sale, from the base table alone."""
    return table(spark, sf_dir, "lineitem").select(F.max("l_shipdate"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock by product, warehouse (the supplier's nation) and snapshot day; tasks by product."""
    s, p = spread(sales(spark, sf_dir), "product_id"), products(spark, sf_dir)
    by = s.groupBy("product_id", "warehouse", F.to_date("event_time").alias("inventory_date")).agg(F.sum("quantity").alias("quantity_on_hand"))
    return by.join(p, "product_id").select("product_id", "product_name", "category", "warehouse", "inventory_date", "quantity_on_hand", F.col("price").cast(MONEY).alias("unit_cost"), (F.col("size") * 1.0).alias("restock_threshold"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream events with the product of their properties and a store."""
    e = table(spark, sf_dir, "events")
    product = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999")).cast("long")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.concat(F.lit("P"), product.cast("string")).alias("product_id"), (F.col("user_id") % 10).alias("store_id"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined-log-format lines of the events; every 97th one is broken."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    method = F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET")
    line = F.concat(
        F.lit("10.0."), (F.col("user_id") % 250).cast("string"), F.lit(".7 - u"), F.col("user_id").cast("string"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0000] "'), method, F.lit(" /"), F.col("event_type"), F.lit("?id="), F.col("event_id").cast("string"), F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" "),
        F.floor(F.col("value") * 10).cast("string"), F.lit(' "-" "agent/1.0"'),
    )
    return e.select("event_id", F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("broken "), F.col("event_type"))).otherwise(line).alias("line"))


SQL = {
    "sales": """sales AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, n_name AS warehouse, n_regionkey AS region_id, o_custkey AS customer_id,
    l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_discount AS discount, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS gross, l_shipdate AS event_time, o_orderdate AS order_time, o_orderpriority AS priority, l_returnflag AS channel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
    "products": """products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category, p_size AS size, p_retailprice AS price FROM part)""",
    "inventory": """inventory AS (
  SELECT s.product_id, product_name, category, warehouse, inventory_date, quantity_on_hand, CAST(price AS DECIMAL(18,4)) AS unit_cost, size * 1.0 AS restock_threshold
  FROM (SELECT product_id, warehouse, CAST(event_time AS DATE) AS inventory_date, sum(quantity) AS quantity_on_hand FROM sales GROUP BY ALL) s
  JOIN products p ON s.product_id = p.product_id)""",
    "ev": """ev AS (
  SELECT event_id, ts, user_id, event_type, value, 'P' || CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, user_id % 10 AS store_id FROM events)""",
    "log_lines": """log_lines AS (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'broken ' || event_type ELSE '10.0.' || (user_id % 250) || '.7 - u' || user_id || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S')
    || ' +0000] "' || CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END || ' /' || event_type || '?id=' || event_id || ' HTTP/1.1" '
    || CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END || ' ' || CAST(floor(value * 10) AS BIGINT) || ' "-" "agent/1.0"' END AS line FROM events)""",
}


def sql(body: str, *names: str) -> str:
    """``body`` after the named views (which may follow from each other: list them in order)."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body
