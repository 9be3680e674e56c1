"""Queries of cleaning, joins, aggregates, windows, ranking and set operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import aggregates as A
from tabulon.operators import cleaning as P
from tabulon.operators import joins as J
from tabulon.operators import windows as W
from tabulon.plans import views as V
from tabulon.registry import register
from tabulon.session import table

D = "double"


def _daily(spark, sf):
    return V.sales(spark, sf).groupBy("warehouse", F.to_date("event_time").alias("day")).agg(F.sum("quantity").alias("units"))


DAILY = "daily AS (SELECT warehouse, CAST(event_time AS DATE) AS day, sum(quantity) AS units FROM sales GROUP BY ALL)"


def _with(body: str, *more: str, views: tuple[str, ...] = ("sales", "products")) -> str:
    return "WITH " + ",\n".join([V.SQL[v] for v in views] + list(more)) + "\n" + body


# ---- projections and filters ----


@register("p1_rename_dropna", "SELECT event_id AS id, event_type AS kind, value FROM events WHERE event_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL")
def _(spark, sf):
    return P.rename_dropna(table(spark, sf, "events").select("event_id", "event_type", "value"), {"event_id": "id", "event_type": "kind"})


@register("p2_parse_products", "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price, CAST(p_size AS DOUBLE) AS rating, p_size AS stock, p_brand AS brand, lower(p_type) AS category FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    raw = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit(" "), "p_name").alias("title"), F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("price"), F.col("p_size").cast("string").alias("rating"), F.col("p_size").cast("string").alias("stock"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    return P.parse_products(raw)


@register("p3_standardise_inventory", "SELECT upper(trim(s_name)) AS code, CAST('1999-01-0' || (s_suppkey % 9 + 1) AS DATE) AS day, CAST(s_acctbal AS DECIMAL(12,2)) AS cost FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit(" "), "s_name").alias("code"), F.concat(F.lit("1999-01-0"), (F.col("s_suppkey") % 9 + 1).cast("string")).alias("day"), F.col("s_acctbal").cast("string").alias("cost"))
    return P.standardise(s, upper=["code"], dates=["day"], money=["cost"])


@register("p4_standardise_suppliers", "SELECT s_suppkey, lower(s_name) || '@example.com' AS email, coalesce(CASE WHEN s_acctbal > 5000 THEN true END, false) AS preferred FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(" "), "s_name", F.lit("@EXAMPLE.com ")).alias("email"), F.when(F.col("s_acctbal") > 5000, True).alias("preferred"))
    return P.standardise(s, lower=["email"]).fillna(False, "preferred")


@register("p5_sale_amount", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(CAST(l_quantity * l_extendedprice * (1 - CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_discount END) AS DECIMAL(18,4)) AS DECIMAL(12,2)) AS sale_amount FROM lineitem WHERE l_orderkey IS NOT NULL")
def _(spark, sf):
    li = table(spark, sf, "lineitem").where("l_orderkey is not null")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", P.sale_amount(F.col("l_quantity"), F.col("l_extendedprice"), F.when(F.col("l_linenumber") != 1, F.col("l_discount"))).alias("sale_amount"))


STAGED = """staged AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE ' ' || p_name END AS product_name, p_type AS category, p_type AS subcategory, p_brand AS brand, 'north ' AS region,
CASE WHEN p_partkey % 9 = 0 THEN -p_retailprice ELSE p_retailprice END AS price, p_retailprice / 8 AS cost, DATE '2024-01-01' AS created_date, CASE WHEN p_partkey % 2 = 0 THEN DATE '2024-02-02' END AS updated_date FROM part)"""
STAGED_DIM = "dim AS (SELECT product_id, trim(upper(product_name)) AS product_name, trim(upper(category)) AS category, trim(upper(subcategory)) AS subcategory, trim(upper(brand)) AS brand, trim(upper(region)) AS region, round(price, 2) AS price, round(cost, 2) AS cost, created_date, coalesce(updated_date, created_date) AS updated_date FROM staged WHERE product_name IS NOT NULL AND category IS NOT NULL AND price > 0 AND cost > 0)"


def staged_products(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(
        k.alias("product_id"), F.when(k % 50 != 0, F.concat(F.lit(" "), "p_name")).alias("product_name"), F.col("p_type").alias("category"), F.col("p_type").alias("subcategory"), F.col("p_brand").alias("brand"), F.lit("north ").alias("region"),
        F.when(k % 9 == 0, -F.col("p_retailprice")).otherwise(F.col("p_retailprice")).alias("price"), (F.col("p_retailprice") / 8).alias("cost"), F.lit("2024-01-01").cast("date").alias("created_date"), F.when(k % 2 == 0, F.lit("2024-02-02").cast("date")).alias("updated_date"),
    )


@register("p6_transform_products", "WITH " + STAGED + ", " + STAGED_DIM + " SELECT * FROM dim")
def _(spark, sf):
    return P.transform_products(staged_products(spark, sf))


STAGED_FACT = """fact AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sale_id, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS sale_date, upper('zone ' || (l_suppkey % 4)) AS region, l_quantity AS quantity, round(l_extendedprice, 2) AS unit_price, round(l_extendedprice, 2) AS total_amount, 'CARD' AS payment_method
FROM lineitem WHERE (l_orderkey % 11 <> 0) AND l_quantity > 0 AND l_extendedprice > 0 AND l_partkey IN (SELECT product_id FROM dim))"""


def staged_transactions(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sale_id"), F.col("l_partkey").alias("product_id"), F.to_date("l_shipdate").alias("sale_date"), F.concat(F.lit("zone "), (F.col("l_suppkey") % 4).cast("string")).alias("region"),
        F.when(F.col("l_orderkey") % 11 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), F.col("l_extendedprice").alias("unit_price"), F.col("l_extendedprice").alias("total_amount"), F.lit("card ").alias("payment_method"),
    )


@register("p7_transform_transactions", "WITH " + ", ".join([STAGED, STAGED_DIM, STAGED_FACT]) + " SELECT * FROM fact")
def _(spark, sf):
    return P.transform_transactions(staged_transactions(spark, sf), P.transform_products(staged_products(spark, sf)))


@register("p8_split_valid", "SELECT o_orderkey, NOT coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END > 100000, false) AS invalid FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    ok, bad = P.split_valid(o, F.col("price") > 100000)
    return ok.select("o_orderkey", F.lit(False).alias("invalid")).unionByName(bad.select("o_orderkey", F.lit(True).alias("invalid")))


@register("p9_derive_total", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * l_extendedprice AS total FROM lineitem")
def _(spark, sf):
    return P.derive_if_missing(table(spark, sf, "lineitem"), "total", F.col("l_quantity") * F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total")


@register("p11_canonicalize_columns", "SELECT p_name AS name, p_brand AS brand, p_retailprice AS price, CASE WHEN length(p_partkey || '12345678') IN (8, 12, 13, 14) THEN lpad(p_partkey || '12345678', 14, '0') END AS gtin, CASE WHEN length(p_partkey || '12345678') IN (8, 12, 13, 14) THEN lpad(p_partkey || '12345678', 14, '0') END AS ean, CAST(NULL AS VARCHAR) AS upc, p_partkey || '-12345678' AS sku FROM part")
def _(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_name").alias("Product_Name"), F.col("p_brand").alias("brand_name"), F.col("p_retailprice").alias("SALE_PRICE"), F.concat(F.col("p_partkey").cast("string"), F.lit("-12345678")).alias("product_identifier"))
    return P.canonicalize_columns(raw).select("name", "brand", "price", "gtin", "ean", "upc", "sku")


@register("p12_normalize_text", "SELECT p_partkey, upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS name FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.normalize_text(F.upper("p_name")).alias("name"))


@register("p13_coerce_numeric", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round_even(value, 0) AS BIGINT) END AS n FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", P.coerce_integer(F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("value").cast("string"))).alias("n"))


@register("p14_compose_keys", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey || '-' || l_linenumber END AS k FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", P.compose_key(F.col("l_orderkey"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).alias("k"))


@register("p15_buckets", """SELECT p_partkey, CASE WHEN p < 10 THEN '< $10' WHEN p < 50 THEN '$10-$49' WHEN p < 100 THEN '$50-$99' WHEN p < 500 THEN '$100-$499' ELSE '$500+' END AS price_bucket,
CASE WHEN r >= 4.5 THEN '4.5-5.0' WHEN r >= 4.0 THEN '4.0-4.4' WHEN r >= 3.5 THEN '3.5-3.9' WHEN r >= 3.0 THEN '3.0-3.4' ELSE '< 3.0' END AS rating_bucket,
CASE WHEN q >= 70 THEN 'healthy' WHEN q >= 35 THEN 'monitor' ELSE 'reorder' END AS stock, CASE WHEN q > 50 THEN 'Top 80 (vânzări)' ELSE 'Bottom 20' END AS label
FROM (SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice - 895 END AS p, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 10.0 END AS r, p_size * 2 AS q FROM part)""")
def _(spark, sf):
    k, q = F.col("p_partkey"), F.col("p_size") * 2
    price, rating = F.when(k % 13 != 0, F.col("p_retailprice") - 895), F.when(k % 7 != 0, F.col("p_size") / 10)
    return table(spark, sf, "part").select(k, P.price_bucket(price).alias("price_bucket"), P.rating_bucket(rating).alias("rating_bucket"), P.stock_status(q).alias("stock"), P.pareto_label(q > 50).alias("label"))


@register("p16_lookup", "SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'Romania' WHEN 'NATION_2' THEN 'Germany' ELSE 'Unknown' END AS country FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", P.lookup(F.col("n_name"), {"NATION_1": "Romania", "NATION_2": "Germany"}, "Unknown").alias("country"))


@register("p17_trailing", "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAYS")
def _(spark, sf):
    return P.trailing(table(spark, sf, "orders"), "o_orderdate", 90).select("o_orderkey")


@register("p18_low_stock", _with("SELECT product_id, warehouse, inventory_date, quantity_on_hand <= 40 AS reorder FROM inventory WHERE quantity_on_hand < restock_threshold", views=("sales", "products", "inventory")))
def _(spark, sf):
    return P.low_stock(V.inventory(spark, sf)).select("product_id", "warehouse", "inventory_date", "reorder")


@register("p19_row_level_filter", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def _(spark, sf):
    grants = table(spark, sf, "region").where("r_regionkey in (1, 3)").select(F.lit("ana").alias("user"), F.col("r_regionkey").alias("region_id"))
    return P.row_level_filter(table(spark, sf, "nation").withColumnRenamed("n_regionkey", "region_id"), grants, "ana").select("n_nationkey", "n_name")


@register("p20_repeatable_sample", "SELECT * FROM events WHERE CAST('0x' || left(md5(CAST(event_id AS VARCHAR)), 8) AS BIGINT) % 10 = 0")
def _(spark, sf):
    return P.repeatable_sample(table(spark, sf, "events"), "event_id", 10)


@register("p20_random_rows", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(*) AS given FROM (SELECT o_orderkey FROM orders ORDER BY random() LIMIT 100)")
def _(spark, sf):
    """The rows are random; that they are whole rows of the table isn't."""
    orders = table(spark, sf, "orders")
    drawn = P.random_rows(orders, 100)
    given = drawn.join(orders.withColumn("given", F.lit(1)), orders.columns, "left")
    return given.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.count("given").alias("given"))


@register("p21_lineage", "SELECT n_nationkey, 'tpch' AS lineage_source, 'load' AS lineage_step, '1' AS lineage_version, md5('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS row_md5 FROM nation")
def _(spark, sf):
    return P.with_lineage(table(spark, sf, "nation").select("n_nationkey", "n_name"), "tpch", "load").drop("n_name", "lineage_time")


PII_TEXT = "CASE WHEN doc_id % 3 = 0 THEN text || ' user_' || doc_id || ' 0123abcd-0000-1111-2222-0123456789ab' ELSE text END"
PII_SQL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "uuid": r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "user_id": r"\buser[_-]?[0-9]+\b"}
PII_MASKED = "t"
for _kind, _pattern in PII_SQL.items():
    PII_MASKED = f"regexp_replace({PII_MASKED}, '{_pattern}', '<{_kind}>', 'g')"
PII_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(t, '{p}')) AS INTEGER) AS n_{k}" for k, p in PII_SQL.items())


@register("p22_detect_pii", f"SELECT doc_id, {PII_COUNTS}, md5({PII_MASKED}) AS masked FROM (SELECT doc_id, {PII_TEXT} AS t FROM documents)")
def _(spark, sf):
    """A third of the texts with a user id and a UUID at the end."""
    planted = table(spark, sf, "documents").withColumn("text", F.expr(PII_TEXT))
    found = P.detect_pii(planted, "text")
    return found.select("doc_id", *[f"n_{k}" for k in PII_SQL], F.md5("masked").alias("masked"))


@register("p23_retention", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1999-06-30'")
def _(spark, sf):
    return P.apply_retention(table(spark, sf, "orders"), "o_orderdate", 2, F.lit("2001-06-30")).select("o_orderkey")


@register("p23_ttl", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS")
def _(spark, sf):
    return P.apply_ttl(table(spark, sf, "events"), "ts", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@register("p24_filter_entries", "SELECT event_id, ts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND user_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("status", F.when(F.col("user_id") % 2 == 0, "open").otherwise("closed"))
    since, until = (F.lit(d).cast("timestamp") for d in ("2024-01-10", "2024-01-20"))
    return P.filter_entries(e, "error", since, 50, "ts", "event_type", "event_id", until, "open").select("event_id", "ts")


@register("p25_consent", """SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id) WHERE t = 'signup')""")
def _(spark, sf):
    e = table(spark, sf, "events")
    consent = e.where("event_type in ('signup', 'error')").select("user_id", F.array(F.lit("ads")).alias("purposes"), (F.col("event_type") == "error").alias("withdrawn"), F.col("event_id").alias("given_at"))
    return P.with_consent(e, consent, "ads").select("event_id")


# ---- joins ----


@register("j1_join_dim", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    return J.join_dim(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "k"), table(spark, sf, "nation").withColumnRenamed("n_nationkey", "k"), "k").select("c_custkey", "n_name")


@register("j2_left_join_renamed", "SELECT l_orderkey, l_partkey, l_suppkey, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def _(spark, sf):
    out = J.left_join_renamed(table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_size > 25"), "l_partkey", "p_partkey")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "p_name")


@register("j3_enrich_sales", _with("SELECT order_id, s.product_id, category, round(CAST(amount AS DOUBLE) - quantity * price, 4) AS margin FROM sales s LEFT JOIN products p ON s.product_id = p.product_id"))
def _(spark, sf):
    return J.enrich_sales(V.sales(spark, sf), V.products(spark, sf)).select("order_id", "product_id", "category", F.round("margin", 4).alias("margin"))


@register("j4_unknown_products", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)")
def _(spark, sf):
    known = table(spark, sf, "part").where("p_size > 2").select(F.col("p_partkey").alias("l_partkey"))
    return J.anti_join(table(spark, sf, "lineitem"), known, "l_partkey").select("l_orderkey", "l_partkey")


@register("j5_anti_join", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return J.anti_join(li.select("l_partkey", "l_suppkey").distinct(), li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


@register("j6_known_only", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return J.known_only(li.select("l_orderkey", "l_partkey", "l_suppkey"), W.distinct_keys(li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]), ["l_partkey", "l_suppkey"])


@register("j7_window_stats", "SELECT event_id, n FROM events JOIN (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS t, count(*) AS n FROM events GROUP BY ALL) ON time_bucket(INTERVAL 1 HOUR, ts) = w AND event_type = t")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("window", F.window("ts", "1 hour"))
    return J.attach_window_stats(e, e.groupBy("window", "event_type").agg(F.count("*").alias("n")), ["window", "event_type"]).select("event_id", "n")


STOCK = """prev AS (SELECT warehouse, product_id, sum(quantity) AS before FROM sales WHERE channel <> 'R' GROUP BY ALL),
sold AS (SELECT warehouse, product_id, sum(quantity) AS sold FROM sales WHERE channel = 'A' GROUP BY ALL), cur AS (SELECT warehouse, product_id, sum(quantity) AS after FROM sales WHERE channel = 'N' GROUP BY ALL)"""


@register("j8_reconcile_stock", _with("SELECT warehouse, product_id, before, after, coalesce(sold, 0) AS sold, greatest(before - coalesce(sold, 0), 0) AS expected, greatest(before - coalesce(sold, 0), 0) = after AS consistent FROM prev JOIN cur USING (warehouse, product_id) LEFT JOIN sold USING (warehouse, product_id)", STOCK))
def _(spark, sf):
    s = V.sales(spark, sf)
    by = lambda cond: s.where(cond).groupBy("warehouse", "product_id").agg(F.sum("quantity").alias("quantity"))
    return J.reconcile_stock(by("channel <> 'R'"), by("channel = 'N'"), by("channel = 'A'"))


@register("j9_category_fallback", "WITH e AS (SELECT l_partkey, round(avg(l_quantity), 4) AS v FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1), c AS (SELECT p_type, CAST(count(*) AS DOUBLE) AS f FROM part GROUP BY 1) SELECT p_partkey AS product_id, coalesce(v, f) AS v FROM part LEFT JOIN e ON p_partkey = l_partkey LEFT JOIN c ON part.p_type = c.p_type")
def _(spark, sf):
    e = table(spark, sf, "lineitem").where("l_partkey % 3 = 0").groupBy(F.col("l_partkey").alias("product_id")).agg(F.round(F.avg("l_quantity"), 4).alias("v"))
    p = V.products(spark, sf)
    return J.with_category_fallback(e, p, p.groupBy("category").agg(F.count("*").cast(D).alias("v")), "v").select("product_id", "v")


@register("j10_candidate_pairs", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def _(spark, sf):
    return J.candidate_pairs(table(spark, sf, "part"), "p_partkey", F.array(F.concat_ws("|", "p_name", "p_brand", "p_size")), one_block=True)


@register("j10_similar_sets", "WITH t AS (SELECT p_partkey AS id, list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_brand || ' s' || p_size, ' ')) AS s FROM part), f AS (SELECT min(id) AS id, any_value(s) AS s FROM t GROUP BY list_sort(s)), e AS (SELECT id, len(s) AS n, unnest(s) AS w FROM f), c AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM e x JOIN e y ON x.w = y.w AND x.id < y.id GROUP BY ALL) SELECT a, b, k::DOUBLE / (n + m - k) AS similarity FROM c WHERE k::DOUBLE / (n + m - k) >= 0.6")
def _(spark, sf):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.concat(F.lit("s"), F.col("p_size").cast("string"))), " ")
    return J.similar_sets(table(spark, sf, "part").select("p_partkey", words.alias("words")), "p_partkey", "words", 0.6)[1]


@register("j11_backfill", "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    fact = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit(" k"), "n_regionkey").alias("code"), F.lit(None).cast("string").alias("r_name"))
    raw = table(spark, sf, "region").select(F.concat(F.lit("K"), "r_regionkey", F.lit(" ")).alias("code"), "r_name")
    return J.backfill(fact, raw, ["code"], ["r_name"]).select("n_nationkey", "r_name")


MERGE = """inv AS (SELECT warehouse, product_id, sum(quantity) AS q, max(event_time) AS last_sale, CASE WHEN product_id % 3 <> 0 THEN CAST(sum(amount) AS DOUBLE) END AS lifetime_revenue, 'note ' || product_id AS note FROM sales GROUP BY warehouse, product_id),
so AS (SELECT warehouse, product_id, sum(quantity) AS sold, max(event_time) AS new_sale, CAST(sum(amount) AS DECIMAL(28,4)) AS revenue FROM sales WHERE channel = 'A' GROUP BY ALL)"""


@register("j13_apply_merge", _with("SELECT warehouse, product_id, CASE WHEN sold IS NULL THEN q ELSE greatest(q - sold, 0) END AS quantity_on_hand, coalesce(new_sale, last_sale) AS last_sale, round(CASE WHEN sold IS NULL THEN lifetime_revenue ELSE coalesce(lifetime_revenue, 0) + CAST(revenue AS DOUBLE) END, 1) AS lifetime_revenue, note FROM inv LEFT JOIN so USING (warehouse, product_id)", MERGE))
def _(spark, sf):
    s = V.sales(spark, sf)
    inv = s.groupBy("warehouse", "product_id").agg(F.sum("quantity").alias("quantity_on_hand"), F.max("event_time").alias("last_sale"), F.when(F.col("product_id") % 3 != 0, A.total("amount")).alias("lifetime_revenue"), F.concat(F.lit("note "), F.col("product_id").cast("string")).alias("note"))
    out = J.apply_sales_merge(inv, A.sales_by_warehouse_product(s.where("channel = 'A'")))
    return out.withColumn("lifetime_revenue", F.round("lifetime_revenue", 1))


@register("k12_insert_ignore", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return J.insert_ignore(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("new")), "o_orderkey")


@register("k13_upsert_replace", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return J.upsert_replace(o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("new")), "o_orderkey", "o_orderdate")


# ---- windows ----


@register("w1_latest_by", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    return W.latest_by(table(spark, sf, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@register("w2_latest_snapshot", _with("SELECT warehouse, product_id, inventory_date, quantity_on_hand FROM inventory QUALIFY row_number() OVER (PARTITION BY warehouse, product_id ORDER BY inventory_date DESC) = 1", views=("sales", "products", "inventory")))
def _(spark, sf):
    return W.latest_by(V.inventory(spark, sf), ["warehouse", "product_id"], "inventory_date").select("warehouse", "product_id", "inventory_date", "quantity_on_hand")


@register("w3_top_n_per_window", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY n DESC, product_id) AS INTEGER) AS rank FROM (SELECT CAST(ts AS DATE) AS day, 'P' || json_extract_string(props, '$.k') AS product_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 5")
def _(spark, sf):
    by = V.events(spark, sf).groupBy(F.to_date("ts").alias("day"), "product_id").agg(F.count("*").alias("n"))
    return W.top_n_per(by, ["day"], "n", 5, "product_id")


@register("w4_recommendations", _with("SELECT * FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY region_id ORDER BY units DESC) AS INTEGER) AS rank FROM (SELECT region_id, product_id, sum(quantity) AS units FROM sales WHERE event_time >= (SELECT max(event_time) FROM sales) - INTERVAL 365 DAYS GROUP BY ALL)) WHERE rank <= 10"))
def _(spark, sf):
    by = P.trailing(V.sales(spark, sf), "event_time", 365, newest=V.newest_sale(spark, sf)).groupBy("region_id", "product_id").agg(F.sum("quantity").alias("units"))
    return W.top_n_per(by, ["region_id"], "units", 10, "product_id", dense=True)


@register("w5_share_within", _with("SELECT warehouse, category, units, units / sum(units) OVER (PARTITION BY warehouse) AS share FROM (SELECT warehouse, category, sum(quantity) AS units FROM sales JOIN products USING (product_id) GROUP BY ALL)"))
def _(spark, sf):
    by = V.sales(spark, sf).join(V.products(spark, sf), "product_id").groupBy("warehouse", "category").agg(F.sum("quantity").alias("units"))
    return W.share_within(by, ["warehouse"], "units")


@register("w7_pareto", _with("SELECT product_id, CAST(v AS DOUBLE) AS value, CAST(rank() OVER (ORDER BY v DESC) AS INTEGER) AS rank, sum(v) OVER (ORDER BY v DESC RANGE UNBOUNDED PRECEDING)::DOUBLE / sum(v) OVER ()::DOUBLE AS cumulative, sum(v) OVER (ORDER BY v DESC RANGE UNBOUNDED PRECEDING)::DOUBLE / sum(v) OVER ()::DOUBLE <= 0.8 AS within FROM (SELECT product_id, sum(quantity) AS v FROM sales GROUP BY 1)"))
def _(spark, sf):
    return W.pareto(V.sales(spark, sf), "product_id", "quantity")


@register("w8_rolling_mean", _with("SELECT warehouse, day, CASE WHEN count(*) OVER w >= 7 THEN avg(units) OVER w END AS rolling FROM daily WINDOW w AS (PARTITION BY warehouse ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)", DAILY))
def _(spark, sf):
    return W.rolling_mean(_daily(spark, sf), ["warehouse"], "day", "units", 28, 7).select("warehouse", "day", "rolling")


@register("w9_trailing_day_avg", _with("SELECT warehouse, day, avg(units) OVER (PARTITION BY warehouse ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW) AS trailing FROM daily", DAILY))
def _(spark, sf):
    return W.trailing_day_avg(_daily(spark, sf), ["warehouse"], "day", "units", 28).select("warehouse", "day", "trailing")


@register("w10_year_over_year", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), b AS (SELECT CAST(day + INTERVAL 12 MONTHS AS DATE) AS day, max(n) AS before FROM d GROUP BY 1) SELECT day, n, before, (n - before) / before AS yoy FROM d LEFT JOIN b USING (day)")
def _(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast(D).alias("n"))
    return W.year_over_year(d, "day", "n")


@register("w11_flag_ties", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size, p_type) > 1 AS tied FROM part")
def _(spark, sf):
    return W.flag_ties(table(spark, sf, "part"), ["p_brand", "p_size", "p_type"]).select("p_partkey", "tied")


@register("w12_autocorrelation", _with("SELECT warehouse, lag, sum(units * nxt) AS r FROM (SELECT warehouse, 0 AS lag, units, units AS nxt FROM daily UNION ALL SELECT warehouse, 1, units, lead(units, 1) OVER w FROM daily WINDOW w AS (PARTITION BY warehouse ORDER BY day) UNION ALL SELECT warehouse, 2, units, lead(units, 2) OVER w FROM daily WINDOW w AS (PARTITION BY warehouse ORDER BY day)) GROUP BY ALL", DAILY))
def _(spark, sf):
    return W.autocorrelation(_daily(spark, sf), ["warehouse"], "day", "units", 2)


@register("w13_pct_change", _with("SELECT warehouse, day, (units - lag(units) OVER w) * 100.0 / lag(units) OVER w AS change_pct FROM daily WINDOW w AS (PARTITION BY warehouse ORDER BY day)", DAILY))
def _(spark, sf):
    return W.pct_change(_daily(spark, sf), ["warehouse"], "day", "units").select("warehouse", "day", "change_pct")


@register("w14_latest_metrics", "SELECT event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def _(spark, sf):
    return W.latest_by(table(spark, sf, "events"), ["event_type"], "ts", "event_id").select("event_type", "ts", "value")


@register("w6_rank_by", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS INTEGER) AS rank FROM part")
def _(spark, sf):
    return W.rank_by(table(spark, sf, "part"), ["p_type"], "p_retailprice").select("p_partkey", "rank")


@register("t1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    return W.top_k(table(spark, sf, "orders"), "o_totalprice", 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@register("t2_sort_by", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def _(spark, sf):
    return W.sort_by(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "-p_size", "p_partkey")


@register("t3_region_top", _with("SELECT product_id, product_name, units FROM (SELECT product_id, sum(quantity) AS units FROM sales WHERE region_id = 2 GROUP BY 1) JOIN products USING (product_id) ORDER BY units DESC, product_id LIMIT 10"))
def _(spark, sf):
    by = V.sales(spark, sf).where("region_id = 2").groupBy("product_id").agg(F.sum("quantity").alias("units"))
    return W.top_k(by.join(V.products(spark, sf), "product_id"), "units", 10, "product_id").select("product_id", "product_name", "units")


@register("t4_in_range", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def _(spark, sf):
    return A.top_groups(table(spark, sf, "events").where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-06'"), "event_type", 3)


@register("u1_union_all", "SELECT o_orderkey AS k, 'F' AS s FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'O' FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return W.union_all(o.where("s = 'F'"), o.where("s = 'O'"))


@register("u2_distinct_keys", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(spark, sf):
    return W.distinct_keys(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@register("u3_missing_values", "SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def _(spark, sf):
    return W.missing_values(table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_size > 3"), "l_partkey", "p_partkey")


@register("u4_key_overlap", "WITH a AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS \"both\", count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b FROM a FULL JOIN b ON a.k = b.k")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return W.key_overlap(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O' and o_totalprice > 400000"), "o_custkey")


@register("u5_singletons", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey <> p.p_partkey AND q.p_name = p.p_name AND q.p_brand = p.p_brand AND q.p_size = p.p_size)")
def _(spark, sf):
    p = table(spark, sf, "part")
    return J.anti_join(p.select("p_partkey"), J.in_shared_blocks(p, "p_partkey", F.array(F.concat_ws("|", "p_name", "p_brand", "p_size"))), "p_partkey")
