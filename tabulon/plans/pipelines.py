"""Composite pipelines: plain functions from tables to tables; scheduling stays with the caller."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions.scalars import recommend, to_hms, to_seconds
from tabulon.operators import aggregates as A
from tabulon.operators import cleaning as P
from tabulon.operators import joins as J
from tabulon.operators import quality as Q
from tabulon.operators import windows as W
from tabulon.sources import tables as T
from tabulon.streaming import metrics as R


def run_log_analytics(spark: SparkSession, source: str, out: str) -> list[StreamingQuery]:
    """One query parses lines into a table; the metric queries read lines of the same folder and write their own tables."""
    logs = R.parse_logs(T.read_log_stream(spark, source))
    frames = {"silver": logs, "rpm": R.requests_per_minute(logs), "errors": R.errors_per_minute(logs), "status": R.status_distribution(logs), "endpoints": R.top_endpoints(logs)}
    return [T.start(df, name, f"{out}/checkpoints/{name}", f"{out}/{name}") for name, df in frames.items()]


def build_lakehouse(sales: DataFrame, products: DataFrame, country: Column) -> dict[str, DataFrame]:
    """Bronze, silver and gold tables: all sales, the latest of each order, product and warehouse if it is valid, known products, and their aggregates.

    A latest row that breaks an expectation is rejected; the one before it doesn't come back.

    ``products`` is a reference (product_id, product_name, category, avg_cost); ``country`` is that of a warehouse.
    """
    latest = W.latest_by(sales, ["order_id", "product_id", "warehouse"], "event_time", "line_no", "quantity", "amount")
    silver, rejected = P.split_valid(latest, (F.col("quantity") > 0) & (F.col("amount") > 0))
    silver = silver.withColumn("country", country)
    enriched, unknown = R.enrich_stream(silver, products)
    gold = enriched.groupBy("warehouse", "category").agg(A.total("amount").alias("revenue"), F.count_distinct("order_id").alias("orders"))
    totals = A.order_totals(enriched, "country")
    return {"bronze": sales, "rejected": rejected, "silver": silver, "enriched": enriched, "unknown": unknown, "gold_category": gold, "gold_performance": R.sales_performance(enriched), "gold_anomalies": R.order_anomalies(totals)}


def update_stock(inventory: DataFrame, sales: DataFrame, days: int, newest: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next snapshot: the latest stock less what was sold in the last ``days`` days; and the sales that can't be applied.

    Sales of unknown products or without a positive quantity are rejected.
    """
    now = W.latest_by(inventory, ["warehouse", "product_id"], "inventory_date")
    sold = A.sales_by_warehouse_product(P.trailing(sales, "event_time", days, newest=newest))
    keys = now.select("warehouse", "product_id")
    unknown = J.anti_join(sold, keys, ["warehouse", "product_id"]).withColumn("reason", F.lit("unknown product"))
    valid, empty = P.split_valid(J.known_only(sold, keys, ["warehouse", "product_id"]), F.col("sold") > 0)
    rejected = unknown.unionByName(empty.withColumn("reason", F.lit("no positive quantity")))
    return {"inventory": J.apply_sales_merge(now, valid), "applied": valid, "rejected": rejected}


def write_stock(spark: SparkSession, root: str, log: str, before: int, inventory: DataFrame, sales: DataFrame, days: int) -> int:
    """Write the next version of the stock and a line of the version log; gives the new version, or the old one if no sale applies."""
    out = update_stock(inventory, sales, days)
    applied, rejected = out["applied"].count(), out["rejected"].count()
    if not applied:
        return before
    T.write_versioned(out["inventory"], root, before + 1)
    row = spark.createDataFrame([(before, before + 1, days, rejected, applied)], "previous_version int, current_version int, days int, invalid_rows long, valid_rows long")
    row.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(log)
    return before + 1


def run_audit(ledgers: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The audit of each ledger that is there: tested rows, summaries of invoices, expenses by category."""
    audits = {
        "cash": Q.audit_cash,
        "payable": lambda df: A.describe(df.withColumn("total", F.col("invoice_amount") + F.col("paid_amount")), ["invoice_amount", "paid_amount", "total"]),
        "receivable": lambda df: A.describe(df.withColumn("total", F.col("invoice_amount") + F.col("received_amount")), ["invoice_amount", "received_amount", "total"]),
        "cost_of_sales": Q.audit_cost_of_sales,
        "operating_expenses": lambda df: A.sums_by(df, ["category"], "monthly_cost"),
        "ppe": Q.audit_ppe,
    }
    return {name: audit(ledgers[name]) for name, audit in audits.items() if name in ledgers}


def audit_counts(audited: Mapping[str, DataFrame]) -> DataFrame:
    """How many rows of each tested ledger there are, and how many pass."""
    parts = [df.agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).select(F.lit(name).alias("ledger"), "n", "ok") for name, df in audited.items() if "ok" in df.columns]
    return reduce(DataFrame.unionByName, parts)


def _times(fact: DataFrame) -> DataFrame:
    """With both times also as H:MM:SS, and whether the corrected one is missing."""
    return fact.withColumns({"elapsed_hms": to_hms(F.col("elapsed")), "corrected_hms": to_hms(F.col("corrected")), "corrected_missing": F.col("corrected").isNull()})


RESULTS = ("regatta", "race", "division", "rank", "sail", "boat", "class", "club", "rating", "points", "elapsed", "corrected")


def build_star(rows: DataFrame) -> dict[str, DataFrame]:
    """Race results (``RESULTS``) as a fact with keys, three dimensions and a report.

    Texts are normalised, times become seconds, ranks and numbers are coerced. Ties are rows of one rank in a race and division, unranked ones
    are none. The report has one row a check.
    """
    P.require_columns(rows, list(RESULTS))
    clean = rows.withColumns(_results(rows))
    clean = clean.withColumn("race_key", P.compose_key(F.col("regatta"), F.col("race")))
    clean = clean.withColumn("fact_key", P.compose_key(F.col("race_key"), F.col("sail")))
    fact = _times(W.flag_ties(clean, ["regatta", "race", "division", "rank"], "rank"))
    dim_race = W.distinct_keys(clean.where("race_key is not null"), ["race_key", "regatta", "race"])
    dim_division = W.distinct_keys(clean.where("division is not null"), ["division"])
    measures = fact.select("fact_key", "race_key", *RESULTS[:3], "sail", "boat", "class", "club", "rating", "rank", "points", "elapsed_hms", "elapsed", "corrected_hms", "corrected", "corrected_missing", "tied")
    return {"fact_results": measures, "dim_boat": _boats(rows), "dim_race": dim_race, "dim_division": dim_division, "report": _star_report(rows)}


def _results(rows: DataFrame) -> dict[str, Column]:
    """The columns ``RESULTS`` as the star holds them, by name."""

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    def number(name: str) -> Column:
        """What is stored as a number needs no way through its text."""
        return F.col(name) if rows.schema[name].dataType.typeName() in ("double", "long", "integer", "short", "byte") else text(name)

    names = {c: P.normalize_text(text(c)) for c in ("division", "sail", "boat", "class", "club")}
    whole = {c: P.coerce_integer(number(c)) for c in ("regatta", "race", "rank")}
    return names | whole | {c: number(c).try_cast("double") for c in ("rating", "points")} | {c: to_seconds(text(c)) for c in ("elapsed", "corrected")}


def _boats(rows: DataFrame) -> DataFrame:
    """(sail, boat, class, club, rating): the first of each text and the median rating.

    Equal spellings are grouped before they are normalised. Blank sails go by their spelling, and the normalised ones can't be null: a filter on these would be
    pushed down to every row.
    """
    rows = rows.where(F.trim(F.col("sail").cast("string")) != "")
    made, spelled, order = _results(rows), ["sail", "boat", "class", "club"], ["regatta", "race", "rank"]
    sail = F.coalesce(made["sail"], F.lit("")).alias("sail")
    forms = rows.groupBy(*spelled).agg(F.min(F.struct(*[made[c].alias(c) for c in order])).alias("_first"))
    boats = forms.select("_first", sail, *[made[c].alias(c) for c in spelled[1:]]).withColumn("_o", F.struct("_first.*", *spelled[1:]))
    ratings = rows.groupBy("sail", "rating").agg(F.count("*").alias("n")).select(sail, made["rating"].alias("rating"), "n")
    return A.collapse_dim(boats, "sail", "_o", spelled[1:], "rating", ratings)


def _star_report(rows: DataFrame) -> DataFrame:
    """The checks (name, n) in one pass over the rows: what they are made of is counted by its spelling and normalised after that."""
    made, places = _results(rows), ["regatta", "race", "division", "rank"]
    alone = ["sail", "elapsed", "corrected"]
    counts = rows.groupingSets([places, *[[c] for c in alone]], *places, *alone).agg(F.count("*").alias("n"), F.grouping("rank").alias("_place"), *[F.grouping(c).alias(f"_{c}") for c in alone])
    kind = F.when(F.col("_place") == 0, "place")
    for c in alone:
        kind = kind.when(F.col(f"_{c}") == 0, c)
    keys = [kind.alias("kind"), *[made[c].alias(c) for c in places], made["sail"].alias("sail"), *[made[c].isNull().alias(f"no_{c}") for c in ("elapsed", "corrected")]]
    groups = counts.select(*keys, "n").groupBy("kind", *places, "sail", "no_elapsed", "no_corrected").agg(F.sum("n").alias("n"))
    place, race = F.col("kind") == "place", P.compose_key(F.col("regatta"), F.col("race"))

    def rows_with(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    checks = {
        "rows": rows_with(place),
        **{f"missing_{c}": rows_with((F.col("kind") == c) & F.col(f"no_{c}")) for c in ("elapsed", "corrected")},
        "missing_sail": rows_with((F.col("kind") == "sail") & F.col("sail").isNull()),
        "tie_groups": F.count_if(place & F.col("rank").isNotNull() & (F.col("n") > 1)),
        "boats": F.count_if((F.col("kind") == "sail") & F.col("sail").isNotNull()),
        "races": F.count_distinct(F.when(place, race)),
        "divisions": F.count_distinct(F.when(place, F.col("division"))),
    }
    one = groups.agg(*[c.alias(name) for name, c in checks.items()])
    return one.selectExpr(f"stack({len(checks)}, {', '.join(f'{chr(39)}{name}{chr(39)}, {name}' for name in checks)}) as (name, n)")


def backfill_times(fact: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fact with missing times from rows of ``raw`` (regatta, race, sail, elapsed, corrected) with the same keys, trimmed and in any case;
    and how complete both times were before and after, in percent."""
    keys = {c: P.coerce_integer(F.col(c).cast("string")) for c in ("regatta", "race")}
    times = {c: to_seconds(F.col(c).cast("string")) for c in ("elapsed", "corrected")}
    filled = _times(J.backfill(fact, raw.withColumns(keys | times), ["regatta", "race", "sail"], ["elapsed", "corrected"]))

    def complete(df: DataFrame, when: str) -> DataFrame:
        shares = [F.coalesce(F.count(c) * 100.0 / F.count("*"), F.lit(0.0)).alias(c) for c in ("elapsed", "corrected")]
        return df.agg(*shares).select(F.lit(when).alias("state"), "elapsed", "corrected")

    return filled, complete(fact, "before").unionByName(complete(filled, "after"))


def run_fashion(products: DataFrame, transactions: DataFrame, days: int = 30, as_of: Column | None = None) -> dict[str, DataFrame]:
    """Staged products and transactions as cleaned dimension and fact, the gates, and the ten best ranks of products of each region in the last ``days`` days."""
    dim = P.transform_products(products)
    fact = P.transform_transactions(transactions, dim)
    by = P.trailing(fact, "sale_date", days, as_of).groupBy("region", "product_id").agg(F.sum("quantity").alias("units"))
    return {"products": dim, "sales": fact, "gates": Q.table_gates(dim, fact), "recommendations": W.top_n_per(by, ["region"], "units", 10, "product_id", dense=True)}


def run_retail_elt(sales: DataFrame, customers: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sales with their customer and product and a total (derived where the table has none), and the control totals."""
    joined = J.left_join_renamed(J.left_join_renamed(sales, customers, "customer_id", "c_id"), products, "product_id", "p_id")
    joined = P.derive_if_missing(joined, "total", F.col("quantity") * F.col("unit_price"))
    return joined, joined.agg(F.round(F.sum("total"), 2).alias("total"), F.count_distinct("customer_id").alias("clients"))


def price_elasticity(weekly: DataFrame, products: DataFrame, min_product: int = 12, min_category: int = 50) -> DataFrame:
    """Elasticity of each product with enough weeks, that of its category where it has too few, promotion uplift and advice."""
    own = A.elasticity(weekly, "product_id", min_product)
    known = weekly.join(products.select("product_id", "category"), "product_id")
    by_category = A.elasticity(known, "category", min_category).select("category", "elasticity")
    filled = J.with_category_fallback(own.select("product_id", "elasticity"), products, by_category, "elasticity")
    sold = filled.join(own.select("product_id", "n"), "product_id", "left").join(A.promo_uplift(weekly, "product_id"), "product_id", "left")
    return sold.withColumn("advice", recommend(F.col("elasticity"), F.when(F.col("n").isNotNull(), F.col("uplift"))))


def run_catalog(spark: SparkSession, root: str, schema: str, out: str | None = None) -> dict[str, DataFrame]:
    """Raw product files by source and day: latest per key, written to ``out`` by source and day if given, and the summary queries."""
    raw = T.read_partitioned_json(spark, root, schema)
    latest = W.latest_by(raw, ["source", "id"], "ingest_ts", "run_date")
    if out is not None:
        T.write_partitioned(latest, out, "source", "run_date")
        latest = spark.read.parquet(out)
    return {"silver": latest, "top_brands": A.top_groups(latest, "brand", 10), "prices": A.bucket_counts(latest, P.price_bucket(F.col("price"))), "ratings": A.average_by(latest, "category", "rating")}
