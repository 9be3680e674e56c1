"""Projection, cleaning and filter operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.folding import title_case
from tabulon.functions.scalars import canonical_gtin


def rename_dropna(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns, then drop rows with any null."""
    return df.withColumnsRenamed(dict(names)).dropna()


def parse_products(df: DataFrame) -> DataFrame:
    """Typed products from raw strings; values that don't parse become null."""
    return df.select(
        F.expr("try_cast(id as bigint)").alias("id"), F.trim("title").alias("title"), F.expr("try_cast(price as double)").alias("price"),
        F.expr("try_cast(rating as double)").alias("rating"), F.expr("try_cast(stock as int)").alias("stock"), F.col("brand"), F.lower(F.trim("category")).alias("category"),
    )


def standardise(df: DataFrame, upper: Sequence[str] = (), lower: Sequence[str] = (), trimmed: Sequence[str] = (), dates: Sequence[str] = (), money: Sequence[str] = ()) -> DataFrame:
    """Trim and case string columns, parse dates, fix money to decimal(12,2)."""
    out = {c: F.upper(F.trim(c)) for c in upper} | {c: F.lower(F.trim(c)) for c in lower} | {c: F.trim(c) for c in trimmed}
    out |= {c: F.expr(f"try_cast({c} as date)") for c in dates} | {c: F.expr(f"try_cast({c} as decimal(12,2))") for c in money}
    return df.withColumns(out)


def with_ingest_lineage(df: DataFrame) -> DataFrame:
    """When and from which file a row came."""
    return df.withColumns({"ingested_at": F.current_timestamp(), "source_file": F.input_file_name()})


def sale_amount(quantity: Column, price: Column, discount: Column) -> Column:
    return (quantity * price * (1 - F.coalesce(discount, F.lit(0.0)))).cast("decimal(18,4)").cast("decimal(12,2)")


def split_valid(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the predicate and all others, so that a null is never lost."""
    ok = F.coalesce(predicate, F.lit(False))
    return df.where(ok), df.where(~ok)


def derive_if_missing(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column unless the frame has it."""
    return df if name in df.columns else df.withColumn(name, value)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


# Known names of the columns of product catalogues.
CATALOGUE_ALIASES = {
    "name": ["name", "product_name"],
    "title": ["title", "product_title"],
    "brand": ["brand", "brand_name"],
    "model": ["model", "model_number", "mpn"],
    "description": ["description", "product_summary", "summary"],
    "price": ["price", "amount", "price_value", "sale_price"],
    "product_url": ["product_url", "page_url"],
    "image_url": ["image_url", "image"],
    "gtin": ["gtin", "gtin13", "gtin_13"],
    "ean": ["ean", "ean13"],
    "upc": ["upc", "upc12"],
    "sku": ["sku"],
}


def canonicalize_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = CATALOGUE_ALIASES, id_column: str = "product_identifier") -> DataFrame:
    """Canonical names for columns known by any of several names, in any case; what is missing becomes null.

    A missing gtin or ean comes from the digits of ``id_column`` where they make a code, a missing sku from its text.
    """
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[a.lower()] for a in (name, *others) if a.lower() in have), None) for name, others in aliases.items()}
    derived = {}
    if id_column.lower() in have:
        value = F.col(have[id_column.lower()]).cast("string")
        derived = {"gtin": canonical_gtin(value), "ean": canonical_gtin(value), "sku": F.when(F.trim(value) != "", value)}
    none = F.lit(None).cast("string")
    return df.select(*[(F.col(c) if c else derived.get(n, none)).alias(n) for n, c in found.items()])


def transform_products(df: DataFrame) -> DataFrame:
    """Cleaned product dimension: texts trimmed and in upper case, money with two digits, a missing update day from creation.

    Rows need an id, a name and a category, and a positive price and cost.
    """
    texts = {c: F.trim(F.upper(c)) for c in ("product_name", "category", "subcategory", "brand", "region")}
    money = {c: F.round(c, 2) for c in ("price", "cost")}
    kept = df.where("product_id is not null and product_name is not null and category is not null and price > 0 and cost > 0")
    return kept.withColumns(texts | money | {"updated_date": F.coalesce("updated_date", "created_date")})


def transform_transactions(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Cleaned fact: rows with ids and a day, positive quantity, price and total, of products that the cleaned dimension has."""
    kept = df.where("sale_id is not null and product_id is not null and sale_date is not null and quantity > 0 and unit_price > 0 and total_amount > 0")
    money = {c: F.round(c, 2) for c in ("unit_price", "total_amount")}
    texts = {c: F.trim(F.upper(c)) for c in ("region", "payment_method")}
    return kept.join(dim.select("product_id"), "product_id", "left_semi").withColumns(money | texts)


def normalize_text(value: Column) -> Column:
    """Trimmed, words capitalised (also after punctuation); blank becomes null."""
    return F.nullif(title_case(F.trim(value)), F.lit(""))


def coerce_integer(value: Column) -> Column:
    """Half-even rounding of a number in text; null where it doesn't parse."""
    return F.bround(value.try_cast("double"), 0).cast("long")


def compose_key(*parts: Column) -> Column:
    """Parts joined by '-', null if any part is."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("-", *[p.cast("string") for p in parts]))


def bands(value: Column, limits: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first limit that the value is below, else ``rest``; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in limits:
        out = out.when(value < limit, label)
    return out.otherwise(rest)


# Bands and states of the reports.
PRICE_BANDS = [(10, "< $10"), (50, "$10-$49"), (100, "$50-$99"), (500, "$100-$499")]
PRICE_REST = "$500+"
RATING_BANDS = [(4.5, "4.5-5.0"), (4.0, "4.0-4.4"), (3.5, "3.5-3.9"), (3.0, "3.0-3.4")]
RATING_REST = "< 3.0"
HEALTHY, MONITOR = 70, 35


def price_bucket(price: Column) -> Column:
    """The band of a price; a null price is in the last one."""
    return F.coalesce(bands(price, PRICE_BANDS, PRICE_REST), F.lit(PRICE_REST))


def rating_bucket(rating: Column) -> Column:
    """The band of a rating, from the top; a null rating is in the lowest one."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for limit, label in RATING_BANDS:
        out = out.when(rating >= limit, label)
    return out.otherwise(RATING_REST)


def stock_status(quantity: Column) -> Column:
    return F.when(quantity >= HEALTHY, "healthy").when(quantity >= MONITOR, "monitor").otherwise("reorder")


def pareto_label(within: Column) -> Column:
    return F.when(within, "Top 80 (vânzări)").otherwise("Bottom 20")


def lookup(value: Column, known: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def trailing(df: DataFrame, column: str, days: int, as_of: Column | None = None, newest: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; without it, before the latest value.

    ``newest`` gives that value in its first column: pass it from the base table where ``df`` is a costly view. The bound
    is a scalar subquery, so it filters the scan.
    """
    if as_of is None:
        last = newest if newest is not None else df.select(F.max(column))
        return df.where(F.col(column) >= last.scalar() - F.make_dt_interval(days=F.lit(days)))
    return df.where((F.col(column) >= as_of - F.make_interval(days=F.lit(days))) & (F.col(column) <= as_of))


def low_stock(df: DataFrame) -> DataFrame:
    return df.where(F.col("quantity_on_hand") < F.col("restock_threshold")).withColumn("reorder", F.col("quantity_on_hand") <= 40)


def row_level_filter(df: DataFrame, user_region: DataFrame, user: str) -> DataFrame:
    """Only rows of the regions that ``user`` may see."""
    return df.join(user_region.where(F.col("user") == user).select("region_id"), "region_id", "left_semi")


def repeatable_sample(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """About one row in ``one_in``, the same ones every time: by a digest of the key."""
    digest = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("long")
    return df.where(digest % one_in == 0)


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` rows in random order: a top-n, not a sort of the table."""
    return df.withColumn("_r", F.rand(seed) if seed is not None else F.rand()).orderBy("_r").limit(n).drop("_r")


def with_lineage(df: DataFrame, source: str, step: str, version: str = "1") -> DataFrame:
    """Source, step, time, version and an md5 of the row as JSON with sorted keys."""
    return df.withColumns({"lineage_source": F.lit(source), "lineage_step": F.lit(step), "lineage_time": F.current_timestamp(), "lineage_version": F.lit(version), "row_md5": F.md5(F.to_json(F.struct(*sorted(df.columns))))})


# What counts as personal data in text.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "uuid": r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "user_id": r"\buser[_-]?[0-9]+\b",
}


def detect_pii(df: DataFrame, column: str) -> DataFrame:
    """Counts of each kind of personal data, and the text with it masked."""
    masked = F.col(column)
    for kind, pattern in PII.items():
        masked = F.regexp_replace(masked, pattern, f"<{kind}>")
    return df.withColumns({f"n_{k}": F.regexp_count(column, F.lit(p)) for k, p in PII.items()} | {"masked": masked})


def apply_retention(df: DataFrame, column: str, years: int, as_of: Column) -> DataFrame:
    return df.where(F.col(column) >= F.add_months(F.to_date(as_of), -12 * years))


def apply_ttl(df: DataFrame, column: str, as_of: Column, days: int = 7) -> DataFrame:
    """Rows that haven't lived longer than ``days`` days."""
    return df.where(F.col(column) > as_of - F.make_dt_interval(days=F.lit(days)))


def filter_entries(df: DataFrame, level: str | None = None, since: Column | None = None, n: int = 100, time: str = "ts", level_column: str = "level", tie: str = "id", until: Column | None = None, status: str | None = None, status_column: str = "status") -> DataFrame:
    """Newest entries of a level and a status from ``since`` until before ``until``."""
    if until is not None:
        df = df.where(F.col(time) < until)
    if status is not None:
        df = df.where(F.col(status_column) == status)
    if level is not None:
        df = df.where(F.col(level_column) == level)
    if since is not None:
        df = df.where(F.col(time) >= since)
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def with_consent(df: DataFrame, consent: DataFrame, purpose: str) -> DataFrame:
    """Rows of users whose latest consent covers ``purpose`` and isn't withdrawn."""
    latest = consent.groupBy("user_id").agg(F.max_by(F.struct("purposes", "withdrawn"), "given_at").alias("c"))
    return df.join(latest.where(F.array_contains("c.purposes", purpose) & ~F.col("c.withdrawn")).select("user_id"), "user_id", "left_semi")
