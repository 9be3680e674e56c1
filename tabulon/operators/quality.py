"""Data-quality rules as data: each rule is a name, a severity and a predicate that flags a violation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    violated: Column
    field: str = ""
    kind: str = "business"
    severity: str = "error"


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``validation_errors`` (array of structs) and ``is_valid``; warnings don't make a row invalid."""
    found = [
        F.when(F.coalesce(r.violated, F.lit(False)), F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.kind).alias("error_type"), F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity")))
        for r in rules
    ]
    out = df.withColumn("validation_errors", F.array_compact(F.array(*found)))
    return out.withColumn("is_valid", ~F.exists("validation_errors", lambda e: e["severity"] == "error"))


def route(validated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows, rows with a schema error (dead letters), other invalid rows."""
    schema = F.exists("validation_errors", lambda e: (e["error_type"] == "schema") & (e["severity"] == "error"))
    return validated.where("is_valid"), validated.where(~F.col("is_valid") & schema), validated.where(~F.col("is_valid") & ~schema)


def required(*fields: str) -> list[Rule]:
    return [Rule(f"{f}_required", F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), f, "schema") for f in fields]


def short_text(*fields: str) -> list[Rule]:
    return [Rule(f"{f}_short", F.length(F.trim(F.col(f))) < 2, f, "completeness", "warning") for f in fields]


@dataclass(frozen=True)
class EventSchema:
    """What events of one type must look like: kinds are string, int or number, ranges hold both ends."""

    required: Sequence[str]
    kinds: Mapping[str, str]
    patterns: Mapping[str, str]
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    important: Sequence[str] = ()
    duplicate_key: Sequence[str] = ()


# Fields, patterns, ranges, important fields and duplicate keys of each event type.
EVENT_SCHEMAS = {
    "click": EventSchema(
        required=("event_type", "product_id", "user_id", "timestamp"),
        kinds={"event_type": "string", "product_id": "string", "user_id": "string", "session_id": "string", "page_type": "string", "user_agent": "string", "timestamp": "string"},
        patterns={
            "product_id": r"^product_[a-zA-Z0-9]+$", "user_id": r"^user_[a-zA-Z0-9]+$", "session_id": r"^session_[a-zA-Z0-9]+$",
            "page_type": r"^(product|category|search|home)$", "timestamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$",
        },
        important=("session_id", "page_type"),
        duplicate_key=("user_id", "product_id", "timestamp"),
    ),
    "transaction": EventSchema(
        required=("event_type", "product_id", "store_id", "quantity", "unit_price", "timestamp"),
        kinds={
            "event_type": "string", "product_id": "string", "store_id": "string", "quantity": "int", "unit_price": "number", "total_amount": "number",
            "currency": "string", "payment_method": "string", "timestamp": "string",
        },
        patterns={
            "product_id": r"^product_[a-zA-Z0-9]+$", "store_id": r"^store_[a-zA-Z0-9]+$", "currency": r"^[A-Z]{3}$",
            "payment_method": r"^(credit_card|paypal|apple_pay|google_pay)$", "timestamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$",
        },
        ranges={"quantity": (1, 1000), "unit_price": (0.01, 10000.00)},
        important=("currency", "payment_method"),
        duplicate_key=("transaction_id",),
    ),
    "stock": EventSchema(
        required=("event_type", "product_id", "warehouse_id", "quantity_change", "timestamp"),
        kinds={"event_type": "string", "product_id": "string", "warehouse_id": "string", "quantity_change": "int", "reason": "string", "timestamp": "string"},
        patterns={
            "product_id": r"^product_[a-zA-Z0-9]+$", "warehouse_id": r"^warehouse_[a-zA-Z0-9]+$",
            "reason": r"^(restock|sale|return|adjustment|damaged|transfer)$", "timestamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$",
        },
        ranges={"quantity_change": (-10000, 10000)},
        important=("reason",),
        duplicate_key=("product_id", "warehouse_id", "timestamp"),
    ),
}


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")


def schema_rules(columns: Sequence[str], schemas: Mapping[str, EventSchema] = EVENT_SCHEMAS, kind: str = "event_type") -> list[Rule]:
    """Rules by event type on the frame's ``columns``: known type, required fields, types, patterns and ranges.

    A field that the frame lacks counts as missing. Numbers may come as text: one that doesn't parse has the wrong type
    and no range.
    """
    here = set(columns)
    rules = [Rule("valid_event_type", ~F.coalesce(F.col(kind).isin(*schemas), F.lit(False)), kind, "schema")]
    for name, schema in schemas.items():
        own = F.col(kind) == name
        rules += [Rule("required_field", own & (_blank(f) if f in here else F.lit(True)), f, "schema") for f in schema.required]
        for f, k in schema.kinds.items():
            if f in here and k != "string":
                parsed = F.col(f).cast("string").try_cast("long" if k == "int" else "double")
                rules.append(Rule("field_type", own & F.col(f).isNotNull() & parsed.isNull(), f, "schema"))
        rules += [Rule("field_pattern", own & ~F.col(f).cast("string").rlike(p), f, "schema") for f, p in schema.patterns.items() if f in here]
        rules += [Rule("field_range", own & ~F.col(f).cast("string").try_cast("double").between(lo, hi), f, "schema") for f, (lo, hi) in schema.ranges.items() if f in here]
    return rules


def completeness_rules(columns: Sequence[str], texts: Sequence[str], schemas: Mapping[str, EventSchema] = EVENT_SCHEMAS, kind: str = "event_type") -> list[Rule]:
    """Warnings: texts of fewer than two characters, and missing fields that are important for their event type."""
    rules = [Rule("data_completeness", F.length(F.trim(F.col(t))) < 2, t, "completeness", "warning") for t in texts]
    for name, schema in schemas.items():
        for f in schema.important:
            missing = F.col(f).isNull() | (F.col(f).cast("string") == "") if f in columns else F.lit(True)
            rules.append(Rule("important_field_missing", (F.col(kind) == name) & missing, f, "completeness", "warning"))
    return rules


def transaction_rules(quantity: str, price: str, total: str, payment: str) -> list[Rule]:
    """The total is quantity times price; over 1000 only credit cards are usual. Missing numbers count as 0."""
    q, p, t = (F.coalesce(F.col(c), F.lit(0)) for c in (quantity, price, total))
    return [
        Rule("transaction_amount_calculation", F.abs(t - F.round(q * p, 2)) > 0.01, total, "business_rule"),
        Rule("high_value_transaction_payment", (t > 1000) & ~F.coalesce(F.col(payment).isin("credit_card"), F.lit(False)), payment, "business_rule", "warning"),
    ]


def stock_rules(change: str, reason: str) -> list[Rule]:
    """Large changes and negative ones need a reason that fits."""
    c = F.col(change)

    def other(*reasons: str) -> Column:
        return ~F.coalesce(F.col(reason).isin(*reasons), F.lit(False))

    return [
        Rule("large_stock_change_reason", (F.abs(c) > 1000) & other("restock", "adjustment"), reason, "business_rule", "warning"),
        Rule("negative_stock_reason", (c < 0) & other("sale", "damaged", "return"), reason, "business_rule", "warning"),
    ]


def click_rules(session: str) -> list[Rule]:
    """A session's number is usually from 1 to 1 000 000; sessions that aren't numbered pass."""
    number = F.replace(F.col(session), F.lit("session_"), F.lit(""))
    out = ~F.trim(number).try_cast("decimal(38,0)").between(1, 1_000_000)
    return [Rule("session_id_range", number.rlike(r"^\s*[+-]?[0-9]+\s*$") & out, session, "business_rule", "warning")]


def duplicate_rule(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that share their key with another one; a null key is no key."""
    return _with_duplicates(df, F.when(_all_known(keys), F.struct(*keys)))


def _all_known(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def _with_duplicates(df: DataFrame, key: Column) -> DataFrame:
    """Counted in one aggregate and joined back, so that no key's rows must meet in one task."""
    rows = df.withColumn("_key", key)
    repeated = rows.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    return rows.join(repeated, "_key", "left").withColumn("is_duplicate", F.col("_n").isNotNull()).drop("_key", "_n")


def window_duplicates(df: DataFrame, time: str, size: str, schemas: Mapping[str, EventSchema] = EVENT_SCHEMAS, kind: str = "event_type") -> DataFrame:
    """Events whose key by their type occurs again within the same window of ``time``; a missing field of a key counts as empty."""
    parts = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, schema in schemas.items():
        values = [F.coalesce(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit("") for f in schema.duplicate_key]
        parts = parts.when(F.col(kind) == name, F.md5(F.concat_ws("|", *values)))
    return _with_duplicates(df, F.when(parts.isNotNull(), F.struct(F.window(time, size)["start"].alias("w"), F.col(kind).alias("t"), parts.alias("k"))))


def expect_or_fail(df: DataFrame, name: str, predicate: Column) -> DataFrame:
    """The job fails at the first row that violates."""
    return df.where(F.when(F.coalesce(predicate, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"expectation {name} failed")).cast("boolean")))


def expect_or_drop(df: DataFrame, name: str, predicate: Column) -> tuple[DataFrame, Observation]:
    """Only rows that satisfy, and an observation of ``dropped`` and ``total``, which can be read after an action."""
    ok, seen = F.coalesce(predicate, F.lit(False)), Observation(name)
    return df.observe(seen, F.count_if(~ok).alias("dropped"), F.count("*").alias("total")).where(ok), seen


def violations(df: DataFrame, table: str, expectations: Mapping[str, Column]) -> DataFrame:
    """(table, expectation, violations) in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(p, F.lit(False))).alias(f"v{i}") for i, p in enumerate(expectations.values())])
    rows = ", ".join(f"'{n}', v{i}" for i, n in enumerate(expectations))
    return one.selectExpr(f"'{table}' as `table`", f"stack({len(expectations)}, {rows}) as (expectation, violations)")


def dq_counters(validated: DataFrame) -> DataFrame:
    """Rows in all, valid, invalid, repeated (where ``is_duplicate`` was set), with a schema error, and violations of rules."""
    kinds = F.transform("validation_errors", lambda e: e["error_type"])
    repeated = F.count_if(F.col("is_duplicate")) if "is_duplicate" in validated.columns else F.lit(0).cast("long")
    return validated.agg(
        F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), repeated.alias("duplicates"),
        F.count_if(F.array_contains(kinds, "schema")).alias("missing"), F.sum(F.size("validation_errors")).alias("rule_violations"),
    )


def check_unique(df: DataFrame, column: str, sample: int = 10) -> DataFrame:
    """The first repeated values with how often they occur."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").orderBy(column).limit(sample)


def check_fk(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    orphans = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    return orphans.agg(F.count("*").alias("orphans"), F.count_distinct(child_key).alias("orphan_keys"))


def completeness(df: DataFrame, columns: Sequence[str], gate: float = 95.0) -> DataFrame:
    one = df.agg(*[(F.avg(F.col(c).isNotNull().cast("int")) * 100).alias(c) for c in columns])
    rows = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {rows}) as (name, percent)").withColumn("passed", F.col("percent") >= gate)


def table_gates(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Counts that must be 0: products and sales with a value that isn't positive, sales of unknown products."""
    p = products.agg(F.count_if(~(F.col("price") > 0)).alias("n")).select(F.lit("product_price").alias("gate"), "n")
    s = sales.agg(F.count_if(~(F.col("quantity") > 0)).alias("n")).select(F.lit("sale_quantity").alias("gate"), "n")
    o = sales.join(products.select("product_id"), "product_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("sale_orphan").alias("gate"), "n")
    return p.unionByName(s).unionByName(o).withColumn("passed", F.col("n") == 0)


def require_gates(gates: DataFrame) -> None:
    """Fail with every gate that didn't pass; the table has a row a gate."""
    failed = [f"{r['gate']}: {r['n']}" for r in gates.where(~F.col("passed")).orderBy("gate").collect()]
    if failed:
        raise ValueError("gates failed: " + "; ".join(failed))


def check_stock(reconciled: DataFrame) -> DataFrame:
    """Of reconciled stock: rows, rows that don't agree with what was sold (clamped at 0), rows below 0."""
    return reconciled.agg(F.count("*").alias("rows"), F.count_if(~F.col("consistent")).alias("inconsistent"), F.count_if(F.col("after") < 0).alias("negative"))


def audit_cash(df: DataFrame, tol: float = 0.01) -> DataFrame:
    diff = F.abs(F.col("begin_balance") + F.col("inflows") - F.col("outflows") - F.col("end_balance"))
    return df.withColumns({"abs_diff": diff, "ok": diff < tol})


def audit_cost_of_sales(df: DataFrame, tol: float = 0.01) -> DataFrame:
    diff = F.abs(F.col("unit_cost") * F.col("units_sold") - F.col("total_cost"))
    return df.withColumns({"abs_diff": diff, "ok": diff < tol})


def audit_ppe(df: DataFrame, tol: float = 0.01) -> DataFrame:
    diff = F.abs(F.col("acquisition_cost") - F.col("accum_depreciation") - F.col("net_book_value"))
    return df.withColumns({"abs_diff": diff, "ok": diff < tol})


def alert_thresholds(events: DataFrame, seconds: int, least_rate: float) -> DataFrame:
    """Every window between the first and the last event, also empty ones, with its alerts."""
    counts = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("window_start"), "n", "errors")
    ends = counts.agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi"))
    calendar = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {seconds} seconds"))).alias("window_start"))
    out = calendar.join(counts, "window_start", "left").fillna(0, ["n", "errors"])
    share = F.try_divide(F.col("errors"), F.col("n"))
    level = F.when(share > 0.5, "critical").when(share > 0.1, "warning").otherwise("ok")
    return out.select("window_start", "n", "errors", (F.col("n") / seconds < least_rate).alias("low_volume"), level.alias("error_level"))


def check_fresh(df: DataFrame, column: str, minutes: int, as_of: Column) -> DataFrame:
    return df.agg((F.count_if(F.col(column) > as_of - F.make_interval(mins=F.lit(minutes))) > 0).alias("fresh"))
