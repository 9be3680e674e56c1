"""Windowed metrics that run unchanged on batch tables and on streams; a watermark bounds a stream's state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions.scalars import endpoint, is_server_error, parse_clf, status_class
from tabulon.operators.ranks import grouped_quantiles
from tabulon.session import cut, spread


def with_lateness(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Rows later than ``delay`` behind the newest one may be dropped; without effect on a batch."""
    return df.withWatermark(column, delay) if df.isStreaming else df


def with_window_bounds(df: DataFrame, column: str = "window") -> DataFrame:
    return df.withColumns({"window_start": F.col(f"{column}.start"), "window_end": F.col(f"{column}.end")}).drop(column)


def parse_logs(lines: DataFrame) -> DataFrame:
    """Parsed access-log records; lines that don't parse go."""
    rows = lines.where(F.length(F.trim("line")) > 0).withColumn("r", parse_clf(F.col("line"))).where("r is not null")
    return rows.select("r.*").withColumns({"endpoint": endpoint(F.col("request_line")), "status": status_class(F.col("status_code"))})


def windowed_count(df: DataFrame, time: str, size: str, delay: str, keys: list[str] | None = None, slide: str | None = None, name: str = "n") -> DataFrame:
    late = with_lateness(df, time, delay)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return with_window_bounds(late.groupBy(window.alias("window"), *(keys or [])).agg(F.count("*").alias(name)))


def requests_per_minute(logs: DataFrame) -> DataFrame:
    return windowed_count(logs, "timestamp", "1 minute", "2 minutes", name="requests")


def errors_per_minute(logs: DataFrame) -> DataFrame:
    return windowed_count(logs.where(is_server_error(F.col("status_code"))), "timestamp", "1 minute", "2 minutes", name="errors")


def status_distribution(logs: DataFrame) -> DataFrame:
    return windowed_count(logs, "timestamp", "1 minute", "2 minutes", ["status"])


def error_rate(logs: DataFrame) -> DataFrame:
    """Requests, server errors and their share in percent per minute, in one pass."""
    late = with_lateness(logs, "timestamp", "2 minutes")
    sums = late.groupBy(F.window("timestamp", "1 minute").alias("window")).agg(F.count("*").alias("requests"), F.count_if(is_server_error(F.col("status_code"))).alias("errors"))
    return with_window_bounds(sums.withColumn("error_rate", F.col("errors") * 100.0 / F.col("requests")))


def top_endpoints(logs: DataFrame, min_hits: int = 5) -> DataFrame:
    return windowed_count(logs, "timestamp", "5 minutes", "2 minutes", ["endpoint"], "1 minute", "hits").where(F.col("hits") > min_hits)


def gmv_per_minute(orders: DataFrame, time: str = "ts", value: str = "value") -> DataFrame:
    late = with_lateness(orders, time, "5 minutes")
    sums = late.groupBy(F.window(time, "1 minute").alias("window")).agg(F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("gmv"), F.count("*").alias("orders"))
    return with_window_bounds(sums)


def product_counts(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    return windowed_count(events, "ts", size, "5 minutes", ["product_id"], slide)


def windowed_sums(df: DataFrame, sub: str, value: Column, seconds: int, delay: str = "5 minutes") -> DataFrame:
    """Sums per product, window and ``sub``, and over all of them as 'ALL'; on a stream too."""
    late = with_lateness(df, "ts", delay).withColumn("_v", value)
    both = late.withColumn(sub, F.explode(F.array(F.col(sub).cast("string"), F.lit("ALL"))))
    return with_window_bounds(both.groupBy(F.window("ts", f"{seconds} seconds").alias("window"), "product_id", sub).agg(F.sum("_v").alias("total")))


def orders_per_minute(orders: DataFrame, time: str = "ts") -> DataFrame:
    return windowed_count(orders, time, "1 minute", "5 minutes", name="orders")


def sales_performance(sales: DataFrame, size: str = "1 hour", slide: str = "5 minutes", keys: tuple[str, ...] = ("warehouse", "country"), time: str = "event_time") -> DataFrame:
    """Revenue, units, margin and (approximate on a stream) distinct orders per sliding window of enriched sales.

    On a table a sale is in one pane of the slide's length, and panes make the windows: no sale is repeated for its windows. A window counts an order
    in the first of its panes that has it, so an order's pane counts for the windows that begin after the one before it.
    """
    each, step = _micros(size), _micros(slide)
    if not sales.isStreaming and each % step == 0:
        paned = spread(sales, "order_id").withColumn("_pane", F.window(time, slide)["start"])
        before = F.lag("_pane").over(Window.partitionBy(*keys, "order_id").orderBy("_pane"))
        starts = [F.col("_pane") - F.expr(f"INTERVAL {i * step} MICROSECONDS") for i in range(each // step)]
        new = reduce(Column.__add__, [F.when(F.col("_before").isNull() | (s > F.col("_before")), 1).otherwise(0) for s in starts])
        new = F.when(F.col("order_id").isNull(), 0).otherwise(new)
        panes = paned.withColumn("_before", before).groupBy("_pane", *keys, new.alias("_new")).agg(F.sum("amount").alias("_a"), F.sum("quantity").alias("_q"), F.sum("margin").alias("_m"), F.count("*").alias("_n"))
        windows = panes.select("*", F.posexplode(F.array(*starts)).alias("_i", "window_start"))
        orders = F.sum(F.when(F.col("_i") < F.col("_new"), F.col("_n")).otherwise(0)).alias("orders")
        sums = windows.groupBy("window_start", *keys).agg(F.sum("_a").cast("double").alias("revenue"), F.sum("_q").alias("units"), F.sum("_m").cast("double").alias("margin"), orders)
        return sums.select(*keys, "revenue", "units", "margin", "orders", "window_start", (F.col("window_start") + F.expr(f"INTERVAL {each} MICROSECONDS")).alias("window_end"))
    late = with_lateness(sales, time, "26 hours")
    orders = F.approx_count_distinct("order_id") if sales.isStreaming else F.count_distinct("order_id")
    sums = late.groupBy(F.window(time, size, slide).alias("window"), *keys).agg(F.sum("amount").cast("double").alias("revenue"), F.sum("quantity").alias("units"), F.sum("margin").cast("double").alias("margin"), orders.alias("orders"))
    return with_window_bounds(sums)


def order_anomalies(totals: DataFrame, k: float = 1.5, size: str = "24 hours", slide: str = "1 hour", keys: tuple[str, ...] = ("warehouse", "country"), time: str = "last_time", value: str = "order_total", accuracy: int = 100) -> DataFrame:
    """Every order in each of its windows, with the quartiles there and whether it is outside their fences.

    Quartiles are exact; on a stream they are approximate, by ``accuracy``. A window whose quartiles agree has no anomalies.
    """
    q1, q3, iqr = F.col("q1"), F.col("q3"), F.col("q3") - F.col("q1")
    outside = (F.col(value) < q1 - k * iqr) | (F.col(value) > q3 + k * iqr)
    marked = {"iqr": iqr, "is_anomalous": (q1 != q3) & outside}
    if totals.isStreaming:
        windows = totals.withColumn("window", F.window(time, size, slide))
        stats = windows.groupBy("window", *keys).agg(F.percentile_approx(value, [0.25, 0.75], accuracy).alias("q"))
        stats = stats.select("window", *keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
        return with_window_bounds(windows.join(stats, ["window", *keys]).withColumns(marked))
    totals = cut(totals)
    each, step = _micros(size), _micros(slide)
    if each % step == 0:
        paned, steps = totals.withColumn("pane", F.window(time, slide)), [F.expr(f"INTERVAL {i * step} MICROSECONDS") for i in range(each // step)]
    else:
        paned, steps = totals.withColumn("pane", F.window(time, size, slide)), [F.expr("INTERVAL 0 MICROSECONDS")]
    # written, so that Spark knows how small the quartiles are before it would shuffle each order once for each of its windows
    stats = cut(grouped_quantiles(paned, keys, value, {"q1": 0.25, "q3": 0.75}, F.col("pane.start"), steps))
    windows = with_window_bounds(totals.withColumn("window", F.window(time, size, slide)))
    return windows.join(stats, ["window_start", *keys]).withColumns(marked)


def _order_sessions(sales: DataFrame, gap: str, keys: tuple[str, ...], delay: str) -> DataFrame:
    orders = with_lateness(sales, "event_time", delay).groupBy(F.session_window("event_time", gap).alias("session"), "order_id", *keys)
    return orders.agg(F.max("event_time").alias("last_time"), F.sum("amount").cast("double").alias("order_total"), F.sum("quantity").alias("units"))


def order_totals_stream(sales: DataFrame, gap: str = "30 minutes", keys: tuple[str, ...] = ("warehouse", "country"), delay: str = "26 hours") -> DataFrame:
    """(order_id, keys, last_time, order_total, units) of the orders that are complete, each once; the totals that ``order_anomalies_stream`` compares."""
    return _order_sessions(sales, gap, keys, delay).drop("session")


def closed_anomalies(totals: DataFrame, watermark: str | None, gap: str = "30 minutes", k: float = 1.5, size: str = "24 hours", slide: str = "1 hour", keys: tuple[str, ...] = ("warehouse", "country")) -> DataFrame:
    """What ``order_anomalies_stream`` gives up to a ``watermark`` (UTC; none: nothing), with exact quartiles, from the table that a stream of ``order_totals_stream`` writes.

    The stream keeps the orders that are open, and an order is written once instead of once for each of its windows.
    """
    found = order_anomalies(totals, k, size, slide, keys)
    end = F.col("window_end").cast("timestamp") + F.expr(f"INTERVAL {_micros(gap) - 1} MICROSECONDS")
    return found.where(end <= F.lit(watermark).cast("timestamp"))


def order_anomalies_stream(sales: DataFrame, gap: str = "30 minutes", k: float = 1.5, size: str = "24 hours", slide: str = "1 hour", keys: tuple[str, ...] = ("warehouse", "country"), delay: str = "26 hours", accuracy: int = 100) -> DataFrame:
    """``order_anomalies`` of the totals of sales (order_id, event_time, amount, quantity), as a stream: each order in each of its windows once that window is closed.

    An order is complete when no line of it came for ``gap`` of event time (lines further apart are orders of their own). Its total moves on with the time of
    its session's end; windows are shifted by the same, so they are those of the last line's time. Statistics are a second aggregation of these totals, and meet
    them again in a join of both streams on the window, whose end lets the state go. On a table the result is the same.
    """
    closed = _order_sessions(sales, gap, keys, delay).withColumn("closed", F.window_time("session")).drop("session")  # a microsecond before the session's end
    shift = _micros(gap) - 1
    window = F.window("closed", size, slide, f"{shift % _micros(slide)} microseconds")
    stats = closed.groupBy(window.alias("window"), *keys).agg(F.percentile_approx("order_total", [0.25, 0.75], accuracy).alias("q"))
    both = closed.withColumn("window", window).join(stats, ["window", *keys])
    q1, q3 = F.col("q")[0], F.col("q")[1]
    outside = (F.col("order_total") < q1 - k * (q3 - q1)) | (F.col("order_total") > q3 + k * (q3 - q1))
    moved = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(shift / 1e6).cast("decimal(18,6)"))
    return both.select(
        "order_id", *keys, "last_time", "order_total", "units", q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"), ((q3 != q1) & outside).alias("is_anomalous"),
        (F.col("window.start") - moved).alias("window_start"), (F.col("window.end") - moved).alias("window_end"),
    )


UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def _micros(duration: str) -> int:
    parts = duration.split()
    return sum(int(number) * UNITS[unit.rstrip("s")] * 1_000_000 for number, unit in zip(parts[::2], parts[1::2], strict=True))


def enrich_stream(sales: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sales of known products (product_id, product_name, category, avg_cost) with their margin, and the side stream of all others."""
    known = products.select("product_id", "product_name", "category", "avg_cost")
    both = sales.join(known, "product_id", "left")
    margin = (F.col("amount") - F.col("quantity").cast("decimal(18,4)") * F.col("avg_cost").cast("decimal(18,4)")).cast("decimal(18,2)")
    return both.where("product_name is not null").withColumn("margin", margin), both.where("product_name is null").select(*sales.columns)


def observe_counters(df: DataFrame, name: str, value: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with observed metrics: rows, nulls of each key, and least, greatest and sum of ``value``.

    A batch's are read from an ``Observation``, a stream's from ``observedMetrics`` of its progress, as ``progress_counters`` does.
    """
    metrics = [F.count("*").alias("rows"), *[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys]]
    if value is not None:
        metrics += [F.min(value).alias(f"min_{value}"), F.max(value).alias(f"max_{value}"), F.sum(value).alias(f"sum_{value}")]
    return df.observe(name, *metrics)


def progress_counters(query: StreamingQuery, name: str) -> list[dict]:
    """The observed metrics ``name`` of each recent micro-batch of a stream."""
    return [{k: row[k] for k in row.asDict()} for p in query.recentProgress if (row := p.observedMetrics.get(name)) is not None]


def sensor_stream(raw: DataFrame, schema: str = "sensor_id string, value string", payload: str = "value") -> DataFrame:
    """The fields of JSON sensor messages; a message that doesn't parse has nulls."""
    return raw.select(F.from_json(F.col(payload).cast("string"), schema).alias("data")).select("data.*")


def dedup_stream(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def parse_events(raw: DataFrame, schema: str, required: list[str], payload: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """JSON payloads as columns with ``error`` (null if fine), the raw text and the columns to ``keep``."""
    parsed = raw.select(*keep, F.from_json(payload, schema).alias("e"), F.col(payload).alias("raw"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"e.{r}").isNull(), F.lit(r)) for r in required]))
    error = F.when(F.col("e").isNull() | (F.size(missing) == len(required)), "malformed").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    return parsed.select(*keep, "e.*", error.alias("error"), "raw")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Rows with an error as JSON text, for a text or Kafka sink."""
    return parsed.where("error is not null").select(F.to_json(F.struct("error", "raw")).alias("value"))


def start_dead_letters(parsed: DataFrame, name: str, checkpoint: str, path: str) -> StreamingQuery:
    """The sink of dead letters: text files with a JSON row a line."""
    writer = dead_letters(parsed).writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.format("text").option("path", path).trigger(availableNow=True).start()


def inspect_dlq(dlq: DataFrame, n: int) -> DataFrame:
    """Errors by frequency, with an example of each."""
    e = F.from_json("value", "error string, raw string")
    return dlq.select(e.alias("e")).groupBy("e.error").agg(F.count("*").alias("n"), F.min("e.raw").alias("example")).orderBy(F.desc("n"), "error").limit(n)


def to_serving_rows(views: DataFrame) -> DataFrame:
    """Latest count per product as (row_key, family, qualifier, value, cell_ts)."""
    latest = views.groupBy("product_id").agg(F.max(F.struct("window_end", "n")).alias("m"))
    return latest.select(F.col("product_id").alias("row_key"), F.lit("stats").alias("family"), F.lit("view_count").alias("qualifier"), F.col("m.n").cast("string").alias("value"), F.col("m.window_end").alias("cell_ts"))


def guarded_batch(df: DataFrame, is_bad: Column, limit: float) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of a micro-batch; if more than ``limit`` of it is bad, all of it is dead letters.

    The share is a one-row subquery of the written batch, so no separate job runs, and the batch is kept while it is used twice.
    """
    flagged = df.withColumn("_bad", F.coalesce(is_bad, F.lit(True))).persist(StorageLevel.MEMORY_AND_DISK)
    stop = flagged.select(F.avg(F.col("_bad").cast("int")) > limit).scalar()
    dead = F.col("_bad") | F.coalesce(stop, F.lit(False))
    return flagged.where(~dead).drop("_bad"), flagged.where(dead).drop("_bad")
