"""Streams with chained state, tables that streams merge into, versions, counters: against their batch forms, late and repeated input included."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tabulon.operators import windows as W
from tabulon.sources import snapshots as S
from tabulon.sources import tables as T
from tabulon.streaming import metrics as R
from tabulon.streaming import progress as G

START = dt.datetime(2024, 1, 1)
SALES = "order_id long, event_time timestamp, warehouse string, country string, amount double, quantity long"


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns or df.columns).collect()))


def files(spark, tmp_path, parts, schema):
    """A stream that reads each part as a file of its own, in order."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            f.rename(tmp_path / "in" / f"{k:03d}.parquet")
            stamp = 1_700_000_000 + k
            os.utime(tmp_path / "in" / f"{k:03d}.parquet", (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def sales():
    rng = random.Random(8)
    rows = []
    for order in range(150):
        at = START + dt.timedelta(minutes=rng.randint(0, 36 * 60))
        if order % 10 == 0:
            at = at.replace(minute=0, second=0)  # on a window's border
        for line in range(rng.randint(1, 3)):
            rows.append((order, at + dt.timedelta(minutes=5 * line), f"w{order % 2}", "de", float(rng.choice([10, 12, 15, 500])), 1 + line))
    rng.shuffle(rows)
    return rows


def test_anomalies_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rows = sales()
    flush = [(10_000, START + dt.timedelta(days=30), "w9", "de", 1.0, 1)]
    late = [(3, START - dt.timedelta(days=9), "w1", "de", 9999.0, 1)]  # behind the watermark: dropped
    stream = files(spark, tmp_path, [rows[:100], rows[100:200], rows[200:], flush, late, flush], SALES)
    options = {"gap": "30 minutes", "size": "6 hours", "slide": "2 hours", "delay": "40 hours"}
    T.start(R.order_anomalies_stream(stream, **options), "anomalies", str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(170)
    got = spark.read.parquet(str(tmp_path / "out")).where("order_id < 10000")
    table = spark.createDataFrame(rows, SALES)
    whole = R.order_anomalies_stream(table, **options)
    assert rows_of(got, *whole.columns) == rows_of(whole) and got.where("is_anomalous").count() > 0
    totals = table.groupBy("order_id", "warehouse", "country").agg(F.max("event_time").alias("last_time"), F.sum("amount").alias("order_total"), F.sum("quantity").alias("units"))
    assert rows_of(R.order_anomalies(totals, 1.5, "6 hours", "2 hours"), *whole.columns) == rows_of(whole)


def test_latest_row_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(1, 20), START + dt.timedelta(minutes=rng.randint(0, 10_000)), rng.random()) for _ in range(200)]
    schema, root = "id long, at timestamp, v double", str(tmp_path / "t")
    stream = files(spark, tmp_path, [rows[:80], rows[80:120], rows[120:], []], schema)
    S.start_latest(stream, "latest", str(tmp_path / "c"), root, ["id"], ["at", "v"], 4).awaitTermination(120)
    want = rows_of(W.latest_by(spark.createDataFrame(rows, schema), ["id"], "at", "v"))
    assert rows_of(S.read_snapshot(spark, root)) == want
    before = S.versions(spark, root)
    assert S.merge(spark.createDataFrame([(1, dt.datetime(2030, 1, 1), 0.0)], schema), root, S.keep_latest(["id"], "at"), ["id"], 4, ("latest", 0)) == before[-1]
    assert rows_of(S.read_snapshot(spark, root)) == want and S.versions(spark, root) == before  # a repeated batch changes nothing
    S.merge(spark.createDataFrame([(99, START, 0.0)], schema), root, S.keep_latest(["id"], "at"), ["id"], 4)
    old, new = (S.manifest(spark, root, v)["folders"] for v in S.versions(spark, root)[-2:])
    assert sum(old.get(k) != f for k, f in new.items()) == 1  # one bucket was written


def test_ranks_of_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(START + dt.timedelta(minutes=rng.randint(0, 600)), f"p{min(rng.randint(0, 9), rng.randint(0, 9))}") for _ in range(400)]
    schema, keys = "ts timestamp, product_id string", ["window_start", "window_end"]
    stream = files(spark, tmp_path, [rows[:150], rows[150:300], rows[300:]], schema)
    counts = R.windowed_count(stream, "ts", "1 hour", "30 days", ["product_id"], "30 minutes")
    S.start_top_n(counts, "top", str(tmp_path / "c"), str(tmp_path / "t"), keys, "product_id", "n", 3, 4).awaitTermination(170)
    whole = R.windowed_count(spark.createDataFrame(rows, schema), "ts", "1 hour", "30 days", ["product_id"], "30 minutes")
    want = W.top_n_per(whole, keys, "n", 3, "product_id")
    assert rows_of(S.read_snapshot(spark, f"{tmp_path}/t/ranks"), *want.columns) == rows_of(want)


def test_versions_appear_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "v")
    df = spark.range(10)
    T.write_versioned(df, root, 1)
    broken = df.withColumn("x", F.raise_error(F.lit("killed")).cast("long"))
    with pytest.raises(Exception, match="killed"):
        T.write_versioned(broken, root, 2)
    (tmp_path / "v" / "v=2").mkdir()  # a write that was killed before it was published
    (tmp_path / "v" / "v=2" / "part-0.parquet").write_text("half a file")
    assert S.versions(spark, root) == [1] and S.read_snapshot(spark, root).count() == 10
    with pytest.raises(FileNotFoundError):
        T.read_version(spark, root, 2)
    T.write_versioned(df.where("id < 3"), root, 2)
    assert T.read_version(spark, root, 2).count() == 3
    with pytest.raises(S.VersionConflict):
        T.write_versioned(df, root, 2)
    with pytest.raises(S.VersionConflict):  # a second writer that began before the first one published
        S.publish(spark, root, 2, df.schema, {"": ["v=1"]}, {})
    assert T.read_version(spark, root, 2).count() == 3
    T.write_versioned(df.where("id < 5"), root, 3)
    assert S.clean_up(spark, root, keep=2) == ["_versions/000000000001", "v=1"]
    assert S.versions(spark, root) == [2, 3] and T.read_version(spark, root, 2).count() == 3 and (tmp_path / "v" / "v=2").exists()
    S.clean_up(spark, root, keep=2, hours=-1.0)
    assert not (tmp_path / "v" / "v=2").exists() and T.read_version(spark, root, 2).count() == 3 and T.read_version(spark, root, 3).count() == 5


def test_counters_of_late_rows(spark, tmp_path):
    schema = "id long, ts timestamp"
    new = [(k, START + dt.timedelta(hours=k)) for k in range(10)]
    late = [(100 + k, START - dt.timedelta(days=2)) for k in range(7)] + [(50, START + dt.timedelta(hours=9))]
    stream = files(spark, tmp_path, [new, [(60, START + dt.timedelta(hours=10))], late], schema)  # what is late is judged by the batch before
    table = G.ProgressTable(spark, str(tmp_path / "counters"))
    spark.streams.addListener(table)
    try:
        kept = R.observe_counters(R.dedup_stream(stream, ["id"], "ts", "2 hours"), "kept", "id")
        T.start(kept, "counted", str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(120)
        for _ in range(50):
            found = {r.counter: r.total for r in G.counter_totals(G.read_counters(spark, str(tmp_path / "counters")).where("query = 'counted'")).collect()} if (tmp_path / "counters").exists() else {}
            if found.get("input_rows") == 19:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(table)
    assert (found["input_rows"], found["dropped_by_watermark"], found["kept.rows"]) == (19, 7, 12)
