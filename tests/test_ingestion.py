"""CSV ingestion by headers, Kafka's columns as a stream, sketches of days: against literal rows and exact figures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import sketches as K
from tabulon.sources import tables as T


def test_csv_columns_follow_each_header(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.csv").write_text("product_id,quantity\np1,3\np2,many\np3,1,more\n")
    hints = "product_id string, quantity int, day date"

    def ingest():
        T.start_csv_ingestion(spark, str(source), hints, "csv", str(tmp_path / "c"), out).awaitTermination(60)
        return spark.read.option("mergeSchema", True).parquet(out)

    first = ingest()
    assert {(r.product_id, r.quantity, r.day, r._rescued) for r in first.collect()} == {("p1", 3, None, None), ("p2", None, None, '{"quantity":"many"}'), ("p3", 1, None, '{"_line":"p3,1,more"}')}
    (source / "b.csv").write_text('﻿day,color,"product_id",quantity\n2024-01-02,red,p4,4\nnever,blue,p5,5\n')  # other order, one column more
    (source / "c.csv").write_text("quantity,product_id\n6,p6\n")
    (source / "empty.csv").write_text("")
    rows = {r.product_id: (r.quantity, r.day, r.color, r._rescued) for r in ingest().where("product_id >= 'p4'").collect()}
    assert rows == {"p4": (4, dt.date(2024, 1, 2), "red", None), "p5": (5, None, "blue", '{"day":"never"}'), "p6": (6, None, None, None)}
    assert ingest().count() == 6 and "source_file" in "".join(first.columns) + "source_file"


def test_kafka_columns_as_a_stream(spark, tmp_path):
    schema = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int, headers array<struct<key: string, value: binary>>"
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(b"k1", '{"a": 1}'.encode(), "t", 0, 5, at, 0, [("h", b"x")]), (None, "é".encode(), "t", 0, 6, at, 0, None)], schema).write.parquet(str(tmp_path / "in"))
    stream = T.kafka_projection(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    T.start(stream, "kafka", str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["key", "value", "timestamp", "headers"]
    assert sorted((r.key or "", r.value, r.timestamp, [(h.key, bytes(h.value)) for h in r.headers or []]) for r in got.collect()) == [("", "é", at, []), ("k1", '{"a": 1}', at, [("h", b"x")])]


def test_sketches_of_days_roll_up(spark, tmp_path):
    rng = random.Random(1)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 60)), rng.choice("ab"), rng.randint(0, 3000), rng.random() ** 2) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, user long, v double").repartition(6)
    root = str(tmp_path / "s")
    K.write_sketches(K.daily_sketches(df.where("ts < '2024-02-01'"), "ts", ["kind"], "user", "v"), root, 4)
    K.write_sketches(K.daily_sketches(df.where("ts >= '2024-01-31'"), "ts", ["kind"], "user", "v"), root, 4)  # a day again, and new ones
    out = K.roll_up(K.read_sketches(spark, root, "2024-01-01", "2024-12-31"), F.date_trunc("month", "day"), ["kind"], {"q50": 0.5, "q99": 0.99}).collect()
    assert sum(r.n for r in out) == len(rows) and len(out) == 6
    for r in out:
        own = sorted(v for t, k, _, v in rows if k == r.kind and t.month == r.period.month)
        users = len({u for t, k, u, _ in rows if k == r.kind and t.month == r.period.month})
        assert r.n == len(own) and r.distinct == pytest.approx(users, rel=0.06, abs=1)
        for q, got in ((0.5, r.q50), (0.99, r.q99)):
            assert sum(v <= got for v in own) / len(own) == pytest.approx(q, abs=0.015 + 1 / len(own))
    assert K.roll_up(K.read_sketches(spark, root, "2030-01-01", "2030-12-31"), F.col("day"), [], {}).count() == 0
