"""Order anomalies with exact fences, of tables and of the orders that a stream has completed."""

import datetime as dt

from pyspark.sql import functions as F

from tabulon.sources import tables as T
from tabulon.streaming import metrics as R
from tabulon.streaming import progress
from tests.test_quantiles import at

START = dt.datetime(2024, 1, 1)


def test_anomalies_have_exact_fences(spark):
    rows = [(i, "w", "c", START + dt.timedelta(minutes=i % 2000), float((i * 31) % 4001), 1) for i in range(4001)]
    totals = spark.createDataFrame(rows, "order_id long, warehouse string, country string, last_time timestamp, order_total double, units long")
    for size, slide in (("24 hours", "6 hours"), ("5 hours", "2 hours")):
        windows = totals.withColumn("w", F.window("last_time", size, slide)["start"]).collect()
        values = {}
        for r in windows:
            values.setdefault(r.w, []).append(r.order_total)
        found = R.order_anomalies(totals, 1.5, size, slide).collect()
        assert len(found) == len(windows)
        assert {(r.window_start, r.q1, r.q3) for r in found} == {(w, at(v, 0.25), at(v, 0.75)) for w, v in values.items()}


def test_closed_anomalies_from_complete_orders(spark, tmp_path):
    rows = [(i, START + dt.timedelta(minutes=13 * i), f"w{i % 2}", "de", float((i * 37) % 101) * (9 if i % 50 == 0 else 1), 1) for i in range(600)]
    schema = "order_id long, event_time timestamp, warehouse string, country string, amount double, quantity long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    options = {"size": "6 hours", "slide": "2 hours"}
    outs = {}
    for name, stream in (("joined", R.order_anomalies_stream), ("totals", R.order_totals_stream)):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = T.start(stream(source, **(options if name == "joined" else {})), name, str(tmp_path / f"c{name}"), str(tmp_path / name))
        query.awaitTermination(170)
        outs[name] = spark.read.parquet(str(tmp_path / name))
    assert outs["totals"].count() < 600  # open ones aren't written
    got = R.closed_anomalies(outs["totals"], progress.newest_watermark(query), **options)
    columns = outs["joined"].columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, outs["joined"].collect())) and got.where("is_anomalous").count() > 0
    assert R.closed_anomalies(outs["totals"], None, **options).isEmpty()
