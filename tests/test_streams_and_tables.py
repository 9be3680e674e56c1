"""Streams against their batch forms; readers and writers as round trips."""

import datetime as dt
import gzip

from pyspark.sql import functions as F

from tabulon.plans import pipelines
from tabulon.sources import tables as T
from tabulon.streaming import metrics as R


def lines():
    out = []
    for minute in range(12):
        for k in range(minute % 3 + 1):
            out.append(f'10.0.0.{k} - - [01/Jan/2024:00:{minute:02d}:{k:02d} +0000] "GET /a?x={k} HTTP/1.1" {500 if k else 200} {k} "-" "agent"')
    return [*out, "broken", "", '10.0.0.9 - - [01/Jan/2024:06:00:00 +0000] "GET /late HTTP/1.1" 500 1 "-" "agent"']


def test_log_stream_equals_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.log").write_text("\n".join(lines()))
    for query in pipelines.run_log_analytics(spark, str(source), str(out)):
        query.awaitTermination(120)
    batch = R.parse_logs(spark.createDataFrame([(x,) for x in lines()], "line string"))
    assert spark.read.parquet(f"{out}/silver").count() == batch.count()
    closed = F.col("window_end") <= F.lit(dt.datetime(2024, 1, 1, 5, 58))
    for name, metric in (("rpm", R.requests_per_minute), ("errors", R.errors_per_minute), ("status", R.status_distribution)):
        want = metric(batch).where(closed)
        got = spark.read.parquet(f"{out}/{name}").select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_foreach_batch_sink_is_idempotent_by_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"product_id": "P1", "t": 1704067200000}\n{"product_id": "P1", "t": 1704067201000}\n')
    stream = T.read_json_stream(spark, str(tmp_path / "in"), "product_id string, t long", "t").withColumnRenamed("t", "ts")
    counts = R.product_counts(stream, "1 minute")
    T.to_table_foreach_batch(counts, "views", str(tmp_path / "cp"), str(tmp_path / "out"), lambda b: b.withColumn("day", F.to_date("window_start"))).awaitTermination(60)
    assert [(r.product_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("P1", 2)]


def test_stream_dedup(spark, tmp_path):
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1))], "id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = R.dedup_stream(spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in")), ["id"], "ts", "2 hours")
    T.start(stream, "dedup", str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_kafka_projection(spark):
    df = spark.createDataFrame([(b"k", b"v", dt.datetime(2024, 1, 1), None)], "key binary, value binary, timestamp timestamp, headers string")
    assert T.kafka_projection(df).first()[:2] == ("k", "v")


def test_guarded_batch(spark):
    df = spark.createDataFrame([(1,), (None,)], "v int")
    good, dead = R.guarded_batch(df, F.col("v").isNull(), 0.9)
    assert (good.count(), dead.count()) == (1, 1)
    good, dead = R.guarded_batch(df, F.col("v").isNull(), 0.1)
    assert (good.count(), dead.count()) == (0, 2)


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (2, "b", dt.datetime(2024, 1, 2))], "id long, name string, ts timestamp")
    T.write_partitioned(df, str(tmp_path / "p"), "name")
    assert T.read_any(spark, str(tmp_path / "p")).count() == 2
    T.write_report(df, str(tmp_path / "r.csv"))
    assert T.read_any(spark, str(tmp_path / "r.csv")).count() == 2
    T.write_quarantine(df, str(tmp_path / "q"))
    T.append_by_day(df, str(tmp_path / "d"), "ts")
    T.append_by_day(df, str(tmp_path / "d"), "ts")
    assert spark.read.parquet(str(tmp_path / "d")).where("day = '2024-01-01'").count() == 2
    T.write_versioned(df, str(tmp_path / "v"), 1, ["id"])
    T.write_versioned(df.limit(1), str(tmp_path / "v"), 2)
    assert (T.read_version(spark, str(tmp_path / "v"), 1).count(), T.read_version(spark, str(tmp_path / "v"), 2).count()) == (2, 1)
    T.write_star({"a": df, "b": df}, str(tmp_path / "s"))
    first = T.read_first_available(spark, [lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.read.parquet(str(tmp_path / "s" / "a"))])
    assert first.count() == 2


def test_partitioned_json_and_catalog(spark, tmp_path):
    folder = tmp_path / "raw" / "source=s1" / "run_date=2024-01-01"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text('{"id": 1, "brand": "b", "category": "c", "price": 5.0, "rating": 4.0, "ingest_ts": 1}\n{"id": 1, "brand": "b", "category": "c", "price": 7.0, "rating": 4.0, "ingest_ts": 2}\n')
    out = pipelines.run_catalog(spark, str(tmp_path / "raw"), "id long, brand string, category string, price double, rating double, ingest_ts long, source string, run_date string")
    assert [(r.id, r.price, r.source) for r in out["silver"].collect()] == [(1, 7.0, "s1")]


def test_evolution_is_filled_with_nulls(spark, tmp_path):
    spark.createDataFrame([(1,)], "id long").write.parquet(str(tmp_path / "t" / "k=1"))
    spark.createDataFrame([(2, "x")], "id long, extra string").write.parquet(str(tmp_path / "t" / "k=2"))
    assert {(r.id, r.extra) for r in spark.read.option("mergeSchema", True).parquet(str(tmp_path / "t")).collect()} == {(1, None), (2, "x")}


def test_enrichment_of_a_stream_with_its_side_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 1, 2.0, 10.0, t), (2, 9, 1.0, 5.0, t)], "order_id long, product_id long, quantity double, amount double, event_time timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("order_id long, product_id long, quantity double, amount double, event_time timestamp").parquet(str(tmp_path / "in"))
    products = spark.createDataFrame([(1, "lamp", "c", 3.0)], "product_id long, product_name string, category string, avg_cost double")
    known, unknown = R.enrich_stream(stream, products)
    T.start(R.observe_counters(known, "known", "quantity", ("product_name",)), "k", str(tmp_path / "c1"), str(tmp_path / "k")).awaitTermination(60)
    T.start(unknown, "u", str(tmp_path / "c2"), str(tmp_path / "u")).awaitTermination(60)
    assert [(r.order_id, float(r.margin)) for r in spark.read.parquet(str(tmp_path / "k")).collect()] == [(1, 4.0)]
    side = spark.read.parquet(str(tmp_path / "u"))
    assert side.columns == stream.columns and [r.order_id for r in side.collect()] == [2]


def test_observed_counters(spark, tmp_path):
    spark.createDataFrame([(1,), (None,), (5,)], "v int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v int").parquet(str(tmp_path / "in"))
    query = T.start(R.observe_counters(stream, "counters", "v", ("v",)), "o", str(tmp_path / "c"), str(tmp_path / "o"))
    query.awaitTermination(60)
    assert {"rows": 3, "null_v": 1, "min_v": 1, "max_v": 5, "sum_v": 6} in R.progress_counters(query, "counters")


def test_sensor_stream_to_console(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"sensor_id": "s1", "value": "4"}\noops\n')
    query = T.start(R.sensor_stream(spark.readStream.text(str(tmp_path / "in"))), "sensors", str(tmp_path / "c"))
    query.awaitTermination(60)
    assert sum(p.numInputRows for p in query.recentProgress) == 2 and "ConsoleTable" in query.recentProgress[0].sink.description
    got = R.sensor_stream(spark.read.text(str(tmp_path / "in"))).collect()
    assert [(r.sensor_id, r.value) for r in got] == [("s1", "4"), (None, None)]


def test_dead_letter_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"qty": 1}\noops\n')
    parsed = R.parse_events(spark.readStream.text(str(tmp_path / "in")), "qty int", ["qty"])
    R.start_dead_letters(parsed, "dlq", str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(60)
    assert R.inspect_dlq(spark.read.text(str(tmp_path / "out")), 5).collect() == [("malformed", 1, "oops")]


def test_incremental_ingestion_evolves(spark, tmp_path):
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"supplier_id": "s1", "rating": 4.5}\n')

    def ingest(run):
        out = T.ingest_suppliers_stream(spark, str(tmp_path / "json"), "supplier_id string, rating double")
        T.start(out, f"i{run}", str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(60)
        return spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out"))

    assert "region" not in ingest(1).columns
    (tmp_path / "json" / "b.json").write_text('{"supplier_id": "s2", "rating": 3.0, "region": 7}\n')
    assert {(r.supplier_id, r.rating, r.region) for r in ingest(2).collect()} == {("s1", 4.5, None), ("s2", 3.0, "7")}
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("product_id;quantity\np1;3\np2;many;more\n")
    rows = T.ingest_inventory_stream(spark, str(tmp_path / "csv"), "product_id string, quantity int", ";")
    T.start(rows, "inv", str(tmp_path / "c3"), str(tmp_path / "inv")).awaitTermination(60)
    assert {(r.product_id, r.quantity, r._rescued) for r in spark.read.parquet(str(tmp_path / "inv")).collect()} == {("p1", 3, None), ("p2", None, "p2;many;more")}


def test_dated_gzip_staging(spark, tmp_path):
    for name, text, suffix in (("products", "product_id,price\n1,2.5\n", "csv.gz"), ("transactions", '{"sale_id": "a", "quantity": 2}\n', "json.gz")):
        folder = tmp_path / "raw" / name / "2024-01-01"
        folder.mkdir(parents=True)
        with gzip.open(folder / f"{name}_2024-01-01.{suffix}", "wt") as f:
            f.write(text)
    assert [tuple(r) for r in T.load_products(spark, str(tmp_path), "2024-01-01", "product_id int, price double").collect()] == [(1, 2.5)]
    assert [tuple(r) for r in T.load_transactions(spark, str(tmp_path), "2024-01-01", "sale_id string, quantity int").collect()] == [("a", 2)]


def test_relational_source_in_parts(spark):
    url, driver = "jdbc:derby:memory:tabulon;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).select("id", (F.col("id") * 2).alias("v")).write.format("jdbc").options(url=url, dbtable="items", driver=driver).mode("overwrite").save()
    out = T.read_jdbc(spark, url, "items", "id", 0, 100, 4, driver=driver)
    assert out.rdd.getNumPartitions() == 4 and out.agg(F.sum("v")).first()[0] == 9900
    assert T.read_jdbc(spark, url, "items", driver=driver).count() == 100


def test_array_file_and_path_partition(spark, tmp_path):
    (tmp_path / "source=s1").mkdir()
    (tmp_path / "source=s1" / "x.json").write_text('[{"id": 1},\n{"id": 2}]')
    rows = T.read_json(spark, str(tmp_path / "source=s1" / "x.json"), array_file=True)
    assert {(r.id, r.s) for r in rows.select("id", T.path_partition("source", F.input_file_name()).alias("s")).collect()} == {(1, "s1"), (2, "s1")}


def test_clustering_by_several_columns_and_compaction(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 64).cast("string").alias("a"), (F.col("id") / 64).cast("int").alias("b"), F.lit("p").alias("part"))
    z = T.interleaved(spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y")), ["x", "y"], 4)
    assert {(r.x, r.y): r._z for r in z.collect()} == {(x, y): sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(4)) for x in range(16) for y in range(16)}
    T.write_versioned(df, str(tmp_path / "v"), 1, ["a", "b"], ["part"])
    assert T.compact(spark, str(tmp_path / "v"), 1, 2) == 2
    for v in (1, 2):
        assert T.read_version(spark, str(tmp_path / "v"), v).select("a", "b").exceptAll(df.select("a", "b")).count() == 0
    assert len(list((tmp_path / "v" / "v=2").glob("*.parquet"))) == 2


def test_catalogue_is_written(spark, tmp_path):
    folder = tmp_path / "raw" / "source=s1" / "run_date=2024-01-01"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text('{"id": 1, "brand": "b", "category": "c", "price": 5.0, "rating": 4.0, "ingest_ts": 1}\n')
    out = pipelines.run_catalog(spark, str(tmp_path / "raw"), "id long, brand string, category string, price double, rating double, ingest_ts long, source string, run_date string", str(tmp_path / "out"))
    assert out["silver"].count() == 1 and (tmp_path / "out" / "source=s1" / "run_date=2024-01-01").exists() and out["prices"].first()[0] == "< $10"
