"""Tasks that don't grow with the tables, and forms that make no pairs and repeat no rows."""

import pytest
from pyspark.sql import functions as F

from tabulon import registry, session
from tabulon.operators import joins as J
from tabulon.plans import matching
from tabulon.plans import views as V
from tabulon.streaming import metrics as R
from tests.oracle import DATA, connect, same


@pytest.mark.parametrize("name", ["a47_best_days", "a13_distinct_orders", "w2_latest_snapshot", "a21_bi_measures", "a5_product_reference", "r11_sales_performance"])
def test_more_tasks_for_larger_tables(spark, monkeypatch, name):
    monkeypatch.setattr(session, "TASK_BYTES", 10_000)
    same(registry.QUERIES[name](spark, str(DATA)), connect(), registry.ORACLE_SQL[name])
    assert V.sales(spark, str(DATA)).rdd.getNumPartitions() > 8 and V.inventory(spark, str(DATA)).rdd.getNumPartitions() > 8


def test_windows_of_panes_count_an_order_once(spark):
    rows = [(1, "a", 0, 1), (1, "a", 1, 2), (1, "a", 3, 4), (1, "b", 0, 8), (None, "a", 1, 16), (2, None, 2, 32), (2, None, 2, 64), (3, "a", None, 128)]
    df = spark.createDataFrame(rows, "order_id long, w string, h long, quantity long").withColumn("t", F.timestamp_seconds(F.col("h") * 3600 + 60))
    df = df.withColumns({"amount": F.col("quantity").cast("decimal(18,4)"), "margin": F.col("quantity").cast("decimal(18,2)")})
    found = R.sales_performance(df, "3 hours", "1 hour", ("w",), "t")
    want = {}
    for order, w, h, q in rows:
        for k in range(3) if h is not None else ():
            sums = want.setdefault((w, h - k), [0, set()])
            sums[0] += q
            sums[1] |= {order} - {None}
    assert {(r.w, r.s // 3600): (r.revenue, r.units, r.orders) for r in found.withColumn("s", F.unix_seconds("window_start")).collect()} == {k: (float(s), s, len(o)) for k, (s, o) in want.items()}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_shared_blocks_without_pairs(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"]), (3, ["z", "z"]), (4, [None]), (5, ["w"]), (5, ["w"])], "id long, b array<string>")
    assert sorted(r.id for r in J.in_shared_blocks(df, "id", F.col("b")).collect()) == [1, 2]
    pairs = J.candidate_pairs(spark.range(6).select("id", (F.col("id") % 2).cast("string").alias("k")), "id", F.array("k"), cell_rows=2, one_block=True)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(0, 2), (0, 4), (1, 3), (1, 5), (2, 4), (3, 5)]


def test_rollup_makes_no_summary_for_every_user(spark):
    plan = registry.QUERIES["a12_a13_rollup"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan


def test_deduplicate_broadcasts_no_written_table(spark, monkeypatch):
    seen, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    inner = matching.connected_components
    monkeypatch.setattr(matching, "connected_components", lambda *a: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or inner(*a))
    rows = spark.createDataFrame([(1, "Phone X100", "a"), (2, "phone x100", "A"), (3, "lamp", "b")], "id long, name string, brand string")
    assert sorted(tuple(r) for r in matching.deduplicate(rows, "id").collect()) == [(1, 1), (2, 1), (3, 3)]
    assert seen == ["-1"] and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
