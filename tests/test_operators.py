"""Literal cases and properties of operators."""

import datetime as dt
import hashlib
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.functions import scalars as S
from tabulon.operators import aggregates as A
from tabulon.operators import cleaning as P
from tabulon.operators import joins as J
from tabulon.operators import quality as Q
from tabulon.operators import ranks
from tabulon.operators import windows as W
from tabulon.operators.graph import connected_components
from tabulon.plans import matching, pipelines

LINE = '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326 "http://www.example.com/start.html" "Mozilla/4.08 [en] (Win98; I ;Nav)"'


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_parse_clf(spark):
    r = one(spark, LINE, S.parse_clf)
    assert (r.status_code, r.response_size, r.timestamp) == (200, 2326, dt.datetime(2000, 10, 10, 20, 55, 36))


@pytest.mark.parametrize("line", ["", "invalid log line", LINE.replace("10/Oct", "99/Oct"), LINE.replace(" 200 ", " abc "), '1.2.3.4 - - "GET / HTTP/1.0" 200 1', None, LINE + "x" * 9000])
def test_parse_clf_rejects(spark, line):
    assert one(spark, line, S.parse_clf) is None


@pytest.mark.parametrize(("text", "seconds"), [("1:02:03", 3723.0), ("05:30", 330.0), ("0.5", 43200.0), ("77", 77.0), ("x", None), (None, None)])
def test_to_seconds(spark, text, seconds):
    assert one(spark, text, S.to_seconds) == seconds


def test_to_hms(spark):
    assert spark.range(1).select(S.to_hms(F.lit(3723)).alias("a"), S.to_hms(F.lit(330.0)).alias("b")).first()[:] == ("1:02:03", "0:05:30")


def test_text_functions(spark):
    assert one(spark, "Țară  ÉLÈVE-9!", S.normalize_name) == "tara eleve 9"
    assert one(spark, "x-yacht CLUB", P.normalize_text) == "X-Yacht Club"
    assert one(spark, "  ", P.normalize_text) is None
    assert one(spark, "123-45678", S.canonical_gtin) == "00000012345678"
    assert one(spark, "12", S.canonical_gtin) is None
    assert one(spark, "Phone X100b big", S.model_tokens) == ["x100b"]
    assert one(spark, None, S.http_method) == "UNKNOWN"
    assert one(spark, "GET", S.endpoint) == "/"


def test_split_valid_keeps_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "q int")
    ok, bad = P.split_valid(df, F.col("q") > 0)
    assert (ok.count(), bad.count()) == (1, 2)


def test_latest_by_keeps_latest(spark):
    df = spark.createDataFrame([(1, "a", 1000), (1, "a", 2000), (2, "a", 1500), (2, "a", 1000)], "id int, source string, ts int")
    assert {(r.id, r.ts) for r in W.latest_by(df, ["source", "id"], "ts").collect()} == {(1, 2000), (2, 1500)}
    assert W.latest_by(df.where("false"), ["id"], "ts").count() == 0


def test_totals_with_all(spark):
    df = spark.createDataFrame([("P1", "S1", 2)], "p string, s string, q int")
    assert {tuple(r) for r in A.totals_with_all(df, "p", "s", "q").collect()} == {("P1", "S1", 2), ("P1", "ALL", 2)}


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b, c"):
        P.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"])


def test_expect_or_fail(spark):
    df = spark.createDataFrame([(1,), (-1,)], "q int")
    with pytest.raises(Exception, match="expectation positive failed"):
        Q.expect_or_fail(df, "positive", F.col("q") > 0).collect()


def test_merge_adds_revenue_and_keeps_the_rest(spark):
    t = dt.datetime(2024, 1, 1)
    inv = spark.createDataFrame([("w", 1, 10, t, 100.0, "a"), ("w", 2, 3, None, None, "b"), ("w", 3, 5, t, 7.0, "c")], "warehouse string, product_id long, quantity_on_hand int, last_sale timestamp, lifetime_revenue double, note string")
    sold = spark.createDataFrame([("w", 2, 5.0, t, 4), ("w", 3, 1.0, t, 3), ("w", 9, 1.0, t, 3), ("w", 1, 0.0, t, 3)], "warehouse string, product_id long, sold double, last_sale timestamp, revenue long")
    out = J.apply_sales_merge(inv, sold)
    assert out.columns == inv.columns
    assert {tuple(r) for r in out.collect()} == {("w", 1, 10, t, 100.0, "a"), ("w", 2, 0, t, 4.0, "b"), ("w", 3, 4, t, 10.0, "c")}


def test_update_stock_splits(spark):
    t = dt.datetime(2024, 1, 1)
    inv = spark.createDataFrame([("w", 1, t, 10.0, None, None)], "warehouse string, product_id long, inventory_date timestamp, quantity_on_hand double, last_sale timestamp, lifetime_revenue double")
    sales = spark.createDataFrame([("w", 1, 4.0, t, 2.0), ("w", 7, 1.0, t, 2.0)], "warehouse string, product_id long, quantity double, event_time timestamp, amount double")
    out = pipelines.update_stock(inv, sales, 30)
    assert out["inventory"].first().quantity_on_hand == 6.0 and [(r.product_id, r.reason) for r in out["rejected"].collect()] == [(7, "unknown product")]


def test_rules_of_warnings(spark):
    df = spark.createDataFrame([("session_abc", 1), ("session_5", 2), ("session_0", 3), (None, 4), ("session_99999999999999999999999", 5)], "s string, k int")
    out = {r.k: [e.rule_name for e in r.validation_errors] for r in Q.validate(df, Q.click_rules("s")).collect()}
    assert out == {1: [], 2: [], 3: ["session_id_range"], 4: [], 5: ["session_id_range"]}
    assert Q.validate(df, Q.click_rules("s")).where("not is_valid").count() == 0


def test_schema_rules_without_a_column(spark):
    df = spark.createDataFrame([("click", "product_1"), (None, "x")], "event_type string, product_id string")
    found = {r.event_type: {(e.rule_name, e.field) for e in r.validation_errors} for r in Q.validate(df, Q.schema_rules(df.columns)).collect()}
    assert found["click"] == {("required_field", "user_id"), ("required_field", "timestamp")} and found[None] == {("valid_event_type", "event_type")}


def test_dropped_rows_can_be_read(spark):
    kept, seen = Q.expect_or_drop(spark.range(10), "big", F.col("id") > 6)
    assert kept.count() == 3 and seen.get == {"dropped": 7, "total": 10}


def test_gates_fail_with_all_messages(spark):
    gates = spark.createDataFrame([("a", 0, True), ("b", 2, False), ("c", 1, False)], "gate string, n long, passed boolean")
    Q.require_gates(gates.where("passed"))
    with pytest.raises(ValueError, match="b: 2; c: 1"):
        Q.require_gates(gates)


def test_candidate_pairs_are_all_found(spark):
    df = spark.range(200).withColumn("k", F.lit("same"))
    assert J.candidate_pairs(df, "id", F.array("k"), 30).count() == 199 * 100
    assert J.candidate_pairs(df.withColumn("k", F.lit(None).cast("string")), "id", F.array("k")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.text("abcd ", max_size=30), st.text("abcd ", max_size=30))
def test_sequence_ratio(a, b):
    core = S._rare(b)
    assert 2 * S.matched(a, b, core, S.Automaton(core)) == pytest.approx(SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)))


def test_sequence_ratio_of_long_texts():
    rng = random.Random(4)
    for n in (150, 250, 400):
        a, b = ("".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for _ in range(2))
        b = a[: n // 2] + b[n // 2 :]
        assert 2 * S.matched(a, b, S._rare(b), S.Automaton(S._rare(b))) / (2 * n) == pytest.approx(SequenceMatcher(None, a, b).ratio())


def test_pair_scores_by_hand(spark):
    rows = [(1, "Acme Lamp X100b", "Acme", None, None), (2, "acme lamp x100b", None, None, None), (3, "Other", "Z", "12345678", None), (4, "Thing", "Y", None, "1234-5678"), (5, "no model here", None, None, None), (6, "no model there", None, None, None)]
    df = matching.prepared(spark.createDataFrame(rows, "id long, name string, brand string, gtin string, ean string"), "id")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    got = {(r.a, r.b): round(r.score, 6) for r in matching.score_pairs(pairs, df).collect()}
    ratio = SequenceMatcher(None, "no model here", "no model there").ratio()
    assert got == {(1, 2): 0.9, (3, 4): 1.0, (5, 6): round(0.4 * 0.5 + 0.2 * ratio, 6)}


def test_canonical_record(spark):
    rows = [(1, "Phone X", "acme", "12345678", "u1", "5"), (1, "PHONE  X!", "Acme", "1234-5678", "u1", "7"), (1, "Phone Y long name", "acme", None, "u2", "x"), (2, " ", None, None, None, None)]
    out = {r.component: r for r in matching.canonical_records(spark.createDataFrame(rows, "component long, name string, brand string, gtin string, url string, price string")).collect()}
    one, two = out[1], out[2]
    assert (one.name, one.gtin, one.url_list, one.size, one.price_min, one.price_max) == ("PHONE  X!", "1234-5678", ["u1", "u2"], 3, 5.0, 7.0)
    assert one.uid == hashlib.sha1(b"00000012345678").hexdigest()[:16] and two.name is None and two.uid is None


def test_pricing_advice(spark):
    df = spark.createDataFrame([(None, 0.0), (-0.5, 0.0), (-1.5, 0.01), (-1.5, None), (-1.5, 0.2), (-1.0, 0.0)], "e double, u double")
    got = [r[0] for r in df.select(S.recommend(F.col("e"), F.col("u"))).collect()]
    assert got == [S.ADVICE[0], S.ADVICE[1], S.ADVICE[2], S.ADVICE[3], S.ADVICE[3], S.ADVICE[3]]


def test_clf_lines_with_marks(spark):
    good = '1.2.3.4 - u [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 -'
    df = spark.createDataFrame([(good,), ("\x1e" + "\x1f".join("123456789"),), ("a\x1fb",), (good + "\x1f",)], "line string")
    got = [r[0] for r in df.select(S.parse_clf(F.col("line"))).collect()]
    assert got[0].response_size == 0 and got[0].referer is None and got[0].user == "u" and got[1:] == [None, None, None]


def test_global_ranks(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randint(0, 40))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = ranks.quantiles(df.union(spark.createDataFrame([(900, None)], "id long, v double")), "v", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
    values = sorted(v for _, v in rows)
    at = 0.37 * 499
    assert (got.a, got.c) == (values[0], values[-1]) and got.b == pytest.approx(values[int(at)] + (values[int(at) + 1] - values[int(at)]) * (at - int(at)))
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for bins in (7, 600):
        binned = {r.id: r.b for r in ranks.equal_bins(df, F.col("v"), "id", bins, "b").collect()}
        size, more = divmod(500, bins)
        want = [b for b in range(1, bins + 1) for _ in range(size + (b <= more))]
        assert [binned[i] for i, _ in order] == want
    assert ranks.equal_bins(df.where("false"), F.col("v"), "id", 3, "b").count() == 0
    assert ranks.quantiles(df.where("false"), "v", {"a": 0.5}).first().a is None


def test_deduplicate_meets_by_first_tokens_and_in_large_blocks(spark):
    rows = [(1, "acme garden hose reel large", "acme", None), (2, "acme garden hose reel large new", "acme", None), (3, "other thing here", "acme", None)]
    rows += [(10 + i, f"bolt set steel v{i % 3}x", "zed", None) for i in range(3000)] + [(7000, "nobrand item", None, None), (7001, "nobrand item", None, None)]
    df = spark.createDataFrame(rows, "id long, name string, brand string, gtin string")
    got = {r["id"]: r["component"] for r in matching.deduplicate(df, "id", threshold=0.58).collect()}
    assert len(got) == len(rows) and got[1] == got[2] != got[3]
    strict = {r["id"]: r["component"] for r in matching.deduplicate(df, "id").collect()}
    assert strict[1] != strict[2] and len({strict[10 + i] for i in range(0, 3000, 3)}) == 1 and strict[10] != strict[11]
    assert strict[7000] != strict[7001]  # two equal names alone score 0.6


def test_deduplicate_toy_catalogue(spark):
    rows = [(1, "Phone X100 black", "Acme", None, 1.0), (2, "phone x100  BLACK", "ACME", None, 2.0), (3, "Tablet T9", "Acme", None, 3.0), (4, "Other", "Zed", "12345678", 1.0), (5, "Different name", "Zed", "1234-5678", 1.0)]
    out = matching.deduplicate(spark.createDataFrame(rows, "id long, name string, brand string, gtin string, price double"), "id")
    assert {(r.id, r.component) for r in out.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}


def test_star_of_race_results(spark):
    rows = [
        ("101", "1", "spinnaker", "1", "a", "", "600", "1:02:03", "1:00:00"), ("101", "1", "Spinnaker", "1", "A ", "alpha", "602", "05:30", None),
        ("101", "2", "cruising", "2", "b", None, "700", None, None), ("102", "1", "club", "3", None, "x", "n/a", "0.5", "2:00:00"),
    ]
    df = spark.createDataFrame([(*r[:6], "c", "club1", r[6], "1", *r[7:]) for r in rows], "regatta string, race string, division string, rank string, sail string, boat string, class string, club string, rating string, points string, elapsed string, corrected string")
    out = pipelines.build_star(df)
    report = {r["name"]: r.n for r in out["report"].collect()}
    assert report == {"rows": 4, "missing_elapsed": 1, "missing_corrected": 2, "missing_sail": 1, "tie_groups": 1, "boats": 2, "races": 3, "divisions": 3}
    assert {(r.sail, r.boat, r.club, r.rating) for r in out["dim_boat"].collect()} == {("A", "Alpha", "Club1", 601.0), ("B", None, "Club1", 700.0)}
    assert {r.race_key for r in out["dim_race"].collect()} == {"101-1", "101-2", "102-1"}
    assert sorted(r.elapsed or 0 for r in out["fact_results"].collect()) == [0, 330, 3723, 43200]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=14))
def test_connected_components(spark, edges):
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.id, r.component) for r in connected_components(df).collect()} == {(v, root(v)) for v in parent}


def test_connected_components_of_a_path(spark):
    df = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(df).select("component").distinct().collect()[0][0] == 0


def test_canonical_record_figures(spark):
    """Counted medians, addresses beyond the limit, rows without a component, ties of codes; nothing but components at all."""
    prices = ["1", "3", "3", "10", "x", None]
    rows = [(1, f"u{i:03}", None, p, None) for i, p in enumerate(prices * 30)] + [(None, "z", "i", "4", "22345678"), (None, " ", None, "5", "12345678"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "component long, url string, image string, price string, ean string")
    out = {r.component: r for r in matching.canonical_records(df).collect()}
    assert out[1].url_list == [f"u{i:03}" for i in range(matching.MAX_URLS)] and out[1].image_list is None
    assert (out[1].size, out[1].price_min, out[1].price_max, out[1].price_median) == (180, 1.0, 10.0, 3.0)
    assert (out[None].size, out[None].url_list, out[None].image_list, out[None].price_median, out[None].ean) == (2, ["z"], ["i"], 4.5, "12345678")
    assert (out[2].size, out[2].url_list, out[2].price_median, out[2].uid) == (1, None, None, None)
    assert [tuple(r) for r in matching.canonical_records(df.select("component").where("component = 2")).collect()] == [(2, 1, None)]
    assert matching.canonical_records(df.where("false")).count() == 0


def test_bins_of_several_values(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 6), rng.random()) for i in range(203)]
    df = spark.createDataFrame(rows, "id long, a long, b double")
    got = {r.id: (r.x, r.y) for r in ranks.equal_bins_of(df, {"x": F.col("a"), "y": -F.col("b")}, "id", 5).collect()}
    for at, order in ((0, sorted(rows, key=lambda r: (r[1], r[0]))), (1, sorted(rows, key=lambda r: (-r[2], r[0])))):
        sizes = [41, 41, 41, 40, 40]
        assert [got[r[0]][at] for r in order] == [b + 1 for b, n in enumerate(sizes) for _ in range(n)]


def test_latest_day_alone(spark):
    """The bound of the latest time is the same from a table of its own, and empty tables give nothing."""
    day = dt.datetime.fromisoformat
    sales = spark.createDataFrame([(day("2024-01-01T05:00"), 1.0, 2.0), (day("2024-01-03T00:00"), 2.0, 3.0), (day("2024-01-03T23:00"), 4.0, 5.0), (None, 9.0, 9.0)], "event_time timestamp, quantity double, amount double")
    for newest in (None, sales.select(F.max("event_time"))):
        got = sorted(tuple(r) for r in A.sales_trend(sales, 2, newest).collect())
        assert [(str(d), u, v) for d, u, v in got] == [("2024-01-02", 0.0, 0.0), ("2024-01-03", 6.0, 8.0)]
    assert A.sales_trend(sales.where("false"), 2).count() == 0
