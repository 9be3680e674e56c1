"""Rules of the pipelines on literal cases: folding, capitals, durations, ratios, race results, versions of sales, cluster reports."""

import difflib
import random
import sys
import unicodedata

from pyspark.sql import functions as F

from tabulon.functions import folding
from tabulon.functions import scalars as S
from tabulon.operators import cleaning as P
from tabulon.operators import windows as W
from tabulon.plans import matching, pipelines

#: Letters that got a capital after the Unicode version of Python's tables.
NEWER = {0x19B, 0x264}


def characters(stop):
    return [chr(p) for p in range(0x20, stop) if not 0xD800 <= p < 0xE000 and p not in folding.HANGUL]


def test_folding_equals_the_unicode_tables(spark):
    rows = [(f"x{c}y{c}",) for c in characters(0x3000) + characters(0x20000)[-4096:]] + [("ﬁ ½ " + "ab " * 500 + "ﬃ", ), ("Škoda čaj",), (None,), ("",), ("\x1eﬁ",)]
    got = spark.createDataFrame(rows, "t string").select("t", folding.without_marks(F.col("t")).alias("p")).collect()
    for r in got:
        want = None if r.t is None else "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c))
        assert r.p == (want.replace("\x1e", " ") if r.t and r.t[0] == "\x1e" else want)
    assert len(got) == len(rows) and sys.maxunicode == 0x10FFFF


def test_capitals_equal_title_case(spark):
    rows = [(f"{c}bC {c} 1{c}",) for c in characters(0x600) if ord(c) not in NEWER] + [("élan ŠKODA čaj",), ("o'NEIL d’ORÉ x2y",), (" ab ",)]
    for r in spark.createDataFrame(rows, "t string").select("t", P.normalize_text(F.col("t")).alias("p")).collect():
        assert r.p == r.t.strip(" ").title(), r.t
    names = {"Škoda čaj": "skoda caj", "Große  Éclair™": "gro e eclair tm".replace(" tm", ""), "ﬁ½": "fi1 2"}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in names], "t string").select("t", S.normalize_name(F.col("t")).alias("n")).collect()}
    assert got == names


def test_duration_forms(spark):
    want = {"1:02:03": 3723.0, "05:30": 330.0, "05:30.7": 330.0, "0.5": 43200.0, "0": 0.0, "90": 90.0, "90.0": 90.0, "1.5": None, "-5": None, "nan": None, "a:b": None, "1:2:3:4": None, "": None, " 1:00 ": 60.0}
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", S.to_seconds(F.col("t")).alias("s")).collect()}
    assert got == want


def test_ratio_equals_the_usual_one(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        n, m = rng.choice([(30, 25), (60, 230), (250, 300)]) if k % 12 == 0 else (rng.randint(0, 12), rng.randint(0, 14))
        letters = rng.choice(["ab", "abc", "abcdefgh", "ab "])
        a = "".join(rng.choice(letters) for _ in range(n))
        b = "".join(rng.choice(letters + ("xyz" if n > 50 else "")) for _ in range(m))
        rows.append((a, a[: n // 2] + "Q" + a[n // 2 :] + b if k % 50 == 0 else b))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", S.seq_ratio("a", "b").alias("r")).collect():
        assert r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio(), (r.a, r.b)


RACE = "regatta string, race string, division string, rank string, sail string, boat string, class string, club string, rating string, points string, elapsed string, corrected string"


def test_race_results(spark):
    rows = [
        ("101", "1", "spinnaker", "1", "fr 12", "élan", "j/80", "y.c. oslo", "600", "1", "1:02:03", None), ("101", "1", "Spinnaker", "1", "ger1", "", "", "", "602", "1", None, "59:00"),
        ("101", "1", "Spinnaker", None, "ger2", "b", "", "", "602", "1", "x", None), ("101", "1", "Spinnaker", None, "ger3", "b", "", "", "602", "1", None, None), (None, "2", None, "2", None, "c", "", "", "", "", "", ""),
    ]
    out = pipelines.build_star(spark.createDataFrame(rows, RACE))
    fact = {r.sail: r for r in out["fact_results"].collect()}
    first = fact["Fr 12"]
    assert (first.fact_key, first.boat, first["class"], first.club, first.elapsed_hms, first.elapsed, first.corrected_missing, first.tied) == ("101-1-Fr 12", "Élan", "J/80", "Y.C. Oslo", "1:02:03", 3723.0, True, True)
    assert (fact["Ger1"].corrected_hms, fact["Ger1"].corrected_missing, fact["Ger1"].tied) == ("0:59:00", False, True)
    assert not fact["Ger2"].tied and not fact["Ger3"].tied and fact[None].fact_key is None  # unranked rows are no ties
    raw = spark.createDataFrame([("101", "1", " GER1 ", "1:00:00", "9:99:99"), ("101", "1", "ger2", "0.5", None)], "regatta string, race string, sail string, elapsed string, corrected string")
    filled, completeness = pipelines.backfill_times(out["fact_results"], raw)
    times = {r.sail: (r.elapsed, r.elapsed_hms, r.corrected) for r in filled.collect()}
    assert times["Ger1"] == (3600.0, "1:00:00", 3540.0) and times["Ger2"] == (43200.0, "12:00:00", None) and times["Fr 12"] == (3723.0, "1:02:03", None)
    assert {r.state: (r.elapsed, r.corrected) for r in completeness.collect()} == {"before": (20.0, 20.0), "after": (60.0, 20.0)}


def _spelled(spark):
    rows = [
        ("101", "1", "club", "2.0", "fr 1", " ", "c", "k", "5", "1", "1:00:00", None), ("101", "1.0", "CLUB", "2", "FR 1 ", "beta", "c", "k", "7", "1", "60:00", "bad"),
        ("101", "1", " Club", None, " ", "gone", "c", "k", "9", "1", "", "1:00"), ("100", "1", None, "2", "Fr 1", "alpha", "c", "k", "x", "1", "x", "1:00"), (None, "1", "club", "2", "fr 2", None, "c", "k", None, "1", None, ""),
    ]
    return spark.createDataFrame(rows, RACE)


def test_report_is_one_pass_over_the_results(spark):
    report = pipelines.build_star(_spelled(spark))["report"]
    assert {r["name"]: r.n for r in report.collect()} == {"rows": 5, "missing_elapsed": 3, "missing_corrected": 3, "missing_sail": 1, "tie_groups": 1, "boats": 2, "races": 2, "divisions": 1}
    assert {r["name"]: r.n for r in pipelines.build_star(_spelled(spark).where("false"))["report"].collect()} == dict.fromkeys(("rows", "missing_elapsed", "missing_corrected", "missing_sail", "tie_groups", "boats", "races", "divisions"), 0)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_spellings_of_a_boat_are_grouped_before_they_are_normalised(spark, tmp_path):
    boats = {r.sail: (r.boat, r["class"], r.club, r.rating) for r in pipelines.build_star(_spelled(spark))["dim_boat"].collect()}
    assert boats == {"Fr 1": ("Alpha", "C", "K", 6.0), "Fr 2": (None, "C", "K", None)}
    _spelled(spark).write.parquet(f"{tmp_path}/rows")
    plan = pipelines.build_star(spark.read.parquet(f"{tmp_path}/rows"))["dim_boat"]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "regexp_extract_all" in line]


def test_a_cancelled_sale_stays_cancelled(spark):
    sales = spark.createDataFrame([(1, 1, "w", "2024-01-01", 1, 5.0, 9.0), (1, 1, "w", "2024-01-02", 2, -5.0, 9.0), (2, 1, "w", "2024-01-01", 1, 2.0, 4.0)], "order_id long, product_id long, warehouse string, event_time string, line_no int, quantity double, amount double")
    sales = sales.withColumns({"event_time": F.to_timestamp("event_time"), "amount": F.col("amount").cast("decimal(18,4)")})
    products = spark.createDataFrame([(1, "lamp", "c", 3.0)], "product_id long, product_name string, category string, avg_cost double")
    out = pipelines.build_lakehouse(sales, products, F.lit("de"))
    assert [r.order_id for r in out["silver"].collect()] == [2] and [(r.order_id, r.quantity) for r in out["rejected"].collect()] == [(1, -5.0)] and out["bronze"].count() == 3


def test_group_figures_with_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 3), ("b", 1, 4), (None, None, 0)], "k string, j int, v int")
    assert sorted((r.k or "", r.v, r.tied) for r in W.flag_ties(df, ["k", "j"]).collect()) == [("", 0, False), ("a", 1, True), ("a", 3, True), ("b", 4, False)]
    assert sorted((r.v, r.share) for r in W.share_within(df, ["k", "j"], "v").collect()) == [(0, None), (1, 0.25), (3, 0.75), (4, 1.0)]


def test_cluster_report(spark):
    rows = [(1, "Acme", 3), (2, "Acme", 1), (3, " Zed ", 3), (4, None, 1), (5, "", 2)]
    got = matching.dedup_report(spark.createDataFrame(rows, "component long, brand string, size long"), clusters=2, brands=1).collect()
    assert {tuple(r) for r in got} == {("size", "3", 2), ("size", "1", 2), ("size", "2", 1), ("cluster", "1", 3), ("cluster", "3", 3), ("brand", "Acme", 2)}
