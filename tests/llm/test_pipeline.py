"""The pipeline: its contract, and what its stages decide on a small corpus."""

import gc
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import registry, toxicity
from tests.oracle import DATA, connect, same


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    root = str(tmp_path_factory.mktemp("sf"))
    item = words(rng, 30)
    rows = []
    for i in range(300):
        text = "\n".join(words(rng, 20) for _ in range(3))
        if i % 10 == 1:
            text += " vermin " + words(rng, 4)
        if i == 50:
            text = words(rng, 15) + "\n" + item + "\n" + words(rng, 15)
        rows.append((i, text, "en", "s", len(text)))
    base = rows[2][1].split(" ")
    base[3] = "changed"
    rows += [(300, " ".join(base), "en", "s", 1), (301, rows[3][1], "en", "s", 1), (302, None, "en", "s", None), (303, "", "en", "s", 0), (None, words(rng, 9), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
    every = {*range(304), None}
    toxic = {i for i in range(300) if i % 10 == 1}
    assert kept["toxicity"] == every - toxic
    # the copies lose all their lines to the originals and go; blank documents stay
    assert kept["line_dedup"] == kept["toxicity"] - {300, 301}
    assert kept["near_dedup"] == kept["line_dedup"]
    assert kept["decontaminate"] == kept["near_dedup"] - {50}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]


def test_near_dedup_stage_keeps_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, docs, folder)
    assert {r.doc_id for r in docs.select("doc_id").exceptAll(out.select("doc_id")).collect()} == {300, 301}


def test_near_dedup_stage_keeps_one_row_of_each_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, docs.unionByName(docs.where("doc_id is null or doc_id in (5, 300, 302, 303)")), folder)
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and n.pop(None) == 2 and set(n.values()) == {1}
    assert set(n) == {*range(304)} - {300, 301}


def test_run_packs_what_is_left(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.agg(F.count_distinct("doc_id")).first()[0] == 304 - 30 - 2 - 1
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_tables(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clashing = [F.lit(c).alias(c) for c in ("removed_lines", "kept", "n", "doc", "toxicity", "component", "bucket", "gone", "id")]
    wide = docs.select("*", *clashing)
    assert stage(spark, wide.where("false"), folder).count() == 0
    twice = wide.unionByName(wide.where("doc_id in (1, 5) or text is null"))
    out = stage(spark, twice, folder)
    if name == "pack":
        assert out.where("doc_id = 5").count() == 2 and out.where("doc_id = 302").select("length").distinct().collect() == [(1,)]
        return
    assert out.columns == wide.columns
    assert {tuple(r) for r in out.select("removed_lines", "kept", "n", "doc", "toxicity", "component", "bucket", "gone", "id").distinct().collect()} == {("removed_lines", "kept", "n", "doc", "toxicity", "component", "bucket", "gone", "id")}
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n[302] == (1 if name == "near_dedup" else 2) and n[303] == 1 and n[5] == (1 if name == "near_dedup" else 2)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, name):
    same(registry.QUERIES[name](spark, str(DATA)), connect(), registry.ORACLE_SQL[name])


def test_no_model_is_held_after_its_stage(spark, folder, monkeypatch):
    gc.collect()
    before, held = sum(isinstance(o, toxicity.Model) for o in gc.get_objects()), []

    def look(spark, docs, sf_dir):
        held.append(sum(isinstance(o, toxicity.Model) for o in gc.get_objects()))
        return docs

    gc.disable()
    try:
        monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("look", look)])
        corpus_pipeline.run(spark, folder)
    finally:
        gc.enable()
    assert held == [before]
