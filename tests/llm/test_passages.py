"""What many lines have in common makes neither pairs of all of them nor loops."""

import random

from pyspark.sql import functions as F

from tabulon.llm import lines
from tests.llm.test_operators import words


def test_a_common_passage_makes_no_pairs_of_all_lines(spark, monkeypatch):
    rng = random.Random(41)
    passage = words(rng, 12)
    texts = [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(240)]
    near = [t.replace(passage, f"{passage} more") for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    met, link = [], lines.linked_components

    def counted(buckets, *more):
        sizes = buckets.distinct().groupBy("bucket").count()
        met.append(sizes.select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0)
        return link(buckets, *more)

    monkeypatch.setattr(lines, "linked_components", counted)
    gone = {r.doc_id for r in lines.op10_lines(docs).collect() if r.n_removed}
    assert gone == set(range(240, 280))
    assert met[0] < 20 * len(texts)  # a bucket of the passage alone has 39,060


def test_a_long_word_of_many_needs_no_loop(spark):
    rng = random.Random(43)
    texts = [f"{words(rng, 40)} {''.join(rng.choice('abcdefgh') for _ in range(19))} {words(rng, 40)}" for _ in range(50)]
    texts += [f"{'ab' * 60} {words(rng, 3)}", words(rng, 12) + " " + "x" * 80]
    found = {r.cid: r for r in lines.with_numbers(spark.createDataFrame(list(enumerate(texts)), "cid long, line string")).collect()}
    assert [k for k in range(50) if found[k].n20 is not None or found[k].sampled is not None] == []
    assert all(found[k].n20 == len({texts[k][i:i + 20] for i in range(len(texts[k]) - 19)}) for k in (50, 51))
