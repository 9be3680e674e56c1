"""Weak labels of quality: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller votes 1 (good), 0 (bad) or abstains (-1). Only the counts of vote patterns (at most 3 ** labellers rows)
reach the driver, where expectation-maximisation estimates the share of good documents and each labeller's accuracy on
either class. The posterior of a document's pattern is its soft label. A logistic regression on hashed words
learns from the soft labels of at most ``max_rows`` different texts (the first by a hash of the id) and scores all.

Null and empty texts get the votes of a text without words; repeated rows count each and the texts of a
repeated id have labels and scores of their own; extra columns are ignored. Without
documents, or with labels of one class only, the score is the posterior.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.bytesops import documents_of
from tabulon.session import cut

MAX_ROWS = 20_000
FEATURES = 1 << 16
BOILERPLATE = ("javascript", "cookie", "cookies", "lorem", "copyright", "subscribe", "login")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def statistics(text: Column) -> dict[str, Column]:
    """Counts of the whole text that the labellers need."""
    return {
        "n_chars": F.greatest(F.length(text), F.lit(1)),
        "n_words": F.regexp_count(text, F.lit(r"\S+")),
        "n_space": F.regexp_count(text, F.lit(r"\s")),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_digits": F.regexp_count(text, F.lit(r"\p{N}")),
        "n_signs": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")),
        "lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0),
        "boilerplate": F.lower(text).rlike(r"\b(" + "|".join(BOILERPLATE) + r")\b"),
    }


def labellers() -> dict[str, Column]:
    """Votes by name, from the columns of ``statistics``."""
    n_chars, n_words, lines = F.col("n_chars"), F.col("n_words"), F.col("lines")
    letters = n_chars - F.col("n_space") - F.col("n_digits") - F.col("n_signs")
    n_lines = F.greatest(F.size(lines), F.lit(1))
    repeated = 1 - F.size(F.array_distinct(lines)) / n_lines
    ended = F.size(F.filter(lines, lambda x: x.rlike(r"[.!?\"”']\s*$"))) / n_lines
    mean_word = (n_chars - n_words + 1) / F.greatest(n_words, F.lit(1))
    capitals = F.col("n_capitals") / F.greatest(letters, F.lit(1))
    return {
        "length": _vote(n_words >= 50, n_words < 20),
        "word_length": _vote(mean_word.between(3, 10), ~mean_word.between(2, 14)),
        "letters": _vote(letters / n_chars > 0.7, letters / n_chars < 0.6),
        "signs": _vote(F.col("n_signs") / n_chars < 0.05, F.col("n_signs") / n_chars > 0.1),
        "digits": _vote(F.col("n_digits") / n_chars < 0.01, F.col("n_digits") / n_chars > 0.1),
        "repeats": _vote((F.size(lines) >= 2) & (repeated == 0), repeated > 0.2),
        "endings": _vote(ended > 0.8, ended < 0.4),
        "capitals": _vote(capitals < 0.08, capitals > 0.3),
        "boilerplate": _vote(F.lit(False), F.col("boilerplate")),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Posteriors of being good by pattern, the share of good ones, and accuracies (labeller, class).

    Starts from the majority of votes; each accuracy has two virtual votes, one and a half of them right, so that a
    labeller with few votes stays above chance.
    """
    good, voted = patterns == 1, patterns >= 0
    post = (good.sum(1) + 0.5) / (voted.sum(1) + 1)
    share, right = 0.5, np.full((patterns.shape[1], 2), 0.75)
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post], 1)
        share = float((w[:, 1].sum() + 1) / (w.sum() + 2))
        hits = np.stack([((~good & voted) * w[:, :1]).sum(0), (good * w[:, 1:]).sum(0)], 1)
        seen = np.stack([(voted * w[:, :1]).sum(0), (voted * w[:, 1:]).sum(0)], 1)
        right = (hits + 1.5) / (seen + 2)
        one = np.where(good, np.log(right[:, 1]), np.log(1 - right[:, 1])) * voted
        zero = np.where(good, np.log(1 - right[:, 0]), np.log(right[:, 0])) * voted
        new = 1 / (1 + np.exp(np.clip(zero.sum(1) - one.sum(1) + np.log((1 - share) / share), -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, share, right


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part) of all rows: ``part`` tells the texts of a repeated id apart."""
    return documents_of(docs).fillna("", "text").withColumn("part", F.xxhash64("text"))


def weak_labels(docs: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(doc_id, part, pattern, posterior), written, ``part`` by the text; and each labeller's accuracy on bad and good documents."""
    votes = labellers()
    counted = _texts(docs).select("doc_id", "part", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    voted = cut(counted.select("doc_id", "part", F.array(*votes.values()).alias("pattern")))
    rows = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3 ** labellers rows at most
    if not rows:
        return voted.withColumn("posterior", F.lit(None).cast("double")), {}
    post, _, right = estimate(np.array([r["pattern"] for r in rows]), np.array([r["n"] for r in rows], float))
    known = docs.sparkSession.createDataFrame([(r["pattern"], float(p)) for r, p in zip(rows, post, strict=True)], "pattern array<int>, posterior double")
    accuracy = {name: (float(a), float(b)) for name, (a, b) in zip(votes, right, strict=True)}
    return voted.join(F.broadcast(known), "pattern"), accuracy


def score_quality(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, posterior, score, kept) of every row."""
    labelled, _ = weak_labels(docs)
    source, row = _texts(docs), ["doc_id", "part"]
    chosen = labelled.dropDuplicates(row).orderBy(F.xxhash64("doc_id"), *row).limit(max_rows)  # bounded, so it may be broadcast
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=FEATURES, binary=True)
    norm = Normalizer(inputCol="tf", outputCol="features")

    def hashed(df: DataFrame) -> DataFrame:
        shape = F.translate(F.lower("text"), "123456789", "000000000")
        words = F.regexp_extract_all(shape, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))
        return norm.transform(tf.transform(df.withColumn("words", words))).drop("words", "tf", "text")

    train = cut(hashed(source.join(F.broadcast(chosen.select(*row, "posterior")), row).dropDuplicates(row)))
    seen = train.agg(F.min("posterior").alias("lo"), F.max("posterior").alias("hi")).first()
    if seen["lo"] is None or not (seen["lo"] < 0.5 <= seen["hi"]):
        return labelled.select("doc_id", "posterior", F.col("posterior").alias("score"), (F.col("posterior") >= 0.5).alias("kept"))
    both = train.select("features", F.lit(1.0).alias("label"), F.col("posterior").alias("weight")).unionByName(train.select("features", F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))
    model = LogisticRegression(maxIter=30, regParam=1e-3, weightCol="weight").fit(both.where("weight > 1e-6"))
    scored = model.transform(hashed(source)).select(*row, vector_to_array("probability")[1].alias("score"))
    posterior = labelled.groupBy(*row).agg(F.max("posterior").alias("posterior"))  # of equal rows
    return scored.join(posterior, row).select("doc_id", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def op3_quality(docs: DataFrame) -> DataFrame:
    """The soft label and the score of every document."""
    return score_quality(docs)
