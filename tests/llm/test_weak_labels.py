"""Weak labels against plain Python, row by row; repeated ids; ties and long texts."""

import math
import re

import numpy as np

from tabulon.llm import weak_labels

GOOD = "The river runs past the old mill and the people of the town walk along its banks every day, " * 3 + "as they have always done."
BAD = "click 1234 5678 !!! $$$ ### 99 88 77 ||| ~~~ 00 11 22 %%% 33"


def votes(text):
    """The nine votes of a text, written from their description."""
    vote = lambda good, bad: 0 if bad else 1 if good else -1
    n, words = max(len(text), 1), len(re.findall(r"[^ \t\n\x0b\f\r]+", text))
    kind = [("s" if c in " \t\n\x0b\f\r" else "d" if c.isnumeric() else "l" if c.isalpha() else "x") for c in text]
    spaces, digits, signs, capitals = kind.count("s"), kind.count("d"), kind.count("x"), sum(c.isupper() for c in text)
    letters = n - spaces - digits - signs
    lines = [x for x in text.split("\n") if x.strip(" ")]
    several = max(len(lines), 1)
    repeated, ended = 1 - len(set(lines)) / several, sum(bool(re.search(r"[.!?\"”']\s*$", x)) for x in lines) / several
    mean, upper = (n - words + 1) / max(words, 1), capitals / max(letters, 1)
    return [
        vote(words >= 50, words < 20), vote(3 <= mean <= 10, not 2 <= mean <= 14), vote(letters / n > 0.7, letters / n < 0.6), vote(signs / n < 0.05, signs / n > 0.1),
        vote(digits / n < 0.01, digits / n > 0.1), vote(len(lines) >= 2 and repeated == 0, repeated > 0.2), vote(ended > 0.8, ended < 0.4), vote(upper < 0.08, upper > 0.3),
        vote(False, bool(re.search(r"\b(" + "|".join(weak_labels.BOILERPLATE) + r")\b", text.lower()))),
    ]


def posteriors(rows):
    """Expectation-maximisation document by document, in plain loops."""
    post = [(sum(v == 1 for v in r) + 0.5) / (sum(v >= 0 for v in r) + 1) for r in rows]
    for _ in range(200):
        share = (sum(post) + 1) / (len(rows) + 2)
        right = []
        for j in range(len(rows[0])):
            mine = [(r[j], p) for r, p in zip(rows, post, strict=True) if r[j] >= 0]
            right.append([(sum(w for v, w in ((v, (1 - p, p)[c]) for v, p in mine) if v == c) + 1.5) / (sum((1 - p, p)[c] for _, p in mine) + 2) for c in (0, 1)])
        new = []
        for r in rows:
            odds = math.log(share / (1 - share))
            for (bad, good), v in zip(right, r, strict=True):
                if v >= 0:
                    odds += math.log(good / (1 - bad)) if v else math.log((1 - good) / bad)
            new.append(1 / (1 + math.exp(-odds)))
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9
        post = new
        if done:
            break
    return post


def corpus():
    rng = np.random.default_rng(8)
    texts = [None, "", " \n ", "Ä" * 30_000, "One line.\nOne line.\nOne line.", GOOD * 400]
    for i in range(120):
        words = " ".join(rng.permutation((GOOD if i % 3 else BAD).split()))
        texts.append(words + (".\n" + words[::-1] + "." if i % 4 == 0 else "") + (" cookie" if i % 7 == 0 else ""))
    return texts


def test_votes_and_posteriors_equal_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(corpus())]
    labelled, accuracy = weak_labels.weak_labels(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in labelled.collect()}
    plain = [votes(t or "") for _, t in rows]
    assert {i: list(r.pattern) for i, r in got.items()} == dict(enumerate(plain))
    assert max(abs(got[i].posterior - p) for i, p in enumerate(posteriors(plain))) < 1e-6
    assert len(accuracy) == len(plain[0])


def test_scorer_follows_the_labels(spark):
    rows = [(i, t) for i, t in enumerate(corpus())]
    got = {r.doc_id: r for r in weak_labels.op3_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    drawn = [i for i, _ in rows[6:]]
    assert sum(got[i].kept == (got[i].posterior >= 0.5) for i in drawn) >= 0.95 * len(drawn)


def test_texts_of_one_id(spark):
    """Each row has a result of its own, by its text; equal rows count each; a clashing column changes nothing."""
    rows = [(i, t) for i, t in enumerate(corpus())] + [(900, GOOD), (900, BAD), (900, BAD), (None, GOOD)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, part int, posterior string")
    got = [r for r in weak_labels.op3_quality(df).collect() if r.doc_id == 900]
    assert sorted(r.kept for r in got) == [False, False, True]
    assert len({(r.posterior, r.score) for r in got}) == 2
    one = weak_labels.op3_quality(df.where("doc_id = 900 and text like 'click%'")).collect()
    assert len(one) == 2 and len({r.score for r in one}) == 1
