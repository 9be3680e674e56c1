"""Texts of a repeated doc_id, and lines of repeated patterns."""

import hashlib
import random

from tabulon.llm import lines, substrings
from tests.llm.test_operators import words


def shingles(line):
    return {line[i:i + 5] for i in range(max(1, len(line) - 4))}


def test_lines_of_a_repeated_pattern_find_each_other(spark):
    rng = random.Random(12)
    pairs = []
    while len(pairs) < 300:
        pattern = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz -|") for _ in range(rng.randint(4, 12) if len(pairs) % 3 else rng.randint(60, 80)))
        a, b = (((pattern * 130)[rng.randint(0, 3):])[: rng.randint(170, 500)] for _ in range(2))
        b = b if len(pairs) % 3 else b[: len(b) // 2] + "#" + b[len(b) // 2 :]  # some similar, most with equal sets
        x, y = shingles(a), shingles(b)
        if a != b and a.strip() and b.strip() and len(x & y) >= 0.8 * len(x | y):
            pairs.append((a, b))
    pairs += [(f"| {'--- | ' * 4}", f"| {'--- | ' * n}") for n in range(5, 25)] + [("        x += 1", "        x += 1 ")]
    rows = [(2 * k + j, p[j]) for k, p in enumerate(pairs) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in lines.op10_lines(docs).collect() if r.n_removed}
    missed = [k for k in range(len(pairs)) if 2 * k + 1 not in gone]
    assert not missed, [pairs[k] for k in missed[:3]]


def test_lines_of_a_repeated_id(spark):
    a, b, c = "the first of all lines is here", "another line that is not like it", "a third line with its own words"
    docs = spark.createDataFrame([(1, f"{a}\n{b}\n{a}"), (1, f"{c}\n{b}"), (2, a), (2, a), (3, c)], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs).collect())
    texts = [t for i, t in kept if i == 1]
    assert sorted("\n".join(texts).split("\n")) == sorted([a, b, c]) and [t for i, t in kept if i > 1] == ["", "", ""]


def test_substrings_of_a_repeated_id(spark):
    rng = random.Random(31)
    shared, other = words(rng, 60), words(rng, 60)
    rows = [(1, words(rng, 400) + shared), (1, "short"), (1, other + shared), (2, other), (2, None), (3, "x" * 300), (3, "x" * 300)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.op5_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert len(got) == len(rows) and sorted(r[1] for r in got) == sorted(len(t or "") for _, t in rows)
    one = [r for r in got if r[0] == 1]
    assert sum(r[2] for r in one) >= len(shared) and max(r[2] for r in one) >= len(shared)  # in the later one of the two texts
    assert [r[2] for r in got if r[0] == 2 and r[1]] == [len(other)] and (1, 5, 0, hashlib.sha256(b"short").hexdigest()) in got
    assert [r[2] for r in got if r[0] == 3] == [299 - 99 + 99, 299 - 99 + 99]
