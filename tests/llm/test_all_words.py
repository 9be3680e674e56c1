"""Toxicity by all words of all examples: brute-force cosines, and copies of every labelled text."""

import random
import zlib

import numpy as np
import pytest

from tabulon.llm import toxicity


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_every_example_of_a_cosine_is_found(monkeypatch, least):
    monkeypatch.setattr(toxicity, "WORD_BLOCK", 8)
    rng = random.Random(23)
    common = [f"c{i}" for i in range(8)]
    rare = [f"r{i}" for i in range(300)]
    voc = common + rare
    idf = np.array([1.1] * 8 + [3.0] * 300)
    rows = []
    for i in range(400):
        at = set(rng.sample(range(8), 5)) | set(rng.sample(range(8, 308), 12))
        if i % 3 == 2:  # near copies of the row before
            at = set(rows[-1][2].tolist()) ^ set(rng.sample(range(8, 308), 2))
        at = np.array(sorted(at), np.int32)
        rows.append((i, i % 2, at, np.array([rng.randint(1, 3) for _ in at], np.int32)))
    rows.append((400, 0, np.empty(0, np.int32), np.empty(0, np.int32)))
    index = toxicity.WordIndex(voc, idf, rows, unseen=4.0, k=500, least=least)
    dense = np.zeros((401, 308))
    for i, _, at, n in rows:
        dense[i, at] = index.unit(at, n)
    opened = []
    for i, _, at, n in rows[:200]:
        text = [voc[a] for a, m in zip(at.tolist(), n.tolist()) for _ in range(m)] + ["unknown"] * (i % 4)
        own, w, _ = index.query(text)
        q = np.zeros(308)
        q[own] = w
        cosines = dense @ q
        clear = {r for r in range(401) if cosines[r] >= least + 1e-4 and r != i}
        got = {r for r, _ in index.neighbours(own, w, i)}
        assert clear <= got and all(cosines[r] >= least - 1e-4 for r in got)
        opened.append(len(index._candidates(own, w)[0]))
    assert least < 0.9 or np.mean(opened) < index.blocks / 4
    assert index.neighbours(*index.query([])[:2]) == [] == index.neighbours(*index.query(["unknown"])[:2])


def test_copies_of_every_labelled_text_are_found(spark):
    """Texts of ordinary words, more than any part of the examples: exact copies, copies with a tenth of their words changed, clean ones."""
    rng = random.Random(29)
    voc = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choices(voc, k=50))) for i in range(3500)]
    toxic = {i for i, _ in rows if i % 10 == 3}
    known = [i for i in sorted(toxic) if zlib.crc32(str(i).encode()) % 5]

    def edited(text):
        parts = text.split(" ")
        for _ in range(5):
            parts[rng.randrange(50)] = rng.choice(voc)
        return " ".join(parts)

    more = [(10_000 + i, rows[i][1]) for i in known] + [(20_000 + i, edited(rows[i][1])) for i in known] + [(30_000 + i, rows[i + 1][1]) for i in known]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.predicted for r in toxicity.op9_toxicity(docs, labels).collect()}
    assert all(got[10_000 + i] == 1 and got[20_000 + i] == 1 and got[30_000 + i] == 0 for i in known)
