"""Reading texts for the toxicity model, many at once: the same words and terms as text by text, each word read by the automaton once."""

import random
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np

from tabulon.llm import toxicity


def _texts(rng):
    letters = "abcdeäßİΣσςé𝒜中ª²Ⅷ_"
    voc = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return [None, "", "  ", "12 34"] + [rng.choice([" ", ", ", "\n", "4", " "]).join(rng.choice(voc) for _ in range(rng.randint(1, 40))) for _ in range(200)]


def test_words_and_terms_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(toxicity, "READ_CHARS", 700)
    rng = random.Random(41)
    texts = _texts(rng)
    words = [toxicity.words_of(t) for t in texts]
    distinct = sorted(set().union(*words))
    terms = sorted({t for w in distinct[::3] for t in toxicity.terms_of(w)})
    keys = np.sort(toxicity.word_keys(distinct[::2]))
    vectors = toxicity.Vectors(terms)
    got = []
    for c in toxicity.Reader(terms, keys).read(texts):
        for (a, b), (i, j) in zip(pairwise(c.ranges(c.word_text)), pairwise(c.ranges(c.term_text)), strict=True):
            spelt = c.spelt(c.word[a:b])
            known = {w for w, p in zip(spelt, c.place[c.word[a:b]].tolist(), strict=True) if p >= 0}
            got.append((dict(zip(spelt, c.times[a:b].tolist(), strict=True)), dict(zip(c.term[i:j].tolist(), c.term_times[i:j].tolist(), strict=True)), known))
    assert got == [(dict(Counter(w)), vectors.counts(w), set(w) & set(distinct[::2])) for w in words]


def test_a_word_is_read_by_the_automaton_once(monkeypatch):
    monkeypatch.setattr(toxicity, "READ_CHARS", 700)
    texts = _texts(random.Random(42))
    met = []
    found = toxicity.Vectors.found
    monkeypatch.setattr(toxicity.Vectors, "found", lambda self, words: met.extend(words) or found(self, words))
    list(toxicity.Reader(["^a", "bc"], np.empty(0, np.uint64)).read(texts * 3))
    assert sorted(met) == sorted(set().union(*map(toxicity.words_of, texts)))


def test_driver_holds_no_postings(spark):
    rng = random.Random(43)
    rows = [(i, " ".join(f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(30))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert set(model.shared) == {"model", *toxicity.POSTINGS}  # each array was sent on its own
    assert not len(model.words.weights) and not len(model.words.keys)
    whole = toxicity._restore(model.shared).words
    assert len(whole.weights) == sum(len(set(t.split())) for i, t in rows if zlib.crc32(str(i).encode()) % 5)


def test_restored_index_is_the_one_made(spark, monkeypatch):
    """Ranges and bounds of blocks that a worker gets are those of an index made in one place."""
    monkeypatch.setattr(toxicity, "COMMON", 1)
    rng = random.Random(44)
    rows = [(i, " ".join(f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(30))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    sent = toxicity._restore(model.shared).words
    assert sent.starts.dtype == sent.postings.dtype == np.int32 and model.shared["cols"].value is sent.starts  # no second copy in a worker
    examples = [(i, 0, *np.unique(np.searchsorted(sent.keys, toxicity.word_keys(t.split())), return_counts=True)) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    whole = toxicity.WordIndex(sent.keys, sent.idf, examples)
    for name in ("starts", "postings", "block_of", "inside", "row"):
        assert np.array_equal(getattr(sent, name), getattr(whole, name)), name
    assert np.allclose(sent.weights, whole.weights) and np.allclose(sent.maxima, whole.maxima)
