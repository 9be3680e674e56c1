"""Fingerprints by chains of content words against SQL and brute force, with nulls, ties, repeats and sparse ids."""

import hashlib
import itertools
import random
import re

from tabulon.llm import registry, spotsigs
from tests.oracle import DATA, connect, same

NOT_WORD = re.compile(r"[\W_]+")


def brute_signatures(text, anchors):
    words = [w for w in NOT_WORD.split(text.lower()) if w]
    content = [i for i, w in enumerate(words) if w not in anchors]
    found = set()
    for i, w in enumerate(words):
        chain = [words[k] for k in content if k > i][:2]
        if w in anchors and len(chain) == 2:
            found.add(hashlib.md5(" ".join([w, *chain]).encode()).hexdigest()[:8])
    if not found and text:
        found = {hashlib.md5((" ".join(words) or text).encode()).hexdigest()[:8]}
    return found


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def text_of(rng, n):
    return " ".join(rng.choice(["the", "a", "of", "in", "on"]) if rng.random() < 0.4 else "".join(rng.choice("abcdé") for _ in range(3)) for _ in range(n))


def rows_of():
    rng = random.Random(11)
    texts = {i * i * 977: text_of(rng, rng.randint(1, 80)) for i in range(60)}
    texts |= {-5: None, 1: "", 2: "...", 3: "!!! ???", 4: "the the the", 5: "ÉCOLE the Año", 10**15: text_of(rng, 3000), 10**15 + 7: "x"}
    rows = [(i, t, 1, "k", "s") for i, t in texts.items()]
    return rows + [(4, "the the the", 1, "k", "s"), (4, "again other words of the day", 1, "k", "s"), (None, "no id", 1, "k", "s")]


def test_query_on_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS", 3)  # many buckets
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket long, copy string, signatures string").repartition(3)
    kept = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda r: (-r[0], r[1]))
    seen = {}
    for _, t in kept:
        for w in {w for w in NOT_WORD.split(t.lower()) if w}:
            seen[w] = seen.get(w, 0) + 1
    anchors = set(sorted(seen, key=lambda w: (-seen[w], w))[:5])
    monkeypatch.setattr(spotsigs, "ANCHORS", 5)
    monkeypatch.setattr(spotsigs.common_words, "__defaults__", (5,))
    want = []
    for k, (i, t) in enumerate(kept):
        following = kept[(k + 1) % len(kept)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        s, e, n = (brute_signatures(x, anchors) for x in (t, edited, following))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(s)), "".join(sorted(e)), round(like(s, e), 9), round(like(s, n), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, spotsigs.op13_spotsigs(docs).collect())]
    assert sorted(got) == sorted(want)
    one = spotsigs.op13_spotsigs(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.op13_spotsigs(docs.where("false")).count() == 0


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(2)
    texts = {i: text_of(rng, rng.randint(5, 150)) for i in range(40)}
    for i in range(40, 100):  # near copies, some in chains
        words = texts[rng.choice([0, 1, 2, *range(39, i)])].split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zzz"
        texts[i] = " ".join(words)
    texts |= {100: None, 101: "", 102: texts[3]}
    anchors = ["the", "a", "of", "in", "on"]
    sets = {i: brute_signatures(t or "", set(anchors)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n long")
    got = {r.doc_id: r for r in spotsigs.similar_documents(docs, anchors=anchors).collect()}
    assert set(got) == set(texts) and got[100].class_id is None and got[101].component_id is None
    groups, classes = {}, {}
    for i, r in got.items():
        if sets[i]:
            groups.setdefault(r.component_id, set()).add(i)
            classes.setdefault(r.class_id, set()).add(frozenset(sets[i]))
    want = {}
    for i in texts:
        if sets[i]:
            want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all(len(c) == 1 for c in classes.values())


def test_query_equals_sql(spark):
    same(registry.QUERIES["op13_spotsigs"](spark, str(DATA)), connect(), spotsigs.OP13_SQL)
