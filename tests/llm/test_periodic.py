"""Periodic runs against brute force and SQL, with empty, tied, repeated and long input."""

import hashlib
import random
import zlib

import numpy as np

from tabulon.llm import periodic, registry
from tests.oracle import DATA, connect, same


def brute(d):
    found = {}
    for q in range(1, len(d) // 4 + 1):
        i = 0
        while i < len(d) - q:
            start = i
            while i < len(d) - q and d[i] == d[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def documents():
    rng = random.Random(1)
    for k in range(300):
        d = [rng.randint(1, rng.choice([1, 2, 3, 30])) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 100, 400]))]
        if d and k % 3 == 0:
            at = rng.randrange(len(d))
            p = 1 + (len(d) - at) // rng.randint(3, 10)
            d = [d[i] if i < at else d[at + (i - at) % p] for i in range(len(d))]
        yield d
    yield [1] * 3000
    yield ([1, 2, 3] * 50 + [7]) * 9
    a, b = [1], [1, 2]
    while len(b) < 1500:
        a, b = b, b + a
    yield b


def test_runs_equal_brute_force():
    docs = list(documents())
    got = [[] for _ in docs]
    for k, *r in periodic.runs_of([np.array(d, np.int64) for d in docs]).tolist():
        got[k].append(tuple(r))
    assert got == [brute(d) for d in docs]


def test_extensions_of_copies_and_long_repeats():
    rng = random.Random(3)
    part = [rng.randint(1, 50) for _ in range(700)]
    d = np.array([0, *part, 51, *part, 52], np.int64)
    edges = np.array([0, len(d) - 1])
    d[edges] = 60, 61
    i = np.arange(1, 700, 13)
    assert (periodic._extensions(d, edges, i, i + 701) == 701 - i).all()


def test_query_on_hard_rows(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["the", "a", "x"]) for _ in range(rng.randint(0, 60))) for i in range(120)}
    texts |= {200: None, 201: "", 202: " \t\n\x0b ", 203: "one", 204: "é\x85ü " * 40, 205: "a " * 20_000, 206: "\n".join(["all rights reserved"] * 9)}
    rows = [(i, t, 1, "r") for i, t in texts.items()] + [(7, "b " * 30, 1, "r"), (7, texts[7], 1, "r"), (None, "c " * 30, 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, runs string").repartition(3)
    want = []
    for i, t, *_ in rows:
        if i is None:
            continue
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = "".join(f"{s},{m},{q}\n" for s, m, q in runs), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        want.append((i, len(runs), *best, *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))
    got = [tuple(r) for r in periodic.op11_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.op11_runs(docs.where("false")).count() == 0


def test_query_equals_sql(spark):
    same(registry.QUERIES["op11_runs"](spark, str(DATA)), connect(), periodic.OP11_SQL)
