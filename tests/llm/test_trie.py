"""The trie of conversations against brute force and SQL, with nulls, ties, turnless and equal conversations and a crowded sketch."""

import hashlib
import random
import zlib

import pytest

from tabulon.llm import registry, trie
from tests.oracle import DATA, connect, same


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of():
    rng = random.Random(4)
    rows = []
    for c in [*range(130), 200, 201, 305, 10**12 + 3]:
        if c % 100 == 50:
            continue
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "what?", "漢字 é"]), 1, "p"))
    rows += [(7, None, None, None, 1, "p"), (7, None, None, "", 1, "p"), (8, 2, "user", "hi", 1, "p"), (None, 1, "user", "no id", 1, "p")]
    rows += [(400, 0, "user", "hi", 1, "p")] + [(c, 0, "user", "hi", 1, "p") for c in range(401, 460)]  # many equal or turnless ones
    rows += [(500, t, "user", "again", 1, "p") for t in range(300)] + [(c, t, "user", "again", 1, "p") for c in (501, 502) for t in range(290)]
    return rows


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, bytes.fromhex(sha(f"{len(role or '')}:{role or ''}{text or ''}")), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c in cs if paths[c] == key))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(cs), len(key), parent, len(cs), sum(len(k) == len(key) + 1 for k in below), len(leaves), saved, sha(ends)))
    return out


@pytest.mark.parametrize("crowded", [False, True])
def test_query_equals_brute_force(spark, monkeypatch, crowded):
    if crowded:  # no counter of the sketch stays at one: all is grouped
        monkeypatch.setattr(trie, "sketch", lambda paths, cells: trie.np.full(trie.ROWS * cells // 8, 255, trie.np.uint8))
    monkeypatch.setattr(trie, "HOT", 4 if crowded else 4096)
    rows = rows_of()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long, prefixes string").repartition(3)
    got = [tuple(r) for r in trie.op12_trie(turns).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_screening_keeps_every_shared_prefix(spark):
    rows = rows_of()
    turns = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")
    found = trie.screened(trie.chained(trie.rebuilt(trie.turns_of(turns)))).collect()
    seen = {}
    for r in found:
        for p in r.prefixes:
            seen[bytes(p)] = seen.get(bytes(p), 0) + 1
    cleared = 0
    for r in found:
        assert all(seen[bytes(p)] == 1 for p in r.prefixes[r.shared + 1 :])
        cleared += len(r.prefixes) - 1 - r.shared
    assert cleared > 100


def test_members_digest_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    ids = [*range(0, 90, 2), 10**15, 10**15 + 1]
    ends = spark.createDataFrame([(b"a" * 16, i) for i in ids] + [(b"", 5)], "prefix binary, conv_id long").repartition(4)
    got = {bytes(r.prefix): r.ends_sha256 for r in trie._digests_of_members(ends).collect()}
    assert got == {b"a" * 16: sha(",".join(map(str, ids))), b"": sha("5")}


def test_empty_table_has_no_nodes(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.op12_trie(turns).count() == 0


def test_query_equals_sql(spark):
    same(registry.QUERIES["op12_trie"](spark, str(DATA)), connect(), trie.OP12_SQL)
