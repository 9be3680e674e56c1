"""Near duplicates of documents by MinHash with odd sketches.

A document is its set of distinct shingles (four words, or all of them if fewer). Documents with equal sets are one
class. Classes meet in bands of MinHash samples (128 samples, 32 bands of 4: a pair of similarity 0.8 is missed with
probability 5e-8). Those that meet another one get an odd sketch: 2048 samples folded into a bitmap of 4096 parities. The
bits in which two sketches differ estimate a high similarity precisely, and a pair goes on only if the estimate is at
most ``SLACK`` (4.5 standard errors) below the threshold. What is left is confirmed on the full sets.

No bucket is expanded into its pairs at once. First every class is compared with the leaders of its buckets by sketch and confirmed
with the likeliest one. Buckets that still hold several components are compared in blocks of ``BLOCK`` rows, by sketch
alone, and of each two components the likeliest pair is confirmed; at last all pairs that may link two different components are.

Null texts, empty ones and texts without words have no shingles and link with nothing. Repeated rows of a text form one
class; a repeated doc_id gives one row for each of its rows, each by its own text, and different texts of one doc_id link only if they are alike. Extra columns and rows without doc_id are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.bytesops import documents_of, mix64, small_batches, utf8
from tabulon.operators.graph import connected_components
from tabulon.session import cut

SAMPLES = 128
BANDS = 32
SKETCH_SAMPLES = 2048
SKETCH_BITS = 4096
SLACK = 0.04
BLOCK = 512
STEP = np.uint64(0x9E3779B97F4A7C15)
P = 0x100000001B3
P_INVERSE = pow(P, -1, 1 << 64)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n; doubled when a longer text comes."""
    global _powers
    up, down = _powers
    while len(up) < n + 1:
        k = len(up)
        up = np.concatenate([up, up * np.uint64(pow(P, k, 1 << 64))])
        down = np.concatenate([down, down * np.uint64(pow(P_INVERSE, k, 1 << 64))])
    _powers = up, down
    return up, down


@cache
def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    return lower + np.uint64(1), gap


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; the A-Z of the text count as a-z."""
    raw = np.frombuffer(utf8(text), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    lower, gap = _byte_classes()
    edge = np.diff(np.concatenate([[1], gap[raw].view(np.int8), [1]]))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower[raw] * up[:len(raw)])])
    own = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)
    n = min(words, len(own))
    rows = len(own) - n + 1
    h = np.full(rows, n, np.uint64)
    for k in range(n):
        h = (h ^ own[k:k + rows]) * STEP
        h ^= h >> np.uint64(29)
    return np.unique(mix64(h))


@cache
def _permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, samples, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, samples, np.uint32)


def minhash(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The least value of each of ``samples`` hash functions (unsigned, 32 bits)."""
    times, plus = _permutations(samples)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(samples, 0xFFFFFFFF, np.uint32)
    rows = max(1, (1 << 17) // samples)
    for at in range(0, len(short), rows):
        part = short[at:at + rows, None] ^ plus
        part *= times
        np.minimum(best, part.min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parities of how many samples fall on each of ``bits`` places, as signed 64-bit words."""
    place = mix64(samples.astype(np.uint64) << np.uint64(16) | np.arange(len(samples), dtype=np.uint64)) % np.uint64(bits)
    odd = (np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def band_keys(samples: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A signed 64-bit key for each band, which also tells bands apart."""
    rows = samples.reshape(bands, -1).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * STEP
    for k in range(rows.shape[1]):
        h = mix64((h ^ rows[:, k]) * STEP)
    return h.view(np.int64)


def digests(h: np.ndarray) -> tuple[int, int]:
    """Two sums over a set's hashes: 128 bits that stand for the set."""
    return int(h.sum().view(np.int64)), int(mix64(h ^ STEP).sum().view(np.int64))


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def sketch(docs: DataFrame, words: int = 4) -> DataFrame:
    """One row a document: the size and two digests of its set, and its band keys."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                h = shingle_hashes(text, words)
                if not len(h):
                    rows.append((0, 0, 0, []))
                    continue
                rows.append((len(h), *digests(h), band_keys(minhash(h))))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "bands"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SKETCH)


def full_sets(docs: DataFrame, words: int = 4) -> DataFrame:
    """(set_a, set_b, n, hashes, odd): the whole set of each document with its two digests, and its odd sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_hashes(t, words) for t in b["text"]]
            odd = [odd_sketch(minhash(h, SKETCH_SAMPLES)).tobytes() for h in sets]
            one, two = zip(*[digests(h) for h in sets], strict=True) if sets else ((), ())
            yield pd.DataFrame({"set_a": one, "set_b": two, "n": [len(h) for h in sets], "hashes": [h.view(np.int64) for h in sets], "odd": odd})

    return docs.mapInPandas(run, "set_a long, set_b long, n long, hashes array<long>, odd binary")


def most_apart(percent: int) -> float:
    """The count of differing bits at which the estimate 1 + bits / (4 samples) ln(1 - 2 apart / bits) is SLACK below the threshold."""
    return SKETCH_BITS / 2 * (1 - np.exp(-4 * SKETCH_SAMPLES / SKETCH_BITS * (1 - percent / 100 + SLACK)))


def _words(odd: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(odd), "<u8").reshape(len(odd), -1)


def _likeliest(pairs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (id, leader) with both sketches, the one of each id with the fewest differing bits that may be a link."""
    limit = most_apart(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                apart = np.bitwise_count(_words(b["odd"]) ^ _words(b["leader_odd"])).sum(axis=1).astype(np.int64)
                yield pd.DataFrame({"id": b["id"], "leader": b["leader"], "apart": apart})[apart <= limit]

    found = pairs.mapInPandas(run, "id long, leader long, apart long")
    return found.groupBy("id").agg(F.min(F.struct("apart", "leader")).alias("m")).select(F.least("id", "m.leader").alias("a"), F.greatest("id", "m.leader").alias("b")).distinct()


def _across(mixed: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs (a, b) of one bucket and two components whose sketches allow a link, each from its first common bucket.

    ``mixed`` has (bucket, id, component, n, odd, own); own lists all mixed buckets of the id. With ``best_only``, the
    likeliest pair of each two components and block.
    """
    sizes = mixed.groupBy("bucket").agg(((F.count("*") + BLOCK - 1) / BLOCK).cast("int").alias("blocks"))
    dealt = mixed.join(sizes, "bucket").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("*", other.alias("other")).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n", "odd", "own")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    limit = most_apart(percent)

    def pairs_of(g: pd.DataFrame) -> pd.DataFrame | None:
        i, j = g["i"].iat[0], g["j"].iat[0]
        left = g[g["block"] == i]
        right = g[g["block"] == j]
        if not len(left) or not len(right):
            return None
        ids, comps, n, bits = right["id"].to_numpy(), right["component"].to_numpy(), right["n"].to_numpy(), _words(right["odd"])
        found = []
        for x, c, k, row, own in zip(left["id"], left["component"], left["n"], _words(left["odd"]), left["own"], strict=True):
            ok = (comps != c) & (np.minimum(n, k) * 100 >= np.maximum(n, k) * percent)
            if i == j:
                ok &= ids > x
            at = np.nonzero(ok)[0]
            apart = np.bitwise_count(bits[at] ^ row).sum(axis=1)
            at, apart = at[apart <= limit], apart[apart <= limit]
            mine = set(own)
            for k2, d in zip(at.tolist(), apart.tolist(), strict=True):
                if min(mine.intersection(right["own"].iat[k2])) == g["bucket"].iat[0]:
                    found.append((min(x, ids[k2]), max(x, ids[k2]), min(c, comps[k2]), max(c, comps[k2]), d))
        if not found:
            return None
        out = pd.DataFrame(found, columns=["a", "b", "ca", "cb", "apart"])
        return out.sort_values(["apart", "a", "b"]).drop_duplicates(["ca", "cb"]) if best_only else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            groups = [g for _, g in b.groupby(["bucket", "i", "j"], sort=False)]
            held = groups.pop() if groups else None  # the last group may go on in the next batch
            yield from (out[["a", "b"]] for g in groups if len(g) > 1 and (out := pairs_of(g)) is not None)
        if held is not None and len(held) > 1 and (out := pairs_of(held)) is not None:
            yield out[["a", "b"]]

    return dealt.mapInPandas(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(common * 100 >= (F.size("ha") + F.size("hb") - common) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) under ``100 * intersection >= percent * union``."""
    source = documents_of(docs)
    sketches = cut(sketch(source, words))
    some = sketches.where("n_shingles > 0")
    classes = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("first_doc"), F.min("bands").alias("bands"))
    classes = cut(classes.withColumn("class_id", F.monotonically_increasing_id()))  # a doc_id may have several texts, so it can't name a class
    buckets = classes.select(F.col("class_id").alias("id"), F.explode("bands").alias("bucket"))
    first = F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id"))
    leaders = buckets.groupBy("bucket").agg(F.count("*").alias("n"), first.alias("m")).where("n > 1")
    shared = cut(buckets.join(leaders.select("bucket", F.col("m.id").alias("leader")), "bucket"))
    wanted = classes.join(shared.select(F.col("id").alias("class_id")).distinct(), "class_id", "left_semi")
    texts = source.join(wanted.select(F.col("first_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    named = wanted.select("set_a", "set_b", F.col("n_shingles").alias("n"), F.col("class_id").alias("id"))
    sets = cut(full_sets(texts, words).join(named, ["set_a", "set_b", "n"]).dropDuplicates(["id"]).select("id", "n", "hashes", "odd"))
    odd = sets.select("id", "odd")

    star = shared.where("id <> leader").select("id", "leader").distinct()
    star = star.join(odd, "id").join(odd.select(F.col("id").alias("leader"), F.col("odd").alias("leader_odd")), "leader")
    links = cut(_confirmed(_likeliest(star, percent), sets, percent))
    components = connected_components(links, "a", "b")
    tried = None
    for best_only in (True, False):
        parts = shared.select("bucket", "id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = parts.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        mixed = parts.join(several, "bucket")
        own = mixed.groupBy("id").agg(F.collect_list("bucket").alias("own"))  # at most BANDS values
        mixed = mixed.join(own, "id").join(sets.select("id", "n", "odd"), "id")
        pairs = _across(mixed, percent, best_only)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs
        new = cut(_confirmed(pairs, sets, percent))
        if not new.isEmpty():
            links = links.unionByName(new)
            components = connected_components(links, "a", "b")

    rooted = classes.select("set_a", "set_b", "n_shingles", "class_id", "first_doc").join(components.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    rooted = rooted.select("set_a", "set_b", "n_shingles", "first_doc", F.coalesce("component", "class_id").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    known = rooted.join(smallest, "root").select("set_a", "set_b", "n_shingles", "component_id")
    linked = some.select("doc_id", "n_shingles", "set_a", "set_b").join(known, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_neardup(docs: DataFrame) -> DataFrame:
    """Four-word shingles, similarity of 0.8 or more."""
    return near_duplicates(docs, 4, 80)
