"""Periodic runs of words: stretches that repeat one period at least four times.

Words are what ASCII white space separates. A run is a stretch of words with smallest period q (words q apart are equal), as long
as it gets, of at least ``max(LEAST, TIMES * q)`` words.

Enumeration goes over a harmonic grid: a run of period q has at least (TIMES - 1) q neighbouring places that equal the
place q words on, so every (TIMES - 1) q-th place is looked at, n ln n / (TIMES - 1) in all. Where such a place holds, the run's ends are two
longest common extensions, forward and backward, of (i, i + q). An extension compares the few words up to the next pair of
places that are both in a difference cover (six residues modulo 31, of which every difference is one), and from there reads a sparse table of
range minima over the common prefixes of the sorted suffixes that begin in the cover. Only these are sorted, a fifth of
all, and only of documents in which some comparison gets that far.

Documents are independent, so Spark deals them out as they are read and shuffles nothing; a task holds ``BATCH`` words, or one document that is longer.
A null or empty text, or one of white space, has no words and no runs. Each row is answered by its own text, repeated ones too;
rows without doc_id and extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.binding import let
from tabulon.llm.bytesops import documents_of

TIMES, LEAST = 4, 6
MODULUS, COVER = 31, np.array([0, 1, 3, 8, 12, 18])
BATCH = 250_000
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start: long, length: long, period: long>>"


def _steps() -> np.ndarray:
    """By residues of two places: how far it is to the next places that are both in the cover."""
    inside = np.isin(np.arange(2 * MODULUS), COVER) | np.isin(np.arange(2 * MODULUS) - MODULUS, COVER)
    a, b, d = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(inside[a + d] & inside[b + d], axis=2)


STEPS = _steps()
SLOT = np.full(MODULUS, -1)
SLOT[COVER] = np.arange(len(COVER))


def compare(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from places i and j on, ``most`` at the most."""
    same = np.zeros(len(i), np.int64)
    at = np.nonzero(most > 0)[0]
    while len(at):
        at = at[words[i[at] + same[at]] == words[j[at] + same[at]]]
        same[at] += 1
        at = at[same[at] < most[at]]
    return same


class CoverSuffixes:
    """Longest common extensions within an array of words above 0 whose documents end in words of their own."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.concatenate([words, np.zeros(2 * MODULUS, words.dtype)])
        places = np.arange(-(-len(words) // MODULUS))[:, None] * MODULUS + COVER
        self.places = places.ravel()
        self.places = self.places[self.places < len(words)]
        levels = self._levels()
        order = np.argsort(levels[-1])
        self.rank = levels[-1]
        self.minima = [self._common(levels, order[:-1], order[1:])]
        while 2 << len(self.minima) - 1 <= len(self.minima[0]):
            last, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _levels(self) -> list[np.ndarray]:
        """Ranks of the samples by their first 31, 62, 124 ... words, until all differ."""
        bits = int(self.words.max()).bit_length()
        per = max(1, 62 // bits)
        keys = []
        for at in range(0, MODULUS, per):
            key = np.zeros(len(self.places), np.int64)
            for k in range(at, min(at + per, MODULUS)):
                key = key << bits | self.words[self.places + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        levels, apart = [rank], len(COVER)
        while rank.max(initial=-1) < len(rank) - 1:
            behind = np.zeros(len(rank), np.int64)
            behind[:-apart] = rank[apart:] + 1
            rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1]
            levels.append(rank)
            apart *= 2
        return levels

    def _common(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of the suffixes of samples a and b: whole blocks by their ranks, then words."""
        n, first, second = len(self.places), a.copy(), b.copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = np.nonzero((first < n) & (second < n))[0]
            equal = inside[levels[k][first[inside]] == levels[k][second[inside]]]
            first[equal] += len(COVER) << k
            second[equal] += len(COVER) << k
        i, j = (x // len(COVER) * MODULUS + COVER[x % len(COVER)] for x in (first, second))
        last = len(self.words) - 1
        rest = compare(self.words, np.minimum(i, last - MODULUS), np.minimum(j, last - MODULUS), np.full(len(i), MODULUS))
        return i - self.places[a] + rest

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from two different places on, both in the cover."""
        x, y = (self.rank[p // MODULUS * len(COVER) + SLOT[p % MODULUS]] for p in (i, j))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.nonzero(level == k)[0]
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def _extensions(words: np.ndarray, edges: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common words from places i and j on. ``words`` has words of their own at ``edges``: before, between and after the documents."""
    most = STEPS[i % MODULUS, j % MODULUS]
    same = compare(words, i, j, most)
    far = np.nonzero(same == most)[0]
    if len(far):  # suffixes of those documents only, with the places' residues as they were
        x, y = i[far] + most[far], j[far] + most[far]
        which = np.unique(np.searchsorted(edges, x, "left"))
        begin, end = edges[which - 1] + 1, edges[which] + 1
        shift = begin - begin % MODULUS
        room = end - shift
        room += -room % MODULUS
        at = np.concatenate([[0], np.cumsum(room)])
        fill = words.max() + 1 + np.arange(at[-1])  # places outside are unlike any other
        for k in range(len(which)):
            fill[at[k] + begin[k] - shift[k]:at[k] + end[k] - shift[k]] = words[begin[k]:end[k]]
        moved = (at[:-1] - shift)[np.searchsorted(which, np.searchsorted(edges, x, "left"))]
        same[far] += CoverSuffixes(fill).common(x + moved, y + moved)
    return same


def runs_of(documents: list[np.ndarray]) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in this order, of arrays of words (numbers above 0)."""
    sizes = np.array([len(d) for d in documents], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    top = max((int(d.max()) for d in documents if len(d)), default=0)
    words = np.zeros(edges[-1] + 1, np.int64)
    for d, at in zip(documents, edges, strict=False):
        words[at + 1:at + 1 + len(d)] = d
    words[edges] = top + 1 + np.arange(len(edges))
    starts, periods = [], []
    for q in range(1, int(sizes.max(initial=0)) // TIMES + 1):
        step = (TIMES - 1) * q
        later = words[q::step]
        hit = np.nonzero(words[::step][:len(later)] == later)[0] * step
        if len(hit):
            starts.append(hit)
            periods.append(np.full(len(hit), q))
    if not starts:
        return np.empty((0, 4), np.int64)
    i, q = np.concatenate(starts), np.concatenate(periods)
    document = np.searchsorted(edges, i, "left") - 1
    inside = (i + q < edges[document + 1]) & (q * TIMES <= sizes[document])
    i, q, document = i[inside], q[inside], document[inside]
    ahead = _extensions(words, edges, i, i + q)
    last = len(words) - 1
    behind = _extensions(words[::-1], last - edges[::-1], last + 1 - i - q, last + 1 - i)
    long = behind + ahead + q >= np.maximum(LEAST, TIMES * q)
    rows = np.stack([document, i - behind - edges[document] - 1, behind + ahead + q, q], axis=1)[long]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # a stretch found with several periods has the smallest one
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _answers(ids: list[int], texts: list[list[bytes]]) -> pa.RecordBatch:
    number: dict[bytes, int] = defaultdict(lambda: len(number) + 1)
    rows = runs_of([np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts])
    offsets = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    for k in np.unique(rows[:, 0]):
        gone = np.zeros(len(texts[k]), bool)
        for _, start, length, period in rows[offsets[k]:offsets[k + 1]]:
            gone[start + period:start + length] = True
        texts[k] = [w for w, g in zip(texts[k], gone, strict=True) if not g]
    fields = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, pa.array([b" ".join(t) for t in texts], pa.binary())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each text in words, by start and period, and the text's words, joined by spaces,
    without those that some run repeats after its first period."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(b.column(0), b.column(1), strict=True):
                words = (text.as_py() or b"").split()
                if held and held + len(words) > BATCH:
                    yield _answers(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i.as_py())
                texts.append(words)
                held += len(words)
            if ids:
                yield _answers(ids, texts)

    found = documents_of(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, the first one of equals; null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with a part of a tenth of the texts, chosen by crc32 of doc_id, made periodic up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")

        def repeated(a: Column) -> Column:
            p = 1 + F.floor((n - a) / (3 + g % 8))
            return let(p, lambda p: F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " "))

        return F.when(n > 0, let(g % n, repeated)).otherwise(F.lit(""))

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, planted)).otherwise(F.col("text")))


def op11_runs(docs: DataFrame) -> DataFrame:
    """Per document: the number of runs, the one most often repeated, and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_planted_runs(documents_of(docs)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = found.withColumn("best", most_repeated(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Equal words of one document, at most a quarter of it apart, form islands by distance; an island and its distance are a stretch.
OP11_SQL = r"""
WITH crc AS (
  SELECT doc_id, coalesce(text, '') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS h
  FROM documents WHERE doc_id IS NOT NULL
), split AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM crc
), cut AS (
  SELECT *, len(w) AS n, g % nullif(len(w), 0) AS a FROM split
), per AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut
), words AS (
  SELECT doc_id, unnest(range(n)) AS i, n, CASE WHEN h % 10 = 0 THEN unnest(list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])) ELSE unnest(w) END AS word
  FROM per WHERE n > 0
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n
), island AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, k
), run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), best AS (
  SELECT r.* FROM run r WHERE NOT EXISTS (SELECT 1 FROM run o WHERE o.doc_id = r.doc_id
    AND (o.length * r.period > r.length * o.period OR (o.length * r.period = r.length * o.period AND (o.start < r.start OR (o.start = r.start AND o.period < r.period)))))
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM crc d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
