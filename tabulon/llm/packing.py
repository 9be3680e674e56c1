"""Best-fit packing of token sequences by the configuration linear program.

Only the histogram of piece lengths (at most ``CAPACITY`` entries) reaches the driver. There, the program "cover every
length's count by configurations of one sequence each, with as few as can be" is solved by multiplicative weights: a
length weighs less the more it is covered, a knapsack dynamic program over the weights prices new configurations, one
for each length that must be in it. The fractional solution is rounded down, what is left is covered by configurations priced
the same way on the rest, each as often as the rest allows, and slack is filled by the largest length that fits.
The plan (configurations and how often each is used) doesn't grow with the rows; pieces find their places by rank
within their length.

Ids are the tokenizer's own: the literal of a special token in a text is that token.
Null and empty texts are one piece of length 1. Repeated rows are pieces of their own, kept apart by a row number where
id and piece tie. Extra columns and rows without doc_id are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.bytesops import crc32, documents_of, small_batches
from tabulon.session import cut

CAPACITY = 4096
ROUNDS = 12
EPSILON = 0.5
CACHED_WORDS = 600_000
BUCKET_ROWS = 1000
SIMPLE = 0x250


@cache
def _simple_text() -> re.Pattern:
    """Only characters that every Unicode version lower-cases and classes alike, to characters of the same range.

    U+001C to U+001F are left out: Python counts them as white space, the tokenizer's pattern doesn't.
    """
    simple = "".join(re.escape(c) for c in map(chr, range(SIMPLE)) if not "\x1c" <= c <= "\x1f" and max(c.lower()) < chr(SIMPLE))
    return re.compile(f"[{simple}‘-”–—]*")


@cache
def _word_patterns() -> tuple[re.Pattern, re.Pattern]:
    """The tokenizer's own splitting pattern, for texts of simple characters, and what is left of it in texts without apostrophes."""
    classes = {"L": "", "N": ""}
    for c in map(chr, range(SIMPLE)):
        kind = unicodedata.category(c)[0]
        if kind in classes:
            classes[kind] += re.escape(c)
    letters, digits = classes["L"], classes["N"]
    plain = f"[{letters}]+|[{digits}]|[^\\s\\x85\\xa0{letters}{digits}]+"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{plain}"), re.compile(plain)


class WordTokenizer:
    """Token ids as little-endian unsigned 32-bit bytes; ids of single words are kept, up to a bound."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts with an added token's literal, in any case, aren't cut into words here; with none, nothing matches
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE)
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        words: dict[int, list[str]] = {}
        missing: set[str] = set()
        rest = []
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        for i, text in enumerate(texts):
            if _simple_text().fullmatch(text) and not self.added.search(text):
                if not text.isascii():
                    text = unicodedata.normalize("NFC", text)
                words[i] = _word_patterns()["'" not in text].findall(text.lower())
                missing.update(words[i])
            else:
                rest.append(i)
        new = [w for w in missing if w not in self.known]
        for at in range(0, len(new), 10_000):
            self.known.update(zip(new[at:at + 10_000], self._encode(new[at:at + 10_000]), strict=True))
        look = self.known.__getitem__
        for i, own in words.items():
            out[i] = b"".join(map(look, own))
        for i, ids in zip(rest, self._encode([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut where longer than ``capacity``."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _tokenizer(tokenizer)
        for b in batches:
            rows, group, size = [], [], 0
            keys, texts = b["doc_id"].tolist(), [t or "" for t in b["text"]]
            for i, text in enumerate(texts):
                group.append(i)
                size += len(text)
                if size < 1_000_000 and i + 1 < len(texts):
                    continue
                for k, ids in zip(group, own.encode([texts[j] for j in group]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((keys[k], piece, at // 4, len(part) // 4, crc32(part)))
                group, size = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents_of(docs).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the linear program, on the histogram alone ----


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity (items may repeat), and the last item taken there (-1: none). ``lengths`` ascend."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]) if len(lengths) else capacity + 1, capacity + 1):
        n = fits[c]
        gains = best[c - lengths[:n]] + values[:n]
        k = int(gains.argmax())
        best[c], last[c] = (gains[k], k) if gains[k] > best[c - 1] else (best[c - 1], -1)
        if last[c] < 0:
            last[c] = last[c - 1]
    return best, last


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For each length, the configuration of most value that holds it; items by index, descending."""
    _, last = knapsack(lengths, values, capacity)
    found = {}
    for j, length in enumerate(lengths.tolist()):
        items, room = [j], capacity - length
        while room > 0 and (k := int(last[room])) >= 0:
            items.append(k)
            room -= int(lengths[k])
        found.setdefault(tuple(sorted(items, reverse=True)))
    return list(found)


def _counts(config: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.asarray(config), return_counts=True)


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """A fractional cover of ``demand``: how often each configuration is used."""
    use: dict[tuple[int, ...], float] = {}
    covered = np.zeros(len(lengths))
    weight = lengths / capacity
    for _ in range(rounds):
        configs = price(lengths, weight, capacity)
        asked = np.zeros(len(lengths))
        for config in configs:
            k, a = _counts(config)
            asked[k] += a
        share = demand / rounds / np.maximum(asked, 1e-12)  # what a round may cover, over those that ask for it
        for config in configs:
            k, a = _counts(config)
            x = float(share[k].min())
            use[config] = use.get(config, 0.0) + x
            covered[k] += a * x
        weight = lengths / capacity * np.exp(-EPSILON * (covered / demand - (covered / demand).min()))
    return use


def _best_fit(lengths: np.ndarray, left: np.ndarray, room: int) -> list[int]:
    """Items for ``room``, each the largest that is left and fits."""
    items: list[int] = []
    taken: dict[int, int] = {}
    while room > 0:
        k = int(np.searchsorted(lengths, room, "right")) - 1
        while k >= 0 and left[k] - taken.get(k, 0) <= 0:
            below = np.nonzero(left[:k] > 0)[0]
            k = int(below[-1]) if len(below) else -1
            while k >= 0 and left[k] - taken.get(k, 0) <= 0:
                k -= 1
        if k < 0:
            break
        items.append(k)
        taken[k] = taken.get(k, 0) + 1
        room -= int(lengths[k])
    return items


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), covering each length's count exactly."""
    known = sorted((length, n) for length, n in histogram.items() if n > 0)
    if not known:
        return []
    lengths, left = (np.array(x, np.int64) for x in zip(*known, strict=True))
    out: list[tuple[tuple[int, ...], int]] = []

    def take(config: tuple[int, ...], times: int) -> None:
        k, a = _counts(config)
        times = min(times, int((left[k] // a).min()))
        while times > 0:
            room = capacity - int(lengths[list(config)].sum())
            left[k] -= a * times
            more = _best_fit(lengths, left, room)
            mk, ma = _counts(tuple(more)) if more else (np.empty(0, np.int64), np.empty(0, np.int64))
            filled = min(times, int((left[mk] // ma).min())) if more else times
            left[mk] -= ma * filled
            left[k] += a * (times - filled)
            out.append((tuple(lengths[list(config) + more].tolist()), filled))
            times -= filled

    use = solve(lengths, left.astype(float), capacity, rounds)
    for config, x in sorted(use.items(), key=lambda item: (-item[1], item[0])):
        take(config, int(x))
    while left.any():
        some = np.nonzero(left)[0]
        rest = lengths[some]
        # the rest: long pieces first, each with the best company that the weights know
        configs = price(rest, rest / capacity * (1 + 1e-3 * rest / capacity), capacity)
        full = sorted(configs, key=lambda c: (capacity - int(rest[list(c)].sum()), -int(rest[c[0]]), c))
        before = int(left.sum())
        for config in full:
            if int(rest[list(config)].sum()) == capacity or left.sum() == before and config is full[0]:
                take(tuple(some[list(config)].tolist()), 1 << 62)
        if int(left.sum()) == before or len(some) <= 64 or before - int(left.sum()) < 0.02 * before:
            break
    while left.any():  # what no full configuration can hold any more: decreasing best fit
        k = int(np.nonzero(left)[0][-1])
        take((k,), int(left[k]))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys ``length << 40 | first rank``, and the sequence and offset of that rank; later ranks follow."""
    rank: dict[int, int] = {}
    rows = []
    sequence = 0
    for items, times in patterns:
        offset = 0
        for length in items:
            rows.append((length << 40 | rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        sequence += times
    rows.sort()
    keys, sequences, offsets = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3
    return keys, sequences, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    ``pieces`` is read several times: pass a written table. The histogram has at most ``capacity`` rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = plan(histogram, capacity, rounds)
    keys, sequences, offsets = _places(patterns, capacity)
    places = spark.sparkContext.broadcast((keys, sequences, offsets))
    # ranks within a length, dealt over buckets of about BUCKET_ROWS rows: no length is one task's work
    salted = spark.createDataFrame(sorted((k, 1 + n // BUCKET_ROWS) for k, n in histogram.items()), "length long, buckets long")
    dealt = pieces.join(F.broadcast(salted), "length").withColumn("bucket", F.expr("pmod(xxhash64(doc_id, piece), buckets)"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, seqs, offs = places.value
        key = length.to_numpy(np.int64) << 40 | rank.to_numpy(np.int64)
        at = np.searchsorted(starts, key, "right") - 1
        return pd.DataFrame({"sequence_id": seqs[at] + key - starts[at], "offset": offs[at]})

    placed = ranked.withColumn("place", place("length", F.col("rank") + F.col("before")))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset")


def op7_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """All documents' pieces in as few sequences of at most 4096 tokens as the program finds."""
    return pack(cut(tokenize_pieces(docs, tokenizer)))
