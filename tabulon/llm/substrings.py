"""Removal of every byte that a 100-byte string covers which also starts earlier, matched over all documents.

The suffixes are sampled by their content: of each 100-byte window, the byte string of ``GRAM`` bytes with the least hash
is its anchor (the leftmost one if several tie). Like the positions of a difference cover, anchors meet in any two equal
windows at equal offsets, but only one position in about forty is one. The consecutive windows of one anchor make a
context. Sampled suffixes are named by fingerprints and sorted into groups of equal anchors: an anchor that occurs once
can't be in a repeat. Occurrences of one context repeat each other window by window, so the first one stands for
all. The remaining suffixes are merged in only where an anchor has several contexts: each window there is named by
its own fingerprint, and the first of each name (smallest doc_id, then start) is told from the later ones. Fingerprints
are 64-bit ones within groups of equal 64-bit anchors.

A null text is empty. Texts of a repeated doc_id are documents of their own, in the order of a hash (of 31 bits); rows repeated whole give one row each, with the same result, as their strings
start at the same place. Extra columns and rows without doc_id are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.bytesops import documents_of, mix64, small_batches, utf8, with_part
from tabulon.llm.neardup import _power_tables
from tabulon.session import cut

LENGTH = 100
GRAM = 28
PART = 24


def _prefix(raw: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=out[1:])
    return out


def _names(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte strings from ``starts`` to ``ends``."""
    _, down = _power_tables(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def contexts(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, context, lo, hi, at): the windows that start at lo to hi have this anchor, which is at ``at``; both are fingerprints."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    prefix = _prefix(raw)
    _, down = _power_tables(len(raw))
    h = mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[:len(raw) - GRAM + 1])
    least, at = h, np.arange(len(h), dtype=np.int32)
    width, reach = LENGTH - GRAM + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        at = np.where(later, at[step:], at[:-step])
        reach += step
    edge = np.nonzero(np.diff(at))[0]
    lo = np.concatenate([[0], edge + 1])
    hi = np.concatenate([edge, [len(at) - 1]])
    own = _names(prefix, lo, hi + LENGTH)
    return least[lo].view(np.int64), own.view(np.int64), lo, hi, at[lo]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(utf8(text), np.uint8)


def _part(place: str) -> Column:
    return F.shiftright(place, 32).alias("part")


def _place(place: str) -> Column:
    return F.col(place).bitwiseAND(0xFFFFFFFF).cast("int").alias(place)


def find_contexts(docs: DataFrame) -> DataFrame:
    """(anchor, context, doc_id, lo, hi, at) of every document (doc_id, part, text); the part is in the upper half of each place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, parts = [], []
            for i, part, text in zip(b["doc_id"], b["part"], b["text"], strict=True):
                anchor, context, *places = contexts(_bytes(text))
                ids.append(np.full(len(anchor), i, np.int64))
                parts.append((anchor, context, *(p.astype(np.int64) + (part << 32) for p in places)))
            if ids:
                columns = [np.concatenate([p[k] for p in parts]) for k in range(5)]
                yield pd.DataFrame({"anchor": columns[0], "context": columns[1], "doc_id": np.concatenate(ids), "lo": columns[2], "hi": columns[3], "at": columns[4]})

    return docs.mapInPandas(run, "anchor long, context long, doc_id long, lo long, hi long, at long")


def _first_windows(docs: DataFrame, several: DataFrame) -> DataFrame:
    """(doc_id, start) of the first window of each name among the windows of ``several`` contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, part, text, places in zip(b["doc_id"], b["part"], b["text"], b["places"], strict=True):
                lo = np.array([p["lo"] for p in places], np.int64)
                hi = np.array([p["hi"] for p in places], np.int64)
                at = np.array([p["at"] for p in places], np.int64)
                anchor = np.array([p["anchor"] for p in places], np.int64)
                n = hi - lo + 1
                starts = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                name = _names(_prefix(_bytes(text)), starts, starts + LENGTH).view(np.int64)
                out.append(pd.DataFrame({"anchor": np.repeat(anchor, n), "offset": (np.repeat(at, n) - starts) // PART, "name": name, "doc_id": i, "start": starts + (part << 32)}))
            if out:
                yield pd.concat(out)

    places = several.groupBy("doc_id", _part("lo")).agg(F.collect_list(F.struct("anchor", *[_place(c) for c in ("lo", "hi", "at")])).alias("places"))
    windows = docs.join(places, ["doc_id", "part"]).select("doc_id", "part", "text", "places").mapInPandas(run, "anchor long, offset int, name long, doc_id long, start long")
    # equal windows have their anchor at equal offsets; dealt by it, windows of one context stay together, which compresses
    return windows.repartition("anchor", "offset").groupBy("anchor", "offset", "name").agg(F.min(F.struct("doc_id", "start")).alias("f")).select("f.doc_id", "f.start")


def removed_spans(raw: np.ndarray, repeats: list[tuple[int, int]], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs, given the repeated windows and those of them that are first ones."""
    n = len(raw) - LENGTH + 1
    change = np.zeros(n + 1, np.int64)
    for lo, hi in repeats:
        change[lo] += 1
        change[hi + 1] -= 1
    marked = np.cumsum(change[:-1]) > 0
    marked[firsts] = False
    at = np.nonzero(marked)[0]
    if not len(at):
        return at, at
    gap = np.nonzero(np.diff(at) > LENGTH)[0]
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + LENGTH


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs``; spans are byte positions."""
    small_batches(docs.sparkSession)
    source = with_part(documents_of(docs).fillna("", "text")).withColumn("part", F.shiftrightunsigned("part", 33))
    found = find_contexts(source)
    repeated = cut(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    places = cut(found.join(repeated, "anchor"))
    kinds = cut(places.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "lo", "hi", "at")).alias("f")))
    many = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    several = cut(kinds.join(many, "anchor").select("anchor", "f.doc_id", "f.lo", "f.hi", "f.at"))
    firsts = cut(_first_windows(source, several))
    first_of = kinds.select("anchor", "context", F.col("f.doc_id").alias("first_doc"), F.col("f.lo").alias("first_lo"))
    later = places.join(first_of, ["anchor", "context"]).where("doc_id <> first_doc or lo <> first_lo").select("doc_id", "lo", "hi")
    marked = later.unionByName(several.select("doc_id", "lo", "hi")).groupBy("doc_id", _part("lo")).agg(F.collect_list(F.struct(_place("lo"), _place("hi"))).alias("repeats"))
    starts = firsts.groupBy("doc_id", _part("start")).agg(F.collect_list(_place("start")).alias("firsts"))
    both = source.join(marked, ["doc_id", "part"], "left").join(starts, ["doc_id", "part"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, repeats, first in zip(b["doc_id"], b["text"], b["repeats"], b["firsts"], strict=True):
                data = utf8(text)
                if repeats is None:
                    rows.append((i, len(data), 0, 0, hashlib.sha256(data).hexdigest(), []))
                    continue
                own = np.empty(0, np.int64) if first is None else np.asarray(first, np.int64)
                lo, hi = removed_spans(np.frombuffer(data, np.uint8), [(r["lo"], r["hi"]) for r in repeats], own)
                digest, last = hashlib.sha256(), 0
                for s, e in zip(lo.tolist(), hi.tolist(), strict=True):
                    digest.update(data[last:s])
                    last = e
                digest.update(data[last:])
                spans = [{"start": s, "end": e} for s, e in zip(lo.tolist(), hi.tolist(), strict=True)]
                rows.append((i, len(data), int((hi - lo).sum()), len(lo), digest.hexdigest(), spans))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return both.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def op5_substrings(docs: DataFrame) -> DataFrame:
    """The digest of what stays of every document."""
    return dedup_substrings(docs)
