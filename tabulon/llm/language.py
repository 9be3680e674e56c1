"""Language identification by rank-order profiles of character n-grams.

A profile is the ranking of the most frequent 1- to 3-grams of a language's texts. A document gets the language whose
profile has the least out-of-place distance to the document's own ranking: each of its most frequent n-grams adds the
difference of the two ranks, or the length of a profile where the profile lacks it.

Letters are what ``str.isalpha`` accepts, after lower-casing; runs of anything else count as one word border, which
n-grams may hold at either end only. Equal counts rank by code point, equal distances by language name. A null text, an empty one or one
without letters is ``und`` with score 0, and so is every text if nothing can be learnt from. Repeated rows learn and
predict each for itself; extra columns are ignored, and so are rows without doc_id in the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.bytesops import held_out, small_batches

TOP = 300
BORDER = 1
BITS = 21
CHUNK = 1 << 20

_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _alpha


def _counts(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(codes, return_counts=True)
    values, at = np.unique(codes, return_inverse=True)
    return values, np.bincount(at, weights).astype(np.int64)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a character) and counts of a text's n-grams; codes ascend."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return none
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = letter[0]
    seq = np.where(letter, points, BORDER)[kept]
    seq = np.concatenate([[BORDER], seq, [BORDER] if seq[-1] != BORDER else []]).astype(np.int64)
    parts = []
    for at in range(0, len(seq), CHUNK):
        a = seq[at:at + CHUNK + 2]
        own = min(CHUNK, len(seq) - at)
        two = a[:-1] << BITS | a[1:]
        three = (two[:-1] << BITS | a[2:])[a[1:-1] != BORDER]
        one = a[:own]
        parts.append(_counts(np.concatenate([one[one != BORDER], two[:own], three])))
    if len(parts) == 1:
        return parts[0]
    return _counts(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def ranking(text: str | None, top: int = TOP) -> np.ndarray:
    """Codes of a text's most frequent n-grams, best first; ties by code."""
    codes, counts = ngram_counts(text)
    return codes[np.argsort(-counts, kind="stable")[:top]]


def gram(code: int) -> str:
    """The n-gram of a code, its word borders as ``_``."""
    points = [code >> s & (1 << BITS) - 1 for s in (2 * BITS, BITS, 0)]
    return "".join("_" if p == BORDER else chr(p) for p in points if p)


def learn_profiles(df: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """(lang, code, n, rank) of each language's most frequent n-grams, over all rows with a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(name: str) -> tuple[np.ndarray, np.ndarray]:
            parts = held[name]
            return _counts(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))

        for b in batches:
            for name, t in zip(b["lang"], b["t"], strict=True):
                held.setdefault(name, []).append(ngram_counts(t))
                if len(held[name]) >= 256:
                    held[name] = [merged(name)]
        for name in held:
            codes, counts = merged(name)
            yield pd.DataFrame({"lang": name, "code": codes, "n": counts})

    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t")).where("lang is not null and t is not null")
    counts = rows.mapInPandas(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    first = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)  # so each task sends its first ones only
    return first.withColumn("rank", F.col("rank") - 1)


class Profiles:
    """Profiles as arrays: bounded by the number of languages times ``top``."""

    def __init__(self, rows: list, top: int = TOP) -> None:
        self.top = top
        self.langs = sorted({r["lang"] for r in rows})
        self.codes = np.array(sorted({r["code"] for r in rows}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, np.int64)
        for r in rows:
            self.ranks[self.langs.index(r["lang"]), np.searchsorted(self.codes, r["code"])] = r["rank"]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 less the distance as a share of the largest possible one."""
        own = ranking(text, self.top)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        theirs = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        away = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own))), self.top).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(min(1.0, max(0.0, 1 - away[best] / (self.top * len(own)))))


def predict_language(df: DataFrame, profiles: DataFrame, text: str = "text", top: int = TOP) -> DataFrame:
    """``df`` with the struct column ``language`` (lang, score)."""
    small_batches(df.sparkSession)
    model = Profiles(profiles.select("lang", "code", "rank").collect(), top)  # at most languages * top rows

    @F.pandas_udf("lang string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return df.withColumn("language", language(F.col(text).cast("string")))


def op6_language(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """The language of every document, learnt from the rows that aren't held out."""
    held = held_out(F.col("doc_id")) if held is None else held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null")
    profiles = learn_profiles(rows.where(~held))
    found = predict_language(rows.select("doc_id", "text"), profiles)
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
