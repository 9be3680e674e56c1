"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Learning: of the labelled rows, at most ``max_examples`` (the first ones by a hash of the id) are examples. All of them are indexed twice:
by all their words, whatever these tell, and by a lexicon of words and character 4- to 6-grams of words with their borders
that tell toxic examples apart (``MIN_Z``, ``MIN_PRECISION``, at least ``MIN_ROWS`` rows, at most ``max_terms``). N-grams
outside the lexicon aren't indexed. Document frequencies of words and lexicon are counted over all documents.

Search by all words: block-max bounds find every example whose cosine with the text is ``LEAST_COSINE`` or more, exactly; further ones
don't vote. Votes weigh c / (1 - c), so a copy of an example gets that one's label.

Search in the lexicon: the examples' unit vectors form an inverted index of postings in blocks of ``BLOCK`` examples, each block with
the largest weight it holds for a term. A query bounds every block by these, visits blocks from the highest bound on, and
stops when no bound reaches its k-th best cosine: the neighbours are exact, ties go to the smaller id. Votes weighted by cosine, and one vote
of the rate of examples without a term, give the raw score; isotonic regression over the examples' own leave-one-out votes turns it into a calibrated one.
Votes by all words are calibrated likewise, over the examples that the lexicon gives less than 0.5 and in pools of
``LEAST_POOL`` at least. The score is the larger one. The evidence is
the nearest examples and the query's heaviest terms in the lexicon, or among all words where these decide.

Texts without any term of the lexicon (null and empty ones too) have the calibrated rate of such examples there. Without
examples every score is 0. Rows with a null label are not labelled; a document labelled twice takes its largest label.
Repeated rows are scored each for itself; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.bytesops import documents_of, held_out, mix64, small_batches
from tabulon.session import cut, free

MAX_EXAMPLES = 20_000
MAX_TERMS = 20_000
MIN_ROWS = 5
MIN_Z = 5.0
MIN_PRECISION = 0.5
NEIGHBOURS = 15
BLOCK = 64
WORD_BLOCK = 256  # a place in a block takes one byte
LEAST_COSINE = 0.7
ASIDE = 0.9  # of it is the most that the words set aside bring
PARTS = 16  # ranges of words whose postings are made together
SLACK = 1e-5  # of weights with single precision
GRAMS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 1_000_000  # met before, that a worker keeps
READ_CHARS = 500_000  # of texts that are read together
COMMON = 16  # entries of a word whose largest weights are kept as a row of all blocks
LEAST_POOL = 50


def terms_of(word: str) -> list[str]:
    """A word with its borders, and its character n-grams."""
    edged = f"^{word}$"
    return list({edged, *(edged[i:i + n] for n in GRAMS for i in range(len(edged) - n + 1))})


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Vectors:
    """Term counts of texts over a fixed lexicon, found in one pass of an automaton over the words with their borders."""

    def __init__(self, terms: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t, i)
        self.any = bool(terms)
        if self.any:
            self.automaton.make_automaton()

    def counts(self, words: list[str]) -> dict[int, int]:
        if not words or not self.any:
            return {}
        return dict(Counter(i for _, i in self.automaton.iter("^" + "$^".join(words) + "$")))

    def found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, term) of every occurrence, by places; no term reaches over a border."""
        if not words or not self.any:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hits = np.array(list(self.automaton.iter("^" + "$^".join(words) + "$")), np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
        return np.searchsorted(ends, hits[:, 0], "right"), hits[:, 1]


def spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges one after the other, and the ranges' lengths."""
    n = end - begin
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(begin - (ends - n), n), n


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point belongs to words, as ``WORD`` says."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        out[m.start():m.end()] = True
    return out


def keys_of(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of words that lie one after the other in ``codes``: sums of a random number for each letter times one for its place."""
    if not len(first):
        return np.empty(0, np.uint64)
    by_place = mix64(np.arange(1, int(length.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    place = np.arange(len(codes)) - np.repeat(first, length)
    return mix64(np.add.reduceat(mix64(codes + np.uint64(1 << 40)) * by_place[place], first))


def word_keys(words: list[str]) -> np.ndarray:
    """The fingerprints of single words, so that workers hold 8 bytes a word instead of its spelling; none is empty."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    return keys_of(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(length) - length, length)


class Counted(NamedTuple):
    """Some texts: distinct words (text, number, times) and terms of the lexicon (text, term, times), both by texts; of each number the key,
    the place among the examples' words or -1, and where the word is in ``joined``."""

    texts: int
    word_text: np.ndarray
    word: np.ndarray
    times: np.ndarray
    term_text: np.ndarray
    term: np.ndarray
    term_times: np.ndarray
    key: np.ndarray
    place: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    joined: str

    def ranges(self, of: np.ndarray) -> list[int]:
        return np.searchsorted(of, np.arange(self.texts + 1)).tolist()

    def spelt(self, words: np.ndarray) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.begin[words].tolist(), self.end[words].tolist(), strict=True)]


class Reader:
    """Reads texts, many at once: words are found and fingerprinted as arrays, and the automaton reads a word only when it is new.

    At most ``KNOWN_WORDS`` words are kept, by their keys, with the terms they hold.
    """

    def __init__(self, terms: list[str], keys: np.ndarray) -> None:
        """``keys``, of the examples' words, ascend."""
        self.terms, self.keys, self.vectors = len(terms), keys, Vectors(terms)
        self.forget()

    def forget(self) -> None:
        self.known, self.known_at = np.empty(0, np.uint64), np.empty(0, np.int64)  # ascending keys, and each one's place in ``starts``
        self.starts, self.held = np.zeros(1, np.int64), np.empty(0, np.int64)

    def _terms(self, key: np.ndarray, begin: np.ndarray, end: np.ndarray, joined: str) -> np.ndarray:
        """The place in ``starts`` of each of these words, by ascending keys."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        at = np.searchsorted(self.known, key)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != key[~new]
        if new.any():
            words = [joined[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
            own, terms = self.vectors.found(words)
            self.known_at = np.insert(self.known_at, at[new], len(self.starts) - 1 + np.arange(len(words)))
            self.known = np.insert(self.known, at[new], key[new])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.bincount(own, minlength=len(words))))
            self.held = np.append(self.held, terms)
            at += np.cumsum(new) - new
        return self.known_at[at]

    def _read(self, texts: list[str]) -> Counted:
        lower = [t.lower() for t in texts]
        joined = "\n".join(lower)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.nonzero(letters()[codes])[0]
        first = np.nonzero(np.diff(at, prepend=-2) > 1)[0]  # of each word, among the letters
        length = np.diff(first, append=len(at))
        key, where, number = np.unique(keys_of(codes[at], first, length), return_index=True, return_inverse=True)
        begin = at[first]
        text = np.searchsorted(np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1), begin, "right")
        some = max(1, len(key))
        pairs, times = np.unique(text * some + number, return_counts=True)
        text, word = pairs // some, pairs % some
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = -1
        place[place >= 0] = np.where(self.keys[place[place >= 0]] == key[place >= 0], place[place >= 0], -1)
        begin, end = begin[where], begin[where] + length[where]
        held = self._terms(key, begin, end, joined)[word]
        at, n = spans(self.starts[held], self.starts[held + 1])
        some = max(1, self.terms)
        found, own = np.unique(np.repeat(text, n) * some + self.held[at], return_inverse=True)
        term_times = np.bincount(own, np.repeat(times, n), len(found)).astype(np.int64)
        return Counted(len(texts), text, word, times, found // some, found % some, term_times, key, place, begin, end, joined)

    def read(self, texts: Iterable[str | None]) -> Iterator[Counted]:
        """All texts in their order, about ``READ_CHARS`` at a time."""
        some, size = [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size > READ_CHARS:
                yield self._read(some)
                some, size = [], 0
        if some:
            yield self._read(some)


def unit_weights(text: np.ndarray, times: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """Weights of terms with these document weights, by texts of length 1."""
    w = (1 + np.log(times)) * idf
    return w / np.maximum(np.sqrt(np.bincount(text, w * w, texts)), 1e-300)[text]


def postings_of(cols: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings by word and block: each entry's word, block, number of postings and largest weight; each posting's place in its block and weight."""
    order = np.lexsort((rows, cols))
    cols, rows, weights = cols[order], rows[order], weights[order]
    block = rows // WORD_BLOCK
    first = np.ones(len(cols), bool)
    first[1:] = (cols[1:] != cols[:-1]) | (block[1:] != block[:-1])
    at = np.nonzero(first)[0]
    largest = np.maximum.reduceat(weights, at) if len(at) else weights
    return cols[at].astype(np.int32), block[at].astype(np.int32), np.diff(np.append(at, len(cols))).astype(np.int32), largest.astype(np.float32), (rows % WORD_BLOCK).astype(np.uint8), weights.astype(np.float32)


def bounds(n: np.ndarray) -> np.ndarray:
    """Where ranges of these lengths begin and end that lie one after the other."""
    out = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=out[1:])
    return out


class WordIndex:
    """All words of the examples as a block-max index, and the nearest examples of a text whose cosine is ``least`` or more.

    A text's commonest words are set aside as long as their weights' length stays under ``ASIDE`` of ``least``: by Cauchy and Schwarz that is all they
    can bring. The other words bound every block of ``WORD_BLOCK`` examples by their largest weights in it; only blocks that can reach
    ``least`` are opened, and the words set aside are summed where an example of these still can.
    """

    def __init__(self, vocabulary: list[str] | np.ndarray, idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], unseen: float = 1.0, k: int = NEIGHBOURS, least: float = 0.0) -> None:
        """``examples`` is (doc_id, label, places in ``vocabulary``, counts), ``vocabulary`` words or their keys; a word of a text that no example has weighs ``unseen``."""
        keys = vocabulary if isinstance(vocabulary, np.ndarray) else word_keys(vocabulary)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.idf, self.unseen, self.k, self.least = idf.astype(np.float32), unseen, k, least
        cols = np.concatenate([e[2] for e in examples] or [np.empty(0, np.int32)]).astype(np.int32)
        weights = np.concatenate([self.unit(e[2], e[3]).astype(np.float32) for e in examples] or [np.empty(0, np.float32)])
        rows = np.repeat(np.arange(len(examples), dtype=np.int32), [len(e[2]) for e in examples])
        self.name([e[0] for e in examples], [e[1] for e in examples])
        cols, block_of, counts, *rest = postings_of(cols, rows, weights)
        self.hold(bounds(np.bincount(cols, minlength=len(self.keys))), block_of, bounds(counts), *rest)

    def name(self, ids: np.ndarray, labels: np.ndarray) -> None:
        """Take the examples' ids and labels."""
        self.ids, self.labels = np.asarray(ids, np.int64), np.asarray(labels, np.float64)
        self.rate = float(self.labels.mean()) if len(self.ids) else 0.0
        self.blocks = -(-len(self.ids) // WORD_BLOCK)
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def hold(self, starts: np.ndarray, block_of: np.ndarray, postings: np.ndarray, block_max: np.ndarray, inside: np.ndarray, weights: np.ndarray) -> None:
        """Take what ``postings_of`` gives, with the bounds of each word's entries and each entry's postings."""
        self.starts, self.block_of, self.postings, self.block_max, self.inside, self.weights = starts, block_of, postings, block_max, inside, weights
        common = np.nonzero(np.diff(starts) >= COMMON)[0]
        self.row = np.full(len(starts) - 1, -1, np.int32)  # of a common word in ``maxima``
        self.row[common] = np.arange(len(common))
        self.maxima = np.zeros((len(common), self.blocks), np.float32)
        for k in range(0, len(common), 1000):
            some = common[k:k + 1000]
            entries, n = spans(starts[some], starts[some + 1])
            self.maxima[np.repeat(np.arange(k, k + len(some)), n), block_of[entries]] = block_max[entries]

    def unit(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[at]
        return w / max(np.sqrt((w * w).sum()), 1e-300)

    def query(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(places, weights, spellings) of a text's words that examples have; all its words count in its length."""
        found = Counter(words)
        if not found or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0), []
        keys, spelt = word_keys(list(found)), list(found)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        w = 1 + np.log(np.fromiter(found.values(), np.float64, len(found)))
        w *= np.where(known, self.idf[self.order[at]], self.unseen)
        w /= max(np.sqrt((w * w).sum()), 1e-300)
        return self.order[at[known]], w[known], [spelt[i] for i in np.nonzero(known)[0].tolist()]

    def _entries(self, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index entries of words, and each one's weight in the text."""
        entries, n = spans(self.starts[at], self.starts[at + 1])
        return entries, np.repeat(weights, n)

    def _sums(self, opened: np.ndarray, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Parts of cosines of the examples in the ``opened`` blocks."""
        place = np.full(self.blocks, -1)
        place[opened] = np.arange(len(opened))
        own = place[self.block_of[entries]]
        held = own >= 0
        entries, own, weights = entries[held], own[held], weights[held]
        postings, n = spans(self.postings[entries], self.postings[entries + 1])
        return np.bincount(np.repeat(own * WORD_BLOCK, n) + self.inside[postings], self.weights[postings] * np.repeat(weights, n), len(opened) * WORD_BLOCK)

    def _candidates(self, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(opened blocks, examples that may reach ``least`` as places in them, parts of their cosines, words set aside)."""
        order = np.argsort(self.starts[at] - self.starts[at + 1], kind="stable")
        length = np.sqrt(np.cumsum(weights[order] ** 2))
        aside = int(np.searchsorted(length, self.least * ASIDE))
        rest = length[aside - 1] if aside > 0 else 0.0
        at, weights = at[order[aside:]], weights[order[aside:]]
        row = self.row[at]
        common = row >= 0
        entries, w = self._entries(at[~common], weights[~common])
        bound = weights[common].astype(np.float32) @ self.maxima[row[common]] + np.bincount(self.block_of[entries], self.block_max[entries] * w, self.blocks)
        opened = np.nonzero((bound > 0) & (bound + rest >= self.least - SLACK))[0]
        if not len(opened):
            return opened, opened, bound[:0], order[:aside]
        sums = self._sums(opened, *self._entries(at, weights))
        hit = np.nonzero((sums > 0) & (sums + rest >= self.least - SLACK))[0]
        return opened, hit, sums[hit], order[:aside]

    def neighbours(self, at: np.ndarray, weights: np.ndarray, leave: int | None = None) -> list[tuple[int, float]]:
        """(row, cosine) of the k nearest examples with a cosine over 0 and of ``least`` or more; ties go to the smaller id."""
        if not len(at) or not self.blocks:
            return []
        opened, hit, cosines, aside = self._candidates(at, weights)
        rows = opened[hit // WORD_BLOCK] * WORD_BLOCK + hit % WORD_BLOCK
        if leave is not None:
            rows, cosines = rows[self.ids[rows] != leave], cosines[self.ids[rows] != leave]
        if len(rows) and len(aside):
            again = np.unique(rows // WORD_BLOCK)
            more = self._sums(again, *self._entries(at[aside], weights[aside]))
            cosines = cosines + more[np.searchsorted(again, rows // WORD_BLOCK) * WORD_BLOCK + rows % WORD_BLOCK]
            rows, cosines = rows[cosines >= self.least - SLACK], cosines[cosines >= self.least - SLACK]
        first = np.lexsort((self.ids[rows], -cosines))[: self.k]
        return [(r, min(1.0, c)) for r, c in zip(rows[first].tolist(), cosines[first].tolist(), strict=True)]

    def vote(self, found: list[tuple[int, float]]) -> float:
        w = np.array([c / (1 - c + 1e-3) for _, c in found])
        return float(((w * self.labels[[r for r, _ in found]]).sum() + self.rate) / (w.sum() + 1))

    def queries(self, texts: Counted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, weights, numbers) of each text's words that examples have; all its words count in its length."""
        places = texts.place[texts.word]
        known = places >= 0
        idf = np.full(len(known), self.unseen)
        idf[known] = self.idf[places[known]]
        w = unit_weights(texts.word_text, texts.times, idf, texts.texts)[known]
        place, word, at = places[known], texts.word[known], texts.ranges(texts.word_text[known])
        return ((place[a:b], w[a:b], word[a:b]) for a, b in pairwise(at))

    def score(self, at: np.ndarray, w: np.ndarray, word: np.ndarray, texts: Counted) -> tuple[float, list[tuple[int, float, int]], list[str]]:
        found = self.neighbours(at, w)
        if not found or self.curve is None:
            return 0.0, [], []
        own = np.lexsort((at, -w))[:3]
        near = [(int(self.ids[r]), c, int(self.labels[r])) for r, c in found[:3]]
        return float(np.interp(self.vote(found), *self.curve)), near, [f"^{x}$" for x in texts.spelt(word[own])]


def isotonic(votes: np.ndarray, labels: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators, of runs of ``least`` rows, with one prior row at either end."""
    order = np.argsort(votes, kind="stable")
    runs = [order[i:i + least] for i in range(0, len(order) - len(order) % least, least)] if len(order) >= least else [order] if len(order) else []
    if runs and len(order) >= least and len(order) % least:
        runs[-1] = order[(len(runs) - 1) * least:]
    first = [(float(labels[r].sum()), float(len(r)), float(votes[r[0]]), float(votes[r[-1]])) for r in runs]
    pools: list[list[float]] = []
    for pool in [(0.0, 1.0, 0.0, 0.0), *first, (1.0, 1.0, 1.0, 1.0)]:
        pools.append(list(pool))
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    return np.array([v for p in pools for v in (p[2], p[3])]), np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


class Model:
    """The index of bounded examples. ``examples`` is (doc_id, label, counts) rows; ``idf`` has a weight for each term."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]], k: int = NEIGHBOURS) -> None:
        self.terms, self.idf, self.k = terms, idf, k
        size = [len(c) for _, _, c in examples]
        at = np.array([i for _, _, c in examples for i in sorted(c)], np.int64)
        times = np.array([c[i] for _, _, c in examples for i in sorted(c)], np.int64)
        self.hold(np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], np.float64), np.repeat(np.arange(len(size)), size), at, times)

    def hold(self, ids: np.ndarray, labels: np.ndarray, own: np.ndarray, cols: np.ndarray, times: np.ndarray) -> None:
        """Take the examples: ids and labels, and (place in ``ids``, term, times), by places and terms."""
        weights = unit_weights(own, times, self.idf[cols], len(ids))
        # alike examples share blocks: order by the heaviest term, then its weight
        top = np.lexsort((cols, -weights, own))
        top = top[np.unique(own[top], return_index=True)[1]]
        heaviest, weight = np.full(len(ids), -1), np.zeros(len(ids))
        heaviest[own[top]], weight[own[top]] = cols[top], weights[top]
        order = np.lexsort((ids, -weight, heaviest))
        self.ids, self.labels, self.blank = ids[order], labels[order], heaviest[order] < 0
        self.blocks = -(-len(ids) // BLOCK)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        rows = place[own]
        order = np.lexsort((rows, cols))
        self.rows, self.weights = rows[order], weights[order]
        self.starts = np.searchsorted(cols[order], np.arange(len(self.terms) + 1))
        key = cols[order] * max(1, self.blocks) + self.rows // BLOCK
        own, at = np.unique(key, return_index=True)  # postings of one term and block are neighbours
        self.block_max = np.maximum.reduceat(self.weights, at) if len(at) else np.empty(0)
        self.block_of = own % max(1, self.blocks)
        self.postings = np.append(at, len(key))
        self.block_starts = np.searchsorted(own // max(1, self.blocks), np.arange(len(self.terms) + 1))
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        self.words: WordIndex | None = None
        self.shared: dict[str, Broadcast] | None = None
        self.blank_rate = float(self.labels[self.blank].mean()) if self.blank.any() else 0.0
        self._search = lru_cache(2_000)(self._search_one)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), np.int64)
        w = np.array([(1 + np.log(counts[i])) * self.idf[i] for i in at.tolist()])
        norm = float(np.sqrt((w * w).sum()))
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def neighbours(self, at: np.ndarray, weights: np.ndarray, leave: int | None = None) -> list[tuple[int, float]]:
        """(row, cosine) of the k best examples with a cosine over 0, exactly; ``leave`` is an id to leave out."""
        return self._search(at.tobytes(), weights.tobytes(), leave)

    def _search_one(self, at_bytes: bytes, weight_bytes: bytes, leave: int | None) -> list[tuple[int, float]]:
        at, q = np.frombuffer(at_bytes, np.int64), np.frombuffer(weight_bytes)
        entries, n = spans(self.block_starts[at], self.block_starts[at + 1])
        w, block_of = np.repeat(q, n), self.block_of[entries]
        bound = np.bincount(block_of, w * self.block_max[entries], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        best: list[tuple[float, int, int]] = []
        step, p = 8, 0
        while p < len(order):
            kth = best[self.k - 1][0] if len(best) >= self.k else 0.0
            some = order[p:p + step]
            some = some[bound[some] >= -kth - 1e-9]
            if not len(some):
                break
            place = np.full(self.blocks, -1)
            place[some] = np.arange(len(some))
            own = place[block_of]
            here = own >= 0
            postings, n = spans(self.postings[entries[here]], self.postings[entries[here] + 1])
            scores = np.bincount(np.repeat(own[here] * BLOCK, n) + self.rows[postings] % BLOCK, self.weights[postings] * np.repeat(w[here], n), len(some) * BLOCK)
            hit = np.nonzero(scores > 0)[0]
            rows = some[hit // BLOCK] * BLOCK + hit % BLOCK
            if leave is not None:
                hit, rows = hit[self.ids[rows] != leave], rows[self.ids[rows] != leave]
            first = np.lexsort((self.ids[rows], -scores[hit]))[: self.k]
            best = sorted([*best, *zip((-scores[hit[first]]).tolist(), self.ids[rows[first]].tolist(), rows[first].tolist(), strict=True)])[: self.k]
            p += step
            step *= 4
        return [(row, min(1.0, -c)) for c, _, row in best]

    def vote(self, found: list[tuple[int, float]]) -> float:
        w = np.array([c for _, c in found])
        y = self.labels[[r for r, _ in found]]
        return float(((w * y).sum() + self.blank_rate) / (w.sum() + 1))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression of labels on votes."""
        self.curve = isotonic(votes, labels)

    def queries(self, texts: Counted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text."""
        w = unit_weights(texts.term_text, texts.term_times, self.idf[texts.term], texts.texts)
        return ((texts.term[a:b], w[a:b]) for a, b in pairwise(texts.ranges(texts.term_text)))

    def score(self, at: np.ndarray, w: np.ndarray) -> tuple[float, list[tuple[int, float, int]], list[str]]:
        """Calibrated score, the three nearest examples (id, cosine, label), the heaviest terms."""
        found = self.neighbours(at, w) if len(at) else []
        if not found:
            return self.blank_rate, [], []
        raw = self.vote(found)
        out = float(np.interp(raw, *self.curve)) if self.curve is not None else raw
        near = [(int(self.ids[r]), c, int(self.labels[r])) for r, c in found[:3]]
        return out, near, [self.terms[i] for i in at[np.argsort(-w, kind="stable")[:3]].tolist()]

    def scores(self, texts: Counted) -> Iterator[tuple[float, list[tuple[int, float, int]], list[str]]]:
        """Of each text the larger of the lexicon's score and that of all words, with its evidence."""
        for own, all_words in zip(self.queries(texts), self.words.queries(texts), strict=True):
            by_terms = self.score(*own)
            by_words = self.words.score(*all_words, texts) if by_terms[0] < 0.5 else (0.0, [], [])
            yield by_words if by_words[0] > by_terms[0] or not by_terms[1] and by_words[1] and by_words[0] == by_terms[0] else by_terms


def _examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # bounded, so it may be broadcast
    return docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def _vocabulary(examples: DataFrame, max_terms: int) -> list[str]:
    """The terms that tell toxic examples apart, best first."""
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return []

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str, int] = {}
            words = [np.array([known.setdefault(w, len(known)) for w in set(words_of(t))], np.int32) for t in b["text"]]
            numbers: dict[str, int] = {}
            held, ends = array("i"), array("i", [0])  # terms of each word
            for w in known:
                held.extend([numbers.setdefault(t, len(numbers)) for t in terms_of(w)])
                ends.append(len(held))
            del known
            flat, starts = np.frombuffer(held, np.int32), np.frombuffer(ends, np.int32)
            n, last = np.zeros((2, len(numbers)), np.int64), np.empty(len(numbers), np.int32)
            for own, toxic in zip(words, b["toxic"], strict=True):
                if len(own):
                    terms = flat[spans(starts[own], starts[own + 1])[0]]
                    places = np.arange(len(terms), dtype=np.int32)
                    last[terms] = places
                    n[int(toxic > 0), terms[last[terms] == places]] += 1
            yield pd.DataFrame({"term": list(numbers), "n0": n[0], "n1": n[1]})

    counted = examples.select("text", "toxic").mapInPandas(spread, "term string, n0 long, n1 long")
    total = counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / F.lit(n0 + n1)
    z = (F.col("n1") / F.lit(n1) - F.col("n0") / F.lit(n0)) / F.sqrt(share * (1 - share) * F.lit(1 / n1 + 1 / n0) + 1e-12)
    told = total.withColumn("z", z).where((F.col("n1") >= MIN_ROWS) & (F.col("z") >= MIN_Z) & (F.col("n1") >= MIN_PRECISION * (F.col("n0") + F.col("n1"))))
    return [r["term"] for r in told.orderBy(F.desc("z"), "term").limit(max_terms).collect()]


def _part_of(keys: np.ndarray) -> np.ndarray:
    """The range of keys, of ``PARTS`` equal ones."""
    return (keys >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)


def _keys_of(examples: DataFrame) -> np.ndarray:
    """The different keys of the words of all examples, ascending."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = np.unique(np.frombuffer(b"".join(b["words"]), np.uint64))
            part = _part_of(keys)
            yield pd.DataFrame([(p, keys[part == p].tobytes()) for p in range(PARTS)], columns=["part", "words"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"][:1], "words": [np.unique(np.frombuffer(b"".join(rows["words"]), np.uint64)).tobytes()]})

    schema = "part long, words binary"
    found = examples.select("words").mapInPandas(spread, schema).groupBy("part").applyInPandas(merge, schema).toLocalIterator()
    return np.frombuffer(b"".join(r["words"] for r in sorted(found, key=lambda r: r["part"])), np.uint64)


#: What ``postings_of`` gives, by the names under which it is sent; ``cols`` and ``counts`` are sent as ``bounds``.
POSTINGS = {"cols": np.int32, "block_of": np.int32, "counts": np.int32, "block_max": np.float32, "inside": np.uint8, "weights": np.float32}


def _postings(examples: DataFrame, index: WordIndex) -> dict[str, Broadcast]:
    """The index of all words, made by ranges of words; row numbers are places in the index's ids, which ascend.

    The ranges are a written table. Each of its columns is one array, which the driver holds only until it is sent.
    """
    context = examples.sparkSession.sparkContext
    shared = context.broadcast((index.keys, index.idf, index.ids))
    kinds = (np.int32, np.int32, np.float32)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, idf, known = shared.value
        for b in batches:
            at = [np.searchsorted(keys, np.frombuffer(k, np.uint64)) for k in b["words"]]
            size = [len(a) for a in at]
            times = np.concatenate([np.frombuffer(n, np.int32) for n in b["times"]] or [np.empty(0, np.int32)])
            at, text = np.concatenate(at or [np.empty(0, np.int64)]), np.repeat(np.arange(len(b)), size)
            rows = np.repeat(np.searchsorted(known, b["doc_id"].to_numpy(np.int64)), size)
            both = [x.astype(t) for x, t in zip((at, rows, unit_weights(text, times, idf[at].astype(np.float64), len(b))), kinds, strict=True)]
            part = _part_of(keys[at])
            yield pd.DataFrame([(p, *(x[part == p].tobytes() for x in both)) for p in range(PARTS)], columns=["part", "cols", "rows", "weights"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = postings_of(*(np.frombuffer(b"".join(rows[c]), t) for c, t in zip(("cols", "rows", "weights"), kinds, strict=True)))
        return pd.DataFrame({"part": rows["part"][:1], **{c: [x.tobytes()] for c, x in zip(POSTINGS, own, strict=True)}})

    spread_rows = examples.select("doc_id", "words", "times").mapInPandas(spread, "part long, cols binary, rows binary, weights binary")
    parts = cut(spread_rows.groupBy("part").applyInPandas(build, "part long, " + ", ".join(f"{c} binary" for c in POSTINGS)))

    def column(name: str, kind: type) -> np.ndarray:
        sizes = {r["part"]: r["n"] for r in parts.select("part", F.octet_length(name).alias("n")).collect()}
        ends = dict(zip(sorted(sizes), np.cumsum([sizes[p] for p in sorted(sizes)]).tolist(), strict=True))
        out = np.empty(sum(sizes.values()), np.uint8)
        for r in parts.select("part", name).toLocalIterator():  # a part at a time
            out[ends[r["part"]] - sizes[r["part"]]:ends[r["part"]]] = np.frombuffer(r[name], np.uint8)
        return out.view(kind)

    ranges = {"cols": lambda x: bounds(np.bincount(x, minlength=len(index.keys))), "counts": bounds}
    sent = {c: context.broadcast(ranges.get(c, np.asarray)(column(c, t))) for c, t in POSTINGS.items()}
    shared.destroy()
    free(parts)
    return sent


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, least: float = LEAST_COSINE) -> Model:
    """The model of at most ``max_examples`` examples, each with all its words; statistics of its terms come from all of ``docs``."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    source = documents_of(docs)
    examples = cut(_examples(source, labels, max_examples))
    terms = _vocabulary(examples, max_terms)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(terms, np.empty(0, np.uint64))
        for b in batches:
            own = []
            for c in reader.read(b["text"]):
                keys = c.key[c.word]
                at, n, times = c.term.astype(np.int32), c.term_times.astype(np.int32), c.times.astype(np.int32)
                own += [(at[i:j].tobytes(), n[i:j].tobytes()) + (keys[k:m].tobytes(), times[k:m].tobytes()) for (i, j), (k, m) in zip(pairwise(c.ranges(c.term_text)), pairwise(c.ranges(c.word_text)), strict=True)]
            yield pd.concat([b[["doc_id", "toxic"]], pd.DataFrame(own, columns=["at", "n", "words", "times"])], axis=1)

    counted_examples = cut(examples.select("doc_id", "toxic", "text").mapInPandas(counts, "doc_id long, toxic int, at binary, n binary, words binary, times binary"))
    held = counted_examples.select("doc_id", "toxic", "at", "n").toPandas().sort_values("doc_id", ignore_index=True)
    ids, toxic = held["doc_id"].to_numpy(np.int64), (held["toxic"].to_numpy() > 0).astype(np.float64)
    own = np.repeat(np.arange(len(held)), [len(x) // 4 for x in held["at"]])
    cols, times = (np.frombuffer(b"".join(held[c]), np.int32).astype(np.int64) for c in ("at", "n"))
    del held
    vocabulary = _keys_of(counted_examples)
    seen = context.broadcast((terms, vocabulary))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_terms, own_words = seen.value
        reader = Reader(own_terms, own_words)
        n, df, df_words = 0, np.zeros(len(own_terms), np.int64), np.zeros(len(own_words), np.int64)
        for b in batches:
            for c in reader.read(b["text"]):
                n += c.texts
                df += np.bincount(c.term, minlength=len(df))
                known = c.place >= 0  # places differ
                df_words[c.place[known]] += np.bincount(c.word, minlength=len(known))[known]
        df = np.append(df, df_words)
        some = np.nonzero(df)[0]
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(df[some], n)})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"terms": [b["term"].to_numpy(np.int64).tobytes()], "ns": [b["n"].to_numpy(np.int64).tobytes()]})

    counted = source.select("text").mapInPandas(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows, df = 0, np.zeros(len(terms) + len(vocabulary), np.int64)
    for r in counted.mapInPandas(packed, "terms binary, ns binary").collect():  # 16 bytes for each term
        at, n = np.frombuffer(r["terms"], np.int64), np.frombuffer(r["ns"], np.int64)
        df[at[at >= 0]] = n[at >= 0]
        rows += int(n[at < 0].sum())
    idf = np.log((1 + rows) / (1 + df)) + 1
    seen.destroy()
    model = Model(terms, idf[: len(terms)], [])
    model.hold(ids, toxic, own, cols, times)
    model.words = WordIndex(vocabulary, idf[len(terms):], [], float(np.log(1 + rows) + 1), least=least)
    model.words.name(ids, toxic)
    sent = _postings(counted_examples, model.words)
    shared = {"model": context.broadcast(_state(model)), **sent}
    model.words = WordIndex(vocabulary[:0], idf[:0], [])  # the driver keeps no copy, only the curve
    del vocabulary, idf, df, ids, toxic, own, cols, times

    def leave_one_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _restore(shared)
        reader = Reader(terms, own.words.keys)
        for b in batches:
            rows, ids = [], iter(zip(b["doc_id"], b["toxic"], strict=True))
            for c in reader.read(b["text"]):
                for (at, w), (places, weights, _), (i, y) in zip(own.queries(c), own.words.queries(c), islice(ids, c.texts), strict=True):
                    found = own.neighbours(at, w, int(i)) if len(at) else []
                    near = own.words.neighbours(places, weights, int(i))
                    rows.append((own.vote(found) if found else None, own.words.vote(near) if near else None, float(y > 0)))
            yield pd.DataFrame(rows, columns=["vote", "by_words", "label"])

    votes = examples.select("doc_id", "toxic", "text").mapInPandas(leave_one_out, "vote double, by_words double, label double").toPandas()
    votes = votes.astype(float)
    model.calibrate(*(votes.dropna(subset="vote")[c].to_numpy() for c in ("vote", "label")))
    if len(votes):
        lexicon = np.interp(votes["vote"].fillna(0.0), *model.curve)
        missed = votes[np.where(votes["vote"].isna(), model.blank_rate, lexicon) < 0.5].dropna(subset="by_words")
        model.words.curve = isotonic(missed["by_words"].to_numpy(), missed["label"].to_numpy(), LEAST_POOL)
    model.shared = shared  # scoring needs no second copy on disk, only the curves
    free(examples, counted_examples)
    return model


def _state(model: Model) -> dict:
    return {k: v for k, v in model.__dict__.items() if k not in ("_search", "shared")}


def _restore(shared: dict[str, Broadcast]) -> Model:
    model = Model.__new__(Model)
    model.__dict__ |= shared["model"].value
    if "cols" in shared:
        model.words.hold(*(shared[c].value for c in POSTINGS))
    model._search = lru_cache(2_000)(model._search_one)
    return model


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``toxicity``: score, nearest examples, heaviest terms."""
    shared = model.shared or {"model": docs.sparkSession.sparkContext.broadcast(_state(model))}
    curves = model.curve, model.words.curve
    kept: dict[int, tuple[Model, Reader]] = {}

    @F.pandas_udf("score double, nearest array<struct<doc_id:bigint,cosine:double,label:int>>, terms array<string>")
    def toxicity(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            own = _restore(shared)
            own.curve, own.words.curve = curves
            kept[0] = own, Reader(own.terms, own.words.keys)
        own, reader = kept[0]
        rows = [r for c in reader.read(texts) for r in own.scores(c)]
        return pd.DataFrame({
            "score": [r[0] for r in rows],
            "nearest": [[{"doc_id": i, "cosine": c, "label": y} for i, c, y in r[1]] for r in rows],
            "terms": [r[2] for r in rows],
        })

    return docs.withColumn("toxicity", toxicity(F.col(text).cast("string")))


def op9_toxicity(docs: DataFrame, labels: DataFrame, held: Column | None = None) -> DataFrame:
    """Every document's calibrated score with its evidence."""
    model = learn_toxicity(docs, labels)
    rows = documents_of(docs)
    held = held_out(F.col("doc_id")) if held is None else held
    found = score_toxicity(rows, model)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("toxicity.score")))
    return found.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.nearest").alias("nearest"), F.col("toxicity.terms").alias("terms"))
