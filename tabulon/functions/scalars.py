"""Scalar functions as column expressions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabulon.functions.binding import let
from tabulon.functions.folding import without_marks

CLF = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?$'
MAX_LINE = 8192


CLF_FIELDS = "\x1f".join(f"${k}" for k in range(1, 10))


def parse_clf(line: Column) -> Column:
    """A combined-log-format line as a struct; null if it doesn't match or its time doesn't parse. Size '-' is 0.

    The pattern runs once a line: it rewrites a line that matches to a marked list of its fields.
    """

    def dash(c: Column) -> Column:
        return F.when((c != "-") & (c != ""), c)

    def record(parts: Column) -> Column:
        part = [F.get(parts, F.lit(k)) for k in range(9)]
        time = F.try_to_timestamp(part[3], F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
        fields = F.struct(
            part[0].alias("client_ip"), dash(part[1]).alias("remote_logname"), dash(part[2]).alias("user"), time.alias("timestamp"), part[4].alias("request_line"),
            part[5].cast("int").alias("status_code"), F.when(part[6] == "-", 0).otherwise(part[6].try_cast("long")).cast("long").alias("response_size"),
            dash(part[7]).alias("referer"), dash(part[8]).alias("user_agent"),
        )
        return F.when((F.size(parts) == 9) & time.isNotNull(), fields)

    usable = (F.length(line) <= MAX_LINE) & ~F.contains(line, F.lit("\x1e")) & ~F.contains(line, F.lit("\x1f"))
    marked = F.when(usable, F.regexp_replace(line, CLF, "\x1e" + CLF_FIELDS))
    return let(F.when(F.startswith(marked, F.lit("\x1e")), F.split(F.substring(marked, 2, MAX_LINE), "\x1f")), record)


def http_method(request: Column) -> Column:
    return F.coalesce(F.nullif(F.get(F.split(F.trim(request), " "), F.lit(0)), F.lit("")), F.lit("UNKNOWN"))


def endpoint(request: Column) -> Column:
    """The path without its query string."""
    path = F.get(F.split(F.trim(request), " "), F.lit(1))
    return F.coalesce(F.nullif(F.get(F.split(path, r"\?"), F.lit(0)), F.lit("")), F.lit("/"))


def status_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def is_error(code: Column) -> Column:
    return code.between(400, 599)


def is_server_error(code: Column) -> Column:
    return code.between(500, 599)


def strip_control(s: Column) -> Column:
    return F.regexp_replace(s, r"[\x00-\x1F]", "")


def parse_iso(s: Column) -> Column:
    return F.try_to_timestamp(s)


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_millis(n: Column) -> Column:
    return F.timestamp_millis(n)


def week_start(d: Column) -> Column:
    return F.to_date(F.date_trunc("week", d))


def to_seconds(s: Column) -> Column:
    """H:M:S or M:S (whole parts count), a day fraction below 1, or whole seconds, as seconds; anything else is null."""
    text = F.trim(s)

    def of(parts: Column) -> Column:
        number = F.get(parts, F.lit(0)).try_cast("double")
        whole = F.transform(parts, lambda p: p.try_cast("double").try_cast("long"))
        clock = F.aggregate(whole, F.lit(0).cast("long"), lambda acc, x: acc * 60 + x).cast("double")
        plain = F.when(F.isnan(number), None).when((number >= 0) & (number < 1), F.bround(number * 86400)).when((number >= 0) & (number == F.floor(number)), number)
        return F.when(F.size(parts).between(2, 3), clock).when(F.size(parts) == 1, plain)

    return let(F.split(text, ":"), of)


def to_hms(seconds: Column) -> Column:
    whole = F.round(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(seconds.isNotNull(), F.concat(hours.cast("string"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"), F.lpad(rest.cast("string"), 2, "0")))


def normalize_name(s: Column) -> Column:
    """Lower case, without marks, anything else but letters and digits of ASCII a single space."""
    return F.trim(F.regexp_replace(without_marks(F.lower(s)), "[^a-z0-9]+", " "))


def nfkd(s: Column) -> Column:
    """Lower case without any combining marks, for all scripts."""
    return without_marks(F.lower(s))


def canonical_gtin(s: Column) -> Column:
    """Digits padded to 14 if there are 8, 12, 13 or 14 of them, else null."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14), F.lpad(digits, 14, "0"))


def tokens(s: Column) -> Column:
    return F.filter(F.split(normalize_name(s), " "), lambda t: t != "")


def model_tokens(s: Column) -> Column:
    """Tokens of letters and digits together, of at most 20 characters."""
    return F.filter(tokens(s), lambda t: t.rlike("[a-z]") & t.rlike("[0-9]") & (F.length(t) <= 20))


def stable_uid(key: Column) -> Column:
    return F.substring(F.sha1(key.cast("binary")), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; two empty ones have 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def edit_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


class Automaton:
    """The suffix automaton of a text: its states are sets of substrings that end at the same places.

    Walking another text along it gives, at each place, the longest substring that ends there and is in this text.
    """

    def __init__(self, text: list[str | None]) -> None:
        self.next: list[dict[str | None, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for k, c in enumerate(text):
            new = self._state({}, self.length[last] + 1, k + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] > self.length[p] + 1:  # only the shorter substrings of q end here as well
                    twin = self._state(dict(self.next[q]), self.length[p] + 1, self.end[q])
                    self.link[twin] = self.link[q]
                    self.link[q] = twin
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    q = twin
                self.link[new] = q
            last = new

    def _state(self, following: dict[str | None, int], length: int, end: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, text: str, begin: int, stop: int) -> tuple[int, int, int]:
        """(place in ``text`` within begin and stop, place here, length) of the longest common substring; of equals the first in ``text``, then the first here."""
        state = n = 0
        best = (begin, 0, 0)
        for i in range(begin, stop):
            c = text[i]
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                n += 1
                if n > best[2]:
                    best = (i - n + 1, self.end[state] - n, n)
        return best


def _rare(text: str) -> list[str | None]:
    """The characters of a text; in one of 200 or more those that make up over a hundredth of it are no part of any block's core."""
    if len(text) < 200:
        return list(text)
    often = {c for c, n in Counter(text).items() if n > len(text) // 100 + 1}
    return [None if c in often else c for c in text]


def matched(a: str, b: str, core: list[str | None], whole: Automaton) -> int:
    """Characters in matching blocks of a and b: the longest common block, grown by what is equal beside it, then the same to its left and right.

    ``core`` is ``_rare(b)`` and ``whole`` its automaton, which serves all texts that b is compared with.
    """
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        automaton = whole if b1 - b0 == len(b) else Automaton(core[b0:b1])
        i, j, n = automaton.longest(a, a0, a1)
        j += b0
        if n:
            left = 0
            while i - left > a0 and j - left > b0 and a[i - left - 1] == b[j - left - 1]:
                left += 1
            i, j, n = i - left, j - left, n + left
        while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return total


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters (Ratcliff and Obershelp); 0 if either is null, 1 if both are empty.

    Each distinct text of ``b`` in a batch gets one automaton, each distinct pair one ratio.
    """
    pairs = pd.DataFrame({"a": a, "b": b})
    found: dict[tuple[str, str], float] = {}
    for right, lefts in pairs.dropna().drop_duplicates().groupby("b", sort=False)["a"]:
        core = _rare(right)
        whole = Automaton(core)
        for left in lefts:
            size = len(left) + len(right)
            found[left, right] = 2 * matched(left, right, core, whole) / size if size else 1.0
    return pd.Series([found.get(pair, 0.0) for pair in zip(a, b, strict=True)], dtype=float)


def dup_key(*columns: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


# Limits and texts of the price recommendations.
INELASTIC, ELASTIC, LEAST_UPLIFT = -0.8, -1.2, 0.05
ADVICE = ("Keep price; insufficient data", "Candidate +2–5% price (inelastic)", "Reduce discounts; focus on value", "Monitor price; A/B small steps")


def recommend(e: Column, uplift: Column) -> Column:
    """A price recommendation from elasticity and promotion uplift; an unknown uplift isn't a low one."""
    low = F.coalesce(uplift < LEAST_UPLIFT, F.lit(False))
    return F.when(e.isNull(), ADVICE[0]).when(e > INELASTIC, ADVICE[1]).when((e < ELASTIC) & low, ADVICE[2]).otherwise(ADVICE[3])


APP_LOG = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - ([A-Z]+) - (.*)$"


def parse_app_log(line: Column) -> Column:
    """A struct (ts, level, message) of ``time,millis - LEVEL - message``, null if it doesn't match."""
    time = F.try_to_timestamp(F.regexp_extract(line, APP_LOG, 1), F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
    fields = F.struct(time.alias("ts"), F.regexp_extract(line, APP_LOG, 2).alias("level"), F.regexp_extract(line, APP_LOG, 3).alias("message"))
    return F.when(line.rlike(APP_LOG) & time.isNotNull(), fields)
