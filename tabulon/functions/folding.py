"""Unicode folding in the JVM, by tables made from the Unicode decompositions.

A character that folds to one or none goes through ``translate``; one that folds to several is looked up by one regular
expression in a dictionary behind the text. Texts without such characters take neither way.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = range(0xAC00, 0xD7A4)  # syllables stay whole: their parts follow from arithmetic, not from a table
END = "\x1e"


@cache
def decompositions() -> tuple[str, str, dict[str, str]]:
    """(characters, what each becomes, the further ones that vanish at the end), and those that become several; of NFKD without combining marks."""
    one: dict[str, str] = {}
    gone, several = [], {}
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        if point in HANGUL or not (unicodedata.decomposition(c) or unicodedata.combining(c)):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not plain:
            gone.append(c)
        elif len(plain) > 1:
            several[c] = plain
        elif plain != c:
            one[c] = plain
    return "".join(one) + "".join(gone), "".join(one.values()), several


def _class(characters: str) -> str:
    """A character class of code points, as ranges."""
    out, points = "", sorted(map(ord, characters))
    at = 0
    while at < len(points):
        to = at
        while to + 1 < len(points) and points[to + 1] == points[to] + 1:
            to += 1
        out += rf"\x{{{points[at]:x}}}-\x{{{points[to]:x}}}"
        at = to + 1
    return f"[{out}]"


@cache
def _patterns() -> tuple[str, str]:
    """The class of what folds to several characters, and the dictionary of it."""
    several = decompositions()[2]
    return _class("".join(several)), "".join(f"{END}{c}{plain}" for c, plain in several.items()) + END


def without_marks(s: Column) -> Column:
    """Compatibility characters in their plain form, without combining marks, in all scripts (Hangul syllables stay)."""
    characters, plain, _ = decompositions()
    many, dictionary = _patterns()
    clean = F.translate(s, END, " ")
    looked_up = F.regexp_replace(F.concat(clean, F.lit(dictionary)), rf"(?s)({many})(?=[^{END}]*{END}(?:.*{END})?\1([^{END}]*){END})", "$2")
    spread = F.when(s.rlike(many), F.regexp_extract(looked_up, f"(?s)^([^{END}]*)", 1)).otherwise(s)
    return F.when(s.rlike(r"[^\x00-\x7f]"), F.translate(spread, characters, plain)).otherwise(s)


def title_case(s: Column) -> Column:
    """Lower case, with a capital at the beginning of each run of cased letters."""
    parts = F.regexp_extract_all(s, F.lit(r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]+|[^\p{IsLowercase}\p{IsUppercase}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")
