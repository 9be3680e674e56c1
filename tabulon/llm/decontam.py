"""Benchmark decontamination by template windows, by DataFrame functions only.

A text becomes its words and numbers in lower case. Numbers (digits or number words, compound ones as one), units that follow
a number, currency signs before one and names become the typed placeholders ``<num>``, ``<unit>`` and ``<name>``. Names are
capitalised words that follow a lower-case word, and in a second form also other capitalised words that are such names elsewhere in
the text; in a third form names stay words, so that copies in other case match. A window matches in any form. Windows of six canonical tokens (all of them for an item with fewer) are hash-joined between documents and
benchmark items; windows of placeholders only are compared where others have aligned both, so an item that has nothing else is never found. Matches of one alignment (document position less item position) are checked for slot consistency: each
value of a slot in the item must stand for one value in the document, as in a question asked again with other
numbers; alignments that fail are dropped. A document is contaminated by an item if what is left covers at least half
of the item's windows.

Null and empty texts match nothing, on either side. Repeated items are reported under each of their ids; repeated rows
of a document give one result. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.bytesops import documents_of
from tabulon.session import cut

WINDOW = 6
COVERAGE = 0.5
BROADCAST_ROWS = 1_000_000  # windows of the benchmark, about 40 bytes each; a larger benchmark is joined by a shuffle

# Units of measure and money, and the English number words.
UNITS = (
    "mm", "cm", "dm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg", "t", "gram", "grams",
    "kilogram", "kilograms", "ton", "tons", "tonne", "tonnes", "oz", "lb", "lbs", "pound", "pounds", "ml", "cl", "l", "liter", "liters", "litre",
    "litres", "gallon", "gallons", "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "kmh", "mph", "hz", "khz", "mhz", "ghz", "w", "kw", "kwh", "v", "kb", "mb", "gb", "tb", "percent",
    "%", "$", "€", "£", "¥", "°", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "gbp",
)
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
    "thousand", "million", "billion",
)
PLACEHOLDERS = ("<num>", "<unit>", "<name>")
NAME = "\x01"
NAME_START = r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;][ \t])"  # what is rare is looked for first
CAPITAL = "\x02"
CAPITAL_START = r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}\x01'’-])"
SIGNS = ("$", "€", "£", "¥")
_NUMBER = "(?:" + "|".join(NUMBER_WORDS) + ")"
COMPOUND = rf"(?=[{''.join(sorted({w[0] for w in NUMBER_WORDS}))}])\b(?:({_NUMBER})[ \t-]|(hundred|thousand|million)[ \t]and[ \t])(?={_NUMBER}\b)"
TOKEN = r"[\x01\x02]?[a-z\p{L}\p{M}]+(?:['’-][a-z\p{L}\p{M}]+)*|\p{N}+(?:[.,:/]\p{N}+)*|[%$€£¥°]"


def tokens(text: Column) -> Column:
    """Words, numbers and unit signs in lower case; names carry a mark, other capitalised words another one."""
    clean = F.translate(text.cast("string"), NAME + CAPITAL, "  ")
    marked = F.lower(F.regexp_replace(F.regexp_replace(clean, NAME_START, NAME), CAPITAL_START, CAPITAL))
    return F.regexp_extract_all(F.regexp_replace(marked, COMPOUND, "$1$2-"), F.lit(TOKEN), F.lit(0))


def plain(token: Column) -> Column:
    return F.when(token < "\x03", F.substring(token, 2, 1 << 30)).otherwise(token)


def _is_number(token: Column) -> Column:
    """Of a token without marks; compound number words start with one and a hyphen."""
    return ((token >= "0") & (token < ":")) | token.isin(*NUMBER_WORDS) | token.contains("-") & token.rlike(rf"^{_NUMBER}(?:-{_NUMBER})*$")


def canonical(words: Column) -> Column:
    """Unmarked tokens with typed placeholders for numbers and units."""

    def one(t: Column, i: Column) -> Column:
        unit = t.isin(*UNITS) & (i > 0) & _is_number(F.get(words, i - 1)) | t.isin(*SIGNS) & F.coalesce(_is_number(F.get(words, i + 1)), F.lit(False))
        return F.when(_is_number(t), "<num>").when(unit, "<unit>").otherwise(t)

    return F.transform(words, one)


def _with_forms(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows`` (keep, marked) with words, form (all that may be a name is one), strict (only sure names are) and literal (none is).

    Texts without a sure name have one form only, which isn't made again.
    """
    words = F.transform("marked", plain)
    sure = F.transform(F.filter("marked", lambda t: t.startswith(NAME)), plain)
    maybe = F.transform(F.filter("marked", lambda t: t.startswith(CAPITAL)), plain)
    named = F.size("sure") > 0
    rows = rows.select(*keep, "marked", words.alias("words"), sure.alias("sure"))
    rows = rows.select(*keep, "marked", "words", named.alias("named"), F.when(named, F.array_intersect("sure", maybe)).alias("also"), canonical(F.col("words")).alias("literal"))
    strict = F.transform("literal", lambda t, i: F.when(F.get("marked", i).startswith(NAME), "<name>").otherwise(t))
    rows = rows.select(*keep, "marked", "words", "named", "also", "literal", F.when(F.col("named"), strict).otherwise(F.col("literal")).alias("strict"))
    form = F.transform("strict", lambda t, i: F.when(F.get("marked", i).startswith(CAPITAL) & F.array_contains("also", F.get("words", i)), "<name>").otherwise(t))
    return rows.select(*keep, "named", "words", "literal", "strict", F.when(F.size("also") > 0, form).otherwise(F.col("strict")).alias("form"))


def _hashed(forms: DataFrame, *keep: str) -> DataFrame:
    """The forms as hashes of their tokens; without a sure name, ``form`` and ``strict`` are null, as they equal ``literal``."""

    def hashes(c: str) -> Column:
        return F.transform(c, lambda t: F.xxhash64(t))

    return forms.select(*keep, "named", hashes("literal").alias("literal"), *[F.when(F.col("named"), hashes(c)).alias(c) for c in ("form", "strict")])


def _windows(size: int) -> Column:
    """(pos, hs) of the windows of the hashed forms; hs has each form's hash once."""
    n = F.size("literal") - size
    places = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))

    def windows(*forms: str) -> Column:
        def window(i: Column) -> Column:
            hs = F.array(*[F.xxhash64(F.slice(c, i + 1, size)) for c in forms])
            return F.struct(i.alias("pos"), (F.array_distinct(hs) if len(forms) > 1 else hs).alias("hs"))

        return F.transform(places, window)

    return F.when(F.col("named"), windows("form", "strict", "literal")).otherwise(windows("literal"))


def _seeds(items: DataFrame) -> DataFrame:
    """(item_id, size, ipos, hs): each window of an item, and the hashes of those of its forms that have a literal token.

    A window of placeholders only would meet every list of numbers; it has no hash and is checked where other windows have aligned a text with the item.
    """

    def of(i: Column) -> Column:
        def seed(c: str) -> Column:
            window = F.slice(c, i + 1, F.col("size"))
            literal = F.exists(window, lambda t: ~t.isin(*PLACEHOLDERS))
            return F.when(literal, F.xxhash64(F.transform(window, lambda t: F.xxhash64(t))))

        return F.struct(i.cast("int").alias("ipos"), F.array_distinct(F.array_compact(F.array(*[seed(c) for c in ("form", "strict", "literal")]))).alias("hs"))

    places = F.sequence(F.lit(0), F.size("literal") - F.col("size"))
    return items.select("item_id", "size", F.explode(F.transform(places, of)).alias("w")).select("item_id", "size", "w.*")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, n_slots, n_changed) of every contaminated pair.

    ``n_changed`` counts slot values that differ from the item's: 0 for a literal copy.
    """
    texts = documents_of(docs).where("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("marked")).where(F.size("marked") > 0)
    items = cut(_with_forms(items.dropDuplicates(["item_id", "marked"]), "item_id"))
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())  # WINDOW values at most
    items = items.withColumn("size", F.least(F.size("literal"), F.lit(WINDOW)))
    seeds = _seeds(items)
    asked = cut(seeds.select("item_id", "size", "ipos", F.explode("hs").alias("h")))
    counts = seeds.groupBy("item_id").agg(F.count_distinct("ipos").alias("n_windows"), F.collect_set(F.when(F.size("hs") == 0, F.col("ipos"))).alias("blanks"))
    counts = cut(counts)

    found = _hashed(_with_forms(texts.select("doc_id", tokens(F.col("text")).alias("marked")), "doc_id"), "doc_id")
    parts = [found.select("doc_id", F.lit(k).alias("size"), F.explode(_windows(k)).alias("w")) for k in sizes]
    if not parts:
        parts = [found.select("doc_id", F.lit(0).alias("size"), F.explode(_windows(WINDOW)).alias("w")).where("false")]
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    windows = windows.select("doc_id", "size", F.col("w.pos").alias("wpos"), F.explode("w.hs").alias("h"))
    small = asked.count() <= BROADCAST_ROWS
    matches = windows.join(F.broadcast(asked) if small else asked, ["size", "h"])
    aligned = matches.groupBy("doc_id", "item_id", "size", (F.col("wpos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("iposes"))
    most = aligned.groupBy("doc_id", "item_id").agg(F.sum(F.size("iposes")).alias("most"), F.count("*").alias("shifts")).join(counts.select("item_id", "n_windows", F.size("blanks").alias("n_blank")), "item_id")
    enough = most.where(F.col("most") + F.col("n_blank") * F.col("shifts") >= F.col("n_windows") * coverage)
    aligned = cut(aligned.join(enough.select("doc_id", "item_id"), ["doc_id", "item_id"]))

    # slot values of both sides, for what is left
    wanted = aligned.select("doc_id").distinct()
    theirs = _with_forms(texts.join(wanted, "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("marked")), "doc_id")
    theirs = theirs.select("doc_id", F.col("words").alias("doc_words"), F.col("form").alias("doc_form")).dropDuplicates(["doc_id", "doc_words"])
    both = aligned.drop("size").join(items.select("item_id", "size", "words", "form"), "item_id").join(counts, "item_id").join(theirs, "doc_id")

    def fits(i: Column) -> Column:
        return F.when(i + F.col("shift") >= 0, F.slice("form", i + 1, F.col("size")) == F.slice("doc_form", i + F.col("shift") + 1, F.col("size"))).otherwise(False)

    both = both.withColumn("iposes", F.array_union("iposes", F.filter("blanks", fits)))
    place = F.array_distinct(F.flatten(F.transform("iposes", lambda i: F.sequence(i, i + F.col("size") - 1))))
    slots = F.filter(place, lambda p: F.get("form", p).isin(*PLACEHOLDERS))
    values = F.array_distinct(F.transform(slots, lambda p: F.struct(F.get("words", p).alias("item"), F.get("doc_words", p + F.col("shift")).alias("doc"))))
    checked = both.select("doc_id", "item_id", "n_windows", "iposes", values.alias("v"))
    consistent = F.size(F.array_distinct(F.transform("v", lambda x: x["item"]))) == F.size("v")
    changed = F.size(F.filter("v", lambda x: ~x["item"].eqNullSafe(x["doc"])))
    kept = checked.where(consistent).select("doc_id", "item_id", "n_windows", "iposes", F.size("v").alias("slots"), changed.alias("changed"))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("iposes"))))
    out = kept.groupBy("doc_id", "item_id", "n_windows").agg(covered.cast("long").alias("n_matched"), F.max("slots").cast("long").alias("n_slots"), F.min("changed").cast("long").alias("n_changed"))
    out = out.select("doc_id", "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), "n_slots", "n_changed")
    return out.where(F.col("coverage") >= coverage)


def op4_decontam(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document that holds at least half of a benchmark item, literally or with other values."""
    return contaminated_pairs(docs, benchmark)
