"""Removal of repeated and nearly repeated lines, by DataFrame functions only.

Lines are what ``\\n`` separates; blank ones (white space only) stay and link with nothing. Equal lines are one class.
A class's signature is the bottom of a MinHash order of its character shingles: the least hashes, under a bound that leaves about
``KEYS`` of them; lines that repeat a pattern are bounded by their different shingles, and have a key for the whole set as well. Lines whose signatures share a value with another line's are candidates: of two lines of similarity 0.8 at least 0.55 of the shingles
are common, so they miss each other with a probability of about e^-7.7 at most. Signatures of short lines are of shorter shingles (see ``CLASSES``; lines at
a border have both kinds), and lines of one repeated pattern of up to three characters have one for the pattern. Candidates meet in
bands of three MinHash values, so a passage that many lines share doesn't make pairs of all of them. They pass a test on bitmaps of their sets and are confirmed by the exact Jaccard similarity (0.8 or more) of their sets of five-character
shingles, a line shorter than that being one shingle. Of each component of links, the line that comes first (smallest
doc_id, then position) stays; all other occurrences of its lines go.

A null text stays null and has no lines; an empty one has one blank line. Texts of a repeated doc_id are told apart by their content; rows repeated whole are
each treated as first occurrences of the same place and both keep the line. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.binding import let
from tabulon.llm.bytesops import documents_of, with_part
from tabulon.llm.linking import linked_components, sharing
from tabulon.session import cut, free, setting

SHINGLE = 5
PERCENT = 80
KEYS = 14
#: (shingle size, characters of a line from, to). Similar lines differ in length by a fifth at most, so each pair has a class in common.
CLASSES = ((5, 0, 10), (8, 8, 64), (20, 48, None))
BITS = 1024
WORDS = PARTS = BITS // 64
#: (turns of the bands, different shingles of a line from, to), by estimates that are right within a tenth.
TURNS = ((16, 0, 34), (4, 22, 110), (1, 70, None))
SPACE = " \t\x0b\f\r"


def _long(line: Column) -> Column:
    """Whether words so long that they may repeat a pattern are a fifth of a line or more."""
    rest = F.length(F.regexp_replace(line, r"(?<!\S)\S{16,}", ""))
    return line.rlike(r"(?:^|\s)\S{16}") & (rest * 5 <= F.length(line) * 4)


def _distinct(wide: Column, size: int, width: int) -> Column:
    """The different hashes of an encoded line's shingles."""
    last = F.greatest((F.octet_length(wide) / width).cast("int") - size, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(wide, i * width + 1, F.lit(width * size)))))


def _number_of(wide: Column, size: int, width: int) -> Column:
    """How many different shingles an encoded line has; bound, as the loop would encode it for each place."""
    return let(wide, lambda w: F.size(_distinct(w, size, width)))


def with_numbers(lines: DataFrame) -> DataFrame:
    """``lines`` (cid, line and more) with the numbers of different shingles of those that may repeat a pattern, null for others: ``n5``, ``n8``
    and ``n20`` for signatures, by ``CLASSES``, and ``sampled`` for the levels of sketches, where a line is long and less than half of its words differ.

    These are the only loops over shingles that aren't compiled; all else takes them from here.
    """
    n, own = F.length("line"), []
    told = lines.select(*[F.col(c).alias(f"own_{c}") for c in lines.columns], "line", F.split("line", " ").alias("words"))
    told = told.select("*", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("differ"), _long(F.col("line")).alias("long"))
    fewer = F.expr("differ * 100 < n_words * 80")  # of shingles that mostly lie in one word
    # a shingle that always reaches into a second word is repeated only where a pair is, and a pair only where both words are; ordinary text
    # repeats many words, but few pairs. Each word takes the next one along, so that no loop is needed
    pairs = F.split(F.regexp_replace("line", r"([^ ]+) (?=([^ ]+))", "$1\u0001$2 "), " ")
    passages = F.when(F.expr("n_words > 2 and differ * 5 < n_words * 4 + 5"), F.size(F.array_distinct(pairs)) * 5 < F.col("n_words") * 4).otherwise(False)
    for size, low, high in CLASSES:
        here = (n >= low) if high is None else n.between(low, high)
        repeats = F.col("long") | (passages if size >= 16 else fewer)
        own.append(F.when(here, F.when(repeats, _number_of(F.encode("line", "UTF-16BE"), size, 2))).alias(f"n{size}"))
    sampled = F.when(n >= 2 * BITS, F.when(F.col("long") | F.expr("differ * 100 < n_words * 50"), _number_of(F.encode("line", "UTF-32"), SHINGLE, 4)))
    return told.select(*[F.col(f"own_{c}").alias(c) for c in lines.columns], *own, sampled.alias("sampled"))


def _shingled(lines: DataFrame, size: int, code: str = "UTF-32", n: str | None = None) -> DataFrame:
    """(cid, n, h): a row for each place where a shingle of a line (cid, line) begins; n is the number in this column or, where that is null, how many
    places the line has, at least one.

    In ``code`` every character has the same number of bytes, so each shingle is found at once. The encoded line is made where its places are:
    read from a row it would be copied for each of them.
    """
    width = 4 if code == "UTF-32" else 2
    wide = lines.select("cid", F.encode("line", code).alias("wide"), (F.col(n) if n else F.lit(None).cast("int")).alias("n"))
    wide = wide.withColumn("places", F.greatest((F.octet_length("wide") / width).cast("int") - size + 1, F.lit(1)))
    places = wide.select("cid", F.coalesce("n", "places").alias("n"), "wide", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("i"))
    return places.select("cid", "n", F.xxhash64(F.lit(size), F.substring("wide", F.col("i") * width + 1, F.lit(width * size))).alias("h"))


def signatures(classes: DataFrame) -> DataFrame:
    """(id, bucket): the values of each class (cid, line)'s signature; a value may repeat, as a shingle may."""
    if "n5" not in classes.columns:
        classes = cut(with_numbers(classes))
    n, kinds = F.length("line"), []
    for size, low, high in CLASSES:
        here = (n >= low) if high is None else n.between(low, high)
        kinds.append(F.when(here, F.struct(F.lit(size).alias("size"), F.col(f"n{size}").alias("n"))))
    wide = classes.select("cid", F.encode("line", "UTF-16BE").alias("wide"), F.explode(F.array(*kinds)).alias("kind")).where("kind is not null")
    wide = wide.select("cid", "wide", "kind.size", "kind.n", F.greatest((F.octet_length("wide") / 2).cast("int") - F.col("kind.size") + 1, F.lit(1)).alias("places"))
    bound = F.lit(2.0**64 * KEYS) / F.coalesce("n", "places") - F.lit(2.0**63)  # signed hashes
    places = wide.select("cid", "wide", "size", bound.alias("bound"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("i"))
    least = places.select(F.col("cid").alias("id"), "bound", F.xxhash64("size", F.substring("wide", F.col("i") * 2 + 1, F.col("size") * 2)).alias("bucket"))
    same = [F.substr(F.col("line"), F.lit(p + 1)) == F.substr(F.col("line"), F.lit(1), F.length("line") - p) for p in (1, 2, 3)]
    turns = [F.when(n >= p + SHINGLE - 1, F.xxhash64(F.lit(-1), F.substring("line", p, SHINGLE))) for p in (1, 2, 3)]
    pattern = F.when(n >= SHINGLE, F.when(reduce(Column.__or__, same), F.least(*turns)))
    whole = F.when(F.coalesce("n5", "n8", "n20").isNotNull(), F.xxhash64(F.lit(-2), let(F.encode("line", "UTF-16BE"), lambda wide: F.array_sort(_distinct(wide, SHINGLE, 2)))))
    more = classes.select(F.col("cid").alias("id"), F.explode(F.array(pattern, whole)).alias("bucket")).where("bucket is not null")
    return least.where(F.col("bucket").cast("double") < F.col("bound")).select("id", "bucket").unionByName(more)


def _folded(lines: DataFrame, turns: int) -> DataFrame:
    """(cid, level, part, key, full, half): of each line (cid, line, sampled) ``PARTS`` rows at most. Shingles are dealt to parts by their hashes,
    with several ``turns`` by independent hashes of their own to the parts of each turn.

    A ``key`` stands for three minima, of the thirds into which hashes deal a part's shingles. It is a band of three MinHash values of one permutation; where a
    third is empty, that counts as its value. ``full`` and ``half`` are 64 bits of what a part has at the line's level and at the next one.
    """
    wide = lines.select("cid", F.encode("line", "UTF-32").alias("wide"), F.col("sampled"))
    wide = wide.withColumn("places", F.greatest((F.octet_length("wide") / 4).cast("int") - SHINGLE + 1, F.lit(1)))
    level = F.floor(F.log2(F.greatest(F.coalesce("sampled", "places") / BITS, F.lit(1.0)))).cast("int")
    rows = wide.select("cid", level.alias("level"), "wide", F.explode(F.sequence(F.lit(0), F.col("places") * turns - 1)).alias("i"))
    shift, cells = turns.bit_length() - 1, PARTS // turns
    h = F.xxhash64(F.lit(SHINGLE), F.substring("wide", F.shiftright("i", shift) * 4 + 1, F.lit(4 * SHINGLE)))
    rows = rows.select("cid", "level", h.alias("h"), F.col("i").bitwiseAND(turns - 1).alias("turn"))
    rows = rows.select("cid", "level", "h", "turn", (F.col("h") if turns == 1 else F.xxhash64("h", "turn")).alias("k"))
    part = F.col("turn") * cells + F.shiftrightunsigned("k", 32).bitwiseAND(cells - 1).cast("int")
    third, bit = F.shiftrightunsigned("k", 40).bitwiseAND(0xFFFF) % 3, F.expr("shiftleft(1L, cast(shiftrightunsigned(k, 58) as int))")
    rows = rows.select("cid", "level", part.alias("part"), "h", "k", third.alias("third"), bit.alias("bit"))
    kept = [F.bit_or(F.when(F.expr(f"h & (shiftleft({n}L, level) - 1) = 0"), F.col("bit"))).alias(name) for n, name in ((1, "full"), (2, "half"))] if turns == 1 else []
    found = rows.groupBy("cid", "level", "part").agg(*[F.min(F.when(F.col("third") == t, F.col("k"))).alias(f"m{t}") for t in range(3)], *kept)
    return found.select("cid", "level", "part", F.xxhash64(F.lit(turns), "part", "m0", "m1", "m2").alias("key"), *["full", "half"][: len(kept)])


def _by_part(of: str, name: str, parts: int = PARTS) -> list[Column]:
    """A column for each part, or for each pair of parts that fold into one."""
    return [F.bit_or(F.when(F.col("part") % parts == k, F.col(of))).alias(f"{name}{k}") for k in range(parts)]


def sketches(lines: DataFrame) -> DataFrame:
    """(id, sketch, keys) of lines (cid, line): a bitmap of the shingles, the level at which they are sampled by their hashes, and a shorter bitmap of the next level;
    and the bands of all shingles, null where a part is empty.

    Lines of up to 2047 shingle places are at level 0, which takes all; each level halves what the one before takes.
    """
    if "sampled" not in lines.columns:
        lines = cut(with_numbers(lines))
    rows = _folded(lines.repartition("cid"), 1)  # all that follows stays in these tasks
    found = rows.groupBy("cid", "level").agg(*_by_part("full", "w"), *_by_part("half", "v", WORDS // 2), *_by_part("key", "k"))
    found = found.fillna(0, [f"w{k}" for k in range(WORDS)] + [f"v{k}" for k in range(WORDS // 2)])
    full, half = [F.col(f"w{k}") for k in range(WORDS)], [F.col(f"v{k}") for k in range(WORDS // 2)]
    folded = [full[k].bitwiseOR(full[k + WORDS // 2]) for k in range(WORDS // 2)]
    estimates = [(_number(full) * F.pow(F.lit(2.0), F.col("level"))).alias("n"), _number(full).alias("nw"), _number(folded).alias("nf"), _number(half).alias("nv")]
    return found.select(F.col("cid").alias("id"), F.struct("level", *estimates, *full, *half).alias("sketch"), F.array(*[f"k{k}" for k in range(PARTS)]).alias("keys"))


def bands(lines: DataFrame, own: DataFrame) -> DataFrame:
    """(id, keys): the ``PARTS`` bands of each line (cid, line and its numbers), of which ``own`` is the written table of sketches.

    Lines of few different shingles have bands that are made in several turns, as they are little selective otherwise; those at a border have two rows, one of each kind.
    """
    n, parts = F.col("sketch.n") * BITS, []
    for turns, low, high in TURNS:
        here = own.where((n >= low) if high is None else (n >= low) & (n < high))
        if turns == 1:
            parts.append(here.select("id", "keys"))
        else:
            # a longer line has so few only if its words or passages repeat
            short = lines.where(f"length(line) < {2 * high} or coalesce(n5, n8, n20, sampled) is not null").join(here.select(F.col("id").alias("cid")), "cid", "left_semi")
            found = _folded(short.repartition("cid"), turns).groupBy("cid").agg(*_by_part("key", "k"))
            parts.append(found.select(F.col("cid").alias("id"), F.array(*[f"k{k}" for k in range(PARTS)]).alias("keys")))
    return reduce(DataFrame.unionByName, parts)


def banded(members: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, bucket): ``members`` (id, bucket) that share a value of their signatures and a band as well, so a passage that many lines have in common doesn't bring all of them together.

    Each value takes a quarter of the bands. A pair of similarity 0.8 has about eight values in common and half of the bands: together it misses each other with
    a probability of some 2e-4.
    """
    quarter = PARTS // 4
    own = F.slice("keys", (F.col("bucket").bitwiseAND(3) * quarter + 1).cast("int"), quarter)
    split = members.join(keys, "id").select("id", "bucket", F.explode(own).alias("key")).where("key is not null")
    return split.select("id", F.xxhash64("bucket", "key").alias("bucket"))


def _number(words: list[Column]) -> Column:
    """How many shingles set these bits, estimated from the share that is set."""
    return -F.ln(1 - reduce(Column.__add__, [F.bit_count(w) for w in words]) / (64 * len(words) + 1))


def likely(a: str, b: str) -> Column:
    """Whether two sketches allow a link.

    The estimated numbers of shingles must agree but for a factor of 0.6. From these and that of both lines together follows the
    estimated similarity, with a standard error of 0.014 to 0.024 at 0.8 (more where more bits are set); it must be at least 0.8 less 0.06 to
    0.1. Lines of neighbouring levels are compared at the higher one by bitmaps of half the bits, with twice that slack.
    """

    def similar(x: list[Column], y: list[Column], nx: Column, ny: Column, slack: float) -> Column:
        filled = reduce(Column.__add__, [F.bit_count(p.bitwiseOR(q)) for p, q in zip(x, y, strict=True)]) / (64 * len(x) + 1)
        return nx + ny >= -F.ln(1 - filled) * (1 + PERCENT / 100 - slack * (0.06 + 0.05 * filled * filled))

    one, two = ([F.col(f"{x}.w{k}") for k in range(WORDS)] for x in (a, b))
    half = WORDS // 2
    folded_one, folded_two = ([w[k].bitwiseOR(w[k + half]) for k in range(half)] for w in (one, two))
    next_one, next_two = ([F.col(f"{x}.v{k}") for k in range(half)] for x in (a, b))
    la, lb, na, nb = (F.col(f"{x}.{c}") for c in ("level", "n") for x in (a, b))
    same = (
        F.when(la == lb, similar(one, two, F.col(f"{a}.nw"), F.col(f"{b}.nw"), 1.0))
        .when(la + 1 == lb, similar(next_one, folded_two, F.col(f"{a}.nv"), F.col(f"{b}.nf"), 2.0))
        .when(lb + 1 == la, similar(folded_one, next_two, F.col(f"{a}.nf"), F.col(f"{b}.nv"), 2.0))
        .otherwise(True)
    )
    return (na >= nb * 0.6) & (nb >= na * 0.6) & same


def _set(line: Column) -> Column:
    """The distinct shingles' hashes."""

    def shingles(wide: Column) -> Column:
        last = F.greatest(F.octet_length(wide) / 4 - SHINGLE, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(wide, i * 4 + 1, F.lit(4 * SHINGLE))))

    return F.array_distinct(let(F.encode(line, "UTF-32"), shingles))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, part, pos, line, k1, k2) of every line that isn't blank; the two hashes stand for the line."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "part", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    return lines.where(F.btrim("line", F.lit(SPACE)) != "").select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def line_groups(docs: DataFrame) -> DataFrame:
    """(k1, k2, grp): the component of every line that has an equal or a similar one; a written table."""
    # Java never compiles a method of more than 8000 bytes, so Spark is to split those that compare sketches
    with setting(docs.sparkSession, spark__sql__codegen__hugeMethodLimit="8000"):
        return _line_groups(docs)


def _line_groups(docs: DataFrame) -> DataFrame:
    classes = split_lines(docs).groupBy("k1", "k2").agg(F.first("line").alias("line"), F.count("*").alias("n"))
    classes = cut(with_numbers(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "n", "line")))
    members = cut(sharing(signatures(classes.select("cid", "line", "n5", "n8", "n20"))).select("id", "bucket"))
    ids = members.select(F.col("id").alias("cid")).distinct()
    texts = cut(classes.select("cid", "line", "n5", "n8", "n20", "sampled").join(ids, "cid", "left_semi"))
    own = cut(sketches(texts))
    met: list[DataFrame] = []

    def of(ids: DataFrame) -> DataFrame:
        met.append(cut(texts.select("cid", "line").join(ids.withColumnRenamed("id", "cid"), "cid", "left_semi")))
        return own.select("id", "sketch").join(ids, "id", "left_semi")

    def verify(pairs: DataFrame) -> DataFrame:
        # lines travel as text, an eighth of their sets
        lines = [met[0].select(F.col("cid").alias(c), F.col("line").alias(f"l{c}")) for c in "ab"]
        sets = F.struct(_set(F.col("la")).alias("la"), _set(F.col("lb")).alias("lb"))

        def similar(x: Column) -> Column:
            return let(F.size(F.array_intersect(x["la"], x["lb"])), lambda n: n * 100 >= (F.size(x["la"]) + F.size(x["lb"]) - n) * PERCENT)

        return pairs.join(lines[0], "a").join(lines[1], "b").where(let(sets, similar)).select("a", "b")

    components = linked_components(banded(members, bands(texts, own)), of, likely, verify)
    free(members, texts, own, *met)
    found = classes.select("cid", "k1", "k2", "n").join(components.select(F.col("id").alias("cid"), "component"), "cid", "left")
    out = cut(found.where("n > 1 or component is not null").select("k1", "k2", F.coalesce("component", "cid").alias("grp")))
    free(classes, components)
    return out


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, part, pos) of every occurrence that goes."""
    places = split_lines(docs).select("doc_id", "part", "pos", "k1", "k2")
    groups = line_groups(docs)
    grouped = cut(places.join(groups, ["k1", "k2"]).select("doc_id", "part", "pos", "grp"))
    free(groups)
    first_doc = grouped.groupBy("grp").agg(F.min(F.struct("doc_id", "part")).alias("first_doc"))
    with_first = grouped.join(first_doc, "grp").withColumn("own", F.struct("doc_id", "part"))
    first = with_first.where("own = first_doc").groupBy("grp").agg(F.min("pos").alias("first_pos"))
    return with_first.join(first, "grp").where("own <> first_doc or pos <> first_pos").select("doc_id", "part", "pos")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and the array ``removed_lines`` of their positions."""
    told = with_part(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("doc")))  # no name can clash
    gone = cut(repeated_lines(told.select("doc_id", "part", "text")).groupBy("doc_id", "part").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    both = told.select("doc_id", "part", "doc").join(gone, ["doc_id", "part"], "left")
    text = F.col("doc.text").cast("string")

    def rest(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
        return F.array_join(F.transform(places, lambda p: F.get(lines, p)), "\n")

    kept = F.when(F.col("gone").isNull(), text).otherwise(let(F.split(text, "\n"), rest))
    own = [kept.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns if c != "removed_lines"]
    return both.select(*own, F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"))


def op10_lines(docs: DataFrame) -> DataFrame:
    """Per document: how many lines it has, which ones go, and the digest of what stays."""
    text = F.col("text").cast("string")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    found = dedup_lines(documents_of(docs).withColumn("n_lines", n_lines))
    n_removed = F.size("removed_lines").cast("long")
    return found.select("doc_id", "n_lines", n_removed.alias("n_removed"), "removed_lines", F.sha2("text", 256).alias("kept_sha256"))
