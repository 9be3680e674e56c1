"""SpotSigs: documents as sets of chains of content words that follow common words, by DataFrame functions only.

Words are runs of letters, marks and digits in lower case. Common words (anchors) are the ``ANCHORS`` words that most documents
contain. Each occurrence of an anchor gives a signature: the anchor and the next ``CHAIN`` words that aren't anchors. A
fingerprint is the set of the first eight digits of these signatures' MD5, sorted and joined; its likeness to another is their
Jaccard similarity. A text without any signature has one, of its words (of itself, if it has none); an empty or null one has none. Two
sets of none have likeness 1.

``similar_documents`` links documents of likeness 0.8 or more. Equal sets are one class. Sets are partitioned by length, in steps of
the threshold, so that similar ones are in one partition or neighbours; there they meet in the signatures that pruning leaves: of a set in
order of rarity, two similar ones share one of the first n - ceil(0.8 n) + 1.

Repeated rows are documents of their own: those of one doc_id follow each other by text. Rows without doc_id and extra columns are ignored.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.binding import let
from tabulon.llm.bytesops import documents_of
from tabulon.llm.linking import linked_components
from tabulon.session import cut, free

ANCHORS = 500
CHAIN = 2
PERCENT = 80
RANGES, ROWS = 200, 512
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
CONTENT = "\x02"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def common_words(docs: DataFrame, most: int = ANCHORS) -> list[str]:
    """The words of most documents (doc_id, text), the smaller ones of equals."""
    seen = docs.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r.word for r in seen.orderBy(F.desc("n"), "word").limit(most).collect()]


def _digest(text: Column) -> Column:
    return F.left(F.md5(text.cast("binary")), F.lit(8))


def signatures(text: Column, anchors: list[str]) -> Column:
    """The sorted distinct digests of a text's signatures.

    The words are written as pieces that begin with a content word and go on with the anchors behind it, so the chain of an anchor
    begins the pieces that follow its own.
    """
    none = F.array().cast("array<string>")

    def spots(pieces: Column) -> Column:
        def of(piece: Column, i: Column) -> Column:
            chain = [F.substring_index(F.get(pieces, i + k), " ", 1) for k in range(1, CHAIN + 1)]
            own = F.split(piece, " ")
            found = F.transform(F.slice(own, 2, F.size(own)), lambda a: _digest(F.concat_ws(" ", a, *chain)))
            return F.when(piece.contains(" ") & (i < F.size(pieces) - CHAIN), found).otherwise(none)

        return F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, of))))

    def marked(words: Column) -> Column:
        one = F.array_join(F.transform(words, lambda w: F.concat(F.when(w.isin(anchors), " ").otherwise(CONTENT), w)), "")
        whole = F.when(text == "", none).otherwise(F.array(_digest(F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(text))))
        return let(let(F.split(one, CONTENT), spots), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))

    return let(words_of(text), marked)


def fingerprint(found: Column) -> Column:
    """Signatures as text."""
    return F.array_join(found, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n)))


def _buckets(docs: DataFrame) -> tuple[Column, int]:
    """A bucket of about ``ROWS`` rows for each doc_id, in the ids' order, and how many buckets a range has.

    Approximate quantiles part the ids into at most ``RANGES`` ranges, and each range is parted evenly.
    """
    n = docs.count()
    ranges = max(1, min(RANGES, ceil(n / ROWS)))
    share = F.percentile_approx("doc_id", F.lit([k / ranges for k in range(ranges + 1)]), 10_000)
    cuts = sorted(set(docs.agg(share.alias("cuts")).first().cuts or [0]))
    parts = max(1, ceil(n / ranges / ROWS))
    edges = F.lit([float(c) for c in cuts])
    at = F.col("doc_id").cast("double")
    number = F.greatest(F.least(F.size(F.filter(edges, lambda c: c <= at)), F.lit(len(cuts) - 1)), F.lit(1))

    def inside(number: Column) -> Column:
        low, high = F.get(edges, number - 1), F.get(edges, number)
        share = F.least(F.greatest((at - low) / F.greatest(high - low, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
        return number.cast("long") * parts + F.least(F.floor(share * parts), F.lit(parts - 1))

    return let(number, inside), parts


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Documents (doc_id, text) in buckets (bucket, copy), and the window in which each is followed by the next one by descending doc_id.

    The first row of each bucket also ends the bucket before it, as a copy; that of the first one ends the last. So texts are shuffled once,
    and no task holds more than a few buckets.
    """
    bucket, parts = _buckets(docs)
    dealt = docs.withColumn("bucket", bucket)
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).withColumn("number", F.floor(F.col("bucket") / parts))
    firsts = heads.groupBy("number").agg(F.min("bucket").alias("low"))  # at most RANGES rows
    firsts = firsts.withColumn("above", F.coalesce(F.lead("low").over(Window.orderBy("number")), F.first("low").over(Window.orderBy("number"))))
    within = F.lead("bucket").over(Window.partitionBy("number").orderBy("bucket"))
    heads = heads.join(F.broadcast(firsts.select("number", "above")), "number").select("doc_id", F.coalesce(within, "above").alias("bucket"))
    copies = docs.join(heads, "doc_id")
    rows = dealt.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    return rows, Window.partitionBy("bucket").orderBy("copy", F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """(doc_id, signatures) of documents."""
    rows = documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    anchors = common_words(rows) if anchors is None else anchors
    return rows.select("doc_id", signatures(F.col("text"), anchors).alias("signatures"))


def similar_documents(docs: DataFrame, percent: int = PERCENT, anchors: list[str] | None = None) -> DataFrame:
    """(doc_id, class_id, component_id): documents of equal class_id have equal signatures; those of equal component_id are linked by
    likeness of ``percent`` or more. Both are null without signatures."""
    found = cut(fingerprints(docs, anchors))
    sets = found.where(F.size("signatures") > 0).groupBy("signatures").agg(F.min("doc_id").alias("first"))
    classes = cut(sets.select(F.monotonically_increasing_id().alias("id"), "signatures", F.size("signatures").alias("n")))
    every = classes.select("id", "n", F.explode("signatures").alias("s"))
    ranked = every.join(every.groupBy("s").agg(F.count("*").alias("seen")), "s").where("seen > 1")
    least = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    missing = F.col("n") - F.size("common")  # signatures of one set alone come first and find nothing
    kept = ranked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "s"))).alias("common"))
    part = F.floor(F.ln("n") / log(100 / percent))
    buckets = cut(
        kept.where(missing < least)
        .select("id", F.explode(F.array(part, part + 1)).alias("part"), F.explode(F.slice("common", F.lit(1), (least - missing).cast("int"))).alias("common"))
        .select("id", F.xxhash64("part", "common.s").alias("bucket"))
    )
    sized = classes.select("id", F.struct("n").alias("sketch"))

    def likely(a: str, b: str) -> Column:
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("id").alias(c), F.col("signatures").alias(f"s{c}")) for c in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(a, "a").join(b, "b").where(let(common, lambda n: n * 100 >= (F.size("sa") + F.size("sb") - n) * percent)).select("a", "b")

    def finer(ids: DataFrame) -> DataFrame:
        """Each signature of the pruned ones that is left after one: two similar sets that share a bucket may share no other, so all stay together."""
        return ids.select("id", F.lit(0).alias("key"))

    components = linked_components(buckets, lambda ids: sized.join(ids, "id", "left_semi"), likely, verify, finer)
    named = classes.join(components, "id", "left").select("signatures", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    out = cut(found.join(named, "signatures", "left").select("doc_id", "class_id", "component_id"))
    free(found, classes, buckets, components)
    return out


def op13_spotsigs(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its text with the last half replaced by the next document's beginning, and its likeness to
    this and to the next document."""
    rows = documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    anchors = common_words(rows)
    dealt, following = with_next(rows)
    half = F.floor(F.length("text") / 2).cast("int")
    both = dealt.withColumn("next_text", F.lead("text").over(following)).withColumn("signatures", signatures(F.col("text"), anchors))
    both = both.withColumn("next_signatures", F.lead("signatures").over(following)).where("not copy")
    both = both.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    both = both.withColumn("edited_signatures", signatures(F.col("edited"), anchors))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL
), anchor AS (
  SELECT word FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'))) AS word FROM texts) WHERE word <> '' GROUP BY word ORDER BY count(*) DESC, word LIMIT 500
), paired AS (
  SELECT row_number() OVER w AS r, doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC, text)) AS next_text FROM texts WINDOW w AS (ORDER BY doc_id DESC, text)
), edited AS (
  SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM paired
), kinds AS (
  SELECT r, 0 AS kind, text FROM edited UNION ALL SELECT r, 1, edited FROM edited
), split AS (
  SELECT r, kind, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS words FROM kinds
), placed AS (
  SELECT r, kind, unnest(words) AS word, unnest(range(len(words))) AS i FROM split
), marked AS (
  SELECT p.*, a.word IS NOT NULL AS is_anchor, CAST(sum(CASE WHEN a.word IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k FROM placed p LEFT JOIN anchor a ON a.word = p.word
), content AS (
  SELECT r, kind, k, word, lead(word) OVER (PARTITION BY r, kind ORDER BY k) AS following FROM marked WHERE NOT is_anchor
), spot AS (
  SELECT DISTINCT m.r, m.kind, left(md5(m.word || ' ' || c.word || ' ' || c.following), 8) AS s
  FROM marked m JOIN content c ON c.r = m.r AND c.kind = m.kind AND c.k = m.k + 1 WHERE m.is_anchor AND c.following IS NOT NULL
), found AS (
  SELECT r, kind, list_sort(list(s)) AS s FROM spot GROUP BY r, kind
), sets AS (
  SELECT x.r, x.kind, CASE WHEN f.s IS NOT NULL THEN f.s WHEN x.text = '' THEN CAST([] AS VARCHAR[])
    ELSE [left(md5(CASE WHEN len(words) > 0 THEN array_to_string(words, ' ') ELSE x.text END), 8)] END AS s
  FROM split x LEFT JOIN found f ON f.r = x.r AND f.kind = x.kind
), common AS (
  SELECT a.r, b.kind, count(*) AS n FROM (SELECT r, unnest(s) AS s FROM sets WHERE kind = 0) a
  JOIN (SELECT r, 1 AS kind, unnest(s) AS s FROM sets WHERE kind = 1 UNION ALL SELECT CASE WHEN r = 1 THEN (SELECT max(r) FROM edited) ELSE r - 1 END, 0, unnest(s) FROM sets WHERE kind = 0) b
  ON b.r = a.r AND b.s = a.s GROUP BY a.r, b.kind
), three AS (
  SELECT e.doc_id, e.text, e.edited, a.s AS s, b.s AS es, len(a.s) AS n, len(b.s) AS en, len(c.s) AS nn, coalesce(x.n, 0) AS e_both, coalesce(y.n, 0) AS n_both
  FROM edited e JOIN sets a ON a.r = e.r AND a.kind = 0 JOIN sets b ON b.r = e.r AND b.kind = 1
    JOIN sets c ON c.kind = 0 AND c.r = CASE WHEN e.r = (SELECT max(r) FROM edited) THEN 1 ELSE e.r + 1 END
    LEFT JOIN common x ON x.r = e.r AND x.kind = 1 LEFT JOIN common y ON y.r = e.r AND y.kind = 0
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(es, '') AS edited_fingerprint,
  CASE WHEN n + en = 0 THEN 1.0::DOUBLE ELSE e_both::DOUBLE / (n + en - e_both) END AS near_edited, CASE WHEN n + nn = 0 THEN 1.0::DOUBLE ELSE n_both::DOUBLE / (n + nn - n_both) END AS near_next
FROM three
"""
