"""From buckets of similar items to components of verified links, without all pairs of a bucket, by DataFrame functions.

Every item is compared with its buckets' leaders (their smallest items) first, and components of what links there are
contracted. In buckets that still hold several components the items outside the largest one are then compared with all of other components, so a group
of linked items costs its size times the number of those in its buckets that aren't linked with it. Where finer keys are given, which similar items still share,
these items are first compared with one of the largest component, and a bucket of more than ``CROWD`` rows is split by the keys. Pairs pass a test on two sketches before they are verified, and none is verified twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.graph import connected_components
from tabulon.session import cut, free

CROWD = 64
CELL = 1000

Step = Callable[[DataFrame], DataFrame]


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def sharing(buckets: DataFrame) -> DataFrame:
    """(bucket, id, leader, n): the different rows of ``buckets`` (id, bucket) of values that several items have, with the smallest item and how many rows there are.

    ``buckets`` is shuffled once and read twice from there.
    """
    dealt = buckets.repartition("bucket")
    shared = dealt.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n")).where("leader <> last").drop("last")
    return dealt.join(shared.hint("shuffle_hash"), "bucket").select("bucket", "id", "leader", "n").distinct()


def _with_main(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, id, component) of the buckets that hold several components, with the largest one (``main``), an item of it and how many rows are in it and outside."""
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.max("id").alias("member"))
    tops = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component", "member")).alias("top")).where("parts > 1")
    named = tops.select("bucket", F.col("top.component").alias("main"), F.col("top.member").alias("member"), "n", (F.col("n") - F.col("top.n")).alias("outside"))
    return rows.join(named, "bucket")


def _across(rows: DataFrame, own: DataFrame, likely: Callable[[str, str], Column]) -> DataFrame:
    """Likely pairs (a, b) of items of one bucket and different components.

    The rows outside a bucket's largest component meet all its rows. Both are dealt into cells of about ``CELL`` rows, and each two cells meet on
    their own, so that no task has a whole bucket.
    """
    mixed = _with_main(rows).withColumn("rest", F.ceil(F.col("outside") / CELL)).withColumn("cells", F.ceil(F.col("n") / CELL)).join(own, "id")

    def side(x: str, kept: DataFrame, own_cell: str, other_cell: str, own_cells: str, other_cells: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_cells) - 1)).alias(other_cell)
        mine = F.expr(f"pmod(xxhash64(id), {own_cells})").alias(own_cell)
        return kept.select("bucket", mine, every, F.col("id").alias(x), F.col("component").alias(f"c{x}"), F.col("main").alias(f"m{x}"), F.col("sketch").alias(f"s{x}"))

    one = side("a", mixed.where("component <> main"), "i", "j", "rest", "cells")
    two = side("b", mixed, "j", "i", "cells", "rest")
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("mb")) | (F.col("a") < F.col("b")))
    met = one.join(two, ["bucket", "i", "j"]).where(once & likely("sa", "sb"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked_components(buckets: DataFrame, sketches: Step, likely: Callable[[str, str], Column], verify: Step, finer: Step | None = None) -> DataFrame:
    """(id, component) of all items of ``buckets`` (id, bucket) that have a link.

    ``sketches`` gives (id, sketch) of the items (id) that share a bucket, ``likely`` says whether two sketch columns
    allow a link, ``verify`` keeps the links of pairs (a, b), ``finer`` gives (id, key) to split crowded buckets by; buckets of several independent values need none. Rows may repeat.
    """
    shared = cut(sharing(buckets))
    star = cut(_pairs(shared.where("id <> leader"), "id", "leader"))
    members = shared.where("n > 2").select("bucket", "id")
    own = cut(sketches(star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))).distinct()))
    tried: list[DataFrame] = []

    def confirmed(pairs: DataFrame, tested: bool = False) -> DataFrame:
        if not tested:
            one, two = own.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), own.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
            pairs = pairs.join(one, "a").join(two, "b").where(likely("sa", "sb")).select("a", "b")
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        tried.append(cut(pairs))
        return cut(verify(tried[-1]))

    links = confirmed(star)
    components = connected_components(links, "a", "b")
    free(star)

    def grown(links: DataFrame, components: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        if new.isEmpty():
            return links, components
        more = links.unionByName(new)
        found = connected_components(more, "a", "b")
        free(components)
        return more, found

    def held(rows: DataFrame) -> DataFrame:
        return rows.select("bucket", "id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))

    if finer is not None:
        mixed = _with_main(held(members))
        links, components = grown(links, components, confirmed(_pairs(mixed.where("component <> main"), "id", "member")))

    rows = cut(held(members))
    free(shared)
    if finer is None:
        dense = cut(_across(rows, own, likely).distinct())
        links, components = grown(links, components, confirmed(dense, True))
        free(rows, dense, own, *tried)
        return components
    several = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    kinds = cut(several.select("bucket", (F.col("n") > CROWD).alias("crowded")))
    rest = cut(_across(rows.join(kinds.where("not crowded").select("bucket"), "bucket"), own, likely).distinct())
    links, components = grown(links, components, confirmed(rest, True))
    if not kinds.where("crowded").isEmpty():
        crowded = cut(held(rows.join(kinds.where("crowded").select("bucket"), "bucket")))
        keys = finer(crowded.select("id").distinct())
        split = cut(crowded.join(keys, "id").select(F.xxhash64("bucket", "key").alias("bucket"), "id", "component"))
        dense = cut(_across(split, own, likely).distinct())
        links, components = grown(links, components, confirmed(dense, True))
        free(crowded, split, dense)
    free(rows, kinds, rest, own, *tried)
    return components
