"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut, free


def _to_roots(forest: DataFrame) -> DataFrame:
    """Pointer jumping: each vertex ``u`` of a written forest ``(u, p)`` with ``p < u`` gets its tree's root as ``p``."""
    before = None
    while True:
        above = forest.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = cut(forest.join(above, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        free(before)
        before, forest = jumped, jumped.select("u", "p")
        if jumped.where("moved").isEmpty():
            forest.written_to = jumped.written_to
            return forest


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): for every vertex of ``edges``, the smallest vertex that it is connected with.

    Each round hooks every vertex to its smallest neighbour if that is smaller, contracts the trees to their roots and
    keeps the distinct edges between roots, so the edges shrink from round to round. No round holds a group in one
    task: hooking is a minimum with partial sums, jumps are joins that adaptive execution can split. Edges with a null
    end are ignored; loops and repeated edges don't matter; no edges give an empty result. The result is a written
    table; those of the rounds are deleted.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = ends.where("a = b").select(F.col("a").alias("id"))
    work = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    forest, trees = None, []
    while not work.isEmpty():
        hooked = cut(work.groupBy("u").agg(F.min("v").alias("p")))
        roots = _to_roots(hooked)
        trees.append(roots)
        forest = roots if forest is None else forest.unionByName(roots)
        one = roots.select(F.col("u"), F.col("p").alias("ru"))
        two = roots.select(F.col("u").alias("v"), F.col("p").alias("rv"))
        moved = work.join(one, "u").join(two, "v", "left").select("ru", F.coalesce("rv", "v").alias("rv")).where("ru <> rv")
        before, work = work, cut(moved.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct())
        free(before, hooked)
    free(work)
    if forest is None:
        return cut(loops.distinct().select("id", F.col("id").alias("component")))
    found = _to_roots(forest)
    members = found.select(F.col("u").alias("id"), F.col("p").alias("component"))
    own = found.select(F.col("p").alias("id"), F.col("p").alias("component")).union(loops.select("id", F.col("id").alias("component")))
    rest = own.distinct().join(members, "id", "left_anti")
    out = cut(members.unionByName(rest))
    free(found, *trees)
    return out
