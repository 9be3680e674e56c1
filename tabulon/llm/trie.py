"""The trie of conversations' turns: nodes are the distinct sequences of first turns (role and text).

A prefix is a digest of 128 bits, chained over its turns' digests; texts are hashed as they are read and not shuffled. A count-min
sketch of all prefixes screens them: where one of its counters is one, the prefix is of one conversation only, and so is all that is longer. Such tails
are emitted from the conversation's own row. Only prefixes that may be shared are shuffled and grouped, exactly.

Sums over subtrees need no descent by levels. A node belongs to its smallest conversation; a conversation owns the end of its path. What a
conversation owns below each of its shared prefixes is summed along its row, and these sums are added up by prefix.

The sketch has four rows of at most ``CELLS`` counters that stop at two; as a bitmap of those at two it goes to the driver and to all
tasks, 8 MB at the most. Beyond some ten million prefixes it clears fewer of them, and more are grouped. Parents are looked up by broadcast for at most
``HOT`` prefixes, those of most conversations, otherwise by a join. Digests of members are made of sorted chunks, and the last step streams over these.

Null roles and texts are empty; turns of one number, nulls first, follow each other by the digest of role and text, repeated ones
stay. A conversation without turns is at the root. A conversation's digests are one row, as a conversation is one example. Rows without conv_id and
extra columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut, free

ROWS, CELLS, BLOCK = 4, 1 << 24, 1 << 16
HOT = 4096
CHUNK = 4096
BYTES = 16
NOTHING = hashlib.sha256(b"").hexdigest()
PATH = "conv_id: long, prefixes: array<binary>, chars: array<long>"

Batches = Iterable[pa.RecordBatch]


def turns_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digest and number of characters."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def chained(paths: DataFrame) -> DataFrame:
    """(conv_id, prefixes, chars) of (conv_id, turns); the first prefix is the root's, which is empty."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes, chars = [], []
            for turns in b.column(1).to_pylist():
                own = [b""]
                for t in turns:
                    own.append(hashlib.sha256(own[-1] + t["digest"]).digest()[:BYTES])
                prefixes.append(own)
                chars.append([0, *(t["chars"] for t in turns)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prefixes, pa.list_(pa.binary())), pa.array(chars, pa.list_(pa.int64()))], ["conv_id", "prefixes", "chars"])

    return paths.select("conv_id", "turns").mapInArrow(run, PATH)


def _cells(prefixes: list[bytes], cells: int) -> np.ndarray:
    """A place in each row of the sketch, one row of the array for each of its own."""
    one, two = np.frombuffer(b"".join(prefixes), "<u8").reshape(-1, 2).T
    row = np.arange(ROWS, dtype=np.uint64)[:, None]
    return ((one + row * (two | np.uint64(1))) % np.uint64(cells) + row * np.uint64(cells)).astype(np.int64)


def sketch(paths: DataFrame, cells: int) -> np.ndarray:
    """Bits of the counters that are at two, of the prefixes of all paths but the root."""

    def count(batches: Batches) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ROWS * cells, np.uint8)
        for b in batches:
            flat = [p for own in b.column(0).to_pylist() for p in own[1:]]
            if flat:
                at, n = np.unique(_cells(flat, cells), return_counts=True)
                table[at] = np.minimum(table[at] + np.minimum(n, 2), 2)
        blocks = table.reshape(-1, BLOCK)
        for k in np.nonzero(blocks.any(axis=1))[0]:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1)])], ["block", "counts"])

    def merge(batches: Batches) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()])], ["block", "counts"])

        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
                if k != now:
                    if now is not None:
                        yield full()
                    now, total = k, own
                else:
                    total = np.minimum(total + own, 2)
        if now is not None:
            yield full()

    columns = "block: int, counts: binary"
    merged = paths.select("prefixes").mapInArrow(count, columns).repartition("block").sortWithinPartitions("block").mapInArrow(merge, columns)
    bits = np.zeros((ROWS * cells // BLOCK, BLOCK // 8), np.uint8)
    for r in merged.collect():  # 8 kB each, 1024 of them at most
        bits[r.block] = np.frombuffer(r.counts, np.uint8)
    return bits.ravel()


def screened(paths: DataFrame) -> DataFrame:
    """``paths`` with the number of their first prefixes, besides the root, that may be of several conversations."""
    turns = paths.agg(F.sum(F.size("prefixes")).alias("n")).first().n or 1
    cells = min(CELLS, max(BLOCK, 1 << (4 * turns - 1).bit_length()))
    shared = paths.sparkSession.sparkContext.broadcast(sketch(paths, cells))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            lists = b.column(1).to_pylist()
            flat = [p for own in lists for p in own[1:]]
            several = np.ones(0, bool)
            if flat:
                at = _cells(flat, cells)
                several = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
            found, begin = [], 0
            for own in lists:
                mine = several[begin:begin + len(own) - 1]
                begin += len(mine)
                found.append(len(mine) if mine.all() else int(np.argmin(mine)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], ["conv_id", "prefixes", "chars", "shared"])

    return paths.select("conv_id", "prefixes", "chars").mapInArrow(run, f"{PATH}, shared: int")


def _owned_sums(rows: DataFrame) -> DataFrame:
    """(prefix, saved, leaves) of each shared prefix of (prefixes, shared, leaf, owned): what the conversation owns from there on."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [])
            for prefixes, shared, leaf, owned in zip(*(c.to_pylist() for c in b.columns), strict=True):
                below = np.zeros(shared + 1, np.int64)
                for x in owned or ():
                    below[x["depth"]] = x["saved"]
                out[0].extend(prefixes[:shared + 1])
                out[1].append(np.cumsum(below[::-1])[::-1])
                out[2].append(np.full(shared + 1, leaf))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *(pa.array(np.concatenate(x)) for x in out[1:])], ["prefix", "saved", "leaves"])

    return rows.select("prefixes", "shared", "leaf", "owned").mapInArrow(run, "prefix: binary, saved: long, leaves: long")


def _digests_of_members(ends: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of (prefix, conv_id): the digest of the sorted ids, joined by commas."""
    chunks = ends.groupBy("prefix", F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["prefix", "ends_sha256"])

        for b in batches:
            for prefix, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if prefix != now:
                    if now is not None:
                        yield full()
                    now, state = prefix, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now is not None:
            yield full()

    return chunks.repartition("prefix").sortWithinPartitions("prefix", "chunk").select("prefix", "ids").mapInArrow(run, "prefix: binary, ends_sha256: string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row for each node of (conv_id, turns): conv_id (the smallest one), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256, the digest of the conversations that end there. The node's text is the turn number ``depth`` of conv_id."""
    chains = cut(chained(paths))
    convs = cut(screened(chains).withColumn("turns", F.size("prefixes") - 1))
    free(chains)
    tailed = convs.where("turns > shared")
    last = F.get("prefixes", F.col("shared"))

    every = convs.select("conv_id", "prefixes", "chars", F.explode(F.sequence(F.lit(0), "shared")).alias("depth"))
    every = every.select("conv_id", "depth", F.get("prefixes", F.col("depth")).alias("prefix"), F.get("prefixes", F.col("depth") - 1).alias("parent"), F.get("chars", F.col("depth")).alias("chars"))
    nodes = every.groupBy("prefix").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = cut(nodes)
    children = nodes.where("depth > 0").select(F.col("parent").alias("prefix")).unionByName(tailed.select(last.alias("prefix")))
    children = children.groupBy("prefix").agg(F.count("*").alias("n_children"))
    nodes2 = cut(nodes.join(children, "prefix", "left").fillna(0, ["n_children"]))
    free(nodes)

    own = F.struct("depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), "n_children")
    owned = nodes2.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max(own).alias("deepest"), F.collect_list(own).alias("owned"))
    both = convs.join(owned, "conv_id", "left")
    ends_here = (F.col("deepest.depth") == F.col("turns")) & (F.col("deepest.n_children") == 0)
    both = both.withColumn("leaf", ((F.col("turns") > F.col("shared")) | F.coalesce(ends_here, F.lit(False))).cast("long"))
    both = cut(both.withColumn("first", F.coalesce("first", F.when(F.col("turns") > F.col("shared"), F.col("shared") + 1))).drop("deepest"))
    sums = _owned_sums(both.where("leaf > 0 or owned is not null")).groupBy("prefix").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    tops = both.where("first > 0").select("conv_id", "first", F.get("prefixes", F.col("first") - 1).alias("prefix"))
    rows = nodes2.agg(F.sum("n_convs").alias("n")).first().n or 0
    hot = F.col("n_convs") * HOT > rows  # fewer than HOT nodes, as all have ``rows`` members together
    owner = nodes2.select("prefix", F.col("conv_id").alias("parent_conv_id"), hot.alias("hot"))
    near = tops.join(F.broadcast(owner.where("hot").drop("hot")), "prefix", "left")
    far = near.where("parent_conv_id is null").drop("parent_conv_id").join(owner.where("not hot").drop("hot"), "prefix")
    parents = cut(near.where("parent_conv_id is not null").unionByName(far).select("conv_id", "first", "parent_conv_id"))

    ends = _digests_of_members(convs.where("turns = shared").select(last.alias("prefix"), "conv_id"))
    above = F.when(F.col("depth") == F.col("first"), F.col("parent_conv_id")).when(F.col("depth") > 0, F.col("conv_id"))
    grouped = nodes2.join(sums, "prefix", "left").join(ends, "prefix", "left").join(parents, "conv_id", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), above.alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    tails = both.where("turns > shared").join(parents.drop("first"), "conv_id", "left").withColumn("depth", F.explode(F.sequence(F.col("shared") + 1, F.col("turns"))))
    at_end = F.col("depth") == F.col("turns")
    alone = tails.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("first"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (~at_end).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(at_end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    return grouped.unionByName(alone)


def rebuilt(paths: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations (conv_id, turns) that begin like the first one of their hundred: the first h turns of conversation
    c - c % group, then their own after the first h, where h is crc32 of c modulo ``most``."""
    heads = paths.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left").withColumn("h", h)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op12_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return prefix_trie(rebuilt(turns_of(turns)))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS i FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.i < c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i >= c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING) AS key
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
), m AS (
  SELECT conv_id, depth, chars, key FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (
  SELECT key, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM m GROUP BY key
), e AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(key, depth) AS key FROM m GROUP BY conv_id) GROUP BY key
), k AS (
  SELECT left(key, (depth - 1) * 32) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT left(n.key, d.d * 32) AS key, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (WHERE k.key IS NULL) AS leaves
  FROM n LEFT JOIN k ON k.key = n.key, LATERAL (SELECT unnest(range(n.depth + 1)) AS d) d GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n LEFT JOIN n p ON n.depth > 0 AND p.key = left(n.key, (n.depth - 1) * 32) LEFT JOIN k ON k.key = n.key JOIN below b ON b.key = n.key LEFT JOIN e ON e.key = n.key
"""
