"""Preference formatting of chosen and rejected conversations.

A conversation is an array of turns (turn, role, text) in order. Of a pair, the longest common prefix of turns (equal
role and text) is rendered once as the prompt; what follows in each is its completion. A completion's mask lists the
character spans that are trained on, ``start:length`` each: the texts of assistant turns with their end marks.

Null roles count as ``user``, null texts as empty; turns with equal numbers are ordered by role and text, repeated ones stay.
Markers inside texts are broken up so that no text can end its own turn. A pair of equal conversations has two empty completions. Extra
columns are ignored. A conversation is one row here, as it is one training example: its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows (conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("user")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    shorter = F.least(F.size(a), F.size(b))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(places, lambda i: (F.get(a, i)["role"] == F.get(b, i)["role"]) & (F.get(a, i)["text"] == F.get(b, i)["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first.cast("int") - 1).otherwise(shorter)


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<|_im_"))


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"), _safe(t["text"]), F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column) -> Column:
    """Spans of assistant texts and their end marks in what ``render`` gives."""

    def step(acc: Column, t: Column) -> Column:
        head = F.lit(len(START) + 1) + F.length(t["role"])
        body = F.length(_safe(t["text"])) + len(END)
        own = F.array(F.concat((acc["at"] + head).cast("string"), F.lit(":"), body.cast("string")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(_rendered(t))).alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, none, step, lambda acc: acc["spans"]), ",")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with n_prefix, prompt, and completion and mask of both sides; the arrays of turns are dropped."""
    n = common_prefix(F.col(chosen), F.col(rejected))
    both = pairs.withColumn("n_prefix", n)

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_prefix") + 1, F.greatest(F.size(side), F.lit(1)))

    return both.select(
        *[c for c in pairs.columns if c not in (chosen, rejected)],
        "n_prefix",
        render(F.slice(F.col(chosen), 1, F.col("n_prefix"))).alias("prompt"),
        render(rest(chosen)).alias("chosen_text"), mask(rest(chosen)).alias("chosen_mask"),
        render(rest(rejected)).alias("rejected_text"), mask(rest(rejected)).alias("rejected_mask"),
    )


def degraded_pairs(conversations: DataFrame) -> DataFrame:
    """Each conversation up to its last assistant turn, against itself with that reply cut to the first half of its words."""
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    found = conversations.withColumn("last", F.array_max(places)).where("last is not null")
    reply = F.element_at("turns", F.col("last"))
    words = F.split(reply["text"], " ")
    half = F.when(F.size(words) > 1, F.array_join(F.slice(words, 1, F.ceil(F.size(words) / 2).cast("int")), " ")).otherwise(F.lit(""))
    cut_reply = F.array(F.struct(reply["turn"].alias("turn"), reply["role"].alias("role"), half.alias("text")))
    before = F.slice("turns", 1, F.col("last") - 1)
    return found.select(F.lit("degraded").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.slice("turns", 1, F.col("last")).alias("chosen"), F.concat(before, cut_reply).alias("rejected"))


def sibling_pairs(conversations: DataFrame) -> DataFrame:
    """Of conversations that begin with the same turn, the one with most assistant text against each other one.

    One row for each other conversation: a star, not all pairs of a group.
    """
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    first = F.element_at("turns", 1)
    keyed = conversations.select("conv_id", "turns", F.sha2(F.concat_ws("\x01", first["role"], first["text"]), 256).alias("opening"), size.alias("size"))
    best = keyed.groupBy("opening").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("size")).alias("s"), "conv_id")).alias("m")).where("n > 1")
    best = best.select("opening", F.col("m.conv_id").alias("chosen_id")).join(conversations.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    both = keyed.join(best, "opening").where("conv_id <> chosen_id")
    return both.select(F.lit("sibling").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))


def op2_preferences(turns: DataFrame) -> DataFrame:
    """Paired masked completions of every conversation that has a reply, and of all that share their first turn."""
    conversations = conversations_of(turns)
    return format_pairs(degraded_pairs(conversations).unionByName(sibling_pairs(conversations)))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t
), last AS (
  SELECT conv_id, max(i) AS m FROM o WHERE role = 'assistant' GROUP BY conv_id
), d AS (
  SELECT 'degraded' AS kind, o.conv_id AS chosen_id, o.conv_id AS rejected_id, o.i, o.role AS c_role, o.text AS c_text, o.role AS r_role,
    CASE WHEN o.i < l.m THEN o.text WHEN len(string_split(o.text, ' ')) > 1
      THEN array_to_string(list_slice(string_split(o.text, ' '), 1, CAST(ceil(len(string_split(o.text, ' ')) / 2.0) AS INTEGER)), ' ') ELSE '' END AS r_text
  FROM o JOIN last l ON o.conv_id = l.conv_id WHERE o.i <= l.m
), k AS (
  SELECT conv_id, max(CASE WHEN i = 1 THEN role || chr(1) || text END) AS opening, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS size
  FROM o GROUP BY conv_id
), b AS (
  SELECT *, row_number() OVER (PARTITION BY opening ORDER BY size DESC, conv_id) AS rn, first_value(conv_id) OVER (PARTITION BY opening ORDER BY size DESC, conv_id) AS best FROM k
), p AS (
  SELECT best AS chosen_id, conv_id AS rejected_id FROM b WHERE rn > 1
), s AS (
  SELECT 'sibling' AS kind, x.chosen_id, x.rejected_id, x.i, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
  FROM (SELECT DISTINCT p.chosen_id, p.rejected_id, o.i FROM p JOIN o ON o.conv_id IN (p.chosen_id, p.rejected_id)) x
  LEFT JOIN o c ON c.conv_id = x.chosen_id AND c.i = x.i LEFT JOIN o r ON r.conv_id = x.rejected_id AND r.i = x.i
), a AS (
  SELECT *, min(CASE WHEN c_role IS NULL OR r_role IS NULL OR c_role <> r_role OR c_text <> r_text THEN i END) OVER (PARTITION BY kind, chosen_id, rejected_id) AS cut,
    max(i) OVER (PARTITION BY kind, chosen_id, rejected_id) AS n,
    '<|im_start|>' || c_role || chr(10) || replace(c_text, '<|im_', '<|_im_') || '<|im_end|>' || chr(10) AS c,
    '<|im_start|>' || r_role || chr(10) || replace(r_text, '<|im_', '<|_im_') || '<|im_end|>' || chr(10) AS r
  FROM (SELECT * FROM d UNION ALL SELECT * FROM s)
), q AS (
  SELECT *, coalesce(cut, n + 1) AS f,
    coalesce(sum(CASE WHEN i >= coalesce(cut, n + 1) THEN length(c) END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_at,
    coalesce(sum(CASE WHEN i >= coalesce(cut, n + 1) THEN length(r) END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r_at
  FROM a WINDOW w AS (PARTITION BY kind, chosen_id, rejected_id ORDER BY i)
)
SELECT kind, chosen_id, rejected_id, CAST(max(f) - 1 AS INTEGER) AS n_prefix,
  coalesce(string_agg(CASE WHEN i < f THEN c END, '' ORDER BY i), '') AS prompt,
  coalesce(string_agg(CASE WHEN i >= f THEN c END, '' ORDER BY i), '') AS chosen_text,
  coalesce(string_agg(CASE WHEN i >= f AND c_role = 'assistant' THEN (c_at + 13 + length(c_role))::BIGINT || ':' || (length(replace(c_text, '<|im_', '<|_im_')) + 10) END, ',' ORDER BY i), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN i >= f THEN r END, '' ORDER BY i), '') AS rejected_text,
  coalesce(string_agg(CASE WHEN i >= f AND r_role = 'assistant' THEN (r_at + 13 + length(r_role))::BIGINT || ':' || (length(replace(r_text, '<|im_', '<|_im_')) + 10) END, ',' ORDER BY i), '') AS rejected_mask
FROM q GROUP BY kind, chosen_id, rejected_id
"""
