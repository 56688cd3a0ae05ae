"""Preference formatting: one prompt, and a masked completion for either answer.

Two conversations, the chosen and the rejected one, share a prefix of equal turns (role and
text, null equal to null). It is rendered once as the prompt; the turns after it are rendered as
two completions. A completion's mask lists the character ranges a loss may use, end excluded:
the texts of its assistant turns and the closing sign behind each. Built-in functions only.

Rendering: ``<|role|>`` newline, text, ``<|end|>`` newline. Where a role or text holds ``<|`` itself,
with backslashes between or not, it gets one backslash more there, so no turn can look like the end of
another, and what was written can be read back. Turns are ordered by turn number,
null first, ties by role and text, so equal rows keep the result stable. An example is one
output row, so a conversation is gathered in one row by nature; nothing else is.

Defined cases: null roles and texts render as empty. A conversation given on one side only is
compared with none: the prompt is empty. Rows with a null pair id are left out. Equal
conversations make everything prompt, both completions are empty and ``differs`` is false.
Turns that repeat are kept. Other input columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<turn:bigint,role:string,text:string>>"


def gather(turns: DataFrame, id_col: str, name: str) -> DataFrame:
    """(pair_id, name): the ordered turns of each conversation."""
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")
    )
    return (
        turns.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("pair_id"))
        .agg(F.array_sort(F.collect_list(turn)).alias(name))
    )


def _plain(value: Column) -> Column:
    """A role or text as it is rendered."""
    text = F.coalesce(value, F.lit(""))
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _plain(turn["role"]), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_ranges(turns: Column) -> Column:
    """``begin-end`` of every assistant text in the rendering, in order, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("ranges"))

    def add(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.char_length(_head(turn))
        end = begin + F.char_length(_body(turn)) - 1  # without the last newline
        own = F.array(F.concat(begin.cast("string"), F.lit("-"), end.cast("string")))
        return F.struct(
            (end + 1).alias("at"),
            F.when(turn["role"] == "assistant", F.concat(done["ranges"], own))
            .otherwise(done["ranges"])
            .alias("ranges"),
        )

    return F.aggregate(turns, start, add, lambda done: F.array_join(done["ranges"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """Number of equal turns both lists begin with."""
    shorter = F.least(F.size(a), F.size(b))

    def differs(i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        same = x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])
        return ~same

    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.coalesce(F.get(F.filter(places, differs), F.lit(0)), shorter)


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen, rejected (ordered turns). One row per pair."""
    empty = F.array().cast(TURN)
    sides = pairs.select(
        "pair_id",
        F.coalesce("chosen", empty).alias("good"),
        F.coalesce("rejected", empty).alias("bad"),
    ).withColumn("n", common_turns(F.col("good"), F.col("bad")))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n") + 1, F.size(side))

    return sides.select(
        "pair_id",
        F.col("n").cast("bigint").alias("prompt_turns"),
        render(F.slice("good", F.lit(1), F.col("n"))).alias("prompt"),
        render(rest("good")).alias("chosen"),
        loss_ranges(rest("good")).alias("chosen_loss"),
        render(rest("bad")).alias("rejected"),
        loss_ranges(rest("bad")).alias("rejected_loss"),
        ((F.size("good") > F.col("n")) | (F.size("bad") > F.col("n"))).alias("differs"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Two tables of turns (id, turn, role, text) whose conversations are paired by id."""
    both = gather(chosen, id_col, "chosen").join(gather(rejected, id_col, "rejected"), "pair_id", "full")
    return format_pairs(both)


def stale_answer_pairs(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Every conversation against a worse one made from it.

    The rejected conversation repeats the first assistant text in place of the last one; with
    only one assistant turn it stops before it; without any the two are equal. Both come from
    one gathering, without a join.
    """
    turns = F.col("chosen")
    places = F.filter(
        F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()
    )
    first, last = F.array_min(places), F.array_max(places)
    stale = F.transform(
        turns,
        lambda t, i: F.when(i == last, t.withField("text", F.get(turns, first)["text"])).otherwise(t),
    )
    worse = (
        F.when(F.size(places) > 1, stale)
        .when(F.size(places) == 1, F.slice(turns, F.lit(1), last))
        .otherwise(turns)
    )
    return format_pairs(gather(conversations, id_col, "chosen").withColumn("rejected", worse))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id AS pair_id, list(struct_pack(role := role, text := text)
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS good
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), marked AS (
  SELECT pair_id, good, list_filter(range(1, len(good) + 1),
    lambda i: coalesce(good[i].role = 'assistant', false)) AS places
  FROM turns
), pair AS (
  SELECT pair_id, good, CASE
    WHEN len(places) > 1 THEN good[1:places[-1] - 1]
      || [struct_pack(role := good[places[-1]].role, text := good[places[1]].text)] || good[places[-1] + 1:]
    WHEN len(places) = 1 THEN good[1:places[1] - 1]
    ELSE good END AS bad
  FROM marked
), cut AS (
  SELECT *, coalesce(list_filter(range(1, least(len(good), len(bad)) + 1),
    lambda i: good[i].role IS DISTINCT FROM bad[i].role
      OR good[i].text IS DISTINCT FROM bad[i].text)[1] - 1, least(len(good), len(bad))) AS n
  FROM pair
), rendered AS (
  SELECT pair_id, n, good, bad, good[n + 1:] AS after_good, bad[n + 1:] AS after_bad,
    list_transform(good, lambda t: '<|' || regexp_replace(coalesce(t.role, ''), '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10)) AS good_head,
    list_transform(good, lambda t: regexp_replace(coalesce(t.text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10)) AS good_body,
    list_transform(bad, lambda t: '<|' || regexp_replace(coalesce(t.role, ''), '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10)) AS bad_head,
    list_transform(bad, lambda t: regexp_replace(coalesce(t.text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10)) AS bad_body
  FROM cut
), texts AS (
  SELECT *, list_transform(range(1, len(good) + 1), lambda i: good_head[i] || good_body[i]) AS g,
    list_transform(range(1, len(bad) + 1), lambda i: bad_head[i] || bad_body[i]) AS b
  FROM rendered
)
SELECT pair_id, n AS prompt_turns,
  coalesce(array_to_string(g[1:n], ''), '') AS prompt,
  coalesce(array_to_string(g[n + 1:], ''), '') AS chosen,
  coalesce(array_to_string(list_transform(list_filter(range(n + 1, len(good) + 1),
    lambda i: coalesce(good[i].role = 'assistant', false)), lambda i:
    CAST(coalesce(list_sum(list_transform(g[n + 1:i - 1], lambda x: length(x))), 0)
      + length(good_head[i]) AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(g[n + 1:i], lambda x: length(x))), 0) - 1 AS BIGINT)), ','), '') AS chosen_loss,
  coalesce(array_to_string(b[n + 1:], ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(n + 1, len(bad) + 1),
    lambda i: coalesce(bad[i].role = 'assistant', false)), lambda i:
    CAST(coalesce(list_sum(list_transform(b[n + 1:i - 1], lambda x: length(x))), 0)
      + length(bad_head[i]) AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(b[n + 1:i], lambda x: length(x))), 0) - 1 AS BIGINT)), ','), '') AS rejected_loss,
  len(good) > n OR len(bad) > n AS differs
FROM texts
"""
