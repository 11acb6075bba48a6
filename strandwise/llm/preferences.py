"""Preference formatting, in DataFrame functions only.

A pair has a chosen and a rejected conversation.  Their longest common prefix of turns (equal role and text) is
rendered once as the prompt; the rest of each is a completion with the spans, in code points, of what is trained on:
the assistant's texts and their end marks.  The prompt is never trained on.

Turns are ordered by number, then role and text.  Null roles read ``unknown`` and null texts are empty.  Equal
conversations are all prompt, with empty completions; a side without turns is an empty conversation.  Rows with a
null conv_id are one conversation.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, END = ("<|", "|>\n"), "\n<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(HEAD[0]), t["role"], F.lit(HEAD[1]), t["text"], F.lit(END)))


def _sizes(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.length(t["role"]) + F.length(t["text"]) + len(HEAD[0] + HEAD[1] + END))


def _ends(sizes: str) -> Column:
    """Running sums, by steps that each add what stands twice as far before: n log n for n turns."""
    steps = f"sequence(0, int(ceil(log2(greatest(size({sizes}), 2)))))"
    return F.expr(f"aggregate({steps}, {sizes}, (s, k) -> transform(s, (x, i) -> x + if(i >= shiftleft(1, k), s[i - shiftleft(1, k)], 0)))")


def _mask(turns: Column, ends: Column) -> Column:
    """start:end of the assistant's texts with their end marks, comma-joined, in the rendered turns."""
    spans = F.zip_with(turns, ends, lambda t, e: F.when(t["role"] == "assistant", F.concat_ws(":", (e - F.length(t["text"]) - len(END)).cast("string"), e.cast("string"))))
    return F.array_join(F.filter(spans, lambda s: s.isNotNull()), ",")


def format_preferences(pairs: DataFrame, key: str) -> DataFrame:
    """key, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask; pairs: key, chosen, rejected (arrays of role, text)."""
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    differ = F.array_position(same, F.lit(False))
    rows = pairs.withColumn("_n", F.when(differ == 0, F.greatest(F.size("chosen"), F.size("rejected"))).otherwise((differ - 1).cast("int")))
    rest = lambda c: F.slice(F.col(c), F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    rows = rows.select(key, "_n", F.slice("chosen", F.lit(1), F.col("_n")).alias("_p"), rest("chosen").alias("_c"), rest("rejected").alias("_r"))
    rows = rows.withColumns({"_cs": _sizes(F.col("_c")), "_rs": _sizes(F.col("_r"))}).withColumns({"_ce": _ends("_cs"), "_re": _ends("_rs")})
    return rows.select(
        key,
        F.col("_n").alias("prompt_turns"),
        F.array_join(_rendered(F.col("_p")), "").alias("prompt"),
        F.array_join(_rendered(F.col("_c")), "").alias("chosen"),
        F.array_join(_rendered(F.col("_r")), "").alias("rejected"),
        _mask(F.col("_c"), F.col("_ce")).alias("chosen_mask"),
        _mask(F.col("_r"), F.col("_re")).alias("rejected_mask"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: each conversation up to its last answer, against the next conversation's last answer in that place.

    The next conversation is conv_id + 1; without one, or without an answer there, the rejected side ends before the
    answer.  A conversation without an answer is both sides.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    talks = talks.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    is_answer = F.transform("turns", lambda t: t["role"] == "assistant")
    last = F.size("turns") - F.array_position(F.reverse(is_answer), F.lit(True)).cast("int") + 1
    talks = talks.withColumn("last", F.when(F.array_contains(is_answer, True), last).otherwise(F.lit(0)))
    other = talks.where("last > 0").select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", F.col("last")).alias("other"))
    joined = talks.join(other, "conv_id", "left")
    none = F.slice("turns", F.lit(1), F.lit(0))
    return joined.select(
        "conv_id",
        F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.col("last"))).otherwise(F.col("turns")).alias("chosen"),
        F.when(F.col("last") > 0, F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.when(F.col("other").isNotNull(), F.array("other")).otherwise(none))).otherwise(F.col("turns")).alias("rejected"),
    )


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conv_id")


def _sql_shown(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)), ''), '')"


def _sql_mask(turns: str, sizes: str) -> str:
    end = f"list_sum({sizes}[1:i])"
    return (
        f"coalesce(array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'),"
        f" lambda i: CAST(CAST({end} - length({turns}[i].text) - {len(END)} AS BIGINT) AS VARCHAR) || ':' || CAST(CAST({end} AS BIGINT) AS VARCHAR)), ','), '')"
    )


OP4_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, list(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, '')) ORDER BY turn, role, text) AS turns
  FROM conversations GROUP BY 1),
l AS (SELECT *, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), 0) AS last FROM t),
p AS (
  SELECT a.conv_id, CASE WHEN a.last > 0 THEN a.turns[1:a.last] ELSE a.turns END AS c,
    CASE WHEN a.last = 0 THEN a.turns WHEN b.last > 0 THEN list_append(a.turns[1:a.last - 1], b.turns[b.last]) ELSE a.turns[1:a.last - 1] END AS r
  FROM l a LEFT JOIN l b ON b.conv_id = a.conv_id + 1),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1),
    lambda i: i > len(c) OR i > len(r) OR c[i].role <> r[i].role OR c[i].text <> r[i].text)), greatest(len(c), len(r)) + 1) - 1 AS n FROM p),
x AS (SELECT conv_id, n, c[1:n] AS p, c[n + 1:len(c)] AS c, r[n + 1:len(r)] AS r FROM n),
y AS (
  SELECT *, list_transform(c, lambda t: length(t.role) + length(t.text) + {len(HEAD[0] + HEAD[1] + END)}) AS cs,
    list_transform(r, lambda t: length(t.role) + length(t.text) + {len(HEAD[0] + HEAD[1] + END)}) AS rs FROM x)
SELECT conv_id, CAST(n AS INTEGER) AS prompt_turns, {_sql_shown('p')} AS prompt, {_sql_shown('c')} AS chosen, {_sql_shown('r')} AS rejected,
  {_sql_mask('c', 'cs')} AS chosen_mask, {_sql_mask('r', 'rs')} AS rejected_mask
FROM y
"""
