"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once: that participant's turns as the
assistant's, everybody else's as turns of named users, and the loss mask covers the participant's own turns (text and
end marker).  Roles in ``context_roles`` (the system prompt) are shown as they are and get no view of their own.

A view is one row, however long the dialogue is; with ``turns_per_part`` it comes as several rows, one for each stretch of
so many turn numbers, whose offsets start anew.  ``<|`` in a text is written ``< |``, and roles are escaped (``%3C`` for ``<``),
so that only the formatter makes markers, turns and masks and different roles stay different.  Defined results: a null role speaks as ``unknown``; a null text is empty; a null turn
comes first (in part -1, where there are parts); rows of the same turn are ordered by role and text, repeated rows stay;
a null conv_id is a conversation of its own; conversations with context roles only, or empty tables, give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)


#: What a role may not hold, and what stands for it; the escape itself comes first, so roles stay apart.
ROLE_ESCAPES = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("|", "%7C"), ("\n", "%0A"), ("\r", "%0D"))


def escaped_role(role: Column) -> Column:
    for a, b in ROLE_ESCAPES:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def rotate_perspectives(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, turns_per_part: int | None = None) -> DataFrame:
    """Rows (conv_id, part, speaker, n_turns, n_target_turns, dialogue, mask_starts, mask_ends), offsets in characters."""
    for a, b in ROLE_ESCAPES:
        context_roles = tuple(c.replace(a, b) for c in context_roles)
    part = F.lit(0) if turns_per_part is None else F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(-1))
    t = turns.select(
        "conv_id",
        "turn",
        part.cast("long").alias("part"),
        escaped_role(F.coalesce("role", F.lit("unknown"))).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    speakers = t.where(~F.col("role").isin(*context_roles)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    views = t.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("role") == F.col("speaker")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role").isin(*context_roles), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    views = views.select("conv_id", "part", "speaker", "turn", "role", "text", own.alias("own"), head.alias("head"), F.concat("text", F.lit("<|end|>\n")).alias("body"))
    size = F.length("head") + F.length("body")
    w = Window.partitionBy("conv_id", "part", "speaker").orderBy("turn", "role", "text")
    views = views.withColumn("nth", F.row_number().over(w)).withColumn("end", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    piece = F.struct("nth", F.concat("head", "body").alias("s"), F.when(F.col("own"), F.col("end") - F.length("body")).alias("a"), F.when(F.col("own"), F.col("end")).alias("b"))
    g = views.groupBy("conv_id", "part", "speaker").agg(F.count("*").alias("n_turns"), F.count_if("own").alias("n_target_turns"), F.array_sort(F.collect_list(piece)).alias("p"))
    return g.select(
        "conv_id",
        "part",
        "speaker",
        "n_turns",
        "n_target_turns",
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("dialogue"),
        F.filter(F.transform("p", lambda x: x["a"]), lambda x: x.isNotNull()).alias("mask_starts"),
        F.filter(F.transform("p", lambda x: x["b"]), lambda x: x.isNotNull()).alias("mask_ends"),
    )


def op6_chat_perspectives(spark, sf_dir):
    """Masks as text, so that any engine compares them alike."""
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("mask_starts", "mask_ends")})


OP6_SQL = """WITH t AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS part,
  replace(replace(replace(replace(replace(replace(coalesce(role, 'unknown'), '%', '%25'), '<', '%3C'), '>', '%3E'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'),
v AS (SELECT conv_id, part, speaker, turn, role, text, role = speaker AS own,
  CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
  text || '<|end|>' || chr(10) AS body FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.c),
w AS (SELECT *, row_number() OVER o AS nth, sum(length(head) + length(body)) OVER (o ROWS UNBOUNDED PRECEDING) AS e FROM v WINDOW o AS (PARTITION BY conv_id, part, speaker ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_target_turns, string_agg(head || body, '' ORDER BY nth) AS dialogue,
  coalesce(string_agg(CAST(e - length(body) AS VARCHAR), ',' ORDER BY nth) FILTER (own), '') AS mask_starts,
  coalesce(string_agg(CAST(e AS VARCHAR), ',' ORDER BY nth) FILTER (own), '') AS mask_ends
FROM w GROUP BY conv_id, part, speaker"""
