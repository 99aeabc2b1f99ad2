"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain > language > source.  Each node passes its token budget to its children in proportion to their
weights.  A child cannot take more than its subtree holds (``max_epochs`` times its tokens); what it cannot take goes
to its siblings first, and only what a whole subtree cannot take is left to the siblings of its parent.  Each leaf
then takes whole epochs of its documents and a token prefix of the next epoch, in an order seeded for that epoch.

Defined results: a null text has no tokens; a null lang or source is the leaf ``(none)``; documents without tokens are
taken while the budget is not used up; rows without doc_id come in the order of a hash of their text; repeated rows count as separate rows; an empty table gives an empty result;
columns beside doc_id, text, lang, source are ignored by the choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

NONE = "(none)"
LEVELS = ("domain", "lang_key", "source_key")
#: Production weights; a child that is not named weighs 1.
WEIGHTS = {
    "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
    "lang_key": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source_key": {},
}
WORDS = r"[^\x20\x09-\x0D]+"


def default_domain() -> Column:
    """The number at the end of a source's name, modulo 4."""
    digits = F.regexp_extract("source", r"([0-9]{1,9})$", 1)
    return F.when(digits != "", F.concat(F.lit("domain"), (digits.try_cast("int") % 4).cast("string"))).otherwise(NONE)


def _waterfill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` among the children of a parent, none above its ``cap``."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = by.orderBy(F.col("ratio"), F.col(name))
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = nodes.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    n = n.withColumn("before", F.sum("cap").over(up_to) - F.col("cap")).withColumn("left_w", F.sum("w").over(after))
    n = n.withColumn("level", (F.col("budget") - F.col("before")) / F.nullif(F.col("left_w"), F.lit(0.0)))
    n = n.withColumn("full", F.coalesce(F.col("ratio") <= F.col("level"), F.lit(False)))
    n = n.withColumn("nth", F.row_number().over(order))
    n = n.withColumn("at", F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(by)["level"])
    n = n.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.coalesce(F.col("at"), F.lit(0.0)))))
    return n.withColumn("alloc", F.greatest(F.lit(0.0), F.round("alloc", 3)))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    w = weights.get(level) or {}
    if not w:
        return F.lit(1.0)
    pairs = F.create_map(*[F.lit(x) for kv in w.items() for x in (kv[0], float(kv[1]))])
    return F.coalesce(F.try_element_at(pairs, F.col(level)), F.lit(1.0))


def budgets(leaves: DataFrame, share: float, max_epochs: float, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``alloc`` tokens for each leaf of (domain, lang_key, source_key, supply)."""
    leaf = leaves.withColumn("cap", F.col("supply") * float(max_epochs))
    top = leaf.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("domain", weights))
    total = leaf.agg(F.sum("supply").alias("total"))
    top = top.crossJoin(F.broadcast(total)).withColumn("budget", F.least(F.col("total") * share, F.col("total") * float(max_epochs)))  # one row
    top = _waterfill(top, [], "domain").select("domain", F.col("alloc").alias("budget"))
    mid = leaf.groupBy("domain", "lang_key").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang_key", weights))
    mid = _waterfill(mid.join(top, "domain"), ["domain"], "lang_key").select("domain", "lang_key", F.col("alloc").alias("budget"))
    low = leaf.withColumn("w", _weight("source_key", weights)).join(mid, ["domain", "lang_key"])
    return _waterfill(low, ["domain", "lang_key"], "source_key").select(*LEVELS, "supply", "alloc")


def mix_sources(docs: DataFrame, share: float = 0.5, max_epochs: int = 2, seed: int = 7, weights: dict[str, dict[str, float]] | None = None, domain: Column | None = None) -> DataFrame:
    """Rows (doc_id, domain, lang, source, n_tokens, epoch) that are taken; a document may come once an epoch.

    ``share``: the target, as a share of the tokens there are.  No task gets a whole leaf: prefixes are cut by summing
    4096 slices of the seeded order, and only the slice at the border is sorted.
    """
    weights = WEIGHTS if weights is None else weights
    tokens = docs.select(
        "doc_id",
        "lang",
        "source",
        (default_domain() if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit(NONE)).alias("lang_key"),
        F.coalesce("source", F.lit(NONE)).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"),
        # rows without id are told apart by their texts
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(NONE), F.md5(F.coalesce("text", F.lit(""))))).alias("name"),
    )
    tokens = written(tokens, "mix-tokens")
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    plan = budgets(leaves, share, max_epochs, weights)
    plan = plan.withColumn("whole", F.when(F.col("supply") > 0, F.floor(F.col("alloc") / F.col("supply"))).otherwise(F.lit(0)).cast("long"))
    plan = written(plan.withColumn("rest", F.col("alloc") - F.col("whole") * F.col("supply")), "mix-plan")
    #: One row a leaf; its number does not follow the number of documents.
    small = plan.select(*LEVELS, "whole", "rest")
    rows = tokens.join(small, list(LEVELS))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), "name"))
    rows = rows.withColumn("key", key).withColumn("slice", F.substring("key", 1, 3))
    slices = rows.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("end", F.sum("n").over(w)).select(*LEVELS, "slice", "end", (F.col("end") - F.col("n")).alias("begin"))
    cut = slices.join(small, list(LEVELS)).select(*LEVELS, "slice", "begin", (F.col("end") < F.col("rest")).alias("inside"), (F.col("begin") < F.col("rest")).alias("some"))
    cut = cut.where("some")
    partial = rows.join(cut, [*LEVELS, "slice"])
    inside = partial.where("inside")
    border = partial.where("not inside")
    one = Window.partitionBy(*LEVELS, "slice").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = border.withColumn("run", F.sum("n_tokens").over(one) - F.col("n_tokens") + F.col("begin")).where("run < rest")
    cols = ["doc_id", "domain", "lang", "source", "n_tokens"]
    out = inside.select(*cols, F.col("whole").cast("int").alias("epoch")).union(border.select(*cols, F.col("whole").cast("int").alias("epoch")))
    if max_epochs >= 1:
        whole = rows.where("whole > 0").select(*cols, F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("epoch"))
        out = out.union(whole)
    return out


def op3_mix_sources(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(level: str) -> str:
    w = WEIGHTS[level]
    return "CAST(1 AS DOUBLE)" if not w else "CAST(CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END AS DOUBLE)"


def _fill_sql(name: str, source: str, parent: str, child: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"{part} ORDER BY ratio, {child}"
    return f"""{name}_a AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE CAST('inf' AS DOUBLE) END AS ratio FROM {source}),
{name}_b AS (SELECT *, sum(cap) OVER ({order} ROWS UNBOUNDED PRECEDING) - cap AS before_, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
  row_number() OVER ({order}) AS nth FROM {name}_a),
{name}_c AS (SELECT *, (budget - before_) / nullif(left_w, 0) AS level_, coalesce(ratio <= (budget - before_) / nullif(left_w, 0), false) AS full_ FROM {name}_b),
{name}_d AS (SELECT *, arg_min(CASE WHEN NOT full_ THEN level_ END, CASE WHEN NOT full_ THEN nth END) OVER ({part}) AS at_ FROM {name}_c),
{name} AS (SELECT *, greatest(0, round(CASE WHEN full_ THEN cap ELSE least(cap, w * coalesce(at_, 0)) END, 3)) AS alloc FROM {name}_d)"""


OP3_SQL = f"""WITH tokens AS (SELECT doc_id, lang, source,
  CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'domain' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 AS VARCHAR) ELSE '(none)' END AS domain,
  coalesce(lang, '(none)') AS lang_key, coalesce(source, '(none)') AS source_key,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens,
  coalesce(CAST(doc_id AS VARCHAR), '(none)' || md5(coalesce(text, ''))) AS name FROM documents),
leaf AS (SELECT domain, lang_key, source_key, CAST(sum(n_tokens) AS DOUBLE) AS supply, CAST(sum(n_tokens) AS DOUBLE) * 2 AS cap FROM tokens GROUP BY ALL),
t1 AS (SELECT domain, sum(cap) AS cap, {_case("domain")} AS w, (SELECT sum(supply) * 0.5 FROM leaf) AS budget FROM leaf GROUP BY domain),
{_fill_sql("f1", "t1", "", "domain")},
t2 AS (SELECT l.domain, l.lang_key, l.cap, l.w, f1.alloc AS budget FROM (SELECT domain, lang_key, sum(cap) AS cap, {_case("lang_key")} AS w FROM leaf GROUP BY domain, lang_key) l JOIN f1 USING (domain)),
{_fill_sql("f2", "t2", "domain", "lang_key")},
t3 AS (SELECT leaf.domain, leaf.lang_key, source_key, supply, leaf.cap, CAST(1 AS DOUBLE) AS w, f2.alloc AS budget FROM leaf JOIN f2 ON leaf.domain = f2.domain AND leaf.lang_key = f2.lang_key),
{_fill_sql("f3", "t3", "domain, lang_key", "source_key")},
plan AS (SELECT domain, lang_key, source_key, CASE WHEN supply > 0 THEN CAST(floor(alloc / supply) AS BIGINT) ELSE 0 END AS whole,
  alloc - CASE WHEN supply > 0 THEN floor(alloc / supply) ELSE 0 END * supply AS rest FROM f3),
r AS (SELECT t.*, whole, rest, md5('7:' || whole || ':' || name) AS key FROM tokens t JOIN plan p ON t.domain = p.domain AND t.lang_key = p.lang_key AND t.source_key = p.source_key),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang_key, source_key ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS run FROM r)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(whole AS INT) AS epoch FROM c WHERE run < rest
UNION ALL SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT), CAST(e AS INT) FROM (SELECT *, unnest(range(whole)) AS e FROM r)"""
