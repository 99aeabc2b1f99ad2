"""Cleaning, scaling, quality gates, predicates over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import keep_last
from .resample import interpolate


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean_frame(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Drop repeated rows, make non-finite values NULL, interpolate by row position."""
    d = df.dropDuplicates().withColumns({c: finite(F.col(c)) for c in cols})
    return interpolate(d, keys, order, cols)


def scale(df: DataFrame, cols: list[str], method: str = "zscore", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Z-score (population) or min-max of columns; a constant column is 0 (or the middle of the range); NULLs stay."""
    stats = df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))])
    d = df.crossJoin(F.broadcast(stats))  # one row
    out = {}
    for c in cols:
        m, sd, lo, hi = (F.col(f"{c}_{n}") for n in ("m", "s", "lo", "hi"))
        if method == "zscore":
            v = F.when(sd > 0, (F.col(c) - m) / sd).otherwise(F.lit(0.0))
        else:
            v = F.when(hi > lo, low + (F.col(c) - lo) / (hi - lo) * (high - low)).otherwise(F.lit((low + high) / 2 if method == "indicator" else low))
        out[c] = F.when(F.col(c).isNotNull(), v)
    return d.withColumns(out).select(*df.columns)


def numeric_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in exclude]


def coerce(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Text to numbers; columns without any value and rows with a NULL or non-finite number go."""
    d = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in numeric})
    counts = d.agg(*[F.count(c).alias(c) for c in d.columns]).first()  # one row
    d = d.select(*[c for c in d.columns if counts[c]])
    return d.dropna(subset=[c for c in numeric if c in d.columns])


def quality_gate(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, window: int = 5, limit: float = 3.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Add ``reasons``: duplicate time, spike against the rows before, out of range. An empty array is clean."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    before = w.rowsBetween(-window, -1)
    again = F.row_number().over(Window.partitionBy(*keys, ts).orderBy(tie)) > 1
    z = F.abs(F.col(value) - F.avg(value).over(before)) / F.nullif(F.stddev_samp(value).over(before), F.lit(0.0))
    enough = F.count(value).over(before) >= window
    rules = [F.when(again, F.lit("duplicate")), F.when(enough & (z > limit), F.lit("spike"))]
    if low is not None:
        rules.append(F.when((F.col(value) < low) | (F.col(value) > high), F.lit("range")))
    return df.withColumn("reasons", F.array_compact(F.array(*rules)))


def quality_summary(gated: DataFrame, most: float) -> DataFrame:
    """Rows, quarantined rows, their share, count of each reason, verdict."""
    bad = F.size("reasons") > 0
    g = gated.agg(F.count("*").alias("total"), F.count_if(bad).alias("quarantined"), *[F.count_if(F.array_contains("reasons", r)).alias(r) for r in ("duplicate", "spike", "range")])
    return g.withColumn("ratio", F.col("quarantined") / F.col("total")).withColumn("ok", F.col("ratio") <= most)


def profile(df: DataFrame, cols: list[str], top: int = 3) -> DataFrame:
    """One row for each column: count, nulls, distinct, mean, sd, quartiles, most frequent values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    base = long.groupBy("column").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_distinct("v").alias("distinct"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), q.alias("q"))
    freq = long.where("v IS NOT NULL").groupBy("column", "v").count()
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "v"))
    most = freq.withColumn("r", rank).where(F.col("r") <= top).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("r", "v", "count"))).alias("top"))
    return base.join(most, "column", "left").select("column", "n", "nulls", "distinct", "mean", "sd", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)], F.col("top")[0]["v"].alias("mode"), F.col("top")[0]["count"].alias("mode_n"))


def canonical_symbol(c: Column, quotes: list[str], spot: bool = True) -> Column:
    """Trim, upper-case, one separator between base and a known quote."""
    bare = F.regexp_replace(F.upper(F.trim(c)), r"[\s_:\-/]+", "")
    sep = "/" if spot else "-"
    return F.regexp_replace(bare, f"^(.+)({'|'.join(quotes)})$", f"$1{sep}$2")


def round_to_step(c: Column, step: Column | float, digits: int = 8) -> Column:
    """Half-up to a multiple of a decimal step."""
    d = c.cast(f"decimal(28,{digits})")
    s = (F.lit(step) if not isinstance(step, Column) else step).cast("decimal(18,6)")
    return (F.round(d / s, 0) * s).cast("double")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


#: Fixed order: a later pattern sees what an earlier one left.
REDACTIONS = {
    "SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "CARD": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "TOKEN": r"\b[0-9a-fA-F]{32,64}\b",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+?[0-9]{0,2}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}",
}


def redact(c: Column) -> Column:
    for name, pattern in REDACTIONS.items():
        c = F.regexp_replace(c, pattern, f"[{name}]")
    return c


def redact_map(c: Column, secret: str = "(?i)(password|secret|token|key)") -> Column:
    """Values of keys that sound secret are replaced."""
    return F.transform_values(c, lambda k, v: F.when(k.rlike(secret), F.lit("***")).otherwise(v))


def text_hash(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), 256), 1, length)


def canonical_json_hash(cols: list[str]) -> Column:
    """SHA-256 of JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def session_gates(df: DataFrame, session: str, ts: str, needed: list[str], rows: int = 20, seconds: int = 900) -> DataFrame:
    g = df.groupBy(session).agg(F.count("*").alias("n"), F.min(sum((F.col(c).isNotNull().cast("int") for c in needed), F.lit(0)) == len(needed)).alias("complete"), (F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))).alias("span"))
    return g.withColumn("ok", (F.col("n") >= rows) & F.col("complete") & (F.col("span") >= seconds))


def book_issues(levels: DataFrame, snapshot: str, side: str, place: str, price: str, qty: str) -> DataFrame:
    """Levels with a negative price, a zero or negative quantity, or out of price order on their side."""
    before = F.lag(price).over(Window.partitionBy(snapshot, side).orderBy(place))
    wrong = F.when(F.col(side) == "bid", F.col(price) > before).otherwise(F.col(price) < before)
    out = levels.withColumn("issues", violations({"negative": F.col(price) < 0, "empty": F.col(qty) <= 0, "order": wrong}))
    return out.where(F.size("issues") > 0)


def claim_spans(df: DataFrame, key: str, text: str, phrases: dict[str, str]) -> DataFrame:
    """Sentences that match a tier's phrases; the first tier that matches counts."""
    d = df.select(key, F.posexplode(F.split(text, r"\.\s+")).alias("nth", "sentence"))
    tier = F.coalesce(*[F.when(F.lower("sentence").rlike(p), F.lit(t)) for t, p in phrases.items()])
    return d.withColumn("tier", tier).where("tier IS NOT NULL")


def last_per_time(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    return keep_last(df, [*keys, ts], [tie])
