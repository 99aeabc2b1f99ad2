"""Column functions: lexicons, links, schedules, divergences, gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def lexicon_score(text: Column, positive: list[str], negative: list[str], boost: list[str], bonus: float = 0.5) -> Column:
    """(positive + bonus * boosted - negative) over the words that count."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    n = lambda words: F.size(F.filter(w, lambda x: x.isin(words)))
    p, m = n(positive), n(negative)
    return F.when(text.isNotNull(), (p + bonus * n(boost) - m) / F.greatest(p + m, F.lit(1)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: an infinity or NaN over 0, where ANSI division is an error."""
    x = a.cast("double")
    over_zero = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf"))
    return F.when(b == 0, over_zero).otherwise(x / F.nullif(b, F.lit(0.0)))


def logarithm(x: Column) -> Column:
    """ln as floating point has it: minus infinity at 0, NaN below, where Spark gives NULL."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))


def engagement(counts: Column) -> Column:
    return F.log1p(F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))


def weighted_shard(key: str, weights: list[int]) -> Column:
    """Shard number by a hash of the key, shards taking shares by weight."""
    h = F.pmod(F.xxhash64(key), F.lit(sum(weights)))
    ends = [sum(weights[: i + 1]) for i in range(len(weights))]
    return F.coalesce(*[F.when(h < e, F.lit(i)) for i, e in enumerate(ends)])


def valid_link(url: str) -> Column:
    host = F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit(""))
    return F.coalesce(F.try_parse_url(F.col(url), F.lit("PROTOCOL")), F.lit("")).isin("http", "https") & (host != "")


def link_title(url: str) -> Column:
    return F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("untitled"))


def missing_tags(df: DataFrame, key: str, tag: str, needed: list[str]) -> DataFrame:
    g = df.groupBy(key).agg(F.collect_set(tag).alias("have"))
    return g.select(key, F.array_join(F.array_except(F.array(*[F.lit(t) for t in needed]), "have"), ",").alias("missing"))


def gradient(c: str, w: WindowSpec) -> Column:
    """Central difference, one-sided at both ends."""
    a, b = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(a.isNull(), b - F.col(c)).when(b.isNull(), F.col(c) - a).otherwise((b - a) / 2)


def kl_divergence(p: str, q: str, floor: float = 1e-12) -> Column:
    unit = lambda c: F.transform(F.transform(c, lambda x: F.greatest(x, F.lit(floor))), lambda x: x / F.aggregate(F.transform(c, lambda y: F.greatest(y, F.lit(floor))), F.lit(0.0), lambda a, y: a + y))
    return F.aggregate(F.zip_with(unit(p), unit(q), lambda x, y: x * F.ln(x / y)), F.lit(0.0), lambda a, x: a + x)


def even_schedule(orders: DataFrame, key: str, qty: str, slices: int) -> DataFrame:
    """Equal whole slices, the rest with the last one."""
    part = F.floor(F.col(qty) / slices)
    d = orders.select(key, qty, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    return d.select(key, "slice", F.when(F.col("slice") < slices - 1, part.cast("double")).otherwise(F.col(qty) - (slices - 1) * part).alias("qty"))


def direction_index(skew: Column, curvature: Column, bias: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Weighted sum of skewness, change of curvature and bias."""
    return weights[0] * skew + weights[1] * curvature + weights[2] * bias


def profile_schedule(orders: DataFrame, key: str, qty: str, profile: list[float], participation: float | None = None) -> DataFrame:
    """Child quantities by a volume profile: its shares, or ``participation`` of each bucket's forecast volume, none above
    the order; what a sum falls short of the order goes to the last one."""
    share = [w / sum(profile) for w in profile]
    each = F.array(*[F.col(qty) * w if participation is None else F.least(F.col(qty), F.lit(participation * v)) for w, v in zip(share, profile, strict=True)])
    d = orders.select(key, qty, F.posexplode(each).alias("slice", "_q"))
    given = F.sum("_q").over(Window.partitionBy(key))
    last = F.col("slice") == len(profile) - 1
    return d.select(key, "slice", F.when(last, F.col("_q") + F.greatest(F.lit(0.0), F.col(qty) - given)).otherwise(F.col("_q")).alias("qty"))


def signal_noise(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    e = F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)))
    g = df.groupBy(*keys).agg(e.alias("mse"), F.avg(F.col(x) * F.col(x)).alias("_p"), F.max(x).alias("_m"))
    return g.select(*keys, "mse", (10 * F.log10(F.col("_p") / F.col("mse"))).alias("snr"), (10 * F.log10(F.col("_m") * F.col("_m") / F.col("mse"))).alias("psnr"))
