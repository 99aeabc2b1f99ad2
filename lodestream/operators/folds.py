"""Recurrences over series as streams of sorted rows: a key's state is carried from row to row, no key is held whole.

Rows are dealt by key and sorted inside the partitions (which spills); a task reads them in Arrow batches and keeps one
state.  One series is one task's stream, as each step needs the one before it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lags import join_null_safe


def streamed_fold(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], kind: str, start: Callable, step: Callable, each: bool = False) -> DataFrame:
    """Fold every series: ``state, out = step(state, *values)`` from ``start()`` on, ``out`` being a tuple of ``kind``.

    With ``each`` a row (keys, order, out) comes for every row, else (keys, out) for the last one of a series.  Nulls in
    ``order`` come first; rows of equal order follow their values.
    """
    rows = df.select(*keys, *order, *[c.alias(f"_v{i}") for i, c in enumerate(values.values())])
    vals = [f"_v{i}" for i in range(len(values))]
    sort = [F.col(c).asc_nulls_first() for c in [*keys, *order, *vals]]
    rows = rows.repartition(*keys).sortWithinPartitions(*sort)
    lead = [*keys, *order] if each else keys
    own = StructType.fromDDL(kind)
    out_kind = StructType([*df.select(*lead).schema, *own])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out_kind)
        now, state, last, first = None, None, None, True
        for b in batches:
            given = [b.column(i) for i in range(len(lead))]
            key_cols = [b.column(i).to_pylist() for i in range(len(keys))]
            cols = [b.column(b.schema.get_field_index(v)).to_pylist() for v in vals]
            done: list[tuple] = []
            for key, row in zip(zip(*key_cols, strict=True), zip(*cols, strict=True), strict=True):
                if first or key != now:
                    if not first and not each:
                        done.append((*now, *last))
                    now, state, first = key, start(), False
                state, last = step(state, *row)
                if each:
                    done.append(last)
            if each and done:
                made = [pa.array(c, schema.field(len(lead) + i).type) for i, c in enumerate(zip(*done, strict=True))]
                yield pa.RecordBatch.from_arrays([*(c.cast(schema.field(i).type) for i, c in enumerate(given)), *made], schema=schema)
            elif done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if not first and not each:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, *last), schema, strict=True)], schema=schema)

    return rows.mapInArrow(work, out_kind)


def value_series(df: DataFrame, keys: list[str], order: list[str], ret: str, novelty: Column | None = None, gamma: float = 0.99, rate: float = 0.1, decay: float = 0.05, burst: float = 2.0, steep: float = 5.0, middle: float = 0.5, bonus: float = 0.1) -> DataFrame:
    """(keys, order, rpe, tonic, phasic, level) of every step: value learned from returns by temporal differences.

    ``rpe`` is the error of the value, ``phasic`` the burst of a positive error (2 at most), ``tonic`` the mean between 0 and
    1 that bursts and gains feed, where ``novelty`` adds to a gain, and ``level`` the logistic signal of it.
    """
    import math

    def step(s, r, new):
        v, tonic = s
        r = r or 0.0
        rpe = r + gamma * v - v
        phasic = min(2.0, max(0.0, rpe) * burst)
        tonic = min(1.0, max(0.0, tonic + decay * (max(0.0, r + bonus * (new or 0.0)) + phasic - tonic)))
        level = 1 / (1 + math.exp(-min(10.0, max(-10.0, steep * (tonic - middle)))))
        return (v + rate * rpe, tonic), (rpe, tonic, phasic, level)

    values = {"ret": F.col(ret).cast("double"), "new": (F.lit(0.0) if novelty is None else novelty).cast("double")}
    return streamed_fold(df, keys, order, values, "rpe double, tonic double, phasic double, level double", lambda: (0.0, 0.0), step, each=True)


def reservation_log(events: DataFrame, keys: list[str], order: list[str], action: str, reservation: str, base: str, quote: str, start_base: float, start_quote: float) -> DataFrame:
    """(keys, order, status, base, base_reserved, quote, quote_reserved) after every event of a book.

    ``action`` is reserve, release or commit, and what it is about goes by the reservation's id.  A reservation is refused
    if its id is open already, an amount is negative or more than what is available and not reserved; a release of an id
    that is not open does nothing; a commit of one is refused, else it takes the amounts out.  The state of a book is its
    balances and its open reservations.
    """

    def step(s, what, name, b, q):
        have_b, held_b, have_q, held_q, open_ = s
        b, q = b or 0.0, q or 0.0
        if what == "reserve":
            ok = name not in open_ and b >= 0 and q >= 0 and b <= have_b - held_b and q <= have_q - held_q
            if ok:
                open_[name] = (b, q)
                held_b, held_q = held_b + b, held_q + q
            status = "reserved" if ok else "refused"
        elif name not in open_:
            status = "unknown" if what == "release" else "refused"
        else:
            b, q = open_.pop(name)
            held_b, held_q = held_b - b, held_q - q
            if what == "commit":
                have_b, have_q = have_b - b, have_q - q
            status = "released" if what == "release" else "committed"
        return (have_b, held_b, have_q, held_q, open_), (status, have_b, held_b, have_q, held_q)

    values = {"what": F.col(action), "name": F.col(reservation), "b": F.col(base).cast("double"), "q": F.col(quote).cast("double")}
    return streamed_fold(events, keys, order, values, "status string, base double, base_reserved double, quote double, quote_reserved double", lambda: (start_base, 0.0, start_quote, 0.0, {}), step, each=True)


def average_cost(fills: DataFrame, keys: list[str], order: list[str], price: str, signed: Column) -> DataFrame:
    """(keys, pos, cost, pnl): position, mean cost and realised profit after all fills of a key, by average cost."""

    def step(s, p, q):
        pos, cost, pnl = s
        new = pos + q
        if pos * q >= 0:
            cost = (cost * abs(pos) + p * abs(q)) / abs(new) if new else 0.0
        else:
            pnl += min(abs(pos), abs(q)) * (p - cost) * (1 if pos > 0 else -1)
            cost = 0.0 if not new else p if pos * new < 0 else cost
        return (new, cost, pnl), (new, cost, pnl)

    values = {"p": F.col(price).cast("double"), "q": signed.cast("double")}
    return streamed_fold(fills, keys, order, values, "pos double, cost double, pnl double", lambda: (0.0, 0.0, 0.0), step)


def ewma(df: DataFrame, keys: list[str], order: list[str], value: Column, alpha: float) -> DataFrame:
    """(keys, ewma): last exponentially weighted mean of each key; null steps carry it along."""

    def step(m, v):
        m = m if v is None else v if m is None else m + alpha * (v - m)
        return m, (m,)

    return streamed_fold(df, keys, order, {"v": value.cast("double")}, "ewma double", lambda: None, step)


def clamped(df: DataFrame, keys: list[str], order: list[str], delta: Column, start: float, low: float, high: float, decay: float = 1.0) -> DataFrame:
    """(keys, level): level after all steps, each time decayed, moved by delta and clamped."""

    def step(level, d):
        level = max(low, min(high, level * decay + (d or 0.0)))
        return level, (level,)

    return streamed_fold(df, keys, order, {"d": delta.cast("double")}, "level double", lambda: start, step)


def token_bucket(df: DataFrame, client: str, order: list[str], seconds: str, rate: float, capacity: float) -> DataFrame:
    """(client, allowed, refused) of a bucket that fills at ``rate`` a second up to ``capacity``; a request takes one."""

    def step(s, t):
        last, tokens, ok, no = s
        tokens = min(capacity, tokens + ((t - last) * rate if t is not None and last is not None else 0.0))
        go = tokens >= 1
        s = (t, tokens - 1 if go else tokens, ok + go, no + (not go))
        return s, (s[2], s[3])

    return streamed_fold(df, [client], order, {"t": F.col(seconds).cast("double")}, "allowed int, refused int", lambda: (None, capacity, 0, 0), step)


def cusum(df: DataFrame, keys: list[str], order: list[str], value: str, drift: float, threshold: float) -> DataFrame:
    """Alarms of the two-sided cumulative sum of z-scores, reset at each alarm: (keys, at, side)."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = join_null_safe(df, stats, keys).withColumn("_z", F.coalesce((F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0)))

    def step(s, x):
        up, down, at = max(0.0, s[0] + x - drift), max(0.0, s[1] - x - drift), s[2]
        side = 1 if up > threshold else -1 if down > threshold else 0
        return ((0.0, 0.0) if side else (up, down)) + (at + 1,), (at, side)

    return streamed_fold(z, keys, order, {"z": F.col("_z")}, "at int, side int", lambda: (0.0, 0.0, 0), step, each=True).where("side <> 0").select(*keys, "at", "side")


def rolling_percentile(df: DataFrame, keys: list[str], order: list[str], value: str, p: float, samples: int = 2048) -> DataFrame:
    """(keys, order, p) after every row: the percentile of the last ``samples`` values of its series, nulls left out."""

    def step(s, v):
        line, ranked = s
        if v is not None:
            if len(line) == samples:
                del ranked[bisect_left(ranked, line.popleft())]
            line.append(v)
            insort(ranked, v)
        if not ranked:
            return s, (None,)
        rank = p * (len(ranked) - 1)
        low = int(rank)
        high = min(low + 1, len(ranked) - 1)
        return s, (ranked[low] + (ranked[high] - ranked[low]) * (rank - low),)

    return streamed_fold(df, keys, order, {"v": F.col(value).cast("double")}, "p double", lambda: (deque(), []), step, each=True)
