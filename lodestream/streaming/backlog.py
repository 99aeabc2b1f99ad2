"""An event-time backlog for each key: rows of several sources are held back until all live sources have passed them.

A key's watermark is the smallest of its live sources' newest event times, less the allowed lateness; it never falls.  A
source is idle, and no longer waited for, when nothing came from it for ``idle``; when all sources are idle nothing is
waited for.  Rows at or before the watermark are released, by event time.  A row that comes behind the watermark is
released at once and marked late, or, when it is more than ``expire`` behind, given back as expired.

The state of a key is a row for each source and the rows that wait, which the watermark bounds.  An event-time timer on
the arrival clock wakes a key whose sources fell silent.
"""

from __future__ import annotations

import heapq
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .keyed import lists

IN_ORDER, LATE, EXPIRED = "in order", "late", "expired"


class Board:
    """The backlog of one key; times are whole microseconds."""

    def __init__(self, late: int, expire: int, idle: int, sources: dict | None = None, waiting: list | None = None, watermark: int | None = None, released: int = 0):
        self.late, self.expire, self.idle = late, expire, idle
        self.sources: dict[str, tuple[int, int]] = sources if sources is not None else {}
        self.waiting: list[tuple[int, int]] = waiting if waiting is not None else []
        heapq.heapify(self.waiting)
        self.watermark, self.released = watermark, released

    def clock(self, now: int) -> list[tuple[int, str, int]]:
        """(row, status, position) of what no longer has to wait at this time."""
        if not self.sources:
            return []
        live = [newest for newest, arrival in self.sources.values() if now - arrival <= self.idle]
        low = min(live) - self.late if live else max(newest for newest, _ in self.sources.values())
        if self.watermark is None or low > self.watermark:
            self.watermark = low
        out = []
        while self.waiting and self.waiting[0][0] <= self.watermark:
            self.released += 1
            out.append((heapq.heappop(self.waiting)[1], IN_ORDER, self.released))
        return out

    def observe(self, source: str, event: int, arrival: int, row: int) -> list[tuple[int, str, int | None]]:
        out: list = self.clock(arrival)
        newest, last = self.sources.get(source, (event, arrival))
        self.sources[source] = (max(newest, event), max(last, arrival))
        if self.watermark is not None and event < self.watermark - self.expire:
            out.append((row, EXPIRED, None))
        elif self.watermark is not None and event <= self.watermark:
            self.released += 1
            out.append((row, LATE, self.released))
        else:
            heapq.heappush(self.waiting, (event, row))
        return out + self.clock(arrival)

    def wake(self) -> int | None:
        """When the next source falls idle, if anything waits for it."""
        live = [arrival for _, arrival in self.sources.values()]
        return min(live) + self.idle if self.waiting and live else None


class BacklogProcessor(StatefulProcessor):
    def __init__(self, key: str, row: str, late: int, expire: int, idle: int):
        self.key, self.row, self.times = key, row, (late, expire, idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a key, as each call of a state crosses to the JVM
        self.board = handle.getValueState("board", "watermark long, released long, source array<string>, newest array<long>, arrival array<long>, event array<long>, row array<long>, timer long")

    def load(self) -> tuple[Board, int | None]:
        """The backlog, and the timer that is set for it."""
        kept = self.board.get()
        if not kept:
            return Board(*self.times), None
        mark, released, source, newest, arrival, event, row, timer = kept
        return Board(*self.times, dict(zip(source, zip(newest, arrival, strict=True), strict=True)), list(zip(event, row, strict=True)), mark, released), timer

    def store(self, board: Board, now: int, old: int | None) -> None:
        # sources that are idle already cannot fall idle again
        live = [a for _, a in board.sources.values() if now - a <= board.idle]
        timer = -((min(live) + board.idle) // -1000) + 1 if board.waiting and live else None
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        at, waiting = list(board.sources.values()), board.waiting
        self.board.update((board.watermark, board.released, list(board.sources), [a for a, _ in at], [a for _, a in at], [e for e, _ in waiting], [r for _, r in waiting], timer))

    def frame(self, key, rows: list) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(rows), self.row: pd.array([r[0] for r in rows], "Int64"), "status": [r[1] for r in rows], "position": pd.array([r[2] for r in rows], "Int64")})

    def handleInputRows(self, key, rows, timerValues):
        columns = lists(rows, "arrival_us", "row", "source", "event")
        batch = sorted(zip(*columns, strict=True), key=itemgetter(0, 1))  # one trigger's rows of the key
        board, timer = self.load()
        out: list = []
        for arrival, row, source, event in batch:
            out += board.observe(source, event, arrival, row)
        self.store(board, batch[-1][0], timer)
        if out:
            yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        board, _ = self.load()
        out = board.clock(now)
        self.store(board, now, None)  # the timer is gone with its call
        if out:
            yield self.frame(key, out)

    def close(self) -> None:
        pass


def micros(interval: str) -> int:
    return int(pd.Timedelta(interval) / pd.Timedelta("1us"))


def released(stream: DataFrame, key: str, source: str, event: str, arrival: str, row: str, late: str, expire: str, idle: str, slack: str = "1 hour") -> DataFrame:
    """(key, row, status, position) of the rows of a stream as they leave the backlog; ``row`` is a number of each row.

    ``slack`` is how far arrivals of different keys may run apart.  A null source is the source "", rows without event or
    arrival time are left out.
    """
    s = stream.where(F.col(event).isNotNull() & F.col(arrival).isNotNull())
    s = s.select(F.col(key).alias(key), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.unix_micros(event).alias("event"), F.unix_micros(arrival).alias("arrival_us"), F.col(arrival).alias("arrival"), F.col(row).cast("long").alias("row"))
    kind = StructType([stream.schema[key]]).add(row, "long").add("status", "string").add("position", "long")
    work = BacklogProcessor(key, row, micros(late), micros(expire), micros(idle))
    return s.withWatermark("arrival", slack).groupBy(key).transformWithStateInPandas(work, kind, "Append", "EventTime")
