"""First-seen state of addresses: a keyed stream processor, and the same over a table."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Tasks get the processor with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: How long an address counts as new.
WINDOW = timedelta(hours=24)
#: How long an address that doesn't come again is remembered.
LIFETIME = timedelta(days=90)
OUT = "project string, url string, at timestamp, first_at timestamp, is_new boolean"
_MICROS = "project string, url string, at long, first_at long, is_new boolean"


class FirstSeen(StatefulProcessor):
    """State of one (project, url): whether it was in the project's baseline run, when it was first and when last seen.

    A timer drops the state when the watermark is a lifetime past the last sight; the address is then first seen again.
    """

    def __init__(self, window: timedelta = WINDOW, lifetime: timedelta = LIFETIME):
        self.window, self.lifetime = window // timedelta(microseconds=1), lifetime // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "baseline boolean, first_at long, last_at long")

    def _expiry(self, last: int) -> int:
        return (last + self.lifetime) // 1000

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = sorted((r.at_us, r.started_us) for r in rows)
        at, started = came[0]
        known = self.seen.get()
        baseline, first, last = known if known is not None else (at <= started, at, None)
        if not baseline and at < first:  # a late sight moves the first one back
            baseline, first = at <= started, at
        newest = max(came[-1][0], last or came[-1][0])
        if newest != last:
            if last is not None:
                self.handle.deleteTimer(self._expiry(last))
            self.handle.registerTimer(self._expiry(newest))
        self.seen.update((baseline, first, newest))
        for at, _ in came:
            yield Row(project=key[0], url=key[1], at=at, first_at=None if baseline else first, is_new=not baseline and at - first <= self.window)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def _registered(urls: DataFrame, projects: DataFrame) -> DataFrame:
    """Sights ``(project, url, at)`` of known projects ``(project, started)``; those up to ``started`` are the baseline run."""
    known = projects.groupBy("project").agg(F.min("started").alias("started")).where("project IS NOT NULL AND started IS NOT NULL")
    return urls.select("project", "url", "at").where("url IS NOT NULL AND at IS NOT NULL").join(known, "project")


def first_seen_stream(urls: DataFrame, projects: DataFrame, window: timedelta = WINDOW, lifetime: timedelta = LIFETIME, late: str = "7 days") -> DataFrame:
    """(project, url, at, first_at, is_new) of each sight in a stream; see :class:`FirstSeen`. Sights that come later than ``late`` are left out.

    ``projects`` is a table of each project's first run. Its addresses are never new, wherever the stream is started again.
    State is dealt by project and address, so a project of any size is spread. Needs the RocksDB state store.
    """
    rows = _registered(urls.withWatermark("at", late), projects).select("project", "url", "at", F.unix_micros("at").alias("at_us"), F.unix_micros("started").alias("started_us"))
    found = rows.groupBy("project", "url").transformWithState(FirstSeen(window, lifetime), _MICROS, "append", "eventTime")
    return found.select("project", "url", F.timestamp_micros("at").alias("at"), F.timestamp_micros("first_at").alias("first_at"), "is_new")


def _seconds(x: timedelta) -> Column:
    return F.expr(f"INTERVAL {int(x.total_seconds())} SECONDS")


def first_seen_table(urls: DataFrame, projects: DataFrame, window: timedelta = WINDOW) -> DataFrame:
    """The same rows from a table of all sights: the first one of an address is an aggregate that joins back."""
    rows = _registered(urls, projects)
    first = rows.groupBy("project", "url").agg(F.min("at").alias("first"))
    found = rows.join(first, ["project", "url"])
    baseline = F.col("first") <= F.col("started")
    return found.select(
        "project", "url", "at", F.when(~baseline, F.col("first")).alias("first_at"),
        (~baseline & (F.col("at") <= F.col("first") + _seconds(window))).alias("is_new"),
    )


def stored_state(spark, checkpoint: str) -> DataFrame:
    """(project, url, baseline, first_at, last_at) that a stopped stream remembers."""
    rows = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    return rows.select("key.project", "key.url", "value.baseline", F.timestamp_micros("value.first_at").alias("first_at"), F.timestamp_micros("value.last_at").alias("last_at"))

