"""Supervision of streaming jobs: a table of what they did, and starting them again.

``ProgressTable`` listens to the queries of a session and appends a row for each start, batch and end to a table: input,
rates, watermark and how far it lags, rows of the state and rows that came too late for it. ``keep_running`` starts a job
again when a batch fails, after a pause that doubles, and gives up when it fails too often in too short a time.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = (
    "at timestamp, query string, run_id string, event string, batch_id bigint, input_rows bigint, rows_per_second double, "
    "batch_ms bigint, watermark timestamp, lag_seconds double, state_rows bigint, late_rows bigint, error string"
)


def _moment(text: str | None) -> dt.datetime | None:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None


class ProgressTable(StreamingQueryListener):
    """Appends to a table under ``path``; small rows, held until there are ``every`` of them or a query ends.

    A query's end does not say its name, so the names of running queries are remembered by run.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every = spark, path, every
        self._held: list[tuple] = []
        self._names: dict[str, str | None] = {}

    def _add(self, query: str | None, run_id: str, event: str, *values, end: bool = False) -> None:
        row = (dt.datetime.now(dt.timezone.utc), query, run_id, event, *values)
        self._held.append(row + (None,) * (13 - len(row)))
        if end or len(self._held) >= self.every:
            self.flush()

    def flush(self) -> None:
        rows, self._held = self._held, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name
        self._add(event.name, str(event.runId), "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        mark, newest = (_moment(p.eventTime.get(k)) for k in ("watermark", "max"))
        lag = (newest - mark).total_seconds() if mark and newest else None
        states = p.stateOperators
        self._add(
            p.name, str(p.runId), "batch", p.batchId, p.numInputRows, p.processedRowsPerSecond, p.durationMs.get("triggerExecution"),
            mark, lag, sum(s.numRowsTotal for s in states), sum(s.numRowsDroppedByWatermark for s in states),
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        error = event.exception[:4000] if failed else None
        name = self._names.pop(str(event.runId), None)
        self._add(name, str(event.runId), "failed" if failed else "ended", *[None] * 8, error, end=True)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


@dataclass(frozen=True)
class Restarts:
    """At most ``most`` failures within ``within`` seconds; the pause doubles from ``first`` to ``longest`` seconds and is
    ``first`` again after that time without a failure."""

    most: int = 5
    within: float = 600.0
    first: float = 1.0
    longest: float = 60.0

    def pause(self, failures: list[float], now: float) -> float | None:
        """Seconds to wait after the failures at these times, the last of them now; None to give up."""
        recent = [t for t in failures if now - t <= self.within]
        return None if len(recent) > self.most else min(self.longest, self.first * 2 ** (len(recent) - 1))


def keep_running(start: Callable[[], StreamingQuery], restarts: Restarts = Restarts(), sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a job until it ends by itself or is stopped; the number of times it was started again.

    A job starts from its checkpoint, so a batch that failed runs again. When it fails too often its last error is raised.
    """
    failures: list[float] = []
    while True:
        query = start()
        try:
            query.awaitTermination()
        except Exception:
            now = time.monotonic()
            failures.append(now)
            pause = restarts.pause(failures, now)
            if pause is None:
                raise
            sleep(pause)
            continue
        return len(failures)
