"""Calls to a store outside the engine, spaced and tried again: requests are dealt to lanes (partitions), whose calls together keep the store's rate.

A lane may begin a call every ``lanes`` times the spacing, and lane l begins l spacings after the first, so that no two lanes need to know of each
other. Only throttled calls are tried again, never before the store allows it, and no call begins that couldn't end within its request's budget.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds between calls, tries, seconds that a call may take, and a request's whole budget.
SPACING, TRIES, CALL_S, BUDGET_S = 0.4, 3, 10.0, 30.0


class Throttled(Exception):
    """The store asks to wait, perhaps for so many seconds."""

    def __init__(self, retry_after: float | None = None):
        super().__init__("throttled")
        self.retry_after = retry_after


class Refused(Exception):
    """A request that failed for good; ``reason`` and the tries made."""

    def __init__(self, reason: str, attempts: int):
        super().__init__(f"{reason} after {attempts}")
        self.reason, self.attempts = reason, attempts


class Outcome(NamedTuple):
    """What became of a request: ``reason`` is None if it gave a ``value``."""

    value: Any = None
    reason: str | None = None
    attempts: int = 0
    waits_s: float | None = None


class Lane:
    """One lane's calendar: when its next call may begin."""

    def __init__(self, number: int = 0, lanes: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, deadline: float = float("inf")):
        self.clock, self.sleep, self.deadline, self.period = clock, sleep, deadline, SPACING * lanes
        self.next = clock() + number * SPACING if number else float("-inf")

    def begin(self, until: float) -> bool:
        """Waits for the lane's turn and takes it; False if a call couldn't end in time, also if the waiting took longer than planned."""
        fits = lambda at: at + CALL_S <= until
        now = self.clock()
        if not fits(max(now, self.next)):
            return False
        if self.next > now:
            self.sleep(self.next - now)
            if not fits(self.clock()):
                return False
        self.next = self.clock() + self.period
        return True

    def request(self, action: Callable[[], Any]) -> Outcome:
        until, asked = min(self.deadline, self.clock() + BUDGET_S), None
        for done in range(TRIES):
            if not self.begin(until):
                return Outcome(None, "budget_exhausted", done, asked)
            try:
                return Outcome(action(), None, done + 1)
            except Throttled as e:
                asked = e.retry_after
                self.next = max(self.next, self.clock() + (2.0**done if asked is None else asked))
            except Exception:  # noqa: BLE001
                return Outcome(None, "request_failed", done + 1)
        return Outcome(None, "rate_limited", TRIES, asked)


class Pacer:
    """A single lane for use on the driver: a request's value, or ``Refused``."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, deadline: float = float("inf")):
        self.lane = Lane(0, 1, clock, sleep, deadline)

    def __call__(self, action: Callable):
        got = self.lane.request(action)
        if got.reason:
            raise Refused(got.reason, got.attempts)
        return got.value


def paced(requests: DataFrame, send: Callable[[str], str], key: str, body: str, lanes: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``key``, ``response``, ``reason``, ``attempts``, ``waits_s`` (what the store last asked for) of each request, whose ``body`` (text) ``send`` is given.

    Each lane is a task, its requests in order of the key; equal keys go to one lane. A task that's lost is run again, so ``send`` must be safe to repeat."""
    kind = requests.schema[key].dataType.simpleString()
    rows = requests.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body")).repartition(lanes, "key").sortWithinPartitions("key")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        lane = Lane(TaskContext.get().partitionId() % lanes, lanes, clock, sleep)
        for batch in batches:
            got = [lane.request(lambda b=b: send(b)) for b in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "response", "reason", "attempts", "waits_s"])

    return rows.mapInArrow(run, f"key {kind}, response string, reason string, attempts int, waits_s double").withColumnRenamed("key", key)
