"""A keyed retry machine with timers: tries, due retries, and ended keys that are dropped after a while. As a stream and as a batch.

An event is a try of a key (``key``, ``ts``, ``ok``, ``throttled``). Tries before the key's next time are passed over. One that fails sets the next
time a cooldown later; throttled ones aren't charged; a success, or the last attempt, ends the key. At its next time a key is ``due``;
``ttl`` after its end, or after it was due and nobody tried, it's ``dropped``, and what comes later begins anew. Both forms give a row for each step:
``key``, ``at``, ``step`` (tried, ended, due, dropped), ``attempts``.

The stream holds events until the watermark has passed them, so that its rows don't depend on how they were dealt into batches, and keeps
state only for keys that are waiting, or were due or ended less than ``ttl`` ago. Times are microseconds; of equal ones failures count first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

COOLDOWN, ATTEMPTS, TTL = 6 * 3600, 3, 2 * 86400
SECOND = 1_000_000
OUT = "at timestamp, step string, attempts int"
#: attempts, the next time (0: none; negative: when it was due), the time of the end (0: not ended); all zero: nothing is known.
NEW = (0, 0, 0)


class Machine:
    """The rules, apart from where state is kept."""

    def __init__(self, cooldown: int = COOLDOWN, attempts: int = ATTEMPTS, ttl: int = TTL):
        self.cooldown, self.attempts, self.ttl = cooldown * SECOND, attempts, ttl * SECOND

    def wake(self, state: tuple) -> int:
        """When something happens without an event; 0: never."""
        return state[2] + self.ttl if state[2] else state[1] if state[1] >= 0 else self.ttl - state[1]

    def passed(self, state: tuple, now: int) -> tuple[tuple, list]:
        """The state at ``now`` without further events, and the steps on the way. A key that's due keeps its attempts, and may be tried."""
        steps = []
        while (at := self.wake(state)) and at <= now:
            n, after, _ = state
            due = after > 0
            steps.append((at, "due" if due else "dropped", n))
            state = (n, -at, 0) if due else NEW
        return state, steps

    def tried(self, state: tuple, at: int, ok: bool, throttled: bool) -> tuple[tuple, list]:
        n, after, end = state
        if end or after > at:
            return state, []
        n += not throttled
        if (ok and not throttled) or n >= self.attempts:
            return (n, 0, at), [(at, "ended", n)]
        return (n, at + self.cooldown, 0), [(at, "tried", n)]

    def run(self, state: tuple, events: list, now: int | None = None) -> tuple[tuple, list]:
        """Folds events (time, ok, throttled) in order, and what happens until ``now``."""
        steps = []
        for at, ok, throttled in sorted(events):
            state, more = self.passed(state, at)
            state, own = self.tried(state, at, ok, throttled)
            steps += more + own
        if now is not None:
            state, more = self.passed(state, now)
            steps += more
        return state, steps


def _prepared(events: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return events.filter("key IS NOT NULL AND ts IS NOT NULL").select("key", "ts", F.unix_micros("ts").alias("us"), flag("ok"), flag("throttled"))


def batch(events: DataFrame, until=None, machine: Machine | None = None) -> DataFrame:
    """The steps of all events up to ``until`` (a column), and of what happens until then; without it of all events. A key's rows are read as a
    stream in order of time, by one task in bounded memory."""
    machine = machine or Machine()
    rows = _prepared(events)
    if until is not None:
        rows = rows.withColumn("until", F.unix_micros(until.cast("timestamp"))).filter("us <= until")
    else:
        rows = rows.withColumn("until", F.lit(None).cast("long"))
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.select("key", "us", "ok", "throttled", "until").repartition("key").sortWithinPartitions("key", "us", "ok", "throttled")

    def run(batches):
        import pyarrow as pa

        own, state, last, end = None, NEW, None, None
        kinds, out = None, []

        def given():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kinds), pa.array([r[1] for r in out], pa.timestamp("us", "UTC")), pa.array([r[2] for r in out]  , pa.string()), pa.array([r[3] for r in out], pa.int32())], names=["key", "at", "step", "attempts"])

        def close():
            if last is not None and end is not None:
                out.extend((own, *s) for s in machine.run(state, [], end)[1])

        for b in batches:
            kinds = b.column(0).type
            for key, us, ok, throttled, until_us in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is None or key != own:
                    close()
                    own, state = key, NEW
                last, end = us, until_us
                state, steps = machine.run(state, [(us, ok, throttled)])
                out.extend((key, *s) for s in steps)
            yield given()
            out = []
        if last is not None:
            close()
            yield given()

    return rows.mapInArrow(run, f"key {kind}, {OUT}")


def _frame(key, steps: list):
    import pandas as pd

    texts = lambda xs: pd.Series(xs, dtype=object)  # noqa: E731  (Arrow strings come in chunks, which Spark doesn't take)
    keys = [key] * len(steps)
    return pd.DataFrame({"key": texts(keys) if isinstance(key, str) else pd.Series(keys), "at": pd.to_datetime([s[0] for s in steps], unit="us", utc=True), "step": texts([s[1] for s in steps]), "attempts": pd.Series([s[2] for s in steps], dtype="int32")})


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "attempts int, after long, ended long, timer long")
        self.held = handle.getListState("held", "us long, ok boolean, throttled boolean")

    def _state(self) -> tuple[tuple, int]:
        got = self.known.get() if self.known.exists() else None
        return ((int(got[0]), int(got[1]), int(got[2])), int(got[3])) if got else (NEW, 0)

    def _keep(self, state: tuple, timer: int, waiting: list) -> None:
        """Keeps what's known, held events, and one timer, for whatever comes first; forgets a key of which nothing is."""
        wake = min([t for t in (self.machine.wake(state), *(e[0] for e in waiting)) if t > 0], default=0)
        due = -(-wake // 1000)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        if state == NEW and not waiting:
            self.known.clear()
        else:
            self.known.update((*state, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        events = [(int(u), bool(o), bool(t)) for frame in rows for u, o, t in zip(frame["us"], frame["ok"], frame["throttled"], strict=True)]
        state, timer = self._state()
        self.held.appendList(events)
        self._keep(state, timer, events + ([(timer * 1000, False, False)] if timer else []))
        yield _frame(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state, _ = self._state()
        held = [(int(e[0]), bool(e[1]), bool(e[2])) for e in self.held.get()] if self.held.exists() else []
        ready, waiting = [e for e in held if e[0] <= now], [e for e in held if e[0] > now]
        state, steps = self.machine.run(state, ready, now)
        if ready:
            self.held.clear()
            if waiting:
                self.held.put(waiting)
        self._keep(state, 0, waiting)  # the expired timer is gone
        yield _frame(key[0], steps)

    def close(self) -> None:
        pass


def stream(events: DataFrame, delay: str = "1 hour", machine: Machine | None = None) -> DataFrame:
    """The steps of a stream of events that may be late by ``delay``; later ones are dropped. It needs the RocksDB state store
    (``stream.with_rocksdb``)."""
    rows = _prepared(events).withWatermark("ts", delay)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(_Processor(machine or Machine()), f"key {kind}, {OUT}", "append", "EventTime")
