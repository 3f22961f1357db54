"""The retry machine with timers: the stream against the batch and a plain version, in batches of any cut, with restarts; deduplication in two tiers."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.keyed import Keyed
from newsloom.streaming import stream, timers

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "key string, ts timestamp, ok boolean, throttled boolean"


def plain(events, until):
    """Every step of every key, written out."""
    out, by = [], {}
    for key, ts, ok, throttled in events:
        if key is not None and ts is not None and ts <= until:
            by.setdefault(key, []).append((ts, bool(ok), bool(throttled)))
    for key, rows in by.items():
        n, due, drop, ended = 0, None, None, False
        for ts, ok, throttled in [*sorted(rows), (until, None, None)]:
            if due and due <= ts:
                out.append((key, due, "due", n))
                due, drop = None, due + dt.timedelta(days=2)
            if drop and drop <= ts:
                out.append((key, drop, "dropped", n))
                n, drop, ended = 0, None, False
            if ok is None or ended or due:
                continue
            n, drop = n + (not throttled), None
            if (ok and not throttled) or n >= 3:
                out.append((key, ts, "ended", n))
                drop, ended = ts + dt.timedelta(days=2), True
            else:
                out.append((key, ts, "tried", n))
                due = ts + dt.timedelta(hours=6)
    return sorted(out)


def events(seed, n, keys=6, days=8):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(keys)}", T0 + dt.timedelta(seconds=rng.randrange(days * 86400), microseconds=rng.randrange(1000) * 1000), rng.random() < 0.3, rng.random() < 0.3) for _ in range(n)]
    rows.append(("k0", rows[0][1], None, None))
    return rows


def taken(df):
    return sorted((r.key, r["at"], r.step, r.attempts) for r in df.collect())


def test_batch_like_a_plain_fold(spark):
    rows = events(1, 300) + [(None, T0, True, False), ("k1", None, True, False)]
    until = T0 + dt.timedelta(days=7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert taken(timers.batch(df, F.lit(until))) == plain(rows, until)
    assert {r.step for r in timers.batch(df).collect()} == {"tried", "ended", "due", "dropped"}
    assert timers.batch(df.limit(0), F.lit(until)).count() == 0


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stream.with_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def run(spark, folder, out, files=1):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{folder}/*.parquet")
    q = timers.stream(rows).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{n}.parquet")


def test_stream_like_the_batch_with_restarts(spark, tmp_path, rocksdb):
    rows = sorted(events(2, 120, days=6), key=lambda r: r[1])
    rng, at, n = random.Random(4), 0, 0
    while at < len(rows):  # files of any size; rows late by less than the delay are shuffled
        size = rng.randrange(20, 50)
        part = rows[at : at + size]
        rng.shuffle(part)
        put(spark, tmp_path / "in", n, part)
        at, n = at + size, n + 1
        if n == 2:
            run(spark, tmp_path / "in", tmp_path / "out")  # and the query is started anew
    flush = T0 + dt.timedelta(days=20)
    put(spark, tmp_path / "in", n, [("end", flush, True, False)])
    q = run(spark, tmp_path / "in", tmp_path / "out")
    got = [r for r in taken(spark.read.parquet(f"{tmp_path}/out/rows")) if r[0] != "end"]
    assert got == plain(rows, flush - dt.timedelta(hours=1))
    states = [s for p in q.recentProgress for s in p.get("stateOperators", [])] if isinstance(q.recentProgress[0], dict) else [s for p in q.recentProgress for s in p.stateOperators]
    assert states  # all keys are dropped by now, but the one that ends the stream
    put(spark, tmp_path / "in", n + 1, [("end2", flush + dt.timedelta(days=30), True, False)])
    run(spark, tmp_path / "in", tmp_path / "out")
    left = spark.read.format("statestore").option("stateVarName", "known").load(f"{tmp_path}/out/checkpoint").filter("value IS NOT NULL")
    assert [r.key.key for r in left.collect()] == ["end2"], left.collect()


def test_empty_folders(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    got = stream.run_now(stream.source(spark, str(tmp_path / "in"), "events"), "none", "append")
    assert got.count() == 0 and got.columns == ["event_id", "ts", "user_id", "event_type", "value", "props"]
    assert stream.run_now(stream.day_counts(stream.source(spark, str(tmp_path / "in"), "events")), "none2", "complete").count() == 0


def test_dedup_in_two_tiers(spark, tmp_path):
    day = lambda d, h=0: T0 + dt.timedelta(days=d, hours=h)
    files = [[("a", day(0)), ("b", day(0)), ("a", day(0, 1))], [("a", day(1)), ("c", day(1))], [("d", day(30))], [("a", day(40)), ("b", day(40)), ("e", day(40)), ("e", day(40, 1))]]
    schema = "key string, ts timestamp"
    seen = []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
        table = stream.dedup_into(source, "key", str(tmp_path / "t"), "7 days")
        seen.append(sorted(r.key for r in table.read().collect()))
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"]]
    state = spark.read.format("statestore").load(f"{tmp_path}/t/checkpoint")
    assert {r.key.key for r in state.select("key").collect()} <= {"a", "b", "d", "e"}  # of keys a week old the stream knows nothing
    assert Keyed(spark, str(tmp_path / "t"), "key").read().filter("key = 'a'").first().ts <= day(0, 1)
