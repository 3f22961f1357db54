"""Paged stores, sources that break, and reports of stages."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from newsloom.operators import integrity
from newsloom.plans import flows
from newsloom.sources import paged, readers

T0 = dt.datetime(2024, 1, 1)


class Store:
    """Rows newest first, in chains of at most ``chain``."""

    def __init__(self, rows, chain):
        self.rows, self.chain, self.pages, self.given = sorted(rows, reverse=True), chain, 0, 0

    def page(self, low, high, cursor, size):
        self.pages += 1
        at = cursor or 0
        if at >= self.chain:
            raise paged.TooMany
        found = [r for r in self.rows if low <= r[0] < high]
        out = found[at : min(at + size, self.chain)]
        self.given += len(out)
        return out, at + len(out) if at + len(out) < len(found) else None


def test_chains_reach_every_row():
    rng = random.Random(1)
    rows = [(T0 + dt.timedelta(minutes=rng.randrange(600)), i) for i in range(900)]
    for chain, size in ((10_000, 100), (50, 20), (50, 50), (7, 3)):
        store = Store(rows, chain)
        got = list(paged.chained(store, T0, T0 + dt.timedelta(days=1), 0, size))
        assert set(got) == set(rows) and len(got) < 2 * len(rows)
    assert store.given == len(got)
    with pytest.raises(ValueError, match="than a chain holds"):
        list(paged.chained(Store([(T0, i) for i in range(9)], 5), T0, T0 + dt.timedelta(days=1), 0, 2))
    assert list(paged.chained(Store([], 5), T0, T0 + dt.timedelta(days=1), 0)) == []


def test_windows():
    got = paged.windows(T0, T0 + dt.timedelta(days=2.5), 1)
    assert [(w.low - T0, w.high - T0) for w in got] == [(dt.timedelta(days=a), dt.timedelta(days=b)) for a, b in ((0, 1), (1, 2), (2, 2.5))]
    assert paged.windows(T0, T0, 1) == []


def test_paged_source_is_the_whole_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(T0 + dt.timedelta(minutes=rng.randrange(5 * 1440)), i // 2, T0 + dt.timedelta(days=9, seconds=i % 2), f"v{i % 2}") for i in range(3000)]
    schema = "collected timestamp_ntz, id long, edited timestamp_ntz, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/p")
    paged.register(spark)
    reader = spark.read.format("paged").schema(schema).options(client="newsloom.sources.paged:FileStore", path=f"{tmp_path}/p", columns="collected,id,edited,text", chain=60, size=25, start="2024-01-01", end="2024-01-06", days=1)
    df = reader.load()
    assert df.rdd.getNumPartitions() == 5
    assert set(map(tuple, df.collect())) == set(rows) and df.count() > len(rows)  # anchors' rows come twice
    got = paged.latest(df).collect()
    assert len(got) == 1500 and {r.text for r in got} == {"v1"}
    narrow = reader.load().filter(F.col("collected") >= F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")).filter(F.col("collected") < F.lit("2024-01-03").cast("timestamp_ntz"))
    assert set(map(tuple, narrow.collect())) == {r for r in rows if T0 + dt.timedelta(days=1.5) <= r[0] < T0 + dt.timedelta(days=2)}


def test_a_window_is_read_once(spark, tmp_path):
    """However many chains it has; a client that goes on to another window reads that one."""
    rng = random.Random(3)
    rows = [(T0 + dt.timedelta(minutes=rng.randrange(2 * 1440)), i) for i in range(2000)]
    spark.createDataFrame(rows, "collected timestamp_ntz, id long").coalesce(1).write.parquet(f"{tmp_path}/p")
    store = paged.FileStore({"path": f"{tmp_path}/p", "columns": "collected,id", "chain": 40})
    data, reads = store.data, []

    class Counted:
        def to_table(self, **kw):
            reads.append(kw)
            return data.to_table(**kw)

    store.data = Counted()
    for k in range(2):
        low, high = T0 + dt.timedelta(days=k), T0 + dt.timedelta(days=k + 1)
        got = list(paged.chained(store, low, high, 0, 15))
        assert set(got) == {r for r in rows if low <= r[0] < high} and len(got) < 2 * len(rows)
        assert len(reads) == k + 1
    # a narrower end within the same window is what's left of it; a wider one is read
    low, mid = T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1.5)
    assert set(paged.chained(store, low, mid, 0)) == {r for r in rows if low <= r[0] < mid} and len(reads) == 2
    assert set(paged.chained(store, T0, mid, 0)) == {r for r in rows if r[0] < mid} and len(reads) == 3


def test_pushed_bounds_narrow_the_windows():
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = paged.PagedReader(T.StructType([T.StructField("collected", T.TimestampNTZType())]), {"start": "2024-01-01", "end": "2024-02-01", "days": "1"})
    filters = [GreaterThan(("collected",), dt.datetime(2024, 1, 9, 12)), LessThanOrEqual(("collected",), dt.datetime(2024, 1, 11)), EqualTo(("id",), 3)]
    assert list(reader.pushFilters(filters)) == filters
    assert [(w.low, w.high) for w in reader.partitions()] == [(dt.datetime(2024, 1, 9, 12), dt.datetime(2024, 1, 10, 12)), (dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 11, 0, 0, 0, 1))]


def test_a_source_that_breaks_while_it_is_read(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"ordinal": 1, "title": "x"}\n{broken')
    schema = "ordinal long, title string, url string, source string, abstract string, crowd_score double, published_at timestamp"
    good = spark.createDataFrame([(0, "GPT-5 released", "https://a.com/1", "OpenAI", "gpt-5 llm agent", None, None)], schema)

    def no_plan():
        return spark.read.parquet(str(tmp_path / "none"))

    def breaks():
        return good.withColumn("title", F.raise_error(F.lit("broken")).cast("string"))

    sources = [lambda: readers.checkpoint(spark, str(tmp_path / "bad.json"), schema), lambda: good, no_plan, breaks]
    backlog = spark.createDataFrame([], "ordinal long, title string, url string, source string, abstract string, crowd_score double, published_at timestamp, fetched_at timestamp, score int, lang string, kind string, category array<string>, base int, bonus int, crowd int")
    got = flows.collect(spark, sources, backlog, spark.createDataFrame([], "url_key string"), spark.createDataFrame([], "url_key string"), F.lit(dt.datetime(2026, 10, 15)))
    assert [r.url for r in got["pending"].collect()] == ["https://a.com/1"]
    assert [k for k, _ in got["failed"]] == [0, 2, 3] and [r.source for r in got["failures"].collect()] == [0, 2, 3]
    rows, bad = readers.json_rows(spark, str(tmp_path / "bad.json"), schema)
    assert [r.title for r in rows.collect()] == ["x"] and [r.line for r in bad.collect()] == ["{broken"]


def test_reports_count_what_is_written(spark, tmp_path):
    rows = spark.range(100).withColumn("odd", F.col("id") % 2)
    with integrity.report("collect", {"id": 1}) as out:
        integrity.counted(out, rows, fetched=F.count("*"), odd=F.sum("odd")).write.parquet(f"{tmp_path}/o")
    assert out["status"] == "success" and out["stats"] == {"fetched": 100, "odd": 50} and out["finishedAt"] >= out["startedAt"]
    with pytest.raises(ZeroDivisionError), integrity.report("collect", {}) as out:
        integrity.counted(out, rows, fetched=F.count("*"))
        1 / 0
    assert out["status"] == "failed" and out["failure"] == "ZeroDivisionError" and "observations" not in out


def test_reports_of_streams(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
    listener = integrity.StreamReports(spark, str(tmp_path / "reports"), {"id": 1})
    spark.streams.addListener(listener)
    try:
        source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
        rows = source().observe("counts", F.count("*").alias("seen"), F.sum("id").alias("total"))
        rows.writeStream.queryName("good").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        q = source().select(F.when(F.col("id") > 12, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id")).writeStream.queryName("bad").format("parquet").option("path", f"{tmp_path}/out2").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            q.awaitTermination()
        until = time.time() + 30
        while len(listener.done) < 2 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    good = json.loads(integrity.get(spark, f"{tmp_path}/reports/good-report.json"))
    written = spark.read.parquet(f"{tmp_path}/out")
    assert (good["status"], good["stats"]["seen"], good["stats"]["total"], good["stats"]["rows"]) == ("success", written.count(), sum(r.id for r in written.collect()), 30)
    assert json.loads(integrity.get(spark, f"{tmp_path}/reports/bad-report.json"))["status"] == "failed"
