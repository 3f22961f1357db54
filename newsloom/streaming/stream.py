"""Structured Streaming forms of the micro-batch operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.keyed import Keyed

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def source(spark: SparkSession, directory: str, name: str, schema: str = EVENTS, per_trigger: int = 1000) -> DataFrame:
    """A table's files as a stream; event time as TIMESTAMP, which watermarks need. A folder may still be empty."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", f"{name}*").parquet(directory)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def day_counts(events: DataFrame) -> DataFrame:
    """Counts by day of event time; rows however late still count, so no watermark drops any."""
    return events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def dedup(events: DataFrame, key: str, exact: bool = True, within: str = "7 days") -> DataFrame:
    """One row of each key: exact with state that grows, or within a watermark with state that's bounded."""
    return events.dropDuplicates([key]) if exact else events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def dedup_into(events: DataFrame, key: str, path: str, within: str = "7 days", name: str = "dedup", checkpoint: str | None = None) -> Keyed:
    """One row of each key in the keyed table at ``path``, with state that's bounded. Repeats that come within the watermark are dropped by the
    stream's state, before anything is read; later ones by the table, of which only parts that may hold them are read."""
    spark = events.sparkSession
    table = Keyed(spark, path, key)
    recent = events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])
    q = recent.writeStream.foreachBatch(lambda batch, epoch: table.insert(batch, name, epoch) and None).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return table


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``; in local mode without that, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="newsloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def run_now(df: DataFrame, name: str, mode: str) -> DataFrame:
    """All that's there now, written by one query with its checkpoint in the shared folder, and read back: rows never gather in the driver.

    In ``complete`` mode each batch replaces the table; in ``append`` mode the file sink adds to it, each batch once."""
    base = shared_folder(df.sparkSession, name)
    out = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").option("path", f"{base}/rows").start()
    else:
        q = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")).start()
    q.awaitTermination()
    if not exists(df.sparkSession, f"{base}/rows"):  # a source without files has no batch
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/rows")


def with_rocksdb(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def retry_states(events: DataFrame, cooldown_s: int = 6 * 3600, attempts: int = 3) -> DataFrame:
    """Keyed retry state: ``key``, ``attempts``, ``next_at``, ``done`` after each micro-batch. Events: ``key``, ``ts``, ``ok``, ``throttled``.

    A key's events of a batch count in order of time (ties: failures first). One before ``next_at`` is passed over; a throttled one waits
    without being charged; a success, or the last attempt, ends the key, whose state stays, so that nothing starts it anew.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import pandas as pd

        n, after, done = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "ok", "throttled"])
        for ts, ok, throttled in zip(rows["ts"].astype("datetime64[s]").astype("int64"), rows["ok"], rows["throttled"], strict=True):
            if done or ts < after:
                continue
            n += not throttled
            done = bool(ok) and not throttled or n >= attempts
            after = 0 if done else int(ts) + cooldown_s
        state.update((int(n), int(after), bool(done)))
        yield pd.DataFrame({"key": [key[0]], "attempts": [n], "next_at": [after], "done": [done]})

    key = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").applyInPandasWithState(step, f"key {key}, attempts int, next_at long, done boolean", "attempts int, after long, done boolean", "update", GroupStateTimeout.NoTimeout)
