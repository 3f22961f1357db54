"""Tables with a key, in hash buckets and versions: insert-if-absent, and merges that are written.

A version is a small file that lists the table's parts (a directory of Parquet for each write and bucket). A write first adds parts, which
nobody reads yet, then commits a version that names them; a reader sees one version or the next, and of two writers the later one begins anew
from the other's version. Each write also keeps a key filter (Bloom bits) for each of its parts, so that a batch reads only parts that
may hold one of its keys, of these only the key, and of these only matching parts are rewritten by a merge.

Filters are tested where they are, against the batch's key hashes: these are broadcast up to ``MOST_KEYS``, beyond that all parts are read.
What the driver handles is the list of parts, not rows. Null keys are a key like any other; of rows with equal keys in a batch the least
counts; empty batches commit nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.integrity import commit, latest
from newsloom.operators.rank import first_per, name

BUCKETS, BITS_PER_KEY, PROBES = 64, 16, 8
#: Keys of one filter, and keys of a batch whose hashes are broadcast.
FILTER_KEYS, MOST_KEYS = 4_000_000, 1_000_000
TRIES = 20


def _spread(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of a hash in a filter: one row of ``PROBES`` for each."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # keys of a bucket have equal low bits
        h ^= h >> np.uint64(29)
        step = (h * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def key_filter(hashes: np.ndarray) -> np.ndarray:
    bits = max(64, -(-len(hashes) * BITS_PER_KEY // 8) * 8)
    out = np.zeros(bits, bool)
    out[_spread(hashes.view(np.uint64), bits).ravel()] = True
    return np.packbits(out)


def may_hold(packed: np.ndarray, hashes: np.ndarray) -> bool:
    places = _spread(hashes.view(np.uint64), len(packed) * 8)
    hit = (packed[(places >> np.uint64(3)).astype(np.int64)] >> (7 - (places & np.uint64(7)).astype(np.uint8))) & 1
    return bool(hit.all(axis=1).any())


class Keyed:
    """The table at ``path``. ``read`` is its rows; ``insert`` and ``merge`` write, and may be called by several writers at once."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # versions

    def state(self) -> tuple[int, dict]:
        version, text = latest(self.spark, f"{self.path}/versions")
        return version, json.loads(text) if text else {"schema": None, "buckets": self.buckets, "parts": [], "batches": {}}

    def rows(self, state: dict, parts: list | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of the parts (all of them by default), with ``__write`` and ``__bucket`` if columns are named."""
        schema = T.StructType.fromJson(state["schema"])
        both = T.StructType([*schema, T.StructField("__write", T.StringType()), T.StructField("__bucket", T.IntegerType())])
        parts = state["parts"] if parts is None else parts
        if not parts:
            out = self.spark.createDataFrame([], both)
        else:
            out = self.spark.read.schema(both).option("basePath", f"{self.path}/data").parquet(*(self._part(w, b) for w, b in parts))
        return out.select(*columns, "__write", "__bucket") if columns else out.select(*(name(f.name) for f in schema))

    def read(self) -> DataFrame:
        """The rows of the latest version; an error if nothing was ever written."""
        version, state = self.state()
        if version < 0:
            raise FileNotFoundError(f"no table at {self.path}")
        return self.rows(state)

    def _part(self, write: str, bucket: int) -> str:
        return f"{self.path}/data/__write={write}/__bucket={bucket}"

    # parts

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(name(self.key)), F.lit(state["buckets"])).cast("int")

    def _stage(self, state: dict, rows: DataFrame) -> list:
        """Writes rows as parts that no version names yet, with their key filters; gives the parts."""
        write = uuid.uuid4().hex
        target = f"{self.path}/data/__write={write}"
        rows.withColumn("__bucket", self._bucket(state)).repartition(state["buckets"], "__bucket").write.partitionBy("__bucket").parquet(target)
        both = T.StructType([*rows.schema, T.StructField("__bucket", T.IntegerType())])
        hashes = self.spark.read.schema(both).option("basePath", target).parquet(target).select("__bucket", F.xxhash64(name(self.key)).alias("h"))

        def build(batches):
            import pyarrow as pa

            held: dict[int, list] = {}

            def given(bucket):
                own = np.concatenate(held.pop(bucket))
                return pa.RecordBatch.from_arrays([pa.array([write]), pa.array([bucket], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([key_filter(own).tobytes()], pa.binary())], names=["write", "bucket", "n", "bits"])

            for batch in batches:
                of, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for bucket in np.unique(of).tolist():
                    held.setdefault(bucket, []).append(h[of == bucket])
                    if sum(map(len, held[bucket])) >= FILTER_KEYS:
                        yield given(bucket)
            for bucket in list(held):
                yield given(bucket)

        filters = f"{self.path}/filters/__write={write}"
        hashes.mapInArrow(build, "write string, bucket int, n bigint, bits binary").write.parquet(filters)
        return [[write, r.bucket] for r in self.spark.read.parquet(filters).select("bucket").distinct().orderBy("bucket").collect()]

    def candidates(self, state: dict, batch: DataFrame) -> list:
        """The parts that may hold a key of the batch."""
        parts = state["parts"]
        if not parts:
            return []
        keys = batch.select(self._bucket(state).alias("bucket"), F.xxhash64(name(self.key)).alias("h")).distinct()
        if keys.count() > MOST_KEYS:
            touched = {r.bucket for r in keys.select("bucket").distinct().collect()}
            return [p for p in parts if p[1] in touched]
        by_bucket = keys.groupBy("bucket").agg(F.collect_list("h").alias("hashes"))
        live = {tuple(p) for p in parts}
        filters = self.spark.read.parquet(*sorted(f"{self.path}/filters/__write={w}" for w in {w for w, _ in parts}))
        tested = filters.select("write", "bucket", "bits").join(F.broadcast(by_bucket), "bucket")

        def test(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    bits, hashes = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8), batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                    if may_hold(bits, hashes):
                        yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), batch.column(0).slice(i, 1)], names=["write", "bucket"])

        found = tested.select("bucket", "write", "bits", "hashes").mapInArrow(test, "write string, bucket int").distinct()
        return sorted(list(p) for p in {(r.write, r.bucket) for r in found.collect()} & live)

    def _batch(self, rows: DataFrame) -> DataFrame:
        """The batch's rows, of a key the least, written once, so that all steps see the same."""
        target = f"{self.path}/incoming/{uuid.uuid4().hex}"
        first_per(rows, [self.key], *(F.col(name(c)) for c in sorted(rows.columns))).write.parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target)

    # writes

    def insert(self, rows: DataFrame, stream: str | None = None, epoch: int = 0) -> DataFrame:
        """Adds rows whose key isn't there; gives ``outcome`` (created or existing) for each key of the batch. A batch of a stream that was committed
        before adds nothing: all that it has is existing."""
        batch = self._batch(rows)
        for _ in range(TRIES):
            version, state = self.state()
            if stream is not None and state["batches"].get(stream, -1) >= epoch:
                return batch.select(self.key, F.lit("existing").alias("outcome"))
            state["schema"] = state["schema"] or json.loads(rows.schema.json())
            near = self.candidates(state, batch)
            known = self.rows(state, near, [self.key]).select(F.col(name(self.key)).alias("__known"))
            fresh = batch.join(known, F.col(name(self.key)).eqNullSafe(F.col("__known")), "left_anti")
            parts = self._stage(state, fresh)
            if stream is not None:
                state["batches"][stream] = epoch
            state["parts"] = state["parts"] + parts
            if (not parts and stream is None) or self._commit(version, state):
                made = self.rows(state, parts, [self.key]).select(F.col(name(self.key)).alias("__made"), F.lit(True).alias("__new"))
                return batch.join(made, F.col(name(self.key)).eqNullSafe(F.col("__made")), "left").select(self.key, F.when(F.col("__new"), "created").otherwise("existing").alias("outcome"))
        raise RuntimeError(f"{TRIES} other writers were first")

    def merge(self, updates: DataFrame, resolve: dict[str, Callable[[Column, Column], Column]] | None = None, add: bool = False) -> int:
        """Sets the columns of ``updates`` in rows of equal key, or what ``resolve`` makes of the old and the new value; with ``add`` keys that
        aren't there come in. Only parts with such rows are written anew. Gives the version. Repeating it changes nothing, if ``resolve`` doesn't."""
        resolve = resolve or {}
        batch = self._batch(updates)
        for _ in range(TRIES):
            version, state = self.state()
            state["schema"] = state["schema"] or json.loads(updates.schema.json())
            new = batch.select(F.col(name(self.key)).alias("__key"), *(F.col(name(c)).alias(f"__new {c}") for c in updates.columns if c != self.key))
            same = F.col(name(self.key)).eqNullSafe(F.col("__key"))
            near = self.rows(state, self.candidates(state, batch), [self.key])
            met = sorted([r["__write"], r["__bucket"]] for r in near.join(new.select("__key"), same, "left_semi").select("__write", "__bucket").distinct().collect())
            old = self.rows(state, met)
            there = F.col("__there").isNotNull()
            value = lambda c: resolve[c](F.col(name(c)), F.col(f"`__new {c}`")) if c in resolve else F.col(f"`__new {c}`")
            rows = old.join(new.withColumn("__there", F.lit(True)), same, "left").select(*(F.when(there, value(c)).otherwise(F.col(name(c))).alias(c) if c in updates.columns and c != self.key else F.col(name(c)) for c in old.columns))
            if add:
                others = batch.join(old.select(F.col(name(self.key)).alias("__key")), same, "left_anti")
                rows = rows.unionByName(others, allowMissingColumns=True)
            elif not met:
                return version
            state["parts"] = [p for p in state["parts"] if p not in met] + self._stage(state, rows.select(*(name(c) for c in old.columns)))
            if self._commit(version, state):
                return version + 1
        raise RuntimeError(f"{TRIES} other writers were first")

    def _commit(self, version: int, state: dict) -> bool:
        return commit(self.spark, f"{self.path}/versions", version + 1, json.dumps(state))

