"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table; shards take turns (heavier
ones more often) to claim the first slot of their order that's still free, until all are taken. The table
depends on the shards alone, never on the data, so its size is a parameter; broadcast, it places any key in
constant time, and when a shard goes almost all keys of the others stay.

A null key is a key like any other. Equal keys go to one shard; ``salt`` spreads the rows of hot keys over
some shards, by further columns. Repeated rows go where the first does; empty tables stay empty; other columns
of any name pass through, but one named like the output; the length of texts doesn't matter, as only keys are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import quoted

#: A prime; at most this many rows are ever broadcast.
SLOTS = 65_537


def fill_table(shards: list[str], weights: list[float] | None = None, slots: int = SLOTS) -> np.ndarray:
    """The index of the owning shard for each slot. ``slots`` must be prime and no less than the shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, each once")
    if slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, math.isqrt(slots) + 1)):
        raise ValueError("slots must be a prime, no less than the number of shards")
    weights = weights or [1.0] * len(shards)
    if len(weights) != len(shards) or min(weights) <= 0:
        raise ValueError("each shard needs a weight above zero")
    share = [w / max(weights) for w in weights]
    offset, skip = [], []
    for name in shards:
        seed = hashlib.sha256(str(name).encode()).digest()
        offset.append(int.from_bytes(seed[:8], "big") % slots)
        skip.append(int.from_bytes(seed[8:16], "big") % (slots - 1) + 1)
    owner, place, due, left = np.full(slots, -1, np.int32), list(offset), [0.0] * len(shards), slots
    while left:
        for k in range(len(shards)):
            due[k] += share[k]
            if due[k] < 1 or not left:
                continue
            due[k] -= 1
            while owner[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            owner[place[k]] = k
            left -= 1
    return owner


def key_slot(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, the same on every machine and in every run."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(df: DataFrame, keys: list[str], shards: list[str], weights: list[float] | None = None, salt: list[str] | None = None, spread: int = 1, out: str = "shard", slots: int = SLOTS) -> DataFrame:
    """Adds ``out``, the name of each row's shard. With ``salt`` a key's rows go to ``spread`` places, by those columns."""
    owner = fill_table(shards, weights, slots)
    table = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string")
    by = [F.col(quoted(k)) for k in keys]
    if salt:
        by.append(F.pmod(F.xxhash64(*(F.col(quoted(k)) for k in salt)), F.lit(spread)))
    kept = [c for c in df.columns if c.lower() != out.lower()]
    # numbered, as columns may have any names
    rows = df.select(*map(quoted, kept), key_slot(*by, slots=slots)).toDF(*(f"c{i}" for i in range(len(kept))), "slot")
    return rows.join(F.broadcast(table), "slot").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("shard").alias(out))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files: int = 8) -> None:
    """One directory per shard, each in about ``files`` files: a shard isn't gathered in a single task. A row's file is a hash of the
    row, so that what a lost executor had is dealt alike again; maps can't be hashed and are left out of it."""
    hashed = [F.col(quoted(f.name)) for f in placed.schema if "map<" not in f.dataType.simpleString()]
    placed.repartition(F.col(quoted(shard)), F.pmod(F.xxhash64(*hashed), F.lit(files))).write.partitionBy(shard).mode("overwrite").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot, its shard of 64, and its shard once ``shard-63`` is gone."""
    names = [f"shard-{i:02d}" for i in range(64)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    docs = place(docs, ["doc_id"], names)
    docs = place(docs, ["doc_id"], names[:-1], out="shard_after_loss")
    return docs.select("doc_id", key_slot(F.col("doc_id")).alias("slot"), "shard", "shard_after_loss")
