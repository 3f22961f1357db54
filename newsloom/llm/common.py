"""Helpers that the operators of this subpackage share: shared-folder tables, words and shingle hashes, slices of batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: White space as the word and line contracts state it: space, tab, LF, VT, FF, CR.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
MIX_A, MIX_B, MIX_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of text that a task turns into Python objects at once (or one text).
SLICE_BYTES = 4_000_000


class Scratch:
    """Tables in the folder that the cluster names in ``spark.checkpoint.dir``.

    A written table cuts the lineage: it survives lost executors, because every executor reaches that folder. Where the
    setting is absent a folder of our own is made in local mode (tests); on a cluster that is an error, as executors would
    write to disks of their own. A table goes when its reader says so (``drop``); what a lazy result still reads stays, and
    is the folder's owner's to clear, as with Spark's own checkpoints.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, context = spark, spark.sparkContext
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not base:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="newsloom-")
            context.setCheckpointDir(base)
        self.base = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    h = (h ^ (h >> np.uint64(27))) * MIX_C
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, with a memory of those seen: most words come again. It's emptied at ``limit`` words or ``most_bytes``."""

    def __init__(self, limit: int = 300_000, most_bytes: int = 16_000_000):
        import xxhash

        self.hash, self.known, self.limit, self.most_bytes, self.held = xxhash.xxh3_64_intdigest, {}, limit, most_bytes, 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, fresh = self.known, self.hash
        if len(known) > self.limit or self.held > self.most_bytes:
            known.clear()
            self.held = 0
        for w in set(words).difference(known):
            known[w] = fresh(w)
            self.held += len(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; of the whole sequence where it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = mix(out * MIX_A + hashes[k : n - width + 1 + k])
    return out


def shingle_set(text: bytes | None, hasher: WordHasher, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text: words are runs without ASCII white space, A-Z lower-cased."""
    return np.unique(shingles(hasher(text.lower().split()), width)) if text else np.empty(0, np.uint64)


def as_bytes(column) -> list[bytes | None]:
    """A string column's values as UTF-8, without decoding them."""
    import pyarrow as pa

    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def in_slices(sizes, most: int):
    """Slices of a batch whose sizes come to about ``most``, so that what is made of long rows doesn't add up."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= most or i + 1 == len(sizes):
            yield start, i + 1
            start, total = i + 1, 0


def sliced(batches, column: int, most: int = SLICE_BYTES):
    """The batches in slices of about ``most`` bytes of the text in ``column``; an empty batch as it is."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        for a, b in in_slices(pc.binary_length(batch.column(column)).to_pylist(), most):
            yield batch.slice(a, b - a)


def tidy(run):
    """``run`` for ``mapInArrow``, giving unused memory back to the machine at the task's end: a Python worker lives on for later stages."""

    def out(batches):
        yield from run(batches)

        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not with this C library
            pass

    return out


def quoted(name: str) -> str:
    """A column's name for ``select``, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over a frame whose columns may have any names: they're numbered, and ``schema`` names the result's."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(tidy(run), schema)
