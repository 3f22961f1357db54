"""Embedding whitening from an exact integer scatter.

A vector's entries become integers, floor(256 c). The fit list holds each distinct integer vector once. Every task subtracts a shift of
its own (a vector near its rows), multiplies what's left in float64 as long as that is exact, and in Python's integers where it isn't,
takes the shift back in integers, and gives sums and cross-products as 32-bit limbs. Spark sums the limbs, so that no total can
overflow; from them the driver forms n XtX - S St exactly, and only then divides by n squared and calls ``eigh``. What the driver
gets grows with the square of the dimension, not with the rows. Rows are whitened where they are.

Rows whose vector is null or holds null or non-finite entries are left out. Integers beyond 64 bits become the nearest that fit.
Vectors of another length are a space of their own, with its own fit; empty vectors have no components and give no rows. A component
without variance has no whitened value (null), and without any variance ``explained`` is null too. Repeated rows are given each, null
ids stay null, other columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, quoted, tidy

SCALE = 256
#: Rows of a batch that are multiplied at once, and the largest shifted entry for which float64 sums of so many products are exact.
BLOCK = 1 << 12
EXACT = 1 << 20
#: Entries beyond this aren't shifted in 64 bits.
WIDE = 1 << 61
#: Components that are written for each row.
TOP = 4


def usable(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda c: finite(c.cast("double")))


def integers(vector: Column) -> Column:
    """The entries as 64-bit integers: floor of ``SCALE`` times each, cut to what fits."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def matrices(column, sizes: np.ndarray):
    """(dimension, rows' places, matrix) for each length in an Arrow list column of integers."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        if d:
            yield int(d), rows, flat[at[rows][:, None] + np.arange(d)]


class Sums:
    """Exact sums of vectors and their cross-products, about a shift."""

    def __init__(self, d: int):
        self.n, self.shift = 0, None
        self.sums, self.products = np.zeros(d, object), np.zeros((d, d), object)

    def add(self, x: np.ndarray) -> None:
        for a in range(0, len(x), BLOCK):
            self._block(x[a : a + BLOCK])

    def _block(self, x: np.ndarray) -> None:
        if self.shift is None:
            self.shift = np.zeros(x.shape[1], np.int64) if np.abs(x.astype(float)).max() >= WIDE else np.floor(x.mean(axis=0, dtype=float)).astype(np.int64)
        self.n += len(x)
        if np.abs(x.astype(float)).max() < WIDE and np.abs(y := x - self.shift).max() < EXACT:
            z = y.astype(np.float64)  # at most 2^12 products below 2^40: all sums are integers that float64 holds
            self.products += (z.T @ z).astype(np.int64).astype(object)
            self.sums += y.sum(axis=0).astype(object)
        else:
            y = x.astype(object) - self.shift.astype(object)
            self.products += y.T.dot(y)
            self.sums += y.sum(axis=0)

    def unshifted(self) -> tuple[int, np.ndarray, np.ndarray]:
        """n, the sums and the cross-products of the vectors as they were."""
        c = self.shift.astype(object)
        both = np.outer(c, self.sums)
        return self.n, self.sums + self.n * c, self.products + both + both.T + self.n * np.outer(c, c)


def limbs(value: int) -> list[int]:
    """Signed base 2^32 digits, lowest first. Sums of two thousand million of them fit in 64 bits."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & 0xFFFFFFFF))
        value >>= 32
    return out


def scatter(fit: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each dimension n, S and n XtX - S St of the vectors in column ``x``, exactly."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, Sums] = {}
        for batch in batches:
            column = batch.column(0)
            for d, _, x in matrices(column, column.value_lengths().to_numpy(zero_copy_only=False)):
                held.setdefault(d, Sums(d)).add(x)
        for d, own in held.items():
            n, s, p = own.unshifted()
            places = [(-1, -1, n), *((i, -1, int(s[i])) for i in range(d)), *((i, j, int(p[i, j])) for i in range(d) for j in range(i + 1))]
            rows = [(d, i, j, k, v) for i, j, value in places for k, v in enumerate(limbs(value))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["d", "i", "j", "limb", "v"])

    parts = fit.select("x").mapInArrow(tidy(run), "d int, i int, j int, limb int, v bigint")
    totals: dict[int, dict] = {}
    for r in parts.groupBy("d", "i", "j", "limb").agg(F.sum("v").alias("v")).collect():  # by the square of the dimension
        own = totals.setdefault(r.d, {})
        own[r.i, r.j] = own.get((r.i, r.j), 0) + (r.v << (32 * r.limb))
    out = {}
    for d, own in totals.items():
        n, s = own[-1, -1], [own.get((i, -1), 0) for i in range(d)]
        out[d] = n, s, [[n * own.get((max(i, j), min(i, j)), 0) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return out


class Fit:
    """A space's mean and components: ``values`` fall, ``vectors`` has one in each column; those without variance have no ``scale``."""

    def __init__(self, n: int, sums: list[int], scattered: list[list[int]]):
        self.n, self.sums = n, np.array(sums, object)
        square = n * n
        cov = np.array([[c / square for c in row] for row in scattered], np.float64)  # each quotient is rounded once
        values, vectors = np.linalg.eigh(cov)
        self.values, self.vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        self.trace = sum(scattered[i][i] for i in range(len(sums))) / square
        self.varied = self.values > self.trace * len(sums) * 2.0**-50
        self.scale = np.sqrt(np.where(self.varied, self.values, 1.0))
        self.narrow = max(map(abs, sums)) < 1 << 61

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly; in 64 bits where that's enough."""
        if self.narrow and np.abs(x.astype(float)).max(initial=0) * self.n < 1 << 61:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, deviations: np.ndarray, top: int) -> np.ndarray:
        out = (deviations.astype(np.float64) / self.n) @ self.vectors[:, :top] / self.scale[:top]
        return np.where(self.varied[:top], out, np.nan)


def squares(deviations: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if deviations.dtype != object and float(np.abs(deviations).max(initial=0)) ** 2 * deviations.shape[1] < 1 << 62:
        return (deviations * deviations).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in deviations.tolist()]


def apply(rows: DataFrame, fits: dict[int, Fit], top: int) -> DataFrame:
    """The rows' other columns with ``dim``, ``n``, ``deviation`` (exact, as text) and ``whitened`` (an array), from ``x``."""
    model = rows.sparkSession.sparkContext.broadcast(fits)  # by the square of the dimension
    names, at = rows.columns, rows.columns.index("x")
    kept = [c for c in names if c != "x"]
    schema = ", ".join([*(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}" for c in kept), "dim int, n bigint, deviation string, whitened array<double>"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(at)
            for d, places, x in matrices(column, column.value_lengths().to_numpy(zero_copy_only=False)):
                own = model.value[d]
                off = own.deviations(x)
                white = own.whitened(off, top)
                k = white.shape[1]
                offsets = pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32))
                others = [batch.column(i).take(pa.array(places)) for i, c in enumerate(names) if c != "x"]
                values = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # NaN as null
                made = [pa.array([d] * len(x), pa.int32()), pa.array([own.n] * len(x), pa.int64()), pa.array([str(v) for v in squares(off)]), pa.ListArray.from_arrays(offsets, values)]
                yield pa.RecordBatch.from_arrays([*others, *made], names=[*kept, "dim", "n", "deviation", "whitened"])

    return rows.mapInArrow(tidy(run), schema)


def identity_errors(spread: DataFrame, fits: dict[int, Fit], top: int) -> dict[int, float]:
    """For each dimension the largest absolute entry of the whitened fit list's covariance, centred, minus the identity."""
    each = [F.get("whitened", F.lit(i)).alias(f"w{i}") for i in range(top)]
    rows = spread.select("dim", *each)
    means = {r.dim: r for r in rows.groupBy("dim").agg(*(F.avg(f"w{i}").alias(f"w{i}") for i in range(top))).collect()}
    if not means:
        return {}
    centre = rows.sparkSession.createDataFrame([(d, *(means[d][f"w{i}"] for i in range(top))) for d in means], "d int, " + ", ".join(f"m{i} double" for i in range(top)))
    centred = rows.join(F.broadcast(centre), F.col("dim") == F.col("d"))  # a row for each dimension
    pairs = [(i, j) for i in range(top) for j in range(i + 1)]
    found = centred.groupBy("dim").agg(*(F.avg((F.col(f"w{i}") - F.col(f"m{i}")) * (F.col(f"w{j}") - F.col(f"m{j}"))).alias(f"c{i}_{j}") for i, j in pairs)).collect()
    return {r.dim: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None), default=0.0) for r in found}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """``id``, ``dim``, ``component`` (from 1), ``n``, ``deviation`` (the exact sum of squares of n x - S, as text), ``whitened``, ``explained``, ``identity_error``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("v")).filter(usable(F.col("v"))).select("id", integers(F.col("v")).alias("x"))
    fit = scratch.write(rows.select("x").distinct(), "fit")
    fits = {d: Fit(*parts) for d, parts in scatter(fit).items()}
    errors = identity_errors(scratch.write(apply(fit, fits, top).select("dim", "whitened"), "spread"), fits, top)
    scratch.drop("fit", "spread")
    facts = [(d, k + 1, float(f.values[k] / f.trace) if f.trace else None, errors[d]) for d, f in fits.items() for k in range(min(top, d))]
    facts = spark.createDataFrame(facts, "d int, component int, explained double, identity_error double")
    each = apply(rows, fits, top).select("id", "dim", "n", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    joined = each.join(F.broadcast(facts), (F.col("dim") == F.col("d")) & (F.col("k") + 1 == F.col("component")))
    return joined.select("id", "dim", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first four components. A deviation beyond 64 bits is null."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
