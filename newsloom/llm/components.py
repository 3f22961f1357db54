"""Connected components of a graph given by edges, in rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch


#: Keys that may count as hubs, and the rows that a hub has at least.
MOST_HUBS, HUB_ROWS = 1000, 1000


def with_least(rows: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """The rows with ``m`` and ``n``: the least ``value`` of their key, and the rows that have it.

    A key of a third of all rows doesn't gather in a task: groups are counted before the shuffle, and keys of more than
    ``total`` / ``MOST_HUBS`` rows (so there are ``MOST_HUBS`` at most) are broadcast, so that their rows stay where they are.
    Rows with a null key are dropped; values may not be null. ``rows`` is read three times: a written table is best.
    """
    groups = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n"))
    is_hub = F.col("n") > max(HUB_ROWS, total // MOST_HUBS)
    marked = rows.join(F.broadcast(groups.filter(is_hub)), key, "left")
    rest = marked.filter("m IS NULL").drop("m", "n").join(groups.filter(~is_hub), key)
    return marked.filter("m IS NOT NULL").unionByName(rest)


def _least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v) pairs with ``m``, the least of u and its partners."""
    return with_least(pairs, "u", "v", total).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``node``, ``root`` (the least node reachable) for all nodes of the edges ``a``, ``b``.

    Each star is a written table: two exchanges each, hubs' rows stay where they are, no driver-side list, and a number
    of rounds that grows with the logarithm of the nodes. Loops and repeated edges do no harm; null ends are dropped.
    """
    now = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = scratch.write(now, f"{name}0"), None
    total = 2 * now.count()
    for k in range(1, 1000):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.filter("u <> v").distinct(), f"{name}-large{k}")
        small = _least(large, total)
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = scratch.write(small.filter("u <> v").distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}", f"{name}-large{k}")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if state == last:
            break
        last, total = state, 2 * state[0]
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
