"""The replayable priority queue: merge of backlog and new articles, bounded work, idempotent saving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import spellings, url_key
from newsloom.operators.keyed import Keyed
from newsloom.operators.rank import dedup_by_url


def recent(published: Column, now: Column, days: int = 7) -> Column:
    """The fresh lane: published before now, under so many days ago. Undated and future rows aren't in it."""
    return F.coalesce((published <= now) & (published > now - F.expr(f"interval {days} days")), F.lit(False))


def merge_pending(backlog: DataFrame, incoming: DataFrame, confirmed: DataFrame, now: Column) -> DataFrame:
    """Backlog first, then new articles; the best of each URL key keeps the backlog's fetch time; confirmed keys go; the fresh lane comes first."""
    first = backlog.withColumn("url_key", url_key(F.col("url"))).groupBy("url_key").agg(F.min_by(F.struct("fetched_at", "published_at"), "ordinal").alias("orig"))
    offset = backlog.agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).first()[0]
    both = backlog.unionByName(incoming.withColumn("ordinal", F.col("ordinal") + offset), allowMissingColumns=True)
    best = dedup_by_url(both).join(confirmed.select("url_key").distinct(), "url_key", "left_anti").join(first, "url_key", "left")
    best = best.withColumn("fetched_at", F.coalesce("orig.fetched_at", "fetched_at")).withColumn("published_at", F.coalesce("orig.published_at", "published_at")).drop("orig")
    return two_lanes(best, now)


def two_lanes(df: DataFrame, now: Column) -> DataFrame:
    lane = recent(F.col("published_at"), now)
    return df.withColumn("recent", lane).orderBy(F.desc("recent"), F.when(F.col("recent"), F.col("published_at")).desc(), F.when(F.col("recent"), F.col("score")).desc(), "ordinal")


def unsaved(candidates: DataFrame, saved: DataFrame, key: str = "url_key") -> DataFrame:
    return candidates.join(saved.select(key), key, "left_anti")


def existing(candidates: DataFrame, pages: DataFrame, key: str = "url_key") -> DataFrame:
    return candidates.join(pages.select(key), key, "left_semi")


def lookup(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id`` of the first page stored under any spelling of each URL; URLs without one aren't in the result. Nine spellings at most, so the join's left side is bounded by the batch."""
    spelled = urls.select("url").distinct().select("url", F.explode(F.array_distinct(F.concat(spellings(F.col("url")), F.array("url")))).alias("spelling"))
    stored = pages.select(F.col("url").alias("spelling"), "page_id", "ordinal")
    return spelled.join(stored, "spelling").groupBy("url").agg(F.min_by("page_id", "ordinal").alias("page_id"))


def within_budget(df: DataFrame, cost: str, budget: float, partition: list[str], *order: Column) -> DataFrame:
    """Rows of each partition, in order, until their summed cost passes the budget."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def before_overflow(df: DataFrame, size: str, budget: int, partition: list[str], *order: Column) -> DataFrame:
    """Rows before the first that would overflow; unlike a filter, nothing after it comes back."""
    return within_budget(df, size, budget, partition, *order)


def bounded_fifo(df: DataFrame, eligible: Column, limit: int = 10) -> DataFrame:
    """The first eligible rows; others don't count."""
    return df.filter(eligible).orderBy("ordinal").limit(limit)


def save_new(batch: DataFrame, table: DataFrame, key: str = "url_key") -> DataFrame:
    """``outcome`` created or existing for each key of a batch, once: insert-if-absent, safe to repeat."""
    one = batch.groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    return one.join(table.select(key, F.lit(True).alias("there")).distinct(), key, "left").select(key, "ordinal", F.when(F.col("there"), "existing").otherwise("created").alias("outcome"))


def outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("outcome").agg(F.count("*").alias("n"))


def confirm(confirmed: DataFrame, saved: DataFrame) -> DataFrame:
    return confirmed.select("url_key").union(saved.select("url_key")).distinct()


def sink(path: str, key: str = "url_key", buckets: int = 64, stream: str = "sink") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: adds rows whose key isn't in the table yet, of a key the least row. A batch reads only parts of the table that may
    hold one of its keys, and one that was committed before adds nothing, so a replay leaves the same bytes."""

    def write(batch: DataFrame, epoch: int) -> None:
        Keyed(batch.sparkSession, path, key, buckets).insert(batch, stream, epoch)

    return write
