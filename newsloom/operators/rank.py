"""Deduplication, scoring and selection of articles. Every order has ``ordinal`` as its last key: Spark's sorts aren't stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.urls import url_key
from newsloom.sources import dims


def name(column: str) -> str:
    """A column's name for ``col``, whatever is in it."""
    return "`" + column.replace("`", "``") + "`"


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``. A partial minimum per task goes before the shuffle, so hot keys don't gather."""
    row = F.struct(*(F.col(name(c)) for c in df.columns))
    best = df.groupBy(*(F.col(name(k)).alias(f"__{k}") for k in keys)).agg(F.min_by(row, F.struct(*order)).alias("r"))
    return best.select("r.*")


def dedup_by_url(articles: DataFrame) -> DataFrame:
    """One article per URL key: the highest score, else votes; the earliest of equals. It takes the ordinal of the key's first occurrence."""
    rank = F.when(F.col("score") > 0, F.col("score").cast("double")).otherwise(F.coalesce("crowd_score", F.lit(0.0)))
    keyed = articles.withColumn("url_key", url_key(F.col("url"))).withColumn("__rank", rank)
    row = F.struct(*(F.col(c) for c in articles.columns if c != "ordinal"), "url_key")
    # highest rank, then the lowest ordinal: ids are negated so that one maximum decides both
    best = keyed.groupBy(F.col("url_key").alias("__k")).agg(F.max_by(row, F.struct("__rank", -F.col("ordinal"))).alias("r"), F.min("ordinal").alias("ordinal"))
    return best.select("ordinal", "r.*")


def last_wins(df: DataFrame, key: str, limit: int | None = 10) -> DataFrame:
    """The last row of each key, at the place of its first; then the first ``limit``."""
    row = F.struct(*(F.col(c) for c in df.columns if c != "ordinal"))
    out = df.groupBy(F.col(key).alias("__k")).agg(F.max_by(row, "ordinal").alias("r"), F.min("ordinal").alias("ordinal")).select("ordinal", "r.*").orderBy("ordinal")
    return out.limit(limit) if limit else out


def score(articles: DataFrame, source_dim: DataFrame, bonus_rules=dims.BONUS_RULES, category_rules=dims.CATEGORY_RULES) -> DataFrame:
    """Adds ``base``, ``bonus``, ``crowd``, ``score``, ``category`` and the source's language and kind. The dimension is broadcast: it's one row a source of a fixed list."""
    text = F.concat(F.col("title"), F.lit(" "), F.col("abstract"))
    dim = F.broadcast(source_dim.select("source", F.col("lang").alias("__lang"), F.col("kind").alias("__kind"), "weight", "crowd_scale"))
    kept = [c for c in articles.columns if c not in ("score", "category", "lang", "kind")]
    lang = F.coalesce("__lang", "lang") if "lang" in articles.columns else F.col("__lang")
    out = articles.join(dim, "source", "left").withColumn("__hits", X.rule_hits(text, bonus_rules, category_rules)).select(
        *kept,
        lang.alias("lang"),
        F.col("__kind").alias("kind"),
        F.coalesce("weight", F.lit(dims.DEFAULT_WEIGHT)).alias("base"),
        F.col("__hits.bonus").alias("bonus"),
        X.crowd_bonus(F.col("crowd_score"), F.coalesce("crowd_scale", F.lit(1.0))).alias("crowd"),
        F.col("__hits.category").alias("category"),
    )
    return out.withColumn("score", F.col("base") + F.col("bonus") + F.col("crowd"))


def ranked(scored: DataFrame, min_score: int = dims.MIN_SCORE) -> DataFrame:
    return scored.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "ordinal")


def diverse_top(scored: DataFrame, limit: int, cap: int = dims.PER_SOURCE) -> DataFrame:
    """The best ``limit`` with at most ``cap`` of a source, topped up from the rest; by score, ties as picked.

    No source puts in more than ``limit`` rows, so a hot source is cut (WindowGroupLimit) before its partition is sorted.
    """
    order = Window.partitionBy("source").orderBy(F.desc("score"), "ordinal")
    rows = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit)
    picked = rows.withColumn("over", (F.col("rn") > cap).cast("int")).orderBy("over", F.desc("score"), "ordinal").limit(limit)
    return picked.orderBy(F.desc("score"), "over", "ordinal").drop("rn", "over")


def per_group_top(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).withColumn("rn", F.col("rn").cast("long"))
