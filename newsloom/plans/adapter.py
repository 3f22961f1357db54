"""The driver's tables seen as articles, in Spark and in SQL alike. The clock is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-08 00:00:00"  # the events that meet documents are of the first days of January
# 20 stand-ins for sources, their languages, kinds, weights and crowd scales.
DIM = [(f"src{i}", "en", "primary" if i < 12 else "secondary", w, s) for i, (w, s) in enumerate([(80, 1.0), (80, 1.0), (70, 1.0), (70, 1.0), (60, 1.0), (60, 1.0), (50, 1.0), (50, 1.0), (40, 1.0), (40, 1.0), (35, 1.0), (25, 1.0), (65, 1.0), (60, 1.0), (55, 1.0), (50, 0.5), (30, 5.0), (20, 1.0), (25, 1.5), (20, 4.0)])]
BONUS = [(["that", "with"], 15), (["tion"], 10), (["que", "der"], 5)]
CATEGORIES = [("English", ["the ", "that"]), ("French", [" les ", " une "]), ("German", [" und ", " der "]), ("Release", ["release", "this"]), ("English", ["with"])]


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIM, "source string, lang string, kind string, weight int, crowd_scale double")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, with a page's URL and an event's value and time each; joined by keys, sides chosen by the planner. The other tables are
    joined first, for the documents' ids only, so that texts move once at most."""
    docs, pages, events, labels = (table(spark, sf_dir, t) for t in ("documents", "pages", "events", "labels"))
    n = pages.count()
    near = events.select(F.col("event_id").alias("ordinal"), "value", "ts").join(docs.select(F.col("doc_id").alias("ordinal")), "ordinal", "left_semi")
    near = near.withColumn("page_id", F.pmod("ordinal", F.lit(max(1, n)))).join(pages.select("page_id", "url"), "page_id").drop("page_id")
    docs = docs.select(F.col("doc_id").alias("ordinal"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), "source", "lang")
    rows = docs.join(near, "ordinal")
    flags = labels.select(F.col("doc_id").alias("ordinal"), "quality", "toxic")
    status = F.when(F.col("quality") == 1, "Starred").when(F.col("toxic") == 1, "Read").otherwise("Unread")
    rows = rows.join(flags, "ordinal", "left")
    published = F.col("ts") - F.make_dt_interval(days=F.pmod("ordinal", F.lit(10)).cast("int"))
    return rows.select(
        "ordinal", "title", "url", "source", "abstract", "lang", F.lit(0).alias("score"),
        F.when(F.col("ordinal") % 5 != 0, F.col("value")).alias("crowd_score"), F.col("ts").alias("fetched_at"),
        F.when(F.col("ordinal") % 17 != 0, published).alias("published_at"), status.alias("status"),
    )


def _any(text: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{k}')" for k in keywords) + ")"


DIM_SQL = "(VALUES " + ", ".join(f"('{s}', '{k}', {w}, CAST({c} AS DOUBLE))" for s, _, k, w, c in DIM) + ") AS dim(source, kind, weight, crowd_scale)"
#: Articles, scored articles and their dedup keys as common table expressions.
HOST = "regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"
PATH = "regexp_replace(regexp_extract({0}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/$', '')"
PAIRS = "list_sort(list_filter(string_split(regexp_extract({0}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_full_match(split_part(p, '=', 1), 'utm_.*|ref|fbclid|gclid')))"


def key_sql(url: str) -> str:
    pairs = PAIRS.format(url)
    return f"{HOST.format(url)} || {PATH.format(url)} || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END"


ART_SQL = f"""
art AS (
  SELECT d.doc_id AS ordinal, split_part(d.text, chr(10), 1) AS title, d.text AS abstract, p.url, d.source, d.lang,
    CASE WHEN d.doc_id % 5 <> 0 THEN e.value END AS crowd_score, e.ts AS fetched_at,
    CASE WHEN d.doc_id % 17 <> 0 THEN e.ts - to_days(CAST(d.doc_id % 10 AS INTEGER)) END AS published_at,
    CASE WHEN l.quality = 1 THEN 'Starred' WHEN l.toxic = 1 THEN 'Read' ELSE 'Unread' END AS status
  FROM documents d JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages) JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id),
texts AS (SELECT *, lower(title || ' ' || abstract) AS low, {key_sql("url")} AS url_key FROM art),
scored AS (
  SELECT t.*, dim.kind, coalesce(dim.weight, 30) AS base,
    {" + ".join(f"CASE WHEN {_any('low', ks)} THEN {b} ELSE 0 END" for ks, b in BONUS)} AS bonus,
    CASE WHEN crowd_score > 0 THEN least(60, CAST(round(18 * log10(crowd_score * coalesce(crowd_scale, 1) + 1)) AS INTEGER)) ELSE 0 END AS crowd,
    coalesce(nullif(array_to_string(list_filter([{", ".join(f"CASE WHEN {_any('low', ks)} THEN '{n}' END" for n, ks in CATEGORIES[:-1])}], lambda x: x IS NOT NULL), ','),
      ''), CASE WHEN contains(low, 'with') THEN 'English' END, 'Other') AS cats0
  FROM texts t LEFT JOIN {DIM_SQL} USING (source)),
full_ AS (
  SELECT *, base + bonus + crowd AS score,
    CASE WHEN contains(low, 'with') AND NOT list_contains(string_split(cats0, ','), 'English') THEN cats0 || ',English' ELSE cats0 END AS categories FROM scored),
best AS (
  SELECT * EXCLUDE (rn, first_), first_ AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY coalesce(crowd_score, 0) DESC, ordinal) AS rn, min(ordinal) OVER (PARTITION BY url_key) AS first_ FROM full_)
  WHERE rn = 1)"""
