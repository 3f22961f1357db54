"""Readers over offline payloads, with one schema for all sources, and each source's predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import html as H
from newsloom.functions import text as X
from newsloom.functions.urls import fetch_url, host_in
from newsloom.operators.rank import first_per
from newsloom.sources import dims
from newsloom.streaming.stream import shared_folder

ARTICLE = "ordinal long, title string, url string, source string, category array<string>, score int, summary string, published_at timestamp, fetched_at timestamp, abstract string, crowd_score double, notion_url string, lang string, kind string"
FEED_ITEM = "feed string, title string, link string, contentSnippet string, content string, isoDate string, pubDate string, extensions map<string,string>"
FEED_CONFIG = "feed string, url string, keywords array<string>, max_age_days int, crowd_field string, min_crowd double"
HN_HIT = "objectID string, title string, url string, points int, num_comments int, created_at string, story_text string"
PAPER = "title string, publishedAt string, paper struct<id:string,title:string,summary:string,publishedAt:string>"
STORY = "title string, url string, score int, comment_count int, description_plain string, description string, created_at string, tags array<string>"
POST = "title string, url string, likes_count int, created_at string, body string, tags array<struct<name:string>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows; a missing file is empty, a corrupt one fails when read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON rows, and the lines that are none (``line``), apart."""
    lines = spark.read.text(path).filter(X.js_trim(F.col("value")) != "")
    rows = lines.select(F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r")).select("r.*")
    return rows.filter("__bad IS NULL").drop("__bad"), rows.filter("__bad IS NOT NULL").select(F.col("__bad").alias("line"))


def fetched(spark: SparkSession, sources: list[Callable[[], DataFrame]]) -> tuple[list[DataFrame], DataFrame]:
    """What each source gives, and ``source`` (its number), ``error``, ``detail`` of those that fail, when they're planned or while they're read.

    A source is read once, into the shared folder, so that later steps see the same rows, and one that breaks leaves nothing."""
    frames, failed, folder = [], [], shared_folder(spark, "fetched")
    for k, read in enumerate(sources):
        try:
            df = read()
            df.write.parquet(f"{folder}/{k}")
            frames.append(spark.read.schema(df.schema).parquet(f"{folder}/{k}"))
        except Exception as e:  # noqa: BLE001
            failed.append((k, type(e).__name__, str(e).split("\n")[0][:300]))
    return frames, spark.createDataFrame(failed, "source int, error string, detail string")


def rss(spark: SparkSession, path: str, feed: str, crowd_field: str | None = None) -> DataFrame:
    """Items of an RSS or RDF file; the extension element that the feed's configuration names is kept."""
    extra = f", `{crowd_field}` string" if crowd_field else ""
    items = spark.read.format("xml").option("rowTag", "item").schema(f"title string, link string, description string, pubDate string, `dc:date` string{extra}").load(path)
    named = F.create_map(F.lit(crowd_field), F.col(f"`{crowd_field}`")) if crowd_field else F.lit(None)
    return items.select(F.lit(feed).alias("feed"), "title", "link", F.col("description").alias("contentSnippet"), F.lit(None).cast("string").alias("content"), F.col("`dc:date`").alias("isoDate"), "pubDate", named.cast("map<string,string>").alias("extensions"))


def atom(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Entries of an Atom file; of several links the alternate one, else the first."""
    schema = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, published string, updated string"
    entries = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    link = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))
    nothing = F.lit(None).cast("string")
    return entries.select(F.lit(feed).alias("feed"), "title", link["_href"].alias("link"), F.col("summary").alias("contentSnippet"), "content", F.coalesce("published", "updated").alias("isoDate"), nothing.alias("pubDate"), F.lit(None).cast("map<string,string>").alias("extensions"))


def fetch_failure(status: Column, content_type: Column, error: Column) -> Column:
    """Why a fetched payload is no article body, or null: the error's kind, an HTTP status that isn't 2xx, or another content type."""
    text = F.coalesce(content_type.contains("text/html") | content_type.contains("text/plain"), F.lit(False))
    return F.when(error.isin("TimeoutError", "AbortError"), "timeout").when(error.isNotNull(), "network_error").when(~F.coalesce(status.between(200, 299), F.lit(False)), "http_error").when(~text, "unsupported_content_type")


def fetched_bodies(payloads: DataFrame, headless: list[str]) -> DataFrame:
    """``page_id``, ``method`` (headless for listed domains), ``paragraphs``, ``reason`` of fetched payloads (``url``, ``status``, ``content_type``,
    ``error``, ``html``): failures are typed, never raised, and only good payloads are parsed."""
    why = fetch_failure(F.col("status"), F.col("content_type"), F.col("error"))
    rows = payloads.select("page_id", F.when(host_in(F.col("url"), headless), "headless").otherwise("http").alias("method"), why.alias("why"), F.when(why.isNull(), F.col("html")).alias("html"))
    rows = rows.withColumn("b", H.body("html"))
    return rows.select("page_id", "method", F.when(F.col("why").isNull(), F.col("b.paragraphs")).otherwise(F.array().cast("array<string>")).alias("paragraphs"), F.coalesce("why", "b.reason").alias("reason"))


def page_bodies(fetched: DataFrame, most: int = 6000) -> DataFrame:
    """``page_id``, ``body`` and ``reason`` of ``fetched_bodies``: paragraphs joined by blank lines, the first ``most`` characters; null where there are none."""
    body = F.substring(F.array_join("paragraphs", "\n\n"), 1, most)
    return fetched.select("page_id", F.when(F.size("paragraphs") > 0, body).alias("body"), "reason")


def keyword_or_none(text: Column, keywords: Column) -> Column:
    """For keywords in a column: those over three characters as substrings, others with an ASCII word boundary."""
    low = F.lower(text)

    def one(k: Column) -> Column:
        k = F.lower(k)
        quoted = F.regexp_replace(k, r"([^a-z0-9_\s])", r"\\$1")
        left = F.when(k.rlike("^[a-z0-9_]"), r"(?<![a-zA-Z0-9_])").otherwise("")
        right = F.when(k.rlike("[a-z0-9_]$"), r"(?![a-zA-Z0-9_])").otherwise("")
        return (k != "") & F.when(F.length(k) > 3, low.contains(k)).otherwise(F.regexp_like(low, F.concat(left, quoted, right)))

    return F.exists(keywords, one)


def feed_articles(items: DataFrame, config: DataFrame, now: Column) -> DataFrame:
    """Feed items that pass their feed's predicates. The config is one row a feed of a stated list, so it's broadcast; feeds of one name share their rules."""
    rows = items.join(F.broadcast(config.drop("url").distinct()), "feed")
    title, link = X.js_trim(F.coalesce("title", F.lit(""))), X.js_trim(F.coalesce("link", F.lit("")))
    crowd = X.crowd_number(F.element_at("extensions", F.col("crowd_field")))
    published = F.coalesce(X.parse_date(F.col("isoDate")), X.parse_date(F.col("pubDate")))
    rows = rows.withColumns({"t": title, "l": link, "crowd": crowd, "published": published})
    text = F.concat("t", F.lit(" "), F.coalesce("contentSnippet", F.lit("")))
    ok = (F.col("t") != "") & (F.col("l") != "") & (F.coalesce(F.size("keywords"), F.lit(0)) < 1) | (F.col("t") != "") & (F.col("l") != "") & keyword_or_none(text, F.col("keywords"))
    popular = F.col("min_crowd").isNull() | F.coalesce(F.col("crowd") >= F.col("min_crowd"), F.lit(False))
    age = F.col("published").isNull() | F.col("max_age_days").isNull() | (now.cast("timestamp").cast("double") - F.col("published").cast("double") <= F.col("max_age_days") * 86400)
    abstract = F.substring(F.coalesce("contentSnippet", "content", F.lit("")), 1, 1000)
    return rows.filter(ok & popular & age).select(F.col("t").alias("title"), fetch_url(F.col("l")).alias("url"), F.col("feed").alias("source"), F.col("published").alias("published_at"), abstract.alias("abstract"), F.col("crowd").alias("crowd_score"))


def fresh_post(likes: Column, created: Column, now: Column, least: int = 3, days: int = 7) -> Column:
    return (likes >= least) & (created.isNull() | (created >= now - F.expr(f"interval {days} days")))


def hacker_news(hits: DataFrame, now: Column, cap: int = 30, least: int = 50) -> DataFrame:
    """Stories of the last 24 hours, the first of each URL, in order of arrival."""
    recent = X.parse_date(F.col("created_at")).cast("double") > now.cast("timestamp").cast("double") - 86400
    rows = hits.filter(recent & F.col("url").isNotNull() & (F.col("points") >= least) & X.matches_keyword(F.col("title"), dims.KEYWORDS))
    rows = first_per(rows, ["url"], F.col("ordinal")).orderBy("ordinal").limit(cap)
    return rows.select("ordinal", "title", "url", F.lit("Hacker News").alias("source"), X.parse_date(F.col("created_at")).alias("published_at"), F.substring(F.coalesce("story_text", F.lit("")), 1, 500).alias("abstract"), F.col("points").cast("double").alias("crowd_score"))


def papers(rows: DataFrame) -> DataFrame:
    p = F.col("paper")
    return rows.select("ordinal", F.coalesce(p["title"], "title").alias("title"), F.concat(F.lit("https://huggingface.co/papers/"), p["id"]).alias("url"), F.lit("HuggingFace").alias("source"), X.parse_date(F.coalesce(p["publishedAt"], "publishedAt")).alias("published_at"), F.substring(F.coalesce(p["summary"], F.lit("")), 1, 1000).alias("abstract"))


def tagged(tags: Column, text: Column, wanted: tuple[str, ...] = ("ai", "ml", "nlp"), keywords: list[str] | None = None) -> Column:
    return F.arrays_overlap(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower), F.array(*(F.lit(w) for w in wanted))) | X.matches_keyword(text, keywords or dims.KEYWORDS)


def lobsters(stories: DataFrame, cap: int = 20, least: int = 5) -> DataFrame:
    rows = stories.filter((F.coalesce("url", F.lit("")) != "") & (F.col("score") >= least) & tagged(F.col("tags"), F.col("title"))).orderBy("ordinal").limit(cap)
    return rows.select("ordinal", "title", "url", F.lit("Lobsters").alias("source"), X.parse_date(F.col("created_at")).alias("published_at"), F.substring(F.coalesce("description_plain", F.lit("")), 1, 500).alias("abstract"), F.col("score").cast("double").alias("crowd_score"))


def qiita(posts: DataFrame, now: Column, cap: int = 20) -> DataFrame:
    created = X.parse_date(F.col("created_at"))
    rows = posts.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & fresh_post(F.col("likes_count"), created, now))
    rows = first_per(rows, ["url"], F.col("ordinal")).orderBy(F.desc("likes_count"), "ordinal").limit(cap)
    return rows.select("ordinal", "title", "url", F.lit("Qiita").alias("source"), created.alias("published_at"), X.collapse(F.coalesce("body", F.lit("")), 500).alias("abstract"), F.col("likes_count").cast("double").alias("crowd_score"))


def listing(pages: DataFrame, base: str, source: str) -> DataFrame:
    """Articles linked from listing pages (``ordinal``, ``html``), the first of each URL."""
    rows = pages.select("ordinal", F.posexplode(H.links("html")).alias("i", "a")).select((F.col("ordinal") * 10_000 + F.col("i")).alias("ordinal"), F.col("a.title").alias("title"), F.concat(F.lit(base), F.col("a.href")).alias("url"), F.lit(source).alias("source"), X.parse_date(F.col("a.date")).alias("published_at"), F.col("a.description").alias("abstract"))
    return first_per(rows, ["url"], F.col("ordinal"))


def trending(pages: list[DataFrame], cap: int = 20) -> DataFrame:
    """Repositories of one page a language: AI ones, at most ``cap`` a language, without those that earlier languages kept."""
    kept = None
    for k, page in enumerate(pages):
        rows = page.select(F.posexplode(H.repositories("html")).alias("i", "r")).select((F.col("i") + k * 1000).cast("long").alias("ordinal"), "r.*")
        rows = rows.filter(X.matches_keyword(F.concat("full_name", F.lit(" "), "description"), dims.KEYWORDS))
        rows = rows.join(kept.select("url"), "url", "left_anti") if kept is not None else rows
        rows = rows.orderBy("ordinal").limit(cap).select("ordinal", "url", "full_name", "description", "language", "period_stars")
        kept = rows if kept is None else kept.unionByName(rows)
    return kept


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources in order, their ordinals kept apart; a source whose reader failed is left out before this."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("ordinal", F.col("ordinal") + F.lit(k) * 1_000_000_000_000)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def latest_by_id(pages: DataFrame, key: str = "id", version: str = "ordinal") -> DataFrame:
    """A full scan with overlaps: the last row of each id."""
    return pages.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*pages.columns), version).alias("r")).select("r.*")


def recoverable(snapshot: DataFrame, queued: DataFrame) -> DataFrame:
    """Pages of a snapshot that aren't queued, by id without hyphens; no Japanese ones."""
    plain = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    return snapshot.filter(~F.col("lang").eqNullSafe("ja") & plain("id").rlike("^[0-9a-f]{32}$")).withColumn("page_key", plain("id")).join(queued.select(plain("id").alias("page_key")), "page_key", "left_anti")


def feed_list(queries: list[str], template: str) -> list[str]:
    """Generated feeds: a URL for each query, percent-encoded."""
    from urllib.parse import quote

    return [template.format(q=quote(q, safe="!*'()")) for q in queries]


def feed_config(spark: SparkSession) -> DataFrame:
    """The configuration of all feeds, the generated ones included."""
    rows = [(name, url, keywords, days, None, None) for name, url, keywords, days in dims.FEEDS]
    rows += [("Hatena", u, dims.KEYWORDS_JA, dims.GENERATED_DAYS, dims.HATENA_FIELD, dims.HATENA_LEAST) for u in feed_list(dims.HATENA_QUERIES, dims.HATENA_URL)]
    rows += [("Zenn", u, None, dims.GENERATED_DAYS, None, None) for u in feed_list(dims.ZENN_TOPICS, dims.ZENN_URL)]
    return spark.createDataFrame(rows, FEED_CONFIG)


def ordinals(df: DataFrame, *order: Column) -> DataFrame:
    """Numbers from 0 by an order, for sources without one. Sorted by ranges, written once; a row's number is its place in its range and the
    number of rows in those before, of which there's one count for each range."""
    spark = df.sparkSession
    path = shared_folder(spark, "ordinals")
    place = F.monotonically_increasing_id()
    df.orderBy(*order).withColumn("__place", place).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema, T.StructField("__place", T.LongType())])).parquet(path)
    part = F.shiftright("__place", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # as many rows as ranges
    numbered = rows.join(F.broadcast(before), part == F.col("__part"))
    return numbered.withColumn("ordinal", F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__place")
