"""Listings: facets, pages, month archive, search index and results."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators.rank import per_group_top

# Rows a page, rows a facet, days searched, results shown.
PAGE, FACET, SEARCH_DAYS, RESULTS = 50, 200, 90, 200
INDEX = ["title", "url", "source", "categories", "score", "lang", "kind", "status"]


def display_date(published: Column, fetched: Column) -> Column:
    return F.coalesce(published, fetched)


def order_date(published: Column, fetched: Column) -> Column:
    return F.coalesce(fetched, published)


def by_newest() -> list[Column]:
    return [F.desc_nulls_last("fetched_at"), F.desc("score"), F.asc("ordinal")]


def by_score() -> list[Column]:
    return [F.desc("score"), F.desc_nulls_last("fetched_at"), F.asc("ordinal")]


def front_page(df: DataFrame, k: int = FACET) -> DataFrame:
    return df.orderBy(*by_newest()).limit(k)


def facet_top(df: DataFrame, facet: str, k: int = FACET) -> DataFrame:
    return per_group_top(df, facet, k, *by_score())


def by_category(df: DataFrame) -> DataFrame:
    """A row for each category that's given. (An inner explode would infer a filter on the list, which is then made again at the scan.)"""
    return df.withColumn("category", F.explode_outer("category")).filter(F.col("category").isNotNull())


def paginate(df: DataFrame, facet: str, size: int = PAGE, k: int = FACET) -> DataFrame:
    """``page_no``, ``last_page``, ``prev_page``, ``next_page`` of the rows of each facet, at most ``k`` of them."""
    top = facet_top(df, facet, k)
    last = F.ceil(F.count("*").over(Window.partitionBy(facet)) / size)
    no = F.ceil(F.col("rn") / size)
    return top.withColumn("page_no", no).withColumn("last_page", last).withColumn("prev_page", F.when(F.col("page_no") > 1, F.col("page_no") - 1)).withColumn("next_page", F.when(F.col("page_no") < F.col("last_page"), F.col("page_no") + 1))


def month_archive(df: DataFrame) -> DataFrame:
    """Rows with their month, newest month and row first; ``partitionBy('month')`` writes only the months that change."""
    return df.filter(F.col("fetched_at").isNotNull()).withColumn("month", F.date_format("fetched_at", "yyyy-MM")).orderBy(F.desc("month"), *by_newest())


def month_histogram(df: DataFrame, ts: str = "fetched_at") -> DataFrame:
    n = df.filter(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.lit(0)))  # one row a month
    return n.select("month", "n", F.greatest(F.lit(2), F.floor(100 * F.col("n") / most + 0.5).cast("int")).alias("width"))


def day_groups(pages: DataFrame, page: str = "page_no") -> DataFrame:
    """Runs of equal dates on a page that's sorted by date: counts are the page's own."""
    return pages.groupBy(page, F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"))


def runs(df: DataFrame, partition: str, value: str, *order: Column) -> DataFrame:
    """Runs of equal values in any order (gaps and islands)."""
    w = Window.partitionBy(partition).orderBy(*order)
    start = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    return df.withColumn("run", F.sum(start).over(w)).groupBy(partition, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def export_stats(df: DataFrame, today: Column) -> DataFrame:
    window = F.col("fetched_at") >= today - F.expr(f"interval {SEARCH_DAYS} days")
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "ja").alias("japanese"), F.count_if(window).alias("in_window"), F.countDistinct("source").alias("sources"), F.min("fetched_at").alias("oldest"))


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n"))


def search_index(df: DataFrame, today: Column, days: int = SEARCH_DAYS) -> DataFrame:
    """The searched window with its haystack; no summaries."""
    rows = df.filter(order_date(F.col("published_at"), F.col("fetched_at")) >= today - F.expr(f"interval {days} days"))
    haystack = X.fold(F.concat_ws(" ", "title", "source", F.array_join("category", " ")))
    return rows.select("ordinal", "title", "url", "source", F.array_join("category", ",").alias("categories"), "score", "lang", "kind", "status", "fetched_at", haystack.alias("haystack"))


def search(index: DataFrame, query: str, ja: bool = False, primary: bool = False, starred: bool = False, k: int = RESULTS) -> DataFrame:
    """The best matches, each with the number of all."""
    keep = X.search(F.col("haystack"), unicodedata.normalize("NFKC", query).lower())
    for on, column, value in ((ja, "lang", "ja"), (primary, "kind", "primary"), (starred, "status", "Starred")):
        keep = keep & (F.col(column) == value) if on else keep
    found = index.filter(keep)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("score"), "ordinal").limit(k).join(F.broadcast(total))  # one row


#: Characters of a gram, and of a query's grams the rarest, whose lists are read.
GRAM, LISTS = 3, 3


#: Characters of haystacks whose grams a task sorts at once.
PART_CHARS = 8_000_000


def grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters, in time that grows with the text."""
    n = F.length(text) - GRAM + 1
    shifted = [F.slice(F.split(text, ""), k + 1, n) for k in range(GRAM)]
    runs = reduce(lambda x, y: F.zip_with(x, y, lambda a, b: F.concat(a, b)), shifted)
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def write_postings(index: DataFrame, path: str, parts: int = 64) -> None:
    """The index's rows by ordinal, the places (``ordinal``) of each gram of their haystacks, and how many each has. The index is made once; places come from its
    written rows. They don't move: a part has those of a range of ordinals, sorted by gram, so a search reads only pages of its files that hold its grams.
    Parts are ``parts``, or as many more as the haystacks need, so that a part's places fit a task's memory."""
    spark = index.sparkSession
    index.repartitionByRange(parts, "ordinal").sortWithinPartitions("ordinal").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").select("ordinal", "haystack")
    chars = rows.agg(F.sum(F.length("haystack"))).first()[0] or 0
    ranges = rows.repartitionByRange(max(parts, -(-chars // PART_CHARS)), "ordinal")
    ranges.select("ordinal", F.explode(grams(F.col("haystack"))).alias("gram")).sortWithinPartitions("gram", "ordinal").write.parquet(f"{path}/places")
    places = spark.read.parquet(f"{path}/places")
    places.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange(parts, "gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """``ordinal`` of the rows that have the query's rarest grams; None if its terms are all too short to tell, so that every row is one."""
    terms = unicodedata.normalize("NFKC", query).lower().split()
    own = sorted({t[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})
    if not own:
        return None
    counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(own)).collect()}  # as many as the query's grams
    rarest = sorted(own, key=lambda g: (counts.get(g, 0), g))[:LISTS]
    found = spark.read.parquet(f"{path}/places").filter(F.col("gram").isin(rarest))
    return found.groupBy("ordinal").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("ordinal")


def search_postings(spark: SparkSession, path: str, query: str, ja: bool = False, primary: bool = False, starred: bool = False, k: int = RESULTS) -> DataFrame:
    """As ``search``, from written postings: rows are read by their candidates' places and tested whole. Also ``candidates``, how many these were."""
    rows, near = spark.read.parquet(f"{path}/rows"), candidates(spark, path, query)
    read = rows if near is None else rows.join(near, "ordinal", "left_semi")
    n = (rows if near is None else near).agg(F.count("*").alias("candidates"))
    return search(read, query, ja, primary, starred, k).join(F.broadcast(n))  # one row


def export_rows(df: DataFrame, source_dim: DataFrame) -> DataFrame:
    """Rows with a URL and a title, their gaps filled from the source's dimension, else by defaults."""
    dim = F.broadcast(source_dim.select("source", F.col("lang").alias("d_lang"), F.col("kind").alias("d_kind")))
    rows = df.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")).join(dim, "source", "left")
    return rows.withColumns({"source": F.coalesce("source", F.lit("Unknown")), "status": F.coalesce("status", F.lit("Unread")), "lang": F.coalesce("lang", "d_lang", F.lit("en")), "kind": F.coalesce("kind", "d_kind", F.lit("primary"))} | ({"score": F.coalesce("score", F.lit(0))} if "score" in df.columns else {})).drop("d_lang", "d_kind")


def coerce(df: DataFrame) -> DataFrame:
    """Values outside their sets fall back: Unread, en, primary."""
    pick = lambda c, ok, other: F.when(F.col(c).isin(*ok), F.col(c)).otherwise(other)
    return df.withColumns({"status": pick("status", ("Unread", "Digested", "Read", "Starred"), "Unread"), "lang": pick("lang", ("en", "ja"), "en"), "kind": pick("kind", ("primary", "secondary"), "primary")})


def write_pages(pages: DataFrame, path: str, facet: str) -> None:
    pages.write.mode("overwrite").partitionBy(facet, "page_no").json(path)


def write_months(df: DataFrame, path: str) -> None:
    """Dynamic overwrite: only months in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_index(index: DataFrame, path: str) -> list[str]:
    """The search index as positional JSON arrays, one a line; returns the names of the fields."""
    index.select(X.json_tuple(*(F.col(c) for c in INDEX)).alias("value")).write.mode("overwrite").text(path)
    return INDEX


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index read back, with the haystack made anew."""
    got = F.from_json("value", "array<string>")
    rows = spark.read.text(path).select(got.alias("v")).select(*(F.get("v", F.lit(k)).alias(n) for k, n in enumerate(INDEX)))
    haystack = X.fold(F.concat_ws(" ", "title", "source", F.replace("categories", F.lit(","), F.lit(" "))))
    return rows.withColumn("score", F.col("score").cast("int")).withColumn("haystack", haystack)


def write_snapshot(df: DataFrame, path: str) -> None:
    """The export as JSON, newest first over its ordered files; an empty one is refused, so that a failed scan never replaces a full export."""
    if df.isEmpty():
        raise ValueError("an empty export isn't written")
    df.orderBy(*by_newest()).write.mode("overwrite").json(path)
