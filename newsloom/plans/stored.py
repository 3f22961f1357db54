"""Queries that write: keyed tables, versions, and streams with timers; their results are read back from the shared folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import site
from newsloom.operators.keyed import Keyed
from newsloom.plans.adapter import table
from newsloom.plans.catalogue import INDEX, _index, query
from newsloom.sources import paged, readers
from newsloom.streaming import stream, timers


def _keyed(spark, name: str, key: str) -> Keyed:
    return Keyed(spark, stream.shared_folder(spark, name), key, 16)


@query("""WITH o AS (SELECT o_custkey AS k, min(o_orderkey) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS a, min(o_orderkey) AS b FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS url_key, coalesce(c_custkey, a, b) AS ordinal, CASE WHEN c_custkey IS NULL THEN 'order' ELSE 'customer' END AS origin FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0) FULL JOIN o ON c_custkey = k""")
def stored_keys(spark, d):
    """Customers who owe are in the table; the orders' customers come in two batches, the second of which is repeated."""
    stored = _keyed(spark, "keys", "url_key")
    stored.insert(table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("url_key"), F.col("c_custkey").alias("ordinal"), F.lit("customer").alias("origin")))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("url_key"), F.col("o_orderkey").alias("ordinal"), F.lit("order").alias("origin"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("old"))
    for epoch, rows in enumerate((orders.filter("old"), orders.filter("NOT old"))):
        stored.insert(rows.drop("old"), "orders", epoch)
    stored.insert(orders.filter("NOT old").drop("old"), "orders", 1)
    return stored.read()


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(top, c_acctbal) AS worth, CASE WHEN n > 15 THEN 'Starred' WHEN n > 5 AND c_acctbal >= 0 THEN 'Read' WHEN c_acctbal < 0 THEN 'Starred' ELSE 'Unread' END AS status FROM customer LEFT JOIN o ON k = c_custkey""")
def written_merge(spark, d):
    """Two steps that are written one after the other, the first of which is repeated: a value is replaced, a status only rises."""
    from newsloom.operators import feedback

    customers = table(spark, d, "customer")
    stored = _keyed(spark, "merged", "c_custkey")
    stored.insert(customers.select("c_custkey", F.col("c_acctbal").alias("worth"), F.when(F.col("c_acctbal") < 0, "Starred").otherwise("Unread").alias("status")))
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("worth"))
    stored.merge(own.select("c_custkey", "worth"))
    feedback.save_statuses(stored, own.select("c_custkey", F.when(F.col("n") > 15, "Starred").when(F.col("n") > 5, "Read").alias("action")))
    stored.merge(own.select("c_custkey", "worth"))
    return stored.read()


COOL, TTL = timers.COOLDOWN * 1_000_000, timers.TTL * 1_000_000
STEPS_SQL = f"""WITH RECURSIVE lim AS (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 AS til FROM events),
raw AS (SELECT user_id AS k, epoch_us(ts) AS t, event_type IN ('purchase', 'signup') AS ok, event_type = 'error' AS thr, false AS fin FROM events, lim WHERE epoch_us(ts) <= til),
e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fin, t, ok, thr) AS i FROM (SELECT * FROM raw UNION ALL SELECT DISTINCT k, til, false, false, true FROM raw, lim)),
s AS (
  SELECT k, CAST(0 AS BIGINT) AS i, 0 AS n, CAST(0 AS BIGINT) AS due, CAST(0 AS BIGINT) AS base, false AS ended, CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS due_at, 0 AS due_n, CAST(NULL AS BIGINT) AS drop_at, 0 AS drop_n, CAST(NULL AS VARCHAR) AS step FROM (SELECT DISTINCT k FROM e)
  UNION ALL
  SELECT k, i, CASE WHEN skip THEN n1 ELSE n2 END, CASE WHEN skip THEN due1 WHEN over THEN 0 ELSE t + {COOL} END, CASE WHEN skip THEN base2 WHEN over THEN t ELSE 0 END, CASE WHEN skip THEN ended1 ELSE over END, t,
    due_at, due_n, drop_at, drop_n, CASE WHEN skip THEN NULL WHEN over THEN 'ended' ELSE 'tried' END FROM (
    SELECT *, fin OR ended1 OR due1 > 0 AS skip, n1 + CASE WHEN thr THEN 0 ELSE 1 END AS n2, (ok AND NOT thr) OR n1 + CASE WHEN thr THEN 0 ELSE 1 END >= 3 AS over FROM (
      SELECT *, CASE WHEN base1 > 0 AND base1 + {TTL} <= t THEN base1 + {TTL} END AS drop_at, n AS drop_n, CASE WHEN base1 > 0 AND base1 + {TTL} <= t THEN 0 ELSE n END AS n1,
        CASE WHEN base1 > 0 AND base1 + {TTL} <= t THEN 0 ELSE base1 END AS base2, ended AND NOT (base1 > 0 AND base1 + {TTL} <= t) AS ended1 FROM (
        SELECT e.k, e.i, e.t, e.ok, e.thr, e.fin, s.n, s.ended, CASE WHEN s.due > 0 AND s.due <= e.t THEN s.due END AS due_at, s.n AS due_n,
          CASE WHEN s.due > 0 AND s.due <= e.t THEN s.due ELSE s.base END AS base1, CASE WHEN s.due > 0 AND s.due <= e.t THEN 0 ELSE s.due END AS due1
        FROM s JOIN e ON e.k = s.k AND e.i = s.i + 1))))
SELECT k AS key, make_timestamp(t) AS at, step, n AS attempts FROM s WHERE step IS NOT NULL UNION ALL SELECT k, make_timestamp(due_at), 'due', due_n FROM s WHERE due_at IS NOT NULL
UNION ALL SELECT k, make_timestamp(drop_at), 'dropped', drop_n FROM s WHERE drop_at IS NOT NULL"""


def _tries(events):
    kind = F.col("event_type")
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), kind.isin("purchase", "signup").alias("ok"), (kind == "error").alias("throttled"))


@query(STEPS_SQL)
def retry_steps(spark, d):
    """The users' events as tries, up to an hour before the last one."""
    events = table(spark, d, "events")
    last = events.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    until = F.timestamp_millis(F.lit((last or 0) - 3_600_000))
    return timers.batch(_tries(events), until).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(STEPS_SQL)
def stream_retry_steps(spark, d):
    """The same from a stream: what the watermark hasn't passed isn't counted yet."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stream.with_rocksdb(spark)
    try:
        rows = stream.run_now(timers.stream(_tries(stream.source(spark, d, "events"))), "retries", "append")
    finally:
        spark.conf.set(key, before)
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events GROUP BY 1")
def stream_two_tiers(spark, d):
    """Users by the first day they were seen, in batches of ten days each; the stream's own state reaches back two days."""
    folder = stream.shared_folder(spark, "tiers")
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.to_date("ts").cast("timestamp").alias("ts")).distinct()
    first = days.agg(F.min("day")).first()[0] or dt.date(2024, 1, 1)
    for k in range(3):
        part = F.least(F.lit(2), F.floor(F.datediff("day", F.lit(first)) / 10)) == k
        days.filter(part).groupBy("user_id").agg(F.min("day").alias("day"), F.min("ts").alias("ts")).write.parquet(f"{folder}/in/{k}.parquet")
        rows = spark.readStream.schema("user_id long, day date, ts timestamp").option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in/*.parquet")
        stored = stream.dedup_into(rows, "user_id", f"{folder}/users", "2 days", "users")
    return stored.read().select("user_id", "day")


#: Rows of a window of the paged store, on average at most; bytes of its files' row groups, which a window reads whole.
WINDOW_ROWS, STORE_BLOCK = 200_000, 4_000_000


@query("SELECT event_id, user_id, event_type, value, ts FROM events")
def anchored_events(spark, d):
    """All events through a store that gives a hundred rows at a time, and ends a chain of pages after five hundred. The store is laid out by time, so that a
    window reads its own part of it; windows are of three days, or of fewer as they'd have more than ``WINDOW_ROWS`` rows on average."""
    paged.register(spark)
    schema, columns = "collected timestamp_ntz, event_id long, user_id long, event_type string, value double", ["ts", "event_id", "user_id", "event_type", "value"]
    events = table(spark, d, "events").select(*columns)
    bounds = events.agg(F.date_trunc("day", F.min("ts")).alias("low"), (F.date_trunc("day", F.max("ts")) + F.expr("interval 1 day")).alias("high"), F.count("ts").alias("n")).first()
    if bounds.low is None:
        return spark.createDataFrame([], "event_id long, user_id long, event_type string, value double, ts timestamp_ntz")
    path = stream.shared_folder(spark, "paged")
    events.repartitionByRange("ts").sortWithinPartitions("ts").write.option("parquet.block.size", STORE_BLOCK).parquet(path)
    days = min(3, (bounds.high - bounds.low) / dt.timedelta(days=1) * WINDOW_ROWS / bounds.n)
    rows = spark.read.format("paged").schema(schema).options(client="newsloom.sources.paged:FileStore", path=path, columns=",".join(columns), chain=500, size=100, start=str(bounds.low), end=str(bounds.high), days=days).load()
    return paged.latest(rows, "event_id", "collected").select("event_id", "user_id", "event_type", "value", F.col("collected").alias("ts"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace(split_part(text, chr(10), 2), '\s+', ' ', 'g')) AS description, ts FROM documents JOIN events ON event_id = doc_id),
u AS (SELECT *, 'https://e.com/news/' || (doc_id // 3) AS url, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS rn FROM t WHERE length(title) >= 10)
SELECT doc_id * 10000 AS ordinal, title, url, substr(description, 1, 500) AS abstract, CASE WHEN doc_id % 4 > 0 THEN date_trunc('second', ts) END AS published_at FROM u WHERE rn = 1""")
def listing_items(spark, d):
    """The documents' first lines as links of listing pages, their second lines as descriptions; three pages link to an article each, of which the first counts."""
    D = F.col("doc_id")
    docs = table(spark, d, "documents").join(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    line = lambda n: X.escape_markup(F.coalesce(F.get(F.split("text", "\n", n + 2), F.lit(n)), F.lit("")))
    date = F.when(D % 4 > 0, F.concat(F.lit('<time datetime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"></time>'))).otherwise("")
    html = F.concat(F.lit('<div><a href="/news/'), F.floor(D / 3).cast("string"), F.lit('"><h3>'), line(0), F.lit('</h3></a><a href="/about">About us, a page</a><p>'), line(1), F.lit("</p>"), date, F.lit("</div>"))
    got = readers.listing(docs.select(D.alias("ordinal"), html.alias("html")), "https://e.com", "Listing")
    return got.select("ordinal", "title", "url", "abstract", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query(INDEX + """, f AS (SELECT * FROM x WHERE contains(haystack, 'the') AND contains(haystack, 'src1') AND status = 'Starred')
SELECT ordinal, score, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM x WHERE contains(haystack, 'the') AND contains(haystack, 'src') AND contains(haystack, 'rc1')) AS candidates FROM f ORDER BY score DESC, ordinal LIMIT 200""")
def search_by_postings(spark, d):
    """The search index as written postings, and a search that reads its candidates only."""
    path = stream.shared_folder(spark, "search")
    site.write_postings(_index(spark, d), path, 16)
    return site.search_postings(spark, path, "The src1", starred=True).select("ordinal", "score", "total", "candidates")
