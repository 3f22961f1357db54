"""Further queries with their SQL: the operators that the catalogue's first part leaves out, over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import urls as U
from newsloom.operators import brief, enrich, feedback, queue, rank, site
from newsloom.plans.adapter import table
from newsloom.plans.catalogue import query
from newsloom.sources import dims, readers

AT = "2024-01-20 00:00:00"


def _at():
    return F.lit(AT).cast("timestamp_ntz")


def pick(values, n):
    """The value at ``n`` modulo their number, in Spark and (``pick_sql``) in SQL."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values, n: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][CAST(({n}) % {len(values)} AS INTEGER) + 1]"


# delivery ledger and reactions


@query("""WITH i AS (SELECT event_id % 40 AS batch, max(event_id) AS i_id, arg_max(user_id % 5, event_id) AS i_run FROM events WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT DISTINCT CAST(b AS BIGINT) AS batch, CAST(b % 5 AS BIGINT) AS run_id, 'r' || (b % 3) AS name, b % 2 = 0 AS reviewed FROM (SELECT unnest(range(60)) AS b)),
r AS (SELECT event_id % 40 AS batch, 'r' || (event_id % 3) AS name, user_id % 5 AS run_id, max(event_id) AS r_id FROM events WHERE event_type = 'click' AND event_id % 7 <> 0 GROUP BY 1, 2, 3)
SELECT s.batch, coalesce(CASE WHEN i_id IS NULL THEN reviewed ELSE s.run_id = i_run AND r_id > i_id END, false) AS ok FROM s LEFT JOIN i USING (batch) LEFT JOIN r ON r.batch = s.batch AND r.name = s.name AND r.run_id = s.run_id""")
def replay_guard(spark, d):
    E = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "intent").when(F.col("event_type") == "click", "result")
    artifacts = table(spark, d, "events").select((E % 40).alias("batch"), kind.alias("kind"), E.alias("id"), F.concat(F.lit("r"), (E % 3).cast("string")).alias("name"), (F.col("user_id") % 5).alias("run_id"), (E % 7 == 0).alias("expired"))
    sources = spark.range(60).select(F.col("id").alias("batch"), (F.col("id") % 5).alias("run_id"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("name"), (F.col("id") % 2 == 0).alias("reviewed"))
    return feedback.may_replay(artifacts, sources)


STATES = ["pending", "sending", "sent", "uncertain", "failed", "lost"]


@query(f"""WITH e AS (SELECT event_id AS e, event_id % 13 AS n, event_id % 13 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS m FROM events),
r AS (SELECT *, list_transform(range(m), lambda i: {pick_sql(STATES[:3], "e + i")}) AS states, list_transform(range(m), lambda i: CASE WHEN (e + i) % 3 <> 2 OR (e % 5) > 1 THEN 'x' ELSE '' END) AS tss FROM e)
SELECT e AS event_id, n <= 10 AND n = m AND e % 11 <> 0 AND e % 9 <> 0 AND {pick_sql(STATES, "e")} <> 'lost' AND ({pick_sql(STATES, "e")} <> 'sent' OR e % 4 <> 0)
  AND len(list_filter(range(m), lambda i: states[i + 1] = 'sent' AND tss[i + 1] = '')) = 0 AS valid FROM r""")
def outbox_valid(spark, d):
    E = F.col("event_id")
    m = (E % 13 + F.when(E % 7 == 0, 1).otherwise(0)).cast("int")
    empty = F.array().cast("array<struct<state:string,ts:string>>")
    replies = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(pick(STATES[:3], E + i).alias("state"), F.when(((E + i) % 3 != 2) | (E % 5 > 1), "x").otherwise("").alias("ts")))).otherwise(empty)
    articles = F.when(E % 13 > 0, F.sequence(F.lit(1), (E % 13).cast("int"))).otherwise(F.array().cast("array<int>"))
    parent = F.struct(pick(STATES, E).alias("state"), F.when(E % 4 != 0, "x").alias("ts"))
    rows = table(spark, d, "events").select("event_id", F.when(E % 11 != 0, 1).otherwise(2).alias("version"), F.when(E % 9 != 0, "c").otherwise("").alias("channel"), articles.alias("articles"), parent.alias("parent"), replies.alias("replies"))
    return rows.select("event_id", feedback.valid_outbox(F.col("version"), F.col("channel"), F.col("articles"), F.col("parent"), F.col("replies")).alias("valid"))


@query(f"""WITH m AS (SELECT *, event_id - event_id % 6 AS head, event_id % 6 AS k FROM events),
p AS (SELECT event_id FROM m WHERE k = 0 AND event_id % 5 <> 0 AND event_id % 4 <> 0 AND ts >= TIMESTAMP '{AT}' - INTERVAL 3 DAY)
SELECT m.event_id % 50 AS item, CASE event_type WHEN 'purchase' THEN 'Starred' ELSE 'Read' END AS action, count(*) AS n FROM m JOIN p ON p.event_id = m.head
WHERE event_type IN ('purchase', 'click') AND m.event_id % 8 <> 0 AND (k > 0 OR m.event_id % 12 = 0) GROUP BY 1, 2""")
def thread_reactions(spark, d):
    """Parents carry their own ``ts`` as thread on every second thread, none on the others."""
    E = F.col("event_id")
    head, k = E - E % 6, E % 6
    stamp = lambda i, t: F.concat(F.unix_timestamp(t.cast("timestamp")).cast("string"), F.lit("."), F.lpad(i.cast("string"), 9, "0"))
    events = table(spark, d, "events")
    heads = events.select(E.alias("head"), F.col("ts").alias("head_ts"))
    rows = events.withColumn("head", head).join(heads, "head")
    thread = F.when((k > 0) | (E % 12 == 0), stamp(F.col("head"), F.col("head_ts")))
    names = F.when(F.col("event_type") == "purchase", F.array(F.lit("star"))).when(F.col("event_type") == "click", F.array(F.lit("+1"))).otherwise(F.array(F.lit("wave")))
    text = F.when(k == 0, F.when(E % 5 != 0, "Digest of").otherwise("Other")).otherwise("see")
    linked = F.when(E % 8 != 0, F.concat(F.lit(" <http://x/"), (E % 50).cast("string"), F.lit("|t>"))).otherwise("")
    rows = rows.select(stamp(E, F.col("ts")).alias("ts"), thread.alias("thread_ts"), F.when((k == 0) & (E % 4 != 0), 5).otherwise(0).alias("reply_count"), F.concat(text, linked).alias("text"), F.transform(names, lambda x: F.struct(x.alias("name"))).alias("reactions"))
    found = feedback.replies(rows, _at(), "Digest")
    return found.groupBy(F.substring_index("url", "/", -1).cast("long").alias("item"), "action").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, CASE {pick_sql(STATES[:5], 'event_id')} WHEN 'sent' THEN 'skip' WHEN 'sending' THEN 'block' WHEN 'uncertain' THEN 'block' ELSE 'send' END AS step FROM events")
def delivery_steps(spark, d):
    E = F.col("event_id")
    return table(spark, d, "events").select("event_id", feedback.next_delivery(pick(STATES[:5], E)).alias("step"))


@query("""WITH n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS total FROM orders GROUP BY 1), m AS (SELECT *, least(total, 5) AS shown FROM n)
SELECT '🗞️ AI News Digest — ' || strftime(day, '%Y-%m-%d') AS title, CASE WHEN total > shown THEN '本日の新着 ' || total || ' 件から上位 ' || shown || ' 件（各記事はスレッドに投稿）' ELSE '本日の新着 ' || shown || ' 件（各記事はスレッドに投稿）' END AS context FROM m""")
def digest_header(spark, d):
    """Of each day's orders five are shown."""
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("total"))
    return days.select(feedback.header(F.col("day").cast("string"), F.col("total"), F.least("total", F.lit(5))).alias("h")).select("h.*")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def foreign_entries(spark, d):
    """Orders of customers who owe."""
    outbox = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("url"))
    return feedback.foreign(outbox, table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("url"))).select("o_orderkey")


@query("""WITH t AS (SELECT min(event_id) AS o, CAST(user_id AS VARCHAR) AS u FROM events WHERE event_type = 'purchase' GROUP BY user_id ORDER BY 1 LIMIT 10), a AS (SELECT list(u ORDER BY o) AS urls FROM t)
SELECT sha256('["C","2024-01-20",["' || array_to_string(urls, '","') || '"]]') AS id, len(urls) AS n FROM a""")
def outbox_batch(spark, d):
    E = F.col("event_id")
    rows = table(spark, d, "events").filter("event_type = 'purchase'").select(E.alias("ordinal"), F.col("user_id").cast("string").alias("url"), "value")
    return feedback.prepare(rows, "C", "2024-01-20").select("id", F.size("replies").cast("long").alias("n"))


# sources


def _hits(spark, d):
    E, D = F.col("event_id"), F.col("doc_id")
    labels = table(spark, d, "events").select(E.alias("doc_id"), "ts", "value")
    title = F.concat(pick(["a new llm ", "said ", "agents and AI ", "rage "], D), F.substring_index("text", "\n", 1))
    return table(spark, d, "documents").join(labels, "doc_id").select(D.alias("ordinal"), title.alias("title"), "text", "ts", "value")


TITLE = "(" + pick_sql(["a new llm ", "said ", "agents and AI ", "rage "], "doc_id") + " || split_part(text, chr(10), 1))"
WORD = lambda c, ks: f"regexp_matches(lower({c}), '" + "|".join(("(^|[^a-z0-9_])" if len(k) <= 3 else "") + k.replace(".", "\\.") + ("($|[^a-z0-9_])" if len(k) <= 3 else "") for k in ks) + "')"


@query(f"""WITH h AS (SELECT doc_id AS ordinal, {TITLE} AS title, CASE WHEN doc_id % 9 <> 0 THEN 'http://x/' || (doc_id % 300) END AS url, CAST(floor(value) AS INTEGER) AS points, ts FROM documents JOIN events ON event_id = doc_id),
g AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS rn FROM h WHERE url IS NOT NULL AND points >= 50 AND ts > TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 24 HOUR AND {WORD('title', dims.KEYWORDS)})
SELECT ordinal, title, url, points, ts AS published FROM g WHERE rn = 1 ORDER BY ordinal LIMIT 30""")
def hn_search(spark, d):
    hits = _hits(spark, d).select("ordinal", "title", F.when(F.col("ordinal") % 9 != 0, F.concat(F.lit("http://x/"), (F.col("ordinal") % 300).cast("string"))).alias("url"), F.col("value").cast("int").alias("points"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"), F.lit("x").alias("story_text"))
    got = readers.hacker_news(hits, F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))
    return got.select("ordinal", "title", "url", F.col("crowd_score").cast("int").alias("points"), F.col("published_at").cast("timestamp_ntz").alias("published"))


@query(f"""WITH s AS (SELECT doc_id AS ordinal, {TITLE} AS title, CASE WHEN doc_id % 9 <> 0 THEN 'http://x/' || doc_id ELSE '' END AS url, CAST(value / 10 AS INTEGER) AS score, {pick_sql(['ai', 'web', 'ML', 'os'], 'doc_id // 4')} AS tag FROM documents JOIN events ON event_id = doc_id)
SELECT ordinal, title, url, score FROM s WHERE url <> '' AND score >= 5 AND (lower(tag) IN ('ai', 'ml', 'nlp') OR {WORD('title', dims.KEYWORDS)}) ORDER BY ordinal LIMIT 20""")
def lobsters_stories(spark, d):
    rows = _hits(spark, d).select("ordinal", "title", F.when(F.col("ordinal") % 9 != 0, F.concat(F.lit("http://x/"), F.col("ordinal").cast("string"))).otherwise("").alias("url"), F.round(F.col("value") / 10).cast("int").alias("score"), F.lit("x").alias("description_plain"), F.lit(None).cast("string").alias("created_at"), F.array(pick(["ai", "web", "ML", "os"], F.floor(F.col("ordinal") / 4))).alias("tags"))
    return readers.lobsters(rows).select("ordinal", "title", "url", F.col("crowd_score").cast("int").alias("score"))


@query(f"""WITH p AS (SELECT doc_id AS ordinal, {TITLE} AS title, 'http://x/' || (doc_id % 400) AS url, CAST(round(value / 5) AS INTEGER) AS likes, ts, doc_id % 10 = 0 AS undated FROM documents JOIN events ON event_id = doc_id),
g AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS rn FROM p WHERE likes >= 3 AND (undated OR ts >= TIMESTAMP '2024-01-09 00:00:00' - INTERVAL 7 DAY))
SELECT ordinal, url, likes FROM g WHERE rn = 1 ORDER BY likes DESC, ordinal LIMIT 20""")
def qiita_posts(spark, d):
    posts = _hits(spark, d).select("ordinal", "title", F.concat(F.lit("http://x/"), (F.col("ordinal") % 400).cast("string")).alias("url"), F.round(F.col("value") / 5).cast("int").alias("likes_count"), F.when(F.col("ordinal") % 10 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("created_at"), F.col("text").alias("body"))
    return readers.qiita(posts, F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")).select("ordinal", "url", F.col("crowd_score").cast("int").alias("likes"))


@query("SELECT doc_id AS ordinal, CASE WHEN doc_id % 3 = 0 THEN 'own ' || doc_id ELSE 'outer' END AS title, 'https://huggingface.co/papers/' || doc_id AS url, substr(text, 1, 1000) AS abstract FROM documents")
def daily_papers(spark, d):
    """The reference's cut of a paper's abstract is the feature here."""
    D = F.col("doc_id")
    paper = F.struct(D.cast("string").alias("id"), F.when(D % 3 == 0, F.concat(F.lit("own "), D.cast("string"))).alias("title"), F.col("text").alias("summary"), F.lit(None).cast("string").alias("publishedAt"))
    return readers.papers(table(spark, d, "documents").select(D.alias("ordinal"), F.lit("outer").alias("title"), F.lit(None).cast("string").alias("publishedAt"), paper.alias("paper"))).select("ordinal", "title", "url", "abstract")


@query("SELECT CASE WHEN k = 0 THEN doc_id ELSE 1000000000000 + doc_id END AS ordinal, k FROM (SELECT doc_id, 0 AS k FROM documents UNION ALL SELECT page_id, 1 FROM pages)")
def union_of_sources(spark, d):
    D = F.col("doc_id")
    one = table(spark, d, "documents").select(D.alias("ordinal"), F.lit(0).alias("k"))
    return readers.union_sources([one, table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), F.lit(1).alias("k"))])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_pages(spark, d):
    return readers.latest_by_id(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type", "event_id")


HEX = "substr(md5(CAST(event_id AS VARCHAR)), 1, 32)"


@query(f"SELECT {HEX} AS page_key FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <> 0 AND {HEX} NOT IN (SELECT {HEX} FROM events WHERE event_id % 3 = 0)")
def recoverable_pages(spark, d):
    E = F.col("event_id")
    key = F.md5(E.cast("string").cast("binary"))
    dashed = F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 32))
    snapshot = table(spark, d, "events").select(F.when(E % 9 != 0, dashed).otherwise("none").alias("id"), F.when(E % 4 == 0, "ja").when(E % 4 == 1, "en").alias("lang"))
    return readers.recoverable(snapshot, table(spark, d, "events").filter("event_id % 3 = 0").select(key.alias("id"))).select("page_key")


KINDS = [None, "TimeoutError", "AbortError", "TypeError", None, None]


@query(f"""SELECT event_id, CASE WHEN {pick_sql(KINDS, 'event_id')} IN ('TimeoutError', 'AbortError') THEN 'timeout' WHEN {pick_sql(KINDS, 'event_id')} IS NOT NULL THEN 'network_error' WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'http_error' WHEN event_id % 11 < 2 THEN 'unsupported_content_type' END AS reason FROM events""")
def fetch_reasons(spark, d):
    E = F.col("event_id")
    status = F.when(E % 5 == 0, 404).when(E % 7 != 0, 200)
    kind = F.when(E % 11 == 0, "image/png").when(E % 11 > 4, "text/html; charset=utf-8").when(E % 11 > 1, "text/plain")
    return table(spark, d, "events").select("event_id", readers.fetch_failure(status, kind, pick(KINDS, E)).alias("reason"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '://([^/?#]*)', 1)), '(^|\.)(example\.net|ththen\.example\.org)$') THEN 'headless' ELSE 'http' END AS method FROM pages")
def fetch_methods(spark, d):
    payloads = table(spark, d, "pages").select("page_id", "url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit("TypeError").alias("error"), F.lit(None).cast("string").alias("html"))
    return readers.fetched_bodies(payloads, ["example.net", "ththen.example.org"]).select("page_id", "method")


# texts, numbers, dates


@query("SELECT doc_id, trim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300)) AS cut FROM documents")
def collapsed(spark, d):
    return table(spark, d, "documents").select("doc_id", X.js_trim(X.collapse(F.col("text"), 300)).alias("cut"))


@query("""WITH t AS (SELECT doc_id, url, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS summary, text AS abstract FROM documents JOIN pages ON page_id = doc_id)
SELECT doc_id, '*<' || url || '|' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>*' || chr(10) ||
  replace(replace(replace(coalesce(nullif(summary, ''), nullif(substr(abstract, 1, 160), ''), '(no summary)'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS line FROM t""")
def article_lines(spark, d):
    """Documents with a page's URL: their second line is the summary, where there is one."""
    docs = table(spark, d, "documents").join(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    line = lambda n: F.coalesce(F.get(F.split("text", "\n", n + 2), F.lit(n)), F.lit(""))
    return docs.select("doc_id", X.article_line(line(0), F.col("url"), line(1), F.col("text")).alias("line"))


NOON = "2024-01-15 12:00:00.5"


@query(f"""WITH r AS (SELECT event_id, ts, value, date_trunc('second', ts) AS sec FROM events),
s AS (SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN CAST(floor(value * 2000) AS BIGINT) WHEN 1 THEN greatest(0, CAST(ceil(epoch(sec) - epoch(TIMESTAMP '{NOON}')) AS BIGINT))
  WHEN 2 THEN greatest(0, CAST(ceil(epoch(sec) - epoch(TIMESTAMP '{NOON}')) AS BIGINT)) END AS seconds FROM r)
SELECT event_id, CASE WHEN seconds <= 604800 THEN seconds END AS seconds FROM s""")
def retry_after_seconds(spark, d):
    """Whole numbers and dates of the events, past and future ones, plain and padded; fractions, words and dates that are none give null."""
    E = F.col("event_id")
    date = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    raw = [F.concat(F.lit(" "), F.floor(F.col("value") * 2000).cast("string")), date, F.concat(F.lit(" \t"), date, F.lit("\n")), F.concat(F.floor("value").cast("string"), F.lit(".5")), F.col("event_type"), F.regexp_replace(date, r", \d\d ", ", 99 ")]
    rows = table(spark, d, "events").select("event_id", F.element_at(F.array(*raw), (E % 6 + 1).cast("int")).alias("raw"))
    return rows.select("event_id", X.retry_after(F.col("raw"), F.lit(NOON).cast("timestamp")).alias("seconds"))


FORMS = [("yyyy-MM-dd'T'HH:mm:ss'Z'", 0), ("EEE, d MMM yyyy HH:mm:ss 'GMT'", 0), ("d MMM yyyy HH:mm:ss 'EST'", 5), ("EEE, dd MMM yyyy HH:mm:ss '+0900'", -9), ("d MMM yyyy HH:mm:ss 'PDT'", 7)]


@query("SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE epoch_ms(CAST(floor(epoch(ts)) AS BIGINT) * 1000) + to_hours(CAST([0, 0, 5, -9, 7, 0][CAST(event_id % 6 AS INTEGER) + 1] AS INTEGER)) END AS at FROM events")
def parsed_dates(spark, d):
    E = F.col("event_id")
    raw = F.lit("no date")
    for k, (form, _) in enumerate(FORMS):
        raw = F.when(E % 6 == k, F.date_format("ts", form)).otherwise(raw)
    return table(spark, d, "events").select("event_id", X.parse_date(raw).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN floor(value) WHEN 2 THEN floor(value) * 1000 ELSE -1 END AS crowd FROM events")
def crowd_numbers(spark, d):
    """The events' values as text: padded, whole, with an exponent; with a letter, as no number, and empty they're none."""
    E, v = F.col("event_id"), F.col("value").cast("string")
    raw = [F.concat(v, F.lit(" ")), F.floor("value").cast("string"), F.concat(F.floor("value").cast("string"), F.lit("e3")), F.concat(v, F.lit("d")), F.lit("NaN"), F.lit("")]
    rows = table(spark, d, "events").select("event_id", F.element_at(F.array(*raw), (E % 6 + 1).cast("int")).alias("raw"))
    return rows.select("event_id", F.coalesce(X.crowd_number(F.col("raw")), F.lit(-1.0)).alias("crowd"))


@query("SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(9) || chr(10))), lambda p: p <> '')[1] AS first, greatest(1, len(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(9) || chr(10))), lambda p: p <> ''))) AS n FROM documents WHERE trim(text) <> ''")
def paragraph_blocks(spark, d):
    p = X.paragraphs(F.col("text"))
    return table(spark, d, "documents").filter("trim(text) <> ''").select("doc_id", F.get(p, F.lit(0)).alias("first"), F.size(p).cast("long").alias("n"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, text) AS joined FROM conversations GROUP BY conv_id")
def rich_texts(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(parts.alias("p"))
    return rows.select("conv_id", X.rich_text(F.transform("p", lambda x: F.struct(x["text"].alias("plain_text")))).alias("joined"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN md5(url) END AS id, length(html) AS stars, html AS body FROM pages WHERE html IS NOT NULL")
def extracted_values(spark, d):
    """Page ids made of the URLs, the pages' lengths as counts of stars, the pages as fenced answers."""
    key = F.md5(F.col("url").cast("binary"))
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://store/Title-"), F.substring(key, 1, 8), F.lit("-"), F.substring(key, 9, 32), F.lit("?v=1"))).otherwise("https://store/none")
    stars = F.concat(F.lit("★ "), F.format_number(F.length("html"), 0), F.lit(" stars today"))
    return table(spark, d, "pages").filter("html IS NOT NULL").select("page_id", X.page_id(link).alias("id"), X.star_count(stars).cast("long").alias("stars"), X.strip_fence(F.concat(F.lit("```json\n"), "html", F.lit("\n```"))).alias("body"))


@query(r"SELECT page_id, regexp_matches(lower(regexp_extract(url, '://([^/?#]*)', 1)), '(^|\.)(example\.org|example\.com)$') AS inside FROM pages")
def hosts_in_domains(spark, d):
    return table(spark, d, "pages").select("page_id", U.host_in(F.col("url"), ["example.org", "example.com"]).alias("inside"))


# scores by the engine's own rules

SEEDS = ["GPT-5 agents with MCP tool use", "RAG retrieval and vector search", "open source weights released for llama", "a jailbreak benchmark, state-of-the-art", "エージェント の 実装 と 解説", "video diffusion and speech", "RLHF with PPO on kubernetes", "introducing a developer tool", "an arXiv paper", "nothing of note"]
LIST = lambda ks: "(" + " OR ".join(f"contains(low, '{k}')" for k in ks) + ")"
DIMS_SQL = "(VALUES " + ", ".join(f"('{s}', {w}, CAST({c} AS DOUBLE), '{lang}', '{kind}')" for s, lang, kind, w, c in dims.SOURCES) + ") AS dim(source, weight, scale, lang, kind)"
NAMES = [s[0] for s in dims.SOURCES] + ["Unknown"]


@query(f"""WITH t AS (SELECT event_id AS ordinal, {pick_sql(NAMES, 'event_id')} AS source, lower({pick_sql(SEEDS, 'event_id')} || ' ' || {pick_sql(SEEDS, 'event_id // 10')}) AS low, value FROM events),
c AS (SELECT *, [x FOR x IN [{", ".join(f"CASE WHEN {LIST(ks)} THEN '{n}' END" for n, ks in dims.CATEGORY_RULES)}] IF x IS NOT NULL] AS cats FROM t LEFT JOIN {DIMS_SQL} USING (source))
SELECT ordinal, lang, kind, coalesce(weight, 30) AS base, {" + ".join(f"CASE WHEN {LIST(ks)} THEN {b} ELSE 0 END" for ks, b in dims.BONUS_RULES)} AS bonus,
  CASE WHEN value > 0 THEN least(60, CAST(round(18 * log10(value * coalesce(scale, 1) + 1)) AS INTEGER)) ELSE 0 END AS crowd,
  CASE WHEN len(cats) = 0 THEN 'Other' ELSE array_to_string(cats, ',') END AS categories FROM c""")
def real_rules(spark, d):
    E = F.col("event_id")
    rows = table(spark, d, "events").select(E.alias("ordinal"), pick(NAMES, E).alias("source"), pick(SEEDS, E).alias("title"), pick(SEEDS, F.floor(E / 10)).alias("abstract"), F.col("value").alias("crowd_score"))
    return rank.score(rows, dims.source_dim(spark)).select("ordinal", "lang", "kind", "base", "bonus", "crowd", F.array_join("category", ",").alias("categories"))


@query(f"""WITH t AS (SELECT doc_id, {pick_sql(SEEDS, 'doc_id')} || ' ' || text AS t FROM documents)
SELECT doc_id, {WORD('t', dims.KEYWORDS)} AS english, {WORD('t', dims.KEYWORDS_JA)} AS japanese FROM t""")
def real_keywords(spark, d):
    """Whole documents, each after a line that may hold keywords."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(pick(SEEDS, F.col("doc_id")), F.lit(" "), "text").alias("t"))
    return rows.select("doc_id", X.matches_keyword(F.col("t"), dims.KEYWORDS).alias("english"), X.matches_keyword(F.col("t"), dims.KEYWORDS_JA).alias("japanese"))


# enrichment


@query("""WITH a AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN ' ' || chr(9) || chr(10) WHEN doc_id % 4 = 1 THEN split_part(text, chr(10), 2) ELSE text END AS abstract FROM documents)
SELECT doc_id, CASE WHEN lang <> 'de' OR lang IS NULL THEN 'pending' WHEN trim(coalesce(abstract, ''), ' ' || chr(9) || chr(10)) <> '' THEN 'excerpt' ELSE 'insufficient_evidence' END AS status FROM a""")
def initial_states(spark, d):
    """Some abstracts are blank, some a second line, which may be missing."""
    D = F.col("doc_id")
    lang = F.when(F.col("lang") == "de", "ja").otherwise(F.col("lang"))
    second = F.coalesce(F.get(F.split("text", "\n", 3), F.lit(1)), F.lit(""))
    abstract = F.when(D % 4 == 0, " \t\n").when(D % 4 == 1, second).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", enrich.initial_status(lang, abstract).alias("status"))


@query("SELECT doc_id, CASE WHEN lang <> 'de' THEN 'made' WHEN trim(substr(text, 1, 300), ' ' || chr(9) || chr(10)) = '' THEN '' ELSE '【フィード抜粋・未検証】' || substr(trim(text, ' ' || chr(9) || chr(10)), 1, 300) END AS summary FROM documents WHERE lang IS NOT NULL")
def stored_summaries(spark, d):
    lang = F.when(F.col("lang") == "de", "ja").otherwise(F.col("lang"))
    return table(spark, d, "documents").filter("lang IS NOT NULL").select("doc_id", enrich.collected_summary(lang, F.col("text"), F.lit("made")).alias("summary"))


STATE = "SELECT event_id, ['pending', 'body_unavailable', 'rate_limited', 'model_failed', 'ready', 'non_ai'][CAST(event_id % 6 AS INTEGER) + 1] AS status, CAST(event_id % 5 AS INTEGER) AS attempts, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 6 HOUR END AS next_at FROM events WHERE event_id % 3 <> 0"
MAY = f"status IN ('pending', 'body_unavailable', 'rate_limited', 'model_failed') AND (status = 'rate_limited' OR attempts < 3) AND (next_at IS NULL OR next_at <= TIMESTAMP '{AT}')"
OVER = "(status <> 'rate_limited' AND attempts >= 3) OR status IN ('ready', 'non_ai')"


@query(f"""WITH b AS (SELECT DISTINCT doc_id FROM documents), s AS ({STATE}), j AS (SELECT doc_id, status, attempts, next_at, coalesce({MAY}, false) AS may FROM b LEFT JOIN s ON event_id = doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY doc_id) AS rn FROM j)
SELECT doc_id AS page_id, CASE WHEN status IS NULL OR {OVER} THEN 'drop' WHEN may AND rn <= 10 THEN 'work' WHEN may THEN 'later' ELSE 'wait' END AS step FROM r""")
def backlog_and_states(spark, d):
    D = F.col("doc_id")
    from newsloom.plans.catalogue import states

    backlog = table(spark, d, "documents").select(D.alias("ordinal"), D.alias("page_id")).distinct()
    own = states(spark, d).filter("event_id % 3 <> 0").withColumnRenamed("event_id", "page_id")
    return enrich.backlog_steps(backlog, own, _at()).select("page_id", "step")


@query("SELECT event_id AS page_id, CASE WHEN event_type = 'purchase' THEN 'new ' || value ELSE props END AS summary, CASE WHEN event_type = 'purchase' THEN 'ready' ELSE event_type END AS status FROM events")
def two_step_update(spark, d):
    """Purchases have results."""
    E = F.col("event_id")
    pages = table(spark, d, "events").select(E.alias("page_id"), F.col("props").alias("summary"), F.col("event_type").alias("status"))
    results = table(spark, d, "events").filter("event_type = 'purchase'").select(E.alias("page_id"), F.concat(F.lit("new "), F.col("value").cast("string")).alias("summary"), F.lit("ready").alias("status"))
    once = enrich.merge_results(enrich.merge_results(pages, results, "summary"), results, "status")
    return enrich.merge_results(once, results, "summary")  # a repeated first step changes nothing


@query(f"WITH s AS ({STATE.replace(' WHERE event_id % 3 <> 0', '')}) SELECT event_id, status, attempts, TIMESTAMP '{AT}' + INTERVAL 6 HOUR AS next_at FROM s")
def reserved_states(spark, d):
    from newsloom.plans.catalogue import states

    return enrich.reserve(states(spark, d), _at()).select("event_id", "status", "attempts", "next_at")


@query("""WITH c AS (SELECT doc_id, text, sha256(text) AS source_hash, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 ELSE 0 END AS next FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text))
SELECT source_hash, CAST(next AS BIGINT) AS next, nullif(substr(text, CAST(next * 3000 + 1 AS BIGINT), 3000), '') AS chunk, next >= ceil(length(text) / 3000.0) AS complete FROM c""")
def translation_chunks(spark, d):
    D = F.col("doc_id")
    docs = rank.first_per(table(spark, d, "documents").select("doc_id", "text"), ["text"], D)
    state = docs.filter("doc_id % 2 = 0").select(F.sha2("text", 256).alias("source_hash"), (D % 3).alias("next"))
    got = enrich.chunk_progress(state.withColumn("next", F.col("next").cast("int")), docs)
    return got.select("source_hash", F.col("next").cast("long").alias("next"), "chunk", "complete")


RUN = {"repository": "a/b", "ref": "main"}
#: Reports of the events: half of the errors and purchases are throttled model calls, some with hints, deadlines or flaws.
REPORTS = f"""SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 2 ELSE 1 END AS schema_version, CASE WHEN user_id % 10 = 0 THEN 'other' ELSE 'main' END AS ref, ts AS started_at,
  ts + to_seconds(CAST(floor(value) AS BIGINT) - CASE WHEN user_id % 11 = 0 THEN 9999 ELSE 0 END) AS finished_at, CASE WHEN value > 20 THEN CAST(floor(value * 1500) AS BIGINT) END AS hint, user_id % 4 = 0 AS dated,
  CASE WHEN user_id % 8 = 0 THEN ts + to_seconds(CAST(floor(value * 4000) AS BIGINT)) END AS explicit_at FROM events WHERE event_type IN ('error', 'purchase') AND user_id % 2 = 0"""
REJECTIONS = f"""r AS ({REPORTS}), w AS (SELECT *, greatest(21600, CASE WHEN hint BETWEEN 0 AND 604800 THEN hint ELSE 0 END) AS wait FROM r),
x AS (SELECT *, CASE WHEN schema_version <> 1 OR ref <> 'main' OR started_at > finished_at OR finished_at > TIMESTAMP '{AT}' + INTERVAL 1 MINUTE THEN 'invalid_report'
  WHEN dated AND (explicit_at IS NULL OR explicit_at < started_at + to_seconds(wait)) THEN 'invalid_deadline' END AS problem FROM w),
y AS (SELECT event_id, problem, CASE WHEN problem IS NULL THEN CASE WHEN dated THEN explicit_at ELSE finished_at + to_seconds(wait) END END AS until FROM x)"""


def _reports(spark, d):
    U, V = F.col("user_id"), F.col("value")
    ended = F.col("ts") + F.make_dt_interval(secs=(F.floor(V) - F.when(U % 11 == 0, 9999).otherwise(0)).cast("decimal(18,6)"))
    explicit = F.when(U % 8 == 0, F.col("ts") + F.make_dt_interval(secs=F.floor(V * 4000).cast("decimal(18,6)")))
    rows = table(spark, d, "events").select(
        "event_id", F.when(U % 9 == 0, 2).otherwise(1).alias("schema_version"), F.lit("enrich").alias("stage"), F.lit("failed").alias("status"), F.lit("a/b").alias("repository"),
        F.when(U % 10 == 0, "other").otherwise("main").alias("ref"), F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("started_at"), ended.alias("finished_at"),
        F.when(F.col("event_type").isin("error", "purchase"), "model").otherwise("wait").alias("operation"), F.when(U % 2 == 0, 429).otherwise(500).alias("http_status"),
        F.when(V > 20, F.floor(V * 1500)).alias("hint"), explicit.alias("explicit_at"), (U % 4 == 0).alias("dated"),
    )
    return rows


@query(f"WITH {REJECTIONS} SELECT event_id, problem, until FROM y")
def rejection_deadlines(spark, d):
    return enrich.rejections(_reports(spark, d), RUN, _at()).select(F.col("run_id").cast("long").alias("event_id"), "problem", "until")


@query(f"""WITH {REJECTIONS}, own AS (SELECT event_type, y.until, y.problem FROM events LEFT JOIN y USING (event_id)),
k AS (SELECT 'all' AS reports, max(until) AS found, bool_or(problem IS NOT NULL) AS refused, TIMESTAMP '2024-01-19' AS held FROM own UNION ALL
  SELECT 'valid', max(until), false, TIMESTAMP '2024-01-19' FROM own WHERE problem IS NULL UNION ALL SELECT 'none', NULL, false, NULL UNION ALL SELECT 'later', max(until), false, TIMESTAMP '2030-01-01' FROM own WHERE problem IS NULL)
SELECT reports, CASE WHEN NOT refused AND (held IS NULL OR found > held) THEN found ELSE held END AS until, CASE WHEN refused THEN 'refused' WHEN held IS NULL THEN 'missing_evidence'
  WHEN greatest(found, held) > TIMESTAMP '{AT}' THEN 'active' ELSE 'expired' END AS status, NOT refused AND coalesce(found > held, false) AS changed FROM k""")
def migrated_cooldown(spark, d):
    """With all reports, of which some are invalid; with the valid ones; without any; and with a later deadline that's there."""
    reports = _reports(spark, d)
    good = reports.join(enrich.rejections(reports, RUN, _at()).filter("problem IS NULL").select("run_id"), "run_id", "left_semi")
    held = lambda until: spark.createDataFrame([(until, "x")] if until else [], "u string, cause string").select(F.col("u").cast("timestamp_ntz").alias("until"), "cause")
    out = None
    for name, rows, until in (("all", reports, "2024-01-19"), ("valid", good, "2024-01-19"), ("none", reports.limit(0), None), ("later", good, "2030-01-01")):
        got = enrich.migrate_cooldown(rows, held(until), RUN, _at()).select(F.lit(name).alias("reports"), "until", "status", "changed")
        out = got if out is None else out.unionByName(got)
    return out


@query("""SELECT event_id // 3 AS page_id, arg_min(CASE WHEN event_id % 5 = 1 THEN 'ready' ELSE 'pending' END, event_id) AS status, arg_min(CAST(event_id % 4 AS INTEGER), event_id) AS attempts FROM events WHERE event_id % 5 IN (1, 2) GROUP BY 1""")
def stored_states(spark, d):
    E = F.col("event_id")
    state = F.concat(F.lit('{"marker":"enrichment-state","status":"'), F.when(E % 5 == 1, "ready").otherwise("pending"), F.lit('","attempts":'), (E % 4).cast("string"), F.lit("}"))
    text = F.when((E % 5).isin(1, 2), state).when(E % 5 == 3, "garbage").when(E % 5 == 4, '{"marker":"other","attempts":1}').otherwise('{"marker":"enrichment-state"}')
    return enrich.page_states(table(spark, d, "events").select(F.floor(E / 3).alias("page_id"), E.alias("n"), text.alias("text"))).select("page_id", "status", "attempts")


FAILED = ["timeout", "http_error", "a secret text"]
CODED = ['"rate_limited"', '"secret code"', "null", "429", '"429"']
TYPED = ['"server_error"', '"https://secret"', "7"]


@query(f"""WITH e AS (SELECT *, event_type <> 'view' AND event_id % 3 < 2 AS kept, CAST(floor(value * 2) AS INTEGER) AS status, CAST(floor(value * 2000) AS INTEGER) AS wait FROM events)
SELECT event_id, CASE WHEN kept THEN {pick_sql(FAILED, 'event_id')} END AS reason, CASE WHEN kept AND status BETWEEN 100 AND 599 THEN status END AS http_status,
  CASE WHEN kept THEN ['rate_limited', 'unrecognized', 'unrecognized', 'unrecognized', 'unrecognized', NULL][CAST(event_id % 6 AS INTEGER) + 1] END AS code,
  CASE WHEN kept THEN ['string', 'other'][CAST(event_id % 3 AS INTEGER) + 1] END AS code_kind, CASE WHEN kept AND event_id % 7 < 2 THEN ['missing', 'present'][CAST(event_id % 7 AS INTEGER) + 1] END AS code_status,
  CASE WHEN kept THEN ['server_error', 'unrecognized', 'unrecognized', NULL][CAST(event_id % 4 AS INTEGER) + 1] END AS provider_type, CASE WHEN kept AND wait <= 604800 AND event_id % 5 <> 0 THEN wait END AS retry_after FROM e""")
def kept_failures(spark, d):
    """Failures with the events' values as status and hint; hints in quotes, unknown codes and free texts don't pass."""
    E = F.col("event_id")
    wait = F.floor(F.col("value") * 2000).cast("string")
    parts = [
        F.concat(F.lit('"stage":"'), F.when(F.col("event_type") == "view", "load").otherwise("model"), F.lit('"')), F.concat(F.lit('"reason":"'), pick(FAILED, E), F.lit('"')),
        F.concat(F.lit('"httpStatus":'), F.floor(F.col("value") * 2).cast("string")), F.when(E % 6 < 5, F.concat(F.lit('"code":'), pick([*CODED, "0"], E))),
        F.concat(F.lit('"codeKind":"'), pick(["string", "other", "odd"], E), F.lit('"')), F.concat(F.lit('"codeStatus":"'), pick(["missing", "present", "a", "b", "c", "d", "e"], E), F.lit('"')),
        F.when(E % 4 < 3, F.concat(F.lit('"providerType":'), pick([*TYPED, "0"], E))), F.concat(F.lit('"retryAfterSeconds":'), F.when(E % 5 == 0, F.concat(F.lit('"'), wait, F.lit('"'))).otherwise(wait)), F.concat(F.lit('"message":"'), "props", F.lit('"')),
    ]
    raw = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    rows = table(spark, d, "events").withColumn("props", F.lit("secret")).select("event_id", enrich.safe_failure(raw).alias("f"))
    return rows.select("event_id", *(F.col(f"f.{c}").alias(c) for c in ("reason", "http_status", "code", "code_kind", "code_status", "provider_type", "retry_after")))


@query("SELECT doc_id AS page_id, i // 2 AS call, CAST(i AS INTEGER) AS n, substr(text, i * 500 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range((length(text) + 499) // 500)) AS i FROM documents)")
def append_calls(spark, d):
    D = F.col("doc_id")
    return enrich.append_batches(table(spark, d, "documents").select(D.alias("page_id"), "text"), 500, 2)


GOOD = "The page says that this is a long passage of its own."


@query(f"""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 THEN 'A summary with GPT-5 and 42 items inside' END AS summary,
  CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 THEN 'ready' ELSE 'invalid_response' END AS status FROM events""")
def grounded_answers(spark, d):
    """Answers of which some are good: others aren't relevant, quote what isn't there, name what the body doesn't, or are too short."""
    E = F.col("event_id")
    body = F.lit(f"About ai: a summary with gpt-5 and 42 items inside. {GOOD} And some more words, so that this body is long enough to be used.")
    summary = F.when(E % 5 == 0, "A summary with GPT-6 and 42 items inside").when(E % 7 == 0, "short").otherwise("A summary with GPT-5 and 42 items inside")
    raw = F.concat(F.lit('```json\n{"relevant":'), F.when(E % 2 == 0, "true").otherwise("false"), F.lit(',"summary":" '), summary, F.lit(' ","evidence":["'), F.when(E % 3 == 0, "This passage is nowhere in the body.").otherwise(GOOD), F.lit('"]}\n```'))
    s = enrich.transition(F.lit(0), body, raw, F.lit(None).cast("int"), F.lit(None).cast("int"), _at(), F.lit(False))
    return table(spark, d, "events").select("event_id", enrich.grounded(raw, body)["summary"].alias("summary"), s["status"].alias("status"))


# brief and site


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderkey % 4 <> 0 AND o_totalprice >= 50000""")
def usable_runs(spark, d):
    """Orders as runs: their priority is the conclusion, cheap ones name no commit."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("in_progress")
    ends = {"1-URGENT": "success", "2-HIGH": "failure", "3-MEDIUM": "timed_out", "4-NOT SPECIFIED": "cancelled"}
    conclusion = F.lit(None).cast("string")
    for k, v in ends.items():
        conclusion = F.when(F.col("o_orderpriority") == k, v).otherwise(conclusion)
    run = F.struct(F.col("o_custkey").cast("string").alias("id"), (F.col("o_orderkey") % 4).alias("attempt"), F.when(F.col("o_totalprice") >= 50000, F.sha2("o_orderstatus", 256)).otherwise("").alias("sha"))
    return brief.usable_run(table(spark, d, "orders").select("o_orderkey", status.alias("status"), conclusion.alias("conclusion"), run.alias("run"))).select("o_orderkey")


@query(f"""WITH e AS (SELECT *, ts AS ended, ts - to_seconds(CAST(floor(value) AS BIGINT)) AS began, event_type <> 'view' AS same, user_id % 5 = 0 AS none FROM events),
f AS (SELECT event_id, NOT none AND same AND began <= TIMESTAMP '{AT}' AND ended <= TIMESTAMP '{AT}' + INTERVAL 1 MINUTE AND ended > TIMESTAMP '{AT}' - INTERVAL 8 HOUR AND event_type <> 'signup' AS collection_valid,
  user_id % 7 <> 0 AND event_type <> 'error' AS ready, abs(epoch(ts) - epoch(TIMESTAMP '{AT}')) <= 180 AS source_read, NOT none AND event_type = 'purchase' AND floor(value) % 3 = 0 AS collected,
  event_type IN ('click', 'purchase') AND floor(value) % 3 = 0 AS enriched, CASE WHEN none THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS fetched FROM e) SELECT * FROM f""")
def run_flags(spark, d):
    """Events as runs with their reports: views have a report of another run, every fifth user has none."""
    E, V = F.col("event_type"), F.floor("value")
    run = lambda attempt: F.struct(F.lit("a/b").alias("repository"), F.lit("main").alias("ref"), F.col("event_id").cast("string").alias("runId"), attempt.alias("attempt"), F.lit("c0").alias("sha"))
    stats = F.struct(V.alias("fetched"), (V % 3).alias("pending"))
    state = F.when(E == "signup", "running").when(E == "purchase", "success").otherwise("failed")
    began = F.col("ts") - F.make_dt_interval(secs=V.cast("decimal(18,6)"))
    collection = F.struct(F.lit(1).alias("schemaVersion"), F.lit("collect").alias("stage"), run(F.when(E == "view", 2).otherwise(1)).alias("run"), state.alias("status"), began.alias("startedAt"), F.col("ts").alias("finishedAt"), stats.alias("stats"))
    enrichment = F.struct(F.lit(1).alias("schemaVersion"), F.lit("enrich").alias("stage"), run(F.lit(1)).alias("run"), F.when(E.isin("click", "purchase"), "success").otherwise("failed").alias("status"), F.col("ts").alias("startedAt"), F.col("ts").alias("finishedAt"), stats.alias("stats"))
    rows = table(spark, d, "events").select(
        "event_id", run(F.lit(1)).alias("run"), F.when(F.col("user_id") % 5 != 0, collection).alias("collection"), enrichment.alias("enrichment"), F.when(E == "error", "cancelled").when(E == "purchase", "success").otherwise("failure").alias("collection_result"),
        F.lit("success").alias("enrichment_result"), (F.col("user_id") % 7 != 0).alias("ready"), F.lit(None).cast("boolean").alias("read_failed"), F.col("ts").alias("source_read_at"), F.lit(False).alias("limited"),
    )
    return brief.report_flags(rows, _at()).select("event_id", "collection_valid", "ready", "source_read", "collected", "enriched", "fetched")


@query(f"""WITH s AS (SELECT doc_id, lang, source, ts, substr(text, 1, 10 + CAST(doc_id % 500 AS INTEGER)) || repeat(' ', CAST(doc_id % 60 AS INTEGER)) AS summary, string_split(text, chr(10)) AS lines FROM documents JOIN events ON event_id = doc_id)
SELECT doc_id FROM s WHERE lang <> 'fr' AND length(trim(summary, ' ' || chr(9) || chr(10))) >= 30 AND length(summary) <= 500 AND source <> 'src3' AND ts <= TIMESTAMP '2024-01-02 12:01:00'
  AND len(lines) BETWEEN 1 AND 5 AND len(list_filter(lines, lambda q: length(trim(q, ' ' || chr(9) || chr(10))) < 20)) = 0""")
def grounded_candidates(spark, d):
    """Documents as candidates: beginnings, padded, as summaries, their lines as quotations; one source's hashes are of another text."""
    D = F.col("doc_id")
    rows = table(spark, d, "documents").join(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    summary = F.concat(F.substring("text", F.lit(1), (10 + D % 500).cast("int")), F.repeat(F.lit(" "), (D % 60).cast("int")))
    rows = rows.select("doc_id", F.when(F.col("lang") != "fr", "source_quoted").otherwise("excerpt").alias("summary_kind"), summary.alias("summary"), F.when(F.col("source") != "src3", F.sha2(summary, 256)).otherwise("other").alias("summary_hash"), F.col("ts").alias("summary_recorded_at"), F.split("text", "\n").alias("evidence"))
    return rows.filter(brief.grounded_candidate(F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))).select("doc_id")


@query(f"""WITH p AS (SELECT event_id, ts, ts - to_hours(CAST(event_id % 200 AS INTEGER)) AS published, event_id % 100 AS score FROM events WHERE event_id % 5 <> 0),
g AS (SELECT * FROM p WHERE ts >= TIMESTAMP '{AT}' - INTERVAL 24 HOUR AND published BETWEEN TIMESTAMP '{AT}' - INTERVAL 168 HOUR AND TIMESTAMP '{AT}' ORDER BY published DESC, ts DESC, score DESC, event_id LIMIT 48)
SELECT event_id, published AS published_at FROM g WHERE event_id % 2 = 0""")
def brief_candidates(spark, d):
    E = F.col("event_id")
    rows = table(spark, d, "events").select(E.alias("page_id"), E.alias("ordinal"), F.col("ts").alias("fetched_at"), (F.col("ts") - F.make_dt_interval(hours=(E % 200).cast("int"))).alias("published_at"), (E % 100).alias("score"), F.when(E % 5 != 0, "s").otherwise("").alias("summary"))
    states = table(spark, d, "events").select(E.alias("page_id"), F.when(E % 2 == 0, "ready").otherwise("pending").alias("status"), F.lit("article_body").alias("input"))
    return brief.candidates(rows, states, _at())[0].select(F.col("page_id").alias("event_id"), "published_at")


@query("""WITH t AS (SELECT doc_id, url, source, ts, split_part(text, chr(10), 1) AS title, substr(text, 1, 200) AS summary, lang, row_number() OVER (ORDER BY ts DESC, doc_id) AS n
  FROM documents JOIN events ON event_id = doc_id JOIN pages ON page_id = doc_id ORDER BY n LIMIT 3)
SELECT string_agg(n || '. ' || regexp_replace(title, '\\s+', ' ', 'g') || chr(10) || '   出典: ' || source || ' · 公開 ' || CASE WHEN lang = 'en' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE '不明' END || ' · 収集 ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
  || chr(10) || '   ' || url || chr(10) || '   自動要約: ' || coalesce(nullif(summary, ''), '本文根拠のある要約は未生成です。'), chr(10) || chr(10) ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, n) AS markdown FROM (
  SELECT * REPLACE (row_number() OVER (ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, n) AS n) FROM t)""")
def brief_markdown(spark, d):
    """The three latest documents; those that aren't English have no date of publication."""
    docs = table(spark, d, "documents").join(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id").join(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    rows = docs.orderBy(F.desc("ts"), "doc_id").limit(3)
    rows = rows.select(F.col("doc_id").alias("ordinal"), F.substring_index("text", "\n", 1).alias("title"), "url", "source", F.when(F.col("lang") == "en", F.col("ts")).alias("published_at"), F.col("ts").alias("fetched_at"), F.lit(0).alias("score"), F.substring("text", 1, 200).alias("summary"), F.lit("source_quoted").alias("summary_kind"))
    return brief.markdown(rows)


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN ts - INTERVAL 5 DAY END, CASE WHEN event_id % 2 <> 0 THEN ts END) AS shown, coalesce(CASE WHEN event_id % 2 <> 0 THEN ts END, CASE WHEN event_id % 3 <> 0 THEN ts - INTERVAL 5 DAY END) AS ordered FROM events")
def shown_dates(spark, d):
    E = F.col("event_id")
    published, fetched = F.when(E % 3 != 0, F.col("ts") - F.expr("interval 5 days")), F.when(E % 2 != 0, F.col("ts"))
    return table(spark, d, "events").select("event_id", site.display_date(published, fetched).alias("shown"), site.order_date(published, fetched).alias("ordered"))


@query(f"""WITH p AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 'u' || event_id ELSE '' END AS url, CASE WHEN event_id % 11 <> 0 THEN 't' END AS title, {pick_sql([*NAMES, None], 'event_id')} AS source, CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) END AS score,
  {pick_sql(['Unread', 'Starred', None, 'Odd'], 'event_id')} AS status, {pick_sql([None, 'ja', 'xx'], 'event_id')} AS lang, {pick_sql([None, 'secondary', 'other', None, None], 'event_id')} AS kind FROM events)
SELECT event_id, coalesce(p.source, 'Unknown') AS source, CASE WHEN p.status IN ('Unread', 'Digested', 'Read', 'Starred') THEN p.status ELSE 'Unread' END AS status, coalesce(score, 0) AS score,
  CASE WHEN coalesce(p.lang, dim.lang) IN ('en', 'ja') THEN coalesce(p.lang, dim.lang) ELSE 'en' END AS lang, CASE WHEN coalesce(p.kind, dim.kind) IN ('primary', 'secondary') THEN coalesce(p.kind, dim.kind) ELSE 'primary' END AS kind
FROM p LEFT JOIN {DIMS_SQL} ON dim.source = p.source WHERE url <> '' AND title IS NOT NULL""")
def exported_rows(spark, d):
    E = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(E % 7 != 0, F.concat(F.lit("u"), E.cast("string"))).otherwise("").alias("url"), F.when(E % 11 != 0, "t").alias("title"), pick([*NAMES, None], E).alias("source"), F.when(F.col("event_type") != "view", F.floor("value")).alias("score"), pick(["Unread", "Starred", None, "Odd"], E).alias("status"), pick([None, "ja", "xx"], E).alias("lang"), pick([None, "secondary", "other", None, None], E).alias("kind"))
    return site.coerce(site.export_rows(rows, dims.source_dim(spark))).select("event_id", "source", "status", "score", "lang", "kind")


@query("SELECT DISTINCT c_custkey AS url_key FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders")
def confirmed_keys(spark, d):
    """Customers who owe are confirmed already; those of the orders come to them."""
    return queue.confirm(table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("url_key")), table(spark, d, "orders").select(F.col("o_custkey").alias("url_key")))


@query("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS ordinal, c_custkey FROM customer")
def numbered(spark, d):
    return readers.ordinals(table(spark, d, "customer").select("c_acctbal", "c_custkey"), F.col("c_acctbal"), F.col("c_custkey")).select("ordinal", "c_custkey")
