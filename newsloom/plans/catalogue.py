"""The driver's queries over its tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import text as X
from newsloom.functions import urls as U
from newsloom.operators import brief, enrich, feedback, queue, rank, site
from newsloom.plans.adapter import ART_SQL, BONUS, CATEGORIES, NOW, articles, key_sql, now, source_dim, table
from newsloom.sources import readers
from newsloom.streaming import stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
WORDS = ["the", "of", "que", "der", "ai", "release", "that"]
ART = f"WITH {ART_SQL} "
TS = f"TIMESTAMP '{NOW}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scored(spark: SparkSession, d: str) -> DataFrame:
    return rank.score(articles(spark, d), source_dim(spark), BONUS, CATEGORIES)


def deduped(spark: SparkSession, d: str) -> DataFrame:
    """Scored after deduplication, as a run does it; ``ordinal`` is the place of the key's first article."""
    return rank.score(rank.dedup_by_url(articles(spark, d)), source_dim(spark), BONUS, CATEGORIES)


@query(ART + "SELECT place AS ordinal, title, url, source, score, categories FROM best WHERE score >= 30 ORDER BY score DESC, place LIMIT 20")
def ranked_feed(spark, d):
    return rank.ranked(deduped(spark, d)).limit(20).select("ordinal", "title", "url", "source", "score", F.array_join("category", ",").alias("categories"))


@query(f"SELECT page_id, {key_sql('url')} AS url_key FROM pages")
def url_key_pages(spark, d):
    return table(spark, d, "pages").select("page_id", U.url_key(F.col("url")).alias("url_key"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) ||
  coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') ||
  coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'ref')), '&'), ''), '') AS url FROM pages""")
def url_normalised_pages(spark, d):
    return table(spark, d, "pages").select("page_id", U.fetch_url(F.col("url")).alias("url"))


@query(f"""WITH k AS (SELECT page_id, url, {key_sql('url')} AS key FROM pages),
s AS (SELECT page_id, url, split_part(key, '?', 1) AS b, CASE WHEN contains(key, '?') THEN '?' || split_part(key, '?', 2) ELSE '' END AS q FROM k),
e AS (SELECT page_id, url, h || www || b || tail || q AS v, b, tail FROM s, (VALUES ('https://'), ('http://')) a(h), (VALUES (''), ('www.')) c(www), (VALUES (''), ('/')) t(tail)),
every AS (SELECT page_id, v FROM e UNION SELECT page_id, url FROM pages)
SELECT page_id, string_agg(v, ' ' ORDER BY v) AS spellings FROM every GROUP BY page_id""")
def url_spellings(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(U.spellings(F.col("url"))), " ").alias("spellings"))


@query(f"""WITH k AS (SELECT page_id, url, value, {key_sql('url')} AS url_key FROM pages JOIN events ON event_id = page_id)
SELECT first_ AS ordinal, url_key, url FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY coalesce(value, 0) DESC, page_id) rn, min(page_id) OVER (PARTITION BY url_key) first_ FROM k) WHERE rn = 1""")
def dedup_pages(spark, d):
    votes = table(spark, d, "events").select(F.col("event_id").alias("page_id"), F.col("value").alias("crowd_score"))
    pages = table(spark, d, "pages").select("page_id", "url").join(votes, "page_id").select(F.col("page_id").alias("ordinal"), "url", "crowd_score", F.lit(0).alias("score"))
    return rank.dedup_by_url(pages).select("ordinal", "url_key", "url")


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def dedup_first_per_source(spark, d):
    return rank.first_per(table(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], F.col("doc_id"))


@query("SELECT user_id, min(event_id) AS ordinal, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id ORDER BY 2 LIMIT 10")
def last_wins_first_position(spark, d):
    return rank.last_wins(table(spark, d, "events").select(F.col("event_id").alias("ordinal"), "user_id", "event_type"), "user_id")


@query(r"SELECT doc_id, regexp_matches(lower(text), '\bthe\b|\bof\b|\bque\b|\bder\b|\bai\b|release|that') AS matched FROM documents")
def keyword_match_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", X.matches_keyword(F.col("text"), WORDS).alias("matched"))


@query(rf"""{ART} SELECT a.ordinal, a.source FROM art a JOIN (VALUES ('src0', 30, NULL), ('src1', 7, 20.0), ('src2', NULL, 20.0)) c(source, days, least_) USING (source)
WHERE trim(a.title) <> '' AND (a.source <> 'src1' OR regexp_matches(lower(a.title || ' ' || a.abstract), '\bai\b|\bof\b|that'))
  AND (c.least_ IS NULL OR a.crowd_score >= c.least_) AND (c.days IS NULL OR a.published_at IS NULL OR {TS} - a.published_at <= to_days(c.days))""")
def keyword_filter_by_feed(spark, d):
    config = spark.createDataFrame([("src0", "", [], 30, None, None), ("src1", "", ["ai", "of", "that"], 7, "votes", 20.0), ("src2", "", [], None, "votes", 20.0)], readers.FEED_CONFIG)
    a = articles(spark, d)
    items = a.select(F.col("source").alias("feed"), "title", F.concat(F.lit("http://x/"), F.col("ordinal").cast("string")).alias("link"), F.col("abstract").alias("contentSnippet"), F.lit(None).cast("string").alias("content"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("isoDate"), F.lit(None).cast("string").alias("pubDate"), F.when(F.col("crowd_score").isNotNull(), F.create_map(F.lit("votes"), F.col("crowd_score").cast("string"))).alias("extensions"))
    out = readers.feed_articles(items, config, now())
    return out.select(F.substring_index("url", "/", -1).cast("long").alias("ordinal"), "source")


@query(r"SELECT conv_id, turn, role = 'system' OR regexp_matches(lower(text), '\bthe\b|\bof\b|\bque\b|\bder\b|\bai\b|release|that') AS relevant FROM conversations")
def tag_or_keyword(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", readers.tagged(F.array("role"), F.col("text"), ("system",), WORDS).alias("relevant"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'that') OR contains(lower(text), 'with') THEN 15 ELSE 0 END + CASE WHEN contains(lower(text), 'tion') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'que') OR contains(lower(text), 'der') THEN 5 ELSE 0 END AS bonus FROM documents")
def keyword_bonus(spark, d):
    return table(spark, d, "documents").select("doc_id", X.keyword_bonus(F.col("text"), BONUS).alias("bonus"))


@query("SELECT event_id, CASE WHEN value > 0 THEN least(60, CAST(round(18 * log10(value * 2 + 1)) AS INTEGER)) ELSE 0 END AS bonus FROM events")
def crowd_bonus(spark, d):
    return table(spark, d, "events").select("event_id", X.crowd_bonus(F.col("value"), F.lit(2.0)).alias("bonus"))


@query(ART + "SELECT ordinal, categories FROM full_")
def categorise(spark, d):
    text = F.concat("title", F.lit(" "), "abstract")
    return articles(spark, d).select("ordinal", F.array_join(X.categorise(text, CATEGORIES), ",").alias("categories"))


@query(ART + "SELECT ordinal, source, base, bonus, crowd, score, kind FROM full_")
def score_breakdown(spark, d):
    return scored(spark, d).select("ordinal", "source", "base", "bonus", "crowd", "score", "kind")


@query(ART + "SELECT ordinal, score FROM full_ WHERE score >= 90 ORDER BY score DESC, ordinal")
def score_threshold(spark, d):
    return rank.ranked(scored(spark, d), 90).select("ordinal", "score")


@query(ART + """, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, ordinal) AS rn FROM full_)
SELECT ordinal, source, score FROM (SELECT * FROM r ORDER BY (rn > 8)::INT, score DESC, ordinal LIMIT 50)""")
def diverse_topk(spark, d):
    return rank.diverse_top(scored(spark, d), 50).select("ordinal", "source", "score")


QUEUE_SQL = ART + f""", b AS (SELECT * FROM full_ WHERE ordinal % 3 = 0), i AS (SELECT * FROM full_ WHERE ordinal % 3 <> 0),
o AS (SELECT max(ordinal) + 1 AS off FROM b),
u AS (SELECT ordinal AS ord2, * FROM b UNION ALL SELECT ordinal + off AS ord2, i.* FROM i, o),
w AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY CAST(score AS DOUBLE) DESC, ord2) AS rn, min(ord2) OVER (PARTITION BY url_key) AS place FROM u),
f AS (SELECT url_key, arg_min(fetched_at, ordinal) AS f_at, max(published_at) FILTER (ordinal = m) AS p_at FROM (SELECT *, min(ordinal) OVER (PARTITION BY url_key) AS m FROM b) GROUP BY url_key),
c AS (SELECT DISTINCT url_key FROM full_ WHERE ordinal % 7 = 0),
q AS (SELECT w.place AS ordinal, w.url_key, w.score, coalesce(f.f_at, w.fetched_at) AS fetched_at, coalesce(f.p_at, w.published_at) AS published_at
  FROM w LEFT JOIN f USING (url_key) WHERE rn = 1 AND w.url_key NOT IN (SELECT url_key FROM c))
SELECT *, coalesce(published_at <= {TS} AND published_at > {TS} - INTERVAL 7 DAY, false) AS recent FROM q"""


@query(QUEUE_SQL)
def pending_priority(spark, d):
    a = scored(spark, d)
    old, new = a.filter("ordinal % 3 = 0"), a.filter("ordinal % 3 <> 0")
    done = a.filter("ordinal % 7 = 0").select(U.url_key(F.col("url")).alias("url_key"))
    return queue.merge_pending(old, new, done, now()).select("ordinal", "url_key", "score", "fetched_at", "published_at", "recent")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unsaved_anti_join(spark, d):
    return queue.unsaved(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def existing_semi_join(spark, d):
    return queue.existing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(ART + ", t AS (SELECT DISTINCT url_key FROM full_ WHERE ordinal % 2 = 0) SELECT CASE WHEN t.url_key IS NULL THEN 'created' ELSE 'existing' END AS outcome, count(DISTINCT f.url_key) AS n FROM full_ f LEFT JOIN t USING (url_key) GROUP BY 1")
def save_outcomes(spark, d):
    a = articles(spark, d).withColumn("url_key", U.url_key(F.col("url")))
    return queue.outcomes(queue.save_new(a, a.filter("ordinal % 2 = 0")))


@query("SELECT l_orderkey, l_linenumber, spent FROM (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS spent FROM lineitem) WHERE spent <= 60")
def deadline_cut(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return queue.within_budget(rows, "l_quantity", 60, ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "spent")


STATE = "SELECT event_id, ['pending', 'body_unavailable', 'rate_limited', 'model_failed', 'ready', 'non_ai'][CAST(event_id % 6 AS INTEGER) + 1] AS status, CAST(event_id % 5 AS INTEGER) AS attempts, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 6 HOUR END AS next_at FROM events"
CAN = "status IN ('pending', 'body_unavailable', 'rate_limited', 'model_failed') AND (status = 'rate_limited' OR attempts < 3) AND (next_at IS NULL OR next_at <= TIMESTAMP '2024-01-15 00:00:00')"


def states(spark, d):
    status = F.element_at(F.array(*(F.lit(s) for s in ("pending", "body_unavailable", "rate_limited", "model_failed", "ready", "non_ai"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", status.alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.expr("interval 6 hours")).alias("next_at"))


def may_run():
    return enrich.eligible(F.col("status"), F.col("attempts"), F.col("next_at"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query(f"WITH s AS ({STATE}) SELECT event_id, status FROM s WHERE {CAN} ORDER BY event_id LIMIT 10")
def bounded_fifo(spark, d):
    return queue.bounded_fifo(states(spark, d).withColumn("ordinal", F.col("event_id")), may_run()).select("event_id", "status")


@query(f"WITH s AS ({STATE}) SELECT event_id, status, attempts FROM s WHERE {CAN}")
def state_eligible(spark, d):
    return states(spark, d).filter(may_run()).select("event_id", "status", "attempts")


@query(f"WITH s AS ({STATE}) SELECT event_id, status, attempts FROM s WHERE (status <> 'rate_limited' AND attempts >= 3) OR status IN ('ready', 'non_ai')")
def state_finished(spark, d):
    return states(spark, d).filter(enrich.finished(F.col("status"), F.col("attempts"))).select("event_id", "status", "attempts")


@query(r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN text END AS body, doc_id % 7 = 0 AS throttled, doc_id % 5 = 0 AS failed, CAST(doc_id % 3 AS INTEGER) AS attempts, ts FROM documents JOIN events ON event_id = doc_id),
t AS (SELECT *, CASE WHEN body IS NULL THEN 'body_unavailable' WHEN length(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 120 THEN 'insufficient_evidence' WHEN NOT regexp_matches(lower(body), '\bthe\b|\bof\b|\bque\b|\bder\b|\bai\b|release|that') THEN 'non_ai'
  WHEN throttled THEN 'rate_limited' WHEN failed THEN 'model_failed' ELSE 'invalid_response' END AS status FROM s)
SELECT doc_id, status, attempts + CASE WHEN status = 'rate_limited' THEN 0 ELSE 1 END AS attempts, ts + CASE WHEN status = 'rate_limited' THEN INTERVAL 10 HOUR ELSE INTERVAL 6 HOUR END AS next_at FROM t""")
def state_transition(spark, d):
    at = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "ts")
    rows = table(spark, d, "documents").select("doc_id", "text").join(at, "doc_id")
    body = F.when(F.col("doc_id") % 11 != 0, F.col("text"))
    s = enrich.transition((F.col("doc_id") % 3).cast("int"), body, F.lit("no json"), F.when(F.col("doc_id") % 7 == 0, 429), F.lit(36000), F.col("ts"), F.col("doc_id") % 5 == 0, WORDS)
    return rows.select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("SELECT max(ts) AS until, arg_max(event_type, (ts, -event_id)) AS cause FROM events WHERE value > 100")
def cooldown_fold(spark, d):
    return enrich.cooldown(table(spark, d, "events").filter("value > 100"), "ts", "event_type", F.col("event_id"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<footer|$)', 1) AS inner_, contains(html, '<article>') AS there FROM pages),
b AS (SELECT page_id, generate_subscripts(s, 1) AS i, unnest(s) AS t FROM (SELECT page_id, string_split_regex(inner_, '</?(?:p|h1|h2|h3|li)>') AS s FROM a)),
t AS (SELECT page_id, i, trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp(;|$)', '&amp;', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM b),
c AS (SELECT *, sum(length(t)) OVER (PARTITION BY page_id ORDER BY i) AS total FROM t WHERE length(t) >= 10),
k AS (SELECT page_id, count(*) AS n, string_agg(t, chr(10) ORDER BY i) AS body FROM c WHERE total <= 12000 GROUP BY 1)
SELECT page_id, coalesce(n, 0) AS n, coalesce(body, '') AS body, CASE WHEN NOT there THEN 'missing_article' WHEN n IS NULL THEN 'empty_article' END AS reason FROM a LEFT JOIN k USING (page_id)""")
def html_paragraphs(spark, d):
    return table(spark, d, "pages").select("page_id", H.body("html").alias("b")).select("page_id", F.size("b.paragraphs").cast("long").alias("n"), F.array_join("b.paragraphs", "\n").alias("body"), "b.reason")


@query(r"SELECT doc_id, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 120 THEN 'insufficient_evidence' WHEN NOT regexp_matches(lower(text), '\bthe\b|\bof\b|\bque\b|\bder\b|\bai\b|release|that') THEN 'non_ai' ELSE 'ok' END AS gate FROM documents")
def body_status(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(enrich.gate(F.col("text"), WORDS), F.lit("ok")).alias("gate"))


TERMS = "[A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*|\\d+(?:\\.\\d+)?"


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark)
SELECT doc_id, len(list_filter(regexp_extract_all(lower(b.text), '{TERMS}'), lambda t: NOT list_contains(regexp_extract_all(lower(d.text), '{TERMS}'), t))) = 0 AS supported
FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n.n""")
def grounded_terms(spark, d):
    return _with_item(spark, d).select("doc_id", enrich.supported(F.col("item"), F.col("text")).alias("supported"))


@query("SELECT doc_id, length(trim(substr(b.text, 1, 60))) >= 20 AND contains(d.text, substr(b.text, 1, 60)) AS quoted FROM documents d, (SELECT count(*) AS n FROM benchmark) n JOIN benchmark b ON b.item_id = d.doc_id % n.n")
def verbatim_quotes(spark, d):
    return _with_item(spark, d).select("doc_id", enrich.quoted(F.array(F.substring("item", 1, 60)), F.col("text")).alias("quoted"))


def _with_item(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(max(1, items.count()))).alias("item_id"))
    return docs.join(items, "item_id")


BRIEF = ART + """, g AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY published_at DESC, fetched_at DESC, score DESC, ordinal) AS rn FROM full_
  WHERE fetched_at <= TIMESTAMP '2024-01-03 06:01:00' AND fetched_at > TIMESTAMP '2024-01-02 06:00:00' AND published_at <= TIMESTAMP '2024-01-03 06:01:00' AND published_at > TIMESTAMP '2023-12-27 06:00:00' AND regexp_matches(url, '^https?://') AND trim(title) <> ''),
s AS (SELECT * FROM g WHERE rn = 1 ORDER BY published_at DESC, fetched_at DESC, score DESC, ordinal LIMIT 3) """
AT = "2024-01-03 06:00:00"


def _selected(spark, d):
    return brief.select(scored(spark, d), F.lit(AT).cast("timestamp_ntz"))


@query(BRIEF + "SELECT ordinal, url, sha256(url_key) AS id, published_at FROM s")
def brief_top3(spark, d):
    return _selected(spark, d).select("ordinal", "url", "id", "published_at")


@query(BRIEF + f"SELECT least(TIMESTAMP '{AT}' + INTERVAL 8 HOUR, min(least(fetched_at + INTERVAL 24 HOUR, published_at + INTERVAL 168 HOUR))) AS valid_until, count(*) AS n FROM s")
def brief_expiry(spark, d):
    return brief.expiry(_selected(spark, d), F.lit(AT).cast("timestamp_ntz"))


@query("""WITH r AS (SELECT event_id, event_id % 13 <> 0 AS collection_valid, event_id % 11 <> 0 AS ready, event_id % 7 <> 0 AS source_read, event_id % 5 <> 0 AS collected, event_id % 3 <> 0 AS enriched, event_id % 2 = 0 AS limited, event_id % 9 AS fetched, event_id % 4 AS n FROM events),
q AS (SELECT *, list_filter([CASE WHEN NOT collection_valid THEN 'collection_report_missing_or_wrong_run' END, CASE WHEN NOT ready THEN 'collection_not_ready' END, CASE WHEN NOT source_read THEN 'source_read_failed' END], lambda x: x IS NOT NULL) AS g,
  list_filter([CASE WHEN NOT collected THEN 'collection_incomplete' END, CASE WHEN NOT enriched THEN 'enrichment_incomplete' END, CASE WHEN limited THEN 'candidate_window_limited' END], lambda x: x IS NOT NULL) AS t FROM r),
z AS (SELECT *, g || t || CASE WHEN len(g) = 0 AND fetched > 0 AND n = 0 THEN ['no_grounded_recent_articles'] ELSE [] END AS reasons FROM q)
SELECT event_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(g) > 0 THEN 'unavailable' WHEN n = 0 THEN 'empty' WHEN len(reasons) > 0 THEN 'partial' ELSE 'ok' END AS status FROM z""")
def brief_status(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(e, (e % 13 != 0).alias("collection_valid"), (e % 11 != 0).alias("ready"), (e % 7 != 0).alias("source_read"), (e % 5 != 0).alias("collected"), (e % 3 != 0).alias("enriched"), (e % 2 == 0).alias("limited"), (e % 9).alias("fetched"), (e % 4).alias("n_articles"))
    return brief.status(rows).select("event_id", F.array_join("reasons", ",").alias("reasons"), "status")


RANKED = "row_number() OVER (PARTITION BY {0} ORDER BY score DESC, fetched_at DESC, ordinal) AS rn"


@query(ART + f"SELECT source, rn, ordinal, score FROM (SELECT *, {RANKED.format('source')} FROM full_) WHERE rn <= 200")
def facet_source_top(spark, d):
    return site.facet_top(scored(spark, d), "source").select("source", "rn", "ordinal", "score")


@query(ART + f", e AS (SELECT ordinal, score, fetched_at, unnest(string_split(categories, ',')) AS category FROM full_) SELECT category, rn, ordinal, score FROM (SELECT *, {RANKED.format('category')} FROM e) WHERE rn <= 200")
def facet_category_top(spark, d):
    return site.facet_top(site.by_category(scored(spark, d).select("ordinal", "score", "fetched_at", "category")), "category").select("category", "rn", "ordinal", "score")


@query(ART + "SELECT ordinal, fetched_at, score FROM full_ ORDER BY fetched_at DESC, score DESC, ordinal LIMIT 200")
def front_page(spark, d):
    return site.front_page(scored(spark, d)).select("ordinal", "fetched_at", "score")


@query(ART + f""", t AS (SELECT * FROM (SELECT *, {RANKED.format('source')} FROM full_) WHERE rn <= 200), p AS (SELECT source, ordinal, CAST(ceil(rn / 10.0) AS BIGINT) AS page_no, CAST(ceil(count(*) OVER (PARTITION BY source) / 10.0) AS BIGINT) AS last_page FROM t)
SELECT *, CASE WHEN page_no > 1 THEN page_no - 1 ELSE 0 END AS prev_page, CASE WHEN page_no < last_page THEN page_no + 1 ELSE 0 END AS next_page FROM p""")
def paginate(spark, d):
    return site.paginate(scored(spark, d), "source", 10).select("source", "ordinal", "page_no", "last_page", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("prev_page", "next_page")))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey FROM orders")
def month_archive(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").alias("fetched_at"), F.lit(0).alias("score"))
    return site.month_archive(rows).select("month", F.col("ordinal").alias("o_orderkey"))


@query("WITH n AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, n, greatest(2, CAST(floor(100 * n / max(n) OVER () + 0.5) AS INTEGER)) AS width FROM n")
def month_histogram(spark, d):
    return site.month_histogram(table(spark, d, "orders"), "o_orderdate")


@query(ART + f", p AS (SELECT CAST(ceil(row_number() OVER (PARTITION BY source ORDER BY score DESC, fetched_at DESC, ordinal) / 50.0) AS BIGINT) AS page_no, source, fetched_at FROM full_) SELECT page_no, CAST(fetched_at AS DATE) AS day, count(*) AS n FROM p WHERE page_no <= 4 GROUP BY 1, 2")
def day_groups(spark, d):
    return site.day_groups(site.paginate(scored(spark, d), "source"))


@query("WITH m AS (SELECT user_id, event_type, event_id, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS s FROM events), g AS (SELECT *, sum(s::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM g GROUP BY 1, 2, 3")
def event_runs(spark, d):
    return site.runs(table(spark, d, "events"), "user_id", "event_type", F.col("event_id")).select("user_id", "run", "event_type", "n")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, d):
    return site.source_counts(table(spark, d, "documents"))


@query(ART + "SELECT count(*) AS total, count(*) FILTER (lang = 'ja') AS japanese, count(*) FILTER (fetched_at >= TIMESTAMP '2024-04-01 00:00:00' - INTERVAL 90 DAY) AS in_window, count(DISTINCT source) AS sources, min(fetched_at) AS oldest FROM art")
def export_stats(spark, d):
    return site.export_stats(articles(spark, d), F.lit("2024-04-01 00:00:00").cast("timestamp_ntz"))


INDEX = ART + ", x AS (SELECT ordinal, title, source, categories, score, status, fetched_at, lower(title || ' ' || source || ' ' || replace(categories, ',', ' ')) AS haystack FROM full_ WHERE coalesce(fetched_at, published_at) >= TIMESTAMP '2024-04-01 00:00:00' - INTERVAL 90 DAY)"


def _index(spark, d):
    return site.search_index(scored(spark, d), F.lit("2024-04-01 00:00:00").cast("timestamp_ntz"))


@query(INDEX + "SELECT ordinal, title, source, categories, score, fetched_at, haystack FROM x")
def search_index(spark, d):
    return _index(spark, d).select("ordinal", "title", "source", "categories", "score", "fetched_at", "haystack")


@query(INDEX + ", f AS (SELECT * FROM x WHERE contains(haystack, 'the') AND contains(haystack, 'src1') AND status = 'Starred') SELECT ordinal, score, (SELECT count(*) FROM f) AS total FROM f ORDER BY score DESC, ordinal LIMIT 200")
def search_terms(spark, d):
    return site.search(_index(spark, d), "The src1", starred=True).select("ordinal", "score", "total")


ACT = "CASE event_type WHEN 'purchase' THEN 'Starred' WHEN 'click' THEN 'Read' WHEN 'view' THEN 'Read' END"


def _reactions(spark, d):
    names = F.when(F.col("event_type") == "purchase", F.array(F.lit("eyes"), F.lit("star"))).when(F.col("event_type").isin("click", "view"), F.array(F.lit("+1"))).otherwise(F.array(F.lit("wave")))
    return table(spark, d, "events").select(F.col("user_id"), feedback.action(names).alias("action"))


@query(f"SELECT user_id, CASE WHEN bool_or({ACT} = 'Starred') THEN 'Starred' ELSE 'Read' END AS action FROM events WHERE {ACT} IS NOT NULL GROUP BY user_id")
def reaction_fold(spark, d):
    return feedback.fold(_reactions(spark, d), "user_id")


@query(f"""WITH a AS (SELECT user_id, max(CASE {ACT} WHEN 'Starred' THEN 3 WHEN 'Read' THEN 2 END) AS r FROM events GROUP BY 1)
SELECT doc_id AS user_id, CASE WHEN coalesce(r, -1) > o THEN CASE r WHEN 3 THEN 'Starred' WHEN 2 THEN 'Read' END WHEN o = 3 THEN 'Starred' WHEN o = 2 THEN 'Read' ELSE 'Unread' END AS status
FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 3 WHEN toxic = 1 THEN 2 ELSE 0 END AS o FROM labels) LEFT JOIN a ON user_id = doc_id""")
def status_raise(spark, d):
    pages = table(spark, d, "labels").select(F.col("doc_id").alias("user_id"), F.when(F.col("quality") == 1, "Starred").when(F.col("toxic") == 1, "Read").otherwise("Unread").alias("status"))
    return feedback.raise_status(pages, _reactions(spark, d), "user_id").select("user_id", "status")


@query("SELECT page_id, url AS link FROM pages WHERE url NOT LIKE '%|%' AND url NOT LIKE '%>%'")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", X.first_link(F.concat(F.lit("see *<"), "url", F.lit("|a title>*"))).alias("link"))


@query("SELECT conv_id, turn, CAST(i AS INTEGER) AS i, substring(text, i * 200 + 1, 200) AS chunk FROM (SELECT *, unnest(range((length(text) + 199) // 200)) AS i FROM conversations)")
def chunk_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.chunks(F.col("text"), 200)).alias("i", "chunk"))


@query(f"SELECT page_id, sha256({key_sql('url')}) AS id FROM pages")
def sha_ids(spark, d):
    return table(spark, d, "pages").select("page_id", U.article_id(F.col("url")).alias("id"))


@query("SELECT event_id, 'k=' || (props->>'$.k') AS props FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("p")).select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("p"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("props"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stream_day_counts(spark, d):
    rows = stream.run_now(stream.day_counts(stream.source(spark, d, "events.parquet")), "day_counts", "complete")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, d):
    rows = stream.source(spark, d, "events.parquet").select("user_id", "ts")
    return stream.run_now(stream.dedup(rows, "user_id"), "deduped", "append").select("user_id")


@query("SELECT l_suppkey, rn, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5")
def supplier_top_lines(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rank.per_group_top(rows, "l_suppkey", 5, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")).select("l_suppkey", "rn", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, CASE WHEN length(text) > 180 THEN regexp_replace(substr(text, 1, 180), '\\s+$', '') || '…' ELSE text END AS excerpt, greatest(3, least(100, CAST(floor(100 * (n_chars % 150 - 30) / 80.0 + 0.5) AS INTEGER))) AS width FROM documents")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"), X.rail_width(F.col("n_chars") % 150).alias("width"))


@query("SELECT sum(l_quantity) AS quantity, count(*) AS n FROM (SELECT l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS t FROM lineitem) WHERE t <= 100")
def total_before_overflow(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    kept = queue.before_overflow(rows, "l_quantity", 100, ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    return kept.agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


def queries() -> dict:
    from newsloom.plans import more, stored  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from newsloom.plans import more, stored  # noqa: F401

    return dict(SQL)
