"""Readers of feed files, streams, pacing and the entry functions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import brief, pacing, queue, site
from newsloom.operators.keyed import Keyed
from newsloom.plans import flows
from newsloom.sources import dims, readers
from newsloom.streaming import stream

NOW = dt.datetime(2026, 10, 15, 12)
RSS = """<rss xmlns:hatena="http://h"><channel><title>feed</title>
<item><title>AI &amp; more</title><link>https://a.com/1?utm_source=x</link><description>text</description><pubDate>Wed, 14 Oct 2026 10:00:00 EST</pubDate><hatena:bookmarkcount>12</hatena:bookmarkcount></item>
<item><title>AI again</title><link>https://a.com/2</link><description>{long}</description><hatena:bookmarkcount>3</hatena:bookmarkcount></item>
<item><title>AI undated</title><link>https://a.com/3</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>One</title><link rel="edit" href="https://b.com/edit"/><link href="https://b.com/1"/><summary>s</summary><updated>2026-10-14T10:00:00Z</updated></entry>
<entry><title>Two</title><link rel="self" href="https://b.com/2"/><content>c</content><published>2026-10-13T10:00:00+09:00</published></entry></feed>"""


def config(spark, *rows):
    return spark.createDataFrame(list(rows), readers.FEED_CONFIG)


def test_feed_files(spark, tmp_path):
    (tmp_path / "r.xml").write_text(RSS.replace("{long}", "x" * 1500))
    (tmp_path / "a.xml").write_text(ATOM)
    items = readers.rss(spark, f"{tmp_path}/r.xml", "r", "hatena:bookmarkcount").unionByName(readers.atom(spark, f"{tmp_path}/a.xml", "a"))
    at = F.lit(NOW).cast("timestamp")
    got = {r.url: r for r in readers.feed_articles(items, config(spark, ("r", "", ["ai"], None, "hatena:bookmarkcount", 5.0), ("a", "", [], 30, None, None)), at).collect()}
    assert got.keys() == {"https://a.com/1", "https://b.com/1", "https://b.com/2"}  # a vote floor drops few votes and none
    one = got["https://a.com/1"]
    assert (one.title, one.crowd_score, one.published_at) == ("AI & more", 12.0, dt.datetime(2026, 10, 14, 15)) and got["https://b.com/2"].published_at == dt.datetime(2026, 10, 13, 1)
    free = readers.feed_articles(items, config(spark, ("r", "", [], None, None, None)), at)
    assert sorted(len(r.abstract) for r in free.collect()) == [0, 4, 1000]


def test_failed_fetches_have_reasons(spark):
    page = "<article><p>A paragraph of the article.</p></article>"
    rows = [(1, "https://x.com", 200, "text/html", None, page), (2, "https://x.com", 500, "text/html", None, page), (3, "https://a.js.com", 200, "text/html", "TimeoutError", None), (4, "https://x.com", 200, "image/png", None, "x"), (5, "https://x.com", None, None, "TypeError", None), (6, "https://x.com", 200, "text/plain", None, "no article")]
    payloads = spark.createDataFrame(rows, "page_id long, url string, status int, content_type string, error string, html string")
    got = {r.page_id: (r.method, list(r.paragraphs), r.reason) for r in readers.fetched_bodies(payloads, ["js.com"]).collect()}
    assert got == {1: ("http", ["A paragraph of the article."], None), 2: ("http", [], "http_error"), 3: ("headless", [], "timeout"), 4: ("http", [], "unsupported_content_type"), 5: ("http", [], "network_error"), 6: ("http", [], "missing_article")}


def test_numbers_that_are_none(spark):
    rows = spark.createDataFrame([(x,) for x in ("1d", " 2 ", "1e3", "", "NaN", "Infinity", ".5", None)], "s string")
    assert [r[0] for r in rows.select(X.crowd_number(F.col("s"))).collect()] == [None, 2.0, 1000.0, None, None, None, 0.5, None]
    rows = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), -1.0, None, 250.0)], "v double")
    assert [r[0] for r in rows.select(X.crowd_bonus(F.col("v"), F.lit(1.0))).collect()] == [0, 60, 0, 0, 43]


def test_search_folds_widths(spark):
    rows = spark.createDataFrame([(1, "ＧＰＴ－５ モデル", "s", ["LLM"], 5)], "ordinal long, title string, source string, category array<string>, score int")
    rows = rows.withColumns({"url": F.lit("u"), "lang": F.lit("ja"), "kind": F.lit("primary"), "status": F.lit("Unread"), "fetched_at": F.lit(NOW), "published_at": F.lit(NOW)})
    index = site.search_index(rows, F.lit(NOW))
    assert site.search(index, "gpt ｌｌｍ").count() == 1 and site.search(index, "gpt claude").count() == 0


def test_retry_states_over_batches(spark, tmp_path):
    hour = 3600
    batches = [
        [("a", 0, False, False), ("b", 0, False, True), ("c", 0, True, False), ("d", 20 * 3600, False, False), ("d", 0, False, False), ("d", 10 * 3600, False, False)],
        [("a", hour, True, False), ("a", 7 * hour, True, False), ("b", 5 * hour, True, False), ("c", 9 * hour, False, False), ("d", 40 * hour, True, False)],
        [("a", 99 * hour, False, False), ("b", 7 * hour, False, False), ("c", 99 * hour, False, False)],
    ]
    schema = "key string, s long, ok boolean, throttled boolean"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("ts", F.timestamp_seconds("s"))
    out = []
    q = stream.retry_states(events).writeStream.outputMode("update").foreachBatch(lambda b, _: out.append({r.key: (r.attempts, r.next_at, r.done) for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for rows in out:
        last |= rows
    assert last == {"a": (2, 0, True), "b": (1, 13 * hour, False), "c": (1, 0, True), "d": (3, 0, True)}


def test_sink_writes_the_same_again(spark, tmp_path):
    write = queue.sink(str(tmp_path))
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 5, "c")], "url_key string, ordinal long, title string")
    for _ in range(2):
        write(rows.repartition(3), 0)
        write(rows.filter("url_key = 'k'").withColumn("title", F.lit("later")), 1)
    assert sorted(tuple(r) for r in Keyed(spark, str(tmp_path), "url_key").read().select("url_key", "ordinal", "title").collect()) == [("j", 5, "c"), ("k", 1, "a")]


def test_pacing():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pacer, plan = pacing.Pacer(lambda: now[0], sleep), []

    def action():
        e = plan.pop(0)
        if isinstance(e, Exception):
            raise e
        return e

    plan[:] = ["a", "b"]
    assert [pacer(action), pacer(action)] == ["a", "b"] and slept == [pacing.SPACING]
    plan[:] = [pacing.Throttled(5), pacing.Throttled(), "c"]
    assert pacer(action) == "c" and [round(s, 3) for s in slept[1:]] == [0.4, 5, 2]
    for errors, reason, tries in (([ValueError()], "request_failed", 1), ([pacing.Throttled(0.1)] * 3, "rate_limited", 3), ([pacing.Throttled(100)], "budget_exhausted", 1)):
        now[0] += 1000
        plan[:] = list(errors)
        with pytest.raises(pacing.Refused) as e:
            pacer(action)
        assert (e.value.reason, e.value.attempts) == (reason, tries)


ITEM = "ordinal long, title string, url string, source string, abstract string, crowd_score double, published_at timestamp"


def articles(spark, rows):
    return spark.createDataFrame([(i, t, u, s, "", None, NOW - dt.timedelta(hours=i)) for i, t, u, s in rows], ITEM)


def test_collect(spark):
    def broken():
        raise OSError

    first = lambda: articles(spark, [(0, "An LLM agent", "https://a.com/1", "OpenAI"), (1, "old", "https://a.com/2?utm_x=1", "Zenn")])
    second = lambda: articles(spark, [(0, "same", "http://www.a.com/1/", "Hacker News"), (1, "new", "https://a.com/3", "arXiv"), (2, "done", "https://a.com/9", "OpenAI")])
    backlog = flows.collect(spark, [first], articles(spark, []).withColumns({"score": F.lit(0), "fetched_at": F.lit(NOW)}), spark.createDataFrame([], "url_key string"), spark.createDataFrame([], "url_key string"), F.lit(NOW))["scored"].filter("ordinal = 0")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "url_key string")
    got = flows.collect(spark, [first, broken, second], backlog, keys("a.com/9"), keys("a.com/2"), F.lit(NOW))
    assert got["failed"] == [(1, "OSError")]
    assert [r.url for r in got["new"].orderBy("ordinal").collect()] == ["https://a.com/1"] and [r.url_key for r in got["existing"].collect()] == ["a.com/2"]
    assert flows.outputs(0, 0)["ready"] and not flows.outputs(0, 3)["ready"] and flows.outputs(1, 3, "partial", 2)["deliverable"] and not flows.outputs(1, 0, "empty")["deliverable"]


def test_enrich_run(spark):
    body = "About ai: a page that is long enough to be used, with some words to quote from it and a number 42. " * 2
    good = json.dumps({"relevant": True, "summary": "a page with a number 42 and some words", "evidence": ["a page that is long enough to be used"]})
    backlog = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "ordinal long, page_id string")
    states = spark.createDataFrame([("p0", "pending", 0, None), ("p1", "pending", 2, None), ("p2", "ready", 1, None), ("p3", "pending", 0, NOW + dt.timedelta(hours=1)), ("p5", "pending", 0, None)], "page_id string, status string, attempts int, next_at timestamp")
    bodies = spark.createDataFrame([("p0", body), ("p5", body)], "page_id string, body string")
    answers = spark.createDataFrame([("p0", good, None, None, False), ("p5", None, 429, 30000, False)], "page_id string, raw string, http int, hint int, failed boolean")
    got = flows.enrich_run(backlog, states, bodies, answers, F.lit(NOW))
    assert {r.page_id: r.step for r in got["steps"].collect()} == {"p0": "work", "p1": "work", "p2": "drop", "p3": "wait", "p4": "drop", "p5": "work"}
    assert {r.page_id: (r.status, r.attempts, r.summary) for r in got["states"].collect()} == {"p0": ("ready", 1, "a page with a number 42 and some words"), "p1": ("body_unavailable", 3, None), "p5": ("rate_limited", 0, None)}
    assert sorted(r.page_id for r in got["backlog"].collect()) == ["p3", "p5"]
    assert {r.step for r in flows.enrich_run(backlog, states, bodies, answers, F.lit(NOW), F.lit(NOW + dt.timedelta(hours=2)))["steps"].collect()} == {"wait"}


def test_brief_and_site(spark):
    summary = "A summary that is long enough to be delivered to readers."
    rows = [(i, f"p{i}", f"title {i}", f"https://a.com/{i}", "OpenAI", summary, NOW - dt.timedelta(hours=i), NOW - dt.timedelta(hours=i), 50, "a", ["LLM"], "Unread", None, None) for i in range(6)]
    pages = spark.createDataFrame(rows, "ordinal long, page_id string, title string, url string, source string, summary string, fetched_at timestamp, published_at timestamp, score int, abstract string, category array<string>, status string, lang string, kind string")
    states = pages.select("page_id", F.lit("ready").alias("status"), F.lit("article_body").alias("input"), F.lit("source_quoted").alias("summary_kind"), F.sha2("summary", 256).alias("summary_hash"), F.lit(NOW).alias("summary_recorded_at"), F.array(F.lit("a quotation of the article")).alias("evidence")).filter("page_id <> 'p1'")
    flags = spark.createDataFrame([(True, True, True, True, False, 6)], "collection_valid boolean, ready boolean, source_read boolean, collected boolean, enriched boolean, fetched int")
    pages_ = pages.drop("status")
    got = flows.build_brief(pages_, states, flags, F.lit(NOW))
    assert [r.page_id for r in got["articles"].collect()] == ["p0", "p2", "p3"]
    status = got["status"].first()
    assert (status.status, list(status.reasons)) == ("partial", ["enrichment_incomplete"]) and got["expiry"].first().n == 3
    for bad, want in (({"fetched": 0}, "empty"), ({"ready": False}, "unavailable"), ({"collection_valid": False}, "unavailable")):
        none = flows.build_brief(pages_, states, flags.withColumns({k: F.lit(v) for k, v in bad.items()}), F.lit(NOW))
        assert none["articles"].count() == 0 and none["status"].first().status == want and none["expiry"].first().n == 0
    run = {"repository": "a/b", "ref": "main", "runId": 5, "attempt": 1, "sha": "c0", "url": "https://e.com/run"}
    made, text = brief.bundle(got["articles"], status.asDict(), run, NOW, got["expiry"].first().valid_until, 6, False)
    brief.assert_deliverable(spark, json.loads(json.dumps(made)), NOW, run)
    assert [a["title"] for a in made["articles"]] == ["title 0", "title 2", "title 3"] and made["deliveryAllowed"] and made["selection"]["scannedCandidates"] == 6
    assert text.startswith("# AI News Brief\n\n生成: 2026-10-15T12:00:00\n") and "\n実行: https://e.com/run (attempt 1)\n" in text
    assert f"\n1. title 0\n   出典: OpenAI · 公開 2026-10-15T12:00:00Z · 収集 2026-10-15T12:00:00Z\n   https://a.com/0\n   自動要約: {summary}\n\n2. title 2" in text
    made, text = brief.bundle(got["articles"].limit(0), {"status": "unavailable", "reasons": ["collection_not_ready"]}, run, NOW, NOW, 0, False)
    assert not made["deliveryAllowed"] and text.endswith("\n配信対象なし。過去の結果へフォールバックしません。\n理由: collection_not_ready\n")
    with pytest.raises(ValueError):
        brief.assert_deliverable(spark, made, NOW, run)
    out = flows.export_site(pages, F.lit(NOW), spark)
    assert out["stats"].first().total == 6 and {r.lang for r in out["rows"].collect()} == {"en"} and out["index"].count() == 6 and out["sources"].count() == 6


def test_feed_config_of_all_feeds(spark):
    rows = readers.feed_config(spark).collect()
    assert len(rows) == 32 and {r.feed for r in rows} < {s[0] for s in dims.SOURCES} and len({r.url for r in rows}) == 32
    urls = {r.url: r for r in rows}
    assert "https://zenn.dev/topics/%E7%94%9F%E6%88%90ai/feed" in urls
    hatena = urls["https://b.hatena.ne.jp/q/Claude%20Code?sort=recent&mode=rss"]
    assert (hatena.crowd_field, hatena.min_crowd, hatena.max_age_days) == ("hatena:bookmarkcount", 10.0, 7)


def test_feeds_of_one_name_give_an_item_once(spark):
    schema = "feed string, title string, link string, contentSnippet string, content string, isoDate string, pubDate string, extensions map<string,string>"
    items = [("arXiv", "A paper", "https://e.com/1", None, None, None, None, None), ("Hatena", "LLMと機械学習", "https://e.com/2", None, None, None, None, {"hatena:bookmarkcount": "10"})]
    items += [("Hatena", "LLMと機械学習", "https://e.com/3", None, None, None, None, {"hatena:bookmarkcount": "9"}), ("Changelog", "Bread", "https://e.com/4", None, None, None, None, None)]
    got = readers.feed_articles(spark.createDataFrame(items, schema), readers.feed_config(spark), F.lit("2026-01-08 00:00:00").cast("timestamp")).collect()
    assert sorted(r.url for r in got) == ["https://e.com/1", "https://e.com/2"]


def test_flags_of_reports(spark):
    run = ("a/b", "main", "5", 1, "c0")
    ok = dict(run=run, collection=(1, "collect", run, "success", NOW - dt.timedelta(minutes=5), NOW - dt.timedelta(seconds=1), (65, 0)), enrichment=(1, "enrich", run, "success", NOW, NOW, (65, 0)), collection_result="success", enrichment_result="success", ready=True, read_failed=False, source_read_at=NOW, limited=False)
    schema = f"run struct<{brief.RUN_IDENTITY}>, collection {brief.STAGE_REPORT}, enrichment {brief.STAGE_REPORT}, collection_result string, enrichment_result string, ready boolean, read_failed boolean, source_read_at timestamp, limited boolean"
    flags = ["collection_valid", "ready", "source_read", "collected", "enriched"]
    report = lambda k, i, v: {k: ok[k][:i] + (v,) + ok[k][i + 1 :]}
    cases = [
        ({}, ""), ({"collection": None}, "collection_valid collected"), (report("collection", 0, 2), "collection_valid"), (report("collection", 1, "enrich"), "collection_valid"), (report("collection", 2, ("a/b", "main", "5", 2, "c0")), "collection_valid"),
        (report("collection", 3, "running"), "collection_valid collected"), (report("collection", 3, "failed"), "collected"), (report("collection", 4, NOW + dt.timedelta(seconds=1)), "collection_valid"), (report("collection", 5, None), "collection_valid"),
        (report("collection", 5, NOW + dt.timedelta(seconds=61)), "collection_valid"), (report("collection", 5, NOW - dt.timedelta(hours=8)), "collection_valid"), (report("collection", 6, (65, 1)), "collected"), (report("collection", 6, None), ""),
        ({"collection_result": "failure"}, "collected"), ({"collection_result": "cancelled"}, "ready collected"), ({"ready": False}, "ready"), ({"ready": None}, "ready"), ({"read_failed": True}, "source_read"), ({"source_read_at": None}, "source_read"),
        ({"source_read_at": NOW - dt.timedelta(seconds=181)}, "source_read"), ({"source_read_at": NOW + dt.timedelta(seconds=180)}, ""), ({"enrichment": None}, "enriched"), ({"enrichment_result": "failure"}, "enriched"),
        (report("enrichment", 2, ("a/b", "x", "5", 1, "c0")), "enriched"), (report("enrichment", 6, (1, 1)), "enriched"), (report("enrichment", 3, "failed"), "enriched"),
    ]
    df = spark.createDataFrame([tuple((ok | over).values()) for over, _ in cases], schema)
    got = [" ".join(f for f in flags if not r[f]) for r in brief.report_flags(df, F.lit(NOW)).collect()]
    assert got == [want for _, want in cases]
    assert [r.fetched for r in brief.report_flags(df, F.lit(NOW)).limit(2).collect()] == [65, 0]


def test_fetched_pages_are_enriched(spark):
    text = "About ai: a page that is long enough to be used, with some words to quote from it and a number 42. " * 2
    pages = [("p0", "https://x.com", 200, "text/html", None, f"<article><p>{text}</p><p>{text}</p></article>"), ("p1", "https://x.com", 200, "text/html", None, "<article><p>short</p></article>"), ("p2", "https://x.com", 500, "text/html", None, text), ("p3", "https://x.com", 200, "text/html", None, "<article><p>about bread only, and nothing else</p></article>")]
    fetched = readers.fetched_bodies(spark.createDataFrame(pages, "page_id string, url string, status int, content_type string, error string, html string"), [])
    bodies = readers.page_bodies(fetched)
    assert {r.page_id: (r.body and r.body.count("\n\n"), r.reason) for r in bodies.collect()} == {"p0": (1, None), "p1": (None, "empty_article"), "p2": (None, "http_error"), "p3": (0, None)}
    assert max(len(r.body or "") for r in readers.page_bodies(fetched, 50).collect()) == 50
    backlog = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "ordinal long, page_id string")
    states = spark.createDataFrame([(f"p{i}", "pending", 0, None) for i in range(4)], "page_id string, status string, attempts int, next_at timestamp")
    answers = spark.createDataFrame([], "page_id string, raw string, http int, hint int, failed boolean")
    got = flows.enrich_run(backlog, states, bodies, answers, F.lit(NOW))
    assert {r.page_id: r.status for r in got["states"].collect()} == {"p0": "invalid_response", "p1": "body_unavailable", "p2": "body_unavailable", "p3": "insufficient_evidence"}


def test_lanes_keep_the_rate(spark):
    class Clock:
        def __init__(self):
            self.now, self.late = 0.0, 0.0

        def sleep(self, s):
            self.now += s + self.late

    clock = Clock()
    lanes = [pacing.Lane(k, 3, lambda: clock.now, clock.sleep) for k in range(3)]
    at = []
    for _ in range(4):
        for lane in lanes:
            assert lane.request(lambda: at.append(clock.now)).reason is None
    assert all(b - a >= pacing.SPACING - 1e-9 for a, b in zip(at, at[1:], strict=False))
    lane = pacing.Lane(0, 1, lambda: clock.now, clock.sleep)
    lane.request(lambda: None)
    clock.late = 25.0  # a sleep that takes longer leaves too little
    assert lane.request(lambda: None) == pacing.Outcome(None, "budget_exhausted", 0, None)

    def send(body):
        if body == "busy":
            raise pacing.Throttled(100)
        if body == "bad":
            raise ValueError
        return body.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "busy"), (3, "bad"), (4, "d")], "id long, body string")
    got = {r.id: (r.response, r.reason, r.attempts, r.waits_s) for r in pacing.paced(rows, send, "id", "body", 4).collect()}
    assert got[1] == ("A", None, 1, None) and got[3] == (None, "request_failed", 1, None) and got[2] == (None, "budget_exhausted", 1, 100.0)


def test_bounded_dedup_forgets(spark, tmp_path):
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    for n, rows in enumerate(([("a", day(0)), ("a", day(1))], [("a", day(2)), ("b", day(30))], [("a", day(31)), ("b", day(31))], [("a", day(32))])):
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
    source = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    got = stream.run_now(stream.dedup(source, "key", exact=False), "bounded", "append")
    assert sorted(r.key for r in got.collect()) == ["a", "a", "b"]  # once its time has passed, and a batch has seen that, a key is new


def test_site_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 2}", i, dt.datetime(2026, 1 + i % 3, 1)) for i in range(9)], "ordinal long, source string, score int, fetched_at timestamp")
    site.write_pages(site.paginate(rows, "source", size=2), f"{tmp_path}/pages", "source")
    back = spark.read.json(f"{tmp_path}/pages")
    assert back.count() == 9 and back.filter("source = 's0'").agg(F.max("page_no")).first()[0] == 3
    months = site.month_archive(rows)
    site.write_months(months, f"{tmp_path}/months")
    site.write_months(months.filter("month = '2026-02'").limit(1), f"{tmp_path}/months")  # the other months stay
    assert {r.month: r["count"] for r in spark.read.parquet(f"{tmp_path}/months").groupBy("month").count().collect()} == {"2026-01": 3, "2026-02": 1, "2026-03": 3}
