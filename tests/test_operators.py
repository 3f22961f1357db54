import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import html as H
from newsloom.operators import brief, enrich, feedback, integrity, queue, rank, site
from newsloom.operators.keyed import Keyed
from newsloom.sources import dims, readers

NOW = dt.datetime(2026, 10, 15, 12)
ARTICLES = "ordinal long, url string, source string, score int, crowd_score double, published_at timestamp, fetched_at timestamp"
few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def now():
    return F.lit(NOW)


def rows(spark, data):
    return spark.createDataFrame([(i, *r, NOW) for i, r in enumerate(data)], ARTICLES)


@few
@given(st.lists(st.tuples(st.sampled_from(["https://a.com/x", "http://www.a.com/x/", "https://b.com", "junk"]), st.integers(0, 3), st.sampled_from([None, 0.0, 5.0])), max_size=12))
def test_dedup_like_a_model(spark, data):
    got = {(r.ordinal, r.score, r.crowd_score) for r in rank.dedup_by_url(rows(spark, [(u, "s", s, c, None) for u, s, c in data])).collect()}
    keep: dict = {}
    for i, (u, s, c) in enumerate(data):
        k = {"https://a.com/x": "a.com/x", "http://www.a.com/x/": "a.com/x", "https://b.com": "b.com"}.get(u, u)
        value = s if s > 0 else (c or 0)
        if k not in keep or value > keep[k][0]:
            keep[k] = (value, keep.get(k, (0, i))[1], s, c)
    assert got == {(i, s, c) for _, i, s, c in keep.values()}


@few
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5)), max_size=15), st.integers(1, 8), st.integers(1, 3))
def test_diverse_top_like_a_model(spark, data, limit, cap):
    got = [r.ordinal for r in rank.diverse_top(rows(spark, [("u", s, n, None, None) for s, n in data]), limit, cap).collect()]
    order = sorted(range(len(data)), key=lambda i: (-data[i][1], i))
    n, picked, rest = {}, [], []
    for i in order:
        s = data[i][0]
        (picked if n.get(s, 0) < cap else rest).append(i)
        n[s] = n.get(s, 0) + 1
    picked = (picked + rest)[:limit] if len(picked) < limit else picked[:limit]
    assert got == sorted(picked, key=lambda i: -data[i][1])


def test_fresh_lane_comes_before_thousands_of_old_rows(spark):
    old = [(f"https://e.com/{i}", "s", 90, None, NOW - dt.timedelta(days=30)) for i in range(3502)]
    both = rows(spark, [*old, ("https://e.com/new", "s", 1, None, NOW - dt.timedelta(days=1)), ("https://e.com/week", "s", 1, None, NOW - dt.timedelta(days=7)), ("https://e.com/future", "s", 1, None, NOW + dt.timedelta(days=1)), ("https://e.com/none", "s", 1, None, None)])
    got = queue.two_lanes(both, now()).select("url", "recent").limit(3).collect()
    assert [(r.url, r.recent) for r in got] == [("https://e.com/new", True), ("https://e.com/0", False), ("https://e.com/1", False)]


def test_merge_keeps_backlog_times_and_drops_confirmed(spark):
    backlog = rows(spark, [("https://e.com/a", "s", 10, None, None), ("https://e.com/c", "s", 10, None, None)]).withColumn("fetched_at", F.lit(NOW - dt.timedelta(days=2)))
    new = rows(spark, [("https://www.e.com/a/", "s", 50, None, NOW), ("https://e.com/b", "s", 5, None, NOW)])
    got = {r.url_key: r for r in queue.merge_pending(backlog, new, spark.createDataFrame([("e.com/c",)], "url_key string"), now()).collect()}
    assert set(got) == {"e.com/a", "e.com/b"} and got["e.com/a"].score == 50 and got["e.com/a"].fetched_at == NOW - dt.timedelta(days=2) and got["e.com/a"].published_at == NOW


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([5, 9, 1])], "g string, i int, c int")
    assert [r.i for r in queue.within_budget(df, "c", 10, ["g"], F.col("i")).collect()] == [0]


def test_sink_is_safe_to_repeat(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "url_key string, n int")
    write = queue.sink(str(tmp_path))
    write(df, 0), write(df, 0), write(df, 1)
    assert sorted(r.url_key for r in Keyed(spark, str(tmp_path), "url_key").read().collect()) == ["a", "b"]


def test_grounding(spark):
    body = "OpenAI released GPT-5 with 1.5 million tokens of context today, and the agent works."
    good = '```json\n{"relevant": true, "summary": "GPT-5 released with 1.5 million tokens of context.", "evidence": ["GPT-5 with 1.5 million tokens"]}\n```'
    bad = [good.replace("1.5 million tokens of", "2.5 million tokens of"), good.replace("true", "false"), good.replace("GPT-5 with 1.5 million tokens", "not in the body at all, no"), "garbage", good.replace('["GPT-5 with 1.5 million tokens"]', "[]")]
    df = spark.createDataFrame([(r, body) for r in [good, *bad]], "raw string, body string").select(enrich.grounded(F.col("raw"), F.col("body")).alias("g"))
    got = [r.g for r in df.collect()]
    assert got[0].summary.startswith("GPT-5") and got[1:] == [None] * len(bad)


def test_transitions(spark):
    long = "ai " * 60
    cases = [(None, None, False, "body_unavailable", 2), ("ai", None, False, "insufficient_evidence", 2), ("x " * 80, None, False, "non_ai", 2), (long, 429, False, "rate_limited", 1), (long, None, True, "model_failed", 2), (long, None, False, "invalid_response", 2)]
    df = spark.createDataFrame([(b, h, f) for b, h, f, *_ in cases], "body string, http int, failed boolean")
    got = df.select(enrich.transition(F.lit(1), F.col("body"), F.lit("?"), F.col("http"), F.lit(90000), now(), F.col("failed")).alias("s")).select("s.*").collect()
    assert [(r.status, r.attempts) for r in got] == [(s, a) for *_, s, a in cases]
    assert got[3].next_at - NOW == dt.timedelta(hours=25) and got[0].next_at - NOW == dt.timedelta(hours=6)


def test_eligible_and_finished(spark):
    df = spark.createDataFrame([("pending", 0), ("pending", 3), ("rate_limited", 9), ("ready", 1)], "status string, attempts int").withColumn("n", F.lit(None).cast("timestamp"))
    got = df.select(enrich.eligible(F.col("status"), F.col("attempts"), F.col("n"), now()), enrich.finished(F.col("status"), F.col("attempts"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (True, False), (False, True)]


def test_freshness_bounds(spark):
    h, s = dt.timedelta(hours=1), dt.timedelta(seconds=1)
    cases = [(NOW - 24 * h, NOW, False), (NOW - 24 * h + s, NOW, True), (NOW, NOW - 168 * h, False), (NOW, NOW - 168 * h + s, True), (NOW + 60 * s, NOW, True), (NOW + 61 * s, NOW, False), (NOW, None, False)]
    df = spark.createDataFrame([(c, p) for c, p, _ in cases], "c timestamp, p timestamp")
    assert [r[0] for r in df.select(brief.fresh(F.col("c"), F.col("p"), now())).collect()] == [w for *_, w in cases]


def test_reactions(spark):
    df = spark.createDataFrame([(["eyes", "star"],), (["+1"],), (["wave"],), ([],)], "n array<string>")
    assert [r[0] for r in df.select(feedback.action(F.col("n"))).collect()] == ["Starred", "Read", None, None]
    pages = spark.createDataFrame([("a", "Starred"), ("b", "Unread")], "url string, status string")
    seen = spark.createDataFrame([("a", "Read"), ("b", "Read")], "url string, action string")
    assert {r.url: r.status for r in feedback.raise_status(pages, seen).collect()} == {"a": "Starred", "b": "Read"}


def test_html():
    page = '<body><nav><p>navigation text here</p></nav><article><p>First paragraph, open<p>Second <b>paragraph</b> text<script>var t="</p>";</script><div class="ad"><p>an advertisement</p></div><ul><li><p>In an item, twice</p></li></ul><p>short</p></article></body>'
    assert H.article_paragraphs(page) == ["First paragraph, open", "Second paragraph text", "In an item, twice", "In an item, twice"]
    assert H.article_paragraphs("<p>no container at all</p>") is None and H.article_paragraphs("<article></article>") == []
    assert H.article_paragraphs("<article><p>" + "a" * 30 + "</p><p>" + "b" * 30 + "</p><p>" + "c" * 12 + "</p></article>", budget=50) == ["a" * 30]
    repo = '<article class="Box-row"><h2><a href="/o/r">o / r</a></h2><p>An LLM tool</p><span itemprop="programmingLanguage">Rust</span><span>1,371 stars today</span></article>'
    assert H.trending(repo) == [{"full_name": "o/r", "url": "https://github.com/o/r", "description": "An LLM tool", "language": "Rust", "period_stars": 1371}]
    assert [x["title"] for x in H.listing_links('<div><a href="/news/x"><h3>A long enough title</h3></a><p>About</p></div><a href="/jobs/y">Another long title</a>')] == ["A long enough title"]


def test_trending_skips_what_earlier_languages_kept(spark):
    box = lambda n: f'<article class="Box-row"><h2><a href="/o/{n}">x</a></h2><p>An LLM agent</p></article>'
    pages = [spark.createDataFrame([(box("a") + box("b"),)], "html string"), spark.createDataFrame([(box("a") + box("c"),)], "html string")]
    assert sorted(r.full_name for r in readers.trending(pages).collect()) == ["o/a", "o/b", "o/c"]


def test_pages_and_score(spark):
    df = rows(spark, [(f"https://e.com/{i}", "s", i, None, None) for i in range(7)])
    got = site.paginate(df, "source", 3).orderBy("rn").collect()
    assert [(r.page_no, r.prev_page, r.next_page) for r in got][::3] == [(1, None, 2), (2, 1, 3), (3, 2, None)]
    a = spark.createDataFrame([(0, "GPT agent", "", "Hacker News", 250.0), (1, "none", "", "Unknown", None)], "ordinal long, title string, abstract string, source string, crowd_score double")
    x, y = rank.score(a, dims.source_dim(spark)).orderBy("ordinal").collect()
    assert (x.score, x.category, x.lang) == (20 + 15 + 43, ["LLM", "Agent"], "en") and (y.score, y.category, y.lang) == (30, ["Other"], None)


def test_checkpoints(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}"), (tmp_path / "b.json").write_text("[]")
    manifest = integrity.seal(spark, str(tmp_path))
    assert integrity.mismatches(spark, str(tmp_path), manifest).count() == 0
    (tmp_path / "a.json").write_text("{ }"), (tmp_path / "c.json").write_text("1")
    (tmp_path / "b.json").unlink()
    assert {(r.name, r.problem) for r in integrity.mismatches(spark, str(tmp_path), manifest).collect()} == {("a.json", "changed"), ("b.json", "missing"), ("c.json", "extra")}
    assert readers.checkpoint(spark, str(tmp_path / "none"), "a int").count() == 0
    path = str(tmp_path / "v")
    integrity.write_version(spark.range(3), path), integrity.write_version(spark.range(5), path)
    assert integrity.read_version(spark, path).count() == 5


RUN = {"repository": "a/b", "ref": "main"}
ENDED = dt.datetime(2026, 10, 18, 10, 57, 1, 167000)


def report(spark, **over):
    row = {"schema_version": 1, "stage": "enrich", "status": "failed", "repository": "a/b", "ref": "main", "run_id": "7", "started_at": dt.datetime(2026, 10, 18, 10, 50), "finished_at": ENDED, "operation": "model", "http_status": 429, "hint": None, "explicit_at": None, "dated": False} | over
    return spark.createDataFrame([tuple(row.values())], enrich.REPORT)


@pytest.mark.parametrize(
    ("over", "held", "now", "status", "until", "changed"),
    [
        ({}, None, dt.datetime(2026, 10, 18, 13), "active", ENDED + dt.timedelta(hours=6), True),
        ({"hint": 86400}, None, dt.datetime(2026, 10, 18, 13), "active", ENDED + dt.timedelta(hours=24), True),
        ({"hint": 8 * 86400}, None, dt.datetime(2026, 10, 18, 13), "active", ENDED + dt.timedelta(hours=6), True),
        ({}, None, ENDED - dt.timedelta(seconds=61), "refused", None, False),
        ({}, None, ENDED + dt.timedelta(hours=7), "expired", ENDED + dt.timedelta(hours=6), True),
        ({"dated": True, "explicit_at": dt.datetime(2026, 10, 18, 16, 57)}, None, dt.datetime(2026, 10, 18, 13), "active", dt.datetime(2026, 10, 18, 16, 57), True),
        ({"dated": True, "explicit_at": dt.datetime(2026, 10, 18, 12)}, None, dt.datetime(2026, 10, 18, 13), "refused", None, False),
        ({"dated": True}, None, dt.datetime(2026, 10, 18, 13), "refused", None, False),
        ({}, dt.datetime(2026, 10, 18, 20), dt.datetime(2026, 10, 18, 13), "active", dt.datetime(2026, 10, 18, 20), False),
        ({"operation": "wait"}, dt.datetime(2026, 10, 18, 12), dt.datetime(2026, 10, 18, 13), "expired", dt.datetime(2026, 10, 18, 12), False),
        ({"operation": "wait"}, None, dt.datetime(2026, 10, 18, 13), "missing_evidence", None, False),
        ({"ref": "other"}, dt.datetime(2026, 10, 18, 12), dt.datetime(2026, 10, 18, 11), "refused", dt.datetime(2026, 10, 18, 12), False),
        ({"started_at": ENDED + dt.timedelta(seconds=1)}, None, dt.datetime(2026, 10, 18, 13), "refused", None, False),
        ({"http_status": 500, "schema_version": 2}, None, dt.datetime(2026, 10, 18, 13), "missing_evidence", None, False),
    ],
)
def test_migrated_cooldowns(spark, over, held, now, status, until, changed):
    current = spark.createDataFrame([(held, "held")] if held else [], "until timestamp, cause string")
    got = enrich.migrate_cooldown(report(spark, **over), current, RUN, F.lit(now)).first()
    assert (got.status, got.until, got.changed) == (status, until, changed) and got.cause == ("rate_limited" if changed else "held" if held else None)


def test_migration_is_idempotent(spark):
    reports, now = report(spark).unionByName(report(spark, http_status=500)), F.lit(dt.datetime(2026, 10, 18, 13))
    none = spark.createDataFrame([], "until timestamp, cause string")
    once = enrich.migrate_cooldown(reports, none, RUN, now)
    again = enrich.migrate_cooldown(reports, once.select("until", "cause"), RUN, now)
    assert once.first().changed and not again.first().changed and again.first().until == once.first().until == ENDED + dt.timedelta(hours=6)
    assert enrich.migrate_cooldown(reports.limit(0), none, RUN, now).first().status == "missing_evidence"


def test_waits_from_headers(spark):
    now = dt.datetime(2026, 10, 15)
    cases = {"Thu, 15 Oct 2026 00:02:00 GMT": 120, "0": 0, " 60 ": 60, "\tThu, 15 Oct 2026 00:02:00 GMT ": 120, "Wed, 14 Oct 2026 00:00:00 GMT": 0, None: None, "": None, "-1": None, "1.5": None, "9999999999999": None, "99999999999999999999": None, "private header": None, "Thu, 99 Oct 2026 00:02:00 GMT": None, "604800": 604800, "604801": None, " " * 130 + "1": None}
    rows = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.s for r in rows.select("h", X.retry_after(F.col("h"), F.lit(now)).alias("s")).collect()} == cases
    late = rows.filter("h LIKE 'Thu, 15%'").select(X.retry_after(F.col("h"), F.lit(now + dt.timedelta(milliseconds=500))).alias("s"))
    assert late.first().s == 120  # parts of a second count whole


def test_usable_runs(spark):
    rows = [("completed", c, r) for c in ("success", "failure", "timed_out", "cancelled", "skipped", None) for r in (("5", 1, "c0"),)]
    rows += [("queued", "success", ("5", 1, "c0")), ("completed", "success", ("", 1, "c0")), ("completed", "success", ("5", 0, "c0")), ("completed", "success", ("5", 1, "")), ("completed", "success", ("5", 1, None)), ("completed", "success", (None, 1, "c0"))]
    df = spark.createDataFrame(rows, "status string, conclusion string, run struct<id:string,attempt:int,sha:string>")
    assert sorted(r.conclusion for r in brief.usable_run(df).collect()) == ["failure", "success", "timed_out"]


def test_first_states(spark):
    df = spark.createDataFrame([("ja", "本文"), ("ja", " \t\u3000"), ("ja", ""), ("ja", None), ("en", ""), (None, "x")], "l string, a string")
    assert [r[0] for r in df.select(enrich.initial_status(F.col("l"), F.col("a"))).collect()] == ["excerpt"] + ["insufficient_evidence"] * 3 + ["pending"] * 2


def test_rules_read_a_text_once(spark):
    rules, cats = [(["ab", "c"], 5), (["zz"], 7), (["ab"], 1)], [("A", ["ab", "x"]), ("B", ["zz"]), ("A", ["c"])]
    texts = ["", None, "AB", "c", "xab ZZ", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.b, list(r.c)) for r in df.select(X.keyword_bonus(F.col("t"), rules).alias("b"), X.categorise(F.col("t"), cats).alias("c")).collect()]

    def plain(t):
        low = (t or "").lower()
        met = [n for n, ks in cats if any(k in low for k in ks)]
        return sum(p for ks, p in rules if any(k in low for k in ks)), list(dict.fromkeys(met)) or ["Other"]

    assert got == [plain(t) for t in texts]
    plan = df.select(X.rule_hits(F.col("t"), rules, cats).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_search_by_postings(spark, tmp_path):
    titles = ["GPT-5 released", "ＧＰＴ－５ モデル", "an agent for code", "agents", "ai", "", "the gp of t-5", "日本語のモデル"]
    df = spark.createDataFrame([(i, t, "src", i) for i, t in enumerate(titles * 5)], "ordinal long, title string, source string, score int")
    df = df.withColumns({"url": F.lit("u"), "category": F.array(F.lit("LLM")), "lang": F.lit("en"), "kind": F.lit("primary"), "status": F.lit("Unread"), "fetched_at": F.lit(NOW), "published_at": F.lit(NOW)})
    index = site.search_index(df, F.lit(NOW))
    site.write_postings(index, f"{tmp_path}/p", 3)
    for query, most in (("gpt-5", 10), ("agent", 10), ("ai", 40), ("モデル", 10), ("ＡＧＥＮＴ llm", 10), ("nowhere", 0), ("code agent src", 5), ("a", 40), ("", 40)):
        got = site.search_postings(spark, f"{tmp_path}/p", query, k=7).collect()
        assert [(r.ordinal, r.total) for r in got] == [(r.ordinal, r.total) for r in site.search(index, query, k=7).collect()], query
        assert all(r.candidates == most for r in got), query


def test_grams_of_any_text(spark):
    texts = ["", "ab", "abc", "aaaa", "日本語のモデル", "a😀b😀c", "x" * 5 + "yz" * 3, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.g for r in df.select(site.grams(F.col("t")).alias("g")).collect()]
    assert got == [list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) if t else [] for t in texts]


def test_postings_make_the_index_once(spark, tmp_path, monkeypatch):
    """And places stay in parts by ordinal, of more files where there's more text."""
    monkeypatch.setattr(site, "PART_CHARS", 400)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(i):
        made.add(1)
        return f"title {i} of an agent"

    df = spark.range(200).select(F.col("id").alias("ordinal"), title("id").alias("haystack"), F.lit(1).alias("score"), F.lit("x").alias("status"))
    site.write_postings(df, f"{tmp_path}/p", 2)
    assert made.value <= 400  # once for the rows, once for the bounds of their ranges
    files = spark.read.parquet(f"{tmp_path}/p/places").select("ordinal", "gram", F.input_file_name().alias("f"))
    spans = sorted((r.low, r.high) for r in files.groupBy("f").agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).collect())
    assert len(spans) >= 8 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    got = site.search_postings(spark, f"{tmp_path}/p", "title 17", k=500).collect()
    assert {r.ordinal for r in got} == {i for i in range(200) if "17" in str(i)}
