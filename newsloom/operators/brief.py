"""The bounded daily brief: provenance and freshness gates, three articles, status and expiry."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import json
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.urls import article_id, url_key
from newsloom.operators.integrity import get, put
from newsloom.operators.rank import first_per

# Articles, candidates read, and hours that a brief, an article and a publication date last.
TOP, SCAN, BRIEF_H, ARTICLE_H, PUBLISHED_H = 3, 48, 8, 24, 168


def _hours(n: int) -> Column:
    return F.expr(f"interval {n} hours")


def grounded_candidate(now: Column) -> Column:
    skew = F.expr("interval 60 seconds")
    return F.coalesce(
        (F.col("summary_kind") == "source_quoted") & (F.length(X.js_trim(F.col("summary"))) >= 30) & (F.length("summary") <= 500) & (F.sha2("summary", 256) == F.col("summary_hash"))
        & (F.col("summary_recorded_at") <= now + skew) & F.size("evidence").between(1, 5) & F.forall("evidence", lambda q: F.length(X.js_trim(q)) >= 20),
        F.lit(False),
    )


def fresh(collected: Column, published: Column, now: Column) -> Column:
    """Collected within a day, published within a week and known; a minute of clock skew is allowed."""
    skew = F.expr("interval 60 seconds")
    return F.coalesce((collected <= now + skew) & (collected > now - _hours(ARTICLE_H)) & (published <= now + skew) & (published > now - _hours(PUBLISHED_H)), F.lit(False))


def sane(url: Column, title: Column, source: Column) -> Column:
    return url.rlike("^https?://") & (X.js_trim(title) != "") & (X.js_trim(source) != "")


ORDER = ("published_at", "fetched_at", "score")


def by_freshness() -> list[Column]:
    return [F.col(c).desc() for c in ORDER] + [F.col("ordinal")]


def select(candidates: DataFrame, now: Column, top: int = TOP) -> DataFrame:
    """The freshest sane candidates, one for each URL key."""
    good = candidates.filter(fresh(F.col("fetched_at"), F.col("published_at"), now) & sane(F.col("url"), F.col("title"), F.col("source"))).withColumn("url_key", url_key(F.col("url")))
    newest = [F.struct(*(-F.col(c).cast("timestamp").cast("double") if c != "score" else -F.col(c) for c in ORDER), F.col("ordinal"))]
    return first_per(good, ["url_key"], *newest).withColumn("id", article_id(F.col("url"))).orderBy(*by_freshness()).limit(top)


def candidates(pages: DataFrame, states: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The bounded scan: recent pages with a summary, at most ``SCAN``, joined to ready states; and whether there were more."""
    rows = pages.filter((F.col("fetched_at") >= F.date_trunc("day", now - _hours(ARTICLE_H))) & (F.col("fetched_at") >= now - _hours(ARTICLE_H)) & F.col("published_at").between(now - _hours(PUBLISHED_H), now) & (F.col("summary") != ""))
    more = rows.limit(SCAN + 1).agg((F.count("*") > SCAN).alias("limited"))
    return rows.orderBy(*by_freshness()).limit(SCAN).join(states.filter("status = 'ready' AND input = 'article_body'"), "page_id"), more


def expiry(selected: DataFrame, now: Column) -> DataFrame:
    each = F.least(F.col("fetched_at") + _hours(ARTICLE_H), F.col("published_at") + _hours(PUBLISHED_H))
    return selected.agg(F.least(now + _hours(BRIEF_H), F.min(each)).alias("valid_until"), F.count("*").alias("n"))


def status(reports: DataFrame) -> DataFrame:
    """``status`` and ``reasons`` of a run from its flags: a failed gate blocks, an incomplete step makes it partial."""
    gates = F.array_compact(F.array(
        F.when(~F.col("collection_valid"), "collection_report_missing_or_wrong_run"), F.when(~F.col("ready"), "collection_not_ready"), F.when(~F.col("source_read"), "source_read_failed")))
    rest = F.array_compact(F.array(F.when(~F.col("collected"), "collection_incomplete"), F.when(~F.col("enriched"), "enrichment_incomplete"), F.when(F.col("limited"), "candidate_window_limited")))
    blocked = F.size(gates) > 0
    empty = F.when(~blocked & (F.col("fetched") > 0) & (F.col("n_articles") == 0), F.array(F.lit("no_grounded_recent_articles"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(gates, rest, empty)
    state = F.when(blocked, "unavailable").when(F.col("n_articles") == 0, "empty").when(F.size(reasons) > 0, "partial").otherwise("ok")
    return reports.select("*", state.alias("status"), reasons.alias("reasons"))


# The fields that identify a run, the selection's policy, and the note that goes with a brief.
RUN = ("repository", "ref", "runId", "attempt", "sha")
POLICY = "grounded_recent_v1"
NOTE = "本文引用・要約ハッシュを確認した自動要約のみ。意味の正確性は未検証です。生成のみで、配信履歴は照合していません。"


def usable_run(df: DataFrame) -> DataFrame:
    """Runs that ended by themselves or by time, and name their id, attempt and commit; a cancelled one isn't usable."""
    named = (F.coalesce(F.col("run.id").cast("string"), F.lit("")) != "") & (F.col("run.attempt") >= 1) & (F.coalesce("run.sha", F.lit("")) != "")
    return df.filter((F.col("status") == "completed") & F.col("conclusion").isin("success", "failure", "timed_out") & named)


RUN_IDENTITY = "repository string, ref string, runId string, attempt int, sha string"
STAGE_REPORT = f"struct<schemaVersion:int,stage:string,run:struct<{RUN_IDENTITY.replace(' string', ':string').replace(' int', ':int').replace(', ', ',')}>,status:string,startedAt:timestamp,finishedAt:timestamp,stats:struct<fetched:bigint,pending:bigint>>"


def report_flags(inputs: DataFrame, now: Column) -> DataFrame:
    """The flags that ``status`` reads, from a run's ``run``, its ``collection`` and ``enrichment`` reports (``STAGE_REPORT``, null if missing),
    ``collection_result``, ``enrichment_result``, ``ready``, ``read_failed``, ``source_read_at`` and ``limited``; other columns stay.

    A collection report counts if it's of this run (all five fields), began by now, ended, within eight hours and at most a minute ahead, and isn't
    running. The source must have been read within three minutes of now. A step is complete if it and its report succeeded and nothing is pending."""
    same = lambda report: functools.reduce(operator.and_, (F.col(f"{report}.run.{k}").eqNullSafe(F.col(f"run.{k}")) for k in RUN))
    done = lambda report: (F.col(f"{report}.status") == "success") & (F.coalesce(F.col(f"{report}.stats.pending"), F.lit(0)) <= 0)
    ended = F.col("collection.finishedAt")
    valid = (
        (F.col("collection.schemaVersion") == 1) & (F.col("collection.stage") == "collect") & same("collection") & (F.col("collection.startedAt") <= now)
        & (ended <= now + F.expr("interval 60 seconds")) & (ended > now - _hours(BRIEF_H)) & (F.col("collection.status") != "running")
    )
    away = F.abs(F.unix_micros(F.col("source_read_at").cast("timestamp")) - F.unix_micros(now.cast("timestamp")))
    flags = {
        "collection_valid": valid, "ready": F.col("ready") & F.col("collection_result").isin("success", "failure"), "source_read": ~F.coalesce("read_failed", F.lit(False)) & (away <= 180_000_000),
        "collected": (F.col("collection_result") == "success") & (F.col("collection.status") == "success") & (F.coalesce("collection.stats.pending", F.lit(0)) <= 0),
        "enriched": (F.col("enrichment_result") == "success") & same("enrichment") & done("enrichment"),
    }
    return inputs.withColumns({**{k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}, "limited": F.coalesce("limited", F.lit(False)), "fetched": F.coalesce("collection.stats.fetched", F.lit(0))})


def blocked() -> Column:
    """Whether the flags of a run bar all articles: a gate failed."""
    return ~(F.col("collection_valid") & F.col("ready") & F.col("source_read"))


ARTICLE = "id string, title string, url string, source string, score int, published_at timestamp, fetched_at timestamp, summary string, summary_kind string, summary_hash string, summary_recorded_at timestamp, evidence array<string>"


def same_run(a: dict, b: dict) -> bool:
    return all(a.get(k) == b.get(k) for k in RUN)


def assert_deliverable(spark: SparkSession, bundle: dict, now: dt.datetime, run: dict) -> None:
    """The consumer's checks of a bundle that was read back; raises ValueError with the first that fails. Its articles, at most ``TOP``, pass the gates of the selection again."""
    made, until = (dt.datetime.fromisoformat(bundle[k]) if bundle.get(k) else dt.datetime.max for k in ("generatedAt", "validUntil"))
    articles = bundle.get("articles", [])
    checks = {
        "schema": bundle.get("schemaVersion") == 1, "policy": (bundle.get("selection") or {}).get("policy") == POLICY, "allowed": bundle.get("deliveryAllowed") is True, "run": same_run(bundle.get("run", {}), run), "status": bundle.get("status") in ("ok", "partial"), "articles": 1 <= len(articles) <= TOP,
        "clock": made <= now + dt.timedelta(seconds=60), "expiry": max(now, made) < until <= made + dt.timedelta(hours=BRIEF_H) if made < dt.datetime.max else False,
    }
    for what, ok in checks.items():
        if not ok:
            raise ValueError(f"bundle can't be delivered: {what}")
    at = F.lit(now)
    ok = grounded_candidate(at) & fresh(F.col("fetched_at"), F.col("published_at"), at) & sane(F.col("url"), F.col("title"), F.col("source")) & (F.col("id") == article_id(F.col("url")))
    rows = spark.createDataFrame([(json.dumps(a),) for a in articles], "a string").select(F.from_json("a", ARTICLE).alias("a")).select("a.*")
    if rows.filter(~F.coalesce(ok, F.lit(False))).count():
        raise ValueError("bundle can't be delivered: an article is stale, ungrounded or invalid")


FILES = ("brief.json", "brief.md")


def write_files(spark: SparkSession, directory: str, bundle: dict, text: str) -> None:
    """The brief as JSON and Markdown; last the manifest with their hashes, without which they don't count."""
    files = dict(zip(FILES, (json.dumps(bundle, ensure_ascii=False, indent=2) + "\n", text), strict=True))
    for name, body in files.items():
        put(spark, f"{directory}/{name}", body)
    put(spark, f"{directory}/manifest.json", json.dumps({"schemaVersion": 1, "run": bundle["run"], "files": {n: hashlib.sha256(t.encode()).hexdigest() for n, t in files.items()}}, indent=2))


def verify_files(spark: SparkSession, directory: str, now: dt.datetime, run: dict) -> dict:
    """The bundle, if its files have the manifest's hashes and it may be delivered."""
    manifest = json.loads(get(spark, f"{directory}/manifest.json"))
    bodies = {n: get(spark, f"{directory}/{n}") for n in FILES}
    if manifest.get("schemaVersion") != 1 or {n: hashlib.sha256(t.encode()).hexdigest() for n, t in bodies.items()} != manifest.get("files"):
        raise ValueError("bundle can't be delivered: its files differ from the manifest")
    bundle = json.loads(bodies["brief.json"])
    assert_deliverable(spark, bundle, now, run)
    return bundle


def preview(snapshot: DataFrame, top: int = TOP) -> DataFrame:
    """The last collected articles of a snapshot, one for each URL key, for reading only: their summaries were not checked."""
    rows = snapshot.filter(F.col("url").rlike("^https?://") & (X.js_trim(F.col("title")) != "")).withColumn("url_key", url_key(F.col("url")))
    newest = [-F.coalesce(F.col("fetched_at").cast("timestamp").cast("double"), F.lit(float("-inf"))), -F.col("score"), F.col("ordinal")]
    return first_per(rows, ["url_key"], *newest).orderBy(F.desc_nulls_last("fetched_at"), F.desc("score"), "ordinal").limit(top)


# The brief's text.
HEADING = "# AI News Brief\n\n生成: {generatedAt}\n有効期限: {validUntil}\n状態: {status}\n生成元: {repository} · {sha}\n実行: {url} (attempt {attempt})\n\n{note}\n"
NOTHING = "\n配信対象なし。過去の結果へフォールバックしません。\n理由: {reasons}\n"
NO_NEW, UNKNOWN, NO_SUMMARY = "新しい対象記事なし", "不明", "本文根拠のある要約は未生成です。"
LABELS = {"source_quoted": "自動要約", "feed_excerpt": "未検証のフィード抜粋"}
NO_LABEL = "要約なし"


def item_text(n: Column) -> Column:
    """An article's lines in a brief: title, source with its dates, URL, and the summary under its kind's name."""
    date = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(UNKNOWN))
    label = F.lit(NO_LABEL)
    for kind, name in LABELS.items():
        label = F.when(F.col("summary_kind") == kind, name).otherwise(label)
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.lit(NO_SUMMARY))
    parts = [n.cast("string"), F.lit(". "), F.regexp_replace("title", f"{X.SPACE}+", " "), F.lit("\n   出典: "), F.col("source"), F.lit(" · 公開 "), date("published_at"), F.lit(" · 収集 "), date("fetched_at"), F.lit("\n   "), F.col("url"), F.lit("\n   "), label, F.lit(": "), summary]
    return F.concat(*parts)


def markdown(selected: DataFrame) -> DataFrame:
    """The articles' text in order, in one row: at most ``TOP`` items."""
    n = F.row_number().over(_all())
    items = selected.select(n.alias("n"), item_text(n).alias("text")).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("items"))
    return items.select(F.array_join(F.transform("items", lambda i: i["text"]), "\n\n").alias("markdown"))


def heading(bundle: dict) -> str:
    run = bundle["run"]
    return HEADING.format(note=NOTE, **{k: bundle[k] for k in ("generatedAt", "validUntil", "status")}, **{k: run.get(k) for k in ("repository", "sha", "url", "attempt")})


def text(bundle: dict, items: str) -> str:
    """The whole brief: its header, and the articles' text or why there are none."""
    return heading(bundle) + (f"\n{items}\n" if bundle["deliveryAllowed"] else NOTHING.format(reasons=", ".join(bundle["reasons"]) or NO_NEW))


def bundle(selected: DataFrame, state: dict, run: dict, now: dt.datetime, until: dt.datetime, scanned: int, limited: bool) -> tuple[dict, str]:
    """The brief as it's written, and its text, from the selected articles (at most ``TOP``), the run's status and reasons."""
    stamp = lambda t: t.isoformat() if t else None
    names = [f.strip().split(" ")[0] for f in ARTICLE.split(",")]
    rows = [r.asDict(recursive=True) for r in selected.select(*names).orderBy(*(F.col(c).desc() for c in ORDER)).limit(TOP).collect()]
    articles = [{k: stamp(v) if isinstance(v, dt.datetime) else v for k, v in r.items()} for r in rows]
    allowed = bool(articles) and state["status"] != "unavailable"
    out = {
        "schemaVersion": 1, "selection": {"policy": POLICY, "candidateLimit": SCAN, "scannedCandidates": scanned, "maxArticles": TOP, "sourceLimited": limited},
        "delivery": {"attempted": False, "history": "not_checked"}, "generatedAt": stamp(now), "validUntil": stamp(until), "run": run, "status": state["status"],
        "deliveryAllowed": allowed, "reasons": list(state["reasons"]), "articles": articles, "qualityNote": NOTE,
    }
    return out, text(out, markdown(selected).first()["markdown"] if allowed else "")


def _all():
    from pyspark.sql import Window

    return Window.orderBy(*by_freshness())
