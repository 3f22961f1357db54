"""The entry functions: what a run of each command computes, composed of the operators. Fetches and model calls are given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.urls import url_key
from newsloom.operators import brief, enrich, queue, rank, site
from newsloom.sources import dims, readers


def collect(spark: SparkSession, sources: list[Callable[[], DataFrame]], backlog: DataFrame, confirmed: DataFrame, stored: DataFrame, now: Column) -> dict:
    """A collection: all sources that can be read, deduplicated, scored and merged with the backlog, then without what is stored.

    ``scored`` is what a dry run shows; ``pending`` the queue in its order; ``new`` what is to be saved, ``existing`` what is there
    already; ``failures`` the sources that gave nothing, and ``failed`` the same as a list. A source that breaks, also while it's read, costs only its rows.
    """
    frames, failures = readers.fetched(spark, sources)
    failed = [(r.source, r.error) for r in failures.collect()]  # one row a source at most
    dim = dims.source_dim(spark)
    if frames:
        items = readers.union_sources(frames)
        missing = {c: v for c, v in (("score", F.lit(0)), ("lang", F.lit(None).cast("string")), ("fetched_at", now)) if c not in items.columns}
        scored = rank.score(rank.dedup_by_url(items.withColumns(missing)), dim)
    else:
        scored = backlog.limit(0)
    ranked = scored.filter(F.col("score") >= dims.MIN_SCORE)
    pending = queue.merge_pending(backlog, ranked, confirmed, now)
    return {"scored": scored, "pending": pending, "new": queue.unsaved(pending, stored), "existing": queue.existing(pending, stored), "failed": failed, "failures": failures}


def outputs(saved: int, pending: int, bundle_status: str | None = None, n_articles: int = 0) -> dict:
    """A job's outputs: ``ready`` once anything was saved or nothing is pending; ``deliverable`` for a brief with articles that is ok or partial."""
    return {"ready": saved > 0 or pending == 0, "deliverable": bundle_status in ("ok", "partial") and n_articles > 0, "status": bundle_status}


def enrich_run(backlog: DataFrame, states: DataFrame, bodies: DataFrame, answers: DataFrame, now: Column, blocked_until: Column | None = None, keywords: list[str] | None = None) -> dict:
    """An enrichment: the backlog's steps, the new states of the pages worked on, their summaries, and the backlog that is left.

    ``bodies`` (``page_id``, ``body``, as ``readers.page_bodies`` gives them) and ``answers`` (``page_id``, ``raw``, ``http``, ``hint``, ``failed``) are what was fetched and generated.
    """
    steps = enrich.backlog_steps(backlog, states, now, blocked_until=blocked_until)
    work = steps.filter("step = 'work'").join(bodies, "page_id", "left").join(answers, "page_id", "left")
    state = enrich.transition(F.col("attempts"), F.col("body"), F.col("raw"), F.col("http"), F.col("hint"), now, F.col("failed"), keywords)
    done = work.select("ordinal", "page_id", state.alias("s"), enrich.grounded(F.col("raw"), F.col("body")).alias("g"))
    done = done.select("ordinal", "page_id", "s.status", "s.attempts", "s.next_at", F.when(F.col("s.status") == "ready", F.col("g.summary")).alias("summary"), F.col("g.evidence").alias("evidence"))
    over = done.filter(enrich.finished(F.col("status"), F.col("attempts"))).select("page_id").unionByName(steps.filter("step = 'drop'").select("page_id"))
    return {"steps": steps, "states": done, "backlog": backlog.join(over, "page_id", "left_anti")}


def build_brief(pages: DataFrame, states: DataFrame, reports: DataFrame, now: Column) -> dict:
    """A brief: its articles, expiry and status. ``reports`` is the one row of flags that ``brief.report_flags`` gives, without ``n_articles``;
    ``limited`` is the scan's own. A blocked run, or one that fetched nothing, has no articles, whatever is stored."""
    found, more = brief.candidates(pages, states, now)
    reports = reports.drop("limited")
    may = reports.select((~brief.blocked() & (F.col("fetched") > 0)).alias("__may"))
    good = found.filter(brief.grounded_candidate(now)).join(F.broadcast(may.filter("__may")), how="left_semi")  # one row or none
    chosen = brief.select(good, now)
    flags = reports.join(F.broadcast(more), how="inner").join(F.broadcast(chosen.agg(F.count("*").alias("n_articles"))), how="inner")  # one row each
    return {"articles": chosen, "expiry": brief.expiry(chosen, now), "status": brief.status(flags)}


def export_site(pages: DataFrame, today: Column, spark: SparkSession) -> dict:
    """The site's tables: rows with gaps filled, statistics, the search index, month archive and facets."""
    rows = site.coerce(site.export_rows(pages, dims.source_dim(spark)))
    return {"rows": rows, "stats": site.export_stats(rows, today), "index": site.search_index(rows, today), "months": site.month_histogram(rows), "sources": site.facet_top(rows, "source"), "categories": site.facet_top(site.by_category(rows), "category")}


def recover(snapshot: DataFrame, queued: DataFrame) -> DataFrame:
    """Pages to put back into the enrichment queue."""
    return readers.recoverable(snapshot, queued)


def confirm_saved(confirmed: DataFrame, saved: DataFrame) -> DataFrame:
    return queue.confirm(confirmed, saved.withColumn("url_key", url_key(F.col("url"))))
