"""Enrichment: evidence gates, the check of generated summaries against their source, and the state of each page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.sources import dims

# States by what may follow.
RETRYABLE = ["pending", "body_unavailable", "rate_limited", "model_failed"]
TERMINAL = ["ready", "excerpt", "insufficient_evidence", "non_ai", "invalid_response"]
MARKER = "enrichment-state"
ATTEMPTS, RETRY = 3, "interval 6 hours"
SUMMARY = "relevant boolean, summary string, evidence array<string>"


def gate(body: Column, keywords: list[str] | None = None) -> Column:
    """``insufficient_evidence`` under 120 characters, ``non_ai`` without a keyword in the body, else null."""
    return F.when(~X.trimmed_at_least(body, 120), "insufficient_evidence").when(~X.matches_keyword(body, keywords or dims.KEYWORDS + dims.KEYWORDS_JA), "non_ai")


def supported(summary: Column, body: Column) -> Column:
    """Whether each Latin term and number of a summary stands in the body, in any case."""
    return F.size(F.array_except(X.terms(F.lower(summary)), X.terms(F.lower(body)))) == 0


def quoted(evidence: Column, body: Column) -> Column:
    return F.size(evidence).between(1, 5) & F.forall(evidence, lambda q: (F.length(X.js_trim(q)) >= 20) & body.contains(q))


def grounded(raw: Column, body: Column) -> Column:
    """The summary and quotes of a model's answer, or null if any check fails."""
    got = F.from_json(X.strip_fence(raw), SUMMARY)
    summary = X.js_trim(got["summary"])
    ok = got["relevant"] & F.length(summary).between(30, 500) & quoted(got["evidence"], body) & supported(summary, body)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(summary.alias("summary"), got["evidence"].alias("evidence")))


def eligible(status: Column, attempts: Column, next_at: Column, now: Column) -> Column:
    return status.isin(RETRYABLE) & ((status == "rate_limited") | (attempts < ATTEMPTS)) & (next_at.isNull() | (next_at <= now))


def finished(status: Column, attempts: Column) -> Column:
    return ((status != "rate_limited") & (attempts >= ATTEMPTS)) | status.isin(TERMINAL)


def initial_status(lang: Column, abstract: Column) -> Column:
    """Japanese items start from their abstract, if it isn't blank; others wait for a summary."""
    return F.when(lang.eqNullSafe("ja") & F.coalesce(X.js_trim(abstract) != "", F.lit(False)), "excerpt").when(lang.eqNullSafe("ja"), "insufficient_evidence").otherwise("pending")


def parse_state(raw: Column, schema: str = "marker string, status string, attempts int, abstract string, nextAttemptAt timestamp") -> Column:
    """The state, or null unless marker and attempts are there: garbage parses to a struct of nulls."""
    got = F.from_json(raw, schema)
    return F.when((got["marker"] == MARKER) & got["attempts"].isNotNull(), got)


def page_states(blocks: DataFrame) -> DataFrame:
    """The state of each page: the first of its blocks (``page_id``, ``n``, ``text``) that parses as one. Pages without any aren't in the result."""
    parsed = blocks.select("page_id", "n", parse_state(F.col("text")).alias("state")).filter("state IS NOT NULL")
    return parsed.groupBy("page_id").agg(F.min_by("state", "n").alias("state")).select("page_id", "state.*")


# What may be kept of a failed call, and the mark of an excerpt that no check has seen.
REASONS = ["http_error", "timeout", "network_error", "incomplete_response", "invalid_response"]
CODE_KINDS = ["number", "numeric_string", "string", "null", "other"]
CODES = [
    "rate_limit_exceeded", "rate_limited", "too_many_requests", "insufficient_quota", "quota_exceeded", "invalid_api_key", "unauthorized",
    "invalid_request_error", "invalid_request", "model_not_found", "unknown_model", "server_error", "overloaded", "context_length_exceeded",
]
PROVIDER_TYPES = ["invalid_request_error", "authentication_error", "rate_limit_error", "server_error"]
CODE_STATUS = ["present", "missing", "no_body", "oversized", "invalid_json", "read_failed"]
HINT_STATUS = ["valid", "missing", "invalid"]
MOST_HINT = 7 * 86400
UNVERIFIED, EXCERPT = "【フィード抜粋・未検証】", 300


def safe_failure(raw: Column) -> Column:
    """A model call's failure without free text, null unless its stage and reason are known: an HTTP status in range, codes and provider
    types of known names (others: ``unrecognized``), known kinds and statuses, and a hint to wait (seconds) of at most a week."""
    field = lambda name: F.get_json_object(raw, f"$.{name}")
    known = lambda name, names: F.when(field(name).isin(names), field(name))
    there = lambda name: F.coalesce(F.array_contains(F.json_object_keys(raw), name), F.lit(False))
    named = lambda name, names: F.when(there(name), F.coalesce(known(name, names), F.lit("unrecognized")))
    whole = lambda name, low, high: F.when(field(name).rlike(r"^\d+$") & F.coalesce(field(name).try_cast("long").between(low, high), F.lit(False)), field(name).try_cast("int"))
    # a number in quotes is none: JSON text keeps the quotes
    number = lambda name, low, high: F.when(~raw.rlike(rf'"{name}"\s*:\s*"'), whole(name, low, high))
    kept = F.struct(
        field("stage").alias("stage"), field("reason").alias("reason"), number("httpStatus", 100, 599).alias("http_status"), named("code", CODES).alias("code"),
        known("codeKind", CODE_KINDS).alias("code_kind"), known("codeStatus", CODE_STATUS).alias("code_status"), named("providerType", PROVIDER_TYPES).alias("provider_type"),
        number("retryAfterSeconds", 0, MOST_HINT).alias("retry_after"), known("retryAfterStatus", HINT_STATUS).alias("retry_after_status"),
    )
    return F.when((field("stage") == "model") & field("reason").isin(REASONS), kept)


def collected_summary(lang: Column, abstract: Column, summary: Column) -> Column:
    """What is stored as summary at collection: of Japanese items a marked excerpt of their abstract (empty if there is none), else the summary."""
    text = F.substring(X.js_trim(abstract), 1, EXCERPT)
    return F.when(lang.eqNullSafe("ja"), F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(UNVERIFIED), text)).otherwise("")).otherwise(summary)


def append_batches(texts: DataFrame, size: int = 2000, per_call: int = 100) -> DataFrame:
    """``page_id``, ``call``, ``n``, ``chunk``: texts in pieces, as many to a call as the store takes."""
    return texts.select("page_id", F.posexplode(X.chunks(F.col("text"), size)).alias("n", "chunk")).select("page_id", F.floor(F.col("n") / per_call).alias("call"), "n", "chunk")


def transition(attempts: Column, body: Column, raw: Column, http: Column, hint: Column, now: Column, failed: Column, keywords: list[str] | None = None) -> Column:
    """``status``, ``attempts``, ``next_at`` after one try. ``body`` null: none was found; ``http`` 429 isn't charged and waits at least as long as its hint (seconds)."""
    throttled = F.coalesce(http == 429, F.lit(False))
    passed = F.when(throttled, "rate_limited").when(F.coalesce(failed, F.lit(False)), "model_failed").when(grounded(raw, body).isNull(), "invalid_response").otherwise("ready")
    status = F.when(body.isNull(), "body_unavailable").otherwise(F.coalesce(gate(body, keywords), passed))

    def after(status: Column) -> Column:
        wait = F.when(status == "rate_limited", F.greatest(F.lit(6 * 3600), F.coalesce(hint, F.lit(0)))).otherwise(F.lit(6 * 3600))
        later = now + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))
        return F.struct(status.alias("status"), F.when(status == "rate_limited", attempts).otherwise(attempts + 1).alias("attempts"), F.when(status != "ready", later).alias("next_at"))

    return F.get(F.transform(F.array(status), after), F.lit(0))  # a lambda's variable: the checks of a text are made once, not for each column


def cooldown(events: DataFrame, until: str, cause: str, ordinal: Column) -> DataFrame:
    """The circuit's state: the latest deadline and its cause; of equal deadlines the first keeps its cause."""
    return events.agg(F.max(until).alias("until"), F.max_by(cause, F.struct(F.col(until), -ordinal)).alias("cause"))


def backlog_steps(backlog: DataFrame, states: DataFrame, now: Column, limit: int = 10, blocked_until: Column | None = None) -> DataFrame:
    """The backlog (``ordinal``, ``page_id``) with its states and the ``step`` of a run: ``drop`` pages without a state or finished, ``work``
    on the first eligible ones, at most ``limit``, leave others that could be worked on for ``later``, and ``wait`` with the rest.
    While the circuit is open (``blocked_until``) nothing is worked on or dropped."""
    rows = backlog.select("ordinal", "page_id").join(states.select("page_id", "status", "attempts", "next_at"), "page_id", "left")
    may = F.coalesce(eligible(F.col("status"), F.col("attempts"), F.col("next_at"), now) & ~finished(F.col("status"), F.col("attempts")), F.lit(False))
    first = rows.filter(may).orderBy("ordinal").limit(limit).select(F.col("ordinal").alias("__first"))
    rows = rows.join(F.broadcast(first), F.col("ordinal") == F.col("__first"), "left")
    gone = F.col("status").isNull() | finished(F.col("status"), F.col("attempts"))
    step = F.when(gone, "drop").when(F.col("__first").isNotNull(), "work").when(may, "later").otherwise("wait")
    step = F.when(blocked_until > now, "wait").otherwise(step) if blocked_until is not None else step
    return rows.select("ordinal", "page_id", "status", "attempts", "next_at", step.alias("step"))


def merge_results(pages: DataFrame, results: DataFrame, *columns: str) -> DataFrame:
    """Pages with the results' cells in place of their own where a page has a result. Repeating it changes nothing, so a summary and then
    the state are saved by two such steps, and a run that breaks between them is repeated whole."""
    new = results.select(F.col("page_id").alias("__page"), *(F.col(c).alias(f"__{c}") for c in columns))
    rows = pages.join(new, F.col("page_id") == F.col("__page"), "left")
    return rows.select(*(F.when(F.col("__page").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in pages.columns))


def reserve(state: DataFrame, now: Column) -> DataFrame:
    """Puts a row's next try off before work on it begins, without charging an attempt."""
    return state.withColumn("next_at", now + F.expr(RETRY))


REPORT = "schema_version int, stage string, status string, repository string, ref string, run_id string, started_at timestamp, finished_at timestamp, operation string, http_status int, hint long, explicit_at timestamp, dated boolean"


def rejections(reports: DataFrame, run: dict, now: Column) -> DataFrame:
    """The reports (``REPORT``) of throttled model calls, with ``until``, the deadline that each proves, or the ``problem`` that bars it.

    A report counts if it's a failed enrichment of this repository and ref, that began before it ended and ended by now (a minute of skew is
    allowed). The deadline is the one it states (``dated``: whether it states one; it may not be before the wait since the start), else the
    wait since its end: six hours, or longer if the hint (seconds) says so. Waits that only cite an old rejection aren't model calls."""
    wait = F.greatest(F.lit(6 * 3600), F.when(F.col("hint").between(0, MOST_HINT), F.col("hint")).otherwise(0))
    after = lambda at: F.col(at) + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))
    valid = (
        (F.col("schema_version") == 1) & (F.col("stage") == "enrich") & (F.col("status") == "failed") & (F.col("repository") == run["repository"]) & (F.col("ref") == run["ref"])
        & F.col("run_id").isNotNull() & (F.col("started_at") <= F.col("finished_at")) & (F.col("finished_at") <= now + F.expr("interval 60 seconds"))
    )
    dated = F.coalesce(F.col("dated"), F.lit(False))
    problem = F.when(~F.coalesce(valid, F.lit(False)), "invalid_report").when(dated & ~F.coalesce(F.col("explicit_at") >= after("started_at"), F.lit(False)), "invalid_deadline")
    found = reports.filter((F.col("operation") == "model") & (F.col("http_status") == 429))
    return found.select("run_id", problem.alias("problem"), F.when(problem.isNull(), F.when(dated, F.col("explicit_at")).otherwise(after("finished_at"))).alias("until"))


def migrate_cooldown(reports: DataFrame, current: DataFrame, run: dict, now: Column) -> DataFrame:
    """One row: ``until`` and ``cause`` of the cooldown that the reports and the current one (``until``, ``cause``; one row or none) give, ``changed``,
    and ``status``: active or expired by now, ``missing_evidence`` if nothing shows one, ``refused`` if a report is invalid, whereupon
    the current one stays. A later deadline that's there stays too. Safe to repeat."""
    own = rejections(reports, run, now).agg(F.max("until").alias("found"), F.coalesce(F.bool_or(F.col("problem").isNotNull()), F.lit(False)).alias("refused"))
    held = current.agg(F.max("until").alias("held"), F.max_by("cause", "until").alias("held_cause"))
    both = own.join(F.broadcast(held), how="inner")  # one row each
    changed = ~F.col("refused") & F.coalesce(F.col("held").isNull() | (F.col("found") > F.col("held")), F.lit(False)) & F.col("found").isNotNull()
    until = F.when(changed, F.col("found")).otherwise(F.col("held"))
    status = F.when(F.col("refused"), "refused").when(until.isNull(), "missing_evidence").when(until > now, "active").otherwise("expired")
    return both.select(until.alias("until"), F.when(changed, "rate_limited").otherwise(F.col("held_cause")).alias("cause"), changed.alias("changed"), status.alias("status"))


def chunk_progress(state: DataFrame, inputs: DataFrame, size: int = 3000) -> DataFrame:
    """The next chunk of each text to translate: progress counts only while the source's hash is the same."""
    hashed = inputs.withColumn("source_hash", F.sha2("text", 256)).withColumn("chunks", X.chunks(F.col("text"), size))
    at = F.coalesce("next", F.lit(0))
    return hashed.join(state.select("source_hash", "next"), "source_hash", "left").select("source_hash", at.alias("next"), F.get("chunks", at).alias("chunk"), (at >= F.size("chunks")).alias("complete"))


def enrich(pages: DataFrame, generate: Callable, schema: str) -> DataFrame:
    """The model call: ``generate`` is given and returns batches (``mapInPandas``); it isn't part of the engine."""
    return pages.mapInPandas(generate, schema)
