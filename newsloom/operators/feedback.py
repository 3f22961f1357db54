"""Reactions folded into statuses, and the delivery ledger."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators.integrity import get, put
from newsloom.operators.keyed import Keyed
from newsloom.sources import dims

# States of an entry, and the most articles of a ledger.
LEDGER_STATES = ["pending", "sending", "sent", "uncertain", "failed"]
MOST_ARTICLES = 10


def action(names: Column) -> Column:
    """Starred if any strong reaction is there, else Read, else null."""
    of = lambda xs: F.array(*(F.lit(x) for x in xs))
    return F.when(F.arrays_overlap(names, of(dims.STARRED)), "Starred").when(F.arrays_overlap(names, of(dims.READ)), "Read")


def fold(reactions: DataFrame, key: str = "url") -> DataFrame:
    """The strongest action of each key."""
    rank = status_rank(F.col("action"))
    return reactions.filter("action IS NOT NULL").groupBy(key).agg(F.max_by("action", rank).alias("action"))


def status_rank(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in dims.STATUS_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def raise_status(pages: DataFrame, reactions: DataFrame, key: str = "url") -> DataFrame:
    """Statuses only rise."""
    rows = pages.join(fold(reactions, key), key, "left")
    up = F.coalesce(status_rank(F.col("action")), F.lit(-1)) > F.coalesce(status_rank(F.col("status")), F.lit(-1))
    return rows.withColumn("status", F.when(up, F.col("action")).otherwise(F.col("status"))).drop("action")


def save_statuses(table: Keyed, reactions: DataFrame) -> int:
    """Raises the statuses of a stored table of pages; of keys that aren't there nothing is kept. Gives the table's version."""
    rank = lambda c: F.coalesce(status_rank(c), F.lit(-1))
    found = fold(reactions, table.key).withColumnRenamed("action", "status")
    return table.merge(found, {"status": lambda old, new: F.when(rank(new) > rank(old), new).otherwise(old)})


def replies(messages: DataFrame, now: Column, prefix: str, days: int = 3) -> DataFrame:
    """``url`` and ``action`` of the messages in the threads of digest parents of the last days, from their reactions. Parents begin with the
    prefix and have replies, and aren't themselves in another's thread; ``ts`` is text of epoch seconds."""
    since = now.cast("timestamp").cast("double") - days * 86400
    recent = (F.col("reply_count") > 0) & F.col("text").startswith(prefix) & (F.col("ts").cast("double") >= F.floor(since))
    parents = messages.filter(recent & F.coalesce(F.col("thread_ts") == F.col("ts"), F.lit(True))).select(F.col("ts").alias("parent"))
    own = messages.filter(F.col("thread_ts").isNotNull()).join(parents, F.col("thread_ts") == F.col("parent"))
    return own.select(X.first_link(F.col("text")).alias("url"), action(F.transform("reactions", lambda r: r["name"])).alias("action")).filter("url IS NOT NULL AND action IS NOT NULL")


def batch_id(channel: Column, date: Column, urls: Column) -> Column:
    """The digest of the JSON array of channel, date and the list of URLs."""
    return F.sha2(X.json_tuple(channel, date, urls), 256)


def deliver(spark: SparkSession, path: str, send: Callable[[dict], str], pause: Callable[[], None] = lambda: None) -> dict:
    """Sends the ledger at ``path``: its parent, then a reply for each of its articles, at most ``MOST_ARTICLES``, in order.

    Each intent is stored before its effect and each outcome after it. Sent entries are skipped; one in flight or uncertain
    blocks the run with a ValueError, as a replay might send it twice, and so does an invalid ledger. ``send`` is given the
    channel, the article (null for the parent) and the parent's ``ts``, and returns the message's; if it raises
    ``ConnectionRefusedError``, nothing was sent (``failed``); after any other error, or without a ``ts``, that isn't known
    (``uncertain``). The first entry that isn't sent ends the run. ``pause`` is called after each one sent.
    """
    box = json.loads(get(spark, path))
    if why := invalid_ledger(box):
        raise ValueError(f"the ledger can't be sent: {why}")
    entries = [(box["parent"], None), *zip(box["replies"], box["articles"], strict=True)]
    if any(e["state"] in ("sending", "uncertain") for e, _ in entries):
        raise ValueError("an entry's outcome isn't known: look it up first")

    def mark(entry: dict, state: str, ts: str | None = None) -> None:
        entry |= {"state": state, "ts": ts}
        put(spark, path, json.dumps(box, ensure_ascii=False))

    for entry, article in entries:
        if entry["state"] == "sent":
            continue
        mark(entry, "sending")
        try:
            ts = send({"channel": box["channel"], "article": article, "thread_ts": box["parent"].get("ts") if article is not None else None})
            mark(entry, *(("sent", ts) if isinstance(ts, str) and ts else ("uncertain",)))
        except ConnectionRefusedError:
            mark(entry, "failed")
        except Exception:
            mark(entry, "uncertain")
            raise
        if entry["state"] != "sent":
            raise RuntimeError(f"delivery {entry['state']}; the ledger is kept")
        pause()
    return box


def invalid_ledger(box: dict) -> str | None:
    """What is wrong with a ledger, or null."""
    articles, replies = box.get("articles"), box.get("replies")
    if box.get("version") != 1 or not box.get("channel") or not isinstance(articles, list) or len(articles) > MOST_ARTICLES:
        return "version, channel or articles"
    if not isinstance(replies, list) or len(replies) != len(articles):
        return "replies"
    for e in (box.get("parent"), *replies):
        if not isinstance(e, dict) or e.get("state") not in LEDGER_STATES or e["state"] == "sent" and not (isinstance(e.get("ts"), str) and e["ts"]):
            return "an entry"
    return None


def prepare(articles: DataFrame, channel: str, date: str) -> DataFrame:
    """One row, the ledger of a batch: the last article of each URL at its first place, at most ``MOST_ARTICLES``; all pending."""
    from newsloom.operators.rank import last_wins

    entry = F.struct(F.lit("pending").alias("state"), F.lit(None).cast("string").alias("ts"))
    top = last_wins(articles, "url", MOST_ARTICLES).agg(F.array_sort(F.collect_list(F.struct("ordinal", "url"))).alias("a"))
    urls = F.transform("a", lambda x: x["url"])
    return top.filter("size(a) > 0").select(F.lit(1).alias("version"), batch_id(F.lit(channel), F.lit(date), urls).alias("id"), F.lit(channel).alias("channel"), F.lit(date).alias("date"), urls.alias("articles"), entry.alias("parent"), F.transform("a", lambda _: entry).alias("replies"))


def may_replay(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """``batch``, ``ok`` of each source (``batch``, ``run_id``, ``name``, ``reviewed``): whether its batch may be sent from it.

    Artifacts have ``batch``, ``kind`` (intent or result), ``id``, ``name``, ``run_id``, ``expired``. The newest intent of the batch
    counts, expired or not; the source must be a live result of the intent's run that is newer. Without an intent, a reviewed source may.
    """
    intent = artifacts.filter("kind = 'intent'").groupBy("batch").agg(F.max("id").alias("i_id"), F.max_by("run_id", "id").alias("i_run"))
    result = artifacts.filter("kind = 'result' AND NOT coalesce(expired, false)").groupBy("batch", "name", "run_id").agg(F.max("id").alias("r_id"))
    rows = sources.join(intent, "batch", "left").join(result, ["batch", "name", "run_id"], "left")
    newer = (F.col("run_id") == F.col("i_run")) & (F.col("r_id") > F.col("i_id"))
    return rows.select("batch", F.coalesce(F.when(F.col("i_id").isNull(), F.col("reviewed")).otherwise(newer), F.lit(False)).alias("ok"))


def valid_outbox(version: Column, channel: Column, articles: Column, parent: Column, replies: Column) -> Column:
    """Whether a ledger's row may be sent; false for anything missing."""
    good = lambda d: d["state"].isin(LEDGER_STATES) & ((d["state"] != "sent") | (F.coalesce(d["ts"], F.lit("")) != ""))
    ok = (version == 1) & (channel != "") & F.size(articles).between(0, MOST_ARTICLES) & (F.size(articles) == F.size(replies)) & good(parent) & F.forall(replies, good)
    return F.coalesce(ok, F.lit(False))


def next_delivery(state: Column) -> Column:
    """What a run may do with an entry: sent ones are skipped, those in flight or uncertain block, others may be sent."""
    return F.when(state == "sent", "skip").when(state.isin("sending", "uncertain"), "block").otherwise("send")


def foreign(outbox: DataFrame, bundle: DataFrame) -> DataFrame:
    return outbox.join(bundle.select("url"), "url", "left_anti")


# The digest's header and the line below it.
DIGEST = "🗞️ AI News Digest — "
SHOWN_OF, ALL_SHOWN = ("本日の新着 ", " 件から上位 ", " 件（各記事はスレッドに投稿）"), ("本日の新着 ", " 件（各記事はスレッドに投稿）")


def header(date: Column, total: Column, shown: Column) -> Column:
    """``title`` and ``context``: how many articles are shown, and of how many if there are more."""
    a, b, c = map(F.lit, SHOWN_OF)
    one, rest = map(F.lit, ALL_SHOWN)
    text = F.when(total > shown, F.concat(a, total.cast("string"), b, shown.cast("string"), c)).otherwise(F.concat(one, shown.cast("string"), rest))
    return F.struct(F.concat(F.lit(DIGEST), date).alias("title"), text.alias("context"))
