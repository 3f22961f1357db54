import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import brief, enrich, feedback, integrity, queue, site

NOW = dt.datetime(2026, 10, 15, 12)
RUN = {"repository": "a/b", "ref": "main", "runId": 5, "attempt": 1, "sha": "c0"}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def bundle(**over):
    text = "A summary of the article that is long enough to pass."
    article = {"id": sha("e.com/a"), "title": "A", "url": "https://e.com/a", "source": "s", "score": 1, "published_at": "2026-10-15T00:00:00", "fetched_at": "2026-10-15T11:00:00", "summary": text, "summary_kind": "source_quoted", "summary_hash": sha(text), "summary_recorded_at": "2026-10-15T11:30:00", "evidence": ["a quotation of the article"]}
    return {"schemaVersion": 1, "selection": {"policy": "grounded_recent_v1"}, "deliveryAllowed": True, "run": RUN, "status": "ok", "generatedAt": "2026-10-15T11:59:00", "validUntil": "2026-10-15T19:00:00", "articles": [article | over.pop("article", {})]} | over


def test_bundle_files(spark, tmp_path):
    d = str(tmp_path)
    brief.write_files(spark, d, bundle(), "# é\n")
    assert brief.verify_files(spark, d, NOW, RUN) == bundle() and integrity.get(spark, f"{d}/brief.md") == "# é\n"
    with pytest.raises(ValueError, match="run"):
        brief.verify_files(spark, d, NOW, RUN | {"attempt": 2})
    integrity.put(spark, f"{d}/brief.md", "changed")
    with pytest.raises(ValueError, match="manifest"):
        brief.verify_files(spark, d, NOW, RUN)


@pytest.mark.parametrize("bad", [{"deliveryAllowed": False}, {"deliveryAllowed": None}, {"selection": {"policy": "newest"}}, {"selection": None}, {"status": "empty"}, {"articles": []}, {"validUntil": "2026-10-15T12:00:00"}, {"validUntil": "2026-10-15T20:00:00"}, {"validUntil": None}, {"generatedAt": "2026-10-15T12:02:00"}, {"article": {"id": "x"}}, {"article": {"title": " "}}, {"article": {"summary": "another summary, which has not the hash that was kept"}}, {"article": {"published_at": None}}, {"article": {"evidence": []}}])
def test_bundles_that_cannot_be_delivered(spark, bad):
    brief.assert_deliverable(spark, bundle(), NOW, RUN)
    with pytest.raises(ValueError):
        brief.assert_deliverable(spark, bundle(**bad), NOW, RUN)


def ledger(*states, **over):
    return {"version": 1, "channel": "c", "articles": [{"url": k} for k in range(len(states) - 1)], "parent": states[0], "replies": list(states[1:])} | over


def entry(state, ts=None):
    return {"state": state, "ts": ts or ("9.9" if state == "sent" else None)}


def test_ledger(spark, tmp_path):
    path, sent = f"{tmp_path}/box.json", []

    def states():
        box = json.loads(integrity.get(spark, path))
        return [e["state"] for e in (box["parent"], *box["replies"])]

    def send(message):
        assert states()[len(sent)] == "sending" and message["channel"] == "c"
        sent.append((message["article"], message["thread_ts"]))
        return f"{len(sent)}.5"

    integrity.put(spark, path, json.dumps(ledger(entry("pending"), entry("failed"), entry("pending"))))
    feedback.deliver(spark, path, send)
    assert states() == ["sent"] * 3 and sent == [(None, None), ({"url": 0}, "1.5"), ({"url": 1}, "1.5")]
    feedback.deliver(spark, path, send)  # all are sent: nothing happens
    assert len(sent) == 3


@pytest.mark.parametrize("error, kept", [(ConnectionRefusedError(), "failed"), (TimeoutError(), "uncertain"), (None, "uncertain"), ("", "uncertain")])
def test_ledger_stops_at_a_failure(spark, tmp_path, error, kept):
    path = f"{tmp_path}/box.json"

    def send(message):
        if message["article"] == {"url": 1}:
            if isinstance(error, Exception):
                raise error
            return error
        return "1.5"

    integrity.put(spark, path, json.dumps(ledger(entry("sent"), entry("pending"), entry("pending"), entry("pending"))))
    with pytest.raises((RuntimeError, TimeoutError)):
        feedback.deliver(spark, path, send)
    assert [e["state"] for e in json.loads(integrity.get(spark, path))["replies"]] == ["sent", kept, "pending"]
    if kept == "uncertain":
        with pytest.raises(ValueError, match="outcome"):
            feedback.deliver(spark, path, send)


@pytest.mark.parametrize("box", [ledger(entry("pending"), version=2), ledger(entry("pending"), channel=""), ledger(entry("pending"), replies=[entry("pending")]), ledger(entry("lost")), ledger({"state": "sent", "ts": ""}), ledger(*[entry("pending")] * 12)])
def test_invalid_ledgers(spark, tmp_path, box):
    path = f"{tmp_path}/box.json"
    integrity.put(spark, path, json.dumps(box))
    with pytest.raises(ValueError, match="can't be sent"):
        feedback.deliver(spark, path, lambda m: "1.5")


def test_replay_needs_the_newest_intents_own_result(spark):
    a = [("b", "intent", 1, "i", 7, False), ("b", "result", 2, "r", 7, False), ("e", "intent", 1, "i", 7, False), ("e", "result", 2, "r", 7, False), ("e", "intent", 3, "i", 8, True), ("o", "intent", 5, "i", 7, False), ("o", "result", 4, "r", 7, False), ("x", "intent", 1, "i", 7, False), ("x", "result", 2, "r", 7, True)]
    artifacts = spark.createDataFrame(a, "batch string, kind string, id long, name string, run_id long, expired boolean")
    sources = spark.createDataFrame([("b", 7, "r", False), ("e", 7, "r", False), ("o", 7, "r", False), ("x", 7, "r", False), ("new", 7, "r", True), ("none", 7, "r", False)], "batch string, run_id long, name string, reviewed boolean")
    assert {r.batch: r.ok for r in feedback.may_replay(artifacts, sources).collect()} == {"b": True, "e": False, "o": False, "x": False, "new": True, "none": False}


def test_batch_id_and_json(spark):
    df = spark.createDataFrame([("C1", "2026-10-15", ["https://e.com/a", 'q"é'], None)], "c string, d string, u array<string>, n string")
    got = df.select(feedback.batch_id(F.col("c"), F.col("d"), F.col("u")), X.json_tuple(F.col("n"), F.lit(3), F.col("u"))).first()
    assert got[0] == sha('["C1","2026-10-15",["https://e.com/a","q\\"é"]]') and json.loads(got[1]) == [None, 3, ["https://e.com/a", 'q"é']]


def test_replies_of_recent_parents(spark):
    at = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())
    react, link = [{"name": "star"}], "<https://e.com/{}|x>"
    data = [(str(at - age), None, text, n, []) for age, text, n in ((100, "Digest 1", 1), (4 * 86400, "Digest 0", 1), (200, "Other", 1), (300, "Digest 2", 0))]
    data += [("9", str(at - age), link.format(age), 0, react) for age in (100, 4 * 86400, 200, 300)]
    df = spark.createDataFrame(data, "ts string, thread_ts string, text string, reply_count int, reactions array<struct<name:string>>")
    assert [tuple(r) for r in feedback.replies(df, F.lit(NOW), "Digest").collect()] == [("https://e.com/100", "Starred")]


def test_lookup_by_spellings(spark):
    pages = spark.createDataFrame([(1, "http://www.e.com/a/", 1), (0, "https://e.com/a", 2), (2, "https://f.com", 3)], "ordinal long, url string, page_id long")
    urls = spark.createDataFrame([("https://e.com/a?utm_source=x",), ("https://g.com",), (None,)], "url string")
    assert [tuple(r) for r in queue.lookup(urls, pages).collect()] == [("https://e.com/a?utm_source=x", 2)]


def test_states_failures_and_summaries(spark):
    state = json.dumps({"marker": enrich.MARKER, "status": "pending", "attempts": 2})
    blocks = spark.createDataFrame([(1, 0, "text"), (1, 1, state), (1, 2, state.replace("2", "3")), (2, 0, "{}"), (3, 0, None)], "page_id long, n int, text string")
    assert [(r.page_id, r.attempts) for r in enrich.page_states(blocks).collect()] == [(1, 2)]
    raw = ['{"stage": "model", "reason": "timeout", "httpStatus": 999, "codeKind": "string", "message": "secret"}', '{"stage": "model", "reason": "secret"}', "junk", None]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(r,) for r in raw], "r string").select(enrich.safe_failure(F.col("r"))).collect()]
    assert got == [("model", "timeout", None, None, "string", None, None, None, None), None, None, None]
    raw = {"stage": "model", "reason": "http_error", "httpStatus": 429, "code": "rate_limited", "codeKind": "string", "codeStatus": "present", "providerType": "rate_limit_error", "retryAfterSeconds": 60, "retryAfterStatus": "valid"}
    odd = {"stage": "model", "reason": "http_error", "httpStatus": "429", "code": None, "codeKind": "secret", "codeStatus": "secret", "providerType": {"a": 1}, "retryAfterSeconds": 7 * 86400 + 1, "retryAfterStatus": "x"}
    got = [tuple(r[0]) for r in spark.createDataFrame([(json.dumps(r),) for r in (raw, odd, raw | {"retryAfterSeconds": 1.5, "code": 7, "httpStatus": 99})], "r string").select(enrich.safe_failure(F.col("r"))).collect()]
    assert got[0] == tuple(raw.values())
    assert got[1] == ("model", "http_error", None, "unrecognized", None, None, "unrecognized", None, None)
    assert got[2] == ("model", "http_error", None, "unrecognized", "string", "present", "rate_limit_error", None, "valid")
    df = spark.createDataFrame([("ja", " 本文 ", "s"), ("ja", None, "s"), ("en", "a", "s")], "l string, a string, s string")
    assert [r[0] for r in df.select(enrich.collected_summary(F.col("l"), F.col("a"), F.col("s"))).collect()] == [enrich.UNVERIFIED + "本文", "", "s"]
    parts = enrich.append_batches(spark.createDataFrame([(1, "x" * 7)], "page_id long, text string"), 2, 3).collect()
    assert [(r.call, r.n, r.chunk) for r in parts] == [(0, 0, "xx"), (0, 1, "xx"), (0, 2, "xx"), (1, 3, "x")]


def test_index_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(0, 'A "b"', "https://e.com", "s", "LLM,RAG", 7, "en", "primary", None, NOW)], "ordinal long, title string, url string, source string, categories string, score int, lang string, kind string, status string, fetched_at timestamp")
    site.write_index(df, f"{tmp_path}/i")
    r = site.read_index(spark, f"{tmp_path}/i").first()
    assert (r.title, r.score, r.status, r.haystack) == ('A "b"', 7, None, 'a "b" s llm rag')
    site.write_snapshot(df, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        site.write_snapshot(df.limit(0), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").count() == 1
    two = df.unionByName(df.withColumns({"ordinal": F.lit(1).cast("long"), "url": F.lit("https://www.e.com/"), "score": F.lit(9)}))
    assert [r.score for r in brief.preview(two).collect()] == [9]
