"""Tables with a key: insert-if-absent, merges, versions, writers at the same time, and crashes between the steps."""

import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import enrich, feedback, integrity, keyed
from newsloom.operators.keyed import Keyed


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def content(path):
    return {f: open(f, "rb").read() for f in files(path)}


def test_filters_hold_all_keys_and_few_others():
    rng = np.random.default_rng(1)
    own, others = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 20_000))
    own, others = own // 64 * 64, others // 64 * 64  # of one bucket
    packed = keyed.key_filter(own)
    assert all(keyed.may_hold(packed, own[i : i + 1]) for i in range(0, len(own), 37))
    assert sum(keyed.may_hold(packed, others[i : i + 1]) for i in range(4000)) < 20
    assert not keyed.may_hold(keyed.key_filter(own[:1]), others[:10]) and not keyed.may_hold(keyed.key_filter(own[:0]), own[:10])


def test_a_batch_reads_few_parts(spark, tmp_path):
    table = Keyed(spark, str(tmp_path), "k")
    for w in range(3):
        table.insert(spark.range(w * 30_000, (w + 1) * 30_000).select(F.col("id").alias("k"), F.lit(w).alias("w")))
    _, state = table.state()
    assert len(state["parts"]) == 3 * 64
    batch = spark.range(1_000_000, 1_001_000).select(F.col("id").alias("k"), F.lit(9).alias("w"))
    assert len(table.candidates(state, batch)) < len(state["parts"]) / 10
    known = spark.createDataFrame([(5, 9), (70_000, 9)], "k long, w int")
    near = table.candidates(state, batch.unionByName(known))
    assert len(near) < len(state["parts"]) / 10
    got = table.insert(batch.unionByName(known)).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"created": 1000, "existing": 2}
    assert table.read().count() == 91_000 and table.read().filter("k IN (5, 70000) AND w = 9").count() == 0
    before = table.state()[1]
    written = content(tmp_path / "data")
    assert {r.outcome for r in table.insert(batch).collect()} == {"existing"} and table.state()[1]["parts"] == before["parts"]
    assert {f: b for f, b in content(tmp_path / "data").items() if f in written} == written


def test_large_batches_need_no_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_KEYS", 10)
    monkeypatch.setattr(keyed, "FILTER_KEYS", 50)
    table = Keyed(spark, str(tmp_path), "k", 4)
    table.insert(spark.range(500).select(F.col("id").alias("k")))
    assert table.insert(spark.range(400, 600).select(F.col("id").alias("k"))).filter("outcome = 'created'").count() == 100
    assert table.insert(spark.createDataFrame([(3,), (700,), (None,), (None,)], "k long")).filter("outcome = 'created'").count() == 2
    got = [r.k for r in table.read().collect()]
    assert len(got) == 602 and set(got) == {*range(600), 700, None}


def test_replayed_batches_leave_the_same_bytes(spark, tmp_path):
    table = Keyed(spark, str(tmp_path), "k", 8)
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4)], "k string, n int")
    assert {r.k: r.outcome for r in table.insert(rows, "s", 0).collect()} == {"a": "created", "b": "created", None: "created"}
    table.insert(rows.withColumn("n", F.lit(0)), "s", 1)
    before, version = content(tmp_path / "data"), table.state()[0]
    for epoch in (0, 1):
        assert {r.outcome for r in table.insert(rows.repartition(3), "s", epoch).collect()} == {"existing"}
    assert content(tmp_path / "data") == before and table.state()[0] == version
    assert sorted((str(r.k), r.n) for r in table.read().collect()) == [("None", 4), ("a", 1), ("b", 3)]
    assert table.insert(rows.limit(0), "s", 2).count() == 0 and table.read().count() == 3
    with pytest.raises(FileNotFoundError):
        Keyed(spark, str(tmp_path / "none"), "k").read()


def test_merge_like_a_plain_one(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    table = Keyed(spark, str(tmp_path), "k", 8)
    for step in range(4):
        batch = {rng.randrange(60): (step, rng.choice("abc")) for _ in range(25)}
        rows = spark.createDataFrame([(k, n, s) for k, (n, s) in batch.items()], "k long, n int, `odd.name` string")
        if step % 2 == 0:
            table.insert(rows)
            want = {k: v for k, v in batch.items() if k not in want} | want
        else:
            add = step == 3
            table.merge(rows, {"n": lambda old, new: F.greatest(old, new * 2)}, add)
            for k, (n, s) in batch.items():
                if k in want:
                    want[k] = (max(want[k][0], n * 2), s)
                elif add:
                    want[k] = (n, s)
        assert {r.k: (r.n, r["odd.name"]) for r in table.read().collect()} == want
    partial = spark.createDataFrame([(next(iter(want)), 99), (1000, 1)], "k long, n int")
    version, parts = table.state()[0], table.state()[1]["parts"]
    assert table.merge(partial) == version + 1
    assert len([p for p in table.state()[1]["parts"] if p in parts]) >= len(parts) - 1  # the others stay as they are
    want[next(iter(want))] = (99, want[next(iter(want))][1])
    assert {r.k: (r.n, r["odd.name"]) for r in table.read().collect()} == want
    assert table.merge(partial.limit(0)) == version + 1 and table.merge(partial.filter("k = 1000")) == version + 1  # nothing to do


def test_a_crash_between_two_steps_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch):
    table = Keyed(spark, str(tmp_path), "page_id", 4)
    pages = spark.createDataFrame([(i, "old", "pending") for i in range(20)], "page_id long, summary string, status string")
    results = spark.createDataFrame([(i, f"new {i}", "ready") for i in range(0, 20, 2)], "page_id long, summary string, status string")
    table.insert(pages)
    plain = lambda rows: sorted(tuple(r) for r in rows.collect())

    def save():
        table.merge(results.select("page_id", "summary"))
        table.merge(results.select("page_id", "status"))

    states = [plain(table.read())]
    commits = []

    def failing(*a):
        commits.append(a)
        if len(commits) in (1, 3):
            raise OSError("lost")
        return integrity.commit(*a)

    monkeypatch.setattr(keyed, "commit", failing)
    with pytest.raises(OSError):
        save()
    assert plain(table.read()) == states[0]  # the first step's parts are there, but no version names them
    with pytest.raises(OSError):
        save()
    half = plain(table.read())
    assert half == sorted((i, f"new {i}" if i % 2 == 0 else "old", "pending") for i in range(20))
    save()
    once = enrich.merge_results(enrich.merge_results(pages, results, "summary"), results, "status")
    assert plain(table.read()) == plain(once)
    save()
    assert plain(table.read()) == plain(once)


def test_statuses_only_rise_in_the_table(spark, tmp_path):
    table = Keyed(spark, str(tmp_path), "url", 4)
    pages = spark.createDataFrame([("a", "Unread"), ("b", "Starred"), ("c", "Read")], "url string, status string")
    table.insert(pages)
    reactions = spark.createDataFrame([("a", "Read"), ("b", "Read"), ("c", "Starred"), ("c", "Read"), ("z", "Read"), ("a", None)], "url string, action string")
    for _ in range(2):
        feedback.save_statuses(table, reactions)
        assert {r.url: r.status for r in table.read().collect()} == {r.url: r.status for r in feedback.raise_status(pages, reactions).collect()} == {"a": "Read", "b": "Starred", "c": "Starred"}


def at_once(*work):
    errors = []

    def run(f):
        try:
            f()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors


def test_writers_at_once(spark, tmp_path):
    table = Keyed(spark, str(tmp_path / "t"), "k", 4)
    table.insert(spark.createDataFrame([(0, -1)], "k long, w int"))
    done, seen = threading.Event(), []

    def write(w):
        Keyed(spark, str(tmp_path / "t"), "k", 4).insert(spark.range(w * 5, w * 5 + 20).select(F.col("id").alias("k"), F.lit(w).alias("w")))

    def read():
        while not done.is_set():
            seen.append(table.read().count())

    reader = threading.Thread(target=read)
    reader.start()
    try:
        at_once(*(lambda w=w: write(w) for w in range(4)))
    finally:
        done.set()
        reader.join()
    assert sorted(r.k for r in table.read().collect()) == list(range(35)) and table.state()[0] == 4
    assert seen == sorted(seen) and seen[0] >= 1


def test_versions_of_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        integrity.read_version(spark, path)
    at_once(*(lambda n=n: integrity.write_version(spark.range(n), path) for n in (3, 5, 7, 9)))
    assert sorted(integrity.read_version(spark, path, v).count() for v in range(4)) == [3, 5, 7, 9]
    assert integrity.read_version(spark, path).count() == integrity.read_version(spark, path, 3).count()
    assert not integrity.commit(spark, f"{path}/versions", 3, "other") and integrity.latest(spark, f"{path}/versions")[0] == 3
    assert not [f for f in os.listdir(f"{path}/versions") if "part" in f and not f.endswith(".crc")]
