"""Sealed checkpoints, run reports and versioned writes."""

from __future__ import annotations

import json
import os
import re
import threading
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``sha256`` of the JSON files in a directory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def seal(spark: SparkSession, path: str) -> dict[str, str]:
    """The manifest: a checkpoint has a few files."""
    return {r.name: r.sha256 for r in hashes(spark, path).collect()}


def mismatches(spark: SparkSession, path: str, manifest: dict[str, str]) -> DataFrame:
    """``name``, ``problem`` (changed, missing, extra) of files that differ from the manifest; empty if all is well."""
    want = spark.createDataFrame(list(manifest.items()), "name string, want string")
    both = hashes(spark, path).join(want, "name", "full_outer")
    problem = F.when(F.col("want").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when(F.col("want") != F.col("sha256"), "changed")
    return both.select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then renamed over it: a reader sees the old or the new one."""
    fs, p = _file(spark, path)
    part = p.suffix(".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), over)


def get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def latest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number and the text of the last version committed at ``path``; -1 and None if there is none."""
    fs, p = _file(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    found = max((int(n[:-5]) for n in names if re.fullmatch(r"\d{20}\.json", n)), default=-1)
    return found, read_version_file(spark, path, found) if found >= 0 else None


def read_version_file(spark: SparkSession, path: str, version: int) -> str:
    fs, p = _file(spark, f"{path}/{version:020d}.json")
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: int, text: str) -> bool:
    """Makes ``text`` the version of this number, unless another writer has: then False, and nothing changes. The file is written beside its
    place and moved there whole, without overwriting (a link where the file system is local, as its move isn't atomic)."""
    fs, p = _file(spark, f"{path}/{version:020d}.json")
    part = p.suffix(f".{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(part.toUri().getPath(), p.toUri().getPath())
        else:
            jvm = spark._jvm
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            never = spark.sparkContext._gateway.new_array(kind, 1)
            never[0] = kind.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), never)
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if fs.exists(p) and fs.exists(part) and "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        fs.delete(part, False)
    return True


def write_version(df: DataFrame, path: str, tries: int = 20) -> str:
    """Writes a new version beside the old ones, then commits its name: a reader sees all of one or of the other, and versions of writers
    at the same time follow each other."""
    name = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/data/{name}")
    for _ in range(tries):
        if commit(df.sparkSession, f"{path}/versions", latest(df.sparkSession, f"{path}/versions")[0] + 1, name):
            return name
    raise RuntimeError(f"{tries} other writers were first")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version, or the one of this number."""
    name = latest(spark, f"{path}/versions")[1] if version is None else read_version_file(spark, f"{path}/versions", version)
    if name is None:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.parquet(f"{path}/data/{name}")


def _observed(of: Observation, seconds: float = 10.0) -> dict:
    """An observation's counts; none if no action has run over it (it would wait for one)."""
    found: dict = {}
    waiting = threading.Thread(target=lambda: found.update(of.get), daemon=True)
    waiting.start()
    waiting.join(seconds)
    return found


@contextmanager
def report(stage: str, run: dict, clock=time.time):
    """A stage's report: running, then success or failed, always closed. Counts that ``counted`` takes come into its ``stats`` at the end."""
    out = {"schemaVersion": 1, "stage": stage, "run": run, "startedAt": clock(), "status": "running", "stats": {}}
    watched = out["observations"] = []
    try:
        yield out
        out["status"] = "success"
    except Exception as e:
        out |= {"status": "failed", "failure": type(e).__name__}
        raise
    finally:
        if out["status"] == "success":
            for of in watched:
                out["stats"] |= _observed(of)
        del out["observations"]
        out["finishedAt"] = clock()


def counted(out: dict, rows: DataFrame, **counts: Column) -> DataFrame:
    """The rows, of which the first action also takes these counts (aggregates) into the report: no further pass over them."""
    of = Observation()
    out["observations"].append(of)
    return rows.observe(of, *(c.alias(k) for k, c in counts.items()))


class StreamReports(StreamingQueryListener):
    """Keeps a report of each named query: counts that it observes (``df.observe(name, ...)``) are summed over its batches, and the report is closed, as a
    file under ``path``, when the query ends. ``done`` tells of queries that have ended."""

    def __init__(self, spark: SparkSession, path: str, run: dict, clock=time.time):
        self.spark, self.path, self.run, self.clock = spark, path, run, clock
        self.open: dict[str, dict] = {}
        self.done: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.open[str(event.runId)] = {"schemaVersion": 1, "stage": event.name, "run": self.run, "startedAt": self.clock(), "status": "running", "stats": {"rows": 0, "batches": 0}}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        stats = self.open[str(p.runId)]["stats"]
        stats["batches"] += 1
        stats["rows"] += p.numInputRows
        for row in p.observedMetrics.values():
            for k, v in row.asDict().items():
                stats[k] = stats.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        out = self.open.pop(str(event.runId))
        out |= {"status": "failed" if event.exception else "success", "finishedAt": self.clock()}
        if event.exception:
            out["failure"] = event.errorClassOnException or "unknown"
        put(self.spark, f"{self.path}/{out['stage']}-report.json", json.dumps(out))
        self.done[out["stage"]] = out
