"""Quality classifier: hierarchical empirical Bayes over document, host and path.

1. Evidence. From a bounded sample of labelled documents (``most_labels``, taken by hash of the id) the driver fits two
   small models: logistic regression on measures of a text's form for low quality, and a lexicon of log-likelihood
   ratios for toxic words and word beginnings (inflected words share these). Of near copies, told by minimum hashes of
   their shingles, one is counted, so that a group is one witness and its rare words aren't taken for toxic.
2. Sites. Over all documents the chance of being bad is summed by host and path. A host's rate is shrunk to the
   global rate, a path's to its host's, by prior weights estimated from the spread between groups (moments).
3. Verdict. A document's evidence is combined with its path's rate in place of the global prior.

Documents are scored once and written with their evidence to the shared folder; the sums and the verdicts read that. Nothing but
the sums by host and path shuffles. Null or empty text has neutral evidence. Null hosts or paths are groups of their own. Without
labels, or with labels of one kind, evidence is neutral and all stay. Repeated rows are judged each (and alike); a document
exactly at the threshold goes; whole texts are scored, however long; empty tables give empty results; other columns, of any name, stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import Scratch, WordHasher, map_arrow, mix, quoted, shingle_set, sliced, tidy
from newsloom.llm.decontaminate import words_of

#: Measures of a text's form, in this order.
FORM = ("upper", "symbols", "repeated", "commonest", "word_length", "log_words", "bars")
SYMBOLS = set("!#$%&*|<>{}[]=~^\\")
MOST_LABELS = 10_000
#: A weak word's odds, as a share of the odds that the prior holds against toxic.
WEAK = 0.65
#: Sites (pairs of host and path) that are broadcast; more are joined by a shuffle.
MOST_SITES = 200_000


def form(text: str) -> list[float]:
    words, n = text.split(), max(1, len(text))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    m = max(1, len(words))
    upper = sum(map(str.isupper, words)) / m
    symbols = sum(text.count(c) for c in SYMBOLS) / n
    return [upper, symbols, 1 - len(counts) / m, max(counts.values(), default=0) / m, min(40.0, (n - len(words)) / m) / 10, math.log1p(m) / 10, text.count("|") / m]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights with the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(word: bytes) -> list[bytes]:
    """A word, and its beginnings of 4 to 7 bytes."""
    return [word, *(word[:k] + b"*" for k in range(4, 8) if len(word) > k)]


class Evidence:
    """What is known about badness from a text alone, given labelled texts' measures, feature hashes and minimum hashes.

    A feature is toxic evidence if at least ``least`` toxic witnesses and 1 in 100 of them have it, at odds of ``ratio`` (log).
    With fewer witnesses (``weak_least``) or lower odds (``weak_ratio``) it's weak: two such words outweigh the prior, one doesn't.
    """

    def __init__(self, forms: np.ndarray, words: list[np.ndarray], mins: list[tuple], low: np.ndarray, toxic: np.ndarray, least: int = 6, ratio: float = 4.5, weak_least: int = 3, weak_ratio: float = 3.4):
        self.mean, self.scale = (forms.mean(0), forms.std(0) + 1e-6) if len(forms) else (0.0, 1.0)
        self.weights = fit_logistic((forms - self.mean) / self.scale, low) if 0 < low.sum() < len(low) else None
        self.toxic: dict[int, float] = {}
        self.toxic_prior = math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)) if len(toxic) else 0.0
        self.memo: dict[bytes, tuple] = {}
        seen, kept = set(), []
        for i, m in enumerate(mins):
            if not seen & set(m):
                kept.append(i)
            seen.update(m)
        bad = [words[i] for i in kept if toxic[i]]
        good = [words[i] for i in kept if not toxic[i]]
        if bad and good:
            word, n_bad = np.unique(np.concatenate(bad), return_counts=True)
            often = n_bad >= max(weak_least, len(bad) / 100)
            word, n_bad = word[often], n_bad[often]
            n_good = np.zeros(len(word), np.int64)
            for w in good:
                n_good += np.isin(word, w, assume_unique=True)
            odds = np.log((n_bad + 0.5) / (len(bad) + 1)) - np.log((n_good + 0.5) / (len(good) + 1))
            weak = WEAK * max(0.0, -self.toxic_prior)
            odds = np.where((odds >= ratio) & (n_bad >= least), odds, np.where(odds >= weak_ratio, weak, 0.0))
            self.toxic = {int(w): float(o) for w, o in zip(word[odds > 0], odds[odds > 0], strict=True)}

    def odds(self, word: bytes, hasher: WordHasher) -> float:
        """The strongest evidence among a word's features."""
        if word not in self.memo:
            if len(self.memo) > 400_000:
                self.memo.clear()
            self.memo[word] = max(self.toxic.get(hasher.hash(f), 0.0) for f in features(word))
        return self.memo[word]

    def bad(self, text: str | None, hasher: WordHasher) -> float:
        """The chance that a text is of low quality or toxic, under the labels' own rates."""
        if not text:
            return 0.0 if self.weights is None and not self.toxic else 1 / (1 + math.exp(-self.toxic_prior))
        low = 0.0
        if self.weights is not None:
            z = float((np.array(form(text)) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1])
            low = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
        toxic = 0.0
        if self.toxic:
            found = sum(self.odds(w, hasher) for w in set(words_of(text.encode())))
            z = self.toxic_prior + (found or -3.0)
            toxic = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
        return 1 - (1 - low) * (1 - toxic)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_labels: int) -> Evidence:
    """Fits on at most ``most_labels`` labelled documents; repeated labels of an id count as their worst."""
    one = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id__")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("__id__"), "__id__").limit(most_labels)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id__"))
    rows = rows.select("text", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def measure(batches):
        import pyarrow as pa

        hasher = WordHasher()
        seeds = mix(np.arange(1, 5, dtype=np.uint64))
        for batch in sliced(batches, 0):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            packs = [np.unique(hasher([f for w in set(words_of(t.encode())) for f in features(w)])).tobytes() for t in texts]
            sets = [shingle_set(t.encode(), hasher) for t in texts]
            mins = [mix(s[:, None] ^ seeds).min(0).view(np.int64).tolist() if len(s) else [0] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([form(t) for t in texts], pa.list_(pa.float64())), pa.array(packs, pa.binary()), pa.array(mins, pa.list_(pa.int64())), batch.column(1), batch.column(2)], names=["form", "words", "mins", "quality", "toxic"])

    got = rows.mapInArrow(tidy(measure), f"form array<double>, words binary, mins array<bigint>, quality {rows.schema['quality'].dataType.simpleString()}, toxic {rows.schema['toxic'].dataType.simpleString()}")
    # written by all executors at once; an iterator over the scan itself would run a job for each of its partitions, one by one
    scratch = Scratch(docs.sparkSession, "quality-labels")
    got = scratch.write(got, "measured")
    forms, words, mins, low, toxic = [], [], [], [], []
    for r in got.toLocalIterator():
        forms.append(r[0]), words.append(np.frombuffer(bytes(r[1]), np.uint64)), mins.append(tuple(r[2])), low.append(int(r[3] == 0)), toxic.append(int(r[4] == 1))
    scratch.drop("measured")
    return Evidence(np.array(forms, float).reshape(-1, len(FORM)), words, mins, np.array(low, int), np.array(toxic, int))


def scored(spark: SparkSession, docs: DataFrame, evidence: Evidence, text_col: str, keep_text: bool = True) -> DataFrame:
    """The rows with ``__bad__``, without the text if it isn't kept."""
    model = spark.sparkContext.broadcast(evidence)  # a few weights and words
    names = docs.columns
    kept = [i for i, c in enumerate(names) if keep_text or c != text_col]
    schema = T.StructType([*(docs.schema[i] for i in kept), T.StructField("__bad__", T.DoubleType(), False)])

    def run(batches):
        import pyarrow as pa

        own, hasher, at = model.value, WordHasher(), names.index(text_col)
        for batch in sliced(batches, at):
            bad = [own.bad(t, hasher) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(bad, pa.float64())], names=[*(names[i] for i in kept), "__bad__"])

    return map_arrow(docs, run, schema)


def prior_weight(groups: DataFrame, rate: str, n: str, up: str) -> float:
    """The weight, in documents, of the level above: binomial variance over the spread between groups beyond chance."""
    r = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(rate) - F.col(up), 2)).alias("spread"), F.sum(F.col(up) * (1 - F.col(up))).alias("chance"), F.sum(F.col(n) * F.col(up) * (1 - F.col(up))).alias("within"), F.sum(n).alias("n")
    ).first()
    if not r["n"] or not r["within"]:
        return 1e6
    between = max(0.0, r["spread"] - r["chance"]) / r["n"]
    return min(1e6, max(1.0, (r["within"] / r["n"]) / between)) if between > 0 else 1e6


def site_rates(sites: DataFrame) -> tuple[DataFrame, float]:
    """``__host__``, ``__path__``, ``__rate__`` (the path's posterior rate of bad documents) and the global rate, from ``site_sums``."""
    total = sites.agg(F.sum("bad"), F.sum("n")).first()
    rate = min(1 - 1e-6, max(1e-6, (total[0] or 0.0) / total[1])) if total[1] else 0.5
    hosts = sites.groupBy("__host__").agg(F.sum("bad").alias("h_bad"), F.sum("n").alias("h_n")).withColumn("up", F.lit(rate))
    k = prior_weight(hosts.withColumn("r", F.col("h_bad") / F.col("h_n")), "r", "h_n", "up")
    hosts = hosts.select("__host__", ((k * F.col("up") + F.col("h_bad")) / (k + F.col("h_n"))).alias("h_rate"))
    sites = sites.alias("s").join(hosts.alias("h"), F.expr("s.__host__ <=> h.__host__")).select("s.*", "h_rate")
    k = prior_weight(sites.withColumn("r", F.col("bad") / F.col("n")), "r", "n", "h_rate")
    return sites.select("__host__", "__path__", ((k * F.col("h_rate") + F.col("bad")) / (k + F.col("n"))).alias("__rate__")), rate


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: tuple[str, ...] = ("lang",), threshold: float = 0.5, most_labels: int = MOST_LABELS, most_sites: int = MOST_SITES, keep_text: bool = True) -> DataFrame:
    """The rows with ``evidence``, ``site_rate``, ``p_bad`` and ``keep`` (columns of these names are replaced); without the text if it isn't kept."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("evidence", "site_rate", "p_bad", "keep")]
    own = {c: f"c{i}" for i, c in enumerate(names)}  # numbered, as columns may have any names
    docs = docs.select(*map(quoted, names)).toDF(*own.values())
    id_col, text_col, host, path = own[id_col], own[text_col], own[host], [own[c] for c in path]
    evidence = fit(docs, labels, id_col, text_col, most_labels)
    scratch = Scratch(spark, "quality")
    rows = scratch.write(scored(spark, docs, evidence, text_col, keep_text), "scored")
    sites, rate = site_rates(scratch.write(site_sums(rows, host, path), "sites"))
    sites = scratch.write(sites, "rates")
    scratch.drop("sites")
    if sites.count() <= most_sites:
        sites = F.broadcast(sites)
    where = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in path))
    rows = rows.join(sites, F.col(host).eqNullSafe(F.col("__host__")) & (where == F.col("__path__")), "left")
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    z = logit(F.col("__bad__")) - math.log(rate / (1 - rate)) + logit(F.coalesce("__rate__", F.lit(rate)))
    p = 1 / (1 + F.exp(-z))
    if not evidence.toxic and evidence.weights is None:
        p = F.lit(0.0)
    return rows.select(*(F.col(k).alias(c) for c, k in own.items() if keep_text or k != text_col), F.col("__bad__").alias("evidence"), F.coalesce("__rate__", F.lit(rate)).alias("site_rate"), p.alias("p_bad"), (p < threshold).alias("keep"))


def site_sums(docs: DataFrame, host: str, path: list[str]) -> DataFrame:
    where = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in path))
    return docs.groupBy(F.col(host).alias("__host__"), where.alias("__path__")).agg(F.sum("__bad__").alias("bad"), F.count("*").alias("n"))


def op7_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with what decided it."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs.select("doc_id", "text", "source", "lang"), labels, keep_text=False)
    return out.filter("keep").select("doc_id", "source", "lang", "evidence", "site_rate", "p_bad")
