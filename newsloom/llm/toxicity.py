"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words, in lower case, and their beginnings (inflected and compound words share these), hashed to ``BUCKETS``;
a term that stands more than once also gives a term of its own. The machine's score is a weight for each term, and for each pair of
terms the product of their factors, so that two terms can mean together what neither means alone.

It's fitted on at most ``most_labels`` labelled documents, taken by hash of the id: their terms are counted by class, the ``most_terms``
that tell most (by chi-squared) are kept, and weights and factors are learnt by Adam steps from a fixed seed. Of near copies, told by
minimum hashes of their shingles, one is counted, so that a group of copies is one witness. What the driver gets is bounded by the two
parameters. All documents are then scored in whole where they are; nothing shuffles.

Null and empty texts have no terms and get the score of these. Repeated rows are scored each (and alike), null ids stay and are never
learnt from, other columns stay, but those named like the results; labels without a toxic mark aren't learnt from, repeated labels of an
id count as their worst. Without labels, or with labels of one kind, the score is their smoothed rate. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import Scratch, WordHasher, map_arrow, mix, quoted, shingle_set, sliced, tidy

#: Buckets that terms are hashed to, and the mark of a term that stands more than once.
BUCKETS, AGAIN = np.uint64((1 << 22) - 1), np.uint64(0xA5A5A5A5A5A5A5A5)
#: Labelled documents, and terms, that the machine is fitted on.
MOST_LABELS, MOST_TERMS = 20_000, 8192
FACTORS, THRESHOLD = 6, 0.3
#: A term's least chi-squared: by chance, few of a million reach it.
CLEAR = 10.0


#: Every byte to itself if it's part of a word, else to a space.
SPLIT = bytes(b if b >= 0x80 or bytes([b]).isalnum() else 32 for b in range(256))
#: Characters of the beginnings that are terms.
BEGINNINGS = (4, 5, 6, 7)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and code points from U+0080 but white space, in lower case."""
    return (text or "").lower().encode("utf-8", "replace").translate(SPLIT).decode().split()


class Terms:
    """Buckets of words' terms, with a memory of words seen that's emptied when it's full."""

    def __init__(self, keep: np.ndarray | None = None, most: int = 50_000):
        import xxhash

        self.hash, self.known, self.telling, self.most = xxhash.xxh3_64_intdigest, set(), {}, most
        self.place = self.kept = None
        if keep is not None:  # places of the buckets that are kept, and whether a bucket is
            self.place, self.kept = {int(b): k for k, b in enumerate(keep)}, np.zeros(int(BUCKETS) + 1, bool)
            self.kept[keep] = True

    def _learn(self, words: list[str]) -> None:
        """The words' pairs of buckets; if only some are kept, (bucket, place, place if it stands again) of these, places -1 if it's not kept."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        owner, hashes = [np.arange(len(words))], [np.fromiter(map(self.hash, words), np.uint64, len(words))]
        for k in BEGINNINGS:
            longer = np.flatnonzero(size > k)
            owner.append(longer)
            hashes.append(np.fromiter((self.hash(words[i][:k], k) for i in longer.tolist()), np.uint64, len(longer)))  # seeded by length, so no word's own
        owner, h = np.concatenate(owner), np.concatenate(hashes)
        once, again = mix(h) & BUCKETS, mix(h ^ AGAIN) & BUCKETS
        at = np.arange(len(owner)) if self.kept is None else np.flatnonzero(self.kept[once] | self.kept[again])
        for k, a, b in zip(owner[at].tolist(), once[at].tolist(), again[at].tolist(), strict=True):
            self.telling.setdefault(words[k], []).append((a, b) if self.place is None else (a, self.place.get(a, -1), self.place.get(b, -1)))
        self.known.update(words)

    def count(self, text: str | None) -> dict:
        """How often each of the text's terms stands in it; of kept terms only, if not all are."""
        counts = Counter(words_of(text))
        if len(self.known) > self.most:
            self.known.clear()
            self.telling.clear()
        if fresh := counts.keys() - self.known:
            self._learn(list(fresh))
        found: dict[tuple, int] = {}
        for w in counts.keys() & self.telling.keys():
            for t in self.telling[w]:
                found[t] = found.get(t, 0) + counts[w]
        return found

    def buckets(self, text: str | None) -> np.ndarray:
        """All buckets that the text fills, sorted."""
        found = self.count(text)
        return np.unique(np.array([a for a, _ in found] + [b for (_, b), n in found.items() if n > 1], np.uint32))

    def places(self, text: str | None) -> np.ndarray:
        """The places of the kept buckets that the text fills, sorted."""
        found = self.count(text)
        return np.unique(np.array([p for _, p, _ in found if p >= 0] + [q for (_, _, q), n in found.items() if n > 1 and q >= 0], np.int32))


class Machine:
    """Bias, weights and factors, for sets of terms."""

    def __init__(self, terms: np.ndarray, bias: float, factors: int = FACTORS, seed: int = 13):
        self.terms, self.bias = terms, bias
        self.weights = np.zeros(len(terms))
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (len(terms), factors))

    def score(self, places: np.ndarray) -> float:
        v = self.factors[places]
        z = self.bias + self.weights[places].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(z)))))

    def fit(self, sets: list[np.ndarray], toxic: np.ndarray, rounds: int = 30, least_steps: int = 600, batch: int = 256, rate: float = 0.02, ridge: float = 2e-4, seed: int = 7) -> Machine:
        """Adam on the logistic loss, in shuffled batches, of few documents in more rounds; the rate falls to nothing."""
        rng, params = np.random.default_rng(seed), [np.array([self.bias]), self.weights, self.factors]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        sizes, step, per_round = np.array([len(s) for s in sets]), 0, math.ceil(len(sets) / batch)
        rounds = max(rounds, math.ceil(least_steps / per_round))
        steps = rounds * per_round
        for _ in range(rounds):
            order = rng.permutation(len(sets))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                of, at = np.repeat(np.arange(len(rows)), sizes[rows]), np.concatenate([sets[i] for i in rows])
                v = params[2][at]
                total = np.zeros((len(rows), v.shape[1]))
                np.add.at(total, of, v)
                linear = np.bincount(of, params[1][at] - 0.5 * (v**2).sum(axis=1), len(rows))
                z = np.clip(params[0][0] + linear + 0.5 * (total**2).sum(axis=1), -30, 30)
                wrong = (1 / (1 + np.exp(-z)) - toxic[rows]) / len(rows)
                # only terms of the batch move, their ridge with them
                own, place = np.unique(at, return_inverse=True)
                down_w = np.bincount(place, wrong[of], len(own)) + ridge * params[1][own]
                down_v = np.zeros((len(own), v.shape[1]))
                np.add.at(down_v, place, wrong[of][:, None] * (total[of] - v))
                down_v += ridge * params[2][own]
                step += 1
                pace = rate * (1 - (step - 1) / steps)
                for k, (where, down) in enumerate(((np.array([0]), np.array([wrong.sum()])), (own, down_w), (own, down_v))):
                    m, s = first[k], second[k]
                    m[where] = 0.9 * m[where] + 0.1 * down
                    s[where] = 0.999 * s[where] + 0.001 * down**2
                    params[k][where] -= pace * (m[where] / (1 - 0.9**step)) / (np.sqrt(s[where] / (1 - 0.999**step)) + 1e-8)
        self.bias, self.weights, self.factors = float(params[0][0]), params[1], params[2]
        return self


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is of the fold that's never learnt from: crc32 of its id as text. A null id isn't."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def telling(of_toxic: np.ndarray, of_all: np.ndarray, n_toxic: int, n: int, most: int, least: int = 3, clear: float = CLEAR) -> np.ndarray:
    """The buckets of at least ``least`` documents that tell most of the class, by a chi-squared of ``clear`` or more; ties by number."""
    often = np.flatnonzero(of_all >= least)
    a, m = of_toxic[often].astype(float), of_all[often].astype(float)
    expected = m * n_toxic / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (a - expected) ** 2 * n / (expected * (n - n_toxic) * (1 - m / n) + 1e-9)
    best = np.lexsort((often, -chi))[:most]
    return np.sort(often[best[chi[best] >= clear]]).astype(np.uint32)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS, most_terms: int = MOST_TERMS) -> Machine:
    """A machine fitted on at most ``most_labels`` labelled documents outside the held-out fold."""
    usable = F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    one = labels.filter(usable).groupBy(F.col("doc_id").alias("__label")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    chosen = one.orderBy(F.xxhash64("__label"), "__label").limit(most_labels)
    rows = docs.select(F.col(quoted(id_col)).alias("__doc"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__label")).select("text", "toxic")

    def measure(batches):
        import pyarrow as pa

        terms, hasher, seeds = Terms(), WordHasher(), mix(np.arange(1, 5, dtype=np.uint64))
        for batch in sliced(batches, 0):
            texts = batch.column(0).to_pylist()
            packs = [terms.buckets(t).tobytes() for t in texts]
            sets = [shingle_set((t or "").encode(), hasher) for t in texts]
            mins = [mix(s[:, None] ^ seeds).min(0).view(np.int64).tolist() if len(s) else [0] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(packs, pa.binary()), pa.array(mins, pa.list_(pa.int64())), batch.column(1)], names=["packs", "mins", "toxic"])

    scratch = Scratch(docs.sparkSession, "toxic-labels")
    measured = scratch.write(rows.mapInArrow(tidy(measure), "packs binary, mins array<bigint>, toxic int"), "measured")

    def witnesses():
        """Buckets and class, of near copies the first; in the same order each time."""
        seen: set[int] = set()
        for r in measured.orderBy("mins", "toxic", F.xxhash64("packs")).toLocalIterator():
            mins = set(r.mins)
            if not seen & mins:
                yield np.frombuffer(bytes(r.packs), np.uint32), int(r.toxic)
            seen |= mins

    counts, n = np.zeros((2, int(BUCKETS) + 1), np.int32), [0, 0]
    for buckets, toxic in witnesses():
        counts[toxic][buckets] += 1
        n[toxic] += 1
    bias = math.log((n[1] + 0.5) / (n[0] + 0.5))
    keep = telling(counts[1], counts[0] + counts[1], n[1], max(1, sum(n)), most_terms) if min(n) else np.empty(0, np.uint32)
    del counts
    sets, classes = [], []
    for buckets, toxic in witnesses() if len(keep) else ():
        at = np.minimum(np.searchsorted(keep, buckets), len(keep) - 1)
        sets.append(at[keep[at] == buckets].astype(np.int32))
        classes.append(toxic)
    scratch.drop("measured")
    machine = Machine(keep, bias)
    return machine.fit(sets, np.array(classes, float)) if sets else machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """The rows with the machine's score; without the text if it isn't kept."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by most_terms
    names = docs.columns
    at = names.index(text_col)
    kept = [i for i, c in enumerate(names) if c.lower() != out.lower() and (keep_text or i != at)]
    schema = T.StructType([*(docs.schema[i] for i in kept), T.StructField(out, T.DoubleType(), False)])

    def run(batches):
        import pyarrow as pa

        own = model.value
        terms = Terms(own.terms, 400_000)
        for batch in sliced(batches, at):
            values = [own.score(terms.places(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(values, pa.float64())], names=[*(names[i] for i in kept), out])

    return map_arrow(docs, run, schema)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, whether it's of the held-out fold, and the verdict."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    out = score(docs, learn(docs, labels), keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
