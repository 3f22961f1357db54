"""Whitening, the prefix trie and the toxicity machine against plain versions, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from newsloom.llm import prefix_trie, toxicity, whitening
from newsloom.llm.common import Scratch

# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, n int")


def plain_whitening(rows):
    """n, S and the covariance as fractions."""
    ints = [tuple(int(np.floor(256 * c)) for c in v) for v in rows]
    fit = sorted(set(ints))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[sum((x[i] - Fraction(s[i], n)) * (x[j] - Fraction(s[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    return ints, n, s, cov


@pytest.mark.parametrize("shift", [0.0, 1e6, 3e15, 2.0**60])
def test_whitening_like_fractions(spark, shift):
    rng = random.Random(11)
    rows = [[shift + rng.gauss(0, 1) * (2.0**12 if shift > 1e12 else 1) * (k + 1) for k in range(5)] for _ in range(60)]
    rows += rows[:7]
    got = {(r.id, r.component): r for r in whitening.whiten(vectors(spark, list(enumerate(rows))).repartition(5)).collect()}
    clipped = [[min(max(c, -(2.0**55)), 2.0**55 - 8) for c in v] for v in rows]
    ints, n, s, cov = plain_whitening(clipped)
    assert len(got) == 4 * len(rows)
    if shift == 2.0**60:  # beyond 64 bits: every entry is the largest there is
        assert all(r.n == 1 and r.whitened is None and r.explained is None and r.deviation == "0" for r in got.values())
        return
    values, comps = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    for k in range(4):
        comp = comps[:, -1 - k]
        want = np.array([float(sum(Fraction(float(comp[i])) * (x[i] - Fraction(s[i], n)) for i in range(5))) for x in ints]) / np.sqrt(values[-1 - k])
        have = np.array([got[i, k + 1].whitened for i in range(len(rows))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert abs(got[0, k + 1].explained - values[-1 - k] / values.sum()) < 1e-9
    for i, x in enumerate(ints):
        assert int(got[i, 1].deviation) == sum((n * x[j] - s[j]) ** 2 for j in range(5)) and got[i, 1].n == n
    assert max(r.identity_error for r in got.values()) < 1e-6


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, []), (6, [0.5, -0.0]), (7, [0.25, 1.0]), (7, [0.25, 1.0]), (None, [0.5, 0.0]), (8, [3.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 4.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted((r.id or 0, r.component) for r in got) == [(0, 1), (0, 2), (6, 1), (6, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), *((i, k) for i in (9, 10) for k in (1, 2, 3))]
    by = defaultdict(list)
    for r in got:
        by[r.id, r.component].append(r)
    assert by[7, 1][0] == by[7, 1][1] and by[6, 1][0].whitened == by[None, 1][0].whitened  # floor(-0.0) is 0
    assert by[6, 1][0].n == 2 and abs(abs(by[6, 1][0].whitened) - 1) < 1e-12 and by[6, 2][0].whitened is None and by[6, 2][0].explained == 0
    assert by[8, 1][0].n == 1 and by[8, 1][0].whitened is None and by[8, 1][0].explained is None
    assert whitening.whiten(vectors(spark, rows).limit(0)).count() == 0


def test_limbs_sum_to_any_number():
    rng = random.Random(3)
    for v in [0, 1, -1, (1 << 32) - 1, -(1 << 32), *(rng.randrange(-(1 << 150), 1 << 150) for _ in range(50))]:
        assert sum(x << (32 * k) for k, x in enumerate(whitening.limbs(v))) == v


# the prefix trie


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda m, p: hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(m, p)) for p, m in members.items())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, depth int")


def plain_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("block", "text_bytes", "hub"), [(64, 1 << 16, 1000), (2, 5, 1), (3, 1, 2)])
def test_trie_like_plain_version(spark, monkeypatch, block, text_bytes, hub):
    monkeypatch.setattr(prefix_trie, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(prefix_trie, "HUB", hub)
    rng = random.Random(12)
    rows = []
    for c in list(range(-12, 40)) + [100, 103]:
        if c in (5, 10):
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9, 14, 23])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "é", "", None])))
    rows += [(20, None, "system", "first"), (20, None, "system", "first"), (20, 3, "b", "tie"), (20, 3, "a", "tie"), (None, 0, "user", "nobody's")]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 230) for t in range(12)]  # copies
    rows = [(c, t, r, x) for c, t, r, x in rows]
    rng.shuffle(rows)
    df = conversations(spark, rows).repartition(3)
    got = prefix_trie.trie(prefix_trie.borrowed(prefix_trie.turns(df)), Scratch(spark, "t"), block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_trie(rows), key=key)


def test_trie_of_a_long_conversation(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(1500)] + [(6, t, "user", f"t{t}") for t in range(700)] + [(5000, 0, "user", "z" * 3_000_000)]
    got = prefix_trie.trie(prefix_trie.borrowed(prefix_trie.turns(conversations(spark, rows))), Scratch(spark, "t"), 8)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_trie(rows), key=key)


def test_empty_trie(spark):
    empty = conversations(spark, [(1, 1, "", "")]).limit(0)
    assert prefix_trie.trie(prefix_trie.borrowed(prefix_trie.turns(empty)), Scratch(spark, "t")).count() == 0


# toxicity

VOCABULARY = [f"{a}{b}{c}" for a in ("ra", "mo", "ti", "su") for b in ("len", "gor", "vi", "pat") for c in ("", "s", "ing", "do", "ker")]


def plain_score(machine, text):
    """Weights and pairwise products, one by one."""
    import xxhash

    terms = defaultdict(int)
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F\s]+", text.lower()):
        terms[w, 0] += 1
        for k in (4, 5, 6, 7):
            if len(w) > k:
                terms[w[:k], k] += 1
    hashed = lambda t, mark=0: int((toxicity.mix(np.array([xxhash.xxh3_64_intdigest(*t)], np.uint64) ^ np.uint64(mark)) & toxicity.BUCKETS)[0])
    buckets = {hashed(t) for t in terms} | {hashed(t, int(toxicity.AGAIN)) for t, n in terms.items() if n > 1}
    at = [k for k, b in enumerate(machine.terms.tolist()) if b in buckets]
    z = machine.bias + sum(machine.weights[k] for k in at) + sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(at) for b in at[i + 1 :])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@pytest.fixture(scope="module")
def planted(spark):
    """Toxic: an insult together with a group's name. Either alone is clean."""
    rng = random.Random(13)
    rows = []
    for i in range(1600):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(15, 60))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        if insult:
            words[rng.randrange(len(words))] = rng.choice(["zounder", "Zounders", "ZOUNDING"])
        if group:
            words[rng.randrange(len(words))] = rng.choice(["quorlish", "quorland"])
        text = " ".join(words)
        rows.append((i, text, int("zound" in text.lower() and "quorl" in text)))
    rows.append((1600, rows[3][1], rows[3][2]))
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(2000, None, "x", 0.5), (2001, "", "x", 0.5), (None, rows[0][1], "x", 0.5), (2002, "zounder quorlish " * 200_000, "x", 0.5)], "doc_id long, text string, c0 string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (2000, 1, None), (1, 1, rows[1][2])], "doc_id long, quality int, toxic int")
    return docs, labels, {i: (t, y) for i, t, y in rows}


def test_machine_learns_pairs(spark, planted):
    docs, labels, rows = planted
    machine = toxicity.learn(docs, labels)
    out = toxicity.score(docs, machine)
    assert out.columns == ["doc_id", "text", "c0", "score"]
    got = {r.doc_id: r.score for r in out.withColumn("id", toxicity.held_out(out.doc_id)).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {r.doc_id for r in out.filter(toxicity.held_out(out.doc_id)).collect()} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [i for i in held if (got[i] >= toxicity.THRESHOLD) != rows[i][1]]
    assert len(held) > 300 and len(wrong) < 0.03 * len(held)
    assert got[1600] == got[3] and got[2000] == got[2001] < toxicity.THRESHOLD and got[None] == got[0] and got[2002] >= toxicity.THRESHOLD
    for i in held[:40]:
        assert abs(got[i] - plain_score(machine, rows[i][0])) < 1e-9
    # additive weights alone can't tell: the pairs do
    pairs = machine.factors.copy()
    assert float(np.abs(pairs).max()) > 0.3


def test_machine_is_the_same_each_time(spark, planted):
    docs, labels, _ = planted
    a, b = toxicity.learn(docs.repartition(3), labels, most_labels=300), toxicity.learn(docs.repartition(7), labels.repartition(2), most_labels=300)
    assert (a.terms == b.terms).all() and (a.weights == b.weights).all() and (a.factors == b.factors).all() and a.bias == b.bias


def test_machine_ignores_the_held_out_fold(spark, planted):
    docs, labels, _ = planted
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    a, b = toxicity.learn(docs, labels, most_labels=200), toxicity.learn(docs, flipped, most_labels=200)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_machine_without_labels(spark, planted):
    docs, labels, _ = planted
    assert toxicity.score(docs.limit(0), toxicity.learn(docs, labels.limit(0))).count() == 0
    assert {r.score for r in toxicity.score(docs.limit(5), toxicity.learn(docs, labels.limit(0))).collect()} == {0.5}
    clean = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert {r.score < 0.01 for r in toxicity.score(docs.limit(5), clean).collect()} == {True}
    assert toxicity.learn(docs.limit(0), labels).weights.size == 0
