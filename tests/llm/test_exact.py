"""Operators against plain versions, round trips, and edge cases: nulls, empty tables, ties, repeated rows, clashing names."""

import hashlib
import itertools
import json
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import bpe, chat, decontaminate, fingerprints, jaccard_join, line_dedup, quality, sharding, token_counts, url_filters
from newsloom.llm.common import Scratch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"w{i}" for i in range(60)]


def docs(spark, texts, ids=None, extra=False):
    ids = ids or range(len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    return df.withColumns({"n_lines": F.lit("x"), "ids": F.lit("x"), "keep": F.lit(1)}) if extra else df


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, words, p):
    return [rng.choice(VOCABULARY) if rng.random() < p else w for w in words]


# URL filters


def test_url_parts_and_stated_rules(spark):
    cases = [("https://A.Example.org/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"), ("http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"), ("http://x.org", "x.org", "", None, "allow"), ("http://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"), ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"), ("http://y.org/?a://b", "y.org", "/", "org/", "allow"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://notcom/fr/", "notcom", "/fr/", None, "allow")]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, rule string")
    none = spark.createDataFrame([], url_filters.RULE)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, none).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert url_filters.judge(pages.limit(0), none).count() == 0


def plain_rules(tokens, bad, least, confidence):
    """All token combinations of the baskets that are frequent together with the bad class, without those that a part makes needless."""
    support = Counter()
    for t in tokens:
        for k in range(1, len(t) + 1):
            support.update(itertools.combinations(sorted(t), k))
    of_bad = Counter()
    for t, b in zip(tokens, bad, strict=True):
        for k in range(1, len(t) + 1) if b else ():
            of_bad.update(itertools.combinations(sorted(t), k))
    rates = {s: n / support[s] for s, n in of_bad.items() if n >= least}
    return {s: r for s, r in rates.items() if r >= confidence and not any(rates.get(p, 0) >= r for k in range(1, len(s)) for p in itertools.combinations(s, k))}


@pytest.mark.parametrize("common_rows", [1000, 2])
def test_mined_rules_like_plain_enumeration(spark, monkeypatch, common_rows):
    monkeypatch.setattr(url_filters, "COMMON_ROWS", common_rows)
    monkeypatch.setattr(url_filters, "MOST_COMMON", 1_000_000)
    rng = random.Random(14)
    urls = [f"http://{rng.choice(['pills', 'news', 'blog'])}.{rng.choice(['a', 'b'])}.net/{rng.choice(['buy', 'read', 'x/y'])}/{i % 60}" + rng.choice(["", "?q=1", "#top"]) for i in range(300)]
    urls += urls[:40] * 2 + [None, "no url"]
    worse = lambda u: "pills" in (u or "") and ("buy" in u or "?q" in u) or ".b." in (u or "") and "#" in u
    flags = [int(worse(u) if rng.random() < 0.9 else rng.random() < 0.3) for u in urls]
    pages = spark.createDataFrame([(i, u, "kept", "x") for i, u in enumerate(urls)], "page_id long, url string, token string, mined_rule string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in enumerate(flags) if i % 2 == 0 or i > 300], "doc_id long, quality int, toxic int")
    rules = url_filters.mine(pages, labels, Scratch(spark, "t"), min_count=4)
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", url_filters.tokens_of(F.col("url")).alias("t")).collect()}
    baskets = {(urls[i], flags[i]): tokens[i] for i in range(len(urls)) if (i % 2 == 0 or i > 300) and tokens[i]}
    want = plain_rules(list(baskets.values()), [b for _, b in baskets], max(4, 0.001 * len(baskets)), 0.6)
    # an item of a mined rule stands for any of its tokens
    got = {tuple(sorted(p)): r.confidence for r in rules.collect() for p in itertools.product(*(s.tokens for s in r.slots)) if len(set(p)) == len(p)}
    assert want and got.keys() == want.keys() and all(abs(got[s] - r) < 1e-9 for s, r in want.items())
    judged = url_filters.judge(pages, rules, by_hand={})
    assert judged.columns == ["page_id", "url", "token", "host", "path", "rule", "verdict", "mined_rule"]
    assert {r.page_id for r in judged.filter("verdict = 'block'").collect()} == {i for i, t in tokens.items() if any(set(s) <= t for s in want)}
    assert judged.count() == len(urls)
    assert url_filters.mine(pages, labels.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("most_items", [0, 3])
def test_longer_baskets_are_mined_like_plain_enumeration(spark, monkeypatch, most_items):
    monkeypatch.setattr(url_filters, "MOST_ITEMS", most_items)
    test_mined_rules_like_plain_enumeration(spark, monkeypatch, 1000)


def test_rules_on_the_least_telling_items(spark):
    """Bad are ax with bx and ay with by, which tell nothing each; some twenty of forty keys of the same baskets tell a little."""
    rng = random.Random(9)
    urls, flags = [], []
    for i in range(400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        keys = [f"k{j}" for j in range(40) if rng.random() < (0.6 if a == b else 0.5)]
        urls.append(f"http://h.net/{'ay' if a else 'ax'}/{'by' if b else 'bx'}/{i}?" + "&".join(f"{k}={i}" for k in keys))
        flags.append(a == b)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not f), 0) for i, f in enumerate(flags)], "doc_id long, quality int, toxic int")
    rules = url_filters.mine(pages, labels, Scratch(spark, "t"), min_count=50).collect()
    sure = {frozenset(r["items"]) for r in rules if r.confidence == 1}
    assert sure == {frozenset(("path:ax", "path:bx")), frozenset(("path:ay", "path:by"))}
    judged = url_filters.judge(pages, spark.createDataFrame([r for r in rules if r.confidence == 1], url_filters.RULE), by_hand={})
    assert {r.page_id for r in judged.filter("verdict = 'block'").collect()} == {i for i, f in enumerate(flags) if f}


def test_rows_of_hot_and_missing_urls_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "COMMON_ROWS", 50)
    urls = ["http://hot.net/buy"] * 400 + ["http://cold.net/hot"] * 300 + [None] * 300 + ["no url"] * 200 + [f"http://a{i}.net/{i}" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(8)
    rules = spark.createDataFrame([(1, ["path:buy"], 0.9, 0.5, [(400, ["path:buy"])])], url_filters.RULE)
    keys = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        judged = url_filters.judge(pages, rules, by_hand={})
        sizes = [r["count"] for r in judged.groupBy(F.spark_partition_id()).count().collect()]
        got = {r.page_id: r.verdict for r in judged.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: "block" if u == "http://hot.net/buy" else "allow" for i, u in enumerate(urls)}
    assert max(sizes) <= 1.5 * len(urls) / 8


def test_tokens_of_any_depth_make_rules(spark):
    """A part past the sixth tells, and is matched."""
    rng = random.Random(5)
    urls = [f"http://x{i % 7}.net/" + "/".join(f"d{j}" for j in range(9)) + ("/junk" if i % 3 == 0 else "/fine") + f"/{i}.html" for i in range(240)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240) if rng.random() < 0.7], "doc_id long, quality int, toxic int")
    judged = url_filters.judge(pages, url_filters.mine(pages, labels, Scratch(spark, "t")), by_hand={})
    assert {r.page_id for r in judged.filter("verdict = 'block'").collect()} == {i for i in range(240) if i % 3 == 0}


def test_mining_is_bounded(spark):
    deep = "http://a.b.c.d.e.f.g.com/" + "/".join(f"p{k}" for k in range(25)) + "?" + "&".join(f"k{k}=1" for k in range(20))
    urls = [deep] * 100 + [f"{deep}&x={k}#f" for k in range(30)] + [f"http://m.net/{'/'.join(f'd{j}' for j in range(1 + k % 12))}/{k}.html" for k in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i < 130)) for i in range(len(urls))], "doc_id long, quality int, toxic int")
    began = time.time()
    rules = url_filters.mine(pages, labels, Scratch(spark, "t"))
    judged = url_filters.judge(pages, rules, by_hand={})
    assert {r.page_id for r in judged.filter("verdict = 'block'").collect()} >= set(range(130)) and time.time() - began < 60


# decontamination


def plain_hits(docs_, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    out = {}
    for d, t in docs_:
        w, hit, found = words(t), set(), set()
        for i, b in items:
            v = words(b)
            for k in range(max(1, len(v) - width + 1)) if v and i is not None else ():
                x = v[k : k + width]
                for s in range(len(w) - len(x) + 1):
                    if w[s : s + len(x)] == x:
                        hit |= set(range(s, s + len(x)))
                        found.add(i)
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_decontamination_like_a_plain_scan(spark, block):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("ab") for _ in range(n))) for i, n in enumerate([3, 5, 6, 9, 0])] + [(7, "É ñ. X-1"), (8, None), (9, "é ñ")]
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 2, 40, 300)] + [None, "", "é, ñ x É ñ X 1!", "a b A.B a"]
    found = decontaminate.search(decontaminate.build_index(docs(spark, texts)), spark.createDataFrame(items, "item_id long, text string"), width=4, block_words=block)
    got = {r.doc: (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found.collect()}
    assert got == plain_hits(enumerate(texts), items, 4)


@pytest.mark.parametrize(("block_words", "scan_blocks"), [(1_000_000, 8), (1, 8), (1, 1), (2, 2)])
def test_rows_in_are_rows_out_for_any_blocks(spark, monkeypatch, block_words, scan_blocks):
    """Repeated and null ids, in segments of equal shape, stay rows of their own."""
    monkeypatch.setattr(decontaminate, "SCAN_BLOCKS", scan_blocks)
    rows = [(7, "a b c"), (8, None), (7, "a b c"), (8, None), (7, "x y z"), (7, "a b c"), (None, "a b x y"), (None, "a b x y"), (9, "c")]
    items = spark.createDataFrame([(1, "a b"), (2, "x y"), (3, "b c"), (1, "x y"), (4, "q")], "item_id long, text string")
    for parts in (1, 4, 9):
        index = Scratch(spark, "t").write(decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)), "segments")
        found = decontaminate.search(index, items, width=2, block_words=block_words).collect()
        got = sorted((str(r.doc), r.n_words, tuple(tuple(s) for s in r.spans), tuple(r["items"])) for r in found)
        abc, xyz, both = (3, ((0, 3),), (1, 3)), (3, ((0, 2),), (1, 2)), (4, ((0, 4),), (1, 2))  # spans that touch are one
        assert got == sorted([("7", *abc)] * 3 + [("7", *xyz)] + [("8", 0, (), ())] * 2 + [("9", 1, (), ())] + [("None", *both)] * 2)
        assert len({r.number for r in index.collect()}) == index.count()


def test_proximity(spark):
    index = decontaminate.build_index(docs(spark, ["a x b y c", "a b c", "c b a", "a x x x b c", None]))
    got = decontaminate.proximity(index, spark.createDataFrame([(1, "a b c")], "item_id long, text string"), slop=2)
    assert {(r.doc, r.start, r.end) for r in got.collect()} == {(0, 0, 5), (1, 0, 3)}


def plain_near(texts, items, width, slop):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    out = set()
    for d, t in enumerate(texts):
        w = words(t)
        for i, b in items:
            v = words(b)
            for k in range(max(1, len(v) - width + 1)) if v else ():
                x = v[k : k + width]
                for s in (s for s in range(len(w)) if w[s] == x[0]):
                    at = s
                    for term in x[1:]:
                        at = next((j for j in range(at + 1, len(w)) if w[j] == term), None)
                        if at is None:
                            break
                    if at is not None and at - s <= len(x) - 1 + slop:
                        out.add((d, i, s, at + 1))
    return out


@pytest.mark.parametrize("segment_words", [decontaminate.SEGMENT_WORDS, 7])
def test_searches_over_any_segments(spark, monkeypatch, segment_words):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", segment_words)
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in (0, 1, 9, 40, 80)] + [None, "a", "b b b"]
    items = [(i, " ".join(rng.choice("abcde") for _ in range(n))) for i, n in enumerate([1, 2, 4, 7])]
    tests = spark.createDataFrame(items + [(None, "a b"), (9, "")], "item_id long, text string")
    for slop in (0, 3):
        got = decontaminate.proximity(decontaminate.build_index(docs(spark, texts)), tests, slop=slop, width=4)
        assert {tuple(r) for r in got.collect()} == plain_near(texts, items, 4, slop)
    found = decontaminate.search(decontaminate.build_index(docs(spark, texts)), tests, width=4).collect()
    assert {r.doc: (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found} == plain_hits(enumerate(texts), items, 4)


def test_phrases_do_not_cross_documents_and_tables_may_be_empty(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r["items"] for r in decontaminate.flag(docs(spark, ["x a", "b y"]).coalesce(1), items).collect()] == [[], []]
    assert decontaminate.flag(docs(spark, ["a b"]), items.limit(0)).first()["items"] == []
    assert decontaminate.flag(docs(spark, ["a"]).limit(0), items).count() == 0


# fingerprints


def spark_hash(values):
    """xxHash64 as Spark chains it over columns: strings as UTF-8, numbers of 4 bytes; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64(v.encode() if isinstance(v, str) else int(v).to_bytes(4, "little"), seed=h).intdigest()
    return h


def plain_signature(text):
    words = [w for w in re.split(r"[ \t\n\x0B\f\r]+", (text or "").lower()) if w]
    least = {}
    for k in range(max(1, len(words) - 4)):
        h = spark_hash(words[k : k + 5])
        at, value = ((h >> 56) + 128) % 256, h & ((1 << 56) - 1)
        least[at] = min(value, least.get(at, value))
    out = []
    for i in range(256):
        tries = [i, *(hashlib.blake2b(b"%d %d" % (i, t), digest_size=1).digest()[0] for t in range(fingerprints.PROBES))]
        at = next((t for t in tries if t in least), None)
        if at is None:
            signed = lambda h: h - (1 << 64) if h >> 63 else h
            at = min((signed(spark_hash([i, j])) & ~255 | j for j in least)) & 255
        out.append(least[at] & 255)
    return bytes(out)


def plain_likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 256) / (1 - 1 / 256))


def test_fingerprints(spark):
    rng = random.Random(2)
    base = prose(rng, 400)
    texts = [" ".join(base), " ".join(edited(rng, base, 0.02)), " ".join(base), "a b", "A  b", "", None, " ".join(prose(rng, 30)), "é\x0b x  Y\t" * 9, " ".join(f"w{i}" for i in range(5000)), " \n "]
    df = docs(spark, texts, extra=True).withColumnRenamed("keep", "h").withColumnRenamed("ids", "bucket")
    got = [r.fingerprint for r in fingerprints.fingerprint(df).orderBy("doc_id").collect()]
    assert got == [plain_signature(t).hex() for t in texts]
    assert got[0] == got[2] and got[3] == got[4] and got[5] == got[6] == got[10]
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (texts[0], texts[1])]
    like = plain_likeness(*(bytes.fromhex(got[i]) for i in (0, 1)))
    assert abs(like - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12
    assert fingerprints.fingerprint(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_docs, ids", [(512, "few"), (3, "few"), (3, "spread"), (2, "hot"), (2, "one"), (4, "none")])
def test_fingerprints_of_neighbours(spark, tmp_path, monkeypatch, bucket_docs, ids):
    monkeypatch.setattr(fingerprints, "BUCKET_DOCS", bucket_docs)
    monkeypatch.setattr(fingerprints, "FAN", 3)
    rng = random.Random(12)
    of = {"few": [5, -3, 70, 1_000_000, 6], "spread": [-(2**63), 2**63 - 1, 0, *rng.sample(range(1000), 40)], "hot": [7] * 30 + [None] * 20 + list(range(20)), "one": [4] * 25, "none": [None] * 3}[ids]
    pool = ["abcdefgh", None, "", "x y z w v u", "ééé日本"] + [" ".join(prose(rng, rng.randint(1, 40))) for _ in range(30)]
    rows = [(i, pool[k] if k < 5 else rng.choice(pool)) for k, i in enumerate(of)]
    docs(spark, [t for _, t in rows], [i for i, _ in rows], extra=True).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op3_fingerprints(spark, str(tmp_path)).collect()
    hashes = {t: r for t, r in spark.createDataFrame([(t,) for t in pool], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        changed = t[: len(t) - cut] + after[:cut]
        a, b, c = (plain_signature(x) for x in (t, changed, after))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    assert Counter((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == Counter(want)


def test_fingerprints_of_no_documents(spark, tmp_path):
    docs(spark, ["a"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprints.op3_fingerprints(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("ids", [range(2000), [*range(1990), *([-(2**62)] * 5), *([2**62] * 5)], [3] * 1500 + list(range(500))])
def test_buckets_are_even(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "BUCKET_DOCS", 20)
    rows = docs(spark, [f"text {k}" for k in range(2000)], ids).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    sizes = [r["count"] for r in rows.withColumn("b", fingerprints.buckets(rows)).groupBy("b").count().collect()]
    assert max(sizes) <= 80 and len(sizes) > 50


# line dedup


def plain_lines(rows, least_chars=40, least_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None else ():
            if len(key(x)) >= least_chars:
                held.setdefault(key(x), set()).add(i)
    drop = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if i is None or drop.get(key(x), i) == i)) for i, t in rows]


@pytest.mark.parametrize("most, small", [(2_000_000, {}), (0, {}), (2_000_000, {"MOST_BYTES": -1}), (0, {"MOST_BYTES": -1, "COMMON_DOCS": 7})])
def test_line_dedup_like_a_plain_version(spark, monkeypatch, most, small):
    for name, value in small.items():
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(3)
    lines = [" ".join(prose(rng, 14)) for _ in range(12)] + ["short", "", "é" * 40, "é" * 39]
    rows = [(i, "\n".join(rng.choice([x, x.upper() + "\t", " " + x]) if x.isascii() else x for x in rng.choices(lines, k=rng.randint(0, 9)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (100, None), (101, "")]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows], extra=True).repartition(5)
    got = line_dedup.dedup_lines(df, most_suspects=most)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter(plain_lines(rows))
    assert line_dedup.dedup_lines(df.limit(0), stats=True).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "a line that is as long as forty characters, or more"
    df = docs(spark, [f"{line}\n{k}" for k in range(6)])
    names = ["keys", "key", "doc", "__doc__", "__keys__", "hash", "keep", "n", "a.b", "rows"]
    df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    got = line_dedup.dedup_lines(df, stats=True)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r["keys"], r["a.b"]) for r in got.collect()) == [(k, f"{line}\n5" if k == 5 else str(k), 0, 8) for k in range(6)]


def test_twice_seen_misses_none():
    h = np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64)
    seen = line_dedup.TwiceSeen()
    first, again = seen.add(h), seen.add(h[:500])
    assert set(h[:500].tolist()) <= set(first.tolist()) | set(again.tolist()) and len(first) < 50


def test_twice_seen_misses_none_when_full():
    h = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    seen = line_dedup.TwiceSeen(bits=1024)
    told = [seen.add(x) for x in (*np.split(h, 30), *np.split(h, 30))]
    assert set(np.concatenate(told).tolist()) >= set(h.tolist())
    assert len(np.concatenate(told)) == len(np.unique(np.concatenate(told)))


def test_pages_follow_the_long_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINES_PER_PAGE", 8)
    long = [" ".join(f"{k}word{i}" for i in range(10)) for k in range(40)]
    assert line_dedup.n_pages(docs(spark, ["\n".join(long), None]), "text", 40) == 8
    assert line_dedup.n_pages(docs(spark, ["x\n" * 200, "y", ""]), "text", 40) == 2
    assert line_dedup.n_pages(docs(spark, ["x"]).limit(0), "text", 40) == 1


# chat


def test_chat_reads_back_any_text(spark):
    rng = random.Random(4)
    bits = ["\\", "### ", "### Assistant: ", "</turn>", "</turn>\n", "<|", "<|image:0|>", ": ", "#", "\n", "é"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "odd: role", "=x", None]), None if rng.random() < 0.1 else "".join(rng.choices(bits, k=6))) for c in (1, 2, None) for t in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(df).collect()
    for c in (1, 2, None):
        whole = "".join(s.segment for s in segments if s.conv == c)
        own = [s for s in segments if s.conv == c]
        want = sorted((t, r or "", x or "") for k, t, r, x in turns if k == c)
        assert [chat.read_turn(whole[s.start : s.start + len(s.segment)])[0] for s in own] == [r for _, r, _ in want]
        assert [chat.unescape(whole[s.loss_start : s.loss_end]) for s in own if s.loss_start is not None] == [x for _, r, x in want if r == "assistant"]
    assert chat.read_back(chat.format_turns(df)).count() == 3 and chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "a.png", "width": 280, "height": 56}, {"type": "audio", "ref": "b.wav", "seconds": 2.5}, {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "text", "text": None}]
    df = spark.createDataFrame([(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts string")
    one, two = chat.format_turns(df, parts="parts").orderBy("turn").collect()
    assert one.segment == "### User: see \\<|image:0|> <|image:0|><|audio:1|><|document:2|></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 20), ("audio", "b.wav", 63), ("document", "c.pdf", 512)] and one.attachment_tokens == 595
    assert two.segment == "### Assistant: </turn>\n" and two.loss_start == two.loss_end


@pytest.mark.parametrize(
    "parts, segment, problems",
    [
        ("no json", "", ["parts are no JSON"]), ('{"type": "text"}', "", ["parts are no list"]), ("[null, 3]", "", ["part 0: no object", "part 1: no object"]), ("null", "", []), ("[]", "", []),
        ('[{"type": "video"}, {"text": "a"}]', "a", ["part 0: unknown type"]), ('[{"type": ["x"]}]', "", ["part 0: unknown type"]), ('[{"type": "image", "width": "wide"}]', "", ["part 0: width is no size"]),
        ('[{"type": "audio", "seconds": NaN}, {"type": "audio", "seconds": -1}]', "", ["part 0: seconds is no size", "part 1: seconds is no size"]), ('[{"text": 5}]', "", ["part 0: text is no text"]),
        ('[{"type": "document", "ref": {}}, {"type": "document", "pages": true}]', "", ["part 0: ref is no text", "part 1: pages is no size"]), ('[{"text": "\\ud800"}]', "?", []),
        ('[{"type": "image", "width": 1e11, "height": 1e11}]', "", ["part 0: too large"]), ("[" * 100_000, "", ["parts are no JSON"]),
    ],
)
def test_chat_of_malformed_parts(parts, segment, problems):
    content, found, wrong = chat.PartVisitor().read(parts)
    assert (content, found, wrong) == (segment, [], problems)


def test_chat_goes_on_after_malformed_parts(spark):
    rows = [(1, 0, "user", "oops"), (1, 1, "user", '[{"type": "image", "ref": "a", "height": []}, {"text": "b"}]'), (1, 2, "assistant", '[{"text": "c"}]')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts string").withColumn("segment", F.lit(0)).withColumn("start", F.lit(0))
    got = chat.format_turns(df, parts="parts").orderBy("turn").collect()
    assert [(r.segment, r.attachment_tokens, r.problems) for r in got] == [("### User: </turn>\n", 0, ["parts are no JSON"]), ("### User: b</turn>\n", 0, ["part 0: height is no size"]), ("### Assistant: c</turn>\n", 0, [])]


# sharding


def test_written_shards(spark, tmp_path):
    df = sharding.place(spark.range(300).withColumn("m", F.create_map(F.lit("a"), "id")), ["id"], ["x", "y"], slots=101)
    sharding.write_shards(df, f"{tmp_path}/s", files=3)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(tuple(r) for r in back.select("id", "shard").collect()) == sorted(tuple(r) for r in df.select("id", "shard").collect())
    assert sharding.place(df.limit(0), ["id"], ["x"], slots=101).count() == 0


def test_sharding_keeps_columns_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2, 3, None), (1, "a", 2, 3, None), (None, "b", 4, 5, 6)], "`k.1` long, `__slot__` string, slot int, `c0` int, `__part__` int")
    got = sharding.place(df, ["k.1"], ["x", "y"], salt=["__slot__"], spread=2, out="my.shard", slots=101)
    assert got.columns == [*df.columns, "my.shard"]
    assert sorted((str(tuple(r)[:5]) for r in got.collect())) == sorted(str(tuple(r)) for r in df.collect())
    sharding.write_shards(got.withColumnRenamed("my.shard", "shard"), str(tmp_path / "o"), files=2)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_sharding_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, slots=1009)
    assert min(np.bincount(table)) >= 1009 // 7 and max(np.bincount(table)) <= 1009 // 7 + 1
    left = sharding.fill_table(names[:-1], slots=1009)
    assert ((table != left) & (table != 6)).mean() < 0.1  # others hardly move
    heavy = np.bincount(sharding.fill_table(names[:2], [1, 3], slots=1009))
    assert 2.8 < heavy[1] / heavy[0] < 3.2
    taken, at, want = set(), [0] * 7, [-1] * 1009  # the same turns, by lists of preferences
    pref = [[(int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "big") % 1009 + j * (int.from_bytes(hashlib.sha256(n.encode()).digest()[8:16], "big") % 1008 + 1)) % 1009 for j in range(1009)] for n in names]
    while len(taken) < 1009:
        for k in range(7):
            while len(taken) < 1009 and pref[k][at[k]] in taken:
                at[k] += 1
            if len(taken) < 1009:
                want[pref[k][at[k]]] = k
                taken.add(pref[k][at[k]])
    assert table.tolist() == want
    with pytest.raises(ValueError):
        sharding.fill_table(names, slots=1000)


def test_sharding_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, shard string")
    got = sharding.place(df, ["k"], ["x", "y", "z"], slots=101)
    assert got.count() == 3 and got.filter("k = 1").select("shard").distinct().count() == 1
    many = spark.range(1000).withColumn("k", F.lit(1))
    assert sharding.place(many, ["k"], list("abcdefgh"), salt=["id"], spread=50, slots=101).select("shard").distinct().count() > 4


# tokens


TEXTS = ["", None, "Hello world's  end\n\n x", "a" * 300, "é" * 150, "日本語 text", " " * 80, "_" * 70, "word " * 3000, "\u0000\ud7ff", "12345 678"]


def test_bpe_like_the_library(spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("theran ea\n'sé") for _ in range(n)) for n in (10, 100, 5000)] + ["".join(rng.choice("ther") for _ in range(n)) for n in (63, 64, 65, 900)]
    coded = bpe.encode(spark, docs(spark, texts, extra=True), RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.decode(spark, coded, RANKS).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == own.encode_ordinary(t or "") and bytes(got[i].bytes) == (t or "").encode() and got[i].keep == 1
    assert bpe.encode(spark, docs(spark, ["a"]).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_runs():
    ranks = bpe.load_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.choice([65, 66, 127, 129, 400]))).encode() for letters in ("a", "ab", "the ran", "é日ñ", "=-_", "\0\1") * 20]
    pieces += [b"a" * 9999, bytes(rng.choice(b"abcdefghij") for _ in range(9999)), bytes(rng.randrange(256) for _ in range(3000)), b"", b"x"]
    assert [x.tolist() for x in bpe.BPE(ranks).encode_pieces(pieces)] == [own._encode_single_piece(p) if p else [] for p in pieces]
    # a vocabulary whose ranks don't follow the order in which a pair's parts are made: only one place may merge in a round
    odd = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 260, b"ab": 270, b"aab": 265}
    own = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=odd, special_tokens={})
    pieces = ["".join(rng.choice("aab") for _ in range(90)).encode() for _ in range(50)]
    assert [x.tolist() for x in bpe.BPE(odd).encode_pieces(pieces)] == [own._encode_single_piece(p) for p in pieces]


def test_token_counts_like_greedy_search(spark):
    rng = random.Random(6)
    for inner in (None, ["b", "bc", "ca", "aab"]):
        first = ["a", "ab", "abc", "b", "c", "cab"]
        count = token_counts.LongestMatch([t.encode() for t in first], inner and [t.encode() for t in inner])
        for _ in range(500):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
            n, rest = 0, word
            while rest:
                k = max((k for k in range(1, len(rest) + 1) if rest[:k] in (first if n == 0 or inner is None else inner)), default=0)
                if not k:
                    n = 1
                    break
                n, rest = n + 1, rest[k:]
            assert count(word.encode()) == n, word
    got = token_counts.count_tokens(spark, docs(spark, TEXTS, extra=True), bpe.load_ranks(RANKS), public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[2].n_words == 7


# n-gram Jaccard join


def plain_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = set() if not w else {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small", [{}, {"longest": 8, "class_nodes": 60, "page_postings": 2000}])
def test_join_like_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(jaccard_join, "SLICE_PAIRS", 50)
        monkeypatch.setattr(jaccard_join, "PACK_POSTINGS", 300)
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 50)
    words = [edited(rng, base, rng.choice([0.005, 0.02, 0.05])) for _ in range(120)] + [passage + prose(rng, rng.choice([3, 8, 200])) for _ in range(60)]
    for _ in range(25):
        b = prose(rng, rng.choice([3, 6, 30, 100]))
        words += [edited(rng, b, rng.choice([0, 0.02])) for _ in range(rng.choice([1, 3]))]
    rows = [(3 * i, " ".join(w)) for i, w in enumerate(words)] + [(9001, ""), (9004, None), (9007, "A b"), (9010, "a  B")]
    got = jaccard_join.similar_groups(docs(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), **small)
    assert {r.doc: (r.n_shingles, r.component) for r in got.collect()} == plain_groups(rows)


@pytest.mark.parametrize("leaders, class_nodes", [(1, 1), (4, 5)])
def test_join_of_settled_nodes(spark, monkeypatch, leaders, class_nodes):
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    rows = []
    for chain in range(16):  # neighbours are linked only through those between them
        starts = [0, 36, 78, 114] if leaders == 1 else [40 * k for k in range(14)]
        rows += [(100 * chain + k, " ".join(f"c{chain}w{i}" for i in range(at, at + 304))) for k, at in enumerate(starts)]
    got = jaccard_join.similar_groups(docs(spark, [t for _, t in rows], [i for i, _ in rows]), class_nodes=class_nodes)
    want = plain_groups(rows)
    assert len({c for _, c in want.values()}) == 16
    assert {r.doc: (r.n_shingles, r.component) for r in got.collect()} == want


def test_join_of_a_template(spark):
    """Texts that share three fifths of their shingles each with all others, but link with none: in one coarse class, and in classes too large."""
    rng = random.Random(15)
    template = [f"t{k}" for k in range(160)]
    rows = [(k, " ".join(template + [f"own{k}x{j}" for j in range(36 + rng.randrange(8))])) for k in range(300)] + [(900, " ".join(template + [f"own7x{j}" for j in range(30)]))]
    rows[7] = (7, " ".join(template + [f"own7x{j}" for j in range(36)]))
    want = plain_groups(rows)
    assert len({c for _, c in want.values()}) == 300 and want[900][1] == 7
    for small in ({}, {"class_nodes": 100}):
        got = jaccard_join.similar_groups(docs(spark, [t for _, t in rows], [i for i, _ in rows]), **small)
        assert {r.doc: (r.n_shingles, r.component) for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(8))
def test_resolved_classes_like_all_pairs(seed):
    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 2**63, rng.integers(3, 60), dtype=np.uint64) for _ in range(2)]
    bases.append(np.concatenate(bases))
    sets = []
    for _ in range(80):
        base = bases[rng.integers(3)]
        own = np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.7, 0.9, 0.97])], rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)]))
        sets += [own] * (len(own) > 0)
    nodes, root = rng.permutation(len(sets) * 7)[: len(sets)].tolist(), list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 4 * both >= 3 * (len(a) + len(b) - both):
                root = [root[j] if r == root[i] else r for r in root]
    assert jaccard_join.resolve(nodes, sets, 3, 4) == [min(n for n, s in zip(nodes, root, strict=True) if s == r) for r in root]


def test_join_edges(spark):
    got = jaccard_join.similar_groups(docs(spark, ["a b", "c d", "a b", "c d", "z"], [1, 1, 2, 3, None])).collect()
    assert {(r.doc, r.component) for r in got} == {(1, 1), (2, 1), (3, 1), (None, None)} and len(got) == 5
    assert jaccard_join.similar_groups(docs(spark, ["a"]).limit(0)).count() == 0
    sparse = docs(spark, ["a b c", "a b c", None], [4, 2, 3]).repartition(8, "doc_id")  # tasks without rows, or without words
    assert {(r.doc, r.component) for r in jaccard_join.similar_groups(sparse).collect()} == {(4, 2), (2, 2), (3, 3)}


def test_divide_skip():
    rng = random.Random(8)
    for _ in range(300):
        lists = [np.array(sorted(rng.sample(range(40), rng.randint(1, 30)))) for _ in range(rng.randint(1, 9))]
        least = rng.randint(1, 6)
        times = Counter(v for x in lists for v in x.tolist())
        assert sorted(jaccard_join.divide_skip(lists, least)) == sorted(v for v, n in times.items() if n >= least)


# quality


def test_quality_on_held_out_documents(spark):
    rng = random.Random(9)

    def text(kind):
        w = prose(rng, 80)
        if kind == "toxic":
            w[rng.randrange(80)] = "nasty" + rng.choice(["", "er", "est", "ish"])
        return " ".join(w) if kind != "junk" else " ".join(x.upper() + "!!$$" for x in w)

    kinds = [("clean", "toxic", "junk", "clean", "clean")[i % 5] for i in range(600)]
    df = spark.createDataFrame([(i, text(k), f"h{i % 3}", None if i % 2 else "en", "x") for i, k in enumerate(kinds)], "doc_id long, text string, source string, lang string, keep string")
    labels = spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kinds[:300])], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(df, labels).collect()}
    assert len(got) == 600 and np.mean([got[i] == (kinds[i] == "clean") for i in range(300, 600)]) > 0.97
    odd = df.withColumns({"__bad__": F.lit("x"), "__rate__": F.lit(1), "__host__": F.lit("y"), "`a.b`": F.lit(2), "__id__": F.lit(3), "c0": F.lit(4)})
    named = quality.classify(odd, labels)
    assert named.columns == [*(c for c in odd.columns if c != "keep"), "evidence", "site_rate", "p_bad", "keep"] and {r.doc_id: r.keep for r in named.collect()} == got
    assert quality.classify(df, labels.limit(0)).filter("keep").count() == 600
    assert quality.classify(df.limit(0), labels).count() == 0


def plain_posteriors(rows):
    """Host and path rates, from (host, path, evidence) of all documents: beta priors whose weights are estimated by moments."""
    rate = min(1 - 1e-6, max(1e-6, sum(b for *_, b in rows) / len(rows)))

    def level(groups, up):
        n = {g: len(v) for g, v in groups.items()}
        total = sum(n.values())
        within = sum(n[g] * up[g] * (1 - up[g]) for g in groups) / total
        between = max(0.0, sum(n[g] * (sum(v) / n[g] - up[g]) ** 2 for g, v in groups.items()) - sum(up[g] * (1 - up[g]) for g in groups)) / total
        k = min(1e6, max(1.0, within / between)) if between > 0 and within else 1e6
        return {g: (k * up[g] + sum(v)) / (k + n[g]) for g, v in groups.items()}

    hosts, paths = {}, {}
    for h, p, b in rows:
        hosts.setdefault(h, []).append(b)
        paths.setdefault((h, p), []).append(b)
    of_host = level(hosts, dict.fromkeys(hosts, rate))
    return rate, level(paths, {g: of_host[g[0]] for g in paths})


def test_verdicts_like_plain_posteriors(spark):
    rng = random.Random(13)
    texts, labels, rows = [], [], []
    for i in range(500):
        host = rng.choice(["a", "b", "c", None])
        junk = rng.random() < {"a": 0.8, "b": 0.05, "c": 0.3, None: 0.3}[host]
        w = prose(rng, rng.choice([1, 3, 40]))
        texts.append(None if i % 50 == 0 else " ".join(x.upper() + rng.choice(["", "!"]) if junk and rng.random() < 0.6 else x for x in w))
        labels.append((i, int(not junk), 0))
        rows.append((host, rng.choice(["en", "de", None])))
    df = spark.createDataFrame([(i, t, *r, 1) for i, (t, r) in enumerate(zip(texts, rows, strict=True))], "doc_id long, text string, source string, lang string, site_rate int")
    known = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, known).collect()}
    rate, paths = plain_posteriors([(*rows[i], got[i].evidence) for i in range(500)])
    odds = lambda p: np.log(max(p, 1e-9) / max(1 - p, 1e-9))
    for i in range(500):
        site = paths[rows[i]]
        p = 1 / (1 + np.exp(-(odds(got[i].evidence) - odds(rate) + odds(site))))
        assert abs(got[i].site_rate - site) < 1e-9 and abs(got[i].p_bad - p) < 1e-9 and got[i].keep == (p < 0.5)
    assert len({got[i].keep for i in range(500)}) == 2 and len({round(x, 6) for x in paths.values()}) > 6


def test_sparse_sites_shrink(spark):
    sums = spark.createDataFrame([("a", "p", 90.0, 100), ("a", "q", 1.0, 1), ("b", "p", 10.0, 1000), ("c", "p", 1.0, 1), (None, "p", 0.0, 1)], "__host__ string, __path__ string, bad double, n long")
    sites, rate = quality.site_rates(sums)
    got = {(r[0], r[1]): r[2] for r in sites.collect()}
    assert len(got) == 5 and got["b", "p"] < rate < got["c", "p"] < got["a", "p"] < 1 and got[None, "p"] <= rate


@pytest.mark.parametrize("hub_rows", [1000, 3])
def test_components_with_hubs(spark, monkeypatch, hub_rows):
    from newsloom.llm import components

    monkeypatch.setattr(components, "HUB_ROWS", hub_rows)
    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(k, k + 1) for k in range(200, 230)] + [(7, 7), (300, 300), (0, 1), (None, 5), (5, None)]
    root = {n: n for e in edges for n in e if n is not None}
    for _ in root:
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    met = {n for a, b in edges if a is not None and b is not None and a != b for n in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got)) == sorted((n, root[n]) for n in met)


def test_components_of_no_edges(spark):
    from newsloom.llm.components import components

    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("hub_rows", [1000, 3])
def test_least_of_groups(spark, monkeypatch, hub_rows):
    from newsloom.llm import components

    monkeypatch.setattr(components, "HUB_ROWS", hub_rows)
    rows = [("hot", v) for v in range(40, 0, -1)] + [("cold", 5), ("cold", 4), (None, 1), ("hot", 1)]
    got = components.with_least(spark.createDataFrame(rows, "k string, v long"), "k", "v", len(rows)).select("k", "v", "m", "n").collect()
    assert Counter(map(tuple, got)) == Counter((k, v, 1, 41) if k == "hot" else (k, v, 4, 2) for k, v in rows if k)
