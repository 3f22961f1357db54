"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's 5-word shingles are hashed once; the high byte of a hash names its bin, the rest is its value, and a bin keeps the
least: the hashes are sorted, and a bin's first is its least. An empty bin borrows by optimal densification: it probes bins in
a sequence that depends on the bin alone until one is filled. The probes are hashes of (bin, attempt); after ``PROBES`` of them,
the least hash of (bin, filled bin) picks, which continues the sequence without repeats, so that it always ends. Of each value
the low 8 bits are stored, packed as hex. The likeness of two fingerprints is their share of equal bytes, corrected for bytes
that agree by chance (1 in 256). All that is an expression over the text alone: rows are neither multiplied nor aggregated.

Words are runs without ASCII white space, in lower case. A null or empty text, or one without words, has one shingle of its
own, so that such texts are alike; fewer than five words are one shingle. A text's hashes are held at once, 24 bytes a word.
Empty tables give empty results; repeated rows have a row each; only the id and text columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, BINS, BITS, PROBES = 5, 256, 8, 6
#: The mark of an empty bin: the largest value (a real one equals it with chance 2^-56).
EMPTY = (1 << 56) - 1
#: Documents in a bucket of neighbouring ids, and the most buckets: the list of their first documents is broadcast.
BUCKET_DOCS, MOST_BUCKETS = 512, 1_000_000
#: Ranges of ids between quantiles: so many squared.
FAN = 32


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not at each place where lambdas below name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def constant(values, kind: str) -> Column:
    return F.array(*(F.lit(v).cast(kind) for v in values))


def shingle_hashes(text: Column) -> Column:
    """A hash for each place where a shingle begins, at least one. Words past the end are null, which a hash passes over."""
    places = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - WIDTH, F.lit(0)))
    return bound(words(text), lambda w: F.transform(places(w), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH)))))


def bin_minima(hashes: Column) -> Column:
    """The least hash of each of the ``BINS`` bins, in their order; null of an empty one. Each bin is given a mark, which sorts last."""
    marks = constant((((b - BINS // 2) << 56) | EMPTY for b in range(BINS)), "long")
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))
    return F.transform(bound(F.sort_array(F.concat(hashes, marks)), first), lambda x: F.when(x.bitwiseAND(EMPTY) != EMPTY, x))


def probe(bin_: int, attempt: int) -> int:
    """The bin that an empty bin tries at an attempt: a hash of both."""
    return hashlib.blake2b(b"%d %d" % (bin_, attempt), digest_size=1).digest()[0] % BINS


def densified(minima: Column) -> Column:
    """The minima with every empty bin filled from another."""
    bins = constant(range(BINS), "int")
    tries = [constant((probe(b, t) for b in range(BINS)), "int") for t in range(PROBES)]

    def fill(m: Column, have: Column) -> Column:
        def value(i: Column) -> Column:
            last = F.array_min(F.transform(have, lambda j: F.xxhash64(i, j).bitwiseAND(~(BINS - 1)).bitwiseOR(j.cast("long"))))
            return F.coalesce(F.get(m, i), *(F.get(m, F.get(t, i)) for t in tries), F.get(m, last.bitwiseAND(BINS - 1).cast("int")))

        return F.when(F.size(have) == BINS, m).otherwise(F.transform(bins, value))

    return bound(minima, lambda m: bound(F.filter(bins, lambda j: F.get(m, j).isNotNull()), lambda have: fill(m, have)))


def signature(text: Column) -> Column:
    """The fingerprint as an array of ``BINS`` bytes (less 128 each)."""
    return F.transform(densified(bin_minima(shingle_hashes(text))), lambda v: (v.bitwiseAND((1 << BITS) - 1) - 128).cast("byte"))


def packed(low: Column) -> Column:
    """A signature as lower-case hex."""
    digits = constant((f"{b:02x}" for b in range(1 << BITS)), "string")
    return bound(digits, lambda d: F.array_join(F.transform(low, lambda v: F.get(d, v.cast("int") + 128)), ""))


def likeness(a: Column, b: Column) -> Column:
    """The corrected share of equal bytes of two signatures, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / BINS
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``id_col`` and ``out`` of every row, a hex string of ``BINS`` bytes. Nothing shuffles."""
    return docs.select(id_col, packed(signature(F.col(text_col))).alias(out))


def buckets(docs: DataFrame) -> Column:
    """The bucket of ``id`` and ``h``, ascending with them: null ids first; ranges between sampled quantiles of all ids, each cut evenly.

    Ids may be any 64-bit numbers: an outlier widens no range but its own. An id that has many rows (or null) is a range of its own,
    cut by the hash of the text; rows alike in both are neighbours in one bucket.
    """
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    total = min(MOST_BUCKETS, max(1, n // BUCKET_DOCS))
    ranges = min(FAN * FAN, total)
    cuts = docs.agg(F.percentile_approx("id", [k / ranges for k in range(ranges)], 20 * FAN * FAN)).first()[0] or [0]
    each = -(-total // ranges)
    distinct = sorted(set(cuts))
    # of an id at several quantiles: the buckets that its rows need
    many = [each * (cuts.count(c) - 1) + 1 if cuts.count(c) > 1 else 1 for c in distinct] if len(distinct) < len(cuts) else [1] * len(distinct)
    of_null = max(1, min(total, nulls // BUCKET_DOCS))
    span = max(each, of_null, *many)
    ends = [*distinct[1:], (1 << 63) - 1]
    rows = [distinct[k : k + FAN] for k in range(0, len(distinct), FAN)]
    ident, h = F.col("id"), F.col("h")
    table = lambda values, kind: F.array(*(constant(values[k : k + FAN], kind) for k in range(0, len(values), FAN)))
    count = lambda xs: F.size(F.filter(xs, lambda c: c <= ident))
    row = F.greatest(F.lit(0), count(constant([r[0] for r in rows], "long")) - 1)
    at = bound(row, lambda k: F.struct(k.alias("k"), F.greatest(F.lit(0), count(F.get(table(distinct, "long"), k)) - 1).alias("j")))

    def place(p: Column) -> Column:
        pick = lambda values, kind: F.get(F.get(table(values, kind), p["k"]), p["j"])
        low, high = pick(distinct, "long").cast("double"), pick(ends, "long").cast("double")
        by_id = F.floor((ident.cast("double") - low) / F.greatest(F.lit(1.0), high - low) * each)
        by_hash = F.floor((h.cast("double") / float(1 << 64) + 0.5) * pick(many, "long"))
        own = ident == pick(distinct, "long")
        inside = F.when(own, F.least(by_hash, pick(many, "long") - 1)).otherwise(F.greatest(F.lit(0), F.least(by_id, F.lit(each - 1))))
        return (2 * (p["k"] * FAN + p["j"]) + F.when(ident > pick(distinct, "long"), 1).otherwise(F.when(own, 0).otherwise(-1))) * F.lit(span).cast("long") + inside

    null_place = F.least(F.floor((h.cast("double") / float(1 << 64) + 0.5) * of_null), F.lit(of_null - 1)) - 4 * span
    return F.when(ident.isNull(), null_place).otherwise(bound(at, place)).cast("long")


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket``, ``id``, ``h``, ``ghost``, ``text``: the documents dealt by buckets of ascending id (nulls first; equal ids by a hash of the
    text). A bucket ends with a ghost: the first document of the next bucket, or after the last one of the first.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    docs = docs.withColumn("bucket", buckets(docs))
    heads = docs.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("head"))  # a few more than MOST_BUCKETS at most
    every = Window.partitionBy(F.lit(0)).orderBy("bucket")
    heads = heads.select(F.col("head.id").alias("i0"), F.col("head.h").alias("h0"), F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("before"))
    placed = docs.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("i0")) & (F.col("h") == F.col("h0")), "left")
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))
    twice = F.array(own, F.struct(F.col("before").alias("b"), F.lit(1).alias("ghost")))
    rows = placed.select("id", "h", "text", F.explode(F.when(F.col("before").isNotNull(), twice).otherwise(F.array(own))).alias("p"))
    return rows.select(F.col("p.b").alias("bucket"), F.col("p.ghost").alias("ghost"), "id", "h", "text").repartition("bucket")


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``edited``, and the signatures ``low``, ``edited_low``, ``next_low``: an edited text ends with the first
    quarter of its length of the next document's. The texts shuffle once."""
    rows = neighbours(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("low", signature(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("ghost", "id", "h", "text")
    rows = rows.select("id", "ghost", "text", "low", F.lead("text").over(order).alias("after"), F.lead("low").over(order).alias("next_low")).filter("ghost = 0")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("after").substr(F.lit(1), cut))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "low", "next_low")
    return rows.withColumn("edited_low", signature(F.col("edited")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint and its edited text's, and the likeness to the edited text and to the next document."""
    rows = with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    near_edited, near_next = likeness(F.col("low"), F.col("edited_low")), likeness(F.col("low"), F.col("next_low"))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    return rows.select(F.col("id").alias("doc_id"), "n_chars", digest.alias("edited_sha256"), packed(F.col("low")).alias("fingerprint"), packed(F.col("edited_low")).alias("edited_fingerprint"), near_edited.alias("near_edited"), near_next.alias("near_next"))
