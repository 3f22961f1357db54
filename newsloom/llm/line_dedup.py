r"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

1. Each task sends the 64-bit hashes of its documents' line keys (each key once a document, and at most twice
   a batch) to pages by their high bits. Only these 8 bytes move, packed.
2. A page's owner streams its hashes through two Bloom filters of fixed size: a hash that the once-seen
   filter holds already is a suspect, and goes into the twice-seen filter. What the second doesn't hold yet is
   reported; what it holds is looked up among those reported, so a false positive of either filter loses none.
3. Only lines whose hash is suspected shuffle, with their text, for exact counts of documents and the choice of
   the kept occurrence. Suspects are looked up in a broadcast filter if they fit ``most_suspects``; beyond, by a
   join on the hash.
4. The lines to drop go to their documents by a shuffled join on the document's id.

A document is known by its id: rows that repeat an id count as one document, and each keeps or loses its lines
alike. Rows with a null id are neither counted nor changed. Null text is one empty line and stays null. Other columns stay,
whatever their names. Empty tables stay empty. Texts are read in slices, and a very long one is a slice of its own.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import ASCII_SPACE, Scratch, as_bytes, map_arrow, mix, quoted, sliced, tidy

#: A page's filters: bits of each, and positions set for a hash. About a million hashes fill half of one.
PAGE_BITS, PROBES = 1 << 22, 3
#: The long lines that a page should get at most: they fill a sixth of its filters.
LINES_PER_PAGE = 1 << 18
#: Bytes of text whose hashes a task packs at once.
PACK_BYTES = 16_000_000
#: Bytes of repeated keys that are broadcast; more are joined by a shuffle.
MOST_BYTES = 32_000_000
#: Keys that may be broadcast beyond that for being very common, the documents that such a key has at least, and its most bytes.
MOST_COMMON, COMMON_DOCS, COMMON_BYTES = 1000, 1000, 4096


def line_key(line: bytes) -> bytes:
    """The key of a line: stripped of ASCII white space, A-Z lower-cased."""
    return line.strip(ASCII_SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points; cheap for keys that are clearly short or long."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class TwiceSeen:
    """The once-seen and twice-seen Bloom filters of a page, fed by batches."""

    def __init__(self, bits: int = PAGE_BITS, probes: int = PROBES):
        self.bits, self.probes = bits, probes
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        self.reported = np.empty(0, np.uint64)

    def _bits(self, h: np.ndarray):
        a, b = mix(h), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
        for k in range(self.probes):
            at = ((a + np.uint64(k) * b) % np.uint64(self.bits)).astype(np.int64)
            yield at >> 3, (np.uint8(1) << (at & 7).astype(np.uint8))

    def has(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for byte, bit in self._bits(h):
            out &= (table[byte] & bit) != 0
        return out

    def put(self, table: np.ndarray, h: np.ndarray) -> None:
        for byte, bit in self._bits(h):
            np.bitwise_or.at(table, byte, bit)

    def add(self, h: np.ndarray) -> np.ndarray:
        """Takes hashes in; returns those that become suspects now."""
        h, n = np.unique(h, return_counts=True)
        again = h[(n > 1) | self.has(self.once, h)]
        self.put(self.once, h)
        held = self.has(self.twice, again)
        held[held] = np.isin(again[held], self.reported)
        fresh = again[~held]
        self.put(self.twice, fresh)
        self.reported = np.insert(self.reported, np.searchsorted(self.reported, fresh), fresh)
        return fresh


def _keys_of(text: bytes | None, least: int) -> list[bytes]:
    """A text's distinct keys that are long enough, in order."""
    if not text:
        return []
    return [k for k in dict.fromkeys(map(line_key, text.split(b"\n"))) if long_enough(k, least)]


def n_pages(docs: DataFrame, text_col: str, least: int) -> int:
    """Pages for the long lines: of a text there are no more than its lines, nor than ``least`` characters and a line feed each allow."""
    text = F.col(text_col)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    most = docs.agg(F.sum(F.least(lines, F.floor((F.length(text) + 1) / (max(0, least) + 1))))).first()[0] or 0
    return 1 << max(0, -(-most // LINES_PER_PAGE) - 1).bit_length()


def suspects(docs: DataFrame, id_col: str, text_col: str, least: int, pages: int) -> DataFrame:
    """``hash``: every hash that two documents' keys share, and few others."""
    shift = np.uint64(64 - (pages - 1).bit_length()) if pages > 1 else None

    def send(batches):
        import pyarrow as pa

        for batch in sliced(batches, 1, PACK_BYTES):
            got = [hashes(keys) for i, t in zip(batch.column(0).is_valid().to_pylist(), as_bytes(batch.column(1)), strict=True) if i and (keys := _keys_of(t, least))]
            h = np.sort(np.concatenate(got)) if got else np.empty(0, np.uint64)
            h = h[(np.arange(len(h)) < 2) | (h != np.roll(h, 2))]  # of each at most two
            page = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
            cut = np.flatnonzero(np.diff(page, prepend=-1))
            packs = [x.tobytes() for x in np.split(h, cut[1:])] if len(h) else []
            yield pa.RecordBatch.from_arrays([pa.array(page[cut], pa.int64()), pa.array(packs, pa.binary())], names=["page", "pack"])

    def own(batches):
        import pyarrow as pa

        page, seen = None, None
        for batch in batches:
            out = [np.empty(0, np.uint64)]
            for p, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != page:
                    page, seen = p, TwiceSeen()
                out.append(seen.add(np.frombuffer(pack, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64), pa.int64())], names=["hash"])

    sent = docs.select(id_col, text_col).mapInArrow(tidy(send), "page bigint, pack binary")
    return sent.repartition("page").sortWithinPartitions("page").mapInArrow(tidy(own), "hash bigint")


def repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, min_chars: int, min_docs: int, most_suspects: int) -> DataFrame:
    """``key``, ``doc``: each long key in the documents that must lose it (in ``min_docs`` or more; kept in the largest id)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    found = scratch.write(suspects(docs, id_col, text_col, min_chars, n_pages(docs, text_col, min_chars)), "suspects")
    n = found.count()
    known = None
    if n <= most_suspects:
        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in found.toLocalIterator()], np.int64)))

    def lines(batches):
        import pyarrow as pa

        for batch in sliced(batches, 1):
            ids, keys, at = [], [], []
            for i, (ok, t) in enumerate(zip(batch.column(0).is_valid().to_pylist(), as_bytes(batch.column(1)), strict=True)):
                if ok and (own := _keys_of(t, min_chars)):
                    keys += own
                    at += [i] * len(own)
            h = hashes(keys).view(np.int64)
            if known is not None and len(h):
                have = known.value
                spot = np.minimum(np.searchsorted(have, h), max(0, len(have) - 1))
                good = np.flatnonzero(have[spot] == h) if len(have) else np.empty(0, np.int64)
            else:
                good = np.arange(len(h))
            ids = batch.column(0).take(pa.array(np.array(at, np.int64)[good]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h[good], pa.int64()), pa.array([keys[g] for g in good], pa.binary())], names=["doc", "hash", "key"])

    rows = docs.select(id_col, text_col).mapInArrow(tidy(lines), f"doc {kind}, hash bigint, key binary")
    if known is None:
        rows = rows.join(found, "hash", "left_semi")
    rows = rows.select("key", "doc")
    if known is not None and n == 0:
        return rows.limit(0)
    rows = scratch.write(rows, "lines")
    # counts by (key, document) first: a key of a third of all documents is spread over all tasks
    many = rows.groupBy("key").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("keep")).filter(F.col("n") >= min_docs)
    many = scratch.write(many, "many")
    return _lost(rows, many, many.agg(F.sum(F.length("key") + 64)).first()[0] or 0)


def _lost(rows: DataFrame, many: DataFrame, size: int) -> DataFrame:
    """``doc``, ``key``: the rows of ``many``'s keys but those of the document that keeps them. A very common key's rows stay where
    they are: all keys are broadcast if they're small, else those that over a thousandth of the rows have, so a thousand at most.
    Very long common keys are left to the shuffled join of two written tables, of which AQE splits skewed partitions."""
    keep = many.select("key", "keep")
    if size <= MOST_BYTES:
        met = rows.join(F.broadcast(keep), "key")
    else:
        is_common = (F.col("n") > max(COMMON_DOCS, rows.count() // MOST_COMMON)) & (F.length("key") <= COMMON_BYTES)
        marked = rows.join(F.broadcast(many.filter(is_common).select("key", "keep")), "key", "left")
        met = marked.filter("keep IS NOT NULL").unionByName(marked.filter("keep IS NULL").drop("keep").join(many.filter(~is_common).select("key", "keep").hint("merge"), "key"))
    return met.filter(F.col("doc") != F.col("keep")).select("doc", "key").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, most_suspects: int = 2_000_000, stats: bool = False) -> DataFrame:
    """The rows with repeated lines dropped from ``text_col``; with ``stats`` also ``n_lines`` and ``n_dropped`` (such columns are replaced).

    At most ``most_suspects`` hashes (16 MB) are broadcast. A text that loses all lines becomes empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    kept = [c for c in docs.columns if not stats or c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*map(quoted, kept))
    drop = repeated_lines(docs, scratch, id_col, text_col, min_chars, min_docs, most_suspects)
    drop = drop.groupBy("doc").agg(F.collect_list("key").alias("keys"))
    # columns are named by their side: the documents may have any names; rows without an id don't move
    known, others = (docs.filter(F.col(quoted(id_col)).isNotNull()), docs.filter(F.col(quoted(id_col)).isNull()))
    rows = known.join(drop.hint("shuffle_hash"), known[quoted(id_col)] == drop["doc"], "left").select(*(known[quoted(c)] for c in kept), drop["keys"])
    rows = rows.union(others.select(*map(quoted, kept), F.lit(None).cast("array<string>").alias("keys")))
    schema = T.StructType([*(docs.schema[c] for c in kept), *([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if stats else [])])
    where = kept.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, where):
            made, n_lines, n_dropped = [], [], []
            for t, keys in zip(as_bytes(batch.column(where)), batch.column(len(kept)).to_pylist(), strict=True):
                have = (t or b"").split(b"\n") if keys or stats else ()
                gone = set(keys or ())
                left = [x for x in have if line_key(x) not in gone] if gone else have
                made.append(b"\n".join(left) if gone else t)
                n_lines.append(len(have)), n_dropped.append(len(have) - len(left))
            cols = list(batch.columns[: len(kept)])
            cols[where] = pa.array(made, pa.binary()).cast(cols[where].type)
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if stats else [])], names=schema.names)

    return map_arrow(rows, run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that dropped, and the digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, stats=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
many AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (m.key IS NOT NULL AND k.doc_id <> m.keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (m.key IS NULL OR k.doc_id = m.keep), '')) AS kept_sha256
FROM keyed k LEFT JOIN many m USING (key) GROUP BY doc_id"""
