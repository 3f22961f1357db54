"""Benchmark decontamination over a positional inverted index.

The index is a table of segments. A segment holds the documents of about ``SEGMENT_WORDS`` words (or one document) and, for
each of their terms, the sorted positions at which it stands; it's built once and serves any test set. A search reads each
segment once: for every phrase it takes the postings of the term that is rarest in that segment as candidate starts
(adjusted by the term's offset in the phrase), then intersects with the next rarest, until none is left. Segments are cut
by documents, so a term of all rows is spread over all segments and nothing shuffles. Test sets go in blocks; a scan of the index takes
some blocks in turn for each segment. A test set of more blocks needs more scans, whose results are joined by the segment's number.

Words are maximal runs of ``[0-9a-z]`` and code points from U+0080, after lower-casing A-Z. Null text has no words. Rows
are documents of their own, also when they repeat an id; a null id stays null. Items without words or without an id are no
queries; items that repeat are each named, once an id. An empty table of documents gives an empty result, an empty test
set finds nothing. Only the id and text columns are read: other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, as_bytes, sliced, tidy

SEGMENT_WORDS = 1 << 17
#: Words of a block of test items, whose phrases are intersected at once, and blocks that are sent to the executors for one scan.
BLOCK_WORDS, SCAN_BLOCKS = 200_000, 8
#: Every byte to itself in lower case if it's part of a word, else to a space.
WORD_BYTES = bytes(b if b >= 0x80 or bytes([b]).isalnum() else 32 for b in bytes(range(256)).lower())


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments: ``number`` (each its own: the partition's, and that in it), ``docs`` (ids), ``starts`` (first word of each document, and
    the end), ``terms`` (sorted, joined by spaces), ``ends`` (of each term's postings), ``deltas`` (of positions, all terms' in order)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        partition, made = TaskContext.get().partitionId(), 0

        def segment(own_type):
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            terms = sorted(ids_of)
            rank = np.empty(len(terms), np.int32)
            rank[np.fromiter(map(ids_of.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms), dtype=np.int32)
            seq = rank[np.concatenate(seqs)] if seqs else np.empty(0, np.int32)
            order = np.argsort(seq, kind="stable").astype(np.int64)
            ends = np.cumsum(np.bincount(seq, minlength=len(terms))).astype(np.int64)
            deltas = np.diff(order, prepend=0).astype(np.int32)
            cols = [pa.array([x], t) for x, t in (((partition << 32) + made, pa.int64()), (owners, pa.list_(own_type)), (starts.tobytes(), pa.binary()), (b" ".join(terms), pa.binary()), (ends.tobytes(), pa.binary()), (deltas.tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=["number", "docs", "starts", "terms", "ends", "deltas"])

        owners, sizes, seqs, ids_of, total = [], [], [], {}, 0
        for batch in sliced(batches, 1):
            own_type = batch.column(0).type
            for owner, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                for w in words:
                    if w not in ids_of:
                        ids_of[w] = len(ids_of)
                owners.append(owner), sizes.append(len(words))
                if words:
                    seqs.append(np.fromiter(map(ids_of.__getitem__, words), np.int32, len(words)))
                total += len(words) + 1
                if total >= SEGMENT_WORDS:
                    yield segment(own_type)
                    made += 1
                    owners, sizes, seqs, ids_of, total = [], [], [], {}, 0
        if owners:
            yield segment(own_type)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"number bigint, docs array<{kind}>, starts binary, terms binary, ends binary, deltas binary")


class Segment:
    """A segment read back."""

    def __init__(self, number, docs, starts, terms, ends, deltas):
        self.number, self.docs, self.starts = number, docs, np.frombuffer(starts, np.int64)
        self.terms = {t: i for i, t in enumerate(bytes(terms).split(b" "))} if len(terms) else {}
        self.ends = np.concatenate([[0], np.frombuffer(ends, np.int64)])
        self.positions = np.cumsum(np.frombuffer(deltas, np.int32), dtype=np.int64)
        self.span = int(self.starts[-1]) + 1
        # sorted by (term, position) as one key, so that lists of many terms are intersected at once
        self.keys = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends)) * self.span + self.positions

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term its postings, one after another, and the index in ``terms`` that each belongs to."""
        a, n = self.ends[terms], self.ends[terms + 1] - self.ends[terms]
        of = np.repeat(np.arange(len(terms)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return self.positions[at], of

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        want = terms * self.span + positions
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (positions >= 0)

    def place(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Where in ``positions`` the first posting of each term at or past each position is, or the end of the term's."""
        return np.searchsorted(self.keys, terms * self.span + np.clip(positions, 0, self.span - 1))

    def next_after(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The first posting of each term past each position, or -1."""
        at = np.searchsorted(self.keys, terms * self.span + positions, "right")
        ok = at < self.ends[terms + 1]
        return np.where(ok, self.positions[np.minimum(at, len(self.positions) - 1)], -1)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


class Phrases:
    """Distinct phrases of a block of items: a matrix of term numbers, lengths, and pairs of a phrase and an item's number."""

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[bytes, int] = {}
        self.names = list(dict.fromkeys(item for item, _ in items))
        number = {item: k for k, item in enumerate(self.names)}
        of = []
        for item, words in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
            for i in range(max(1, len(ids) - width + 1)):
                of.append((rows.setdefault(ids[i : i + width].tobytes(), len(rows)), number[item]))
        pairs = np.unique(np.array(of, np.int64).reshape(-1, 2), axis=0)
        self.item = pairs[:, 1].astype(np.int32)
        #: Where each phrase's items begin, and the end.
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.length = np.array([len(r) // 4 for r in rows], np.int64)
        self.terms = np.full((len(rows), width), -1, np.int32)
        for k, r in enumerate(rows):
            self.terms[k, : len(r) // 4] = np.frombuffer(r, np.int32)

    def items_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items' numbers of each of the phrases, one after another, and the index in ``rows`` that each belongs to."""
        n = self.first[rows + 1] - self.first[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return self.item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[rows], n)], of

    def local(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """The phrases all of whose terms the segment has, and their terms there."""
        to = np.fromiter((segment.terms.get(w, -1) for w in self.vocabulary), np.int64, len(self.vocabulary))
        here = np.where(self.terms >= 0, to[self.terms], -2)
        rows = np.flatnonzero((here != -1).all(axis=1))
        return rows, here[rows]


def exact_hits(segment: Segment, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every occurrence, within one document."""
    rows, terms = phrases.local(segment)
    if not len(rows) or not len(segment.keys):
        return rows[:0], rows[:0]
    size = np.diff(segment.ends)
    rarity = np.where(terms >= 0, size[np.maximum(terms, 0)], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    starts, of = segment.lists(terms[np.arange(len(rows)), order[:, 0]])
    starts = starts - order[of, 0]
    keep = starts >= 0
    starts, of = starts[keep], of[keep]
    for k in range(1, terms.shape[1]):
        offset = order[of, k]
        term = terms[of, offset]
        keep = (term < 0) | segment.holds(np.maximum(term, 0), starts + offset)
        starts, of = starts[keep], of[keep]
    keep = segment.owner(starts) == segment.owner(starts + phrases.length[rows[of]] - 1)
    return rows[of[keep]], starts[keep]


def near_hits(segment: Segment, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, end) where its terms follow each other in order, with at most ``slop`` other words between in all."""
    rows, terms = phrases.local(segment)
    if not len(rows) or not len(segment.keys):
        return rows[:0], rows[:0], rows[:0]
    size, length = np.diff(segment.ends), phrases.length[rows]
    rare = np.where(terms >= 0, size[np.maximum(terms, 0)], np.iinfo(np.int64).max).argmin(axis=1)
    # from the postings of the rarest term back to those of the first term within reach
    there, of = segment.lists(terms[np.arange(len(rows)), rare])
    first = terms[of, 0]
    low, high = (segment.place(first, there - rare[of] - more) for more in (slop, -1))
    n = np.maximum(0, high - low)
    of = np.repeat(of, n)
    starts = segment.positions[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    both = np.unique(of * segment.span + starts)  # from several of the rarest term's postings
    of, starts = both // segment.span, both % segment.span
    at = starts.copy()
    for k in range(1, terms.shape[1]):
        term = terms[of, k]
        to = np.where(term >= 0, segment.next_after(np.maximum(term, 0), at), at)
        keep = (to >= 0) & (to - starts <= length[of] - 1 + slop)
        starts, of, at = starts[keep], of[keep], to[keep]
    keep = segment.owner(starts) == segment.owner(at)
    return rows[of[keep]], starts[keep], at[keep] + 1


def item_blocks(items: DataFrame, item_col: str, text_col: str, width: int, block_words: int):
    """The test set, streamed to the driver and given out in blocks of at most so many words (or of one item)."""
    block, size = [], 0
    for item, text in items.select(item_col, text_col).toLocalIterator():
        words = words_of(text.encode()) if text and item is not None else []
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield Phrases(block, width)
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    if block:
        yield Phrases(block, width)


def _segments(batches):
    for batch in batches:
        for i in range(batch.num_rows):  # one by one, without a copy of all
            yield Segment(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *(c[i].as_buffer() for c in batch.columns[2:]))


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document of the index: ``doc``, ``n_words``, ``spans`` (disjoint hit spans in words, end exclusive)
    and ``items`` (ids of items with a window in it, sorted). An item's windows are its runs of ``width`` words, or all of it."""
    spark = index.sparkSession
    kind, item = index.schema["docs"].dataType.elementType.simpleString(), items.schema[item_col].dataType.simpleString()
    doc_type, item_type = _arrow(index.schema["docs"].dataType.elementType), _arrow(items.schema[item_col].dataType)
    schema = f"number bigint, doc_no int, doc {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<{item}>"

    def scan(blocks):
        def run(batches):
            import pyarrow as pa

            for s in _segments(batches):
                starts, ends, named = [], [], [set() for _ in s.docs]
                for block in blocks:
                    phrases = block.value
                    row, start = exact_hits(s, phrases)
                    starts.append(start), ends.append(start + phrases.length[row])
                    number, of = phrases.items_of(row)
                    names, doc = phrases.names, s.owner(start)
                    pair = np.unique(doc[of] * len(names) + number) if len(row) else row
                    for d, k in zip((pair // max(1, len(names))).tolist(), (pair % max(1, len(names))).tolist(), strict=True):
                        named[d].add(names[k])
                start = np.concatenate(starts) if starts else np.empty(0, np.int64)
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(np.concatenate(ends)[order]) if len(order) else start
                doc = s.owner(start)
                # a span begins where the one before, of the same document, has ended
                fresh = np.ones(len(start), bool)
                fresh[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(fresh)
                last = np.concatenate([first[1:], [len(start)]]) - 1 if len(first) else first
                spans = [[] for _ in s.docs]
                for d, a, b in zip(doc[first].tolist(), start[first].tolist(), end[last].tolist(), strict=True):
                    spans[d].append({"start": a - int(s.starts[d]), "end": b - int(s.starts[d])})
                n = len(s.docs)
                cols = [pa.array([s.number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.docs, doc_type), pa.array(np.diff(s.starts), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in named], pa.list_(item_type))]
                yield pa.RecordBatch.from_arrays(cols, names=["number", "doc_no", "doc", "n_words", "spans", "items"])

        return index.mapInArrow(tidy(run), schema)

    every = _scans(spark, scan, item_blocks(items, item_col, text_col, width, block_words))
    if len(every) == 1:
        return every[0].select("doc", "n_words", "spans", "items")
    every = functools.reduce(DataFrame.unionByName, every)
    every = every.groupBy("number", "doc_no", "doc", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return every.select("doc", "n_words", merged("spans").alias("spans"), "items")


def _scans(spark: SparkSession, scan, blocks) -> list[DataFrame]:
    """The results of all scans. A single one is lazy; of several each is written and its blocks are let go before the next."""
    done, held, scratch = [], [], Scratch(spark, "scans")
    for block in blocks:
        if len(held) == SCAN_BLOCKS:
            done.append(scratch.write(scan(held), f"scan{len(done)}"))
            for b in held:
                b.destroy()
            held = []
        held.append(spark.sparkContext.broadcast(block))
    if held or not done:
        last = scan(held)
        done.append(scratch.write(last, f"scan{len(done)}") if done else last)
    return done


def merged(spans: str):
    """Sorted spans with those that touch or overlap made one."""
    join = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), join)


def proximity(index: DataFrame, items: DataFrame, slop: int, item_col: str = "item_id", text_col: str = "text", width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc``, ``item``, ``start``, ``end`` of every place where a window's words follow each other in order within ``slop`` extra words."""
    spark = index.sparkSession
    doc_type, item_type = _arrow(index.schema["docs"].dataType.elementType), _arrow(items.schema[item_col].dataType)
    schema = f"doc {index.schema['docs'].dataType.elementType.simpleString()}, item {items.schema[item_col].dataType.simpleString()}, start bigint, end bigint"

    def scan(blocks):
        def run(batches):
            import pyarrow as pa

            types = [doc_type, item_type, pa.int64(), pa.int64()]
            for s in _segments(batches):
                for block in blocks:
                    phrases = block.value
                    row, start, end = near_hits(s, phrases, slop)
                    doc = s.owner(start)
                    number, of = phrases.items_of(row)
                    places = zip(doc[of].tolist(), number.tolist(), (start - s.starts[doc])[of].tolist(), (end - s.starts[doc])[of].tolist(), strict=True)
                    out = [(s.docs[d], phrases.names[k], a, b) for d, k, a, b in places]
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["doc", "item", "start", "end"])

        return index.mapInArrow(tidy(run), schema)

    return functools.reduce(DataFrame.unionByName, _scans(spark, scan, item_blocks(items, item_col, text_col, width, block_words))).distinct()


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def flag(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """Builds the index in the shared folder and searches it: see ``search``."""
    index = Scratch(docs.sparkSession, "postings").write(build_index(docs, id_col, text_col), "segments")
    return search(index, items, width=width)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those inside a benchmark window, and the items found."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = flag(docs.select("doc_id", "text"), items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP2_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
win AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM w WHERE side = 'b' AND len(ws) > 0)),
spots AS (
  SELECT id AS doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE side = 'd' AND len(ws) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM spots JOIN win USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT w.id AS doc_id, len(w.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON words.doc_id = w.id LEFT JOIN items ON items.doc_id = w.id WHERE w.side = 'd'"""
