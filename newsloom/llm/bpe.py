"""Byte-level BPE encoding and decoding, and the pre-token splitting that token counts share.

Method: the distinct pre-tokens of a batch go to length buckets of padded matrices. In each round every row merges its leftmost
pair of minimum rank; ranks come from a hashed pair table; then rows and finished rows are compacted. Rows over ``WIDEST`` bytes
(long runs without a break) are merged in matrices too, and in a round of these a row also merges the further places of that
same pair, left to right, which would be the next rounds' leftmost minima. Only if one of these merges makes a pair of a lower
rank does the row merge the leftmost place alone. So the rounds of a long row are as many as the ranks it merges, not its bytes.

Null text is the empty text: no ids. Repeated rows are encoded each; empty tables stay empty; other columns pass through. A very
long text is one row of a slice of its own; a very long pre-token is a matrix of one row, 40 bytes a byte of it.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import in_slices, map_arrow, quoted

#: Bytes of rows that merge one pair a round, and cells of a matrix.
WIDEST, CELLS = 64, 1 << 20
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Open addressing over keys (left id, right id) -> merged id, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        todo, at, self.reach = np.arange(len(keys)), self._slot(keys), 1
        while len(todo):
            free = self.keys[at[todo]] == -1
            put, first = np.unique(at[todo[free]], return_index=True)
            who = todo[free][first]
            self.keys[put], self.values[put] = keys[who], values[who]
            todo = np.setdiff1d(todo, who, assume_unique=True)
            lost = self.keys[at[todo]] != -1
            at[todo[lost]] = (at[todo[lost]] + 1) & (size - 1)
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, which are ranks too; NONE where the pair doesn't merge or a side is padding."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        at = self._slot(flat)
        there = self.keys[at]
        out = np.where(there == flat, self.values[at], NONE)
        open_ = np.flatnonzero((there != flat) & (there != -1) & (flat >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at[open_]]
            hit = there == flat[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out.reshape(keys.shape)


class BPE:
    """An encoder over a rank table; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.pairs = PairTable(keys, np.array(merged, np.int32))

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        out: list = [None] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 2
        while width <= WIDEST:
            low = width // 2 if width > 2 else 0
            rows = np.flatnonzero((length > low) & (length <= width))
            for some in np.array_split(rows, -(-len(rows) * width // CELLS)) if len(rows) else ():
                self._bucket(pieces, some, length[some], width, out)
            width *= 2
        long = np.flatnonzero(length > WIDEST)
        while len(long):
            low = int(length[long].min())
            rows = long[length[long] <= 2 * low]
            for some in np.array_split(rows, min(len(rows), -(-len(rows) * 2 * low // CELLS))):
                self._long_bucket(pieces, some, length[some], out)
            long = np.setdiff1d(long, rows, assume_unique=True)
        for i in np.flatnonzero(length == 0):
            out[i] = np.empty(0, np.int32)
        return out

    def _bucket(self, pieces, rows, length, width, out) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        ids = self.byte[raw]
        ids[np.arange(width) >= length[:, None]] = -1
        ranks = np.full(ids.shape, NONE, np.int32)  # the last column never merges
        ranks[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == NONE
            if done.any():
                for i, row in zip(rows[done], ids[done], strict=True):
                    out[i] = row[row >= 0]
                go = ~done
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            ids[every, at] = best
            cols = np.arange(ids.shape[1] - 1)
            take = cols + (cols > at[:, None])  # closes the gap that the right partner leaves
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ranks[:, -1] = NONE
            if ids.shape[1] == 1:
                continue
            here = np.minimum(at, ids.shape[1] - 2)
            fits = at <= ids.shape[1] - 2
            new = self.pairs(ids[every, here], ids[every, here + 1])
            ranks[every[fits], at[fits]] = new[fits]
            before = at > 0
            ranks[every[before], at[before] - 1] = self.pairs(ids[every[before], at[before] - 1], ids[every[before], at[before]])

    def _long_bucket(self, pieces, rows, length, out) -> None:
        """As ``_bucket``, with all places of a row's least pair in a round."""
        width = int(length.max())
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        ids = self.byte[raw]
        ids[np.arange(width) >= length[:, None]] = -1
        # two columns of padding, so that each place has a neighbour and one after that
        ids = np.pad(ids, ((0, 0), (0, 2)), constant_values=-1)
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        while True:
            least = ranks.min(axis=1)
            done = least == NONE
            if done.any():
                for i, row in zip(rows[done], ids[done], strict=True):
                    out[i] = row[row >= 0]
                rows, ids, ranks, least = rows[~done], ids[~done], ranks[~done], least[~done]
                if not len(rows):
                    return
            r, c = np.nonzero(ranks == least[:, None])
            # of places in a row one after another (aaaa) every second, from the left
            fresh = np.ones(len(r), bool)
            fresh[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
            pick = (np.arange(len(r)) - run) % 2 == 0
            follows = np.concatenate([[False, False], ~fresh[2:] & ~fresh[1:-1]])[pick] if len(r) > 2 else np.zeros(pick.sum(), bool)
            r, c = r[pick], c[pick]
            # pairs that are there after each merge, with what is left of it merged and what is right of it not yet
            before = np.where(follows, least[r], ids[r, np.maximum(c - 1, 0)])
            before[c == 0] = -1
            early = np.minimum(self.pairs(before, least[r]), self.pairs(least[r], ids[r, c + 2])) < least[r]
            if early.any():
                alone = np.zeros(len(rows), bool)
                alone[r[early]] = True
                first = np.ones(len(r), bool)
                first[1:] = r[1:] != r[:-1]
                r, c = r[first | ~alone[r]], c[first | ~alone[r]]
            ids[r, c] = least[r]
            ids[r, c + 1] = -1
            keep = ids >= 0
            n = keep.sum(axis=1)
            # where merged tokens come to stand
            c = c - _ranks_within(r)
            mask = np.arange(int(n.max()) + 2) < n[:, None]
            ids, old, ranks, old_ranks = np.full(mask.shape, -1, np.int32), ids, np.full(mask.shape, NONE, np.int32), ranks
            ids[mask], ranks[mask] = old[keep], old_ranks[keep]
            ranks[r, c] = self.pairs(ids[r, c], ids[r, c + 1])
            r, c = r[c > 0], c[c > 0] - 1
            ranks[r, c] = self.pairs(ids[r, c], ids[r, c + 1])


def _ranks_within(rows: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal rows."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))


class PieceCache:
    """What a function gives for pre-tokens, kept for a task; it's emptied at ``limit`` entries or ``most_chars`` of them."""

    def __init__(self, compute, limit: int = 300_000, most_chars: int = 8_000_000):
        self.compute, self.limit, self.most_chars, self.known, self.held = compute, limit, most_chars, {}, 0

    def __call__(self, pieces: set[str]) -> dict:
        if len(self.known) > self.limit or self.held > self.most_chars:
            self.known.clear()
            self.held = 0
        if fresh := [p for p in pieces if p not in self.known]:
            self.known.update(zip(fresh, self.compute([p.encode() for p in fresh]), strict=True))
            self.held += sum(map(len, fresh))
        return self.known


#: Encoders of a worker by their rank table: a worker serves many tasks.
_ENCODERS: dict[int, BPE] = {}


def encoder_of(ranks) -> BPE:
    """The encoder of a broadcast rank table, made once a worker."""
    if ranks.value is not None and id(ranks.value) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(ranks.value)] = BPE(ranks.value)
    return _ENCODERS[id(ranks.value)]


#: Characters, and token ids, of a slice.
SLICE_CHARS, SLICE_IDS = 2_000_000, 200_000


def encode(spark: SparkSession, df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """Adds ``out``, the array of token ids of ``text``; a column of that name is replaced. ``keep_text`` false: without ``text``.

    The rank file is read once on the driver and sent to the executors: a vocabulary is bounded (here
    about 1 MB), whatever the rows are.
    """
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    kept = [c for c in df.columns if c.lower() != out.lower()]
    given = [c for c in kept if keep_text or c != text]
    schema = T.StructType([*(df.schema[c] for c in given), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import regex

        find = regex.compile(pattern).findall
        encoder = encoder_of(ranks)
        cache = PieceCache(lambda pieces: [ids.tobytes() for ids in encoder.encode_pieces(pieces)])
        for batch in batches:
            texts = batch.column(kept.index(text))
            for a, b in in_slices(pc.binary_length(texts).to_pylist(), SLICE_CHARS):
                split = [find(t) if t else [] for t in texts.slice(a, b - a).to_pylist()]
                known = cache(set().union(*split))
                packs = [b"".join(map(known.__getitem__, s)) for s in split]
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packs])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packs), np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(kept.index(c)).slice(a, b - a) for c in given), lists], names=[*given, out])

    return map_arrow(df.select(*map(quoted, kept)), run, schema)


def decode(spark: SparkSession, df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds ``out``, the bytes that ``ids`` stand for (null for null; a column of that name is replaced); an unknown id is an error."""
    tokens = spark.sparkContext.broadcast({i: t for t, i in load_ranks(ranks_path).items()})
    kept = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        table = np.full(max(tokens.value, default=-1) + 1, None, object)
        for i, t in tokens.value.items():
            table[i] = t
        for batch in batches:
            lists = batch.column(kept.index(ids))
            for a, b in in_slices(lists.value_lengths().to_pylist(), SLICE_IDS):
                some = lists.slice(a, b - a)
                flat = some.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and flat.min() < 0:
                    raise ValueError("an id below zero")
                parts = table[flat].tolist()
                n = some.value_lengths()
                ends = np.cumsum(n.fill_null(0).to_numpy(zero_copy_only=False)).tolist()
                made = [b"".join(parts[x:y]) if ok else None for x, y, ok in zip([0, *ends], ends, n.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(made, pa.binary())], names=[*kept, out])

    return map_arrow(df.select(*map(quoted, kept)), run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token count, digest of the ids, digest of the bytes decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(spark, docs, path, public_tokenizers.PATTERN, keep_text=False)
    return decode(spark, coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
