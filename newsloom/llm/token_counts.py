"""Token counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie; each node has a failure link and the number of tokens that are popped when the
link is followed. One pass over a word's bytes then counts its pieces, without building them. Words for
which some suffix has no match count as one unknown token. Null or empty text: zero. Repeated rows are counted each; empty tables
stay empty; other columns pass through, but such as are named like the counts. A very long text is a slice of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newsloom.llm.bpe import SLICE_CHARS, PieceCache, load_ranks
from newsloom.llm.common import in_slices, map_arrow, quoted


class LongestMatch:
    """Counts for words of bytes. ``inner``: the pieces that may stand after the first (all, by default)."""

    def __init__(self, vocabulary, inner=None):
        first = [bytes(t) for t in vocabulary if t]
        later = first if inner is None else [bytes(t) for t in inner if t]
        self.next: list[dict[int, int]] = [{}]
        ends = {self._add(0, t): t for t in first}
        self.root, self.loop = 0, 0
        if inner is not None:
            self.next.append({})
            self.loop = len(self.next) - 1
            ends |= {self._add(self.loop, t): t for t in later}
        n = len(self.next)
        self.fail, self.popped = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        order = [(self.root, None, -1)] + ([(self.loop, None, -1)] if self.loop != self.root else [])
        for v, up, byte in order:  # breadth first; the list grows while it's read
            if v in ends:
                self.fail[v], self.popped[v] = self.loop, 1
            elif up is not None:
                at, n_popped = self.fail[up], self.popped[up]
                while at >= 0 and byte not in self.next[at]:
                    n_popped, at = n_popped + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[v], self.popped[v] = self.next[at][byte], n_popped
            order += [(w, v, b) for b, w in self.next[v].items()]

    def _add(self, at: int, token: bytes) -> int:
        for b in token:
            if b not in self.next[at]:
                self.next[at][b] = len(self.next)
                self.next.append({})
            at = self.next[at][b]
        return at

    def __call__(self, word: bytes) -> int:
        go, fail, popped, at, n = self.next, self.fail, self.popped, self.root, 0
        for b in word:
            while (to := go[at].get(b)) is None:
                if fail[at] < 0:
                    return 1
                n, at = n + popped[at], fail[at]
            at = to
        while at != self.loop:
            if at == self.root:
                break
            if fail[at] < 0:
                return 1
            n, at = n + popped[at], fail[at]
        return int(n)


def count_tokens(spark: SparkSession, df: DataFrame, vocabulary, pattern: str, text: str = "text", out: str = "n_tokens", inner=None) -> DataFrame:
    """Adds ``out``, the word pieces of ``text``, and ``n_words``, its pre-tokens; such columns are replaced."""
    pieces = spark.sparkContext.broadcast((list(vocabulary), inner))  # a vocabulary is bounded
    kept = [c for c in df.columns if c.lower() not in (out.lower(), "n_words")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_words", T.LongType(), False), T.StructField(out, T.LongType(), False)])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import regex

        find, count = regex.compile(pattern).findall, LongestMatch(*pieces.value)
        cache = PieceCache(lambda words: [count(w) for w in words])
        for batch in batches:
            texts = batch.column(kept.index(text))
            for a, b in in_slices(pc.binary_length(texts).to_pylist(), SLICE_CHARS):
                split = [find(t) if t else [] for t in texts.slice(a, b - a).to_pylist()]
                get = cache(set().union(*split)).__getitem__
                made = [pa.array([len(s) for s in split], pa.int64()), pa.array([sum(map(get, s)) for s in split], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *made], names=[*kept, "n_words", out])

    return map_arrow(df.select(*map(quoted, kept)), run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pre-tokens and greedy longest-match tokens under the 50k byte vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return count_tokens(spark, docs, vocabulary, public_tokenizers.PATTERN).select("doc_id", "n_words", "n_tokens")
