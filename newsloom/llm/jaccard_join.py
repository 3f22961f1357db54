"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as classes of linked documents.

How it finds every link without making all pairs:

1. A document's set is hashed; equal sets are one node, so exact copies cost nothing further.
2. Inverted lists: a node enters those of its first shingles in hash order, ``n - T + l`` of ``n`` where ``T`` is
   the overlap that it needs. Two similar nodes share at least ``l`` of these, the smaller's ``l``. Lists are built by
   pages of the hash range, and travel packed.
3. T-occurrence search: for each node its lists (of nodes no smaller) are merged by DivideSkip: the longest are set
   aside, the short ones heap-merged, and those that occur often enough are probed in the long ones by binary
   search. Lists over ``longest`` (boilerplate, large groups) aren't merged at all: they lower the count needed, and a
   node whose count they could meet alone is joined to them by a star instead of by pairs.
   Of the too common shingles a node takes part in as many as it needs to meet all that it must, the least common first.
4. What may be linked falls into coarse classes. Sets go to their coarse class once, and links are decided exactly there.
   An index of the leaders of the classes found so far counts a node's overlap with each; as Jaccard distance is a metric,
   other members are compared only if their distance from the leader differs from the node's by no more than the link's.
   Classes too large for one task first lose, in distributed rounds of the same test, the nodes that this bound settles;
   of what stays too large, all pairs of parts are resolved.

Shingles, words and sets are known by 64-bit hashes: two that differ are taken for equal with chance 2^-64 a pair.

Words are runs without ASCII white space, A-Z lower-cased. Null or empty texts, or texts without words, have empty sets
and are linked with nothing. Rows that repeat an id are one document with the links of each; rows with a null id get a
null component and link nothing. Whole texts count, however long (a task holds a few megabytes of them, or one text, and their sets);
columns other than id and text don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, WordHasher, as_bytes, mix, shingle_set, sliced, tidy
from newsloom.llm.components import components, with_least

#: Postings that a page should hold, and a task's pack; pairs of postings that a task makes at once.
PAGE_POSTINGS, PACK_POSTINGS, SLICE_PAIRS = 1 << 19, 1 << 19, 1 << 18
#: Nodes and shingles of a coarse class that one task resolves.
CLASS_NODES, CLASS_SHINGLES = 32_768, 4_000_000
#: How much a probe of a long list costs, as against a merged posting, and the roots of which one node each is tried first.
PROBE, TRIES = 8, 8
#: Leaders of a large class in a round.
LEADERS = 16
#: Bytes of leaders' sets that are sent to the executors at once.
LEADER_BYTES = 32_000_000
#: Rows of leaders' classes, and of classes with their distances, that are broadcast; more are joined by a shuffle.
MOST_HOMES, MOST_CLASSES = 1_000_000, 10_000


def needed(n: int, num: int, den: int) -> int:
    """The least overlap of a set of ``n`` with any that is similar enough."""
    return -(-num * n // den)


def spare(n: int, num: int, den: int) -> int:
    """``l``: how many of its listed shingles a node shares with any that's similar and no smaller."""
    return min(needed(n, num, den), 1 + max(4, n // 12)) if n else 0


def listed(n: int, num: int, den: int) -> int:
    return n - needed(n, num, den) + spare(n, num, den) if n else 0


def node_of(shingles: np.ndarray) -> int:
    """A set's node: a hash over all its sorted shingles, as a signed 64-bit number."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes(), 7) - (1 << 63)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def heap_merge(lists: list[list[int]]):
    """(value, times) over sorted lists, by a heap of their heads."""
    now, n = None, 0
    for v in heapq.merge(*lists):
        if v != now:
            if n:
                yield now, n
            now, n = v, 0
        n += 1
    if n:
        yield now, n


def n_long(n_lists: int, least: int, longest: int) -> int:
    """How many of the longest lists DivideSkip sets aside: fewer than ``least``, and the fewer the more a probe costs."""
    return min(n_lists, least - 1, int(least / (0.0085 * math.log2(max(2, longest)) + 1)))


def divide_skip(lists: list[np.ndarray], least: int) -> list[int]:
    """The values that stand in at least ``least`` (1 or more) of the sorted lists.

    The ``L`` longest are long, L < least; what stands in ``least - L`` short ones is probed in them.
    """
    lists = sorted(lists, key=len)
    if len(lists) < least:
        return []
    aside = n_long(len(lists), least, len(lists[-1]))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = [(v, n) for v, n in heap_merge([x.tolist() for x in short]) if n >= least - aside]
    if not found or not long:
        return [v for v, n in found if n >= least]
    values, times = np.array([v for v, _ in found], np.int64), np.array([n for _, n in found])
    for x in long:
        times += x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values
    return values[times >= least].tolist()


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """``doc``, ``n`` (shingles), ``node`` (null for an empty set)."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in sliced(batches, 1):
            sets = ((len(s), node_of(s) if len(s) else None) for s in (shingle_set(t, hasher, width) for t in as_bytes(batch.column(1))))
            n, node = zip(*sets, strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["doc", "n", "node"])

    return docs.mapInArrow(tidy(run), f"doc {kind}, n bigint, node bigint")


def postings(docs: DataFrame, width: int, pages: int, longest: int, num: int, den: int) -> DataFrame:
    """Packs of postings for the pages. Of a shingle that over ``longest`` of a batch's nodes list, the page gets so many as
    show that it's too common; the others go to pages of their own (negative), which are spread by node."""
    shift = np.uint64(64 - (pages - 1).bit_length()) if pages > 1 else None

    def run(batches):
        import pyarrow as pa

        def packed(nodes):
            ids = np.array(list(nodes), np.int64)
            sizes = np.array([n for n, _ in nodes.values()], np.int32)
            heads = [h for _, h in nodes.values()]
            h = np.concatenate(heads) if heads else np.empty(0, np.uint64)
            of = np.repeat(np.arange(len(heads), dtype=np.int32), [len(x) for x in heads]) if heads else np.empty(0, np.int32)
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
            page = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
            extra = place > longest
            page[extra] = -1 - (mix(ids[of[extra]].view(np.uint64)) >> np.uint64(48)).astype(np.int64) % max(16, pages)
            order = np.argsort(page, kind="stable")
            h, of, page = h[order], of[order], page[order]
            cut = np.flatnonzero(np.diff(page, prepend=page[0] - 1)) if len(page) else np.empty(0, np.int64)
            out = []
            for a, b in zip(cut, np.append(cut[1:], len(page)), strict=True):
                own, at = np.unique(of[a:b], return_inverse=True)
                out.append((int(page[a]), h[a:b].tobytes(), at.astype(np.int32).tobytes(), ids[own].tobytes(), sizes[own].tobytes()))
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page", "hashes", "at", "nodes", "sizes"])

        hasher, nodes, total = WordHasher(), {}, 0
        for batch in sliced(batches, 1):
            for ok, t in zip(batch.column(0).is_valid().to_pylist(), as_bytes(batch.column(1)), strict=True):
                if ok and len(s := shingle_set(t, hasher, width)) and (n := node_of(s)) not in nodes:
                    nodes[n] = (len(s), s[: listed(len(s), num, den)].copy())
                    total += len(nodes[n][1])
                    if total >= PACK_POSTINGS:
                        yield packed(nodes)
                        nodes, total = {}, 0
        if nodes:  # a task may have had no rows, or no others since its last pack
            yield packed(nodes)

    return docs.mapInArrow(tidy(run), "page bigint, hashes binary, at binary, nodes binary, sizes binary")


LISTS = "node bigint, size int, lens array<int>, partners array<bigint>, hot array<bigint>"


def inverted_lists(packs: DataFrame, longest: int, num: int, den: int) -> DataFrame:
    """For each node of a page: the lists it's in, each cut to the nodes that come after it by (size, node) and aren't too
    large, and the hashes of lists over ``longest``."""

    def page_out(parts: list[tuple], common: bool):
        h = np.concatenate([p[0] for p in parts])
        node = np.concatenate([p[1] for p in parts])
        size = np.concatenate([p[2] for p in parts])
        if not common:
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(h) else order
            h, node, size = h[order], node[order], size[order]
        order = np.lexsort((node, size, h))
        h, node, size = h[order], node[order], size[order]
        if len(h):
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])  # copies of a node
            h, node, size = h[fresh], node[fresh], size[fresh]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        length = np.diff(np.append(first, len(h)))
        hot = np.repeat(length > longest, length) if not common else np.ones(len(h), bool)
        end = np.repeat(first + length, length)
        # some nodes at a time: their pairs are many more than their postings
        count = np.where(hot, 0, end - np.arange(len(h)) - 1)
        by = np.argsort(node, kind="stable")
        by = by[(count[by] > 0) | hot[by]]
        start = np.flatnonzero(np.concatenate([[True], node[by][1:] != node[by][:-1]])) if len(by) else np.empty(0, np.int64)
        start = np.append(start, len(by))
        pairs = np.concatenate([[0], np.cumsum(count[by])])[start]
        a = 0
        while a + 1 < len(start):
            b = max(a + 1, int(np.searchsorted(pairs, pairs[a] + SLICE_PAIRS, "right")) - 1)
            yield lists_out(h, node, size, hot, count, by[start[a] : start[b]])
            a = b

    def lists_out(h, node, size, hot, count, by):
        import pyarrow as pa

        n = count[by]
        of = np.repeat(np.arange(len(by)), n)
        dst = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + by[of] + 1
        fits = size[dst].astype(np.int64) * num <= size[by[of]].astype(np.int64) * den
        of, dst = of[fits], dst[fits]
        lens = np.bincount(of, minlength=len(by)).astype(np.int32)
        # one row a node: its entries together
        some = (lens > 0) | hot[by]
        by, lens = by[some], lens[some]
        rows = np.flatnonzero(np.concatenate([[True], node[by][1:] != node[by][:-1]])) if len(by) else np.empty(0, np.int64)
        cold, is_hot = lens > 0, hot[by]

        def ragged(per_entry, values, kind):
            ends = np.concatenate([[0], np.cumsum(per_entry)])
            return pa.ListArray.from_arrays(pa.array(np.append(ends[rows], ends[-1]), pa.int32()), pa.array(values, kind))

        columns = [pa.array(node[by[rows]], pa.int64()), pa.array(size[by[rows]], pa.int32()), ragged(cold, lens[cold], pa.int32()), ragged(lens, node[dst], pa.int64()), ragged(is_hot, h[by[is_hot]].view(np.int64), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["node", "size", "lens", "partners", "hot"])

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for i, page in enumerate(batch.column(0).to_pylist()):
                if parts and (page != now or page < 0):
                    yield from page_out(parts, now < 0)
                    parts = []
                h, at, nodes, sizes = (np.frombuffer(c[i].as_buffer(), k) for c, k in zip(batch.columns[1:], (np.uint64, np.int32, np.int64, np.int32), strict=True))
                now = page
                parts.append((h.copy(), nodes[at], sizes[at]))
        if parts:
            yield from page_out(parts, now < 0)

    return packs.repartition("page").sortWithinPartitions("page").mapInArrow(tidy(run), LISTS)


def search(lists: DataFrame, num: int, den: int) -> DataFrame:
    """``a``, ``b``: a pair that may be linked (``hot`` null), or a node and the hash of a list that it may have to meet others by:
    ``b`` such lists are enough, if all nodes take theirs by one order."""

    def one(node, size, lists, hot):
        l, n_hot = spare(size, num, den), len(hot)
        pairs = divide_skip(lists, l - n_hot if l > n_hot else 1) if lists else []
        for other in pairs:
            yield node, other, None
        # a node no larger needs this many shared, or this node does itself
        least = spare(needed(size, num, den), num, den)
        for x in hot if n_hot >= least else ():
            yield node, n_hot - least + 1, x

    def run(batches):
        import pyarrow as pa

        now, size, mine, hot = None, 0, [], set()
        for batch in batches:
            out = []
            for node, n, lens, partners, common in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4)), strict=True):
                if node != now:
                    if now is not None:
                        out += one(now, size, mine, hot)
                    now, size, mine, hot = node, n, [], set()
                    if len(out) >= 50_000:
                        yield table(out)
                        out = []
                flat = partners.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(lens.values.to_numpy(zero_copy_only=False))
                mine += [np.sort(x) for x in np.split(flat, ends[:-1])] if len(ends) else []
                hot.update(common.as_py())
            yield table(out)
        if now is not None:
            yield table(list(one(now, size, mine, hot)))

    def table(out):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["a", "b", "hot"])

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(tidy(run), "a bigint, b bigint, hot bigint")


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> tuple[bool, float]:
    """Whether two sets are similar enough, decided in whole numbers, and their distance."""
    both = overlap(a, b)
    union = len(a) + len(b) - both
    return den * both >= num * union, 1 - both / union


class Lists:
    """Inverted lists over the sets of a coarse class: every shingle that two of them have, the rarest first; the nodes in ascending size.

    A node's lists are so in ascending length. Entries are kept as sorted numbers ``shingle * nodes + node``, so that cuts of many
    lists, and probes of them, are one binary search over arrays.
    """

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets], np.int64)
        self.order = np.argsort(n, kind="stable")
        self.size, self.n = n[self.order], len(sets)
        hashes = np.concatenate([sets[i] for i in self.order])
        at = np.argsort(hashes, kind="stable").astype(np.int32)
        hashes = hashes[at]
        own = np.repeat(np.arange(self.n, dtype=np.int32), self.size)[at]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        times = np.diff(np.append(first, len(hashes)))
        del hashes, at
        rarity = np.empty(len(first), np.int64)
        rarity[np.argsort(times, kind="stable")] = np.arange(len(first))
        shared = np.repeat(times > 1, times)
        self.keys = np.repeat(rarity * self.n, times)[shared] + own[shared]
        del own, shared
        self.keys.sort()
        own = (self.keys % self.n).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=self.n))])
        self.shingles = (self.keys // self.n)[np.argsort(own, kind="stable")]

    def entries(self, lists: np.ndarray, low: int, high: int) -> np.ndarray:
        """How often each node from ``low`` to ``high`` stands in the lists: they're merged."""
        a, b = np.searchsorted(self.keys, lists * self.n + low), np.searchsorted(self.keys, lists * self.n + high)
        n = b - a
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return np.bincount(self.keys[at] - np.repeat(lists * self.n + low, n), minlength=high - low)

    def probed(self, lists: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """In how many of the lists each node stands, by binary search."""
        want = (lists[None, :] * self.n + nodes[:, None]).ravel()
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want).reshape(len(nodes), len(lists)).sum(1)


def resolve(nodes: list[int], sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """The root (least node) of each node's class, exactly, for the nodes of one coarse class.

    T-occurrence search once more, over the class's own lists and by bands of sizes, each with the overlap that it needs: DivideSkip
    sets the longest lists aside, and only nodes that stand in enough of the others are counted in these. So what all nodes share
    (a template) makes no candidates. Of a node's candidates those that are in its class already need no count.
    """
    lists = Lists(sets)
    root, size = np.arange(lists.n), lists.size

    def link(i: int, others: np.ndarray) -> None:
        for r in np.unique(root[others]).tolist():
            if r != root[i]:
                root[root == r] = root[i]

    for i in range(lists.n if len(lists.keys) else 0):
        own, n = lists.shingles[lists.first[i] : lists.first[i + 1]], int(size[i])
        least = needed(n, num, den)
        if len(own) < least:
            continue
        edges = [least, least + (n - least) // 3, least + 2 * (n - least) // 3, n + 1]
        for low, high in zip(np.searchsorted(size, edges[:-1]).tolist(), np.searchsorted(size, edges[1:]).tolist(), strict=True):
            high = min(high, i)
            if low >= high:
                continue
            # the overlap that the band's smallest node needs
            least = -(-num * (n + int(size[low])) // (num + den))
            if len(own) < least:
                continue
            aside = n_long(len(own), least, high - low)
            # lists of shingles that no other node has would be the shortest: they're empty
            short, long = own[: len(own) - aside], own[len(own) - aside :]
            times = lists.entries(short, low, high)
            found = np.flatnonzero(times >= least - aside)
            found = found[root[low + found] != root[i]]
            for last in (False, True):
                if not len(found):
                    break
                test = found
                if not last:
                    # a promising node of each root first: one link is enough to be done with all of it
                    by = np.lexsort((-times[found], root[low + found]))
                    heads = by[np.flatnonzero(np.diff(root[low + found[by]], prepend=-1))]
                    if len(heads) > TRIES:
                        continue
                    test = found[heads]
                if len(test) * PROBE > high - low:
                    both = times[test] + lists.entries(long, low, high)[test]
                else:
                    both = times[test] + lists.probed(long, low + test)
                close = (num + den) * both >= num * (n + size[low + test])
                link(i, low + test[close])
                found = np.setdiff1d(found, test, assume_unique=True)
                found = found[root[low + found] != root[i]]
    names = np.array(nodes, np.int64)[lists.order]
    least_of = np.full(lists.n, np.iinfo(np.int64).max)
    np.minimum.at(least_of, root, names)
    out = np.empty(lists.n, np.int64)
    out[lists.order] = least_of[root]
    return out.tolist()


def resolve_classes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a``, ``b``: each node and its class's root, coarse class by coarse class."""

    def run(batches):
        import pyarrow as pa

        def out():
            roots = resolve(nodes, own, num, den)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])

        now, nodes, own = None, [], []
        for batch in batches:
            for i, (c, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if c != now and nodes:
                    yield out()
                    nodes, own = [], []
                now = c
                if not nodes or nodes[-1] != n:
                    nodes.append(n), own.append(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64).copy())
        if nodes:
            yield out()

    return sets.select("comp", "node", "shingles").repartition("comp").sortWithinPartitions("comp", "node").mapInArrow(tidy(run), "a bigint, b bigint")


def settle_large(sets: DataFrame, scratch: Scratch, num: int, den: int, class_nodes: int, class_shingles: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds over the coarse classes that are too large for a task: every node is compared with some leaders of its class. Nodes
    linked with one get a home; homes that share a node are one. A node goes only if a leader of its home is so near that none
    outside that home, settled or open, can be linked with it. Classes that rounds hardly lessen are resolved by pairs of parts.
    Gives edges, and rest classes small enough."""
    spark, reach = sets.sparkSession, 1 - num / den + 1e-9
    now, edges, small, last, k = sets.withColumn("home", F.lit(None).cast("bigint")), [], [], None, 0
    while True:
        sizes = now.groupBy("comp").agg(F.count("*").alias("nodes"), F.sum(F.length("shingles") / 8).alias("total"), F.count_if(F.col("home").isNull()).alias("open"))
        sizes = scratch.write(sizes, f"sizes{k}")
        fits = (F.col("nodes") <= class_nodes) & (F.col("total") <= class_shingles)
        if not sizes.filter(fits).isEmpty():
            small.append(scratch.write(now.join(sizes.filter(fits), "comp").select("comp", "node", "shingles"), f"small{k}", "snappy"))
        large = sizes.filter(~fits)
        # without open nodes there are no new leaders; and each round should settle or drop a tenth at least
        stuck = F.col("open") == 0
        if last is not None:
            large = large.join(last.select("comp", F.col("nodes").alias("nodes0"), F.col("open").alias("open0")), "comp")
            stuck |= (F.col("nodes") > 0.9 * F.col("nodes0")) & (F.col("open") > 0.9 * F.col("open0"))
        large = scratch.write(large.withColumn("stuck", stuck), f"large{k}")
        if not large.filter("stuck").isEmpty():
            parted = now.join(large.filter("stuck").select("comp", "nodes", "total"), "comp")
            small.append(_pairs_of_parts(scratch.write(parted.drop("home"), f"parted{k}", "snappy"), class_nodes, class_shingles))
        large, last = large.filter("NOT stuck").select("comp", "open"), sizes
        if large.isEmpty():
            return edges, small
        # some open nodes of each large class, by a hash of their own in each round: at most about LEADERS, one at least
        open_ = now.filter("home IS NULL").join(large, "comp").withColumn("luck", F.xxhash64("node", F.lit(k)))
        first = open_.groupBy("comp").agg(F.min_by("node", "luck").alias("first"))
        share = F.pmod(F.col("luck"), F.lit(1 << 30)) < (LEADERS - 1) * (1 << 30) / F.col("open")
        leaders = open_.join(first, "comp").filter(share | (F.col("node") == F.col("first"))).select("comp", "node", "shingles")
        near = []
        for block in _blocks(leaders):
            near.append(_distances(now, spark.sparkContext.broadcast(block), num, den))
        every = near[0]
        for more in near[1:]:
            every = every.unionByName(more)
        every = scratch.write(every, f"distances{k}", "snappy")
        to = every.select("node", F.explode("near").alias("leader")).filter("node <> leader")
        edges.append(scratch.write(to.select(F.col("node").alias("a"), F.col("leader").alias("b")), f"edges{k}"))
        every = every.withColumn("met", F.array_compact(F.concat("near", F.array("home")))).withColumn("first", F.array_min("met"))
        shared = every.filter("size(met) > 1").select(F.col("first").alias("a"), F.explode("met").alias("b")).distinct()
        homes = scratch.write(components(shared, scratch, f"homes{k}-"), f"homes{k}")

        def with_home(rows, of, name):
            found = homes.select(F.col("node").alias(of), F.col("root").alias("__root__"))
            return rows.join(_checked(found), of, "left").withColumn(name, F.coalesce("__root__", of)).drop("__root__")

        every = with_home(every, "first", "home")
        # for each leader the least distance of a node that isn't of its home: nodes of that home nearer than that by more than a link are done with
        far = every.select("comp", "home", F.posexplode(F.arrays_zip("leaders", "distances")).alias("place", "x"))
        far = with_home(far.select("comp", "home", "place", F.col("x.leaders").alias("leader"), F.col("x.distances").alias("d")), "leader", "own")
        outside = F.when(F.col("home").isNull() | (F.col("home") != F.col("own")), F.col("d"))
        far = far.groupBy("comp", "place").agg(F.first("own").alias("own"), F.coalesce(F.min(outside), F.lit(2.0)).alias("d"))
        far = scratch.write(far.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("place", "own", "d"))).alias("closest")), f"closest{k}")
        done = F.exists(F.zip_with("distances", "closest", lambda d, c: (c["own"] == F.col("home")) & (d < c["d"] - reach)), lambda x: x)
        now = every.join(_checked(far, MOST_CLASSES), "comp").filter(F.col("home").isNull() | ~done).select("comp", "node", "shingles", "home")
        if k:
            scratch.drop(f"distances{k - 1}")
        k += 1


def _checked(rows: DataFrame, most: int = MOST_HOMES) -> DataFrame:
    """A written table as a side that's broadcast, if it has at most so many rows."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _pairs_of_parts(rows: DataFrame, class_nodes: int, class_shingles: int) -> DataFrame:
    """Classes of ``nodes`` and ``total`` shingles in parts, of which a task holds about two: each part with each other one of its
    class is a class of its own, so that all pairs of nodes meet."""
    parts = (1 + F.floor(2 * F.greatest(F.col("nodes") / class_nodes, F.col("total") / class_shingles))).cast("bigint")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).filter("other <> own")
    return rows.select(F.xxhash64("comp", F.least("own", "other"), F.greatest("own", "other")).alias("comp"), "node", "shingles")


def _blocks(leaders: DataFrame):
    """Leaders by class, streamed to the driver; blocks of whole classes of about ``LEADER_BYTES``."""
    block, size, last = {}, 0, None
    for comp, node, shingles in leaders.orderBy("comp", "node").toLocalIterator():
        if comp != last and size > LEADER_BYTES:
            yield block
            block, size = {}, 0
        last = comp
        block.setdefault(comp, []).append((node, bytes(shingles)))
        size += len(shingles)
    yield block


def _distances(now: DataFrame, block, num: int, den: int) -> DataFrame:
    """The rows with the ``leaders`` of their class, those that are ``near`` enough for a link, and the ``distances`` of all."""
    schema = "comp bigint, node bigint, shingles binary, home bigint, leaders array<bigint>, near array<bigint>, distances array<double>"

    def run(batches):
        import pyarrow as pa

        own = {c: [(n, np.frombuffer(s, np.uint64)) for n, s in x] for c, x in block.value.items()}
        for batch in batches:
            pick = [i for i, c in enumerate(batch.column(0).to_pylist()) if c in own]
            batch = batch.take(pa.array(pick, pa.int64()))
            leaders, near, distances = [], [], []
            for c, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                test = [(n, *linked(s, x, num, den)) for n, x in own[c]]
                leaders.append([n for n, *_ in test]), near.append([n for n, yes, _ in test if yes]), distances.append([d for *_, d in test])
            lists = [pa.array(leaders, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64())), pa.array(distances, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["comp", "node", "shingles", "home", "leaders", "near", "distances"])

    return now.select("comp", "node", "shingles", "home").mapInArrow(tidy(run), schema)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``comp``, ``node``, ``shingles`` of the wanted (``rep``, ``node``, ``comp``): one document of each node, read again."""
    rows = docs.join(wanted.hint("shuffle_hash"), docs["doc"] == wanted["rep"]).select("comp", "node", "text")

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in sliced(batches, 2):
            made = [shingle_set(t, hasher, width) for t in as_bytes(batch.column(2))]
            keep = [i for i, (s, n) in enumerate(zip(made, batch.column(1).to_pylist(), strict=True)) if len(s) and node_of(s) == n]
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([made[i].tobytes() for i in keep], pa.binary())], names=["comp", "node", "shingles"])

    return rows.mapInArrow(tidy(run), "comp bigint, node bigint, shingles binary")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: Fraction = Fraction(3, 4), longest: int = 64, page_postings: int = PAGE_POSTINGS, class_nodes: int = CLASS_NODES, class_shingles: int = CLASS_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: ``doc``, ``n_shingles``, ``component`` (the least id reachable by links)."""
    num, den = similarity.numerator, similarity.denominator
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    known = scratch.write(profiles(docs, width), "profiles")
    n_listed = known.agg(F.sum(F.ceil(F.col("n") * (1 - num / den + 1 / 12)) + 5)).first()[0] or 0
    pages = 1 << max(0, int(n_listed // page_postings)).bit_length()
    lists = inverted_lists(postings(docs, width, pages, longest, num, den), longest, num, den)
    found = scratch.write(search(lists, num, den), "found")
    _free(spark)
    hot = found.filter("hot IS NOT NULL").select("a", "b", "hot")
    order = Window.partitionBy("a").orderBy("n", "hot")
    hot = with_least(hot, "hot", "a", hot.count()).withColumn("k", F.row_number().over(order)).filter("k <= b").select("a", "hot")
    hot = scratch.write(hot, "hot")
    stars = with_least(hot, "hot", "a", hot.count()).select("a", F.col("m").alias("b"))
    coarse = scratch.write(components(found.filter("hot IS NULL").select("a", "b").unionByName(stars), scratch, "coarse"), "coarse")
    reps = known.filter("node IS NOT NULL AND doc IS NOT NULL").groupBy("node").agg(F.min("doc").alias("rep"), F.max("n").alias("n"))
    wanted = scratch.write(reps.join(coarse, "node").select("rep", "node", F.col("root").alias("comp"), "n"), "wanted")
    sizes = wanted.groupBy("comp").agg(F.count("*").alias("nodes"), F.sum("n").alias("total"))
    is_large = (F.col("nodes") > class_nodes) | (F.col("total") > class_shingles)
    large = scratch.write(sizes.filter(is_large).select("comp"), "large")
    edges = []
    if large.isEmpty():
        edges.append(resolve_classes(sets_of(docs, wanted, width), num, den))
    else:
        edges.append(resolve_classes(sets_of(docs, wanted.join(large, "comp", "left_anti"), width), num, den))
        sets = scratch.write(sets_of(docs, wanted.join(large, "comp", "left_semi"), width), "sets", "snappy")
        more, rest = settle_large(sets, scratch, num, den, class_nodes, class_shingles)
        edges += more + [resolve_classes(x, num, den) for x in rest]
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    every = scratch.write(every, "links")
    _free(spark)
    roots = every.select(F.col("a").alias("node"), F.col("b").alias("root")) if len(edges) == 1 else components(every, scratch, "exact")
    ids = known.select("doc", "node").filter("node IS NOT NULL AND doc IS NOT NULL").join(roots, "node", "left").select("doc", F.coalesce("root", "node").alias("root"))
    ids = scratch.write(ids, "roots")
    ids = scratch.write(_by_document(ids, scratch, spark), "classes")
    scratch.drop("found", "hot", "coarse", "wanted", "large", "links", "sets", "roots", "merged")
    out = known.filter("doc IS NOT NULL").join(ids.withColumnRenamed("doc", "__doc__"), F.col("doc") == F.col("__doc__"), "left")
    out = out.select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))
    none = known.filter("doc IS NULL")  # rows without an id don't move
    return out.unionByName(none.select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component")))


def _by_document(ids: DataFrame, scratch: Scratch, spark: SparkSession) -> DataFrame:
    """``doc``, ``component``. Rows that repeat an id may have several roots: these are one class then."""
    twice = ids.groupBy("doc").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    if not twice.isEmpty():
        more = ids.join(twice.select("doc", "a"), "doc").select("a", F.col("root").alias("b"))
        roots = components(more, scratch, "repeated").withColumnRenamed("root", "least")
        ids = scratch.write(ids.join(roots, ids["root"] == roots["node"], "left").select("doc", F.coalesce("least", "root").alias("root")), "merged")
    return with_least(ids, "root", "doc", ids.count()).select("doc", F.col("m").alias("component")).distinct()


def _free(spark: SparkSession) -> None:
    """Shuffle files go once the driver's JVM finds that nothing refers to them."""
    spark._jvm.System.gc()


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its shingles and its class."""
    out = similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
