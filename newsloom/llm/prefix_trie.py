"""A trie of conversation prefixes, by chained digests.

Turns become digests of (role, text); a conversation's rows are streamed in order, and each prefix's digest chains the one before with
the turn's, so that equal digests are equal sequences. Every prefix is a row; grouped by depth and digest these are the trie's nodes,
counted before the shuffle, as the root has all conversations. For sums over subtrees each node is sent to all its ancestors, found by
the prefixes of the conversation that stands for it (its smallest member), within blocks of ``BLOCK`` depths; the heads of blocks form
a trie of their own, a ``BLOCK``-th as deep, that's summed in the same way. So a row is sent at most ``BLOCK`` times a level, however
long conversations are. A node's ends are joined into texts by ranges of (node, conversation), and only these are hashed in one task.

Turns stand in order of their number (null first), equal numbers by role and text; repeated rows are turns each. Null roles and texts are
empty. Rows without a conversation's id belong to none and are left out, whole texts are hashed, other columns don't matter, an empty
table gives no nodes.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, quoted, tidy

#: Depths of a block, within which nodes are sent to all ancestors.
BLOCK = 64
#: A parent of more than this many children, and a thousandth of the nodes, is broadcast.
HUB = 1000
#: Bytes of ids that are joined to one text.
TEXT_BYTES = 1 << 16
ROOT = hashlib.sha256(b"").digest()


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, without nulls in the latter two and without rows that belong to no conversation."""
    c = lambda name: F.col(quoted(name))
    return rows.select(c(conv).cast("long").alias("conv"), c(turn).alias("turn"), F.coalesce(c(role).cast("string"), F.lit("")).alias("role"), F.coalesce(c(text).cast("string"), F.lit("")).alias("text")).filter("conv IS NOT NULL")


def heads(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` turns of each conversation, cut before and after the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


def head_turns(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % 9


def borrowed(rows: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """The rows with ``own`` (1), and for every conversation the first turns of the one it's rebuilt from, ``conv - conv % group`` (``own`` 0).
    Those given to numbers that no conversation has are dropped when prefixes are made."""
    lent = heads(rows.filter(F.col("conv") % group == 0), most)
    to = F.filter(F.sequence(F.col("conv") - (group - 1), F.col("conv") + (group - 1)), lambda c: c - c % group == F.col("conv"))
    lent = lent.select(F.explode(to).alias("conv"), "turn", "role", "text", F.lit(0).alias("own"))
    return rows.withColumn("own", F.lit(1)).unionByName(lent)


def prefixes(rows: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: ``conv``, ``depth``, ``digest``, ``parent`` (its digest), ``bytes`` of its last text, ``ends``."""
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.select("conv", "own", "turn", "role", "text").repartition("conv").sortWithinPartitions("conv", "own", F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("conv", "own", F.unhex(said).alias("said"), F.octet_length("text").cast("long").alias("bytes"))  # keeps the order

    def run(batches):
        import pyarrow as pa

        kinds = {"conv": pa.int64(), "depth": pa.int64(), "digest": pa.binary(), "parent": pa.binary(), "bytes": pa.int64(), "ends": pa.bool_()}
        out = {k: [] for k in kinds}

        def add(*row):
            for k, v in zip(out, row, strict=True):
                out[k].append(v)

        def given():
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds.values(), strict=True)], names=list(kinds))
            for v in out.values():
                v.clear()
            return made

        now, lent, skip, last = None, [], 0, None

        def step(said, n):  # the row before is given once it's known whether it ends the conversation
            nonlocal last
            _, depth, digest, *_ = last
            add(*last, False)
            last = (now, depth + 1, hashlib.sha256(digest + said).digest(), digest, n)

        for batch in batches:
            for conv, own, said, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != now:
                    if last:
                        add(*last, True)
                    now, lent, last = conv, [], None
                if not own:
                    lent.append((said, n))
                    continue
                if last is None:  # its first own turn: what it borrows comes before
                    skip = head_turns(now)
                    last = (now, 0, ROOT, None, 0)
                    for x in lent[:skip]:
                        step(*x)
                if skip:
                    skip -= 1
                else:
                    step(said, n)
                if len(out["conv"]) >= 4096:
                    yield given()
        if last:
            add(*last, True)
        yield given()

    return rows.mapInArrow(tidy(run), "conv bigint, depth bigint, digest binary, parent binary, bytes bigint, ends boolean")


def nodes(prefix: DataFrame) -> DataFrame:
    """The trie's nodes: ``depth``, ``digest``, ``parent``, ``conv`` (the smallest member), ``n_convs``, ``bytes``."""
    return prefix.groupBy("depth", "digest", "parent", "bytes").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"))


def subtree_sums(values: DataFrame, paths: DataFrame, names: list[str], scratch: Scratch, block: int = BLOCK, level: int = 0) -> DataFrame:
    """``depth``, ``digest`` and the sums of ``names`` over each node's subtree, the node included.

    ``values``: ``depth``, ``digest``, ``conv`` and the nodes' own values. ``paths``: ``conv``, ``depth``, ``digest`` of the nodes that each
    ``conv`` of ``values`` passes."""
    within = lambda df: df.withColumn("block", F.floor(F.col("depth") / block))
    sums = [F.sum(n).alias(n) for n in names]
    up = paths.select(F.col("conv").alias("c"), F.col("depth").alias("up"), F.col("digest").alias("above"), F.floor(F.col("depth") / block).alias("b"))
    low = within(values)
    sent = low.join(up, (low["conv"] == up["c"]) & (low["block"] == up["b"]) & (up["up"] <= low["depth"]))
    own = scratch.write(sent.groupBy(F.col("up").alias("depth"), F.col("above").alias("digest")).agg(*sums), f"own{level}")
    deepest = values.agg(F.max("depth")).first()[0] or 0
    if deepest < block:
        return own
    # a block's head has all that's in its block; the heads' own trie gives it what's in the blocks below
    top = values.filter(F.col("depth") % block == 0).select("depth", "digest", "conv").join(own, ["depth", "digest"])
    top = scratch.write(top.withColumn("depth", (F.col("depth") / block).cast("long")), f"heads{level}")
    chain = paths.filter(F.col("depth") % block == 0).withColumn("depth", (F.col("depth") / block).cast("long"))
    whole = subtree_sums(top, chain, names, scratch, block, level + 1)
    below = top.select("depth", "digest", "conv").join(whole, ["depth", "digest"]).filter("depth > 0")
    # and to all nodes of the block above it that it hangs under
    sent = below.join(up, (below["conv"] == up["c"]) & (below["depth"] - 1 == up["b"])).select(F.col("up").alias("depth"), F.col("above").alias("digest"), *names)
    out = scratch.write(own.unionByName(sent).groupBy("depth", "digest").agg(*sums), f"whole{level}")
    scratch.drop(f"own{level}", f"heads{level}", f"own{level + 1}", f"whole{level + 1}")
    return out


def joined_ids(ends: DataFrame) -> DataFrame:
    """``depth``, ``digest``, ``ends_sha256``: of the ids of the conversations that end at each node, ascending, joined by commas.

    By ranges of (node, id) ids become texts of some 64 kB, so that one node's task reads few rows, however many end there."""

    def join(batches):
        import pyarrow as pa

        node, first, size, part = None, None, 0, []

        def row():
            return (*node, first, ",".join(part))

        def given(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.string()))], names=["depth", "digest", "first", "ids"])

        for batch in batches:
            out = []
            for depth, digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part and ((depth, digest) != node or size >= TEXT_BYTES):
                    out.append(row())
                    size, part = 0, []
                if not part:
                    node, first = (depth, digest), conv
                part.append(str(conv))
                size += len(part[-1]) + 1
            yield given(out)
        if part:
            yield given([row()])

    def digest(batches):
        import pyarrow as pa

        node, now = None, None

        def given(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))], names=["depth", "digest", "ends_sha256"])

        for batch in batches:
            out = []
            for depth, name, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if now is not None and (depth, name) == node:
                    now.update(b",")
                else:
                    if now is not None:
                        out.append((*node, now.hexdigest()))
                    node, now = (depth, name), hashlib.sha256()
                now.update(ids.encode())
            yield given(out)
        if now is not None:
            yield given([(*node, now.hexdigest())])

    ranged = ends.select("depth", "digest", "conv").repartitionByRange("digest", "conv").sortWithinPartitions("digest", "depth", "conv")
    texts = ranged.mapInArrow(tidy(join), "depth bigint, digest binary, first bigint, ids string")
    return texts.repartition("digest").sortWithinPartitions("digest", "depth", "first").mapInArrow(tidy(digest), "depth bigint, digest binary, ends_sha256 string")


def with_parents(own: DataFrame, total: int) -> DataFrame:
    """The nodes with ``parent_conv``, and ``n_children``. Parents of very many children, at most a thousand of them, are broadcast."""
    counts = own.filter("parent IS NOT NULL").groupBy((F.col("depth") - 1).alias("d"), F.col("parent").alias("p")).agg(F.count("*").alias("n_children"))
    own = own.join(counts, (F.col("depth") == F.col("d")) & (F.col("digest") == F.col("p")), "left").drop("d", "p").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    above = own.filter("n_children > 0").select((F.col("depth") + 1).alias("d"), F.col("digest").alias("p"), F.col("conv").alias("parent_conv"), "n_children")
    hub = F.col("n_children") > max(HUB, total // HUB)
    hubs = above.filter(hub).select("d", "p", F.col("parent_conv").alias("hub_conv"))
    rest = above.filter(~hub).drop("n_children")
    marked = own.join(F.broadcast(hubs), (F.col("depth") == F.col("d")) & (F.col("parent") == F.col("p")), "left").drop("d", "p")
    # the root and the children of hubs don't move for the join
    done = marked.filter("parent IS NULL OR hub_conv IS NOT NULL").withColumnRenamed("hub_conv", "parent_conv")
    others = marked.filter("parent IS NOT NULL AND hub_conv IS NULL").drop("hub_conv").join(rest, (F.col("depth") == F.col("d")) & (F.col("parent") == F.col("p"))).drop("d", "p")
    return done.unionByName(others)


def trie(rows: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """A row for each node of the conversations in ``rows`` (``conv``, ``own``, ``turn``, ``role``, ``text``, as ``borrowed`` gives them)."""
    prefix = scratch.write(prefixes(rows), "prefixes")
    own = scratch.write(nodes(prefix), "nodes")
    own = scratch.write(with_parents(own, own.count()), "family")
    scratch.drop("nodes")
    worth = own.select("depth", "digest", "conv", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(worth, prefix.select("conv", "depth", "digest"), ["n_leaves", "saved_tokens"], scratch, block)
    ends = joined_ids(prefix.filter("ends"))
    out = own.join(sums, ["depth", "digest"]).join(ends, ["depth", "digest"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(borrowed(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), Scratch(spark, "trie"))


OP12_SQL = r"""
WITH base AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM base)),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, b.rn, b.role, b.text FROM convs c JOIN base b ON b.conv_id = c.conv_id - c.conv_id % 5 AND b.rn <= c.h
  UNION ALL SELECT c.conv_id, 1, b.rn, b.role, b.text FROM convs c JOIN base b ON b.conv_id = c.conv_id AND b.rn > c.h),
seqs AS (
  SELECT c.conv_id, coalesce(s.seq, []) AS seq, coalesce(s.sizes, []) AS sizes FROM convs c LEFT JOIN (
    SELECT conv_id, list(sha256(role || chr(0) || text) ORDER BY own, rn) AS seq, list(strlen(text) ORDER BY own, rn) AS sizes FROM rebuilt GROUP BY conv_id) s USING (conv_id)),
pre AS (
  SELECT conv_id, d AS depth, sha256(array_to_string(seq[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(seq[1:d - 1], ',')) END AS up,
    CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, d = len(seq) AS ends
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM seqs)),
node AS (
  SELECT depth, k, up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM pre GROUP BY depth, k, up),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT p.depth, p.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens
  FROM node n JOIN pre p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k GROUP BY p.depth, p.k)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN sums USING (depth, k) LEFT JOIN kids USING (depth, k) LEFT JOIN node a ON a.depth = n.depth - 1 AND a.k = n.up"""
