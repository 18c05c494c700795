"""The trie of all turn prefixes of conversations: members, children, leaves and saved tokens of every node.

A turn is a key of 16 bytes (of the SHA-256 of its role and text) and a number of words, so a conversation is a path of keys; texts go no
further than the first scan. Paths, ties by conv_id, are dealt over shards by splitters from a sample. The prefixes of splitters are the
skeleton of the trie. It is broadcast, and any other node has all its members in one shard: between two neighbouring splitters that both
lack its prefix. So each sorted shard finishes its own nodes in one pass with a stack, and only sums for skeleton nodes leave it, which
are reduced by node. Copies of one conversation may fill many shards, as splitters hold conv_id too.

Splitters' paths are cut so that all sampled ones together take about SKELETON_BYTES at most. Results don't depend on where splitters lie. One
conversation is one row of 20 bytes a turn.

Defined cases: rows with a null conv_id are left out; a null role or text is empty; turns of a conversation are ordered by turn (null
first), then by key, so repeated turns stay; an empty table has no nodes, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import discard, materialised, or_empty, pieces_for, release_memory, table

KEY = 16
SHARD_BYTES, SKELETON_BYTES = 32 << 20, 64 << 20
MOST_SHARDS, SAMPLES = 16384, 16
#: Ids of conversations that one row of a skeleton node's partial sums holds.
ENDS = 1 << 16
FIRST_ID = -(1 << 63)


def turn_keys(turns: DataFrame) -> DataFrame:
    """conv_id, t(turn, key in hex, words) of turns(conv_id, turn, role, text)."""
    role, text = or_empty("role"), or_empty("text")
    key = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(2 * KEY))
    return turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words")).alias("t"))


def as_path(turns) -> list:
    """The columns path and words of an array of t."""
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["key"]), "")).alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id, path, words of each conversation as it is."""
    return turn_keys(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", *as_path(F.col("turns")))


def branched_paths(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conv_id, path, words where conversation c begins with the first h = crc32(decimal c) % most turns of c - c % group, if that is there, in
    place of its own. Conversations of a group meet in one partition, their keys only."""
    x = turn_keys(turns).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).repartition("base")
    x = x.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    x = x.withColumns({"head": head, "h": h})
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return x.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns")).select("conv_id", *as_path(F.col("turns")))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their start."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    low, high = 0, n  # of low turns it holds, of high it doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[: mid * KEY] == b[: mid * KEY]:
            low = mid
        else:
            high = mid
    return low


class Skeleton:
    """The trie of the splitters' paths, nodes numbered in preorder from the root, 0."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.splitters = splitters
        self.parent, self.depth, self.nodes = [-1], [0], []  # nodes: of each splitter the node of each of its prefixes
        before, own = b"", np.zeros(1, np.int32)
        for path, _ in splitters:
            shared, n = shared_turns(before, path), len(path) // KEY
            new = np.arange(len(self.parent), len(self.parent) + n - shared, dtype=np.int32)
            own = np.concatenate([own[: shared + 1], new])
            self.parent.extend(own[shared:n].tolist())
            self.depth.extend(range(shared + 1, n + 1))
            self.nodes.append(own)
            before = path

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def around(self, shard: int) -> list[tuple[bytes, np.ndarray]]:
        """Path and nodes of the splitters at both ends of a shard."""
        return [(self.splitters[k][0], self.nodes[k]) for k in (shard - 1, shard) if 0 <= k < len(self.splitters)]


def skeleton_of(paths: DataFrame, shard_bytes: int, skeleton_bytes: int, least: int) -> Skeleton:
    total = paths.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("path").cast("long") + 16), F.lit(0)).alias("b")).first()
    n_shards = min(MOST_SHARDS, pieces_for(int(total["b"]), shard_bytes, least))
    cut = max(1, skeleton_bytes // (KEY * n_shards * SAMPLES)) * KEY
    every = max(1, total["n"] // (n_shards * SAMPLES))
    sample = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0)
    whole = F.octet_length("path") <= cut
    found = sorted((bytes(r["p"]), r["c"]) for r in sample.select(F.substring("path", 1, cut).alias("p"), F.when(whole, F.col("conv_id")).otherwise(FIRST_ID).alias("c")).collect())  # bounded by SKELETON_BYTES
    return Skeleton(sorted({found[k * len(found) // n_shards] for k in range(1, n_shards)}) if found else [])


SHARDED = pa.schema([("shard", pa.int32()), ("conv_id", pa.int64()), ("path", pa.binary()), ("words", pa.list_(pa.int32()))])
SHARDED_DDL = "shard int, conv_id bigint, path binary, words array<int>"


def dealt(paths: DataFrame, skeleton) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [skeleton.value.shard(p, c) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0), batch.column(1), batch.column(2).cast(SHARDED.types[3])], schema=SHARDED)

    return paths.select("conv_id", "path", "words").mapInArrow(run, SHARDED_DDL)


#: A finished node (node null; parent_node where its parent is in the skeleton), or a shard's sums for a node of the skeleton, with the ids of the
#: conversations that end there in pieces numbered by seq.
PARTS = pa.schema(
    [("node", pa.int32()), ("parent_node", pa.int32()), ("shard", pa.int32()), ("seq", pa.int32())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")]
    + [("ends_sha256", pa.string()), ("ends", pa.binary())]
)
PARTS_DDL = "node int, parent_node int, shard int, seq int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string, ends binary"


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class _Node:
    __slots__ = ("children", "count", "ends", "least", "leaves", "node", "saved", "waiting", "words")

    def __init__(self, words: int, node: int | None) -> None:
        self.words, self.node = words, node  # node: its number in the skeleton
        self.count = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.waiting: list[tuple] = []  # rows of finished children, which lack this node's smallest member


def shard_nodes(rows: Iterator[tuple[int, int, bytes, list[int]]], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows of PARTS from rows (shard, conv_id, path, words) in the order of shard, path, conv_id."""
    stack: list[_Node] = []
    at, before, ends = None, b"", []

    def closed() -> Iterator[tuple]:
        x, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if x.node is None:
            yield from (w[:6] + (x.least,) + w[7:] for w in x.waiting)
            x.leaves += not x.children
            x.saved += (x.count - 1) * x.words
            row = (None, above.node, at, 0, x.least, depth, None, x.count, x.children, x.leaves, x.saved, x.words, _sha(x.ends), None)
            above.children += 1
            if above.node is None:
                above.waiting.append(row)
            else:
                yield row
        else:
            yield (x.node, None, at, 0, x.least, depth, None, x.count, x.children, x.leaves, x.saved, x.words, None, np.array(x.ends[:ENDS], "<i8").tobytes())
            for k in range(1, -(-len(x.ends) // ENDS)):
                yield (x.node, None, at, k, x.least, depth, None, 0, 0, 0, 0, x.words, None, np.array(x.ends[k * ENDS : (k + 1) * ENDS], "<i8").tobytes())
        if above is not None:
            above.count += x.count
            above.leaves += x.leaves
            above.saved += x.saved
            above.least = x.least if above.least is None else min(above.least, x.least)

    for shard, conv_id, path, words in rows:
        if shard != at:
            while stack:
                yield from closed()
            at, before, ends = shard, b"", skeleton.around(shard)
            stack.append(_Node(0, 0))
        shared = shared_turns(before, path)
        while len(stack) - 1 > shared:
            yield from closed()
        if len(words) > shared:
            known = [(shared_turns(path, p), nodes) for p, nodes in ends]
            for d in range(shared + 1, len(words) + 1):
                stack.append(_Node(words[d - 1], next((int(nodes[d]) for n, nodes in known if d <= n), None)))
        x = stack[-1]
        x.ends.append(conv_id)
        x.count += 1
        x.least = conv_id if x.least is None else min(x.least, conv_id)
        before = path
    while stack:
        yield from closed()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") if isinstance(row[-1], bytes) else 0
        if len(held) >= 4096 or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
    release_memory()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def local_parts(sharded: DataFrame, n_shards: int, skeleton) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(shard_nodes(_rows(batches), skeleton.value), PARTS)

    return sharded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id").mapInArrow(run, PARTS_DDL)


NODES = pa.schema([("node", pa.int32())] + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")] + [("ends_sha256", pa.string())])
NODES_DDL = "node int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string"


def _reduced(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row a node from shards' sums (node, conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, words, ends) in the order of node, shard,
    seq. The ids that end there go through the digest a piece at a time."""
    now, sums, digest = None, [], None
    for node, conv_id, depth, *values, words, ends in rows:
        if node != now:
            if now is not None:
                yield (now, *sums, digest.hexdigest())
            now, sums, digest, some = node, [conv_id, depth, None, 0, 0, 0, 0, words], hashlib.sha256(), False
        sums[0] = min(sums[0], conv_id)
        sums[3:7] = [a + b for a, b in zip(sums[3:7], values)]
        if ends:
            digest.update((b"," if some else b"") + ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode())
            some = True
    if now is not None:
        yield (now, *sums, digest.hexdigest())


def reduced_skeleton(parts: DataFrame, skeleton) -> DataFrame:
    """The finished nodes of the skeleton. Shards' sums hold what lies below in nodes of their own; what the skeleton's nodes add to those above
    them is summed here over ranges of the preorder, in one task of at most SKELETON_BYTES / KEY rows."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_reduced(_rows(batches)), NODES)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), NODES)
        if not len(t):
            return
        parent, depth = np.array(skeleton.value.parent), np.array(skeleton.value.depth)
        node = t["node"].to_numpy()
        n, children, leaves, saved, words, conv = (_placed(node, t[c].to_numpy(), len(parent)) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "words", "conv_id"))
        there = n > 0
        np.add.at(children, parent[there & (parent >= 0)], 1)
        end = _subtree_ends(depth)
        below = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[end] - s[:-1]
        leaves += below((there & (children == 0)).astype(np.int64))
        saved += below(np.where(there, (n - 1) * words, 0))
        up = [None if p < 0 else int(conv[p]) for p in parent[node].tolist()]
        columns = [t["node"], t["conv_id"], t["depth"], pa.array(up, pa.int64()), t["n_convs"], pa.array(children[node]), pa.array(leaves[node]), pa.array(saved[node]), t["words"], t["ends_sha256"]]
        yield from pa.table(columns, schema=NODES).combine_chunks().to_batches(max_chunksize=4096)

    sums = parts.filter("node is not null").select("node", "shard", "seq", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "ends").repartition("node").sortWithinPartitions("node", "shard", "seq")
    return sums.drop("shard", "seq").mapInArrow(reduce, NODES_DDL).repartition(1).mapInArrow(finish, NODES_DDL)


def _placed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[at] = values
    return out


def _subtree_ends(depth: np.ndarray) -> np.ndarray:
    """For each node in preorder the number after its last descendant."""
    end, open_ = np.full(len(depth), len(depth)), []
    for v, d in enumerate(depth.tolist()):
        while open_ and depth[open_[-1]] >= d:
            end[open_.pop()] = v
        open_.append(v)
    return end


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(paths: DataFrame, shard_bytes: int = SHARD_BYTES, skeleton_bytes: int = SKELETON_BYTES, least: int = 12) -> DataFrame:
    """A row for each distinct prefix of paths(conv_id, path, words): conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    paths = materialised(paths, "paths")
    known = skeleton_of(paths, shard_bytes, skeleton_bytes, least)
    skeleton = spark.sparkContext.broadcast(known)
    parts = materialised(local_parts(dealt(paths, skeleton), len(known.splitters) + 1, skeleton), "trie-parts")
    discard(paths)
    top = materialised(reduced_skeleton(parts, skeleton), "trie-skeleton")
    above = F.broadcast(top.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_above")))  # SKELETON_BYTES / KEY rows at most
    own = parts.filter("node is null").drop("node").join(above, "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return own.select(*OUT).unionByName(top.select(*OUT))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(branched_paths(table(spark, sf_dir, "conversations")))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
t AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS k FROM (
  SELECT conv_id, turn, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT conv_id, list(key ORDER BY src, k) FILTER (key IS NOT NULL) AS ks, list(words ORDER BY src, k) FILTER (key IS NOT NULL) AS ws FROM (
  SELECT conv_id, NULL AS src, NULL AS k, NULL AS key, NULL AS words FROM c
  UNION ALL SELECT c.conv_id, 0, k, key, words FROM c JOIN t ON t.conv_id = c.base WHERE k <= h
  UNION ALL SELECT c.conv_id, 1, k, key, words FROM c JOIN t ON t.conv_id = c.conv_id WHERE k > h) GROUP BY conv_id),
m AS (SELECT conv_id, len(coalesce(ks, [])) AS n, d, coalesce(array_to_string(ks[1:d], ''), '') AS p, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words FROM (
  SELECT *, unnest(range(0, len(coalesce(ks, [])) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM m GROUP BY p, d),
k AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p),
s AS (SELECT left(p, 32 * a) AS p, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM o) GROUP BY ALL)
SELECT o.conv_id, o.d::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM o JOIN s ON s.p = o.p LEFT JOIN n u ON o.d > 0 AND u.p = left(o.p, 32 * (o.d - 1))"""
