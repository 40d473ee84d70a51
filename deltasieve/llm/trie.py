"""The trie of conversations' turns, with aggregates of every node: sorted shards below a skeleton of splitter paths."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, stash

#: Bytes of a turn's digest in a path.
STEP = 16
#: Conversations looked at for each splitter, and bytes of paths that are looked at in all.
OVERSAMPLE, MOST = 20, 16 << 20
#: Bytes of the list of ends that go on as one row.
PIECE = 64 << 10
#: Conversations of a block begin with turns of its first one, fewer than HEADS of them.
BLOCK, HEADS = 5, 9


def shared_openings(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """conv_id, path (a digest of STEP bytes for each turn), sizes (UTF-8 bytes of each turn's text) of rebuilt conversations.

    Conversation c begins with the first h turns of conversation c - c % block (all if it has fewer, none if there is no
    such conversation), h being crc32 of the decimal c, modulo heads; then come its own turns after its first h.

    Turns are in order of turn (null first), those with one number in order of their digests. A null role or text is
    empty; rows without conv_id belong to no conversation. A conversation's digests and sizes are one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(2 * STEP))
    number = F.col("conv_id").cast("bigint")
    turns = conversations.where("conv_id IS NOT NULL").select((number - number % block).alias("base"), number.alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("size")).alias("t"))
    # One exchange by block serves the grouping and the join of blocks with their first conversation.
    own = turns.repartition(partitions(conversations.sparkSession), "base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = own.where("conv_id = base").select("base", F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0))
    rebuilt = own.join(first, "base", "left").select("conv_id", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return rebuilt.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    at, end = 0, min(len(a), len(b))
    while at < end and a[at : at + STEP] == b[at : at + STEP]:
        at += STEP
    return at // STEP


@dataclass
class Skeleton:
    """The trie of splitters' paths. Its nodes are numbered in preorder, the root first.

    A node whose conversations, in order of (path, conv_id), stand in more than one shard is a prefix of the path that
    parts two of these: what isn't in the skeleton is in one shard.
    """

    splitters: list[tuple[bytes, int]]
    #: Numbers of the nodes along each splitter's path.
    numbers: list[list[int]] = field(default_factory=list)
    parent: list[int | None] = field(default_factory=lambda: [None])
    depth: list[int] = field(default_factory=lambda: [0])
    size: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def of(cls, rows: list[tuple[bytes, int, list[int]]]) -> Skeleton:
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        it = cls([(p, c) for p, c, _ in rows])
        before, path = [0], b""
        for p, _, sizes in rows:
            numbers = before[: common(path, p) + 1]
            for size in sizes[len(numbers) - 1 :]:
                it.parent.append(numbers[-1])
                it.depth.append(len(numbers))
                it.size.append(size)
                numbers.append(len(it.parent) - 1)
            it.numbers.append(numbers)
            before, path = numbers, p
        return it

    def table(self) -> list[tuple]:
        """pre, parent, depth, children within the skeleton, bytes of the texts of its subtree, path of numbers (of childless nodes)."""
        n = len(self.parent)
        children, below = [0] * n, list(self.size)
        for i in range(n - 1, 0, -1):
            children[self.parent[i]] += 1
            below[self.parent[i]] += below[i]
        lines = {numbers[-1]: numbers for numbers in [[0], *self.numbers]}
        return [(i, self.parent[i], self.depth[i], children[i], below[i], None if children[i] else lines[i]) for i in range(n)]


@dataclass
class _Node:
    size: int = 0
    number: int | None = None  # in the skeleton
    least: int | None = None
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    digest: object = None
    waiting: list[tuple] = field(default_factory=list)  # children whose parent's conv_id isn't known yet


SCANNED = "kind string, pre bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"


class Scan:
    """One shard's conversations, in order of (path, conv_id): nodes are finished when the order leaves them.

    Gives rows of SCANNED: 'node' (whole; of a child of the skeleton's, pre is its parent), 'part' (what a shard adds to a
    node of the skeleton; saved_tokens without taking a text off for the node itself) and 'ends' (a piece of its list).
    """

    def __init__(self, skeleton: Skeleton, shard: int):
        sides = [i for i in (shard - 1, shard) if 0 <= i < len(skeleton.splitters)]
        self.sides = [(skeleton.splitters[i][0], skeleton.numbers[i]) for i in sides]
        self.out: list[tuple] = []
        self.open = [_Node(number=0)]
        self.path = b""

    def add(self, path: bytes, sizes: list[int], conv_id: int) -> None:
        shared = common(path, self.path)
        while len(self.open) > shared + 1:
            self._close()
        if len(self.open) <= len(sizes):
            numbers = max((n[: common(path, p) + 1] for p, n in self.sides), key=len, default=[0])
            for d in range(len(self.open), len(sizes) + 1):
                self.open.append(_Node(sizes[d - 1], numbers[d] if d < len(numbers) else None))
        self.path = path
        node = self.open[-1]
        node.convs += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        node.ends.append(conv_id)
        if 8 * len(node.ends) >= PIECE:
            self._list_ends(node)

    def _list_ends(self, node: _Node) -> None:
        """Take the ends gathered so far on: into the digest, or as a piece of their own for the skeleton."""
        text = ",".join(map(str, node.ends))
        if node.number is not None:
            if node.ends:
                self.out.append(("ends", node.number, node.ends[0], None, None, None, None, None, None, text))
        else:
            if node.digest is None:
                node.digest = hashlib.sha256()
            elif text:
                text = "," + text
            node.digest.update(text.encode())
        node.ends = []

    def _close(self) -> None:
        depth, node = len(self.open) - 1, self.open.pop()
        above = self.open[-1] if self.open else None
        self._list_ends(node)
        if node.number is not None:
            node.saved += node.convs * node.size
            self.out.append(("part", node.number, node.least, None, None, node.convs, node.children, node.leaves, node.saved, None))
        else:
            node.saved += (node.convs - 1) * node.size
            node.leaves = node.leaves or 1
            self.out += [(*row[:4], node.least, *row[5:]) for row in node.waiting]
            row = ("node", above.number, node.least, depth, None, node.convs, node.children, node.leaves, node.saved, node.digest.hexdigest())
            (self.out if above.number is not None else above.waiting).append(row)
            above.children += 1
        if above is not None and node.convs:
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.leaves += node.leaves
            above.saved += node.saved

    def end(self) -> None:
        while self.open:
            self._close()


def _batches(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.string() if p.endswith("string") else pa.int64() for p in SCANNED.split(", ")]
    names = [p.split()[0] for p in SCANNED.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _splitters(paths: DataFrame, shards: int) -> list[tuple]:
    """(path, conv_id, sizes) of shards - 1 conversations, about as many between any two, from a sample of at most MOST bytes."""
    longest = paths.agg(F.max(F.octet_length("path"))).first()[0]
    if longest is None or shards < 2:
        return []
    most = min(shards * OVERSAMPLE, MOST // max(longest, STEP))
    rows = paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(most).select("path", "conv_id", "sizes").collect()
    found = sorted((bytes(r.path), r.conv_id, list(r.sizes)) for r in rows)
    return [found[i * len(found) // shards] for i in range(1, shards)] if len(found) >= shards else found


def trie_nodes(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """A row for each node of the trie of paths: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    paths: conv_id, path, sizes as shared_openings() gives them, one row for each conv_id. A node is a sequence of first
    turns that a conversation has, from the root, which has none; its members are the conversations that begin so.
    n_leaves counts the childless nodes of its subtree (itself included), saved_tokens adds (n_convs - 1) times the bytes
    of a node's last text over its subtree, ends_sha256 is of its members without further turns, comma-joined in order.

    Conversations are dealt in order of (path, conv_id) into shards that splitters part, so that copies of one
    conversation may stand in many. The skeleton, the trie of the splitters' paths, is broadcast (MOST bytes of paths
    at most). A shard's scan finishes all nodes outside it, holding the open nodes and the children of these; nodes of
    the skeleton get a row of partial sums from each shard that has any of them, and these are added up.

    Digests of 128 bits tell turns apart. Turnless conversations are members of the root only. No rows, no nodes.
    """
    spark = paths.sparkSession
    paths = stash(paths.select("conv_id", "path", "sizes"), "paths")
    shards = shards or partitions(spark)
    skeleton = Skeleton.of(_splitters(paths, shards))
    shared = spark.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        splitters = shared.value.splitters
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shard = pa.array([bisect_right(splitters, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *(batch.column(c) for c in ("conv_id", "path", "sizes"))], ["shard", "conv_id", "path", "sizes"])

    def scan(batches: Iterator) -> Iterator:
        now, at = None, None
        for batch in batches:
            for shard, conv_id, path, sizes in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")), strict=True):
                if shard != at:
                    if now is not None:
                        now.end()
                        yield _batches(now.out)
                    now, at = Scan(shared.value, shard), shard
                now.add(path, sizes, conv_id)
            if now is not None and now.out:
                yield _batches(now.out)
                now.out = []
        if now is not None:
            now.end()
            yield _batches(now.out)

    def join_ends(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pre, digest = None, None
        for batch in batches:
            rows = []
            for number, ends in zip(batch.column("pre").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if number != pre:
                    if pre is not None:
                        rows.append((pre, digest.hexdigest()))
                    pre, digest = number, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["pre", "ends_sha256"])
        if pre is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pre]), pa.array([digest.hexdigest()])], ["pre", "ends_sha256"])

    dealt = paths.mapInArrow(deal, "shard int, conv_id bigint, path binary, sizes array<bigint>")
    scanned = stash(dealt.repartitionById(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(scan, SCANNED), "nodes")

    parts = scanned.where("kind = 'part'").groupBy("pre").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # Pieces of a list are in order of their first conv_id, as shards are; SHA-256 takes them in one after the other.
    ends = scanned.where("kind = 'ends'").select("pre", "conv_id", "ends").repartition(partitions(spark), "pre").sortWithinPartitions("pre", "conv_id").mapInArrow(join_ends, "pre bigint, ends_sha256 string")
    bones = spark.createDataFrame(skeleton.table(), "pre bigint, parent bigint, depth bigint, bones bigint, bytes bigint, line array<bigint>")
    sums = bones.join(parts, "pre").join(ends, "pre", "left")
    sums = stash(sums.withColumns({"n_children": F.col("n_children") + F.col("bones"), "saved_tokens": F.col("saved_tokens") - F.col("bytes"), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))}), "skeleton")
    childless = sums.where("n_children = 0").select(F.explode("line").alias("pre")).groupBy("pre").agg(F.count(F.lit(1)).alias("childless"))
    above = F.broadcast(sums.select(F.col("pre").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = sums.join(childless, "pre", "left").join(above, "parent", "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("childless", F.lit(0)))
    whole = scanned.where("kind = 'node'").withColumnRenamed("ends", "ends_sha256")
    inner = whole.where("pre IS NULL").select(names)
    outer = whole.where("pre IS NOT NULL").drop("parent_conv_id").join(above, F.col("pre") == F.col("parent")).select(names)
    return inner.unionByName(outer).unionByName(top.select(names))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations as shared_openings() rebuilds them, by trie_nodes()."""
    return trie_nodes(shared_openings(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND i <= h
  UNION ALL
  SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
s AS (SELECT conv_id, text, md5(strlen(role) || ':' || role || text) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d FROM r),
m AS (
  SELECT conv_id, 0 AS d, '' AS node, 0 AS bytes FROM c
  UNION ALL
  SELECT conv_id, d, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d), strlen(text) FROM s),
e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM m),
n AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS listed
  FROM e GROUP BY node, d),
k AS (SELECT left(node, 32 * (depth - 1)::BIGINT) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (
  SELECT left(node, 32 * up) AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens, sha256(w.listed) AS ends_sha256
FROM w JOIN u ON w.node = u.node LEFT JOIN n p ON w.depth > 0 AND p.node = left(w.node, 32 * (w.depth - 1)::BIGINT)
"""
