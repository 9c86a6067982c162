"""Prefix trie of conversations, gathered by adaptive radix trees over turn ids.

1. Each turn has a 16-byte big-endian id, a digest of its role and text, so that
   every task names it alike. Positions within conversations come from one range
   sort; no conversation is a group, so one may hold any share of the rows.
2. A conversation is cut into chunks of ``CHUNK`` turns. A chunk's key is the
   digest of all chunks before it, followed by its turn ids. Digests of the
   chunks before are sums of hashes, so they come from a window over chunks.
3. In each task the keys go into an adaptive radix tree: nodes of 4, 16, 48 and
   256 children that grow when full, with compressed paths. A walk emits, at
   byte depths that end a turn and only there, a node's members, smallest member
   and the weight (words) its members carry from that turn on. A tree is written
   out and started anew before it outgrows its bound; equal nodes of several
   trees are added up by their digest, so hot prefixes are combined in the tasks.
4. A node belongs to its smallest member. The owned nodes of a conversation are
   the end of its path, so a second pass of the same trees, over owners and their
   owned turns alone, gives the weight of distinct nodes and the leaves of every
   subtree. Members' words less distinct words are the saved tokens.
5. Ids of the conversations that end at a node are joined in blocks of 4,096
   consecutive ids; one stream per node hashes its blocks in order.

Defined results: rows without a conv_id belong to no conversation and are left
out; null roles and texts are empty; rows of one turn are ordered by the digest
of role and text, null turns first; repeated rows are turns of their own;
``c - c % 20`` is taken towards zero for negative ids; an empty table has no
nodes; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastebud.functions.index import dense_index
from tastebud.llm.common import materialise, small_batches

WIDTH, CHUNK = 16, 32  # bytes of a turn id; turns of a chunk
WORD = r"[^\x20\x09-\x0D]+"
TREE_BYTES, BATCH_ROWS = 24 * 1024 * 1024, 8192
ID_BLOCK = 4096
HUB, SHARED_TURNS = 20, 4


class Node:
    """An inner node: a compressed path, children by byte in the smallest layout that holds them, a value of its own."""
    __slots__ = ("path", "kind", "bytes_", "slots", "count", "value")

    def __init__(self, path: bytes):
        self.path, self.kind, self.bytes_, self.slots, self.count, self.value = path, 4, bytearray(), [], 0, None

    def child(self, byte: int):
        if self.kind <= 16:
            i = bisect_left(self.bytes_, byte)
            return self.slots[i] if i < self.count and self.bytes_[i] == byte else None
        if self.kind == 48:
            i = self.bytes_[byte]
            return self.slots[i - 1] if i else None
        return self.slots[byte]

    def put(self, byte: int, child) -> None:
        """Set the child of ``byte``; a full node takes the next layout first."""
        if self.child(byte) is None:
            if self.count == self.kind:
                self._grow()
            self.count += 1
            if self.kind <= 16:
                i = bisect_left(self.bytes_, byte)
                self.bytes_.insert(i, byte)
                self.slots.insert(i, child)
            elif self.kind == 48:
                self.slots.append(child)
                self.bytes_[byte] = self.count
            else:
                self.slots[byte] = child
        elif self.kind <= 16:
            self.slots[bisect_left(self.bytes_, byte)] = child
        elif self.kind == 48:
            self.slots[self.bytes_[byte] - 1] = child
        else:
            self.slots[byte] = child

    def _grow(self) -> None:
        if self.kind == 4:
            self.kind = 16
        elif self.kind == 16:
            index = bytearray(256)
            for i, b in enumerate(self.bytes_):
                index[b] = i + 1
            self.kind, self.bytes_ = 48, index
        else:
            slots = [None] * 256
            for b in range(256):
                if self.bytes_[b]:
                    slots[b] = self.slots[self.bytes_[b] - 1]
            self.kind, self.bytes_, self.slots = 256, bytearray(), slots

    def children(self) -> list[tuple[int, Node]]:
        """(byte, child), by byte."""
        if self.kind <= 16:
            return list(zip(self.bytes_, self.slots, strict=True))
        if self.kind == 48:
            return [(b, self.slots[i - 1]) for b, i in enumerate(self.bytes_) if i]
        return [(b, c) for b, c in enumerate(self.slots) if c is not None]


class RadixTree:
    """Byte-string keys with values that ``merge`` joins when a key comes again."""

    def __init__(self, merge):
        self.root, self.merge, self.size = Node(b""), merge, 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            path = node.path
            same = _common(path, key, at)
            if same < len(path):
                self._split(node, same)
            at += same
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            nearer = node.child(key[at])
            if nearer is None:
                leaf = Node(key[at + 1:])
                leaf.value = value
                node.put(key[at], leaf)
                self.size += 200 + len(key) - at
                return
            node, at = nearer, at + 1

    def _split(self, node: Node, at: int) -> None:
        """Cut a node's path at ``at``: the node keeps the front, a child takes the rest."""
        lower = Node(b"")
        for name in Node.__slots__:
            setattr(lower, name, getattr(node, name))
        lower.path, byte = node.path[at + 1:], node.path[at]
        node.path, node.kind, node.bytes_, node.slots, node.count, node.value = node.path[:at], 4, bytearray(), [], 0, None
        node.put(byte, lower)
        self.size += 200

    def items(self) -> Iterator[tuple[bytes, object]]:
        """(key, value) in byte order."""
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            here = before + node.path
            if node.value is not None:
                yield here, node.value
            stack.extend((here + bytes((b,)), c) for b, c in reversed(node.children()))


def _common(path: bytes, key: bytes, at: int) -> int:
    if key.startswith(path, at):
        return len(path)
    n = 0
    for a, b in zip(path, key[at:at + len(path)]):
        if a != b:
            break
        n += 1
    return n


class Members:
    """What the conversations below a place of the tree add up to."""
    __slots__ = ("count", "first", "tail", "weights")

    def __init__(self, count: int, first: int, tail: int, weights: np.ndarray):
        self.count, self.first, self.tail, self.weights = count, first, tail, weights

    def plus(self, other: Members) -> Members:
        return Members(self.count + other.count, min(self.first, other.first), self.tail + other.tail,
                       self.weights + other.weights)


def aligned_nodes(tree: RadixTree) -> Iterator[tuple[bytes, int, Members]]:
    """(base and turn ids so far, turns, members) for every byte depth of the tree that ends a turn."""
    order, stack = [], [(b"", tree.root, -1)]
    while stack:  # parents before children
        before, node, above = stack.pop()
        here = before + node.path
        at = len(order)
        order.append([here, above, node.value])
        stack.extend((here + bytes((b,)), c, at) for b, c in node.children())
    for _, above, members in reversed(order):
        if above >= 0 and members is not None:
            up = order[above]
            up[2] = members if up[2] is None else up[2].plus(members)
    for key, above, members in order:
        if members is None:
            continue
        # Depths of this node's own stretch: after its parent's end, up to its own end.
        first = len(order[above][0]) + 1 if above >= 0 else 0
        for depth in range(max(WIDTH, -(-first // WIDTH) * WIDTH), len(key) + 1, WIDTH):
            yield key[:depth], depth // WIDTH - 1, members


def name_of(base_and_turns: bytes) -> bytes:
    return hashlib.md5(base_and_turns).digest()


def gather(chunks: DataFrame) -> DataFrame:
    """Partial nodes (node, parent, depth, conv_id, n, weight) of the trees of all tasks.

    ``chunks`` has conv_id, chunk, base, top (the node above the chunk), key,
    words, count, start (the first turn of the chunk that weighs) and tail.
    """
    def emit(tree, above):
        rows = []
        for prefix, turns, m in aligned_nodes(tree):
            chunk, top = above[prefix[:WIDTH]]
            if turns == 0 and chunk:
                continue  # the last node of the chunk before
            parent = None if turns == 0 else top if turns == 1 and chunk else name_of(prefix[:-WIDTH])
            weight = m.tail + int(m.weights[max(turns - 1, 0):].sum())
            rows.append((name_of(prefix), parent, chunk * CHUNK + turns, m.first, m.count, weight))
            if len(rows) >= BATCH_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)

    columns = ["node", "parent", "depth", "conv_id", "n", "weight"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, above = RadixTree(Members.plus), {}
        for b in batches:
            for conv, chunk, base, top, key, words, count, start, tail in b.itertuples(index=False, name=None):
                weights = np.zeros(CHUNK, np.int64)
                weights[start:len(words)] = words[start:]
                above[bytes(base)] = (chunk, None if top is None else bytes(top))
                tree.insert(bytes(base) + bytes(key), Members(count, conv, tail, weights))
                tree.size += 64 + 8 * CHUNK
                if tree.size >= TREE_BYTES:
                    yield from emit(tree, above)
                    tree, above = RadixTree(Members.plus), {}
        yield from emit(tree, above)

    rows = chunks.select("conv_id", "chunk", "base", "top", "key", "words", "count", "start", "tail")
    return (rows.repartitionByRange("base", "key", "conv_id").sortWithinPartitions("base", "key", "conv_id")
            .mapInPandas(run, "node binary, parent binary, depth long, conv_id long, n long, weight long"))


def merged(partial: DataFrame) -> DataFrame:
    return partial.groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, words) of every turn, pos counting from 0 in its conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed = dense_index(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")], "idx")
    first = placed.groupBy("conv_id").agg(F.min("idx").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("idx") - F.col("first")).alias("pos"), "id", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv_id, total) after the first turns of every conversation gave way to those of its hub's."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    conv = F.col("conv_id")
    convs = sizes.select("conv_id", "n", F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED_TURNS)).alias("h"),
                         (conv - conv % HUB).alias("hub"))
    hubs = sizes.select(F.col("conv_id").alias("hub"), F.col("n").alias("hub_n"))
    convs = convs.join(hubs, "hub", "left").withColumn("m", F.least("h", F.coalesce("hub_n", F.lit(0))))
    totals = convs.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    own = (turns.join(convs.select("conv_id", "h", "m"), "conv_id").where(F.col("pos") >= F.col("h"))
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "words"))
    lent = turns.where((F.col("pos") < SHARED_TURNS - 1) & (conv % HUB == 0)).select(conv.alias("hub"), "pos", "id", "words")
    lent = (lent.join(convs.select("conv_id", "hub", "h"), "hub").where(F.col("pos") < F.col("h"))
            .select("conv_id", "pos", "id", "words"))
    return own.unionByName(lent), totals


def chunks_of(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """(conv_id, chunk, base, top, key, words, last) of every chunk of every conversation."""
    rows = turns.select("conv_id", (F.col("pos") / CHUNK).cast("long").alias("chunk"), "pos", "id", "words")
    chunks = (rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("t"))
              .select("conv_id", "chunk", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["id"])), "")).alias("key"),
                      F.transform("t", lambda x: x["words"]).alias("words")))
    none = totals.where(F.col("total") == 0).select("conv_id", F.lit(0).cast("long").alias("chunk"),
                                                    F.unhex(F.lit("")).alias("key"), F.array().cast("array<long>").alias("words"))
    chunks = chunks.unionByName(none)
    digest = F.md5(F.concat(F.col("chunk").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("key")))
    lanes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    by = Window.partitionBy("conv_id").orderBy("chunk")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(x).over(before), F.lit(0)).cast("string") for x in lanes]
    based = chunks.withColumn("base", F.unhex(F.md5(F.concat_ws(",", *sums).cast("binary"))))
    node = F.unhex(F.md5(F.concat("base", "key")))
    return (based.withColumn("node", node).withColumn("top", F.lag("node").over(by))
            .withColumn("last", F.lead("chunk").over(by).isNull()))


def weighed(chunks: DataFrame, count: Column, start: Column) -> DataFrame:
    """``chunks`` with what each counts, its first turn that weighs, and the words that weigh after it."""
    after = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    rows = chunks.withColumn("count", count.cast("long")).withColumn("start", start.cast("int"))
    own = F.aggregate(F.slice("words", F.col("start") + 1, F.lit(CHUNK)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("own", own).withColumn("tail", F.coalesce(F.sum("own").over(after), F.lit(0)))


def ends_of(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for b in batches:
            rows = []
            for node, ids in zip(b["node"], b["ids"], strict=True):
                if now is not None and bytes(node) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    rows.append((now, digest.hexdigest()))
                now, digest = bytes(node), hashlib.sha256(ids.encode())
            yield pd.DataFrame(rows, columns=["node", "ends_sha256"])
        yield pd.DataFrame([] if now is None else [(now, digest.hexdigest())], columns=["node", "ends_sha256"])

    ends = chunks.where("last").select("node", "conv_id", F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
    blocks = ends.groupBy("node", "block").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("node", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return (blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
            .mapInPandas(run, "node binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    spark = conversations.sparkSession
    small_batches(spark)
    turns = materialise(spark, turns_of(conversations), "turns")
    chunks = materialise(spark, chunks_of(*rebuilt(turns)), "chunks")
    nodes = materialise(spark, merged(gather(weighed(chunks, F.lit(1), F.lit(0)))), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(spark, nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
                        "nodes")
    # Owners: the depth from which a conversation owns its path, and whether that ends in a leaf.
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    start = F.least(F.greatest(F.col("owned") - 1 - F.col("chunk") * CHUNK, F.lit(0)), F.lit(CHUNK))
    distinct = merged(gather(weighed(chunks.join(owners, "conv_id"), F.col("leaf"), start)))
    distinct = distinct.select("node", F.col("n").alias("n_leaves"), F.col("weight").alias("distinct_weight"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(distinct, "node", "left").join(ends_of(chunks), "node", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
                    (F.col("weight") - F.col("distinct_weight")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
