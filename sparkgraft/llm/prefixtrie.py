"""The prefix trie of conversations, by vertical bitmaps.

A conversation is a sequence of turns (role, text); each distinct sequence of its first d turns is
a node of depth d. Turns become digests of 128 bits and lengths as they are read; no text moves.
They are placed by a range partitioning, so that one conversation may hold most of the rows.

Conversations are cut into blocks of `block_turns` turns, and blocks dealt by hash into shards of
about `shard_turns` turns, so that conversations with a common beginning are spread evenly. In a
shard an index holds, for each (position, turn), a bitset of conversations; from the root of each
block on, the bitset of a node and the postings of the next position meet: what is left is a
child, its bits are the node's members, and those without a next turn make the node's end list.
The index is walked depth first. Nodes are named by digests of their sequences, so Spark adds up
the shards' counts by node, partly before anything moves.

What a node sums over its subtree are sums over its members: each conversation owns the nodes of
which it is the smallest member, which are all its nodes from some depth on. The first walk finds
these owners and childless nodes; the second adds up, for each member, the lengths of its turns
from the node on, less those that it owns (each node's text counts once), and the leaves owned.

End lists are hashed as streams, in ascending order: ranges of (node, conversation) are joined to
pieces of bounded size, and a node's pieces follow each other; only a piece is held at a time.

Defined results: rows with a null conv_id take no part; turns are ordered by turn (null first),
equal ones by their digest; repeated rows are turns of their own; null roles and texts are empty;
conversations without turns are members of the root alone; an empty table has no nodes; extra
columns are ignored. Lengths are code points.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean

ROOT = hashlib.md5(b"").digest()
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "node binary, parent binary, depth long, conv_id long, n_convs long, length long, saved long, n_leaves long"


def digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def heads_of(conv_id: Column) -> Column:
    """How many turns of its hundred's first conversation a conversation begins with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def placed(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), key, length of every turn. Ranges of the order are written; a range's first conversation goes on from those before."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    keyed = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("key"), F.length(text).cast("long").alias("length"))
    order = ["conv_id", F.asc_nulls_first("turn"), "key"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        for b in batches:
            places = []
            for conv in b.column(0).to_pylist():
                place = place + 1 if conv == last else 1
                last = conv
                places.append(place)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(places, pa.int64()), b.column(3)], ["conv_id", "key", "length", "place", "part"])

    rows = ranged.select("conv_id", "key", "length", F.spark_partition_id().alias("part")).mapInArrow(number, "conv_id long, key binary, length long, place long, part int")
    rows = scratch.cut(rows, "placed")
    # a conversation that lies in several ranges has one row for each here
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("before IS NOT NULL").select("conv_id", "part", "before")
    before = scratch.cut(before, "before")  # at most a row for each range
    return rows.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("position"), "key", "length")


def rebuilt(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all conversation ids, rebuilt turns: conv_id, position, key, length).

    A conversation c begins with the first h turns of conversation c - c % 100, then come its own
    after its first h; h is heads_of(c). At most five turns of one conversation meet at most
    two hundred conversations.
    """
    rows = placed(scratch, turns)
    convs = scratch.cut(rows.where("position = 1").select("conv_id", heads_of(F.col("conv_id")).alias("h")), "convs")
    first = rows.where("position <= 5 AND conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    mine = convs.withColumn("base", F.expr("conv_id - conv_id % 100"))
    given = mine.join(first, "base").where("position <= h").select("conv_id", "position", "key", "length")
    given = scratch.cut(given, "given")
    held = given.groupBy("conv_id").agg(F.count("*").alias("held"))
    shifts = scratch.cut(convs.join(held, "conv_id", "left").select("conv_id", "h", (F.coalesce("held", F.lit(0)) - F.col("h")).alias("shift")), "shifts")
    own = rows.join(shifts, "conv_id").where("position > h").select("conv_id", (F.col("position") + F.col("shift")).alias("position"), "key", "length")
    return convs.select("conv_id"), given.union(own)


def blocks_of(scratch: Scratch, convs: DataFrame, turns: DataFrame, block_turns: int) -> DataFrame:
    """conv_id, block, entry (node before it), leave (node after a full block), keys, lengths, last (whether the conversation ends here), after (length of later turns)."""
    cut = turns.withColumn("block", F.floor((F.col("position") - 1) / block_turns)).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("position", "key", "length"))).alias("turns"))
    cut = cut.select("conv_id", "block", F.col("turns.key").alias("keys"), F.col("turns.length").alias("lengths"))
    whole = F.unhex(F.md5(F.array_join(F.transform("keys", F.hex), "")))
    # a block's entry is named by sums over the blocks before it, of digests that depend on their place
    hexed = F.md5(F.concat(F.col("block").cast("string"), F.lit(":"), F.hex(whole)))
    x, y = (F.conv(F.substring(hexed, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 17))
    cut = scratch.cut(cut.withColumn("x", x).withColumn("y", y).withColumn("total", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)), "cut")
    order = Window.partitionBy("conv_id").orderBy("block")
    name = lambda frame: F.unhex(F.md5(F.concat_ws("/", F.sum("x").over(frame).cast("string"), F.sum("y").over(frame).cast("string"))))
    until, before, later = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    named = cut.select(
        "conv_id", "block", F.when(F.col("block") == 0, F.lit(ROOT)).otherwise(name(before)).alias("entry"), name(until).alias("leave"), "keys", "lengths",
        F.lead("block").over(order).isNull().alias("last"), F.coalesce(F.sum("total").over(later), F.lit(0)).alias("after"),
    )
    none = F.lit(None)
    bare = convs.join(cut.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("block"), F.lit(ROOT).alias("entry"), none.cast("binary").alias("leave"), F.array().cast("array<binary>").alias("keys"), F.array().cast("array<long>").alias("lengths"), F.lit(True).alias("last"), F.lit(0).cast("long").alias("after")
    )
    return scratch.cut(named.unionByName(bare), "blocks")


class Shard:
    """Blocks of conversations as an index from (block, position, turn) to bitsets of them."""

    def __init__(self, block_turns: int):
        self.block_turns = block_turns
        self.ids, self.keys, self.leave, self.rest, self.mine, self.leaf = [], [], [], [], [], []
        self.roots: dict[tuple[int, bytes], int] = defaultdict(int)
        self.index: dict[tuple[int, int, bytes], int] = defaultdict(int)
        self.ends: dict[tuple[int, int], int] = defaultdict(int)  # by block and place: those that go no further there

    def add(self, conv: int, block: int, entry: bytes, leave: bytes | None, keys: list[bytes], lengths: list[int], last: bool, after: int, mine: int | None, leaf: int | None) -> None:
        bit = 1 << len(self.ids)
        self.roots[block, entry] |= bit
        for place, key in enumerate(keys):
            self.index[block, place, key] |= bit
        if last:
            self.ends[block, len(keys)] |= bit
        rest, sums = after, [after]  # lengths of all turns from a place on
        for length in reversed(lengths):
            rest += length
            sums.append(rest)
        self.ids.append(conv)
        self.keys.append(keys)
        self.leave.append(leave)
        self.rest.append(sums[::-1])
        self.mine.append(mine or 0)
        self.leaf.append(leaf or 0)

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    def walk(self) -> Iterator[tuple]:
        """The rows of NODES for every node of the shard but the root of all, and (node, ids) of its end lists."""
        for (block, entry), bits in self.roots.items():
            base = hashlib.md5(entry)
            stack = [(bits, 0, entry, entry, base)]
            while stack:
                bits, place, node, parent, chain = stack.pop()
                if place or block == 0:
                    yield self.row(bits, block, place, node, parent)
                if done := bits & self.ends.get((block, place), 0):
                    yield node, sorted(self.ids[i] for i in self.members(done))
                    bits ^= done
                while bits and place < self.block_turns:
                    i = (bits & -bits).bit_length() - 1
                    key = self.keys[i][place]
                    child = bits & self.index[block, place, key] if bits & (bits - 1) else bits
                    bits ^= child
                    deeper = chain.copy()
                    deeper.update(key)
                    name = self.leave[i] if place + 1 == self.block_turns else deeper.digest()
                    stack.append((child, place + 1, name, node, deeper))

    def row(self, bits: int, block: int, place: int, node: bytes, parent: bytes) -> tuple:
        held = list(self.members(bits))
        one, at = held[0], place - 1 if place else 0  # the root has no text of its own
        length = self.rest[one][at] - self.rest[one][place] if place else 0
        saved = sum(self.rest[i][at] - min(self.rest[i][at], self.mine[i]) for i in held)
        return node, parent if place else None, block * self.block_turns + place, min(self.ids[i] for i in held), len(held), length, saved, sum(self.leaf[i] for i in held)


def walk_all(rows: DataFrame, shards: int, block_turns: int, ends: bool) -> DataFrame:
    """NODES of every shard, or (ends) node and conv_id of every end. rows: as of blocks_of, with mine (length of the turns that the conversation owns) and leaf (1 if it owns one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "conv_id"] if ends else [c.split()[0] for c in NODES.split(", ")]
        kinds = [pa.binary(), pa.int64()] if ends else [pa.binary(), pa.binary(), *[pa.int64()] * 6]

        def emit(shard: Shard) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for found in shard.walk():
                if ends and len(found) == 2:
                    out += ((found[0], i) for i in found[1])
                elif not ends and len(found) > 2:
                    out.append(found)
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        at, shard = None, Shard(block_turns)
        for b in batches:
            for number, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != at:
                    yield from emit(shard)
                    at, shard = number, Shard(block_turns)
                shard.add(*row)
        yield from emit(shard)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("conv_id", "block"), F.lit(shards)))
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard")
    columns = ["shard", "conv_id", "block", "entry", "leave", "keys", "lengths", "last", "after", "mine", "leaf"]
    return dealt.select(*columns).mapInArrow(lean(run), "node binary, conv_id long" if ends else NODES)


def hashed_ends(ended: DataFrame, piece: int = 50_000) -> DataFrame:
    """node, ends_sha256 of the ascending, comma-joined ids that end there. ended: node, conv_id."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def put() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["node", "first", "ids"])

        for b in batches:
            for own, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (own != node or len(ids) >= piece):
                    yield put()
                    ids = []
                node = own
                ids.append(i)
        if ids:
            yield put()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, hashlib.sha256()
        for b in batches:
            out = []
            for own, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if own != node:
                    if node is not None:
                        out.append((node, running.hexdigest()))
                    node, running = own, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["node", "ends_sha256"])

    pieces = ended.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(finish, "node binary, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame, rebuild: Callable[[Scratch, DataFrame], tuple[DataFrame, DataFrame]] = rebuilt, block_turns: int = 1024, shard_turns: int = 50_000, hot_parents: int = 10_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node. conversations: conv_id, turn, role, text."""
    scratch = Scratch(spark, "trie")
    convs, turns = rebuild(scratch, conversations)
    rows = blocks_of(scratch, convs, turns, block_turns)
    total = rows.agg(F.coalesce(F.sum(F.size("keys") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_turns))
    blank = rows.withColumn("mine", F.lit(0).cast("long")).withColumn("leaf", F.lit(0).cast("long"))
    first = walk_all(blank, shards, block_turns, ends=False).groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("length").alias("length"), F.min("conv_id").alias("conv_id"))
    first = scratch.cut(first, "first")
    children = scratch.cut(first.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "children")
    nodes = scratch.cut(first.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    owners = nodes.groupBy("conv_id").agg(F.sum("length").alias("mine"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min(F.struct("depth", "node", "parent")).alias("top"))
    owners = scratch.cut(owners, "owners")

    sums = walk_all(rows.join(owners.drop("top"), "conv_id", "left"), shards, block_turns, ends=False).groupBy("node").agg(F.sum("n_convs").alias("n_convs"), F.sum("saved").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = hashed_ends(walk_all(blank, shards, block_turns, ends=True))

    # the parent's smallest member is the node's own, but where a conversation's nodes begin; parents of very many are broadcast
    tops = owners.where("top.parent IS NOT NULL").select("top.node", "top.parent")
    many = max(1000, nodes.count() // hot_parents)
    named = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = scratch.cut(named.where(F.col("n_children") > many).drop("n_children"), "hot")  # at most hot_parents rows
    flagged = tops.join(F.broadcast(hot), "parent", "left")
    cold = flagged.where("parent_conv_id IS NULL").drop("parent_conv_id").join(named.where(F.col("n_children") <= many).drop("n_children"), "parent")
    parents = flagged.where("parent_conv_id IS NOT NULL").select("node", "parent_conv_id").union(cold.select("node", "parent_conv_id"))

    out = nodes.join(sums, "node").join(ends, "node", "left").join(parents, "node", "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )

