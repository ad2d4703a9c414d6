"""A hash tree over content rows, by time-forward processing, with a proof for every row."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from listing_lake.llm.common import let
from listing_lake.session import materialize

# Levels of a tree that one block of nodes spans; a block has at most 2 ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 10
CONTENT_FIELDS = ("content_id", "source", "sourceLanguage", "title", "summary", "url", "price")

STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])
PROOF = "array<struct<left: boolean, digest: string>>"


def field_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values as text: `-` for null, else its UTF-8 byte count, `:` and the value itself."""
    def framed(value: Column) -> Column:
        plain = value.cast("string")
        return F.when(plain.isNull(), "-").otherwise(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain))

    return F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256)


def _parent(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


# --- one block ----------------------------------------------------------------------------------
def _label(level: int, place: int, n: int) -> tuple[int, int]:
    """Label of a node: the last leaf below it, then its level. Children come before their parent, left before right."""
    return min(((place + 1) << level) - 1, n - 1), level


def deliver_up(leaves: Sequence[str], levels: int) -> tuple[str, dict]:
    """(root, received): the forward sweep over one block.

    Every node sends its digest to its parent through a priority queue ordered by the receiver's label, so a node finds its
    children's digests at the head of the queue when its turn comes. `received` keeps what each node was sent, in order.
    """
    n = len(leaves)
    # Sorted by label, so already a heap.
    queue = [((i, 0), i, i, digest) for i, digest in enumerate(leaves)]
    received, digest = {}, ""
    while queue:
        label, place, child, digest = heapq.heappop(queue)
        level = label[1]
        if level:
            children = [(child, digest)]
            while queue and queue[0][0] == label:
                children.append(heapq.heappop(queue)[2:])
            received[level, place] = children
            digest = _parent([d for _, d in children])
        if level < levels:
            heapq.heappush(queue, (_label(level + 1, place >> 1, n), place >> 1, place, digest))
    return digest, received


def deliver_down(received: dict, n: int, levels: int, above: list[dict]) -> list[list[dict]]:
    """The proof of every leaf of a block: the reversed sweep.

    Nodes are taken by descending label; each sends its own proof, headed by the sibling's digest, to its children. A step
    without a digest is a node hashed alone. `above` is the proof of the block's root.
    """
    proofs: list = [above] * n
    queue = [((-(n - 1), -levels), 0, above)]
    while queue:
        (_, level), place, proof = heapq.heappop(queue)
        level = -level
        if not level:
            proofs[place] = proof
            continue
        children = received[level, place]
        for at, (child, _) in enumerate(children):
            sibling = children[1 - at][1] if len(children) == 2 else None
            last, below = _label(level - 1, child, n)
            heapq.heappush(queue, ((-last, -below), child, [{"left": at == 1, "digest": sibling}, *proof]))
    return proofs


def levels_of(nodes: int, most: int) -> int:
    """How many levels of parents a block spans in a tree with this many nodes on the block's lowest level."""
    return min(most, max(nodes - 1, 0).bit_length())


# --- all blocks of all trees --------------------------------------------------------------------
def _blocks(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes gathered into blocks of consecutive places, in order. A block is bounded, however large its tree."""
    return nodes.groupBy("tree", "nodes", F.shiftright("place", most).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "row"))).alias("members"))


def _roots(blocks: DataFrame, most: int) -> DataFrame:
    """Forward sweep: the blocks' roots as nodes of the next round."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, nodes, block = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            roots = [deliver_up(d, levels_of(n, most))[0] for n, d in zip(nodes, batch.column(3).to_pylist())]
            after = [-(-n >> most) for n in nodes]
            yield pa.RecordBatch.from_arrays(
                [tree, pa.array(after, pa.int64()), block, pa.array(roots, pa.string())], ["tree", "nodes", "place", "digest"])

    narrow = blocks.select("tree", "nodes", "block", F.col("members.digest").alias("digests"))
    return narrow.mapInArrow(sweep, "tree string, nodes long, place long, digest string").withColumn("row", F.lit(None).cast("int"))


def climb(nodes: DataFrame, most: int = BLOCK_LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of every round, roots): all trees from their leaves to their roots.

    `nodes` has `tree`, `nodes` (leaves of the tree), `place` (gapless from 0 within the tree), `digest` and `row`, which travels along.
    A round lifts all trees by `most` levels: its shuffle by block is the queue between blocks. With ten levels, ten thousand
    million leaves take four rounds. `roots` has `tree` and `digest`.
    """
    rounds = []
    while True:
        blocks = materialize(_blocks(nodes, most), "tree_blocks")
        rounds.append(blocks)
        nodes = materialize(_roots(blocks, most), "tree_nodes")
        left = nodes.agg(F.max("nodes")).first()[0]
        if left is None or left == 1:
            return rounds, nodes.select("tree", "digest")


def descend(rounds: list[DataFrame], tops: DataFrame, most: int = BLOCK_LEVELS) -> DataFrame:
    """(row, digest, top, proof) of every leaf: proofs from the roots down to the leaves, round by round.

    `tops` has `tree`, `top` (anything that all leaves of the tree are to know) and `proof`, the steps above the tree's root.
    """
    above = tops.select("tree", F.lit(0).cast("long").alias("block"), "top", "proof")
    for blocks in reversed(rounds):
        row, top = blocks.schema["members"].dataType.elementType["row"].dataType, above.schema["top"].dataType
        flat = blocks.select("tree", "block", "nodes", F.col("members.digest").alias("digests"), F.col("members.row").alias("rows"))

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    digests, n = one.column("digests")[0].as_py(), one.column("nodes")[0].as_py()
                    block, size = one.column("block")[0].as_py(), len(digests)
                    levels = levels_of(n, most)
                    _, received = deliver_up(digests, levels)
                    proofs = deliver_down(received, size, levels, one.column("proof")[0].as_py())
                    first = block << most

                    def same(name: str) -> pa.Array:
                        return one.column(name).take(pa.array([0] * size, pa.int32()))

                    yield pa.RecordBatch.from_arrays(
                        [same("tree"), pa.array(range(first, first + size), pa.int64()), one.column("digests").flatten(),
                         one.column("rows").flatten(), same("top"), pa.array(proofs, pa.list_(STEP))],
                        ["tree", "block", "digest", "row", "top", "proof"])

        above = flat.join(above, ["tree", "block"]).mapInArrow(
            sweep, f"tree string, block long, digest string, row {row.simpleString()}, top {top.simpleString()}, proof {PROOF}")
    return above.select("row", "digest", "top", "proof")


def _place_leaves(leaves: DataFrame) -> DataFrame:
    """Adds `nodes` and `place`: the leaf's place in its tree, by `key`, digest and row, and the leaves of the tree.

    Leaves are dealt by ranges of the whole order, so that a tree with any share of the rows is spread. The driver
    gets one row per range: its first and last tree and their leaves there.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranged = materialize(
        leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "tree_leaves")
    ranged = ranged.withColumn("range", F.shiftright("at", 33))
    counts = ranged.groupBy("range", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ends = counts.groupBy("range").agg(
        F.min(F.struct("first", "tree", "n")).alias("head"), F.max(F.struct("first", "tree", "n")).alias("tail")).orderBy("range").collect()
    starts, open_tree, open_leaves = [], None, 0
    for part in ends:
        before = open_leaves if part["head"]["tree"] == open_tree else 0
        starts.append((part["range"], part["head"]["tree"], before))
        carried = before if part["tail"]["tree"] == part["head"]["tree"] else 0
        open_tree, open_leaves = part["tail"]["tree"], carried + part["tail"]["n"]
    before = F.broadcast(spark.createDataFrame(starts, "range long, tree string, before long"))
    sizes = counts.groupBy("tree").agg(F.sum("n").alias("nodes"))
    offsets = counts.join(sizes, "tree").join(before, ["range", "tree"], "left").select(
        "range", "tree", "nodes", (F.coalesce("before", F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(offsets, ["range", "tree"]).select(
        "tree", F.col("nodes").cast("long").alias("nodes"), (F.col("at") + F.col("shift")).alias("place"), "digest", "row")


def manifest(
    content: DataFrame, fields: Sequence[str] = CONTENT_FIELDS, group: str = "sourceLanguage", key: str = "content_id",
    keep: Sequence[str] = (), block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Hash tree over content rows: one row per row with `content_id`, `leaf`, `subroot`, `root`, `proof` and the columns in `keep`.

    A leaf is `field_hash` of the row's `fields`. The leaves of one `group` value ascend by `key`; while several nodes remain,
    every two consecutive ones (a last one alone) become the hash of their digests. What remains is the group's `subroot`; the
    subroots, ordered by group bytewise with null first, give `root` in the same way. `proof` lists the levels from the leaf to
    the root: the sibling's digest and whether it is the left one; no digest where a node was hashed alone.

    Rows with the same key are ordered by their leaves, equal rows are leaves of their own, null keys come first; null and empty
    texts differ. A single row is its own root, with an empty proof; no rows give no rows. Only `keep`, `key`, `group` and
    `fields` are read; a kept column may have any name but those of the result. `block_levels` sets how many levels one task takes at a
    time and changes nothing else.
    """
    key_value = F.col(f"`{key}`")
    for name in fields:
        kind = content.schema[name].dataType
        if not isinstance(kind, IntegralType) and kind.simpleString() != "string":
            raise ValueError(f"field {name} is {kind.simpleString()}; only text and whole numbers have one text form")
    named = content.select(
        F.concat(F.when(F.col(f"`{group}`").isNull(), "-").otherwise("="), F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(""))).alias("tree"),
        key_value.alias("key"),
        field_hash(*[F.col(f"`{name}`") for name in fields]).alias("digest"),
        F.struct(key_value.alias("key"), *[F.col(f"`{name}`").alias(f"keep{i}") for i, name in enumerate(keep)]).alias("row"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # Written once, so that dealing by ranges does not hash the texts twice.
    rounds, subroots = climb(_place_leaves(materialize(named, "leaves")), block_levels)
    single = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.col("tree").alias("row"), F.lit(0).alias("tie"))
    top_rounds, root = climb(_place_leaves(single), block_levels)
    # One root, so one row.
    top = descend(top_rounds, root.select("tree", F.col("digest").alias("top"), F.expr(f"cast(array() AS {PROOF})").alias("proof")), block_levels)
    tops = materialize(top.select(
        F.col("row").alias("tree"), F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"), "proof"), "subroots")
    return descend(rounds, tops, block_levels).select(
        F.col("row.key").alias("content_id"), F.col("digest").alias("leaf"), "top.subroot", "top.root", "proof",
        *[F.col(f"row.keep{i}").alias(name) for i, name in enumerate(keep)])


# --- proofs -------------------------------------------------------------------------------------
def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    def step(digest: Column, s: Column) -> Column:
        other = F.coalesce(s["digest"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(other, digest)).otherwise(F.concat(digest, other)).cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Hash of the siblings of a proof, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["digest"]), "").cast("binary"), 256)


def verified(leaf: Column, proof: Column, root: Column) -> Column:
    return let(fold(leaf, proof), lambda found: found == root)
