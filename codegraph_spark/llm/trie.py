"""Conversation prefix trie by ROLLUP over positional turn columns (operator 13).

A node is a distinct sequence of first turns. Turns become narrow rows early: two 64-bit hashes of role and text, and the
text's length. A conversation is cut into blocks of BLOCK turns, one row a block with one group of columns a position, keyed
by the node that the block before ends in. One `GROUP BY block, key, ROLLUP(position 1, position 2, ...)` then aggregates the
nodes of all depths of all blocks together; grouping_id() tells a node's depth in its block. No loop: the number of jobs
doesn't depend on the depth.

A node's name is its depth and the XOR of the hashes (two of 64 bits) of its turns, each salted with its position, so the node
before a block is known from a running aggregate. Sums over subtrees need no walk either: every node belongs to its smallest
member, a conversation's own nodes are the last ones of its path, so a second ROLLUP that adds up what members own gives the
subtree, less what the node's own conversation owns above it (a running sum).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_split

#: Positions a block; more of them make wider rows and more unused groups of short conversations.
BLOCK = 8
#: Ids that one row of a node's list of ends holds at most, as a power of two.
ENDS_BITS = 8


def turn_steps(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(steps, convs): steps(c, pos, ta, tb, chars), one row a turn, numbered from 1; convs(c, n), one row a conversation.

    Turns are ordered by turn, null first; turns that tie are ordered by the hash of role and text, so repeated rows are turns
    of their own and the order doesn't depend on how rows are stored. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation and take no part. Only hashes and lengths of texts are moved.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.xxhash64(F.lit(1), role, text).alias("ta"), F.xxhash64(F.lit(2), text, role).alias("tb"), F.length(text).cast("long").alias("chars")
    )
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "ta", "tb")
    return rows.select("c", F.row_number().over(order).cast("long").alias("pos"), "ta", "tb", "chars"), rows.groupBy("c").agg(F.count("*").alias("n"))


def with_shared_openings(steps: DataFrame, convs: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Steps and convs in which the first h turns of conversation c are those of conversation c - c % group; h is
    crc32(decimal c) % most. All turns of that conversation if it has fewer, none if there is no such conversation; then c's own
    turns after its first h, if any. A conversation may come out without turns."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    first = F.col("c") - F.col("c") % group
    sized = convs.select("c", "n", h.alias("h"), first.alias("first"))
    opening = convs.where(F.col("c") % group == 0).select(F.col("c").alias("first"), F.col("n").alias("n_first"))
    taken = F.least("h", F.coalesce("n_first", F.lit(0).cast("long")))
    sized = cut(sized.join(opening, "first", "left").select("c", "n", "h", "first", taken.alias("taken")))
    own = steps.join(sized, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "ta", "tb", "chars")
    lent = steps.where((F.col("c") % group == 0) & (F.col("pos") < most)).withColumnRenamed("c", "first")
    lent = lent.join(sized.where("taken > 0").select("c", "first", "taken"), "first").where("pos <= taken").select("c", "pos", "ta", "tb", "chars")
    return own.unionByName(lent), sized.select("c", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _xor(columns: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in columns:
        out = out.bitwiseXOR(F.coalesce(c, F.lit(0).cast("long")))
    return out


def _blocks(steps: DataFrame, convs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, ends): one row a block of a conversation; and the node that each conversation ends in."""
    salted = steps.select("c", "pos", F.xxhash64(F.lit(3), "pos", "ta", "tb").alias("a"), F.xxhash64(F.lit(4), "pos", "tb", "ta").alias("b"), "chars")
    order = Window.partitionBy("c").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut(salted.select("*", F.bit_xor("a").over(so_far).alias("pa"), F.bit_xor("b").over(so_far).alias("pb"), F.lead("pos").over(order).isNull().alias("last")))
    at = (F.col("pos") - 1) % size
    block = F.floor((F.col("pos") - 1) / size).cast("long").alias("block")
    one = lambda j, x: F.max(F.when(at == j, x))
    columns = [one(j, F.col(x)).alias(f"{x}{j}") for j in range(size) for x in ("a", "b", "chars")]
    keys = [one(0, F.col("p" + x).bitwiseXOR(F.col(x))).alias("k" + x) for x in "ab"]
    #: the depth of the conversation's last node, or one beyond the block where it goes on
    reach = F.coalesce(F.max(F.when(F.col("last"), F.col("pos"))), (F.first("block") + 1) * size + 1).alias("reach")
    blocks = run.withColumn("block", block).groupBy("c", "block").agg(*keys, reach, *columns)
    none = [F.lit(None).cast("long").alias(f"{x}{j}") for j in range(size) for x in ("a", "b", "chars")]
    zero = F.lit(0).cast("long")
    bare = convs.where("n = 0").select("c", zero.alias("block"), zero.alias("ka"), zero.alias("kb"), zero.alias("reach"), *none)
    ends = run.where("last").select("c", F.col("pos").alias("depth"), "pa", "pb").union(convs.where("n = 0").select("c", zero, zero, zero))
    return cut(blocks.unionByName(bare)), ends


def _rollup(blocks: DataFrame, size: int, measures: str) -> DataFrame:
    """depth, pa, pb, the parent's ppa and ppb, chars of the last turn, and the measures of every node."""
    places = ", ".join(f"(a{j}, b{j}, chars{j})" for j in range(size))
    columns = ", ".join(f"{x}{j}" for j in range(size) for x in ("a", "b", "chars"))
    rolled = blocks.sparkSession.sql(f"SELECT block, ka, kb, {columns}, {measures}, grouping_id() AS gid FROM {{blocks}} GROUP BY block, ka, kb, ROLLUP({places})", blocks=blocks)
    within = (F.lit(3 * size) - F.bit_count("gid")) / 3
    filled = sum((F.col(f"a{j}").isNotNull().cast("int") for j in range(size)), F.lit(0))
    last = lambda x: F.coalesce(*[F.col(f"{x}{j}") for j in reversed(range(size))], F.lit(0).cast("long"))
    named = [_xor([F.col("k" + x), *[F.col(f"{x}{j}") for j in range(size)]]) for x in "ab"]
    # groups deeper than their conversations are no nodes; a block's empty prefix is the last node of the block before
    nodes = rolled.where((filled == within) & ((within > 0) | (F.col("block") == 0)))
    names = [m.rsplit(" AS ", 1)[1] for m in measures.split(", ")]
    parents = [named[n].bitwiseXOR(last(x)).alias("pp" + x) for n, x in enumerate("ab")]
    return nodes.select((F.col("block") * size + within.cast("long")).alias("depth"), named[0].alias("pa"), named[1].alias("pb"), *parents, last("chars").alias("chars"), *names)


def _digest_ends(ends: DataFrame) -> DataFrame:
    """(depth, pa, pb, ends_sha256): digest of the ids that end in a node, in order, comma-joined.

    Ids are joined in rows of a bounded number of them; a node's rows are then read in order, one after another, and only the
    digest's state is held, however many conversations end in one node.
    """
    lists = ends.groupBy("depth", "pa", "pb", F.shiftright("c", ENDS_BITS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    lists = lists.repartition("depth", "pa", "pb").sortWithinPartitions("depth", "pa", "pb", "part")

    def run(batches):
        key, state, names = None, None, ["depth", "pa", "pb", "ends_sha256"]
        for batch in batches:
            out = []
            for *now, ids in zip(*[batch.column(n).to_pylist() for n in (0, 1, 2, 4)], strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names)

    return lists.mapInArrow(run, "depth long, pa long, pb long, ends_sha256 string")


def trie_nodes(steps: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of `steps` (c, pos, ta, tb, chars; pos from 1 without gaps) of all `convs` (c, n).

    conv_id: smallest member; depth; parent_conv_id (root: null); n_convs: members, the node's own ends included; n_children;
    n_leaves: childless nodes of its subtree; saved_tokens: summed over its subtree, (n_convs - 1) times the code points of a
    node's last text; ends_sha256. No conversations give no nodes; conversations without turns are members of the root alone.
    """
    name = ["depth", "pa", "pb"]
    blocks, ends = _blocks(steps, convs, block)
    worth = ((F.col("n_convs") - 1) * F.col("chars")).alias("worth")
    nodes = cut(_rollup(blocks, block, "min(c) AS conv_id, count(*) AS n_convs, max(reach) AS reach").select("*", worth, (F.col("reach") == F.col("depth")).alias("leaf")).drop("reach", "chars"))
    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("worth").alias("worth"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    sums = _rollup(blocks.join(owned, "c"), block, "sum(worth) AS held, sum(leaf) AS n_leaves").select(*name, "held", "n_leaves")

    path = Window.partitionBy("conv_id").orderBy("depth")
    above = F.coalesce(F.sum("worth").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("above")
    nodes = cut(nodes.select("*", above, F.lag("conv_id").over(path).alias("parent_conv_id")))
    # a node whose parent belongs to another conversation looks it up; parents of many children (the root) are split off
    branch = nodes.where("parent_conv_id IS NULL AND depth > 0").select(*name, (F.col("depth") - 1).alias("pd"), "ppa", "ppb")
    parents = nodes.select(F.col("depth").alias("pd"), F.col("pa").alias("ppa"), F.col("pb").alias("ppb"), F.col("conv_id").alias("parent_conv_id"))
    found = join_split(branch, parents, ["pd", "ppa", "ppb"]).select(*name, "parent_conv_id")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ppa").alias("pa"), F.col("ppb").alias("pb")).agg(F.count("*").alias("n_children"))
    every = nodes.select(*name, "conv_id", "parent_conv_id", "n_convs", "above")
    for part in (found, children, sums, _digest_ends(ends)):
        every = every.unionByName(part, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    merged = every.groupBy(*name).agg(*[F.max(x).alias(x) for x in ("conv_id", "parent_conv_id", "n_convs", "above", "n_children", "held", "n_leaves", "ends_sha256")])
    return merged.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("held") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, block: int = BLOCK, **columns: str) -> DataFrame:
    """trie_nodes() of conversations as they are; see turn_steps() for columns, order, nulls and repeated rows. Other columns
    are ignored."""
    return trie_nodes(*turn_steps(turns, **columns), block)
