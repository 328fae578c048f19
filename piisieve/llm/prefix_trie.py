"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

*Trie.* A conversation's turns, in order, spell a path from the root. The prefix of length d is known by d and
two 64-bit exclusive-or sums of hashes of (place, turn digest), so prefixes come from running sums over
blocks of turns and no row ever holds a conversation. Prefixes that agree are one node, named by its
depth and its smallest member. A node's own weight is its number of members; the weight of its whole
subtree, the sum of (length - depth + 1) over its members, comes out of the same aggregation.

*Decomposition.* Each component of the parent-edge forest has a top, and every node knows the weight of
its subtree inside the component. The nodes with more than half of the top's weight form a path that starts
at the top; the deepest is the centroid. Taking it out leaves the trees of its children and the part
above, none heavier than half; on the path above it the centroid's weight is subtracted. After
log2(weight) rounds at most nothing is left, however deep or lopsided the trie is.

*Rollup.* A round's total below a centroid, one aggregation by component, is added to each node on the path from
the centroid to the top. The sum of what a node received over all rounds is its subtree's total.

To split a component, a node below the centroid's depth asks for its ancestor at that depth: the node
itself says so if the depth lies in the part of the path that its smallest member alone names, else a row
(smallest member, depth) of the prefix table does.

Defined results: null role or text is empty; turns order by turn (null first), then by md5 of role and text;
repeated rows are turns of their own; a null conv_id belongs to no conversation and its rows are left
out; an empty table has no node; extra columns are ignored; long texts enter as digest and length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import with_row_index
from .tables import stored

BLOCK_TURNS = 1024
MAX_HEAD_TURNS = 5
CHUNK_IDS = 4096


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def ordered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, idx, digest, chars): turns numbered from 0 in each conversation. Narrow rows are range-sorted, so a
    conversation of any size is split over tasks."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     turn_digest(r, t).alias("digest"), F.length(t).cast("long").alias("chars")).filter("conv_id IS NOT NULL")
    ranked = stored(with_row_index(rows, ["conv_id", "turn", "digest"], "place").drop("turn"), "turns")
    first = ranked.groupBy("conv_id").agg(F.min("place").alias("first"))
    return ranked.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first")).alias("idx"), "digest", "chars")


def with_shared_heads(turns: DataFrame, every: int = 100) -> DataFrame:
    """(conv_id, pos, digest, chars) and, for conversations without turns, pos null: each conversation c starts with
    the first h turns of conversation c - c % every (all if fewer, none if absent) in place of its own first
    h, h = crc32(c) % 6. pos starts at 1."""
    turns = stored(turns, "ordered")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
                         F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MAX_HEAD_TURNS + 1)).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns")), "base", "left")
    convs = stored(convs.withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0).cast("long")))), "heads")
    heads = turns.filter(F.col("idx") < MAX_HEAD_TURNS).withColumnRenamed("conv_id", "base")
    head = convs.join(heads, "base").filter("idx < h").select("conv_id", (F.col("idx") + 1).alias("pos"), "digest", "chars")
    own = turns.join(convs, "conv_id").filter("idx >= h").select(
        "conv_id", (F.col("idx") - F.col("h") + F.col("taken") + 1).alias("pos"), "digest", "chars")
    none = convs.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"),
                        F.lit(0).cast("long").alias("chars"))
    return head.unionByName(own).unionByName(none)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, chars, turns): one row per prefix of each conversation of (conv_id, pos, digest,
    chars), the empty one included; (depth, a, b) names the prefix, (depth - 1, pa, pb) its parent.

    Running exclusive-or sums in two levels: inside blocks of turns, and over the totals of the blocks."""
    rows = turns.filter("pos IS NOT NULL").withColumns({
        "block": F.floor(F.col("pos") / BLOCK_TURNS), "ha": F.xxhash64("pos", "digest"), "hb": F.xxhash64("digest", F.lit("second"), "pos")})
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = blocks.select("conv_id", "block", F.coalesce(F.bit_xor("ta").over(before), zero).alias("sa"),
                           F.coalesce(F.bit_xor("tb").over(before), zero).alias("sb"))
    lengths = blocks.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    summed = rows.withColumns({"wa": F.bit_xor("ha").over(inside), "wb": F.bit_xor("hb").over(inside)})
    a, b = F.col("wa").bitwiseXOR(F.col("sa")), F.col("wb").bitwiseXOR(F.col("sb"))
    paths = summed.join(starts, ["conv_id", "block"]).join(lengths, "conv_id").select(
        "conv_id", F.col("pos").alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("ha")).alias("pa"),
        b.bitwiseXOR(F.col("hb")).alias("pb"), "chars", "turns")
    roots = turns.select("conv_id").distinct().join(lengths, "conv_id", "left").select(
        "conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), zero.alias("chars"),
        F.coalesce("turns", zero).alias("turns"))
    return paths.unionByName(roots)


def trie_nodes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (owner, depth, parent, n_convs, weight, chars, n_children) and the prefix rows as (conv_id, depth, owner)."""
    grouped = paths.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
        F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    grouped = stored(grouped, "nodes")
    children = grouped.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"))
    names = grouped.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent"))
    nodes = (grouped.join(children, ["depth", "a", "b"], "left").join(names, ["depth", "pa", "pb"], "left")
             .select("owner", "depth", "parent", "n_convs", "weight", "chars", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children")))
    members = paths.join(grouped.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).select("conv_id", "depth", "owner")
    return stored(nodes, "trie"), stored(members, "members")


def decomposition(nodes: DataFrame, members: DataFrame, values: list[str]) -> list[DataFrame]:
    """Rounds of the centroid decomposition of (owner, depth, weight, *values): tables of node, its component's top
    (top, top_depth), ``path`` (from top to centroid) and ``under`` (in the centroid's subtree)."""
    own = members.filter("owner = conv_id").groupBy(F.col("conv_id").alias("owner")).agg(F.min("depth").alias("since"))
    # ancestors that another conversation names: (owner, depth) -> its name there and one step further down
    shared = members.filter("owner <> conv_id").join(own.withColumnRenamed("owner", "conv_id"), "conv_id")
    steps = members.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("owner").alias("next"))
    shared = stored(shared.join(steps, ["conv_id", "depth"]).select(
        F.col("conv_id").alias("owner"), F.col("depth").alias("at"), F.col("owner").alias("above"), "next"), "ancestors")
    root = nodes.filter("depth = 0").agg(F.min("owner").alias("top")).first()["top"]  # one number
    state = stored(nodes.select("owner", "depth", "weight", *values).join(own, "owner").withColumns(
        {"top": F.lit(root).cast("long"), "top_depth": F.lit(0).cast("long")}), "state")
    comp, rounds = ["top", "top_depth"], []
    while not state.isEmpty():
        total = state.groupBy(*comp).agg(F.max("weight").alias("total"))
        # stored, so that a join by a large component is not bound to the aggregation after it and can be split
        heavy = stored(state.join(total, comp).withColumn("path", 2 * F.col("weight") > F.col("total")).drop("total"), "heavy")
        centre = heavy.filter("path").groupBy(*comp).agg(
            F.max_by(F.struct(F.col("owner").alias("c"), F.col("depth").alias("c_depth"), F.col("weight").alias("c_weight")), "depth").alias("m"))
        half = heavy.join(centre.select(*comp, "m.*"), comp)
        # above the depth since which the node's name is its own, the ancestor's name is looked up
        asked = half.withColumn("at", F.when(F.col("c_depth") < F.col("since"), F.col("c_depth")).otherwise(-1))
        known = asked.join(shared, ["owner", "at"], "left")
        below = F.col("depth") >= F.col("c_depth")
        under = F.when(F.col("at") < 0, (F.col("owner") == F.col("c")) & below).otherwise(F.col("above") == F.col("c"))
        done = stored(known.select("owner", "depth", "weight", *values, "since", *comp, "path", "c", "c_depth", "c_weight",
                                   F.coalesce("next", "owner").alias("next"), under.alias("under")), "round")
        rounds.append(done)
        is_centre = (F.col("owner") == F.col("c")) & (F.col("depth") == F.col("c_depth"))
        state = done.filter(~is_centre).select(
            "owner", "depth", F.when(F.col("path"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"),
            *values, "since", F.when(F.col("under"), F.col("next")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"))
    return rounds


def subtree_sums(rounds: list[DataFrame], values: list[str]) -> DataFrame:
    """(owner, depth, *values summed over the subtree): component totals added along centroid-to-top paths."""
    rows = rounds[0].withColumn("round", F.lit(0))
    for i, r in enumerate(rounds[1:], 1):
        rows = rows.unionByName(r.withColumn("round", F.lit(i)))
    comp = ["round", "top", "top_depth"]
    totals = rows.filter("under").groupBy(*comp).agg(*[F.sum(v).alias(v) for v in values])
    return (rows.filter("path").select(*comp, "owner", "depth").join(totals, comp)
            .groupBy("owner", "depth").agg(*[F.sum(v).alias(v) for v in values]))


def _chunks(batches):
    """Runs of conversation ids of a node joined by commas, at most CHUNK_IDS to a row."""
    node, ids = None, []

    def row():
        return (*node, ids[0], ",".join(map(str, ids)))

    for b in batches:
        out = []
        for owner, depth, conv in zip(*(c.to_pylist() for c in b.columns)):
            if ids and ((owner, depth) != node or len(ids) == CHUNK_IDS):
                out.append(row())
                ids = []
            node = (owner, depth)
            ids.append(conv)
        yield _named(out, ["owner", "depth", "first", "ids"], [pa.int64()] * 3 + [pa.string()])
    if ids:
        yield _named([row()], ["owner", "depth", "first", "ids"], [pa.int64()] * 3 + [pa.string()])


def _digests(batches):
    node, sha = None, None
    for b in batches:
        out = []
        for owner, depth, ids in zip(*(c.to_pylist() for c in b.columns)):
            if (owner, depth) == node:
                sha.update(b",")
            else:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (owner, depth), hashlib.sha256()
            sha.update(ids.encode())
        yield _named(out, ["owner", "depth", "ends_sha256"], [pa.int64()] * 2 + [pa.string()])
    if node:
        yield _named([(*node, sha.hexdigest())], ["owner", "depth", "ends_sha256"], [pa.int64()] * 2 + [pa.string()])


def _named(rows, names, types) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (owner, depth, conv_id): ids are packed into long strings where they were range-sorted;
    only those strings meet in one task for a node."""
    packed = (ends.select("owner", "depth", "conv_id").repartitionByRange("owner", "depth", "conv_id")
              .sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(_chunks, "owner long, depth long, first long, ids string"))
    return (packed.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first")
            .select("owner", "depth", "ids").mapInArrow(_digests, "owner long, depth long, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, pos from 1, digest, chars; pos null for one without
    turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = stored(prefixes(turns), "prefixes")
    nodes, members = trie_nodes(paths)
    if nodes.isEmpty():
        return nodes.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                            F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                            F.lit("").alias("ends_sha256"))
    valued = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    sums = subtree_sums(decomposition(valued, members, ["n_leaves", "saved_tokens"]), ["n_leaves", "saved_tokens"])
    lengths = paths.groupBy("conv_id").agg(F.max("turns").alias("depth"))
    ends = end_digests(members.join(lengths, ["conv_id", "depth"]))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(sums, ["owner", "depth"]).join(ends, ["owner", "depth"], "left")
            .select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")))
