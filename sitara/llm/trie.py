"""Conversation prefix trie: shared beginnings of conversations, and what caching them would save.

A node is a distinct sequence of first turns. Its identity is its depth and 128
bits of hash, a running exclusive-or over its turns' hashes with their places;
its name is its smallest member and its depth. The nodes of one smallest member
are a run of the trie, each the parent of the next, so subtree totals are
computed by peeling runs: every run holds a counter of the runs below it that
are not done; a run whose counter is zero sends its totals to the node it hangs
from; this goes on until only the root's run is left. Totals of nodes inside
a run are sums from its end. So the rounds follow how often conversations
branch off from one another, not their length.

Texts leave the plan at the scan; only hashes and lengths are shuffled. Turns
are ranked after a sort by ranges, and sums along a conversation are taken over
blocks of it, so one conversation may hold any share of the turns. Equal
conversations meet as partial aggregates. Members that end at one node are
joined to pieces of text by range, and only the pieces of a node are hashed
one after another, as SHA-256 demands.

Defined results: rows without a conv_id are dropped; a null role or text is
empty; turns of equal number come by role, then by the text's first 32
characters, then by its hash; repeated rows are turns of their own; a table
without conversations gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitara.llm.common import bounded_batches, join_counted, materialize, pick_columns, release, shuffle_partitions, small

#: Turns of a conversation that are summed as one block.
BLOCK_BITS = 15
#: Conversations whose ids make one piece of text at most.
PIECE = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ranked_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), a and b (hashes of role and text), n_bytes of every turn.

    Sorted by ranges, so that a conversation may lie in several partitions;
    each partition begins inside one conversation at most, so the table of
    where ranks start has as many rows as there are partitions, and is broadcast.
    """
    pick_columns(turns, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, 32).alias("begin"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "begin", "a", "row"]
    dealt = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    # Written with its partition and place in it: a sort by sampled ranges need not come out alike twice.
    laid = materialize(dealt.select("conv_id", "a", "b", "n_bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    parts = laid.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    split = parts.join(F.broadcast(parts.groupBy("conv_id").count().where("count > 1").select("conv_id")), "conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at")) - 1
    ranked = laid.withColumn("local", local).join(F.broadcast(starts), ["conv_id", "part"], "left")
    ranked = ranked.select("conv_id", (F.col("local") + F.coalesce("start", F.lit(0))).alias("place"), "a", "b", "n_bytes")
    return materialize(ranked, "ranked", instead=laid)


def rebuilt(ranked: DataFrame, every: int, heads: int) -> DataFrame:
    """conv_id, place, a, b, n_bytes of every turn of the rebuilt conversations, and one row of place -1 for each.

    The head of conversation c is the first ``h`` turns of conversation
    ``c - c % every``, ``h = crc32(decimal c) % heads``; then come c's own turns
    after its first h.
    """
    n = ranked.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(every))
    convs = n.withColumn("base", base).withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)))
    lengths = n.where(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lengths, "base", "left").select("conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    convs = materialize(convs, "convs")
    total = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Only turns past the head are the conversation's own.
    own = join_counted(ranked, convs.select("conv_id", "n", "h", "taken"), "conv_id", total).where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "n_bytes")
    # A base has fewer than `heads` turns here, and at most `every` conversations take them.
    shared = ranked.where((F.pmod("conv_id", F.lit(every)) == 0) & (F.col("place") < heads - 1)).withColumnRenamed("conv_id", "base")
    head = shared.join(convs.select("base", "conv_id", "taken"), "base").where("place < taken").select("conv_id", "place", "a", "b", "n_bytes")
    roots = convs.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n_bytes"))
    return roots.unionByName(own).unionByName(head)


def _running(rows: DataFrame, order: str, sums: dict[str, tuple[Column, Callable[[Column], Column], Callable[[Column, Column], Column]]], down: bool = False) -> DataFrame:
    """``rows`` with running totals along each conversation by ``order``, each row included; ``down``: from the end.

    ``sums``: name to (what, aggregate, how two totals add up). Totals run inside
    blocks of 2**15 places; blocks of a conversation that has several start from
    those before them, a table of a row for each, joined by broadcast if it is small.
    """
    block = F.shiftright(F.col(order), BLOCK_BITS).alias("block")
    by = lambda c: F.col(c).desc() if down else F.col(c).asc()
    kept = rows.columns
    rows = materialize(rows, "rows").select("*", block, *[what.alias(f"__{n}") for n, (what, _, _) in sums.items()])
    inside = Window.partitionBy("conv_id", "block").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    ran = rows.select(*kept, "block", *[total(F.col(f"__{n}")).over(inside).alias(n) for n, (_, total, _) in sums.items()])
    long = rows.where(F.col("block") > 0).select("conv_id").distinct()
    blocks = rows.join(small(long), "conv_id", "left_semi").groupBy("conv_id", "block").agg(*[total(F.col(f"__{n}")).alias(n) for n, (_, total, _) in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy(by("block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("conv_id", "block", *[total(F.col(n)).over(earlier).alias(f"__{n}") for n, (_, total, _) in sums.items()])
    out = ran.join(small(starts), ["conv_id", "block"], "left")
    return out.select(*kept, *[add(F.col(n), F.coalesce(f"__{n}", F.lit(0))).cast("long").alias(n) for n, (_, _, add) in sums.items()])


def prefixes(turns: DataFrame) -> DataFrame:
    """Rebuilt turns as trie nodes met: conv_id, depth, x and y (the prefix), px and py (its parent), n_bytes."""
    # The root's row has no hash of its own.
    e = {n: F.when(F.col("place") < 0, F.lit(0)).otherwise(F.xxhash64(F.lit(k), "place", "a", "b")).cast("long") for k, n in ((3, "x"), (5, "y"))}
    rows = turns.select("conv_id", (F.col("place") + 1).alias("depth"), "n_bytes", e["x"].alias("ex"), e["y"].alias("ey"))
    xor = lambda a, b: a.bitwiseXOR(b)
    ran = _running(rows, "depth", {"x": (F.col("ex"), F.bit_xor, xor), "y": (F.col("ey"), F.bit_xor, xor)})
    return ran.select("conv_id", "depth", "n_bytes", "x", "y", xor(F.col("x"), F.col("ex")).alias("px"), xor(F.col("y"), F.col("ey")).alias("py"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, x, y, conv_id) sorted so: a piece of text for each node, or more if it has many rows."""
    key, first, ids = None, None, []

    def cut() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": key[0], "x": key[1], "y": key[2], "first": first, "piece": ",".join(map(str, ids))}], schema=_PIECES)

    for b in batches:
        columns = [b.column(i).to_numpy() for i in range(4)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1 if b.num_rows > 1 else np.array([], int)
        edges = [0, *change.tolist(), b.num_rows]
        out = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            for at in range(lo, hi, PIECE):
                here, more = tuple(int(c[lo]) for c in columns[:3]), columns[3][at : min(hi, at + PIECE)].tolist()
                if ids and (here != key or len(ids) + len(more) > PIECE):
                    out.append(cut())
                    ids = []
                if not ids:
                    key, first = here, more[0]
                ids = ids + more
        yield from out
    if ids:
        yield cut()


_PIECES = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
_SHAS = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id: the hash of each node's pieces joined by commas."""
    key, h = None, None
    for b in batches:
        done = []
        for r in b.to_pylist():
            here = (r["depth"], r["x"], r["y"])
            if here != key:
                if key is not None:
                    done.append((*key, h.hexdigest()))
                key, h = here, hashlib.sha256(r["piece"].encode())
            else:
                h.update(b"," + r["piece"].encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], schema=_SHAS)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], schema=_SHAS)


def ends(met: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 of every node where a conversation ends."""
    last = met.groupBy("conv_id").agg(F.max(F.struct("depth", "x", "y")).alias("at")).select("at.*", "conv_id")
    order = ["depth", "x", "y", "conv_id"]
    n = shuffle_partitions(met.sparkSession)
    sorted_ = bounded_batches(last.repartitionByRange(n, *order).sortWithinPartitions(*order))
    pieces = sorted_.mapInArrow(_pieces, "depth long, x long, y long, first long, piece string")
    chained = pieces.repartition(n, "depth", "x", "y").sortWithinPartitions("depth", "x", "y", "first")
    return chained.mapInArrow(_chain, "depth long, x long, y long, ends_sha256 string")


def peel(runs: DataFrame, saved: str = "saved", leaves: str = "leaves") -> DataFrame:
    """Totals of each run and all runs below it: parent_conv_id, at_depth, leaves, saved, for runs but the root's.

    ``runs``: conv_id, parent_conv_id, at_depth (null for the root's run),
    waiting (runs that hang from it), and its own leaves and saved. Each round
    takes the runs that wait for none, adds their totals to those that they
    hang from, and writes what is left.
    """
    columns, done, left = ["parent_conv_id", "at_depth", leaves, saved], [], runs
    zero = lambda c: F.coalesce(c, F.lit(0))
    while True:
        # A run of a tree that is not done has one below it that waits for none, so every round takes some.
        hangs = F.col("parent_conv_id").isNotNull()
        sent = materialize(left.where((F.col("waiting") == 0) & hangs).select(*columns), "sent")
        if sent.isEmpty():
            release(sent, left)
            break
        done.append(sent.made_at)
        told = sent.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("__n"), F.sum(leaves).alias("__leaves"), F.sum(saved).alias("__saved"))
        rest = left.where((F.col("waiting") > 0) | ~hangs).join(told, "conv_id", "left")
        rest = rest.select("conv_id", "parent_conv_id", "at_depth", (F.col("waiting") - zero("__n")).alias("waiting"), (F.col(leaves) + zero("__leaves")).alias(leaves), (F.col(saved) + zero("__saved")).alias(saved))
        left = materialize(rest, "left", instead=left)
    spark, schema = runs.sparkSession, runs.select(*columns).schema
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def trie(conversations: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ranked = ranked_turns(conversations)
    met = materialize(prefixes(rebuilt(ranked, every, heads)), "prefixes", instead=ranked)
    any_ = [F.any_value(c).alias(c) for c in ("n_bytes", "px", "py")]
    nodes = met.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *any_)
    nodes = nodes.join(ends(met), ["depth", "x", "y"], "left")
    nodes = materialize(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
    # The top of each run, and the node that it hangs from: as many as there are distinct conversations.
    key = lambda x, y, depth: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), depth.alias("depth"))
    runs = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "px", "py")).alias("top"), F.max("depth").alias("bottom"), F.sum("own").alias("saved"))
    tops = runs.where("top.depth > 0").select("conv_id", "bottom", "saved", key("top.px", "top.py", F.col("top.depth") - 1).alias("key"))
    tops = materialize(tops, "tops")
    hung = tops.groupBy("key").agg(F.count("*").alias("n"))
    owners = nodes.select(key("x", "y", F.col("depth")).alias("key"), F.col("conv_id").alias("parent_conv_id")).join(hung, "key")
    hanging = join_counted(tops, materialize(owners, "owners"), "key", tops.count())
    hanging = hanging.select("conv_id", "bottom", "saved", "parent_conv_id", F.col("key.depth").alias("at_depth"))
    root = runs.where("top.depth = 0").select("conv_id", "bottom", "saved", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(None).cast("long").alias("at_depth"))
    hanging = materialize(hanging.unionByName(root), "runs")
    below = hanging.where("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("at_depth").alias("bottom")).agg(F.count("*").alias("n"))
    below = materialize(below, "below")
    waiting = below.groupBy("conv_id").agg(F.sum("n").alias("waiting"))
    # A run ends in a leaf unless another hangs from its last node.
    state = hanging.join(waiting, "conv_id", "left").join(below, ["conv_id", "bottom"], "left")
    state = state.select("conv_id", "parent_conv_id", "at_depth", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.when(F.col("n").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved", "bottom")
    state = materialize(state, "state")
    sums = peel(state.drop("bottom")).groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("at_depth").alias("depth")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    bottoms = state.select("conv_id", F.col("bottom").alias("depth"), F.col("leaves").alias("own_leaf"), F.lit(1).alias("last"))
    tops = state.where("parent_conv_id IS NOT NULL").select("conv_id", (F.col("at_depth") + 1).alias("depth"), F.col("parent_conv_id").alias("above"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    at = ["conv_id", "depth"]
    whole = nodes.join(sums, at, "left").join(bottoms, at, "left").join(tops, at, "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs",
        (zero("hung") + F.when(F.col("last").isNull(), 1).otherwise(0)).alias("n_children"),
        (zero("leaves") + zero("own_leaf")).alias("l"), (F.col("own") + zero("saved")).alias("s"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    add = lambda a, b: a + b
    out = _running(whole, "depth", {"n_leaves": (F.col("l"), F.sum, add), "saved_tokens": (F.col("s"), F.sum, add)}, down=True)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256")
