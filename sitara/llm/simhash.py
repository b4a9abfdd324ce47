"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint becomes a point of 32 small numbers: the bits set in
each segment of two bits. The Manhattan distance of two points is at most
the Hamming distance of their fingerprints, so links of radius 3 are found
among points at distance 3 or less. The points lie in a grid: their
coordinates form six parts, and as a distance of 3 touches three parts at
most, linked points agree on some three parts; each choice of three is a grid
key, and in a cell points sorted by the bits set in the other parts are
compared only within a range of 3. Candidates are checked by Manhattan, then
by exact Hamming distance.

A cell gives back no pairs but one row for each member that joins another, so
a group of copies costs as many rows as it has members.

The pipeline's stage ``keep_one`` follows another rule: texts are near copies
if the Jaccard similarity of their five-word shingles is 0.8 or more. In 64 bits
such pairs differ in up to 19, which the grid cannot carry, so candidates
come from the links of fingerprints and, for pairs beyond their radius, from
bands of MinHash values; exact similarity decides on both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitara.llm.blocks import Block, mix, text_blocks
from sitara.llm.common import bounded_batches, join_counted, join_groups, materialize, pick_columns, release, shuffle_partitions, small

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Cells with more members are compared block by block, each pair of blocks apart.
CELL_ROWS = 20_000
#: A node with fewer edges needs no care of its own.
HUB = 1_000
#: Bits of the six parts: whole segments of two bits.
PARTS = (12, 12, 10, 10, 10, 10)
_LOW = 0x5555555555555555
#: Shingle size and least similarity of near copies, for ``keep_one``.
COPY_SHINGLE = 5
COPY_SIMILARITY = 0.8
#: Bands of MinHash values. At similarity 0.8 a pair shares none of them once in 38,000 (0.59 ** 20).
BANDS, BAND_ROWS = 20, 4
#: Shingles of a block of a cell's members, 8 bytes each: a task holds two blocks at most, or two texts.
COPY_WEIGHT = 1 << 21
#: Shingles of texts that one text is compared with at once.
COPY_HASHES = 1 << 18
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _draw.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _part_masks() -> list[int]:
    masks, at = [], 0
    for width in PARTS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


#: For each choice of three parts: the mask of their bits.
KEYS = [sum(m) for m in combinations(_part_masks(), 3)]


def _bits_majority(hashes: np.ndarray, borders: list[int]) -> np.ndarray:
    """Fingerprints of runs of hashes: a bit is set if over half the run have it."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(borders) - 1, 64), dtype=np.uint8)
    for i, (s, e) in enumerate(zip(borders, borders[1:], strict=False)):
        if e > s:
            out[i] = bits[s:e].sum(axis=0, dtype=np.int32) * 2 > e - s
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_batch(texts: pa.Array, shingle: int = SHINGLE) -> pa.Array:
    """Fingerprints of whole texts, as signed 64-bit numbers."""
    digest, done, held, borders = xxhash.xxh64_intdigest, [], [], [0]

    def flush() -> None:
        if len(borders) > 1:
            flat = np.concatenate(held) if held else np.zeros(0, np.uint64)
            done.append(_bits_majority(flat, borders))
            held.clear()
            borders[:] = [0]

    for scalar in texts:
        buf = scalar.as_buffer()
        words = buf.to_pybytes().lower().split() if buf is not None else []
        text, n = b" ".join(words), len(words)
        if n > shingle:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = [0, *(ends[: n - shingle] + 1).tolist()]
            got = np.fromiter((digest(text[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)
        else:
            got = np.array([digest(text, SEED)] if n else [], dtype=np.uint64)
        held.append(got)
        borders.append(borders[-1] + len(got))
        if borders[-1] > 100_000:
            flush()
    flush()
    all_ = np.concatenate(done) if done else np.zeros(0, np.uint64)
    return pa.array(all_.view(np.int64), pa.int64())


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    return fingerprint_batch(texts)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _embed(fp: np.ndarray) -> np.ndarray:
    """Points, packed: 32 numbers 0 to 2 in unary code (00, 01, 11)."""
    low = np.uint64(_LOW)
    return ((fp | (fp >> np.uint64(1))) & low) | (fp & (fp << np.uint64(1)) & ~low)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distances of packed points: numbers in unary code differ in as many bits."""
    return np.bitwise_count(a ^ b)


def cell_links(cell: np.ndarray, fp: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) fingerprints of the linked groups inside cells.

    Rows come sorted by cell, then by ``rest``, the bits set outside the cell's
    key. Row i is compared with i+1, i+2, ... while cell and range allow.
    """
    n = len(fp)
    point, root = _embed(fp), np.arange(n)
    left = np.arange(n)
    step = 0
    while len(left):
        step += 1
        left = left[left + step < n]
        right = left + step
        near = (cell[left] == cell[right]) & (rest[right] - rest[left] <= RADIUS)
        left, right = left[near], right[near]
        i, j = root[left], root[right]
        open_ = np.flatnonzero(i != j)
        a, b = left[open_], right[open_]
        keep = _manhattan(point[a], point[b]) <= RADIUS
        a, b = a[keep], b[keep]
        keep = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
        a, b = root[a[keep]], root[b[keep]]
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows (cell, fp, rest); a cell that a batch may cut is held back for the next."""
    held: list[pa.Table] = []

    def emit(t: pa.Table) -> pa.RecordBatch:
        cell = t.column("cell").to_numpy()
        fp, rest = t.column("fp").to_numpy().view(np.uint64), t.column("rest").to_numpy().astype(np.int64)
        again = np.flatnonzero(cell[1:] == cell[:-1])
        pick = np.zeros(len(cell), dtype=bool)
        pick[again], pick[again + 1] = True, True
        a, b = cell_links(cell[pick], fp[pick], rest[pick])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        cut = 0 if cell[0] == cell[-1] else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
        table = pa.Table.from_batches([batch])
        if cut == 0 and (not held or held[-1].column("cell")[0].as_py() == cell[0]):
            held.append(table)
            continue
        yield emit(pa.concat_tables([*held, table.slice(0, cut)]))
        held = [table.slice(cut)]
    if held:
        yield emit(pa.concat_tables(held))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints ``fp`` that are linked, over one or more links."""
    low = F.lit(_LOW)
    either = F.col("fp").bitwiseOR(F.shiftrightunsigned("fp", 1)).bitwiseAND(low)
    point = either.bitwiseOR(F.col("fp").bitwiseAND(F.shiftleft("fp", 1)).bitwiseAND(F.bitwise_not(low)))
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(_signed(m)).alias("m")) for c, m in enumerate(KEYS)])
    cells = fps.select("fp", point.alias("point"), F.explode(keys).alias("key"))
    inside, outside = F.col("point").bitwiseAND(F.col("key.m")), F.bitwise_not(F.col("key.m")).bitwiseAND(F.col("fp"))
    cells = cells.select("fp", F.xxhash64("key.c", inside).alias("cell"), F.bit_count(outside).alias("rest"))
    large = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    cells = cells.join(large, "cell", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    others = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    cells = cells.withColumn("block", block).withColumn("other", others)
    pair = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    cells = cells.select(F.when(F.col("blocks") > 1, pair).otherwise(F.col("cell")).alias("cell"), "fp", "rest")
    dealt = cells.repartition(shuffle_partitions(fps.sparkSession), "cell").sortWithinPartitions("cell", "rest", "fp")
    return dealt.mapInArrow(_links, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph's components, by alternating large and small stars.

    Every round is joins and minima over edges; only the counts that tell
    whether a round changed anything reach the driver. The edges of a node
    with a large share of all edges stay where they are: its minimum goes to
    them. Every star is written, so no plan holds more than one.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, both: bool) -> DataFrame:
        around = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        least = materialize(least, "minima")
        size = least.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
        joined = join_counted(around, least, "u", size.total) if size.most is not None and size.most >= HUB else around.join(least, "u")
        if both:  # neighbours above go to the least
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # the node and its neighbours below go to the least
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        out = materialize(out.where("u != v").distinct(), "edges", instead=e)
        release(least)
        return out

    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    before = state(edges)
    while before[0]:
        edges = star(star(edges, True), False)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row; null and word-less texts have the fingerprint zero."""
    pick_columns(docs, "doc_id", "text")
    return bounded_batches(docs).select("doc_id", fingerprint("text").alias("fp"))


def groups(prints: DataFrame) -> DataFrame:
    """Adds ``component_id`` to (doc_id, fp): the smallest doc_id reachable over links, itself included.

    Null ids take part in links but name no component unless all ids of it
    are null. Repeated rows stay. An empty table gives an empty result.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("n")), "fingerprints")
    found = components(links(nodes.select("fp")))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("members"))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Components are named like nodes: a large one goes to its nodes, not they to it.
    sized = named.withColumnRenamed("members", "n")
    told = materialize(join_counted(rooted.withColumnRenamed("n", "rows"), sized, "root", total[1]).select("fp", "component_id", F.col("rows").alias("n")), "components")
    return join_counted(prints, told, "fp", total[0]).drop("n")


def _block_shingles(b: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, borders by text, hashes of whole word sequences); a text of fewer words than ``k`` is one shingle."""
    h, n = b.hashes(), np.diff(b.first)
    at = np.arange(len(h)) - np.repeat(b.first[:-1], n)
    place = mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ place), dtype=np.uint64)))
    whole = sums[b.first[1:]] - sums[b.first[:-1]]
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    borders = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(borders[-1]), np.uint64)
    for m in range(1, k + 1):
        which = np.flatnonzero(n >= k if m == k else n == m)
        starts = np.repeat(b.first[which], size[which]) + np.arange(int(size[which].sum())) - np.repeat(np.cumsum(size[which]) - size[which], size[which])
        key = np.full(len(starts), m, np.uint64)
        for j in range(m):
            key = mix(key) + h[starts + j]
        out[np.repeat(borders[which], size[which]) + starts - np.repeat(b.first[which], size[which])] = mix(key)
    return out, borders, whole


def _bands(texts: pa.Array, k: int) -> pa.StructArray:
    """node: a hash of the word sequence; bands: hashes of groups of MinHash values, none for a text without words."""
    nodes, bands, lengths = [], [], []
    for b in text_blocks(texts, lower=True):
        hs, borders, whole = _block_shingles(b, k)
        full = np.flatnonzero(np.diff(borders))
        keys = np.zeros((len(full), BANDS), np.uint64)
        for i in range(BANDS * BAND_ROWS if len(full) else 0):
            keys[:, i // BAND_ROWS] = mix(keys[:, i // BAND_ROWS] + np.minimum.reduceat((hs ^ _MASKS[i]) * _FACTORS[i], borders[:-1][full]))
        nodes.append(whole)
        bands.append(keys.ravel())
        lengths.append(np.where(np.diff(borders) > 0, BANDS, 0))
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    offsets = np.concatenate(([0], np.cumsum(joined(lengths, np.int64)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined(bands, np.uint64).view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(joined(nodes, np.uint64).view(np.int64)), lists], names=["node", "bands"])


def _sets(texts: pa.Array, k: int) -> pa.StructArray:
    """node, and the distinct shingle hashes of each text in ascending order."""
    nodes, sets = [], []
    for b in text_blocks(texts, lower=True):
        hs, borders, whole = _block_shingles(b, k)
        nodes.append(whole)
        sets += [np.unique(hs[i:j].view(np.int64)) for i, j in zip(borders, borders[1:], strict=False)]
    ids = np.concatenate(nodes) if nodes else np.zeros(0, np.uint64)
    return pa.StructArray.from_arrays([pa.array(ids.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hs"])


def copy_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the groups of a cell: each set is compared with all later ones that are not yet in its group.

    Members that are ``joined`` are one group from the start.
    """
    n = len(nodes)
    root, sizes = np.arange(n), np.array([len(x) for x in sets])
    if joined is not None and joined.any():
        root[joined] = np.flatnonzero(joined)[0]
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        less, more = np.minimum(sizes[later], sizes[i]), np.maximum(sizes[later], sizes[i])
        later = later[(root[later] != root[i]) & (less > 0) & (less >= similarity * more - 1e-9)]
        # So many of them at once that what is laid end to end stays small, however long the texts are.
        for part in np.split(later, np.flatnonzero(np.diff(np.cumsum(sizes[later]) // COPY_HASHES)) + 1) if len(later) else ():
            flat = np.concatenate([sets[j] for j in part])
            at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[part])[:-1])))
            for r in np.unique(root[part[both >= similarity * (sizes[part] + sizes[i] - both) - 1e-9]]):
                low, high = min(r, root[i]), max(r, root[i])
                root[root == high] = low
    moved = np.flatnonzero(root != np.arange(n))
    return nodes[moved], nodes[root[moved]]


def _copy_cells(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, node, joined, hs) that come sorted by cell."""
    cell, nodes, sets, joined = None, [], [], []

    def emit() -> pa.RecordBatch:
        u, v = copy_links(np.array(nodes, np.int64), sets, similarity, np.array(joined, bool))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        hs = batch.column("hs")
        offsets, flat = hs.offsets.to_numpy(), hs.values.to_numpy()
        for c, node, old, i, j in zip(batch.column("cell").to_pylist(), batch.column("node").to_pylist(), batch.column("joined").to_pylist(), offsets, offsets[1:], strict=False):
            if c != cell:
                if len(nodes) > 1:
                    yield emit()
                cell, nodes, sets, joined = c, [], [], []
            nodes.append(node)
            joined.append(old)
            # A copy, as a slice would keep its whole batch.
            sets.append(flat[i:j].copy())
    if len(nodes) > 1:
        yield emit()


def _copy_pairs(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that connect the near copies of each cell. ``members``: (cell, node), ``texts``: (node, hs).

    Cells of one block are compared in a task. In larger ones all members are
    compared with one of them first; those that join it are connected, so of them
    only those pairs are left that have a member which did not. Blocks of these
    meet blocks of the others and one another; where all joined there is nothing left.
    """
    spark = members.sparkSession
    compare = lambda rows: rows.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell").select("cell", "node", "joined", "hs").mapInArrow(lambda batches: _copy_cells(batches, similarity), "u long, v long")
    sized = materialize(members.join(texts.select("node", F.size("hs").cast("long").alias("weight")), "node"), "copy-sized")
    weights = sized.groupBy("cell").agg(F.sum("weight").alias("weight"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("first"))
    large = materialize(weights.where(F.col("weight") > COPY_WEIGHT), "copy-large")
    own = sized.join(small(large.select("cell")), "cell", "left_anti").select("cell", "node", F.lit(False).alias("joined")).join(texts, "node")
    out = compare(own)
    if large.isEmpty():
        return out
    firsts = large.select("cell", F.col("first").alias("node")).join(texts, "node").select("cell", F.col("node").alias("first"), F.col("hs").alias("first_hs"))
    inside = sized.join(small(large.select("cell")), "cell", "left_semi")
    rest = join_groups(inside.join(texts, "node"), materialize(firsts, "copy-firsts"), ["cell"], F.col("node"))
    both = F.size(F.array_intersect("hs", "first_hs"))
    alike = both >= similarity * (F.size("hs") + F.size("first_hs") - both) - 1e-9
    tried = materialize(rest.select("cell", "node", "weight", "first", (alike | (F.col("node") == F.col("first"))).alias("joined")), "copy-tried")
    side = tried.groupBy("cell").agg(F.coalesce(F.sum(F.when(F.col("joined"), F.col("weight"))), F.lit(0)).alias("w_in"), F.coalesce(F.sum(F.when(~F.col("joined"), F.col("weight"))), F.lit(0)).alias("w_out")).where("w_out > 0")
    side = side.select("cell", *[F.ceil(F.col(w) / COPY_WEIGHT).cast("long").alias(n) for w, n in (("w_in", "n_in"), ("w_out", "n_out"))])
    left = join_groups(tried.select("cell", "node", "joined"), materialize(side, "copy-sides"), ["cell"], F.col("node"))
    block = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("joined"), F.col("n_in")).otherwise(F.col("n_out")), F.lit(1)))
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    left = materialize(left.withColumn("block", block), "copy-left")
    # Joined block a meets open block b as (0, a, b); open blocks a <= b meet as (1, a, b).
    mixed = left.select("node", "joined", "cell", "block", F.explode(F.when(F.col("joined"), to(F.col("n_out"))).otherwise(to(F.col("n_in")))).alias("other"))
    mixed = mixed.select("node", "joined", F.xxhash64(F.lit(0), "cell", F.when(F.col("joined"), F.col("block")).otherwise(F.col("other")), F.when(F.col("joined"), F.col("other")).otherwise(F.col("block"))).alias("cell"))
    among = left.where(~F.col("joined")).select("node", "joined", "cell", "block", F.explode(to(F.col("n_out"))).alias("other"))
    among = among.select("node", "joined", F.xxhash64(F.lit(1), "cell", F.least("block", "other"), F.greatest("block", "other")).alias("cell"))
    hubs = tried.where(F.col("joined") & (F.col("node") != F.col("first"))).select(F.col("node").alias("u"), F.col("first").alias("v"))
    return out.unionByName(hubs).unionByName(compare(mixed.unionByName(among).join(texts, "node")))


def fingerprint_cells(prints: DataFrame) -> DataFrame:
    """(node, cell) of texts (node, fp): every two of linked fingerprints share a cell.

    ``links`` names one root for each linked group of a grid cell, and two
    linked fingerprints lie in some grid cell together, so groups by root hold all links.
    """
    nodes = materialize(prints.select("node", "fp").distinct(), "copy-fingerprints")
    prints_ = nodes.groupBy("fp").agg(F.count("*").alias("n"))
    found = materialize(links(prints_.select("fp")).distinct(), "copy-links")
    groups = found.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("fp"), F.col("v").alias("root")))
    alone = prints_.where("n > 1").select("fp", F.col("fp").alias("root"))
    rooted = materialize(groups.unionByName(alone).distinct(), "copy-roots")
    return join_groups(nodes, rooted, ["fp"], F.col("node")).select("node", F.xxhash64(F.lit(-1), "root").alias("cell"))


def copy_groups(docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """(doc_id, text_key, root) of every row: ``root`` is shared by the texts that near copies connect.

    Candidates are those that SimHash links and those that share a MinHash band.
    Texts of the same words (ASCII case and white space aside) are one node;
    texts without words are one too. Cells with the same members count once,
    and shingles are made only for texts that share a cell.
    """
    pick_columns(docs, "doc_id", "text")
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    bands = F.arrow_udf(lambda t: _bands(t, shingle), "node long, bands array<long>")
    sets = F.arrow_udf(lambda t: _sets(t, shingle), "node long, hs array<long>")
    prints = bounded_batches(docs).select("doc_id", key.alias("text_key"), fingerprint("text").alias("fp"), bands(F.coalesce(F.col("text"), F.lit(""))).alias("b"))
    prints = materialize(prints.select("doc_id", "text_key", "fp", "b.node", "b.bands"), "copy-prints")
    cells = prints.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("cell"))
    cells = cells.unionByName(fingerprint_cells(prints.where(F.size("bands") > 0))).distinct()
    mixed = F.xxhash64("node").cast("decimal(38,0)")
    shared = cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum(mixed).alias("s"), F.bit_xor("node").alias("x")).where("n > 1")
    shared = materialize(shared.groupBy("n", "s", "x").agg(F.min("cell").alias("cell")).select("cell", "n"), "copy-cells")
    members = materialize(cells.join(small(shared), "cell"), "copy-members")
    wanted = prints.select("node", "text_key").join(small(members.select("node").distinct()), "node").groupBy("node").agg(F.min("text_key").alias("text_key"))
    wanted = materialize(wanted.select("text_key"), "copy-texts")
    texts = join_groups(docs.select("doc_id", key.alias("text_key"), "text"), wanted, ["text_key"], F.col("doc_id")).select(sets(F.col("text")).alias("s"))
    texts = materialize(texts.groupBy("s.node").agg(F.any_value("s.hs").alias("hs")), "copy-shingles")
    found = components(_copy_pairs(members, texts, similarity))
    nodes = prints.groupBy("node").agg(F.count("*").alias("n")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = join_counted(prints.select("doc_id", "text_key", "node"), materialize(nodes, "copy-nodes"), "node", prints.count())
    return rooted.select("doc_id", "text_key", "root")


def keep_one(docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one row for each group of near copies: that of the smallest doc_id.

    Of repeated rows one stays; rows that share a doc_id but not a group stay
    both. Rows without doc_id cannot be told apart by name and all stay.
    Columns stay as they are.
    """
    found = copy_groups(docs, shingle, similarity).where(F.col("doc_id").isNotNull())
    keepers = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_key").alias("__key"))
    keepers = materialize(keepers, "copy-keepers")
    named, nameless = docs.where(F.col("doc_id").isNotNull()), docs.where(F.col("doc_id").isNull())
    names = docs.columns
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    marked = named.select(*cols, F.col("doc_id").alias("__id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__key"))
    first = Window.partitionBy("__id", "__key").orderBy(F.xxhash64("__id", "__key"))
    numbered = marked.join(keepers, ["__id", "__key"], "left_semi").withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return numbered.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]).unionByName(nameless)
