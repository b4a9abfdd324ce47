"""Vector code compression: every part of a vector becomes the index of its nearest codebook entry.

Components are integers, ``floor(SCALE * x)``. A part position's codebook is
trained by rounds of assignment and componentwise means over all vectors, each
round one pass whose tasks hand over a count and a sum for each entry. The
nearest entry is found in a vantage-point tree of the codebook, walked for a
whole batch at once: a side of a node is left out only if the triangle
inequality, with bounds rounded to the safe side, puts all of it strictly
farther than the best entry so far. Which entry is nearer is decided by exact
integers, ties by the lower index, so the result is that of trying all entries.

Defined results: vectors that are null, or hold a null or a component that is
not finite, are dropped. Vectors shorter than the longest go on with zeros, as
does the last part where the length is not divisible. Components stop at
+-2**31 after scaling, squared distances at the largest long. Rows without an
id come after all others when the first codebook is chosen; rows of equal id
are chosen in the order of their components. With fewer vectors than entries
there are as many entries as vectors. Repeated rows are rows like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitara.llm.common import bounded_batches, fresh_name, join_groups, materialize, pick_columns

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Entries up to which a node of the tree is a leaf whose entries are all tried.
LEAF = 3
#: Integer components stop here, so that sums over two billion rows stay within a long.
STOP = 1 << 31
#: A distance computed in doubles is off by less than this share of itself.
MARGIN = 2.0**-48
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Node:
    """A leaf with ``entries``; or an entry (``at``) and the entries within and beyond a distance of it,
    ``inner`` at most ``inner_most`` away and ``outer`` at least ``outer_least`` (both rounded to the safe side)."""

    entries: tuple[int, ...] = ()
    at: int = -1
    inner: Node | None = None
    outer: Node | None = None
    inner_most: float = 0.0
    outer_least: float = 0.0


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one entry; beyond a long, its largest value."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    d = a - b
    if int(np.abs(d).max()) ** 2 * max(1, d.shape[1]) <= MOST:
        return np.einsum("ij,ij->i", d, d)
    return np.array([min(MOST, sum(int(x) * int(x) for x in row)) for row in d], np.int64)


def plant(codebook: np.ndarray, own: tuple[int, ...] | None = None) -> Node:
    """The tree of a codebook (entries by components)."""
    own = tuple(range(len(codebook))) if own is None else own
    if len(own) <= LEAF:
        return Node(entries=own)
    at, rest = own[0], own[1:]
    d = {i: int(squared(codebook[i : i + 1], codebook[at])[0]) for i in rest}
    order = sorted(rest, key=lambda i: (d[i], i))
    inner, outer = order[: len(order) // 2], order[len(order) // 2 :]
    return Node(
        at=at,
        inner=plant(codebook, tuple(inner)),
        outer=plant(codebook, tuple(outer)),
        inner_most=float(np.sqrt(float(d[inner[-1]]))) * (1 + MARGIN),
        outer_least=float(np.sqrt(float(d[outer[0]]))) * (1 - MARGIN),
    )


class _Best:
    """The nearest entry so far of every row of a batch."""

    def __init__(self, rows: np.ndarray, codebook: np.ndarray):
        self.rows, self.codebook = rows, codebook
        self.d = np.full(len(rows), MOST, np.int64)
        self.i = np.full(len(rows), len(codebook), np.int64)
        self.tried = 0

    def attempt(self, entry: int, own: np.ndarray) -> np.ndarray:
        """Squared distances of the rows ``own`` to an entry, which becomes theirs where it is nearer, or as near with a lower index."""
        d = squared(self.rows[own], self.codebook[entry])
        self.tried += len(own)
        better = (d < self.d[own]) | ((d == self.d[own]) & (entry < self.i[own]))
        won = own[better]
        self.d[won], self.i[won] = d[better], entry
        return d

    def reach(self, own: np.ndarray) -> np.ndarray:
        return np.sqrt(self.d[own].astype(np.float64)) * (1 + MARGIN)


def _walk(node: Node, best: _Best, own: np.ndarray) -> None:
    if not len(own):
        return
    if node.at < 0:
        for entry in node.entries:
            best.attempt(entry, own)
        return
    away = np.sqrt(best.attempt(node.at, own).astype(np.float64))
    least, most = away * (1 - MARGIN), away * (1 + MARGIN)
    inside = most <= (node.inner_most + node.outer_least) / 2
    # The side that a row lies on first, then the other where an entry of it may be as near as the best so far.
    for first in (True, False):
        _walk(node.inner, best, own[inside & _near(least - node.inner_most, best, own)] if first else own[~inside & _near(least - node.inner_most, best, own)])
        _walk(node.outer, best, own[~inside & _near(node.outer_least - most, best, own)] if first else own[inside & _near(node.outer_least - most, best, own)])


def _near(gap: np.ndarray, best: _Best, own: np.ndarray) -> np.ndarray:
    """Whether a side at least ``gap`` away may hold an entry as near as the best so far (equal ones are visited)."""
    return gap - np.abs(gap) * MARGIN <= best.reach(own)


def nearest(rows: np.ndarray, codebook: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry (ties: the lower) and exact squared distance of every row; how many distances that took."""
    best = _Best(rows, codebook)
    _walk(tree, best, np.arange(len(rows)))
    return best.i, best.d, best.tried


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position within the part."""

    entries: np.ndarray

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Node]:
        return [plant(book) for book in self.entries]


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept vectors of a batch, and their integer components as rows of ``width``."""
    n = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    row, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    kept = np.asarray(vectors.is_valid()).copy()
    kept[row[~np.isfinite(x)]] = False
    out = np.zeros((len(n), width), np.int64)
    good = kept[row]
    place = np.arange(len(x)) - np.repeat(begin, n)
    with np.errstate(over="ignore"):
        out[row[good], place[good]] = np.clip(np.floor(x[good] * SCALE), -STOP, STOP).astype(np.int64)
    return np.flatnonzero(kept), out[kept]


def _is_kept(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def _components(docs: DataFrame, vector: str) -> DataFrame:
    """The kept vectors alone."""
    return docs.where(_is_kept(F.col(f"`{vector}`"))).select(F.col(f"`{vector}`").alias("vector"))


def _first(docs: DataFrame, key: str, vector: str, parts: int, entries: int) -> np.ndarray | None:
    """The first codebooks, or None if no vector is kept."""
    v = F.col(f"`{vector}`")
    kept = docs.where(_is_kept(v))
    longest = kept.agg(F.max(F.size(v))).first()[0]
    if longest is None:
        return None
    rows = kept.select(F.col(f"`{key}`").alias("id"), v.alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    part = -(-longest // parts)
    _, ints = integers(rows["v"].combine_chunks(), part * parts)
    return ints.reshape(len(ints), parts, part).transpose(1, 0, 2).copy()


def _round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one assignment of all vectors; entries that none takes stay."""
    parts, entries, part = books.entries.shape

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, part), np.int64)
        for b in batches:
            _, rows = integers(b.column(0), books.width)
            for p in range(parts):
                own = rows[:, p * part : (p + 1) * part]
                index, _, _ = nearest(own, books.entries[p], trees[p])
                count[p] += np.bincount(index, minlength=entries)
                for e in np.unique(index):
                    total[p, e] += own[index == e].sum(axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p * entries + e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["entry", "n", "total"])

    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(part)]
    # A row for each part and entry comes to the driver, as many as the codebooks have.
    found = vectors.mapInArrow(tally, "entry long, n long, total array<long>").groupBy("entry").agg(F.sum("n").alias("n"), *sums).collect()
    new = books.entries.copy()
    for r in found:
        new[r.entry // entries, r.entry % entries] = [r[f"s{i}"] // r.n for i in range(part)]
    return Codebooks(new)


def train(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all kept vectors; None if there is none."""
    pick_columns(docs, key, vector)
    first = _first(docs, key, vector, parts, entries)
    if first is None:
        return None
    books = Codebooks(first)
    vectors = bounded_batches(_components(docs, vector))
    for _ in range(rounds):
        books = _round(vectors, books)
    return books


def encode(docs: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The kept rows with all their columns, and ``code`` (two hex digits a part) and ``error`` (squared distances summed)."""
    pick_columns(docs, vector)
    # Columns of these names give way.
    docs = docs.drop("code", "error")
    schema = docs.drop(vector).schema.add("code", "string").add("error", "long")
    if books is None:
        return docs.sparkSession.createDataFrame([], schema)
    names = [c for c in docs.columns if c.lower() != vector.lower()]
    part = books.entries.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for b in batches:
            kept, rows = integers(b.column(b.num_columns - 1), books.width)
            error, codes = np.zeros(len(rows), np.float64), np.zeros((len(rows), books.parts), np.uint8)
            exact = np.zeros(len(rows), np.int64)
            for p in range(books.parts):
                index, d, _ = nearest(rows[:, p * part : (p + 1) * part], books.entries[p], trees[p])
                codes[:, p] = index
                error += d
                exact = np.where(error < 9.2e18, exact + d, MOST)
            out = b.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array([x.tobytes().hex() for x in codes], pa.string()), pa.array(exact)], [*names, "code", "error"])

    return bounded_batches(docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{vector}`"))).mapInArrow(code, schema)


def compress(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Kept rows with ``code``, ``error``, ``label_error`` (errors summed over equal labels, nulls together) and ``codebooks_sha256``.

    Columns of these names in ``docs`` give way; all its others but the vectors stay.
    """
    pick_columns(docs, key, vector, label)
    docs = docs.drop("label_error", "codebooks_sha256")
    books = train(docs, key, vector)
    coded = materialize(encode(docs, books, vector), "codes")
    group, none = fresh_name(coded, "label"), fresh_name(coded, "no_label")
    own = F.col(f"`{label}`")
    keyed = coded.withColumn(group, F.coalesce(own.cast("string"), F.lit(""))).withColumn(none, own.isNull())
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(20,0)")).cast("long")
    sums = keyed.groupBy(group, none).agg(total.alias("label_error"))
    out = join_groups(keyed, sums, [group, none], F.struct(F.col(f"`{key}`"), F.col("code")))
    return out.drop(group, none).withColumn("codebooks_sha256", F.lit(books.sha256() if books else None).cast("string"))
