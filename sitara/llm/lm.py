"""An interpolated modified Kneser-Ney trigram model, counted in Spark.

Counting goes over all training texts. Words are hashed to 64 bits; the sorted
distinct hashes are the vocabulary, and words get ids, frequent ones first.
Tasks count trigrams of ids and hand them over in compressed runs, by shards
that the middle word sets (a frequent one is spread over all shards by the
word before it). So a shard has what a trigram, its context and its last two
words need, and is written, as hash tables, to one of the model's files in the
shared folder. Workers map the files into memory and look up whole blocks of
keys at once, so scoring needs no memory of the model's size and no shuffle.

p(w | uv) = max(c(uvw) - D3(c(uvw)), 0) / c(uv) + g(uv) p(w | v),
p(w | v) = max(k(vw) - D2(k(vw)), 0) / k(v) + g(v) p(w),
p(w) = max(k(w) - D1(k(w)), 0) / K + g / (V + 1), where c counts trigrams and
c(uv) is their sum; k(vw) is the number of distinct words before vw, k(v) their
sum, k(w) the number of distinct words before w and K their sum; g is what the
discounts set free, and V + 1 the vocabulary and one unknown word. Before a
text's first word stand two starts. Discounts for counts 1, 2 and 3 or more
come from the counts of counts (Chen and Goodman). Contexts that were never
seen leave the word to the shorter one.

A table holds 32 bits of a key's hash in buckets of about eight, so a key that
is not there is taken for another once in 500 million lookups.
"""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.llm.blocks import Block, mix, text_blocks
from sitara.llm.common import bounded_batches, materialize, pick_columns, run_dir, shuffle_partitions
from sitara.llm.common import release as drop

#: The hash that stands for the end of a text. A word may hash to it, as to any other's, once in 2**64.
END = np.uint64(0x7C0FFEE123456789)
#: Words in the middle with more tokens than a shard's share times this are spread over all shards.
SPREAD = 0.25
#: Counts are handed over whenever so many distinct ones have gathered in a task.
HELD = 1 << 21
#: Bytes of text whose keys are looked up at once.
LOOKUP = 1 << 21
#: Tokens of a shard, which one task holds in memory; tokens of a file from which on files grow in number; files before that.
SHARD_TOKENS, FILE_TOKENS, SOME_FILES = 1 << 20, 1 << 26, 64
#: Words of a file of the vocabulary or of statistics.
FILE_WORDS = 1 << 21
#: Entries of a bucket of a hash table, about.
BUCKET = 8


def held_out(doc_id: Column) -> Column:
    """Texts that the model does not learn from: crc32 of the id's text, mod 5, is 1. A null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


# --- files -----------------------------------------------------------------


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays; a rerun of the task replaces it with the same bytes."""
    fs, path = _filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    rough = f"{path}.{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
    table = pa.table({k: pa.array(v) for k, v in arrays.items()})
    with fs.open_output_stream(rough) as out, pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table, max_chunksize=max(1, len(table)))
    fs.move(rough, path)


def _mapped(uri: str) -> pa.Buffer:
    """A file's bytes, mapped into memory. Where a store has no mount, workers of a machine share a copy."""
    fs, path = _filesystem(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        folder = os.path.join(tempfile.gettempdir(), "sitara-model-files")
        os.makedirs(folder, exist_ok=True)
        local = os.path.join(folder, hashlib.sha256(uri.encode()).hexdigest())
        if not os.path.exists(local):
            with fs.open_input_stream(path) as f, tempfile.NamedTemporaryFile(dir=folder, delete=False) as copy:
                shutil.copyfileobj(f, copy)
            os.replace(copy.name, local)
        path = local
    with pa.memory_map(path) as f:
        return f.read_buffer()


@lru_cache(maxsize=256)
def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory. Only the files used last stay open."""
    table = pa.ipc.open_file(_mapped(uri)).read_all()
    return {k: (table.column(k).chunk(0).to_numpy() if len(table) else np.zeros(0, table.schema.field(k).type.to_pandas_dtype())) for k in table.column_names}


class TableWriter:
    """A file of hash tables, some kinds for each shard, one shard after another.

    A table is a list of buckets by the high bits of the keys (``off``), and
    in their order the low 32 bits of the keys and a byte for the value.
    Values that a byte cannot hold go to the file's index, with their place.
    """

    def __init__(self, uri: str, kinds: tuple[str, ...]) -> None:
        self.uri, self.at = uri, 0
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.rough = f"{self.path}.{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
        self.out = self.fs.open_output_stream(self.rough)
        self.index: dict[str, list] = {f"{k}_{part}": [] for k in kinds for part in ("shard", "bits", "off", "key", "value", "first", "large_at", "large")}
        self.count = dict.fromkeys(kinds, 0)

    def _put(self, a: np.ndarray) -> int:
        at = self.at
        data = a.tobytes()
        data += bytes(-len(data) % 8)
        self.out.write(data)
        self.at += len(data)
        return at

    def table(self, kind: str, shard: int, keys: np.ndarray, codes: np.ndarray, large: np.ndarray, values: np.ndarray) -> None:
        """``codes`` are the values' bytes, ``large`` says which do not fit, ``values`` (rows by entry) are all in full."""
        bits = max(1, (len(keys) // BUCKET).bit_length())
        order = np.argsort((keys >> np.uint64(64 - bits) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF)))
        keys = keys[order]
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        off = np.zeros((1 << bits) + 1, np.uint32)
        off[1:] = np.cumsum(np.bincount(bucket, minlength=1 << bits))
        at = np.flatnonzero(large[order])
        add = lambda part, x: self.index[f"{kind}_{part}"].append(x)
        add("shard", shard)
        add("bits", bits)
        add("off", self._put(off) // 4)
        add("key", self._put(keys.astype(np.uint32)) // 4)
        add("value", self._put(codes[order].astype(np.uint8)))
        add("first", self.count[kind])
        add("large_at", at + self.count[kind])
        add("large", values[order][at])
        self.count[kind] += len(keys)

    def close(self) -> None:
        self.out.close()
        arrays = {}
        for name, xs in self.index.items():
            wide = name.endswith(("large_at", "large"))
            arrays[name] = np.concatenate(xs).astype(np.int64) if wide and xs else np.array(xs if not wide else [], dtype=np.int64)
        held = io.BytesIO()
        np.savez(held, **arrays)
        with self.fs.open_output_stream(f"{self.rough}.index") as out:
            out.write(held.getvalue())
        self.fs.move(self.rough, self.path)
        self.fs.move(f"{self.rough}.index", f"{self.path}.index")


class TableFile:
    """Lookups in a file that TableWriter wrote; its tables stay mapped, not read."""

    def __init__(self, uri: str, shards: int) -> None:
        data = _mapped(uri)
        self.bytes = np.frombuffer(data, np.uint8)
        self.words = np.frombuffer(data, np.uint32, count=len(self.bytes) // 4)
        arrays = np.load(io.BytesIO(_mapped(f"{uri}.index").to_pybytes()))
        self.kinds: dict[str, dict[str, np.ndarray]] = {}
        for kind in {name.split("_")[0] for name in arrays.files}:
            own = {part: arrays[f"{kind}_{part}"] for part in ("bits", "off", "key", "value", "first", "large_at", "large")}
            at = np.full(shards, -1)
            at[arrays[f"{kind}_shard"] % shards] = np.arange(len(own["bits"]))
            self.kinds[kind] = own | {"at": at}

    def find(self, kind: str, shard: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are there, their places among the kind's entries, and in the file their bytes); places of others mean nothing."""
        t = self.kinds[kind]
        at = t["at"][shard]
        there = np.flatnonzero(at >= 0)
        at, keys = at[there], keys[there]
        off = t["off"][at] + (keys >> (64 - t["bits"][at]).astype(np.uint64)).astype(np.int64)
        low, end = self.words[off].astype(np.int64), self.words[off + 1].astype(np.int64)
        key, base = keys.astype(np.uint32), t["key"][at]
        # The first entry of the bucket that is not below the key, by halving steps.
        for step in (1 << k for k in reversed(range(int((end - low).max(initial=0)).bit_length()))):
            to = low + step
            low += step * ((to <= end) & (self.words[np.minimum(base + to, len(self.words)) - 1] < key))
        hit = low < end
        hit[hit] = self.words[(base + low)[hit]] == key[hit]
        there, at, low = there[hit], at[hit], low[hit]
        return there, t["first"][at] + low, self.bytes[t["value"][at] + low]

    def large(self, kind: str, places: np.ndarray) -> np.ndarray:
        t = self.kinds[kind]
        return t["large"][np.searchsorted(t["large_at"], places)]


@lru_cache(maxsize=256)
def table_file(uri: str, shards: int) -> TableFile:
    return TableFile(uri, shards)


def _gram_key(*ids: np.ndarray, after: np.ndarray | np.uint64 = np.uint64(0x9E3779B97F4A7C15)) -> np.ndarray:
    """A 64-bit hash of ids; ``after`` is that of the ids before them."""
    key = after
    for x in ids:
        key = mix(key + x.astype(np.uint64) + np.uint64(1))
    return key


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, where each stands, the number of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def _order(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns of ids, the first counting most."""
    if kind.itemsize > 4:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.uint64)
    for i, x in enumerate(columns[1:]):
        if i:  # two ids fill a key; their number among all leaves room for one more
            key = _distinct(key)[2].astype(np.uint64)
        key = key << np.uint64(32) | x.astype(np.uint64)
    return np.argsort(key)


@dataclass(frozen=True)
class Model:
    """Where the files lie, and the numbers that all workers need.

    ``shards`` of grams, ``per_file`` to a file; vocabulary files by the high
    bits of a word's hash; statistics by id, ``stat_rows`` to a file.
    """

    path: str
    vocab_shift: int
    vocab_files: frozenset[int]
    shards: int
    per_file: int
    stat_rows: int
    vocab: int
    tokens: int
    spread_from: int
    files: frozenset[int] = frozenset()
    pair_files: frozenset[int] = frozenset()
    discounts: tuple[tuple[float, float, float], ...] = ()
    unknown: float = 0.0

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u4" if self.vocab + 1 < 1 << 32 else "<u8")

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts of sorted hashes; -1 and 0 for unknown ones."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for s, lo, hi in _runs(h >> np.uint64(self.vocab_shift)):
            if s in self.vocab_files:
                a = map_arrays(f"{self.path}/vocab-{s}")
                at = np.searchsorted(a["hash"], h[lo:hi])
                ok = np.flatnonzero(a["hash"][np.minimum(at, len(a["hash"]) - 1)] == h[lo:hi])
                ids[lo + ok], counts[lo + ok] = a["id"][at[ok]], a["count"][at[ok]]
        return ids, counts

    @property
    def start(self) -> int:
        """The id of what stands before a text's first token."""
        return self.vocab

    def shard(self, middle: np.ndarray, key: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Of a middle word, or the key of it and a word beside it if it is spread."""
        out = middle % self.shards
        out[spread] = key[spread] % np.uint64(self.shards)
        return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, past) of the runs of an array that is grouped by value."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            yield int(values[lo]), lo, hi


# --- counting ----------------------------------------------------------------


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words; positions of the ends."""
    out = np.full(len(b.starts) + b.n, END, dtype=np.uint64)
    out[np.arange(len(b.starts)) + b.word_doc()] = b.hashes()
    return out, b.first[1:] + np.arange(b.n)


class _Counter:
    """Counts of 64-bit keys, handed over as sorted arrays of bounded length."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = merge(np.concatenate(self.keys), np.concatenate(self.counts))
        self.__init__()
        return k, c


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _rows(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for lo in range(0, n, 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 17)]) for c in columns.values()], names=list(columns))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for batch in batches:
        for b in text_blocks(batch.column(0), lower=True):
            counter.add(_tokens(b)[0])
            if counter.size > HELD:
                k, c = counter.take()
                if len(k) > HELD // 2:
                    yield from _rows(h=k.view(np.int64), c=c)
                else:
                    counter.keys, counter.counts, counter.size = [k], [c], len(k)
    if counter.size:
        k, c = counter.take()
        yield from _rows(h=k.view(np.int64), c=c)


def _trigrams(model: Model, b: Block) -> tuple[np.ndarray, ...]:
    """(ids and training counts of the distinct words, the start last; for every token its place among these, and those of the two before it; the ends of texts)."""
    h, ends = _tokens(b)
    uniq, _, w = _distinct(h)
    ids, counts = model.ids(uniq)
    ids, counts = np.append(ids, model.start), np.append(counts, np.iinfo(np.int64).max)
    first = np.concatenate(([0], ends[:-1] + 1))
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:] = w[:-1]
    v[first] = len(ids) - 1
    u[1:] = v[:-1]
    u[first] = len(ids) - 1
    return ids, counts, w, v, u, ends


def _pack(kind: np.dtype, *columns: np.ndarray) -> bytes:
    """Columns, the first ascending, as a compressed run: differences of the first, and bytes by significance."""
    ready = [np.diff(columns[0], prepend=0), *columns[1:]]
    planes = [np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes() for x in ready]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(kind: np.dtype, run: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(run), np.uint8).reshape(columns, kind.itemsize, -1)
    out = [np.ascontiguousarray(x.T).view(kind).ravel() for x in raw]
    return [np.cumsum(out[0], dtype=kind), *out[1:]]


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


_RUN = "shard int, spread boolean, run binary"


def _run_rows(model: Model, shard: np.ndarray, spread: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, spread, run) of columns that are sorted by shard, spread and themselves."""
    both = shard * 2 + spread
    rows = [(s // 2, bool(s % 2), _pack(model.kind, *[x[lo:hi] for x in columns])) for s, lo, hi in _runs(both)]
    if rows:
        shards, flags, runs = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(flags), pa.array(runs, pa.binary())], names=["shard", "spread", "run"])


def _count_trigrams(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def hand_over() -> Iterator[pa.RecordBatch]:
            v, u, w, both = (np.concatenate(x) for x in zip(*held, strict=True))
            order = _order(model.kind, both, v, u, w)
            v, u, w, both = v[order], u[order], w[order], both[order]
            at = _firsts(both, v, u, w)
            count = np.diff(np.append(at, len(v)))
            yield from _run_rows(model, both[at].astype(np.int64) // 2, both[at] % 2 == 1, [v[at], u[at], w[at], count])

        for batch in batches:
            for b in text_blocks(batch.column(0), lower=True, size=LOOKUP):
                ids, counts, w, v, u, _ = _trigrams(model, b)
                spread = (counts > model.spread_from)[v]
                w, v, u = ids[w], ids[v], ids[u]
                both = (model.shard(v, _gram_key(v, u), spread) * 2 + spread).astype(np.uint32)
                held.append((v.astype(model.kind), u.astype(model.kind), w.astype(model.kind), both))
                size += len(w)
                if size > HELD:
                    yield from hand_over()
                    held, size = [], 0
        if held:
            yield from hand_over()

    return run


def _write_vocab(path: str, shift: int, starts: dict[tuple[int, int], int], kind: np.dtype):
    """Writes a vocabulary file for each run of rows (hash, count) in order of hash; ids go on from ``starts`` by file and class."""

    def write(s: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        level, ids = _level(c), np.zeros(len(h), kind)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            ids[at] = starts[s, int(k)] + np.arange(len(at))
        write_arrays(f"{path}/vocab-{s}", {"hash": h, "count": c, "id": ids})
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = -1
        for batch in batches:
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for s, lo, hi in _runs(h >> np.uint64(shift)):
                if s != now and held:
                    yield write(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                now = s
                held.append((h[lo:hi], c[lo:hi]))
        if held:
            yield write(now, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    """Classes of frequency: the whole part of the binary logarithm."""
    return np.frexp(counts.astype(np.float64))[1] - 1


_PART = "id long, total long, n1 long, n2 long, n3 long, k long, shard int, spread boolean, run binary"
_STATS = ("total", "n1", "n2", "n3", "k")


class _Parts:
    """Partial statistics of words, by id, handed over when many have gathered. Ids below zero hold counts of counts."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, **values: np.ndarray) -> None:
        rows = np.zeros((len(ids), 6), np.int64)
        rows[:, 0] = ids
        for name, x in values.items():
            rows[:, 1 + _STATS.index(name)] = x
        self.held.append(rows)
        self.size += len(rows)

    def coc(self, counts: np.ndarray, order: int) -> None:
        """Counts of the counts 1 to 4 of an order, under -1 to -4 (order 3) or -5 to -8 (order 2)."""
        self.add(-np.arange(1, 5) - (4 if order == 2 else 0), total=np.bincount(np.minimum(counts, 5), minlength=6)[1:5])

    def pairs(self, v: np.ndarray, w: np.ndarray, k: np.ndarray) -> None:
        """Sorted pairs with the numbers of distinct words before them."""
        if not len(v):
            return
        self.coc(k, 2)
        at = _firsts(v)
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (k, k == 1, k == 2, k >= 3)]
        self.add(v[at], **dict(zip(_STATS[:4], sums, strict=True)))
        ids, n = np.unique(w, return_counts=True)
        self.add(ids, k=n)

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows = np.concatenate(self.held)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        at = _firsts(rows[:, 0])
        sums = np.add.reduceat(rows, at, axis=0)
        sums[:, 0] = rows[at, 0]
        self.held, self.size = [], 0
        n = len(sums)
        for lo in range(0, n, 1 << 17):
            part = sums[lo : lo + (1 << 17)]
            none = pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.bool_()), pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(part[:, i])) for i in range(6)], *none], names=["id", *_STATS, "shard", "spread", "run"])


def _byte(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.minimum(values, 255), values >= 255, values.reshape(-1, 1)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bool, bytes]]]]:
    """(shard, its runs) of rows that come sorted by shard."""
    now, held = -1, []
    for batch in batches:
        for s, spread, run in zip(batch.column("shard").to_pylist(), batch.column("spread").to_pylist(), batch.column("run"), strict=True):
            if s != now and held:
                yield now, held
                held = []
            now = s
            held.append((spread, run.as_py()))
    if held:
        yield now, held


#: Statistics of ids from minus this on down say that a file of grams was written.
WRITTEN = 100


def _write_grams(model: Model, pairs_only: bool):
    """Writes the tables of shards that come one after another; gives partial statistics, and the pairs of spread words as runs for their own shards.

    With ``pairs_only`` the runs are those pairs: (first word, second word, distinct words before).
    """
    name, kinds, columns = ("pairs", ("big",), 3) if pairs_only else ("grams", ("tri", "ctx", "big"), 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, file, parts = None, -1, _Parts()
        for shard, runs in _by_shard(batches):
            if shard // model.per_file != file:
                if writer:
                    writer.close()
                file = shard // model.per_file
                writer = TableWriter(f"{model.path}/{name}-{file}", kinds)
                if not pairs_only:
                    parts.add(np.array([-WRITTEN - file]), total=np.array([1]))
            got = [(spread, _unpack(model.kind, r, columns)) for spread, r in runs]
            cols = [np.concatenate(x) for x in zip(*(c for _, c in got), strict=True)]
            order = _order(model.kind, *cols[:-1])
            cols = [x[order] for x in cols]
            at = _firsts(*cols[:-1])
            n = np.add.reduceat(cols[-1].astype(np.int64), at)
            grams = [x[at].astype(np.int64) for x in cols[:-1]]
            if pairs_only:
                writer.table("big", shard, _gram_key(*grams), *_byte(n))
                parts.pairs(*grams, n)
            else:
                yield from _trigram_tables(model, writer, parts, shard, grams, n, np.unique(np.concatenate([c[0] for spread, c in got if spread] or [np.zeros(0, model.kind)])))
            if parts.size > HELD // 4:
                yield from parts.take()
        if writer:
            writer.close()
        yield from parts.take()

    return run


def _trigram_tables(model: Model, writer: TableWriter, parts: _Parts, shard: int, grams: list[np.ndarray], n: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    v, u, w = grams
    writer.table("tri", shard, _gram_key(v, u, w), *_byte(n))
    parts.coc(n, 3)
    at = _firsts(v, u)
    full = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3)], axis=1)
    # Most contexts have few followers, seen once or twice: five bits for the ones, three for the twos; zero stands for all others.
    code = np.where((full[:, 3] == 0) & (full[:, 1] < 32) & (full[:, 2] < 8), full[:, 1] + 32 * full[:, 2], 0)
    writer.table("ctx", shard, _gram_key(v[at], u[at]), code, code == 0, full)
    order = _order(model.kind, v, w)
    v, w = v[order], w[order]
    at = _firsts(v, w)
    k = np.diff(np.append(at, len(v)))
    v, w = v[at], w[at]
    far = np.isin(v, spread)
    near = ~far
    writer.table("big", shard, _gram_key(v[near], w[near]), *_byte(k[near]))
    parts.pairs(v[near], w[near], k[near])
    if far.any():
        v, w, k = v[far], w[far], k[far]
        to = model.shard(v, _gram_key(v, w), np.ones(len(v), bool))
        order = np.lexsort((w, v, to))
        for b in _run_rows(model, to[order], np.ones(len(to), bool), [v[order], w[order], k[order]]):
            none = [pa.nulls(len(b), pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([*none, *b.columns], names=["id", *_STATS, "shard", "spread", "run"])


def _write_stats(path: str, rows: int):
    """Writes blocks of ``rows`` statistics, which come in order of id: what a context multiplies and adds, and p(w)."""

    def write(s: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, total, free, p1 = (np.concatenate(x) for x in zip(*parts, strict=True))
        a = {n: np.full(rows, v) for n, v in (("total", 0.0), ("free", 1.0), ("p1", np.nan))}
        at = ids - s * rows
        a["total"][at], a["free"][at], a["p1"][at] = total, free, p1
        write_arrays(f"{path}/stats-{s}", a)
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            for s, lo, hi in _runs(cols[0] // rows):
                if s != now and held:
                    yield write(now, held)
                    held = []
                now = s
                held.append(tuple(c[lo:hi] for c in cols))
        if held:
            yield write(now, held)

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts from the counts of counts 1 to 4.

    They suppose that counts of counts fall smoothly. Where they do not (tiny
    data, or a corpus whose documents come in pairs, which has few threes for
    its twos) a discount may leave its bounds, 0 and the count, or leave less of
    a greater count than of a smaller one; 0.5, 1 and 1.5 stand in for all
    three then, so what is seen more often always weighs more.
    """
    n1, n2, n3, n4 = (float(x) for x in n)
    out = []
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    for j, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(j - (j + 1) * y * b / a if a else -1.0)
    left = [j - d for j, d in enumerate(out, 1)]
    if all(0 < x < j for j, x in enumerate(left, 1)) and left == sorted(left):
        return out[0], out[1], out[2]
    return 0.5, 1.0, 1.5


def _layout(tokens: int, parts: int) -> tuple[int, int]:
    """(files, shards to a file): shards of bounded size, and files whose number grows with the tokens but slowly."""
    files = max(1, -(-tokens // FILE_TOKENS), min(parts, SOME_FILES, -(-tokens // (4 * SHARD_TOKENS))))
    return files, max(1, -(-tokens // (files * SHARD_TOKENS)))


def _free(d: tuple[float, float, float], total: Column) -> Column:
    return F.when(total > 0, (F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / total).otherwise(F.lit(1.0))


def train(texts: DataFrame) -> Model:
    """Counts the texts of a one-column table and writes the model in the shared folder.

    Null texts are empty: an end and no words. No texts at all give a model
    that knows no word and scores every token 1 (probability of its one unknown word).
    """
    spark = bounded_batches(texts).sparkSession
    path = run_dir(spark, "lm")
    words = materialize(texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    size = words.agg(F.count("*").alias("vocab"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens")).first()
    bits = max(1, (-(-size.vocab // FILE_WORDS) - 1).bit_length())
    shift, files = 64 - bits, 1 << bits
    words = words.withColumn("file", F.shiftrightunsigned("h", shift).cast("int"))
    # Ids by class of frequency, then by file: a row for each of both reaches the driver.
    level = F.length(F.bin("c")) - 1
    starts, at = {}, 0
    for r in sorted(words.groupBy("file", level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: (-r.level, r.file)):
        starts[r.file, r.level] = at
        at += r.n
    model = Model(path, shift, frozenset(), 1, 1, 1, size.vocab, size.tokens, 0)
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = words.repartition(files, "file").sortWithinPartitions(unsigned).select("h", "c")
    vocab_files = frozenset(r.file for r in dealt.mapInArrow(_write_vocab(path, shift, starts, model.kind), "file int").collect())
    gram_files, per_file = _layout(size.tokens, shuffle_partitions(spark))
    stat_files = max(1, -(-(size.vocab + 1) // FILE_WORDS))
    shards = gram_files * per_file
    model = replace(model, vocab_files=vocab_files, shards=shards, per_file=per_file, stat_rows=-(-(size.vocab + 1) // stat_files), spread_from=int(SPREAD * size.tokens / shards))
    drop(words)
    in_files = lambda runs: runs.repartition(gram_files, F.floor(F.col("shard") / per_file)).sortWithinPartitions("shard")
    runs = texts.mapInArrow(_count_trigrams(model), _RUN)
    part = materialize(in_files(runs).mapInArrow(_write_grams(model, False), _PART), "lm-parts")
    far = part.where("run IS NOT NULL").select("shard", "spread", "run")
    more = materialize(in_files(far).mapInArrow(_write_grams(model, True), _PART), "lm-pair-parts")
    of_file = F.floor(F.col("shard") / per_file).alias("file")
    pair_files = frozenset(int(r.file) for r in far.select(of_file).distinct().collect())
    sums = part.where("run IS NULL").union(more).groupBy("id").agg(*[F.sum(c).alias(c) for c in _STATS])
    stats = materialize(sums, "lm-stats")
    drop(part), drop(more)
    coc = {r.id: r.total for r in stats.where("id < 0").collect()}
    real = stats.where("id >= 0")
    lower = real.agg(*[F.coalesce(F.count_if(F.col("k") == j), F.lit(0)).alias(f"k{j}") for j in (1, 2, 3, 4)], F.count_if(F.col("k") >= 3).alias("many"), F.sum("k").alias("K")).first()
    d3, d2 = (discounts([coc.get(-j - shift_, 0) for j in (1, 2, 3, 4)]) for shift_ in (0, 4))
    d1 = discounts([lower[f"k{j}"] for j in (1, 2, 3, 4)])
    K = float(lower["K"] or 0)
    free1 = (d1[0] * lower["k1"] + d1[1] * lower["k2"] + d1[2] * lower["many"]) / K if K else 1.0
    unknown = free1 / (size.vocab + 1)
    cut = F.when(F.col("k") >= 3, F.lit(d1[2])).when(F.col("k") == 2, F.lit(d1[1])).when(F.col("k") == 1, F.lit(d1[0])).otherwise(F.lit(0.0))
    p1 = (F.col("k") - cut) / F.lit(max(K, 1.0)) + F.lit(unknown)
    final = real.select("id", F.col("total").cast("double").alias("total"), _free(d2, F.col("total")).alias("free"), p1.alias("p1"))
    final = final.repartition(stat_files, F.floor(F.col("id") / model.stat_rows)).sortWithinPartitions("id")
    final.mapInArrow(_write_stats(path, model.stat_rows), "file int").count()
    drop(stats)
    gram_set = frozenset(-i - WRITTEN for i in coc if i <= -WRITTEN)
    return replace(model, files=gram_set, pair_files=pair_files, discounts=(d3, d2), unknown=unknown)


# --- scoring -----------------------------------------------------------------


def _stat(model: Model, ids: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
    """Statistics of sorted ids."""
    out = [np.empty(len(ids)) for _ in names]
    for s, lo, hi in _runs(ids // model.stat_rows):
        a = map_arrays(f"{model.path}/stats-{s}")
        at = ids[lo:hi] - s * model.stat_rows
        for o, n in zip(out, names, strict=True):
            o[lo:hi] = a[n][at]
    return out


def _lookup(model: Model, name: str, kind: str, shard: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Values (rows of ``width`` numbers) of keys; zeros for those that no table holds."""
    out = np.zeros((len(keys), width), np.int64)
    file = shard // model.per_file
    order = np.argsort(file.astype(np.uint16) if model.shards <= 1 << 16 else file, kind="stable")
    for f, lo, hi in _runs(file[order]):
        if f not in (model.files if name == "grams" else model.pair_files):
            continue
        at = order[lo:hi]
        # Files that were written are known, so one that is not there is an error and not a gram never seen.
        t = table_file(f"{model.path}/{name}-{f}", model.per_file)
        hit, places, code = t.find(kind, shard[at] % model.per_file, keys[at])
        code = code.astype(np.int64)
        if kind == "ctx":
            ones, twos = code & 31, code >> 5
            values, large = np.stack([ones + 2 * twos, ones, twos, np.zeros_like(ones)], axis=1), code == 0
        else:
            values, large = code.reshape(-1, 1), code == 255
        if large.any():
            values[large] = t.large(kind, places[large])
        out[at[hit]] = values
    return out


def _follow(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return count - np.array([0.0, *d])[np.minimum(count, 3)]


def _probabilities(model: Model, ids: np.ndarray, counts: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """p(w | uv) of every token; all three are places among ``ids``."""
    d3, d2 = model.discounts
    spread, known = counts > model.spread_from, ids >= 0
    order = np.flatnonzero(known)[np.argsort(ids[known])]
    p1, total, free = np.full(len(ids), model.unknown), np.zeros(len(ids)), np.ones(len(ids))
    p1[order], total[order], free[order] = _stat(model, ids[order], ("p1", "total", "free"))
    own = _gram_key(np.maximum(ids, 0))
    # Pairs: each distinct one is looked up once. Those of spread first words lie in files of their own.
    both = np.flatnonzero(known[w] & (total > 0)[v])
    keys, first, where = _distinct(_gram_key(ids[w[both]], after=own[v[both]]))
    at = v[both[first]]
    shard, k = model.shard(ids[at], keys, spread[at]), np.zeros(len(keys), np.int64)
    for name, flag in (("grams", False), ("pairs", True)):
        part = np.flatnonzero(spread[at] == flag)
        k[part] = _lookup(model, name, "big", shard[part], keys[part], 1)[:, 0]
    count = np.zeros(len(w), np.int64)
    count[both] = k[where]
    p = np.where(total[v] > 0, _follow(count, d2) / np.maximum(total, 1.0)[v] + free[v] * p1[w], p1[w])
    # Contexts of two words, then the trigrams of those that were seen.
    both = np.flatnonzero(known[u] & known[v])
    keys, first, where = _distinct(_gram_key(ids[u[both]], after=own[v[both]]))
    at = v[both[first]]
    shard = model.shard(ids[at], keys, spread[at])
    found = _lookup(model, "grams", "ctx", shard, keys, 4)
    leave = (found[:, 1:] @ np.array(d3)) / np.maximum(found[:, 0], 1)
    has = np.flatnonzero((found[where, 0] > 0) & known[w[both]])
    seen = where[has]
    count = _lookup(model, "grams", "tri", shard[seen], _gram_key(ids[w[both[has]]], after=keys[seen]), 1)[:, 0]
    sums = found[:, 0][where]
    p[both] = np.where(sums > 0, leave[where] * p[both], p[both])
    p[both[has]] += _follow(count, d3) / sums[has]
    return p


SCORES = "n_tokens long, n_known long, base_score double, score double"


def _score_batch(model: Model, texts: pa.Array) -> pa.StructArray:
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for b in text_blocks(texts, lower=True, size=LOOKUP):
        if not model.vocab:
            ends = b.first[1:] + np.arange(b.n)
            n = len(b.starts) + b.n
            logs, base, count = np.zeros(n), np.zeros(n), np.zeros(n)
        else:
            ids, counts, w, v, u, ends = _trigrams(model, b)
            logs = np.log10(_probabilities(model, ids, counts, w, v, u))
            count = counts[w]
            base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.vocab + 1)))[w]
        begins = np.concatenate(([0], ends[:-1] + 1))
        parts[0].append(ends + 1 - begins)
        parts[1].append(np.add.reduceat((count > 0).astype(np.int64), begins))
        parts[2].append(np.add.reduceat(base, begins))
        parts[3].append(np.add.reduceat(logs, begins))
    cols = [np.concatenate(p) if p else np.zeros(0) for p in parts]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    Scores are log10 probabilities of whole texts, the end included; the
    perplexity is 10 ** (-score / n_tokens). Null and empty texts are an end
    alone. Repeated rows score alike; other columns are ignored.
    """
    pick_columns(docs, "doc_id", "text")
    run = F.arrow_udf(lambda texts: _score_batch(model, texts), SCORES)
    scored = bounded_batches(docs).select("doc_id", run(F.coalesce(F.col("text"), F.lit(""))).alias("s"))
    return scored.select("doc_id", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score")


def release(spark: SparkSession, model: Model) -> None:
    """Delete a model's files."""
    fs, path = _filesystem(model.path)
    fs.delete_dir(path)
