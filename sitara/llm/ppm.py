"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to ORDER bytes. A byte's code
length in a context is that of its count, or that of an escape and the byte's
code length in the next shorter context (escape method C: n bytes and q
distinct ones seen give q / (n + q)); below the empty context all 256 bytes are
equal. A text's code length is the sum over all its bytes, with statistics
frozen after training. The language with the shortest code, the cost of naming
it included (shares of training texts, by half counts), is predicted.

Statistics come from all bytes of all training texts, as counts of the longest
grams that tasks sum before they are shuffled; shorter ones are sums of these.
A tree keeps what is frequent: a context or a byte in it whose count is a
``1 / k`` share of the language's bytes or more, at most k of each length. Counts
of bytes that are not kept belong to their context's escape, so probabilities
still sum to one. k is such that all languages' tables of one length have CELLS
cells together at most; this bounds the model, which is broadcast, whatever the
corpus. Code lengths are integers (parts of 2**-16 bits), so sums do not depend on
how texts are batched.

Defined results: texts that are null or have no letter are ``und`` with score 0,
as is every text if nothing was learned. Training texts that are null, or have
a null language, teach nothing; empty ones count as texts of their language.
Ties go to the first language by code point. Repeated rows count again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitara.llm.common import bounded_batches, materialize, pick_columns, release

#: Bytes of the longest context; 8 * (ORDER + 1) bits are a key.
ORDER = 4
#: Cells of the tables of one length, of all languages together.
CELLS = 1 << 21
#: Parts of a bit.
UNIT = 1 << 16
UNKNOWN = "und"
#: Bytes that are worked on at once, and counts that a task holds before it hands them over.
CHUNK, HELD = 1 << 18, 1 << 21


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from: those whose checksum leaves 2 by 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _mask(length: int) -> int:
    return (1 << 8 * length) - 1


def _texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none), and where each begins, and the end."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def _chunks(data: np.ndarray, begin: np.ndarray, order: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, keys): the gram of order + 1 bytes that ends at each byte from lo to hi, zeros before its text; the last byte lowest."""
    for lo in range(0, len(data), CHUNK):
        hi = min(len(data), lo + CHUNK)
        first = max(0, lo - order)
        piece = data[first:hi].astype(np.int64)
        keys = piece[lo - first :].copy()
        # How far each byte is from the first of its text, no further than a gram reaches.
        texts = begin[np.searchsorted(begin, lo, "right") - 1 : np.searchsorted(begin, hi, "left")]
        since = np.full(hi - lo, order, np.int64)
        # Far ones first, so that the nearer of two beginnings holds.
        for j in reversed(range(order)):
            at = texts + j - lo
            since[at[(at >= 0) & (at < hi - lo)]] = j
        for j in range(1, order + 1):
            prior = np.zeros(hi - lo, np.int64)
            have = lo - first - j
            source = piece[max(0, have) : max(0, len(piece) - j)]
            prior[len(prior) - len(source) :] = source
            keys |= np.where(since >= j, prior, 0) << (8 * j)
        yield lo, hi, keys


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(k, kind="stable")
    k, n = k[by], n[by]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(n, first)


def _count(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, counts, held = [], [], 0

        def hand_over() -> pa.RecordBatch:
            lang = pa.DictionaryArray.from_arrays(pa.array(keys[0] >> 8 * (order + 1), pa.int32()), pa.array(list(names), pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([lang, pa.array(keys[0] & _mask(order + 1)), pa.array(counts[0])], ["lang", "gram", "n"])

        for b in batches:
            data, begin = _texts(b.column(1))
            own = b.column(0).dictionary_encode()
            local = np.array([names.setdefault(x, len(names)) for x in own.dictionary.to_pylist()], np.int64)
            lang = local[np.asarray(own.indices)] if len(local) else np.zeros(0, np.int64)
            for lo, hi, gram in _chunks(data, begin, order):
                at = np.arange(lo, hi)
                k, n = np.unique(gram | lang[np.searchsorted(begin, at, "right") - 1] << 8 * (order + 1), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > 2 * HELD:
                    k, n = _merged(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > HELD:
                        yield hand_over()
                        keys, counts, held = [], [], 0
        if held:
            k, n = _merged(keys, counts)
            keys, counts = [k], [n]
            yield hand_over()

    return count


class Table:
    """Keys in an open hash; ``find`` gives a key's row, or -1."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.bits = max(4, int(max(1, 4 * self.n) - 1).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_row = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(self.n), self._slot(keys)
        while len(left):
            # Of the keys that come to a free slot the first stays; all others go on by one.
            free = self.slot_row[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slot_key[at[won]], self.slot_row[at[won]] = keys[left[won]], left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.slot_key[at]
        row = np.where(there == keys, self.slot_row[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.slot_key[at[left]]
            hit = there == keys[left]
            row[left[hit]] = self.slot_row[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return row


@dataclass(frozen=True)
class Model:
    """Languages in order, the cost of naming each, and by length of gram: its table, each language's cost of
    the last byte after the others, and of an escape from the gram as a context."""

    langs: list[str]
    prior: np.ndarray
    order: int
    tables: list[Table]
    full: list[np.ndarray]
    escape: list[np.ndarray]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length of every text in every language, without the language's name."""
        data, begin = _texts(texts)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for lo, hi, keys in _chunks(data, begin, self.order):
            cost = self._costs(keys)
            row = np.searchsorted(begin, np.arange(lo, hi), "right") - 1
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.int64)
        return out

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        cost = np.zeros((len(keys), len(self.langs)), np.int32)
        left = np.arange(len(keys))
        for m in range(self.order + 1, 0, -1):
            own = keys[left] & _mask(m)
            row = self.tables[m].find(own)
            hit = row >= 0
            cost[left[hit]] += self.full[m][row[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return cost
            above = self.tables[m - 1].find(own >> 8)
            known = above >= 0
            cost[left[known]] += self.escape[m - 1][above[known]]
        cost[left] += 8 * UNIT
        return cost


def _bits(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(p) * UNIT).astype(np.int32)


def build(langs: list[str], texts: list[int], grams: list[np.ndarray], contexts: list[np.ndarray], order: int) -> Model:
    """The model of kept counts. ``grams[m]``: columns lang, key, n; ``contexts[m]``: lang, key, n, q."""
    n_langs = len(langs)
    prior = _bits((np.array(texts, float) + 0.5) / (sum(texts) + 0.5 * n_langs)) if n_langs else np.zeros(0, np.int32)
    tables, full, escape = [], [], []
    for m in range(order + 2):
        (gl, gk, gn), (cl, ck, cn, cq) = grams[m], contexts[m]
        keys = np.union1d(gk, ck)
        table = Table(keys)
        seen = np.zeros((len(keys), n_langs), np.int64)
        seen[table.find(gk), gl] = gn
        # An escape takes the counts of bytes that are not kept.
        total, distinct = np.zeros_like(seen), np.zeros_like(seen)
        total[table.find(ck), cl], distinct[table.find(ck), cl] = cn, cq
        if m <= order:
            kept = np.zeros_like(seen)
            nl, nk, nn = grams[m + 1]
            np.add.at(kept, (table.find(nk >> 8), nl), nn)
            out = distinct + total - kept
            escape.append(np.where(total > 0, _bits(np.where(total > 0, out, 1) / np.maximum(1, total + distinct)), 0).astype(np.int32))
        if m == 0:
            tables.append(table)
            full.append(np.full((len(keys), n_langs), 8 * UNIT, np.int32))
            whole, parts = total, distinct
            continue
        above, below = tables[m - 1].find(keys >> 8), tables[m - 1].find(keys & _mask(m - 1))
        known = (above >= 0)[:, None]
        ways = np.where(known, whole[above] + parts[above], 0)
        own = _bits(np.where(seen > 0, seen, 1) / np.maximum(1, ways))
        lower = full[m - 1][below] + np.where(known, escape[m - 1][above], 0)
        full.append(np.where((seen > 0) & (ways > 0), own, lower).astype(np.int32))
        tables.append(table)
        whole, parts = total, distinct
    return Model(langs, prior, order, tables, full, escape)


def least_counts(totals: list[int], cells: int) -> list[int]:
    """Least count that each language's tree keeps: at most ``cells / languages**2`` of a length reach it."""
    k = max(1, cells // max(1, len(totals)) ** 2)
    return [max(1, -(-t // k)) for t in totals]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, cells: int = CELLS) -> Model:
    """The model of all texts of each language."""
    pick_columns(docs, lang, text)
    known = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    n_texts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n_texts)
    longest = bounded_batches(known).mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    longest = materialize(longest, "grams")
    totals = {r.lang: r.n for r in longest.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = least_counts([totals.get(x, 0) for x in langs], cells)
    # One row for each language: as many as there are classes.
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(x, i, least[i]) for i, x in enumerate(langs)], "lang string, id int, least long"))
    lengths = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col("gram").bitwiseAND(F.lit(_mask(m))).alias("key")) for m in range(1, order + 2)]))
    every = longest.join(ids, "lang").select("id", "least", lengths.alias("g"), "n").groupBy("id", "least", "g.m", "g.key").agg(F.sum("n").alias("n"))
    every = materialize(every, "lengths")
    kept = every.where("n >= least").select("id", "m", "key", "n").toArrow()
    above = every.groupBy("id", "least", (F.col("m") - 1).alias("m"), F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("q"))
    contexts = above.where("n >= least").select("id", "m", "key", "n", "q").toArrow()
    release(longest, every)

    def by_length(t: pa.Table, *names: str) -> list[tuple[np.ndarray, ...]]:
        m, columns = t["m"].to_numpy(), [t[c].to_numpy().astype(np.int64) for c in names]
        return [tuple(c[m == k] for c in columns) for k in range(order + 2)]

    return build(langs, [n_texts[x] for x in langs], by_length(kept, "id", "key", "n"), by_length(contexts, "id", "key", "n", "q"), order)


def predict(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (else all) with ``lang_pred``, ``score`` (its share of probability among the languages) and ``bits`` (its code length).

    Columns of these names in ``docs`` give way.
    """
    pick_columns(docs, text)
    new = ("lang_pred", "score", "bits")
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body = F.col(f"`{text}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts, n = b.column(b.num_columns - 1), b.num_rows
            pred, score, bits = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            is_text = np.asarray(texts.is_valid())
            if model.langs and n:
                cost = model.lengths(texts) + model.prior
                best = cost.argmin(axis=1)
                least = cost[np.arange(n), best]
                share = 1 / np.exp2((least[:, None] - cost) / UNIT).sum(axis=1)
                pred = np.where(is_text, np.array(model.langs, object)[best], UNKNOWN)
                score, bits = np.where(is_text, share, 0.0), np.where(is_text, least / UNIT, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(bits)], [*kept, *new])

    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.when(body.rlike(r"\p{L}"), body).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double").add("bits", "double")
    return bounded_batches(own).mapInArrow(run, schema)
