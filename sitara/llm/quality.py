"""Quality rules whose cutoffs limit false rejection, with a proof from labels.

Each rule rejects a text whose measure exceeds a cutoff. Labelled good texts
are a holdout. For every stratum all rules climb one nested path of cutoffs,
lenient to strict, and the exact binomial tail tells at each step whether the
data refute "the rules together reject more than ALPHA of good texts"; the
path is left at the first step that fails (fixed-sequence testing, which
needs no correction inside a path), and DELTA is split over strata
(Bonferroni). The path comes from labels that do not prove it: those of other
strata and bad ones, or else half of the good ones. So with probability
1 - DELTA no stratum loses more than ALPHA of its good texts.

Strata with too few good labels of their own share the cutoffs that are
certified on all of them pooled, if need be with the next larger strata; for
those the promise holds over the pool, not for each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitara.llm.blocks import Block, mix, span_hashes, text_blocks
from sitara.llm.common import bounded_batches, pick_columns

ALPHA = 0.03
DELTA = 0.05
MIN_WORDS = 50
_SHARES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
#: Rules: measure of a text and the ladder of its cutoffs, lenient first.
LADDERS: dict[str, tuple[float, ...]] = {"symbols": _SHARES, "duplicate_lines": _SHARES, "repeats": _SHARES, "capitals": _SHARES}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_SCHEMA = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _repeated(b: Block) -> np.ndarray:
    """Words in three-word windows that a text holds twice or more."""
    h, doc = b.hashes(), b.word_doc()
    if len(h) < 3:
        return np.zeros(b.n, dtype=np.int64)
    same = doc[2:] == doc[:-2]
    key = mix(mix(mix(h[:-2] + doc[:-2].astype(np.uint64)) + h[1:-1]) + h[2:])
    at = np.flatnonzero(same)
    _, which, times = np.unique(key[at], return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    covered = np.zeros(len(h), dtype=bool)
    for k in range(3):
        covered[again + k] = True
    return b.per_doc_words(covered)


def _lines(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, by text."""
    feed = np.flatnonzero(b.data == 0x0A)
    full = np.flatnonzero(b.offs[1:] > b.offs[:-1])
    starts = np.union1d(b.offs[:-1][full], feed + 1)
    starts = starts[starts < len(b.data)]
    ends = np.concatenate((starts[1:], [len(b.data)])) if len(starts) else starts
    ends = ends - ((ends > starts) & (b.data[np.maximum(ends - 1, 0)] == 0x0A))
    doc = np.searchsorted(b.offs, starts, side="right") - 1
    wordy = np.searchsorted(b.starts, ends) > np.searchsorted(b.starts, starts)
    starts, ends, doc = starts[wordy], ends[wordy], doc[wordy]
    key = mix(span_hashes(b.data, starts, ends) + doc.astype(np.uint64))
    lines = np.bincount(doc, minlength=b.n)
    _, first = np.unique(key, return_index=True)
    return lines, lines - np.bincount(doc[first], minlength=b.n)


def measure_batch(texts: pa.Array) -> pa.Array:
    """The measures of whole texts, as a struct array."""
    parts: dict[str, list[np.ndarray]] = {m: [] for m in MEASURES}
    for b in text_blocks(texts):
        point = (b.data & 0xC0) != 0x80
        lines, dup = _lines(b)
        for m, v in zip(MEASURES, (np.diff(b.first), b.per_doc(point & ~_SPACE[b.data]), b.per_doc(_SYMBOL[b.data]), dup, _repeated(b), lines, b.per_doc(_CAPITAL[b.data])), strict=True):
            parts[m].append(v)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for p in parts.values()], names=list(MEASURES))


@F.arrow_udf(_SCHEMA)
def text_measures(texts: pa.Array) -> pa.Array:
    return measure_batch(texts)


def _share(part: str, of: str) -> Column:
    return F.col(f"m.{part}") / F.greatest(F.col(f"m.{of}"), F.lit(1))


def rule_values() -> dict[str, Column]:
    """The measure of each rule, from the struct ``m`` of measures."""
    return {"symbols": _share("n_symbols", "word_chars"), "duplicate_lines": _share("n_dup_lines", "n_lines"), "repeats": _share("n_repeat_words", "n_words"), "capitals": _share("n_capitals", "word_chars")}


def base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * 50)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed downwards until terms vanish."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    total, j = 0.0, k
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    while j >= 0:
        term = math.exp(log_term)
        total += term
        if j < n * p and term < total * 1e-17:
            break
        if j:
            log_term += math.log(j) - math.log(n - j + 1) + math.log1p(-p) - math.log(p)
        j -= 1
    return min(1.0, total)


@dataclass(frozen=True)
class Certificate:
    """What proves some cutoffs: of ``n`` good texts of the strata, ``k`` are rejected; so few have this probability at most if more than ALPHA were."""

    strata: tuple[str | None, ...]
    cutoffs: dict[str, float]
    n: int
    k: int
    tail: float


@dataclass(frozen=True)
class Cutoffs:
    """Cutoffs by (stratum, rule) for the strata in ``own``, which have a proof of their own; ``rest`` by rule, proved on a pool, for all others."""

    at: dict[tuple[str | None, str], float] = field(default_factory=dict)
    own: frozenset[str | None] = frozenset()
    rest: dict[str, float] = field(default_factory=dict)
    certificates: tuple[Certificate, ...] = ()

    def rejects(self, stratum: Column) -> Column:
        out = F.lit(False)
        values = rule_values()
        same = lambda name: stratum.isNull() if name is None else F.coalesce(stratum == F.lit(name), F.lit(False))
        for (name, rule), cut in self.at.items():
            out = out | (same(name) & (values[rule] > cut))
        other = F.lit(True)
        for name in self.own:
            other = other & ~same(name)
        for rule, cut in self.rest.items():
            out = out | (other & (values[rule] > cut))
        return out


@dataclass(frozen=True)
class Counted:
    """Labelled texts by the first cutoff of each rule's ladder that they exceed (``level``, a column per rule)."""

    stratum: np.ndarray
    good: np.ndarray
    half: np.ndarray
    level: np.ndarray
    n: np.ndarray

    def pick(self, where: np.ndarray) -> Counted:
        return Counted(self.stratum[where], self.good[where], self.half[where], self.level[where], self.n[where])

    def total(self, good: bool) -> int:
        return int(self.n[self.good == good].sum())

    def hit(self, state: np.ndarray, good: bool) -> int:
        """Texts that some rule rejects when rule r stands at cutoff ``state[r]`` (-1: at none)."""
        return int(self.n[(self.good == good) & (self.level <= state).any(axis=1)].sum())


def nested_path(c: Counted, alpha: float) -> list[np.ndarray]:
    """States from none to strict, one cutoff of one rule at a time: that which rejects most bad texts for each good one; ends beyond 3 alpha."""
    sizes = [len(x) for x in LADDERS.values()]
    state, path = np.full(len(sizes), -1), []
    n_good, n_bad = max(1, c.total(True)), max(1, c.total(False))
    free = c
    lost = 0
    while lost <= 3 * alpha * n_good:
        best = None
        for r in range(len(sizes)):
            if state[r] + 1 < sizes[r]:
                new = state.copy()
                new[r] += 1
                won = (free.hit(new, False) / n_bad + 1e-9) / (free.hit(new, True) / n_good + 1e-9)
                if best is None or won > best[0]:
                    best = won, new
        if best is None:
            break
        state = best[1]
        path.append(state)
        lost += free.hit(state, True)
        free = free.pick(~(free.level <= state).any(axis=1))
    return path


def certify(proof: Counted, path: list[np.ndarray], alpha: float, delta: float) -> np.ndarray | None:
    """The certified state of a path that parts good from bad best; the more lenient on ties; None if none helps."""
    best, gain = None, 0.0
    good, bad = proof.total(True), proof.total(False)
    for state in path:
        g = proof.hit(state, True)
        if binomial_tail(g, good, alpha) > delta:
            break
        if (won := proof.hit(state, False) / max(1, bad) - g / max(1, good)) > gain + 1e-12:
            best, gain = state, won
    return best


def fewest(alpha: float, delta: float) -> float:
    """Good labels that a proof without any hit needs."""
    return math.log(delta) / math.log1p(-alpha)


def _cutoffs(c: Counted, inside: np.ndarray, alpha: float, delta: float) -> Certificate | None:
    """Certified cutoffs by rule for the strata of the rows ``inside``, with their proof; None if the labels are too few for one."""
    own, others = c.pick(inside), c.pick(~inside)
    if others.total(True) >= fewest(alpha, delta):
        proof, learn = own, c.pick(~inside | ~c.good)
    else:
        proof, learn = own.pick((own.half == 1) | ~own.good), c.pick(~inside | ~c.good | (c.half == 0))
    if proof.total(True) < fewest(alpha, delta):
        return None
    state = certify(proof, nested_path(learn, alpha), alpha, delta)
    if state is None:
        state = np.full(len(LADDERS), -1)
    n, k = proof.total(True), proof.hit(state, True)
    strata = tuple(sorted(set(c.stratum[inside].tolist()), key=lambda s: (s is None, s or "")))
    cuts = {rule: ladder[i] for (rule, ladder), i in zip(LADDERS.items(), state.tolist(), strict=True) if i >= 0}
    return Certificate(strata, cuts, n, k, binomial_tail(k, n, alpha))


def fit(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> Cutoffs:
    """Choose cutoffs from ``measured`` (doc_id, stratum, m) and ``labels`` (doc_id, quality).

    Every labelled text counts, and once: copies are no trials of their own.
    A text labelled twice is good only if all its labels are; null ids or
    qualities are ignored. What reaches the driver is a count for each stratum
    and combination of levels. Strata without labels fall under the pooled
    cutoffs.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    levels = {}
    for rule, value in rule_values().items():
        above = F.lit(0)
        for cut in LADDERS[rule]:
            above = above + (value > cut).cast("int")
        levels[rule] = F.lit(len(LADDERS[rule])) - above
    held = measured.where(~base_failed()).select("doc_id", "text_key", F.col(stratum).cast("string").alias("stratum"), *[v.alias(r) for r, v in levels.items()])
    texts = held.join(marks, "doc_id").groupBy("stratum", "text_key", *LADDERS).agg(F.min("good").alias("good"))
    half = F.pmod(F.xxhash64("text_key"), F.lit(2)).alias("half")
    rows = texts.groupBy("stratum", "good", half, *LADDERS).agg(F.count("*").alias("n")).collect()
    if not rows:
        return Cutoffs()
    c = Counted(np.array([r.stratum for r in rows], dtype=object), np.array([r.good for r in rows], dtype=bool), np.array([r.half for r in rows]), np.array([[r[rule] for rule in LADDERS] for r in rows]), np.array([r.n for r in rows]))
    sizes = sorted(((c.pick(c.stratum == s).total(True), s) for s in set(c.stratum.tolist())), key=lambda x: (-x[0], x[1] is None, x[1] or ""))
    n_own = max((m for m in range(len(sizes) + 1) if all(n >= fewest(alpha, delta / (m + 1)) for n, _ in sizes[:m])), default=0)
    share = delta / (n_own + 1)
    at, own, pool, proofs = {}, [], sizes[n_own:], []
    for n, s in sizes[:n_own]:
        proof = _cutoffs(c, c.stratum == s, alpha, share)
        if proof is None:
            pool.append((n, s))
            continue
        own.append(s)
        proofs.append(proof)
        at |= {(s, rule): cut for rule, cut in proof.cutoffs.items()}
    # The pool: all strata without a proof, and the smallest of the others until one is possible.
    names = {s for _, s in pool}
    left = [s for _, s in sizes if s not in names]
    while (rest := _cutoffs(c, np.array([s in names for s in c.stratum.tolist()], dtype=bool), alpha, share)) is None and left:
        names.add(left.pop())
    if rest:
        proofs.append(rest)
    return Cutoffs(at, frozenset(own), rest.cutoffs if rest else {}, tuple(proofs))


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of every row, the struct ``m`` of its text's measures (null: an empty text), and ``text_key``, a hash of the text."""
    pick_columns(docs, "text", *keep)
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")
    return bounded_batches(docs).select(*[F.col(f"`{c}`") for c in keep], key, text_measures(F.coalesce(F.col("text"), F.lit(""))).alias("m"))


def judge(measured: DataFrame, cutoffs: Cutoffs, stratum: str = "lang") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to measured rows.

    Empty and null texts have no words and fail the base rule. Null strata
    are a stratum of their own. Repeated rows are judged alike.
    """
    return measured.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~cutoffs.rejects(F.col(stratum).cast("string"))})


def keep_good(docs: DataFrame, cutoffs: Cutoffs, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they are."""
    m, names = text_measures(F.coalesce(F.col("text"), F.lit(""))), docs.columns
    marked = bounded_batches(docs).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], m.alias("m"))
    at = names.index(stratum)
    kept = marked.where(~base_failed() & ~cutoffs.rejects(F.col(f"c{at}").cast("string")))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
