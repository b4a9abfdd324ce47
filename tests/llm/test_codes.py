"""Vector codes against trying every entry, in plain integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from sitara.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, Code string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    part = -(-max(len(v) for _, v, _ in kept) // parts)
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (part * parts - len(v)) for _, v, _ in kept]
    cut = [[row[p * part : (p + 1) * part] for p in range(parts)] for row in ints]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for row in cut:
                own.setdefault(near(row[p], books[p])[1], []).append(row[p])
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
    error = [min((1 << 63) - 1, sum(d for d, _ in f)) for f in found]
    by = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        by[lab] = by.get(lab, 0) + e
    return [(i, "".join(f"{j:02x}" for _, j in f), e, min((1 << 63) - 1, by[lab]), sha) for (i, _, lab), f, e in zip(kept, found, error, strict=True)]


def got(spark, rows):
    df = codes.compress(spark.createDataFrame([(*r, "z") for r in rows], SCHEMA))
    return [tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]


def _rows(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dim)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def _sorted(x):
    return sorted(x, key=repr)


def test_against_brute_force(spark):
    rows = _rows(150, 16, 1)
    rows += [(200 + k, rows[3][1], 1) for k in range(40)] + [rows[5], rows[5]]
    rows += [(-4, None, 1), (-3, [1.0] * 15 + [None], 1), (-2, [float("nan")] * 16, 2), (-1, [float("-inf")] * 16, 2), (None, rows[9][1], None)]
    assert _sorted(got(spark, rows)) == _sorted(brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)], _rows(5, 8, 2), _rows(30, 13, 3) + [(99, [0.5], 1)]], ids=["none", "null", "empty", "few", "uneven"])
def test_edges(spark, rows):
    assert _sorted(got(spark, rows)) == _sorted(brute(rows))


def test_large_components(spark):
    rows = _rows(40, 8, 4, spread=1e5)
    assert _sorted(got(spark, rows)) == _sorted(brute(rows))


def test_tree_equals_trying_all_entries():
    rng = np.random.default_rng(5)
    for k, low, high, width in ((16, -3, 3, 2), (16, -700, 700, 8), (64, -50, 50, 3), (1, 0, 9, 4), (16, -(1 << 31), 1 << 31, 8), (7, 0, 1, 3)):
        book, rows = rng.integers(low, high, (k, width)), rng.integers(low, high, (400, width))
        i, d, _ = codes.nearest(rows, book, codes.plant(book))
        for r in range(len(rows)):
            want = min((min(codes.MOST, sum((int(a) - int(b)) ** 2 for a, b in zip(rows[r], e, strict=True))), j) for j, e in enumerate(book))
            assert (int(d[r]), int(i[r])) == want


def test_tree_leaves_entries_out():
    """Clustered rows need few of a larger codebook's distances."""
    rng = np.random.default_rng(6)
    book = rng.integers(-4000, 4000, (64, 3))
    rows = book[rng.integers(0, 64, 2000)] + rng.integers(-60, 60, (2000, 3))
    _, _, tried = codes.nearest(rows, book, codes.plant(book))
    assert tried < 0.6 * 64 * len(rows)
