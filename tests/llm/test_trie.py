"""The conversation trie against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from sitara.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, conv_ID2 string"


def brute(rows, every=5, heads=9):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    members = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole = convs.get(c - c % every, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole) == d))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1].encode() if p else b"") + sum(saved[k] for k in children[p])
        ends = ",".join(map(str, sorted(c for c, end in members[p] if end)))
        out.add((min(c for c, _ in members[p]), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -5, 10**12]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", None, ""]), rng.choice(["a", "é", "", None, "x,y"])))
    rows += [(None, 1, "user", "lost"), (3, 2, "user", "a"), (3, 2, "user", "a")]
    return rows


def got(spark, rows):
    df = trie.trie(spark.createDataFrame([(*r, "z") for r in rows], SCHEMA))
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    assert got(spark, rows) == brute(rows)


def test_blocks_and_pieces(spark, monkeypatch):
    """A conversation with most turns, in many blocks and partitions; a node where many end, in many pieces."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(3)
    rows = [(5, t, "user", rng.choice("ab")) for t in range(300)] + [(7, t, "user", "x") for t in range(90)]
    rows += [(c, t, "user", "same") for c in range(100, 180) for t in range(12)]
    rows += [(c, 0, "user", "once") for c in range(200, 220)]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_pieces_of_a_node_are_hashed_in_order(monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(1, -9, 4, c) for c in range(-3, 9)] + [(1, 2, 4, 70)] + [(2, 2, 4, c) for c in (5, 5, 6)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], ["depth", "x", "y", "conv_id"])
    pieces = pa.Table.from_batches(list(trie._pieces(map(batch, (rows[:1], rows[1:5], rows[5:14], rows[14:])))))
    assert pieces["piece"].to_pylist() == ["-3", "-2,-1,0", "1", "2,3,4", "5,6,7", "8", "70", "5,5,6"]
    done = pa.Table.from_batches(list(trie._chain(pieces.to_batches(2)))).to_pylist()
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [r["ends_sha256"] for r in done] == [sha(range(-3, 9)), sha([70]), sha([5, 5, 6])]


def test_no_conversation(spark):
    assert got(spark, []) == set()
    assert got(spark, [(None, 1, "user", "a")]) == set()
    assert got(spark, [(1, None, None, None)]) == brute([(1, None, None, None)])


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_vector_codes"])
def test_whole_tables_against_sql(spark, sf_dir, name):
    import duckdb

    from sitara.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())
