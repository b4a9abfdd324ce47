"""The pipeline's stages against plain Python, on tables with planted cases; and over empty ones."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from sitara.llm import quality
from sitara.llm.queries import QUERIES
from tests.llm.test_free import _measures
from tests.llm.test_native import _brute, _targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents, labels and a benchmark: clean texts, near and exact copies, junk, short texts, benchmark passages."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    bench = [(i, " ".join(word() for _ in range(rng.randrange(15, 40)))) for i in range(8)]
    texts: dict[int, str | None] = {i: " ".join(word() for _ in range(rng.randrange(60, 140))) for i in range(400)}
    for k in range(40):  # one word in the middle changed: similarity above 0.8
        ws = texts[k].split()
        ws[len(ws) // 2] = "changedword"
        texts[1000 + k] = " ".join(ws)
    for k in range(40, 60):
        texts[1000 + k] = texts[k]
        texts[2000 + k] = texts[k].upper()
    for k in range(60, 120):  # junk
        texts[3000 + k] = " ".join(word() + "***" for _ in range(80))
    for k in range(120, 140):
        ws = texts[k].split()
        at = rng.randrange(len(ws))
        texts[k] = " ".join([*ws[:at], *bench[k % 8][1].split(), *ws[at:]])
    texts |= {4000: None, 4001: "", 4002: "too short", 4003: "same line here now " * 40}
    rows = [(d, t, "en", ("a", "b", None)[d % 7 % 3], len(t or "")) for d, t in texts.items()]
    labels = [(d, int(d < 3000), 0) for d in texts if d < 400 or 3000 <= d < 4000] + [(None, 1, 0), (1, None, 0)]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def _near(texts: dict[int, str], least: float = 0.8) -> dict[int, int]:
    """Smallest id of each group of texts that chains of near copies connect."""
    sets = {}
    for d, t in texts.items():
        ws = t.lower().split()
        sets[d] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}
    root = {d: d for d in texts}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= least * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in texts}


def test_stages_against_brute_force(spark, planted):
    folder, rows, bench = planted
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text, source = {r[0]: r[1] or "" for r in rows}, {r[0]: r[3] for r in rows}

    kept = stages["quality_rules"](spark, docs, folder)
    got = {r.doc_id for r in kept.collect()}
    cut = quality.fit(quality.measure(docs, "doc_id", "lang"), spark.read.parquet(f"{folder}/labels.parquet"))
    limits = {r: c for (_, r), c in cut.at.items()} or cut.rest
    want = set()
    for d, t in text.items():
        n, chars, symbols, dup, repeats, lines, capitals = _measures(t)
        share = {"symbols": symbols / max(chars, 1), "duplicate_lines": dup / max(lines, 1), "repeats": repeats / max(n, 1), "capitals": capitals / max(chars, 1)}
        if n >= 50 and 100 * repeats <= 50 * n and all(share[r] <= c for r, c in limits.items()):
            want.add(d)
    assert limits and got == want
    assert not {d for d in got if 3000 <= d < 4000} and len(set(range(400)) - got) <= 12
    assert kept.columns == docs.columns

    single = stages["near_duplicates"](spark, kept, folder)
    root = _near({d: text[d] for d in got})
    want = {min(d for d in group if d is not None) for group in ([d for d in got if root[d] == r] for r in set(root.values()))}
    got = {r.doc_id for r in single.collect()}
    assert got == want and not got & set(range(1000, 3000))

    clean = stages["decontamination"](spark, single, folder)
    bad = {d for d, _ in _brute([(d, text[d], None) for d in got], bench)}
    got = {r.doc_id for r in clean.collect()}
    assert len(bad) == 20 and got == want - bad

    mixed = stages["mixture"](spark, clean, folder).collect()
    words = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", text[d]))
    sizes, largest, taken = Counter(), Counter(), Counter()
    for d in got:
        sizes[source[d]] += words(d)
        largest[source[d]] = max(largest[source[d]], words(d))
    for r in mixed:
        assert r.text == text[r.doc_id]
        taken[r.source] += words(r.doc_id)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    for s, t in _targets(sizes).items():
        assert abs(taken[s] - t) <= 0.5 * largest[s] + 1

    placed = stages["shards"](spark, spark.createDataFrame(mixed, SCHEMA), folder).collect()
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in mixed)
    by = Counter(r.shard for r in placed)
    assert max(by.values()) - min(by.values()) <= 1
    assert {(r.shard, r.slot) for r in placed} == {(s, i) for s, n in by.items() for i in range(n)}
    for s in set(source.values()):
        n = [sum(r.shard == k and r.source == s for r in placed) for k in by]
        assert max(n) - min(n) <= 2


def test_near_copies_come_from_simhash_links(spark):
    """Texts whose fingerprints are linked share a cell of candidates, whatever their MinHash bands are."""
    from sitara.llm import simhash

    rng = random.Random(9)
    fps = [rng.getrandbits(63) for _ in range(60)]
    near = [f ^ sum(1 << b for b in rng.sample(range(63), k % 4)) for k, f in enumerate(fps[:40])]
    rows = [(i, f) for i, f in enumerate(fps)] + [(1000 + i, f) for i, f in enumerate(near)]
    cells: dict[int, set] = {}
    for r in simhash.fingerprint_cells(spark.createDataFrame(rows, "node long, fp long")).collect():
        cells.setdefault(r.node, set()).add(r.cell)
    of = dict(rows)
    for a in of:
        for b in of:
            linked = a != b and (of[a] ^ of[b]).bit_count() <= simhash.RADIUS
            assert bool(cells.get(a, set()) & cells.get(b, set())) == linked or a == b


def test_run_is_its_stages(spark, planted):
    from sitara.llm import common

    folder, *_ = planted
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert Counter(map(repr, out.collect())) == Counter(map(repr, docs.collect()))
    common.clean(spark)


def test_empty_tables(spark, planted, tmp_path):
    folder, *_ = planted
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES:  # no labels, no benchmark: only the base rules and copies cost rows
        docs = stage(spark, docs, str(tmp_path))
        assert 0 < docs.count() <= 3 * kept, name


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
