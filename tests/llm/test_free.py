"""Quality rules, SimHash groups, language model, token files, pages, licences against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sitara.llm import html, licenses, lm, quality, simhash, tokens
from sitara.llm.blocks import text_blocks

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, m string, fp long"


def _docs(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", "x", 1) for d, t in texts], SCHEMA)


def _lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def _texts(n=120, seed=4):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "AND", "naïve", "Straße", "x y", "***", "a|b", "École"] + [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 90))) for _ in range(n)]
    out = [t.replace(" w1 ", "\n") for t in out]
    return [*out, "", None, " \t\n", "one", "two words", "a b c", "same line\nsame line\nsame line", "x " * 30_000, out[5], out[5], out[7] + " more"]


def test_blocks_hash_words_alike():
    texts = [t or "" for t in _texts()]
    seen: dict[str, int] = {}
    for b in text_blocks(pa.array(texts), lower=True):
        words = [w for t in texts[b.lo : b.hi] for w in WORDS.findall(_lower(t))]
        hashes = b.hashes().tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def _measures(t: str) -> tuple:
    w = WORDS.findall(t)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(lines), len(re.findall("[A-Z]", t))


def test_quality_measures(spark):
    for r in quality.measure(_docs(spark, list(enumerate(_texts()))), "doc_id", "text").collect():
        assert tuple(r.m) == _measures(r.text or ""), (r.text or "")[:80]


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 3, 0.2), (200, 0, 0.01), (500, 7, 0.03), (30, 30, 0.5)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_cutoffs_hold_their_promise(spark):
    """Good texts have few symbols, bad ones many: the bad go, and of the good no more than promised."""
    rng = random.Random(8)
    rows = [(i, " ".join((f"word{rng.randrange(10**6)}" + ("***" if i % 5 == 0 and rng.random() < 0.9 else "")) for _ in range(60))) for i in range(3000)]
    docs = _docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(3000)] + [(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    measured = quality.measure(docs, "doc_id", "lang")
    cut = quality.fit(measured, labels)
    assert ("en", "symbols") in cut.at
    kept = {r.doc_id for r in quality.judge(measured, cut).where("kept").collect()}
    good = {i for i in range(3000) if i % 5}
    assert len(good - kept) <= quality.ALPHA * len(good) and not (kept - good)
    assert quality.fit(measured, labels.limit(50)).at == {}
    out = quality.keep_good(docs, cut)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert quality.keep_good(docs.limit(0), cut).count() == 0


def test_cutoffs_of_small_strata(spark):
    """200 good labels prove a language's cutoffs; languages with fewer, or none, share those of a pool."""
    rng = random.Random(9)
    langs = ["en"] * 900 + ["fr"] * 300 + ["it"] * 150 + [None] * 150 + ["xx"] * 5
    rows = [(i, " ".join(f"word{rng.randrange(10**6)}" + ("***" if i % 4 == 0 and rng.random() < 0.5 else "") for _ in range(60)), lang) for i, lang in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(1500)], "doc_id long, quality int")
    measured = quality.measure(docs, "doc_id", "lang")
    cut = quality.fit(measured, labels)
    assert cut.own == {"en", "fr"} and "symbols" in cut.rest
    assert {r.doc_id for r in quality.judge(measured, cut).where("kept").collect()} == {i for i in range(len(langs)) if i % 4}


def test_certificates_and_copies(spark):
    """Copies are one trial; certificates hold what a binomial tail needs; null strata have cutoffs."""
    rng = random.Random(10)
    rows = [(i, " ".join(f"word{rng.randrange(10**6)}" + ("***" if i % 4 == 0 else "") for _ in range(60)), None if i % 2 else "en") for i in range(800)]
    copies = [(1000 + i, rows[1][1], None) for i in range(500)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i >= 1000 or i % 4 != 0)) for i in [*range(800), *range(1000, 1500)]], "doc_id long, quality int")
    cut = quality.fit(quality.measure(docs, "doc_id", "lang"), labels)
    assert {c.strata: c.n for c in cut.certificates if len(c.strata) == 1}.get((None,), 0) <= 400
    for c in cut.certificates:
        assert c.tail == pytest.approx(quality.binomial_tail(c.k, c.n, quality.ALPHA)) and c.tail <= quality.DELTA
    assert any("symbols" in c.cutoffs for c in cut.certificates)
    assert quality.fit(quality.measure(docs, "doc_id", "lang"), labels.limit(0)) == quality.Cutoffs()


def _fingerprint(t: str) -> int:
    w = WORDS.findall(_lower(t))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)] or ([xxhash.xxh64_intdigest(" ".join(w).encode(), 42)] if w else [])
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash_groups(spark):
    rng = random.Random(6)
    texts = [(i, t) for i, t in enumerate(_texts(60))]
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    for k in range(40):
        ws = list(base)
        ws[rng.randrange(len(ws))] = f"edit{k}"
        texts.append((1000 - k, " ".join(ws)))
    fp = {d: _fingerprint(t or "") for d, t in texts}
    parent = {d: d for d in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    docs = _docs(spark, texts)
    out = simhash.groups(simhash.fingerprints(docs)).collect()
    assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in out} == {d: (f, root(d)) for d, f in fp.items()}
    kept = simhash.keep_one(docs.union(docs.limit(3)).union(_docs(spark, [(None, "no name")])))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, d) for d in sorted({root(d) for d in fp})] + [(True, 0)]
    assert simhash.groups(simhash.fingerprints(docs.limit(0))).count() == 0


def test_links_with_small_blocks(spark, monkeypatch):
    """Cells beyond the limit are compared block by block, with the same links."""
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = {tuple(r) for r in simhash.components(simhash.links(df)).collect()}
    monkeypatch.setattr(simhash, "CELL_ROWS", 10)
    assert {tuple(r) for r in simhash.components(simhash.links(df)).collect()} == want


def test_keep_one_by_five_word_shingles(spark):
    """Near copies of similarity 0.8 or more go, transitively; others stay, and so do unrelated rows of one doc_id."""
    rng = random.Random(12)
    texts = []
    for g in range(30):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 160))]
        for k in range(5):
            ws = list(base)
            for _ in range(rng.randrange(0, 5)):
                ws[rng.randrange(len(ws))] = f"edit{rng.randrange(10**6)}"
            texts.append((g * 10 + k, " ".join(ws)))
    texts += [(3, "another text of the same name"), (500, None), (501, " "), (502, "Another  TEXT of the\nsame name")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = 0
    for i in range(len(texts)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if either == 0 or len(sets[i] & sets[j]) >= 0.8 * either - 1e-9:
                near += texts[i][1] != texts[j][1]
                parent[root(i)] = root(j)
    assert near > 20
    want = sorted(min(texts[j][0] for j in range(len(texts)) if root(j) == r) for r in {root(i) for i in range(len(texts))})
    docs = _docs(spark, texts)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want
    assert want.count(3) >= 1 and simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_hubs_and_hot_prints(spark):
    """A hub of 3,000 edges, a chain and a pair; and rows of which a third share a fingerprint."""
    edges = [(5000, i) for i in range(3000)] + [(i, i + 1) for i in range(6000, 6040)] + [(9001, 9000), (9000, 9001), (2999, 6040), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(1, 3000), 5000, *range(6000, 6041)]} | {9001: 9000}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0
    rows = [(i, 0 if i % 3 == 0 else (i << 20) * 0x9E3779B97F4A7C15 % (1 << 62)) for i in range(6000)]
    out = simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long"))
    assert out.columns == ["fp", "doc_id", "component_id"] and out.count() == 6000
    assert out.where("fp = 0 AND component_id = 0").count() == 2000


def test_copies_with_small_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    docs = _docs(spark, [(i, " ".join([*base[: 100 + i % 90], f"end{i}", *base[100 + i % 90 :]])) for i in range(60)])
    monkeypatch.setattr(simhash, "COPY_WEIGHT", 300)
    monkeypatch.setattr(simhash, "COPY_HASHES", 500)
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [0]


@pytest.mark.parametrize("weight", [300, 1500])
def test_copies_of_large_cells(spark, monkeypatch, weight):
    """Members of a cell that are unlike its first are compared with those that joined it, and with one another, over all blocks."""
    rng = random.Random(6)
    words = [f"v{rng.randrange(10**6)}" for _ in range(900)]
    chain = [" ".join(words[8 * k : 8 * k + 200]) for k in range(60)]
    core = [f"c{i}" for i in range(150)]
    star = [" ".join([f"s{k}-{i}" if i in range(3 * k, 3 * k + 12) else w for i, w in enumerate(core)]) for k in range(40)]
    docs = _docs(spark, list(enumerate(chain + star)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, chain + star)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    monkeypatch.setattr(simhash, "COPY_WEIGHT", weight)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(root))


def _kneser_ney(train: list[list], score: list[list]) -> tuple[list[float], int, int]:
    uni, tri = Counter(x for s in train for x in s), Counter()
    for s in train:
        padded = ["<s>", "<s>", *s]
        tri.update(zip(padded, padded[1:], padded[2:], strict=False))
    bi = Counter((v, w) for _, v, w in tri)
    one = Counter(w for _, w in bi)
    d3, d2, d1 = (lm.discounts([sum(n == j for n in c.values()) for j in (1, 2, 3, 4)]) for c in (tri, bi, one))
    total3, free3, total2, free2, K = Counter(), Counter(), Counter(), Counter(), sum(one.values())
    for (u, v, _), n in tri.items():
        total3[u, v] += n
        free3[u, v] += d3[min(n, 3) - 1]
    for (v, _), n in bi.items():
        total2[v] += n
        free2[v] += d2[min(n, 3) - 1]
    free1 = sum(d1[min(n, 3) - 1] for n in one.values()) / K

    def level(n, total, free, d, lower):
        return (n - d[min(n, 3) - 1] if n else 0) / total + free / total * lower if total else lower

    def prob(u, v, w):
        p = (max(one[w] - d1[min(one[w], 3) - 1], 0) / K if one[w] else 0) + free1 / (len(uni) + 1)
        return level(tri[u, v, w], total3[u, v], free3[u, v], d3, level(bi[v, w], total2[v], free2[v], d2, p))

    for u, v in [*list(total3)[:20], ("never", "seen"), ("never", next(iter(uni)))]:
        assert sum(prob(u, v, x) for x in uni) + prob(u, v, "never seen") == pytest.approx(1)
    logs = []
    for s in score:
        padded = ["<s>", "<s>", *s]
        logs.append(sum(math.log10(prob(*x)) for x in zip(padded, padded[1:], padded[2:], strict=False)))
    return logs, sum(uni.values()), len(uni)


def test_a_lost_model_file_is_an_error(spark):
    from pathlib import Path

    docs = _docs(spark, [(i, f"one two three word{i} again and again") for i in range(200)])
    model = lm.train(docs.select("text"))
    assert model.files and lm.score(docs, model).where("score < 0").count() == 200
    folder = Path(model.path.removeprefix("file:"))
    lost = sorted(folder.glob("grams-*"))
    assert {p.stem for p in lost} == {f"grams-{f}" for f in model.files}
    lost[0].unlink()
    lm.table_file.cache_clear()
    fresh = spark.createDataFrame([(i, f"one two three word{i} again and again", "", "", "", 0) for i in range(200)], docs.schema)
    moved = folder.rename(folder.with_name(folder.name + "-moved"))  # files that workers have open stay readable under the old name only
    from dataclasses import replace

    with pytest.raises(Exception, match="grams-"):
        lm.score(fresh, replace(model, path=str(moved))).collect()


@pytest.mark.parametrize("small", [False, True])
def test_language_model(spark, monkeypatch, small):
    """Scores are those of the plain model; also with many files, shards, spread words and hand-overs."""
    if small:
        for name, value in (("SHARD_TOKENS", 300), ("FILE_TOKENS", 1500), ("FILE_WORDS", 16), ("HELD", 400), ("LOOKUP", 2000), ("SPREAD", 0.05), ("BUCKET", 2)):
            monkeypatch.setattr(lm, name, value)
    texts = list(enumerate(_texts() + ["common word here " * 400]))
    docs = _docs(spark, texts)
    toks = {d: [*WORDS.findall(_lower(t or "")), None] for d, t in texts}
    seen = [d for d, _ in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    want, n, vocab = _kneser_ney([toks[d] for d in seen], [toks[d] for d, _ in texts])
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))).select("text"))
    assert (model.tokens, model.vocab) == (n, vocab)
    assert not small or (len(model.files) > 5 and model.per_file > 1 and len(model.vocab_files) > 1 and len(model.pair_files) > 1)
    uni = Counter(x for d in seen for x in toks[d])
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    for (d, _), w in zip(texts, want, strict=True):
        r = got[d]
        assert r.score == pytest.approx(w, rel=1e-9) and r.n_tokens == len(toks[d]) and r.n_known == sum(uni[x] > 0 for x in toks[d])
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (vocab + 1))) for x in toks[d]), rel=1e-9)
    assert spark.range(1).select(lm.held_out(F.lit(None).cast("long"))).first()[0] is False
    lm.release(spark, model)


def test_tables_of_grams(tmp_path):
    """Every key is found with its value, large ones too; others are not."""
    rng = np.random.default_rng(3)
    uri = str(tmp_path / "grams-0")
    writer = lm.TableWriter(uri, ("tri", "ctx"))
    want = {}
    for shard, n in ((0, 0), (2, 1), (3, 5000)):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values = np.where(rng.random(n) < 0.01, rng.integers(255, 10**9, n), rng.integers(1, 255, n))
        want[shard] = keys, values
        writer.table("tri", shard, keys, *lm._byte(values))
    writer.close()
    t = lm.TableFile(uri, 4)
    for shard, (keys, values) in want.items():
        hit, places, code = t.find("tri", np.full(len(keys), shard), keys)
        assert hit.tolist() == list(range(len(keys)))
        got = code.astype(np.int64)
        got[got == 255] = t.large("tri", places[got == 255])[:, 0] if (got == 255).any() else 0
        assert got.tolist() == values[hit].tolist()
        assert not len(t.find("tri", np.full(len(keys), shard), keys ^ np.uint64(2))[0])
    assert not len(t.find("tri", np.array([1]), np.array([5], np.uint64))[0]) and not len(t.find("ctx", np.array([0]), np.array([5], np.uint64))[0])


def test_runs_of_columns():
    rng = np.random.default_rng(5)
    for kind in (np.dtype("<u4"), np.dtype("<u8")):
        cols = [np.sort(rng.integers(0, 1 << 31, 1000)).astype(kind), *[rng.integers(0, 1 << 31, 1000).astype(kind) for _ in range(2)]]
        assert all(np.array_equal(a, b) for a, b in zip(cols, lm._unpack(kind, lm._pack(kind, *cols), 3), strict=True))


def test_language_model_of_nothing(spark):
    docs = _docs(spark, [(1, "a b"), (2, None)])
    model = lm.train(docs.select("text").limit(0))
    assert [(r.n_tokens, r.n_known) for r in lm.score(docs, model).orderBy("doc_id").collect()] == [(3, 0), (1, 0)]
    assert lm.score(docs.limit(0), lm.train(docs.select("text"))).count() == 0


def test_language_model_beats_unigrams_on_held_out_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))).select("text"))
    r = lm.score(docs.where(lm.held_out(F.col("doc_id"))), model).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_repeated_texts_score_higher(spark, sf_dir):
    """A text that the model learnt twice scores above what words in its length usually score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    learnt = docs.where(~lm.held_out(F.col("doc_id")))
    scored = lm.score(docs, lm.train(learnt.union(learnt.where("doc_id % 9 = 0")).select("text")))
    rate = scored.where("n_tokens > 50").select("doc_id", (F.col("score") / F.col("n_tokens")).alias("r"))
    known = rate.where(~lm.held_out(F.col("doc_id")))
    once, twice = (known.where(x).agg(F.percentile_approx("r", 0.5)).first()[0] for x in ("doc_id % 9 <> 0", "doc_id % 9 = 0"))
    assert twice > once > rate.where(lm.held_out(F.col("doc_id"))).agg(F.percentile_approx("r", 0.5)).first()[0]


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    texts = [*enumerate(_texts(80)), (500, "<|endoftext|> it's wide é ΣΑΣ 123 don't"), (501, "z" * 300), (502, "ﬁn ½ ①")]
    random.Random(3).shuffle(texts)
    files = tokens.write(_docs(spark, texts), tokenizer, str(tmp_path / "tok"))
    got, at = {r.doc_id: r for r in tokens.read(spark, files).collect()}, 0
    assert len(got) == len(texts)
    for d, t in sorted(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
    part = next((tmp_path / "tok").glob("part-*.tok"))
    with pytest.raises(ValueError, match="another dictionary"):
        tokens.open_part(part.read_bytes(), b"other")
    reader = tokens.open_part(part.read_bytes(), (tmp_path / "tok" / f"{files.dictionary}.dict").read_bytes())
    assert reader.ids(0)[-1] == 1


def test_token_files_of_odd_tables(spark, tokenizer):
    rows = _docs(spark, [(None, "a"), (1, "b"), (1, "b"), (0, None)])
    out = tokens.read(spark, tokens.write(rows, tokenizer)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in out] == [(None, 2), (0, 1), (1, 2), (1, 2)]
    assert tokens.read(spark, tokens.write(rows.limit(0), tokenizer)).count() == 0


PAGES = {
    "<html><body><nav><a>Home</a></nav><article><h1>T &amp; x</h1><p>One <b>bo</b>ld\n text.<br>Two.<p>Ti.</article><footer>c</footer></body></html>": "T & x One bold text. Two. Ti.",
    "<article><p>Keep this.</p><div class='ad-box'>Buy</div><aside>Side</aside><p>And this.</p><form><p>mail</p></form><section id='comments'><p>Nice!</p></section></article>": "Keep this. And this.",
    "<body><div id=sidebar>links links</div><div class=content><p>" + "Long text of the story. " * 8 + "</p><p>Short.</p></div><div class='cookie-notice'>We use cookies</div></body>": ("Long text of the story. " * 8).strip() + " Short.",
    "<body><script>var t='</p>';</script><style>p{}</style><main>Only &eacute;&#33;</main><noscript>x</noscript>": "Only é!",
    "<body><nav><ul><li>a<article>Inside unclosed nav</article>": "Inside unclosed nav",
    "": "", "plain text only": "plain text only", "<p>": "",
}


def test_pages(spark):
    for page, want in PAGES.items():
        assert html.main_text(page) == want, page
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article>héé</article>", "y"), (2, None, "<article>héé</article>", "y")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in html.extract_pages(df).orderBy("page_id").collect()] == [(1, "", 0), (2, "héé", 3), (2, "héé", 3)]
    assert html.extract_pages(df.limit(0)).count() == 0


STORY = "A long paragraph of the story that goes on for a while and says much of what there is to say about it. " * 3
HARD_PAGES = {
    "cards beside the story": ("<body><div id=content><p>" + STORY + "</p><p>" + STORY + "</p></div><article>Card one</article><article>Card two</article></body>", 2),
    "hidden": ("<article><p>" + STORY + "</p><div hidden>secret</div><p style='display: none'>gone</p><p aria-hidden=true>gone</p></article>", 1),
    "names that only look like marks": ("<article><div class='share-price'><p>" + STORY + "</p></div><div class='read-more-content'><p>" + STORY + "</p></div></article>", 2),
    "layout named after a sidebar": ("<body><div class='has-sidebar layout'><div class='post'><p>" + STORY + "</p></div><div class=sidebar><p>" + "link text " * 5 + "</p></div></div></body>", 1),
    "everything in a marked wrapper": ("<body><div class='page sidebar-right'><p>" + STORY + "</p><p>" + STORY + "</p></div></body>", 2),
    "story in a container that is marked": ("<body><div class=banner><p>" + STORY + "</p><p>" + STORY + "</p></div><p>Short end.</p></body>", 2),
    "links inside the article": ("<article><p>" + STORY + "</p><div><a href=a>Buy a very cheap thing now</a></div><ul><li><a>Other story</a><li><a>One more story</a></ul></article>", 1),
    "comments": ("<main><p>" + STORY + "</p><section id=comments><p>" + STORY + "</p></section></main>", 1),
}


def test_hard_pages():
    for name, (page, times) in HARD_PAGES.items():
        assert html.main_text(page) == " ".join([STORY.strip()] * times) + (" Short end." if "container that" in name else ""), name
    head = "<main><header class='entry-header'><h1>The headline</h1><ul class='share-links'><li><a>Share it</a></ul></header><p>" + STORY + "</p></main>"
    assert html.main_text(head) == "The headline " + STORY.strip()
    lead = "<body><div class=wrap><p>A short lead.</p><div class=body><p>" + STORY + "</p><p>" + STORY + "</p></div><p>Closing words.</p></div><footer>f</footer></body>"
    assert html.main_text(lead) == f"A short lead. {STORY.strip()} {STORY.strip()} Closing words."
    assert html.main_text("</div>" * 50_000 + "<article>x</article>") == "x"
    assert len(html.main_text("<article>" + f"<p>{STORY}" * 3000)) == 3000 * len(STORY) - 1


def _smooth(values, sigma):
    at = lambda i, j: math.exp(-((i - j) ** 2) / (2 * sigma**2)) if abs(i - j) <= math.ceil(3 * sigma) else 0.0
    return [sum(at(i, j) * v for j, v in enumerate(values)) / sum(at(i, j) for j in range(len(values))) for i in range(len(values))]


def test_smoothing_and_threshold():
    rng = random.Random(12)
    for n in (1, 2, 5, 40):
        values = [rng.random() * 100 for _ in range(n)]
        for sigma in (0.5, 1.0, 2.3):
            assert html.smooth(values, sigma) == pytest.approx(_smooth(values, sigma))
        t = html.threshold(values)
        low, high = [v for v in values if v < t], [v for v in values if v >= t]
        assert not low or not high or t == pytest.approx((sum(low) / len(low) + sum(high) / len(high)) / 2, abs=1e-6)
    assert 2 < html.threshold([1, 1, 2, 50, 60, 55]) < 50 and html.threshold([]) == 0


def test_random_pages_give_the_article_in_order():
    """Pages built at random around an article: exactly its paragraphs, in page order."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega")) + str(rng.randrange(99)) for _ in range(n))
    for _ in range(60):
        body, want = [], []
        body.append("<nav><ul>" + "".join(f"<li><a href=x>{say(2)}</a></li>" for _ in range(rng.randrange(2, 9))) + "</ul></nav>")
        if rng.random() < 0.5:
            body.append(f"<div class='{rng.choice(('ad', 'promo-box', 'cookie-notice', 'sponsored'))}'><p>{say(rng.randrange(3, 25))}</p></div>")
        wrap = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div id=main><section>", "</section></div>")))
        paragraphs = [say(rng.randrange(30, 90)) for _ in range(rng.randrange(3, 9))]
        body.append(wrap[0])
        for p in paragraphs:
            body.append(rng.choice(("<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<p><b>{}</b></p>")).format(p))
            want.append(p)
        body.append(f"<section id=comments><p>{say(40)}</p></section>" if rng.random() < 0.4 else "")
        body.append(wrap[1])
        body.append(f"<aside><p>{say(30)}</p></aside><footer>&copy; {say(5)}</footer>")
        assert html.main_text("<html><body>" + "\n".join(body) + "</body></html>") == " ".join(want)


@pytest.fixture(scope="module")
def classifier(spark, sf_dir):
    return licenses.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_licences(spark, classifier, sf_dir):
    cases = [("Some prose here.\nReleased under the MIT License.\nMore.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("LICENSED UNDER CC BY-NC 4.0.", "cc-by-nc"), ("Nothing to see.", "none"), ("", "none"), (None, "none"), ("a\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "cc-by-nc,mit"), ("All rights reserved. Unauthorized copying of this document is prohibited.", "unknown"), ("w " * 20_000, "none")]
    out = licenses.scan(_docs(spark, [(i, t) for i, (t, _) in enumerate(cases)]), classifier)
    assert {r.doc_id: r.license for r in out.collect()} == {i: w for i, (_, w) in enumerate(cases)}
    families = {"mit": "MIT License", "apache-2.0": "Apache License", "gpl-3.0": "General Public License, version 3", "cc-by-nc": "CC BY-NC"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = licenses.scan(docs, classifier).join(docs.select("doc_id", "text"), "doc_id").collect()
    right = sum(r.license == (",".join(sorted(f for f, s in families.items() if s in r.text)) or "none") for r in said)
    assert right / len(said) > 0.98
    assert licenses.scan(docs.limit(0), classifier).count() == 0


def test_grams_probabilities_and_confirmation_by_plain_python(classifier):
    """What a paragraph's words, features, probabilities and template share must be, word by word."""
    from sitara.llm.blocks import mix

    texts = ["Released under the MIT License.\n\n(this) 'is' prose: w1 w2\nmore, here", "", "one", "*** --- licensed under the (apache) license, version 2.0 ***", "the the the license license"]
    one = {}
    words = lambda line: [w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in line.split()]
    for w in {w for t in texts for w in words(t)}:
        one[w] = licenses._grams_of([w or "-"]).one[0]
    pair = lambda a, b: mix(mix(np.array([one[a]])) + one[b])[0]
    n = 0
    for b in text_blocks(pa.array(texts), lower=True):
        g = licenses.grams(b)
        p = classifier.probabilities(g)
        lines = [(d, words(x)) for d, t in enumerate(texts) for x in t.split("\n") if x.split()]
        assert len(lines) == len(g.line_doc) and g.line_doc.tolist() == [d for d, _ in lines]
        assert licenses._paragraphs(g, b.n).tolist() == [2, 0, 1, 1, 1]
        for i, (_, ws) in enumerate(lines):
            got = g.line == i
            assert g.one[got].tolist() == [one[w] for w in ws] and g.two[got][:-1].tolist() == [pair(a, c) for a, c in zip(ws, ws[1:])]
            weights = {int(h): classifier.weights[k] for k, h in enumerate(classifier.vocab)}
            z = classifier.bias.copy()
            for h in [*(one[w] for w in ws), *(pair(a, c) for a, c in zip(ws, ws[1:]))]:
                z = z + weights.get(int(h), 0.0) / math.sqrt(len(ws))
            e = np.exp((z - z.max()) / classifier.temperature)
            assert p[i] == pytest.approx(e / e.sum())
            have = {int(pair(a, c)) for a, c in zip(ws, ws[1:])}
            for family, templates in licenses.TEMPLATES.items():
                best = 0.0
                for t in templates:
                    tw = words(t)
                    if all(w in one for w in tw):
                        best = max(best, len({int(pair(a, c)) for a, c in zip(tw, tw[1:])} & have) / len({int(pair(a, c)) for a, c in zip(tw, tw[1:])}))
                assert classifier.confirm(family, g.two[got]) >= best - 1e-12
            n += 1
    assert n == 6


def test_whole_licence_texts(spark, classifier):
    import textwrap

    cases = [("Copyright (c) 2024 A Person\n\n" + textwrap.fill(max(licenses.TEMPLATES[f], key=len), 72), f) for f in ("mit", "apache-2.0", "gpl-3.0", "bsd", "isc", "unlicense", "epl", "mpl-2.0")]
    cases += [("\n\n".join(textwrap.fill(x + ".", 70) for x in max(licenses.TEMPLATES["bsd"], key=len).split(". ")), "bsd")]
    out = licenses.scan(_docs(spark, [(i, t) for i, (t, _) in enumerate(cases)]), classifier).collect()
    said = {r.doc_id: set(r.license.split(",")) - {"unknown"} for r in out}
    assert said == {i: {f} for i, (_, f) in enumerate(cases)}


def test_licences_of_odd_tables(spark):
    """An empty table to fit on, null ids, repeated rows."""
    rows = _docs(spark, [(None, "Released under the MIT License."), (1, None), (2, "x"), (2, "x")])
    model = licenses.fit(rows.limit(0))
    out = licenses.scan(rows, model).collect()
    assert sorted((r.doc_id or 0, r.license, r.n_paragraphs) for r in out) == [(0, "mit", 1), (1, "none", 0), (2, "none", 1), (2, "none", 1)]


def test_licences_in_wrapped_and_long_lines(spark, classifier):
    import textwrap

    grant = next(t for t in licenses.TEMPLATES["mit"] if t.startswith("Permission"))
    rng = random.Random(5)
    prose = " ".join(f"w{rng.randrange(10**5)}" for _ in range(3000))
    cases = [(f"Title\n\n{textwrap.fill(grant, 40)}\n\nEnd.", "mit"), ("\n".join("# " + x for x in textwrap.wrap(grant, 50)), "mit"), (f"{prose} Released under the MIT License. {prose}", "mit"), (f"{prose} This work is licensed under the GNU General Public License, version 3. {prose}", "gpl-3.0"), (prose, "none")]
    cases += [(textwrap.fill(x, 60), f) for f, ts in licenses.TEMPLATES.items() for x in ts if len(x) > 120]
    out = licenses.scan(_docs(spark, [(i, t) for i, (t, _) in enumerate(cases)]), classifier).collect()
    assert {r.doc_id: r.license for r in out} == {i: w for i, (_, w) in enumerate(cases)}
