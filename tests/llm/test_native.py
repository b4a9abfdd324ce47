"""Sharding, mixing, decontamination and secret scans against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitara.llm import decontam, mixing, secrets, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, src string, rank long"


def _docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, "x", 2) for d, t, s in rows], DOC)


def _random_rows(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randrange(1, 5) for _ in range(int(rng.paretovariate(1.1)))), rng.choice(["hot", "hot", "b", "c", None])) for i in range(n)]
    return rows + [(n, None, "b"), (n + 1, "", None), (n + 2, "w " * 5000, "c"), (n + 3, "same", "hot"), (n + 3, "same", "hot"), (None, "no id", "b")]


def test_shards(spark):
    rows = _random_rows()
    out = sharding.interleave(_docs(spark, rows), 24).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(24):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sizes[k]))
    by = Counter(r.source for r in out)
    for s, n in by.items():
        share = [sum(r.source == s for r in out if r.shard == k) for k in range(24)]
        assert all(abs(x - n / 24) < 2.5 for x in share), (s, share)
    assert {r.law for r in out} == {"rows"} and all(r.grown_shard is None for r in out)
    again = sharding.interleave(_docs(spark, rows[::-1]).repartition(7), 24).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_shards_of_few_and_no_rows(spark):
    assert sharding.interleave(_docs(spark, [(1, "a", "s")]).limit(0)).count() == 0
    assert sharding.interleave(_docs(spark, [(1, "a", "s")])).first().shard == 0
    with pytest.raises(ValueError):
        sharding.interleave(_docs(spark, [(1, "a", "s")]), 0)


def _targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in stopped else level * w[s] for s in order}
        stopped |= over


def test_mix_reaches_targets(spark):
    rows = _random_rows(600)
    out = mixing.mix(_docs(spark, rows)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() >= {"n", "src", "rank", "mix_copies"}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = _targets(sizes)
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.mix_size == words(r.text) and r.mix_source_size == sizes[r.source] and 0 <= r.mix_copies <= 3
        assert r.mix_target == pytest.approx(want[r.source])
        taken[r.source] += r.mix_copies * r.mix_size
        largest[r.source] = max(largest[r.source], r.mix_size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 * largest[s] + 1
    again = mixing.mix(_docs(spark, rows[::-1]).repartition(5)).collect()
    assert Counter((r.doc_id, r.text, r.mix_copies) for r in again) == Counter((r.doc_id, r.text, r.mix_copies) for r in out)


def test_rates_are_the_entropy_balance(spark):
    """l solves the constraint, and rates are min(3, exp(l x))."""
    import math

    sizes = spark.createDataFrame([("a", s, n) for s, n in ((1, 50), (10, 20), (100, 3))], "src string, size long, n long")
    for target in (100.0, 550.0, 1200.0, 1640.0):
        goal = spark.createDataFrame([("a", 550, target)], "src string, source_size long, target double")
        r = mixing.balance(sizes, goal).first()
        got = sum(n * s * min(3.0, math.exp(r.lam * s / r["mean"])) for s, n in ((1, 50), (10, 20), (100, 3)))
        assert got == pytest.approx(target, rel=1e-3)


def test_mix_of_odd_tables(spark):
    assert mixing.mix(_docs(spark, [(1, "a", "s")]).limit(0)).count() == 0
    assert mixing.mix(_docs(spark, [(1, None, None), (2, "", "s")])).count() == 2
    assert mixing.mix(_docs(spark, [(1, "a b", "s")])).first().mix_copies == 1


def _jaccard(a: Counter, b: Counter) -> float:
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def _shingles(ws: list[str], k: int) -> Counter:
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def _brute(docs, bench) -> set:
    found, norm = set(), lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, b in bench:
        item = norm(b)
        if not item:
            continue
        k = min(5, len(item))
        want = _shingles(item, k)
        for d, t, _ in docs:
            ws = norm(t)
            if any(_jaccard(want, _shingles(ws[s : s + len(item)], k)) >= 0.8 for s in range(max(1, len(ws) - len(item) + 1 if len(ws) >= len(item) else 1))):
                found.add((d, i))
    return found


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    bench = [(i, " ".join(word() for _ in range(rng.randrange(14, 50))) + ".") for i in range(12)] + [(12, None), (13, ""), (14, "tiny item here"), (15, "word " * 20)]
    docs = []
    for d in range(60):
        ws = [word() for _ in range(rng.randrange(5, 120))]
        if d % 3 == 0:
            item = bench[d % 12][1].split()
            if d % 6 == 0 and len(item) > 30:
                item[len(item) // 2] = "changed"
            at = rng.randrange(len(ws))
            ws[at:at] = item
        docs.append((d, " ".join(ws), "s"))
    docs += [(100, None, "s"), (101, "", "s"), (102, bench[3][1].upper(), "s"), (102, bench[3][1].upper(), "s"), (103, "A tiny, ITEM here!", None), (104, "x " * 4000 + bench[5][1], "s"), (None, bench[4][1], "s")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.contaminated(_docs(spark, docs), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == _brute(docs, bench)
    assert sum(r.doc_id == 102 for r in got) == 2
    kept = decontam.drop_contaminated(_docs(spark, docs), table)
    bad = {d for d, _ in _brute(docs, bench)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _ in docs if d not in bad)
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert decontam.contaminated(_docs(spark, docs), table.limit(0)).count() == 0
    assert decontam.contaminated(_docs(spark, docs).limit(0), table).count() == 0


def test_recall_at_the_border_by_item_length(spark):
    """Of windows at similarity 0.80 to 0.85 (shingles replaced), those within the radius, by shingles of the item."""
    rng = random.Random(21)
    rows = []
    for n in (10, 20, 40, 80, 200):
        for k in range(120):
            a = [rng.getrandbits(63) for _ in range(n)]
            changed = n // 9  # n - c common of n + c: 0.8 at c = n / 9
            rows.append((n, a, [*a[changed:], *[rng.getrandbits(63) for _ in range(changed)]]))
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    far = F.bit_count(decontam.simhash(F.col("a")).bitwiseXOR(decontam.simhash(F.col("b"))))
    out = df.groupBy("n").agg(F.avg((far <= decontam.RADIUS).cast("double")).alias("recall"), F.min(decontam.weighted_jaccard(F.col("a"), F.col("b"))).alias("least")).collect()
    assert all(r.least >= 0.8 for r in out)
    assert {r.n: r.recall >= 0.97 for r in out} == {n: True for n in (10, 20, 40, 80, 200)}, out


def test_weighted_jaccard_by_counters(spark):
    rng = random.Random(22)
    rows = [([rng.randrange(6) for _ in range(rng.randrange(9))], [rng.randrange(6) for _ in range(rng.randrange(9))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [r[0] for r in df.select(decontam.weighted_jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([_jaccard(Counter(a), Counter(b)) for a, b in rows])


def test_targets_of_tiny_shares_end(spark):
    """A target far below its source, where words move in steps larger than the tolerance, still ends."""
    sizes = spark.createDataFrame([("a", 1_000_003, 7), ("b", 1, 10**6)], "src string, size long, n long")
    goal = spark.createDataFrame([("a", 7_000_021, 35.0), ("b", 10**6, 1e-3)], "src string, source_size long, target double")
    assert mixing.balance(sizes, goal).where("done").count() == 2


def test_large_groups_are_salted(spark, monkeypatch):
    """Beyond the broadcast's bytes joins salt their groups; results are the same."""
    from sitara.llm import common

    rows = _random_rows(300)
    plain = Counter(map(repr, sharding.interleave(_docs(spark, rows)).collect())), Counter((r.doc_id, r.text, r.mix_copies) for r in mixing.mix(_docs(spark, rows)).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert plain == (Counter(map(repr, sharding.interleave(_docs(spark, rows)).collect())), Counter((r.doc_id, r.text, r.mix_copies) for r in mixing.mix(_docs(spark, rows)).collect()))
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "a b")], "item_id long, text string")
    docs = _docs(spark, [(1, "x one two three four five six seven y", "s"), (2, "so a b it is", "s"), (3, "none", "s")])
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(1, 1), (2, 2)}


def test_hamming_blocks_miss_nothing(spark):
    """Any fingerprint within the radius shares a block value with the sought one."""
    rng = random.Random(2)
    pairs = []
    for n in (0, 1, 7, 13, 19):
        for _ in range(20):
            a = rng.getrandbits(63)
            pairs.append((a, a ^ sum(1 << i for i in rng.sample(range(63), n))))
    df = spark.createDataFrame(pairs, "a long, b long")
    hit = df.select(F.arrays_overlap(decontam._blocks(F.col("a"), decontam.RADIUS), decontam._blocks(F.col("b"))).alias("hit"))
    assert all(r.hit for r in hit.collect())


def _base(t: str) -> list[tuple]:
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


@pytest.fixture(scope="module")
def ratios(spark, sf_dir):
    return secrets.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_secret_spans(spark, ratios):
    key = "kJ8xQz2LmN4pR7sT9vW1yB3dF5gH6jK0"
    texts = [None, "", 'é😀 token = "abcdef123"', "secret: token = 'abcdefgh'", "PASSWORD=x passwd:yyyyyyy", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 14, "f" * 23 + " " + "0a" * 12, "token=password=abcdefgh", f"see {key} here", "internationalization_of_responsibilities", "api_key='" + "ab" * 20 + "'", "x" * 50_000 + " token=abcdefg"]
    docs = _docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in secrets.scan(docs, ratios).collect():
        got = [(s.start, s.rank, s.end, s.kind) for s in r.secret_spans]
        assert [s for s in got if s[3] != "markov"] == _base(r.text or ""), r.text
        assert got == sorted(got)
        if r.text and key in r.text:
            assert got == [(4, 3, 36, "markov")]
        if r.doc_id in (10, 12):
            assert not any(s[3] == "markov" for s in got)
    assert secrets.scan(docs.limit(0), ratios).count() == 0


def test_markov_models_on_held_out_strings(spark, ratios):
    rng = random.Random(9)
    import base64

    random_ = [base64.b64encode(hashlib.sha256(str(rng.random()).encode()).digest()).decode().rstrip("=") for _ in range(200)]
    parts = "account user total session manager payload response internal request buffer default value counter weather quarter invoice".split()
    plain = ["_".join(rng.choice(parts) for _ in range(4)) for _ in range(100)] + ["".join(rng.choice(parts).title() for _ in range(4)) for _ in range(100)]
    df = spark.createDataFrame([(True, x) for x in random_] + [(False, x) for x in plain], "random boolean, value string")
    out = df.select("random", secrets.is_random(F.col("value"), ratios).alias("said")).collect()
    assert sum(r.random == r.said for r in out) / len(out) > 0.97


def test_markov_recall_by_length_and_false_alarms(spark, ratios, sf_dir):
    """Random strings of 16 characters and more are found; names, paths, dates, UUIDs and words of documents are not."""
    import string

    rng = random.Random(31)
    found = {}
    for n in (16, 20, 32, 48):
        rows = [("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)),) for _ in range(300)]
        found[n] = spark.createDataFrame(rows, "value string").where(secrets.is_random(F.col("value"), ratios)).count() / 300
    assert found[16] > 0.85 and found[20] > 0.95 and found[32] > 0.99 and found[48] > 0.99, found
    import uuid

    plain = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(50)]
    plain += ["4785380592391139", "20240115093045123", "+20-1012-3456-7890-11"]
    plain += ["/usr/local/share/applications/index", "com/example/service/internal/RequestHandler", "2024-01-15-release-candidate-notes", "ThisIsAVeryLongClassNameForTesting", "MAX_CONCURRENT_CONNECTIONS_PER_HOST", "internationalisation-and-localisation", "==================", "--------------------------------"]
    plain += ["_".join(rng.sample(secrets.PROGRAM_WORDS, 3)) for _ in range(200)]
    wrong = [r.value for r in spark.createDataFrame([(x,) for x in plain], "value string").where(secrets.is_random(F.col("value"), ratios)).collect()]
    assert len(wrong) <= 2, wrong
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[a-z]{16,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("value")).distinct()
    n = words.count()
    assert words.where(secrets.is_random(F.col("value"), ratios)).count() <= 0.005 * n + 1


def test_pair_counts_and_ratios_by_plain_python(spark):
    import math

    rng = random.Random(4)
    rows = [(rng.random() < 0.5, "".join(rng.choice("abcXYZ019+-é") for _ in range(rng.randrange(0, 30)))) for _ in range(300)] + [(True, None), (False, "")]
    table = secrets.train(spark.createDataFrame(rows, "random boolean, value string"))
    n = len(secrets.ALPHABET)
    counts = {label: Counter() for label in (True, False)}
    for label, v in rows:
        for a, b in zip(v or "", (v or "")[1:]):
            if a in secrets.ALPHABET and b in secrets.ALPHABET:
                counts[label][a, b] += 1
    rate = lambda label, a, b: (counts[label][a, b] + secrets.PSEUDO) / (sum(counts[label][a, c] for c in secrets.ALPHABET) + secrets.PSEUDO * n)
    want = {(a, b): math.log(rate(True, a, b) / rate(False, a, b)) for a in secrets.ALPHABET for b in secrets.ALPHABET}
    assert table == pytest.approx([want[a, b] for a in secrets.ALPHABET for b in secrets.ALPHABET], abs=2e-6)
    values = ["abcXYZ", "a", "019+-", "zzzzzzzzzz_=/"]
    out = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.ratio(F.col("v"), table).alias("r")).collect()
    assert [r.r for r in out] == pytest.approx([sum(want[p] for p in zip(r.v, r.v[1:])) for r in out], abs=1e-4)


def test_secrets_without_labels(spark):
    docs = _docs(spark, [(1, "token = kJ8xQz2LmN4pR7sT9vW1yB3dF5gH6jK0", "s"), (2, None, None)])
    model = secrets.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [len(r.secret_spans) for r in secrets.scan(docs, model).orderBy("doc_id").collect()] == [1, 0]


@pytest.mark.parametrize(("n", "others"), [(1000, 9500), (7, 40)])
def test_mixing_of_equal_rows(spark, n, others):
    """Sources of nothing but equal rows come within a document of their targets too, whatever the number of copies."""
    rows = [(1, "four words are here", "c")] * n + [(2, "w x", "a")] * others + [(i, "one two three " * (i % 7), "b") for i in range(50)] + [(None, None, "c"), (1, "four words are here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = [mixing.mix(docs, columns=["source"]).groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.max("mix_target").alias("target"), F.max("mix_copies").alias("most"), F.count("*").alias("n")).collect() for _ in range(2)]
    assert sorted(map(str, out[0])) == sorted(map(str, out[1]))
    for r in out[0]:
        assert r.most <= 3 and abs(r.taken - r.target) <= {"a": 2, "b": 18, "c": 4, None: 4}[r.source], r
    assert sum(r.n for r in out[0]) == len(rows)
    kept = mixing.mix(docs.withColumns({"Rank": F.lit(1), "n": F.lit(2), "bucket": F.lit(3)}))
    assert kept.columns == ["doc_id", "text", "source", "Rank", "n", "bucket", "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    assert kept.agg(F.sum(F.col("mix_copies") * F.col("mix_size"))).first()[0] == sum(r.taken for r in out[0])
