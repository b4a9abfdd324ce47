from __future__ import annotations

import json
import logging

import pytest
from pyspark.sql import functions as F

from sitara.operators import audit, evaluate, models
from sitara.plans.queries import PEPPER
from sitara.sources.policy import baseline
from sitara.streaming import audit_stream as st

EVENTS = [(1, "2026-09-01 10:00:00", "u1", "EG_MOBILE", "MASK", "f1", "r1"), (2, "2026-09-01 10:30:00", None, "EG_MOBILE", "BLOCK", "f1", "r1"), (3, "2026-09-02 10:30:00", "u_2", "PERSON", "MASK", None, "r2")]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame(EVENTS, "id long, ts string, user_id string, entity_type string, action string, value_fp string, request_id string")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_audit_queries(events):
    assert [(r.entity_type, r.events, r.blocked) for r in audit.timeline(events).collect()] == [("EG_MOBILE", 2, 1), ("PERSON", 1, 0)]
    assert tuple(audit.summary(events).first()) == (3, 2, 1, 1, 2)
    assert [r.id for r in audit.page(events, 2).collect()] == [3, 2]
    assert [r.user_id for r in audit.fingerprint_users(events, "f1").collect()] == ["u1", None]
    assert [r.id for r in audit.recent(events, 24).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in audit.Filters(search="u_").apply(events).collect()] == [3]
    assert audit.timeline(events.limit(0)).count() == 0 and audit.summary(events.limit(0)).first().events == 0
    for bad in (0, 501):
        with pytest.raises(ValueError):
            audit.page(events, bad)
    with pytest.raises(ValueError):
        audit.timeline(events, "week")


def test_flags(spark, events):
    flags = spark.createDataFrame([(1, "confirmed", 1, None, "2026-01-01"), (1, "false_positive", 2, "n", "2026-01-03"), (1, "false_positive", 1, None, "2026-01-02")], "event_id long, verdict string, flagged_by int, note string, created_at string")
    assert audit.latest_flags(flags).count() == 2
    assert [(r.id, r.verdict) for r in audit.with_flags(events, flags).orderBy("id").collect()] == [(1, "false_positive"), (2, None), (3, None)]


def _scores(spark, predictions):
    cases = evaluate.parse_markup(spark.createDataFrame([("p1", "egyptian", "[محمد](PER) في [القاهرة](LOC)"), ("p2", "msa", "زار [أحمد](PER) المكان"), ("n1", "egyptian", "لا يوجد شيء هنا")], "case_id string, register string, marked string"))
    gold = cases.select("case_id", "register", F.inline("gold"))
    return evaluate.score_variant(cases, gold, spark.createDataFrame(predictions, "case_id string, start int, end int, label string, score double")).first()


def test_scores(spark):
    good = [("p1", 0, 4, "PER", 1.0), ("p1", 8, 15, "LOC", 1.0), ("p2", 4, 8, "PER", 1.0)]
    r = _scores(spark, good)
    assert (r.coverage_any, r.coverage_typed, r.char_recall, r.span_precision, r.fp_per_clean, r.accepted) == (1, 1, 1, 1, 0, True)
    r = _scores(spark, [*good, ("n1", 0, 2, "PER", 1.0), ("n1", 3, 5, "PER", 1.0)])
    assert r.fp_per_clean == 2 and not r.accepted
    r = _scores(spark, [("p1", 3, 5, "LOC", 1.0), ("p2", 8, 9, "PER", 1.0)])
    assert r.coverage_any == pytest.approx(1 / 3) and r.coverage_typed == 0
    assert _scores(spark, [("p9", 0, 1, "PER", 1.0)]).coverage_any == 0


@pytest.mark.parametrize(
    ("labels", "scores", "offsets", "want"),
    [
        ("B-PER I-PER O", (0.9, 0.8, 0.99), ((0, 4), (5, 9), (10, 14)), [(0, 9, "PER", 0.8)]),
        ("B-PER B-PER", (0.9, 0.9), ((0, 4), (5, 9)), [(0, 4, "PER", 0.9), (5, 9, "PER", 0.9)]),
        ("B-PER I-LOC", (0.9, 0.9), ((0, 4), (5, 9)), [(0, 4, "PER", 0.9), (5, 9, "LOC", 0.9)]),
        ("O B-PER O", (1, 0.9, 1), ((0, 0), (0, 5), (0, 0)), [(0, 5, "PER", 0.9)]),
        ("B-PER", (0.3,), ((0, 4),), []),
    ],
)
def test_bio(labels, scores, offsets, want):
    assert models.decode_bio(labels.split(), scores, offsets) == want


def test_tidy():
    text = "أنا رايح لمنى في المعادي بكرة"
    assert models.tidy(text, [(17, 23, "LOC", 0.9)]) == [(17, 24, "LOC", 0.9)]
    assert models.tidy(text, [(9, 12, "LOC", 0.81), (12, 13, "LOC", 0.77)]) == [(9, 13, "LOC", 0.77)]
    assert len(models.tidy("القاهرة الاسكندرية", [(0, 7, "LOC", 0.9), (8, 18, "LOC", 0.9)])) == 2
    assert models.tidy("عمارة 12", [(0, 5, "LOC", 0.9)]) == [(0, 5, "LOC", 0.9)]


def test_missing_model_files(tmp_path):
    with pytest.raises(FileNotFoundError, match="model.onnx, tokenizer.json, labels.txt"):
        models.OnnxTagger(str(tmp_path))
    z = models.ZeroShotTagger(models.DictionaryTagger({"Ann": "person name"}), baseline().prompts)
    assert z.tag(["Ann here"]) == [[(0, 3, "PERSON", 0.9)]]
    assert models.ZeroShotTagger(z, {}).tag(["x"]) == [[]]


def test_stream_spills_and_replays(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "events")
    rows = spark.createDataFrame([("r1", 0, "mail a@b.com"), ("r2", 0, None)], "request_id string, text_index int, text string")
    rows.write.parquet(src)
    down = {"now": True}

    def append(df):
        if down["now"]:
            raise OSError("no database")
        df.write.mode("append").parquet(table)

    sink = st.AuditSink(spark, table, st.Spill(spark, str(tmp_path / "spill")), append)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = st.start(stream, baseline, PEPPER, sink, str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert (sink.stats.spilled, sink.stats.written, sink.spill.pending()) == (1, 0, 1)
    (segment,) = sink.spill.segments()
    from pathlib import Path

    (folder,) = sink.spill.batches(segment)
    Path(folder.removeprefix("file:"), "part-torn.json").write_text('{"id": 3, "ts"\n\n')
    assert sink.spill.corrupt(segment) == 1
    down["now"] = False
    assert sink.replay() == 1 and sink.spill.segments() == []
    out = st.distinct_events(spark.read.parquet(table)).collect()
    assert len(out) == 1 and out[0].entity_type == "EMAIL_ADDRESS" and not any("a@b.com" in str(x) for x in out[0])
    assert st.health(sink, q) == {"written": 0, "spilled": 1, "dropped": 0, "replayed": 1, "failures": 2, "pending": 0, "readable": True, "running": False}
    st.write_status(spark, str(tmp_path / "status.json"), sink.stats)
    st.write_status(spark, str(tmp_path / "status.json"), sink.stats)
    assert json.loads((tmp_path / "status.json").read_text())["replayed"] == 1


def test_spill_keeps_the_latest_segments(spark, tmp_path, events):
    spill = st.Spill(spark, str(tmp_path / "s"), most=2, roll=0)
    assert [spill.append(events.select("id")) for _ in range(4)] == [0, 0, events.count(), events.count()]
    assert [s.rsplit("-", 1)[1] for s in spill.segments()] == ["00000002", "00000003"]


def test_logs_are_redacted():
    record = logging.LogRecord("x", logging.INFO, "", 0, "m" * 900, (), None)
    record.text = "secret"
    st.RedactText().filter(record)
    assert record.text == "[redacted]" and len(record.msg) == 500


def test_nearest_rank_holds_no_group_in_a_task(spark):
    import random

    from sitara.operators import evaluate

    rng = random.Random(3)
    groups = {"a": [rng.random() for _ in range(999)], "b": [float(rng.randrange(3)) for _ in range(400)], "c": [7.5], None: [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "variant string, latency_ms double")
    out = evaluate.nearest_rank(df, "variant", "latency_ms", {"p95": 0.95, "p50": 0.5})
    want = {g: tuple(sorted(vs)[round(q * (len(vs) - 1))] for q in (0.95, 0.5)) for g, vs in groups.items()} | {"d": (None, None)}
    assert {r.variant: (r.p95, r.p50) for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    import statistics

    median = {g: statistics.median(vs) for g, vs in groups.items()} | {"d": None}
    assert {r.variant: (r.p95_ms, r.median_ms) for r in evaluate.latency(df).collect()} == {g: (v[0], median[g]) for g, v in want.items()}


def _spans(rng, n, most):
    out = []
    for _ in range(n):
        a = rng.randrange(0, 3 * most)
        out.append((f"c{rng.randrange(4)}", rng.choice(["msa", "mixed_script"]), a, a + rng.randrange(1, most), rng.choice(["PER", "LOC", None])))
    return out


@pytest.mark.parametrize(("stretch", "most"), [(1 << 16, 12), (8, 30)])
def test_sweeps_against_pairs(spark, monkeypatch, stretch, most):
    """Hits, precision and characters by comparing every pair and every character, also with spans over several stretches."""
    import random

    from sitara.operators import evaluate

    monkeypatch.setattr(evaluate, "STRETCH", stretch)
    rng = random.Random(most)
    gold, pred = _spans(rng, 25, most), _spans(rng, 25, most)
    gold += gold[:2] + [(None, "msa", 1, 5, "PER")]
    pred += pred[:3] + [(None, "msa", 1, 5, "PER")]
    schema = "case_id string, register string, start int, end int, label string"
    g, p = spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)
    meets = lambda a, b: a[0] is not None and a[0] == b[0] and a[2] < b[3] and b[2] < a[3]
    want = {(*x, any(meets(x, y) for y in pred), any(meets(x, y) and x[4] is not None and x[4] == y[4] for y in pred)) for x in gold}
    assert {tuple(r) for r in evaluate.span_hits(g, p).select("case_id", "register", "start", "end", "label", "hit", "typed").collect()} == want
    chars = lambda spans: {(s[0], i) for s in spans for i in range(s[2], s[3])}
    a, b = chars(gold), chars(pred)
    assert tuple(evaluate.character_coverage(g, p).first())[:3] == (len(a), len(a & b), len(b - a))
    cases = spark.createDataFrame([(f"c{i}",) for i in range(6)], "case_id string")
    row = evaluate.precision(cases, g, p).first()
    assert (row.predicted, row.true_spans) == (len(pred), sum(any(meets(x, y) for y in gold) for x in pred))


@pytest.mark.parametrize("stretch", [1 << 16, 8])
def test_precision_deals_each_span_once(spark, monkeypatch, stretch):
    """One row for a span in a stretch and one more for its case, empty spans and spans without an end as the comparison of pairs has them."""
    import random

    from sitara.operators import evaluate

    monkeypatch.setattr(evaluate, "STRETCH", stretch)
    rng = random.Random(stretch)
    pred, gold = ([(f"c{rng.randrange(9)}", a := rng.randrange(90), a + rng.choice([0, 0, 1, 3, 20])) for _ in range(60)] for _ in range(2))
    gold = [g for g in gold if g[0] not in ("c2", "c5")]
    # An empty span of gold where an empty prediction is takes nothing from the one around both.
    pred += [("e", 5, 5), ("f", 5, 5), ("n", 1, None), ("n", None, 4), (None, 0, 9)] + 2 * [("c5", 3, 30), ("c1", 3, 30)]
    gold += [("e", 5, 5), ("e", 3, 8), ("f", 5, 5), ("n", 0, 9), (None, 0, 9)]
    cases = [*(f"c{i}" for i in range(12)), "e", None]
    known = lambda *s: None not in s
    true = sum(any(known(*x, *y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in gold) for x in pred)
    clean = [c for c in cases if c is None or c not in {g[0] for g in gold}]
    schema = "case_id string, start int, end int"
    p, g = spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema)
    out = evaluate.precision(spark.createDataFrame([(c,) for c in cases], "case_id string"), g, p, 3)
    row = out.first()
    assert (row.predicted, row.true_spans, row.clean_cases) == (len(pred), true, len(clean))
    assert row.false_in_clean == sum(x[0] is not None and x[0] in clean for x in pred)
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 2


def test_tasks_of_a_sweep_follow_its_spans(spark, monkeypatch):
    from sitara.operators import evaluate

    monkeypatch.setattr(evaluate, "SWEPT", 50)
    g = spark.range(1_000).selectExpr("concat('c', id % 90) AS case_id", "'msa' AS register", "int(id % 7 * 40000) AS start", "int(id % 7 * 40000 + id % 50000 + 1) AS end", "if(id % 3 = 0, 'PER', 'LOC') AS label")
    p = g.withColumns({"start": F.col("end") - 1, "end": F.col("end") + 30, "label": F.lit("PER")}).where("start % 4 = 0")
    tasks = evaluate.sweep_tasks(g)
    assert tasks == 20
    got = evaluate.span_hits(g, p, tasks)
    assert got.count() == g.distinct().count() and got.exceptAll(evaluate.span_hits(g, p)).count() == 0
    assert got.rdd.getNumPartitions() == 20


def test_a_case_of_many_spans(spark):
    import time

    from sitara.operators import evaluate

    g = spark.range(100_000).select(F.lit("c").alias("case_id"), F.lit("msa").alias("register"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 7).cast("int").alias("end"), F.lit("PER").alias("label"))
    p = g.withColumns({"start": F.col("start") + 5, "end": F.col("end") + 6})
    began = time.monotonic()
    assert evaluate.span_hits(g, p).where("hit AND typed").count() == 100_000
    assert tuple(evaluate.character_coverage(g, p).first())[:3] == (700_000, 499_997, 300_003)
    assert time.monotonic() - began < 40


def test_an_outage_fills_few_segments(spark, tmp_path, events):
    """Segments roll by their bytes, the oldest go, and what was dropped is counted from their indexes."""
    rows = events.select("id")
    n = rows.count()
    one = st.Spill(spark, str(tmp_path / "one"))
    one.append(rows, ("q", 0))
    size = one.files.length(one.segments()[0])
    spill = st.Spill(spark, str(tmp_path / "s"), most=3, roll=2 * size)
    lost = [spill.append(rows, ("q", k)) for k in range(11)]
    assert len(spill.segments()) == 3 and sum(lost) == (11 * n) - spill.pending() and sum(lost) > 0
    assert max(len(spill.batches(s)) for s in spill.segments()) >= 2
    held = [spill.batch(b) for s in spill.segments() for b in spill.batches(s)]
    assert held == [(f"spilled q {k}", 0) for k in range(11 - len(held), 11)]
    kept = []
    sink = st.AuditSink(spark, "", spill, lambda df: kept.append(df.count()))
    waits = spill.pending()
    assert sink.replay() == waits == sum(kept) and spill.segments() == []
