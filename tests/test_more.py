"""Overlay as a table, strategies, comparison of taggers, cache hits, draining, formats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitara.functions.text import has_arabic, laid_out
from sitara.operators import audit, conversations, evaluate, models
from sitara.sources.policy import OVERLAY_SCHEMA, STRATEGIES, PolicyError, baseline, delete_overlay, overlay_table, strategies, upsert_overlay
from sitara.streaming import audit_stream as st


def _rows(spark, *rows):
    names = [x.split()[0] for x in OVERLAY_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], OVERLAY_SCHEMA)


def test_overlay_rows_go_in_and_out(spark):
    from datetime import datetime

    made = datetime(2026, 1, 1)
    table = _rows(spark, {"entity_type": "BADGE", "gliner_prompt": "badge", "action": "BLOCK", "created_at": made}, {"entity_type": "PERSON", "score_threshold": 0.9})
    new = _rows(spark, {"entity_type": "BADGE", "gliner_prompt": "badge number", "action": "MASK", "created_at": datetime(2026, 2, 2)}, {"entity_type": "PLATE", "gliner_prompt": "plate"})
    out = upsert_overlay(table, new, baseline())
    assert {r.entity_type: (r.action, r.created_at) for r in out.collect()} == {"BADGE": ("MASK", made), "PERSON": (None, None), "PLATE": (None, None)}
    policy, skipped = overlay_table(baseline(), out)
    assert policy.prompts["badge number"] == "BADGE" and not skipped
    assert {r.entity_type for r in delete_overlay(out, "PERSON").collect()} == {"BADGE", "PLATE"}
    with pytest.raises(PolicyError):
        delete_overlay(out, "NOBODY")
    with pytest.raises(PolicyError):
        upsert_overlay(table, _rows(spark, {"entity_type": "NO_PROMPT"}), baseline())
    assert upsert_overlay(table.limit(0), new.limit(0), baseline()).count() == 0


def test_strategies_are_those_of_policies(spark):
    rows = strategies(spark).collect()
    assert {r.name for r in rows} == set(STRATEGIES) and {r.name for r in rows if r.realistic} == {"constant", "surrogate"}


def test_variants_are_timed_and_compared(spark):
    cases = spark.createDataFrame([("1", "msa", "met Ann and Bob"), ("2", "msa", "nobody"), ("3", "egyptian", None)], "case_id string, register string, text string")
    gold = spark.createDataFrame([("1", "msa", 4, 7, "PER"), ("1", "msa", 12, 15, "PER")], "case_id string, register string, start int, end int, label string")
    both = models.timed(cases, lambda: models.DictionaryTagger({"Ann": "PER", "Bob": "PER"}), "both")
    one = models.timed(cases, lambda: models.DictionaryTagger({"Ann": "PER", "nobody": "PER"}), "one")
    runs = both.union(one)
    assert runs.where("latency_ms >= 0").count() == 6
    rows = {r.variant: r for r in evaluate.compare_variants(runs, cases, gold, ["both", "one"]).collect()}
    assert (rows["both"].coverage_any, rows["both"].accepted, rows["one"].coverage_any, rows["one"].accepted) == (1.0, True, 0.5, False)
    verdicts = spark.createDataFrame([(True, 20.0), (True, 501.0), (False, 1.0), (None, None)], "a boolean, p double")
    assert [r[0] for r in verdicts.select(evaluate.tier_verdict(F.col("a"), F.col("p"))).collect()] == ["on", "too slow", "unavailable", "unavailable"]


def test_prompts_change_between_calls():
    tagger = models.ZeroShotTagger(models.DictionaryTagger({"Ann": "name", "Rome": "city"}), {"name": "PERSON"})
    assert [t[2] for t in tagger.tag(["Ann in Rome"])[0]] == ["PERSON"]
    tagger.set_prompts({"city": "LOCATION"})
    assert [t[2] for t in tagger.tag(["Ann in Rome"])[0]] == ["LOCATION"]


def test_a_batch_is_one_call(spark):
    class Counting(models.DictionaryTagger):
        def tag(self, texts):
            return [[(0, 1, str(len(texts)), 1.0)] for _ in texts]

    rows = spark.range(40).select(F.concat(F.lit("latin words "), F.col("id").cast("string")).alias("text")).coalesce(1)
    tag = models.tag_spans(lambda: Counting({}), "latin")
    assert {r.s[0].entity_type for r in rows.select(tag(F.col("text")).alias("s")).collect()} == {"40"}


def test_cache_hits(spark):
    slots = spark.createDataFrame([("p", "en", "a"), ("p", "en", "b"), ("p", "en", "b"), ("q", "en", "a")], "policy_fp string, lang string, text string")
    done = slots.limit(1).select("policy_fp", "lang", F.sha2("text", 256).alias("text_hash"))
    assert tuple(conversations.hit_rate(slots, done.union(done)).first()) == (1, 3, 0.25)
    assert tuple(conversations.hit_rate(slots.limit(0), done).first()) == (0, 0, 0.0)


def test_drain_stops_a_stream(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "audit")
    rows = spark.createDataFrame([("r1", 0, "mail a@b.com")], "request_id string, text_index int, text string")
    rows.write.parquet(src)
    sink = st.AuditSink(spark, table, st.Spill(spark, str(tmp_path / "spill")))
    q = st.start(spark.readStream.schema(rows.schema).parquet(src), baseline, b"0123456789abcdef0123456789abcdef", sink, str(tmp_path / "ck"))
    q.processAllAvailable()
    assert st.drain(q, sink).written == 1 and not q.isActive


def test_formats(spark):
    one = spark.createDataFrame([("2026-09-19 22:30:00", "a ١"), (None, "a")], "ts string, t string")
    rows = one.select(audit.shown_time(F.col("ts").cast("timestamp"), "Africa/Cairo").alias("at"), has_arabic(F.col("t")).alias("arabic")).collect()
    assert [tuple(r) for r in rows] == [("2026-09-20 01:30:00", True), (None, False)]


def test_many_matches_lie_in_order(spark):
    import re

    texts = ["ab1 " * n + "é2" for n in (0, 1, 127, 128, 129, 1000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    places = laid_out(F.split("t", "[0-9]", -1), F.regexp_extract_all("t", F.lit("[0-9]"), F.lit(0)))
    for r in rows.select("t", places.alias("s")).collect():
        assert [tuple(s) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]", r.t)]


def test_many_labels_of_an_address(spark):
    from sitara.operators.detect import detect
    from sitara.plans.queries import only

    rows = spark.createDataFrame([("a@" + "b." * 30_000 + "com",), ("x@b.com.",), ("x@b.com.1",)], "text string")
    out = detect(rows, only("EMAIL_ADDRESS")).collect()
    assert [(r.spans[0].start, r.spans[0].end) for r in out] == [(0, 60_005), (0, 7), (0, 7)]


def test_splice_of_many_spans(spark):
    from sitara.functions.text import splice

    cases = []
    for n in (0, 1, 2, 127, 128, 129, 400):
        text, spans = "", []
        for i in range(n):
            text += "é" * (i % 3)
            spans.append((len(text), len(text) + 2, "" if i % 5 == 0 else f"<{i}>"))
            text += "ab"
        cases.append((text + "zé", spans[::-1]))
    rows = spark.createDataFrame(cases, "t string, s array<struct<start:int,end:int,replacement:string>>")
    for r in rows.select("t", "s", splice(F.col("t"), F.col("s")).alias("x")).collect():
        want, at = "", 0
        for s in sorted(r.s):
            want, at = want + r.t[at : s.start] + s.replacement, s.end
        assert r.x == want + r.t[at:]
    for bad in ([(0, 3, "x"), (2, 4, "y")], [(0, 99, "x")], [(2, 2, "x")], [(3, 1, "x")], [(-1, 1, "x")]):
        with pytest.raises(Exception, match="spans overlap"):
            spark.createDataFrame([("abcdef", bad)], rows.schema).select(splice(F.col("t"), F.col("s"))).collect()


def test_only_entities_asked_for(spark):
    from sitara.operators.detect import detect

    rows = spark.createDataFrame([("a@b.com 01012345678",)], "text string")
    assert [s.entity_type for s in detect(rows, baseline(), entities=("EG_MOBILE",)).first().spans] == ["EG_MOBILE"]


def test_frames_over_chunks(spark):
    whole = "".join(f'data: {{"choices":[{{"delta":{{"content":"{s}"}}}}]}}\n\n' for s in ("Hel", "lo", " you")) + "data: [DONE]\n\n"
    rows = [("r", i, whole[at : at + 11]) for i, at in enumerate(range(0, len(whole), 11))]
    out = conversations.parse_stream(spark.createDataFrame(rows, "request_id string, seq int, body string"), chunks=True)
    assert [tuple(r) for r in out.collect()] == [("r", "Hello you")]


def test_settled_texts(spark, tmp_path):
    from sitara.sources.synthetic import seed

    rows = spark.createDataFrame([("c", 0.0, "h"), ("c", 0.2, "he"), ("c", 0.4, "hey"), ("c", 2.0, "hey you"), ("d", 0.1, "x")], "conv_id string, at double, text string")
    rows = rows.select("conv_id", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("ts"), "text")
    assert {(r.conv_id, r.text) for r in st.settled(rows).collect()} == {("c", "hey"), ("c", "hey you"), ("d", "x")}
    seed(rows, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exists"):
        seed(rows, str(tmp_path / "t"))


class _Words:
    """A tokenizer of words: its length is a word's id; 101 and 102 stand around a text."""

    def encode(self, text, add_special_tokens=True):
        import re
        from types import SimpleNamespace

        words = list(re.finditer(r"\S+", text))
        ids, offsets = [len(m[0]) if m[0] != "Ann" and m[0] != "Lee" else 90 + (m[0] == "Lee") for m in words], [m.span() for m in words]
        if add_special_tokens:
            ids, offsets = [101, *ids, 102], [(0, 0), *offsets, (0, 0)]
        return SimpleNamespace(ids=ids, offsets=offsets, special_tokens_mask=[int(i > 100) for i in ids])


@pytest.mark.parametrize(("window", "overlap"), [(8, 2), (9, 3), (32, 8)])
def test_long_texts_in_windows(window, overlap):
    """The model refuses more tokens than it takes, and knows a second name only by the first beside it: names at any border are found once."""
    import numpy as np

    calls = []

    def run(feed):
        ids, mask = feed["input_ids"], feed["attention_mask"]
        assert ids.shape[1] <= window and ids.shape == mask.shape == feed["token_type_ids"].shape
        assert all(row[0] == 101 and row[int(m.sum()) - 1] == 102 for row, m in zip(ids, mask, strict=True))
        calls.append(len(ids))
        out = np.zeros((*ids.shape, 3))
        out[..., 0] = 5.0
        out[ids == 90] = [0, 9, 0]
        second = np.zeros(ids.shape, bool)
        second[:, 1:] = (ids[:, 1:] == 91) & (ids[:, :-1] == 90)
        out[second] = [0, 0, 9]
        return out

    tagger = models.TokenClassifier(run, _Words(), ["O", "B-PER", "I-PER"], window, overlap, call=4)
    texts = []
    for at in range(40):
        words = ["w" * (1 + i % 7) for i in range(60)]
        words[at : at + 2] = ["Ann", "Lee"]
        texts.append(" ".join(words))
    for t, tags in zip(texts, tagger.tag(texts), strict=True):
        assert [(a, b, label) for a, b, label, _ in tags] == [(t.index("Ann"), t.index("Ann") + 7, "PER")]
    assert max(calls) == 4 and tagger.tag(["", "no name", "Ann"])[0] == []
    for n in (0, 1, window - 2, window - 1, 100):
        ws = tagger.windows(n)
        assert [a for _, _, a, _ in ws][1:] == [b for _, _, _, b in ws][:-1] and ws[0][2] == 0 and ws[-1][3] == n
        assert all(lo <= a <= b <= hi <= lo + window - 2 for lo, hi, a, b in ws)
    with pytest.raises(ValueError, match="overlap"):
        models.TokenClassifier(run, _Words(), ["O"], 4, 2)
