from __future__ import annotations

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from sitara.functions import validators as v
from sitara.functions.text import to_arabic_digits
from sitara.operators import audit, conversations, prepare
from sitara.operators.detect import deconflict_rows, detect, detect_distinct
from sitara.sources.policy import Entity, Policy, PolicyError, Preview, Replacement, baseline, overlay

PEPPER = b"0123456789abcdef0123456789abcdef"


def today():
    return F.to_date(F.lit("2026-09-19"))


def found(spark, *texts: str, policy: Policy | None = None):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    out = detect(rows, policy or baseline(), today()).orderBy("id").collect()
    return [[(s.entity_type, s.start, s.end, round(s.score, 2)) for s in r.spans] for r in out]


def types(spark, *texts: str, policy: Policy | None = None):
    return [[s[0] for s in r] for r in found(spark, *texts, policy=policy)]


def test_national_ids(spark):
    rows = found(spark, "id 28503122148219", "id 28503122148210", "99991234567890", "123456789012345678901234", "رقم ٢٨٥٠٣١٢٢١٤٨٢١٩")
    assert rows[0] == [("EG_NATIONAL_ID", 3, 17, 1.0)]
    assert rows[1] == [("EG_NATIONAL_ID", 3, 17, 0.85)]
    assert "EG_NATIONAL_ID" not in [s[0] for s in rows[2]] and rows[3] == []
    assert rows[4] == [("EG_NATIONAL_ID", 4, 18, 1.0)]


@pytest.mark.parametrize("nid", ["28513322148219", "28500122148219", "28503322148219", "28502292148219", "19803122148219", "28503123648219", "28503129948219", "2850312214821"])
def test_bad_national_ids(spark, nid):
    assert spark.range(1).select(v.parse_nid(F.lit(nid), today()).alias("p")).first().p is None


def test_mobiles_cards_mail(spark):
    assert types(spark, "01012345678", "+201012345678", "00201012345678", "010-1234-5678", "01312345678") == [["EG_MOBILE"]] * 4 + [[]]
    assert types(spark, "mail ahmed@example.com card 4111111111111111") == [["EMAIL_ADDRESS", "CREDIT_CARD"]]
    assert types(spark, "card 4111 1111 1111 1111 12", "4111111111111112") == [["CREDIT_CARD"], []]


def test_context_decides(spark):
    rows = found(spark, "tax id 123-456-789", "order number 123-456-789 shipped today", "tax id 111-111-111", "جواز سفر A12345678", "build artifact A12345678", "جواز سفر a12345678")
    assert rows[0] == [("EG_TAX_ID", 7, 18, 0.65)]
    assert rows[1] == rows[2] == rows[4] == rows[5] == []
    assert [s[0] for s in rows[3]] == ["EG_PASSPORT"]


def test_ibans(spark):
    assert types(spark, "account EG880003000500000000012345678", "EG880003000500000000012345679", "GB82 WEST 1234 5698 7654 32") == [["EG_IBAN"], [], ["IBAN_CODE"]]


def test_digits_of_hexadecimal_text_are_no_numbers(spark):
    tokens = ("cc0386e01012345678f1", "7b201012345678c", "f01012345678ab3d9", "9e28503122148219d", "a28503122148219ab", "9f0e28503122148219")
    assert types(spark, *[f'token = "{t}" end' for t in tokens]) == [[]] * len(tokens)
    assert types(spark, "tel01012345678", "ID28503122148219", "no. a01012345678", "abc+201012345678 now", "01012345678cd") == [["EG_MOBILE"], ["EG_NATIONAL_ID"], *[["EG_MOBILE"]] * 3]


def test_addresses(spark):
    rows = found(spark, "العنوان ١٢ شارع الهرم، الجيزة", "أنا عايش في القاهرة", "القاهرة مدينة كبيرة", "شارع", "123 Main Street, Springfield")
    assert rows[0][0][0] == "EG_ADDRESS" and rows[0][0][1] == 8
    assert rows[1:] == [[], [], [], []]


def test_null_empty_and_repeats(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.com"), (3, "a@b.com")], "id int, text string")
    p = baseline()
    out = prepare.prepare(detect(rows, p, today()), p, PEPPER).orderBy("id").collect()
    assert [(r.id, r.masked, len(r.spans)) for r in out] == [(1, None, 0), (2, "", 0), (3, "<EMAIL>", 1), (3, "<EMAIL>", 1)]
    assert detect(rows.limit(0), p).count() == 0


def test_fingerprints_are_hmacs_of_one_form(spark):
    cases = {("EG_NATIONAL_ID", "28503122148219"): "e2058163d2afcccd", ("EG_MOBILE", "010-1234-5678"): "1da9bc245208d998", ("CREDIT_CARD", "4111 1111 1111 1111"): "7b7e6cb2715c7b1c", ("EG_IBAN", "EG88 0003 0005 0000 0000 0123 45678"): "93f0314594452c02", ("EMAIL_ADDRESS", "ahmed@example.com"): "d212c01488c80c73", ("AR_PERSON", "محمد علي"): "255e05a5935ec65b"}
    rows = spark.createDataFrame([(*k, want) for k, want in cases.items()], "e string, x string, want string")
    for r in rows.withColumn("fp", prepare.fingerprint(F.col("e"), F.col("x"), PEPPER)).collect():
        assert r.fp == r.want
    assert spark.range(1).select(prepare.fingerprint(F.lit("PERSON"), F.lit("!!!"), PEPPER)).first()[0] is None
    assert spark.range(1).select(prepare.hmac_sha256(F.lit("x é"), PEPPER)).first()[0] == hmac.new(PEPPER, "x é".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(PolicyError):
        prepare.fingerprint(F.lit("A"), F.lit("b"), b"")


def test_previews_and_replacements(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(prepare.preview(F.lit("28503122148219"), "first_last", 4, 4)) == "2850******8219"
    assert one(prepare.preview(F.lit("12345678"), "first_last", 4, 4)) is None
    assert one(prepare.replacement(F.lit("9f75871d3d222bcb"), "<PERSON>", "labelled_fingerprint")) == "<PERSON:9f75871d>"
    assert one(prepare.replacement(F.lit("9f75871d3d222bcb"), "[x]", "labelled_fingerprint")) == "[x:9f75871d]"
    pool = ("John Doe", "Jane Roe", "Sam Poe", "Alex Coe", "Chris Loe")
    assert one(prepare.replacement(F.lit("e2058163d2afcccd"), "<P>", "surrogate", None, pool)) == pool[3]


@pytest.mark.parametrize("bad", [{"strategy": "constant"}, {"strategy": "constant", "value": " "}, {"strategy": "surrogate"}, {"strategy": "surrogate", "pool": ("a", " ")}, {"strategy": "surrogate", "pool": ("a", "a")}, {"pool": ("a",)}, {"strategy": "redact", "value": "x"}])
def test_bad_replacements(bad):
    with pytest.raises(PolicyError):
        Replacement(**bad)


def test_deconflict_is_the_greedy_loop(spark):
    rng = random.Random(3)
    rows = []
    for text in range(120):
        for _ in range(rng.randrange(8)):
            s = rng.randrange(20)
            rows.append((text, s, s + rng.randrange(1, 9), round(rng.random(), 1), rng.randrange(2), rng.choice("ABC")))
    got = {tuple(r) for r in deconflict_rows(spark.createDataFrame(rows, "text_id int, start int, end int, score double, specificity int, entity_type string"), "text_id").collect()}
    want = set()
    for text in range(120):
        kept: list[tuple] = []
        for r in sorted((r for r in rows if r[0] == text), key=lambda r: (-(r[2] - r[1]), -r[3], -r[4], r[5], r[1])):
            if not any(k[1] <= r[1] and r[2] <= k[2] for k in kept):
                kept.append(r)
        want |= set(kept)
    assert got == want


def test_allow_never_hides_mask(spark):
    p = Policy({"EMAIL_ADDRESS": Entity("EMAIL_ADDRESS", "contact", "MASK", 0.5, "<EMAIL>"), "EG_ADDRESS": Entity("EG_ADDRESS", "location", "ALLOW", 0.4)})
    rows = spark.createDataFrame([("شارع الهرم a@b.com قرب النادي",)], "text string")
    assert prepare.prepare(detect(rows, p, today()), p, PEPPER).first().masked == "شارع الهرم <EMAIL> قرب النادي"


def test_masking_is_idempotent_and_blocks(spark):
    p, _ = overlay(baseline(), [{"entity_type": "EMAIL_ADDRESS", "replacement_strategy": "surrogate", "replacement_pool": ["x@example.org", "y@example.org"]}, {"entity_type": "CREDIT_CARD", "action": "block"}])
    rows = spark.createDataFrame([("a@b.com", ), ("4111111111111111 is mine",)], "text string")
    once = prepare.prepare(detect(rows, p, today()), p, PEPPER)
    twice = prepare.prepare(detect(once.select(F.col("masked").alias("text")), p, today()), p, PEPPER)
    assert [r.masked for r in once.collect()] == [r.masked for r in twice.collect()]
    assert [r.blocked for r in once.collect()] == [False, True]


def test_partial_overlaps_are_joined(spark):
    s = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("replacement"), F.lit("MASK").alias("action")) for a, b, x in ((0, 4, "<A>"), (3, 8, "<B>"), (8, 9, "<C>"))])
    assert prepare.masked(spark.range(1).select(F.lit("abcdefghij").alias("text"), s.alias("spans"))).first().masked == "<A><C>j"


def test_arabic_digits_give_the_same_fingerprint(spark):
    p = baseline()
    rows = spark.createDataFrame([("28503122148219",)], "text string")
    both = rows.union(rows.select(to_arabic_digits(F.col("text"))))
    fps = {r.spans[0].value_fp for r in prepare.prepare(detect(both, p, today()), p, PEPPER).collect()}
    assert fps == {"e2058163d2afcccd"}


def test_events_hold_no_value(spark):
    p = baseline()
    rows = spark.createDataFrame([("r1", 0, "call 01012345678")], "request_id string, text_index int, text string")
    events = audit.to_events(prepare.prepare(detect(rows, p, today()), p, PEPPER))
    assert [f"{n} {k}" for n, k in events.dtypes] == [x.replace("long", "bigint") for x in audit.EVENT_SCHEMA.split(", ")]
    assert not any("01012345678" in str(x) for x in events.first())


def test_distinct_detection_joins_back(spark):
    rows = spark.createDataFrame([(1, "a@b.com"), (2, "a@b.com"), (3, "x"), (4, None)], "id int, text string")
    assert [(r.id, len(r.spans)) for r in detect_distinct(rows, baseline(), today()).orderBy("id").collect()] == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_distinct_detection_of_hot_texts(spark, monkeypatch):
    from sitara.operators import detect as module

    monkeypatch.setattr(module, "HOT", 5)
    rows = spark.range(60).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a@b.com' WHEN id % 3 = 1 THEN concat('n', id) END AS text").repartition(7)
    out = detect_distinct(rows, baseline(), today()).collect()
    assert sorted((r.id, len(r.spans)) for r in out) == [(i, int(i % 3 == 0)) for i in range(60)]


def test_requests(spark):
    rows = [("r", ["mail a@b.com", "", None], [("1", "function", ("f", '{"to":"c@d.com"}')), ("2", "function", ("g", None))], {"user_api_key_user_id": "u"}, None)]
    req = spark.createDataFrame(rows, conversations.REQUEST_SCHEMA)
    p = baseline()
    out = conversations.mask_requests(req, p, PEPPER, today()).first()
    assert out.texts == ["mail <EMAIL>", "", None] and out.tool_calls[0].function.arguments == '{"to":"<EMAIL>"}'
    assert out.entity_counts == {"EMAIL_ADDRESS": 2} and not out.blocked
    assert req.select(*conversations.identity(F.col("metadata"), F.col("fallback_metadata"))).first().user_id == "u"


def test_policy_rules():
    merged, skipped = overlay(baseline(), [{"entity_type": "PERSON", "score_threshold": 0.9}, {"entity_type": "NEW_ONE"}, {"entity_type": "LOCATION", "enabled": False}])
    assert merged.entities["PERSON"].threshold == 0.9 and "LOCATION" not in merged.entities and len(skipped) == 1
    assert merged.fingerprint() != baseline().fingerprint()
    with pytest.raises(PolicyError):
        Preview("last", 0, 9)
    with pytest.raises(PolicyError):
        prepare.check_pepper("short")


def test_many_spans_in_one_text(spark):
    """Time follows the number of spans: 20,000 in one text, cut and masked too."""
    import time

    n = 20_000
    rows = spark.createDataFrame([(" ".join(f"u{i}@example.com" for i in range(n)),), ("mobile ٠١٠12345678 " * 3,)], "text string")
    p = Policy({k: v for k, v in baseline().entities.items() if k in ("EMAIL_ADDRESS", "EG_MOBILE")}, baseline().gazetteer)
    done = prepare.prepare(detect(rows, p), p, b"0" * 32)
    began = time.monotonic()
    got = done.select("spans", "masked").collect()
    assert time.monotonic() - began < 20
    spans = sorted(got, key=lambda r: -len(r.spans))
    assert [(s.start, s.end) for s in spans[0].spans][:3] == [(0, 14), (15, 29), (30, 44)] and len(spans[0].spans) == n
    assert spans[0].masked == " ".join(["<EMAIL>"] * n) and len(spans[1].spans) == 3


def test_span_pieces_by_plain_python(spark):
    """Deconfliction and joining of overlaps over hundreds of random spans against loops."""
    import random

    from sitara.operators import scan

    rng = random.Random(9)
    cases = []
    for k in range(40):
        n = rng.choice([0, 1, 5, 127, 129, 400])
        spans = []
        for i in range(n):
            a = rng.randrange(0, 40 + 4 * n)
            spans.append((a, a + rng.randrange(1, 12), rng.choice(["EG_A", "B", "AR_C"]), "r", rng.choice([0.5, 0.9]), None, rng.choice(["MASK", "ALLOW", "BLOCK"]), str(i)))
        cases.append((k, spans))
    df = spark.createDataFrame(cases, f"k int, s array<{scan.FOUND}>")
    cut = F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("replacement")))
    out = df.withColumn("cut", cut).select("k", F.expr(scan.deconflicted("s")).alias("kept"), F.expr(scan.joined("cut")).alias("joined")).collect()
    for r in out:
        spans = sorted(cases[r.k][1], key=lambda s: (s[0], -s[1], -s[4], -int(s[2][:3] in ("EG_", "AR_")), s[2], s[:5], s[6:]))
        every = strong = -1
        want = []
        for s in spans:
            if s[1] > (max(every, strong) if s[6] == "ALLOW" else strong):
                want.append(s)
            every, strong = max(every, s[1]), strong if s[6] == "ALLOW" else max(strong, s[1])
        assert [tuple(x) for x in r.kept] == want
        joined = []
        for a, b, v in sorted((s[0], s[1], s[7]) for s in cases[r.k][1]):
            if joined and joined[-1][1] > a:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]), joined[-1][2])
            else:
                joined.append((a, b, v))
        assert [tuple(x) for x in r.joined] == joined


def test_detection_runs_no_python(spark):
    p = baseline()
    done = prepare.prepare(detect(spark.createDataFrame([("ﻻ 😀 a@b.com",)], "text string"), p), p, b"0" * 32)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_a_scan_is_built_once(spark, monkeypatch):
    """Calls to the JVM for a second detection under the same policy, as each micro-batch makes one."""
    from py4j import clientserver, java_gateway

    calls = []
    for kind in {java_gateway.GatewayConnection, clientserver.ClientServerConnection}:
        monkeypatch.setattr(kind, "send_command", lambda self, *a, _send=kind.send_command, **b: (calls.append(1), _send(self, *a, **b))[1])
    rows = spark.createDataFrame([("a@b.com",)], "text string")
    p = baseline()
    prepare.prepare(detect(rows, p), p, b"0" * 32)
    calls.clear()
    prepare.prepare(detect(rows, p), p, b"0" * 32)
    assert len(calls) < 1_000
