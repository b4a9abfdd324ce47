"""Requests masked in place: shapes of tool calls, repeated and empty requests, many slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitara.operators import audit, conversations, prepare
from sitara.operators.detect import detect
from sitara.sources.policy import baseline
from sitara.streaming.audit_stream import distinct_events

PEPPER = b"0123456789abcdef0123456789abcdef"


def today():
    return F.to_date(F.lit("2026-09-19"))


def test_map_shaped_calls(spark):
    schema = "request_id string, texts array<string>, tool_calls array<struct<id:string,function:map<string,string>>>, metadata map<string,string>, fallback_metadata map<string,string>"
    rows = [("r", ["x"], [("1", {"name": "f", "arguments": "to c@d.com"}), ("2", {"name": "g"}), ("3", None), None], None, None)]
    req = spark.createDataFrame(rows, schema)
    out = conversations.mask_requests(req, baseline(), PEPPER, today()).first()
    assert out.tool_calls[0].function == {"name": "f", "arguments": "to <EMAIL>"} and out.tool_calls[1].function == {"name": "g"}
    assert out.tool_calls[2].function is None and out.tool_calls[3] is None and out.entity_counts == {"EMAIL_ADDRESS": 1}
    assert [r.text for r in conversations.flatten_request(req).orderBy(F.desc("container"), "slot").collect()] == ["to c@d.com", "x"]


def test_requests_that_share_an_id(spark):
    """Equal requests and different ones under one id keep their own texts and counts."""
    rows = [("r", ["a@b.com", f"call {i}"], None, None, None) for i in (0, 0, 1)] + [("r", None, None, None, None), (None, [], [], None, None)]
    out = conversations.mask_requests(spark.createDataFrame(rows, conversations.REQUEST_SCHEMA), baseline(), PEPPER, today()).collect()
    assert sorted((r.texts or [], r.entity_counts) for r in out if r.texts) == [(["<EMAIL>", "call 0"], {"EMAIL_ADDRESS": 1})] * 2 + [(["<EMAIL>", "call 1"], {"EMAIL_ADDRESS": 1})]
    assert len(out) == 5 and not any(r.blocked for r in out)


def test_places_hold_with_many_slots(spark):
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"{i} u{i}@x.com" for i in range(300)]
    out = conversations.mask_requests(spark.createDataFrame([("r", texts, None, None, None)], conversations.REQUEST_SCHEMA), baseline(), PEPPER, today()).first()
    assert out.texts == [t and f"{i} <EMAIL>" for i, t in enumerate(texts)]


def test_ids_of_rows_without_request(spark):
    """Texts without request_id that have equal spans are two events; a request logged again is one."""
    p = baseline()
    made = lambda rows, batch: audit.to_events(prepare.prepare(detect(rows, p, today()), p, PEPPER), batch=batch)
    rows = spark.createDataFrame([(None, 0, "a@b.com"), (None, 0, "a@b.com"), ("r", 0, "a@b.com")], "request_id string, text_index int, text string")
    assert distinct_events(made(rows, "1").union(made(rows, "1"))).count() == 3
    assert distinct_events(made(rows, "1").union(made(rows, "2"))).count() == 5
    assert distinct_events(made(rows.drop("request_id"), "1")).count() == 3


def test_detection_stands_in_a_plan_once(spark, sf_dir):
    from sitara.plans.queries import QUERIES

    plan = QUERIES["detect_documents"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
