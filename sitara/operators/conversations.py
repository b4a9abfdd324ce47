"""Conversations and requests: flattening, masking, writing back.

Tool calls are structs whose ``function`` is a struct or a map with ``arguments``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitara.operators import prepare
from sitara.operators.detect import detect_distinct
from sitara.sources.policy import Policy

REQUEST_SCHEMA = (
    "request_id string, texts array<string>, tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>, "
    "metadata map<string,string>, fallback_metadata map<string,string>"
)
IDENTITY = ("user_id", "team_id", "key_alias", "key_hash", "end_user_id")


def identity(metadata: Column, fallback: Column) -> list[Column]:
    """Identity fields from the request's metadata, each from the fallback where it is absent."""
    keys = {"user_id": "user_api_key_user_id", "team_id": "user_api_key_team_id", "key_alias": "user_api_key_alias", "key_hash": "user_api_key_hash", "end_user_id": "user_api_key_end_user_id"}
    return [F.coalesce(F.try_element_at(metadata, F.lit(k)), F.try_element_at(fallback, F.lit(k))).alias(n) for n, k in keys.items()]


def at(values: Column, index: Column) -> Column:
    """An element of a parallel array; null where the array is short."""
    return F.get(values, index)


def flatten_batch(requests: DataFrame) -> DataFrame:
    """texts with parallel arrays (message_indices, message_roles, fields) -> a row per text."""
    keep = [c for c in requests.columns if c not in ("texts", "message_indices", "message_roles", "fields")]
    rows = requests.select(*keep, "message_indices", "message_roles", "fields", F.posexplode("texts").alias("text_index", "text"))
    i = F.col("text_index")
    return rows.select(*keep, "text_index", "text", at(F.col("message_indices"), i).alias("message_index"), at(F.col("message_roles"), i).alias("message_role"), at(F.col("fields"), i).alias("field"))


def _slots(requests: DataFrame, key: str) -> DataFrame:
    """All slots of requests, empty ones too: the key, container, slot, text, field."""
    texts = requests.select(key, F.lit("texts").alias("container"), F.posexplode("texts").alias("slot", "text"), F.lit("content").alias("field"))
    calls = requests.select(key, F.lit("tool_calls").alias("container"), F.posexplode("tool_calls").alias("slot", "c"), F.lit("tool_call.args").alias("field"))
    calls = calls.select(key, "container", "slot", F.col("c.function.arguments").alias("text"), "field")
    return texts.unionByName(calls)


def _set_arguments(call: Column, value: Column, function: T.DataType) -> Column:
    """A tool call with other arguments; ``function`` may be a struct or a map."""
    f = call["function"]
    if isinstance(function, T.MapType):
        others = F.map_filter(f, lambda k, _: k != "arguments")
        return call.withField("function", F.when(F.map_contains_key(f, "arguments"), F.map_concat(others, F.create_map(F.lit("arguments"), value))).otherwise(f))
    return call.withField("function", F.when(f.isNotNull(), f.withField("arguments", value)))


def flatten_request(requests: DataFrame) -> DataFrame:
    """Contents and tool-call arguments of requests as one list of slots: request_id, container, slot, text, field. Empty ones are left out."""
    return _slots(requests, "request_id").where(F.coalesce(F.col("text"), F.lit("")) != "")


def mask_requests(requests: DataFrame, policy: Policy, pepper: bytes, today: Column | None = None) -> DataFrame:
    """Requests with texts and tool-call arguments masked in place, ``blocked`` and ``entity_counts``.

    Counts come from the spans of each request. A blocked request keeps its
    place; whether it goes on is the caller's decision by ``blocked``.
    """
    keyed = requests.withColumn("__request", F.sha2(F.to_json(F.struct("request_id", "texts", "tool_calls")), 256))
    slots = _slots(keyed, "__request")
    done = prepare.prepare(detect_distinct(slots, policy, today), policy, pepper)
    types = F.transform("spans", lambda s: F.struct(s["entity_type"].alias("entity_type")))
    # Repeated requests share a key and have equal slots; a set keeps one of each, in order of place.
    entry = F.struct("container", "slot", "masked", "blocked", types.alias("types"))
    by = done.groupBy("__request").agg(F.array_sort(F.collect_set(entry)).alias("__slots"))
    out = keyed.join(by, "__request", "left")
    of = lambda kind: F.transform(F.filter("__slots", lambda s: s["container"] == kind), lambda s: s["masked"])
    out = out.withColumns({"__texts": of("texts"), "__calls": of("tool_calls")})
    texts = F.transform("texts", lambda t, i: F.coalesce(F.get("__texts", i), t))
    function = requests.schema["tool_calls"].dataType.elementType["function"].dataType
    calls = F.transform("tool_calls", lambda c, i: F.when(c.isNotNull(), _set_arguments(c, F.coalesce(F.get("__calls", i), c["function"]["arguments"]), function)))
    none = F.array().cast("array<struct<entity_type:string>>")
    spans = F.coalesce(F.flatten(F.transform("__slots", lambda s: s["types"])), none)
    blocked = F.coalesce(F.exists("__slots", lambda s: s["blocked"]), F.lit(False))
    return out.withColumns({"blocked": blocked, "entity_counts": prepare.counts(spans), "texts": texts, "tool_calls": calls}).drop("__request", "__slots", "__texts", "__calls")


def mask_turns(turns: DataFrame, policy: Policy, pepper: bytes, today: Column | None = None) -> DataFrame:
    """Conversation turns (conv_id, turn, role, text) with ``masked``, ``spans``; each distinct text is scanned once."""
    return prepare.prepare(detect_distinct(turns, policy, today), policy, pepper)


def chat_view(prepared: DataFrame) -> DataFrame:
    """The first text of each request: masked text, what was found with its placeholder, whether it was blocked."""
    one = prepared.where(F.col("text_index") == 0)
    found = F.transform("spans", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["replacement"], F.concat(F.lit("<"), s["entity_type"], F.lit(">"))).alias("placeholder")))
    return one.select("request_id", "masked", "blocked", found.alias("found"))


def not_cached(slots: DataFrame, cached: DataFrame) -> DataFrame:
    """Slots whose (policy_fp, lang, text hash) is not in a table of done ones."""
    return slots.withColumn("text_hash", F.sha2("text", 256)).join(cached, ["policy_fp", "lang", "text_hash"], "left_anti")


def hit_rate(slots: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: slots found in a table of done ones, those not found, and the share found, to four places (0 for none)."""
    keyed = slots.withColumn("text_hash", F.sha2("text", 256))
    marked = keyed.join(cached.select("policy_fp", "lang", "text_hash").distinct().withColumn("__hit", F.lit(True)), ["policy_fp", "lang", "text_hash"], "left")
    n = marked.agg(F.count_if(F.col("__hit")).alias("hits"), F.count_if(F.col("__hit").isNull()).alias("misses"))
    return n.withColumn("hit_rate", F.coalesce(F.round(F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), 4), F.lit(0.0)))


def parse_stream(frames: DataFrame, chunks: bool = False) -> DataFrame:
    """Deltas of server-sent events (request_id, seq, body) joined in order; stops at [DONE], skips bad JSON.

    A body holds whole frames, or with ``chunks`` what the network gave: frames
    may then go on from one body to the next, as all of an answer are joined.
    """
    if chunks:
        bodies = F.array_sort(F.collect_list(F.struct("seq", "body")))
        frames = frames.groupBy("request_id").agg(F.array_join(F.transform(bodies, lambda x: x["body"]), "").alias("body"), F.min("seq").alias("seq"))
    lines = frames.select("request_id", "seq", F.posexplode(F.split("body", "\n\n")).alias("at", "frame")).where(F.col("frame").startswith("data: "))
    data = lines.select("request_id", F.struct("seq", "at").alias("at"), F.substring("frame", 7, 1 << 30).alias("data"))
    ends = data.where("trim(data) = '[DONE]'").groupBy("request_id").agg(F.min("at").alias("end"))
    open_ = data.join(ends, "request_id", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    delta = F.from_json("data", "choices array<struct<delta:struct<content:string>>>")["choices"]
    said = open_.withColumn("delta", F.get(delta, F.lit(0))["delta"]["content"]).where("delta is not null")
    ordered = F.array_sort(F.collect_list(F.struct("at", "delta")))
    return said.groupBy("request_id").agg(F.array_join(F.transform(ordered, lambda x: x["delta"]), "").alias("text"))
