"""The audit log: rows for spans, and the queries of an investigation."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENT_SCHEMA = (
    "id string, ts timestamp, request_id string, user_id string, team_id string, key_alias string, key_hash string, "
    "end_user_id string, entity_type string, recognizer string, score double, action string, span_start int, span_end int, "
    "value_len int, message_index int, message_role string, field string, value_fp string, preview string, model string, "
    "lang string, latency_ms int"
)
#: What investigators read; the key's hash stays behind.
EVENT_COLUMNS = tuple(c for c in (x.split()[0] for x in EVENT_SCHEMA.split(", ")) if c != "key_hash")
VERDICTS = ("confirmed", "false_positive")
PAGE, PAGE_MOST = 200, 500
_IDENTITY = ("request_id", "user_id", "team_id", "key_alias", "key_hash", "end_user_id", "model", "message_index", "message_role", "field")


def to_events(prepared: DataFrame, ts: Column | None = None, latency_ms: Column | None = None, batch: str | None = None) -> DataFrame:
    """One row per span of prepared texts, in the audit schema, without values. Identity columns that are absent are null.

    The id is 32 digits of a SHA-256 over the request, the text's place in it,
    the span and its value's fingerprint, so a request that is logged again
    gets its ids again. A row without request_id goes by its place in
    ``batch`` (default: a new batch for each call).
    """
    kinds = dict(x.rsplit(" ", 1) for x in EVENT_SCHEMA.split(", "))
    have = [F.col(c) if c in prepared.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _IDENTITY]
    index = F.col("text_index") if "text_index" in prepared.columns else F.lit(0).alias("text_index")
    place = F.concat(F.lit(f"row {batch or uuid.uuid4().hex} "), F.monotonically_increasing_id().cast("string"))
    request = F.when(F.col("request_id").isNotNull(), F.concat(F.lit("request "), F.col("request_id"))).otherwise(place) if "request_id" in prepared.columns else place
    # An outer generator: below an inner one the optimizer repeats the detection in a filter.
    rows = prepared.select(*have, index, "lang", request.alias("__request"), F.explode_outer("spans").alias("s")).where(F.col("s").isNotNull())
    parts = ["__request", "message_index", "text_index", "field", "s.start", "s.end", "s.entity_type", "s.recognizer", "s.value_fp"]
    key = F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])), 256), 1, 32)
    made = {"id": key, "ts": ts if ts is not None else F.current_timestamp(), "entity_type": F.col("s.entity_type"), "recognizer": F.col("s.recognizer"), "score": F.col("s.score"), "action": F.col("s.action"), "span_start": F.col("s.start"), "span_end": F.col("s.end"), "value_len": F.col("s.value_len"), "value_fp": F.col("s.value_fp"), "preview": F.col("s.preview"), "latency_ms": latency_ms if latency_ms is not None else F.lit(None)}
    return rows.select(*[made.get(c, F.col(c)).cast(k).alias(c) for c, k in kinds.items()])


@dataclass(frozen=True)
class Filters:
    """Conditions on events; those left out do not count. Both ends of the time range are inclusive."""

    since: datetime | None = None
    until: datetime | None = None
    user_id: str | None = None
    value_fp: str | None = None
    entity_types: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    search: str | None = None

    def apply(self, events: DataFrame) -> DataFrame:
        if self.since is not None:
            events = events.where(F.col("ts") >= F.lit(self.since))
        if self.until is not None:
            events = events.where(F.col("ts") <= F.lit(self.until))
        for column in ("user_id", "value_fp"):
            if (value := getattr(self, column)) is not None:
                events = events.where(F.col(column) == value)
        if self.entity_types:
            events = events.where(F.col("entity_type").isin(*self.entity_types))
        if self.actions:
            events = events.where(F.col("action").isin(*self.actions))
        if self.search:
            term = self.search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            anywhere = F.lit(False)
            for c in ("user_id", "key_alias", "end_user_id", "request_id"):
                if c in events.columns:
                    anywhere = anywhere | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
            events = events.where(anywhere)
        return events


def shown_time(ts: Column, zone: str = "UTC", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time as readers see it, in their zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz")), pattern)


def timeline(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Events and blocked ones by time bucket and entity, in order of time."""
    if unit not in ("minute", "hour", "day"):
        raise ValueError("unit must be minute, hour or day")
    made = events.groupBy(F.date_trunc(unit, "ts").alias("bucket"), "entity_type").agg(F.count("*").alias("events"), F.count_if(F.col("action") == "BLOCK").alias("blocked"))
    return made.orderBy("bucket", "entity_type")


def summary(events: DataFrame) -> DataFrame:
    """One row: events, distinct users and values, blocked and masked events."""
    return events.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("value_fp").alias("values"), F.count_if(F.col("action") == "BLOCK").alias("blocked"), F.count_if(F.col("action") == "MASK").alias("masked"))


def page(events: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of events, latest first."""
    if not 1 <= limit <= PAGE_MOST or offset < 0:
        raise ValueError(f"limit must be within 1 and {PAGE_MOST}, offset not negative")
    return events.select(*[c for c in EVENT_COLUMNS if c in events.columns]).orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def event(events: DataFrame, id_: str) -> DataFrame:
    return events.where(F.col("id") == id_)


def fingerprint_summary(events: DataFrame, fp: str) -> DataFrame:
    """One row on a value: occurrences, users, requests, first and last time."""
    hit = events.where(F.col("value_fp") == fp)
    return hit.agg(F.count("*").alias("occurrences"), F.countDistinct("user_id").alias("users"), F.countDistinct("request_id").alias("requests"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def fingerprint_users(events: DataFrame, fp: str, limit: int = 50) -> DataFrame:
    """Who sent a value most often; a null user is one of them. Ties go by user."""
    hit = events.where(F.col("value_fp") == fp)
    by = hit.groupBy("user_id").agg(F.count("*").alias("occurrences"), F.max("ts").alias("last_seen"))
    return by.orderBy(F.desc("occurrences"), F.asc_nulls_last("user_id")).limit(limit)


def recent(events: DataFrame, hours: int = 24) -> DataFrame:
    """Events of the last hours before the latest one."""
    latest = events.agg(F.max("ts")).scalar()
    return events.where(F.col("ts") >= latest - F.make_interval(hours=F.lit(hours)))


def with_category(events: DataFrame, policy_rows: DataFrame) -> DataFrame:
    """Adds the category of each event's entity; ``other`` for unknown ones. A policy is a few rows by nature."""
    names = policy_rows.select("entity_type", "category").distinct()
    return events.join(F.broadcast(names), "entity_type", "left").withColumn("category", F.coalesce("category", F.lit("other")))


def latest_flags(flags: DataFrame, *key: str) -> DataFrame:
    """The latest verdict for each key (default: event and reviewer); later rows win, which is what an upsert means."""
    key = key or ("event_id", "flagged_by")
    order = [F.desc("created_at")] + ([F.desc("flagged_by")] if "flagged_by" not in key else []) + [F.desc("verdict")]
    w = Window.partitionBy(*key).orderBy(*order)
    return flags.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def upsert_flag(flags: DataFrame, new: DataFrame) -> DataFrame:
    """Verdicts with new ones taking the place of older ones by (event_id, flagged_by)."""
    return latest_flags(flags.unionByName(new))


def with_flags(events: DataFrame, flags: DataFrame) -> DataFrame:
    """Events with their latest verdict, null for none."""
    last = latest_flags(flags, "event_id").select(F.col("event_id").alias("id"), "verdict", "flagged_by", "note")
    return events.join(last, "id", "left")
