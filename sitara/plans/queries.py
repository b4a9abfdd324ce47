"""The registered queries over the reference tables, and DuckDB SQL for those that SQL can express.

Personal values never leave a query: rows carry lengths, hashes, fingerprints
or the masked text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.functions import validators as v
from sitara.functions.text import dominant_script, fold, script_segments
from sitara.operators import audit, cache, evaluate, prepare
from sitara.operators.detect import deconflict_rows, detect
from sitara.sources import audit_log as logs
from sitara.sources import synthetic
from sitara.sources.policy import Policy, Preview, baseline
from sitara.sources.versioned import Table, scratch

#: For tests and examples only.
PEPPER = b"0123456789abcdef0123456789abcdef"
_TODAY = "2026-09-19"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer pieces than there are cores are dealt out, as scanning them is what takes time."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "conversations") and df.rdd.getNumPartitions() < cores else df


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to three tasks a core by their key: texts are made of them, and a small file, or one of few row groups, would be one task's."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def today() -> Column:
    return F.to_date(F.lit(_TODAY))


def only(*names: str) -> Policy:
    p = baseline()
    return Policy({n: p.entities[n] for n in names}, p.gazetteer)


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def _exploded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.explode_outer("spans").alias("s")).where(F.col("s").isNotNull())


# --- texts ---------------------------------------------------------------------

_EMAIL = r"[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
_RUNS = "[0-9]+"
_LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN CASE WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END ELSE d[i]::INT END)) % 10 = 0"


def _placed(pattern: str) -> str:
    """SQL: every match of a pattern in documents, with the code points before it."""
    return f"""(SELECT doc_id, source, ms[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS start
  FROM (SELECT doc_id, source, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gaps FROM documents)))"""


_CARDS = f"SELECT doc_id, source, m AS digits, start FROM {_placed(_RUNS)} WHERE length(m) BETWEEN 13 AND 19 AND m[1] <> '0'"
_LUHN_CARDS = f"SELECT doc_id, source, digits, start FROM (SELECT *, string_split(digits, '') AS d FROM ({_CARDS})) WHERE {_LUHN}"


@query(f"SELECT doc_id, start, length(m)::INT AS value_len, md5(m) AS value_md5 FROM {_placed(_EMAIL)}")
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of every document."""
    found = detect(table(spark, sf_dir, "documents"), only("EMAIL_ADDRESS"))
    return _exploded(found).select("doc_id", "s.start", F.char_length("s.value").alias("value_len"), F.md5("s.value").alias("value_md5"))


@query(f"SELECT doc_id, start, length(digits)::INT AS n_digits, md5(digits) AS value_md5 FROM ({_LUHN_CARDS})")
def card_spans_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 13 to 19 digits that pass Luhn's check."""
    found = detect(table(spark, sf_dir, "documents"), only("CREDIT_CARD"))
    bare = v.digits(F.col("s.value"))
    return _exploded(found).select("doc_id", "s.start", F.length(bare).alias("n_digits"), F.md5(bare).alias("value_md5"))


@query(
    f"""SELECT source, entity_type, count(*) AS n FROM (
  SELECT source, 'EMAIL_ADDRESS' AS entity_type FROM (SELECT source, unnest(regexp_extract_all(text, '{_EMAIL}')) FROM documents)
  UNION ALL SELECT source, 'CREDIT_CARD' FROM ({_LUHN_CARDS})) GROUP BY source, entity_type"""
)
def pii_summary_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by source and entity."""
    p = only("EMAIL_ADDRESS", "CREDIT_CARD")
    return prepare.entity_totals(prepare.prepare(detect(table(spark, sf_dir, "documents"), p), p, PEPPER), "source")


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g')) AS masked_md5, len(regexp_extract_all(text, '{_EMAIL}'))::INT AS n_spans FROM documents")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its e-mail addresses masked."""
    p = only("EMAIL_ADDRESS")
    out = prepare.prepare(detect(table(spark, sf_dir, "documents"), p), p, PEPPER)
    return out.select("doc_id", F.md5("masked").alias("masked_md5"), F.size("spans").alias("n_spans"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g')) AS masked_md5 FROM documents")
def masking_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking what is masked already changes nothing."""
    p = only("EMAIL_ADDRESS")
    once = prepare.prepare(detect(table(spark, sf_dir, "documents"), p), p, PEPPER).select("doc_id", F.col("masked").alias("text"))
    return prepare.prepare(detect(once, p), p, PEPPER).select("doc_id", F.md5("masked").alias("masked_md5"))


_DETECTED = f"""(SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, 'email' AS recognizer, start, m, trim(regexp_replace(lower(m), '[^0-9a-z]+', ' ', 'g')) AS form, NULL::VARCHAR AS preview FROM {_placed(_EMAIL)}
  UNION ALL SELECT doc_id, 'CREDIT_CARD', 'card', start, digits, digits, repeat('*', length(digits) - 4) || substr(digits, length(digits) - 3) FROM ({_LUHN_CARDS}))"""


def _sql_hmac(message: str) -> str:
    inner, outer = (bytes(b ^ x for b in PEPPER.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query(
    f"""SELECT 'doc-' || doc_id AS request_id, entity_type, recognizer, 1.0::DOUBLE AS score, 'MASK' AS action, start AS span_start, CAST(start + length(m) AS INT) AS span_end, CAST(length(m) AS INT) AS value_len,
  substr({_sql_hmac("form")}, 1, 16) AS value_fp, preview, 'en' AS lang FROM {_DETECTED}"""
)
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recognizers over all documents: audit rows without values."""
    p = baseline()
    texts = table(spark, sf_dir, "documents").withColumns({"request_id": F.concat(F.lit("doc-"), "doc_id"), "text_index": F.lit(0)})
    events = audit.to_events(prepare.prepare(detect(texts, p, today()), p, PEPPER), ts=F.lit("2026-09-19 00:00:00").cast("timestamp"))
    return events.select("request_id", "entity_type", "recognizer", "score", "action", "span_start", "span_end", "value_len", "value_fp", "preview", "lang")


@query(
    """SELECT doc_id, (letters > 0 AND arabic * 5 >= letters) AS is_arabic, CASE WHEN letters = 0 THEN 0 ELSE 1 END::INT AS n_segments FROM (
  SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{Arabic}]', '', 'g')) AS arabic FROM documents)"""
)
def segment_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script of each document and the number of its script runs (the test documents have Latin letters only)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (dominant_script(F.col("text")) == "arabic").alias("is_arabic"), F.size(script_segments(F.col("text"))).alias("n_segments"))


# --- audit log -------------------------------------------------------------------

_AUDIT = """(SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type AS entity_type, CASE WHEN event_type = 'error' THEN 'BLOCK' ELSE 'MASK' END AS action,
  value AS score, substr(sha256(props), 1, 16) AS value_fp, 'req-' || CAST(event_id // 10 AS VARCHAR) AS request_id FROM events)"""


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an audit log."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("entity_type"),
        F.when(F.col("event_type") == "error", "BLOCK").otherwise("MASK").alias("action"), F.col("value").alias("score"),
        F.substring(F.sha2(F.col("props"), 256), 1, 16).alias("value_fp"), F.concat(F.lit("req-"), F.expr("event_id div 10")).alias("request_id"),
    )


def _timeline(unit: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.timeline(audit_log(spark, sf_dir), unit).withColumn("bucket", epoch(F.col("bucket")))

    run.__name__ = f"timeline_{unit}"
    run.__doc__ = f"Events by {unit} and entity."
    query(f"SELECT epoch(date_trunc('{unit}', ts))::BIGINT AS bucket, entity_type, count(*) AS events, count(*) FILTER (action = 'BLOCK') AS blocked FROM {_AUDIT} GROUP BY ALL")(run)


for _unit in ("minute", "hour", "day"):
    _timeline(_unit)


@query(f"SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT value_fp) AS values, count(*) FILTER (action = 'BLOCK') AS blocked, count(*) FILTER (action = 'MASK') AS masked FROM {_AUDIT}")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the log."""
    return audit.summary(audit_log(spark, sf_dir))


@query(f"SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS at, user_id, entity_type, action FROM {_AUDIT} WHERE action = 'BLOCK' ORDER BY ts DESC, id DESC LIMIT 200 OFFSET 20")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of blocked events."""
    return audit.page(audit.Filters(actions=("BLOCK",)).apply(audit_log(spark, sf_dir)), 200, 20).select("id", epoch(F.col("ts")).alias("at"), "user_id", "entity_type", "action")


@query(f"SELECT count(*) AS n FROM {_AUDIT} WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12' AND entity_type IN ('view', 'click')")
def count_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two entities in a week."""
    from datetime import datetime

    f = audit.Filters(since=datetime(2024, 1, 5), until=datetime(2024, 1, 12), entity_types=("view", "click"))
    return f.apply(audit_log(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"SELECT id, request_id FROM {_AUDIT} WHERE request_id ILIKE '%REQ-12%' OR user_id ILIKE '%REQ-12%'")
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text search over identities."""
    return audit.Filters(search="REQ-12").apply(audit_log(spark, sf_dir)).select("id", "request_id")


_SOME_FP = f"(SELECT value_fp FROM {_AUDIT} GROUP BY value_fp ORDER BY count(*) DESC, value_fp LIMIT 1)"


def _some_fp(log: DataFrame) -> str:
    return log.groupBy("value_fp").count().orderBy(F.desc("count"), "value_fp").first()["value_fp"]


@query(f"SELECT count(*) AS occurrences, count(DISTINCT user_id) AS users, count(DISTINCT request_id) AS requests, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_seen, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen FROM {_AUDIT} WHERE value_fp = {_SOME_FP}")
def pivot_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the most frequent value."""
    log = audit_log(spark, sf_dir)
    out = audit.fingerprint_summary(log, _some_fp(log))
    return out.withColumns({c: epoch(F.col(c)) for c in ("first_seen", "last_seen")})


@query(f"SELECT user_id, count(*) AS occurrences, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen FROM {_AUDIT} WHERE value_fp = {_SOME_FP} GROUP BY user_id ORDER BY occurrences DESC, user_id NULLS LAST LIMIT 50")
def pivot_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who sent it."""
    log = audit_log(spark, sf_dir)
    return audit.fingerprint_users(log, _some_fp(log)).withColumn("last_seen", epoch(F.col("last_seen")))


def _written_log(spark: SparkSession, sf_dir: str) -> Table:
    """The audit log as a versioned table: three appends, of which two are in clusters and one is loose."""
    events = audit_log(spark, sf_dir)
    kinds = dict(x.rsplit(" ", 1) for x in audit.EVENT_SCHEMA.split(", "))
    whole = events.select(*[(F.col(c) if c in events.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    log = logs.open_log(spark, scratch(spark, "log"), clusters=16)
    for k in range(3):
        log.append(whole.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k), ("query", k))
        if k == 1:
            log.compact()
    return log


@query(f"SELECT count(*) AS occurrences, count(DISTINCT user_id) AS users, count(DISTINCT request_id) AS requests, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_seen, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen FROM {_AUDIT} WHERE value_fp = {_SOME_FP}")
def log_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the most frequent value, from the log's files of its cluster."""
    log = _written_log(spark, sf_dir)
    fp = _some_fp(log.read())
    out = audit.fingerprint_summary(logs.find(log, audit.Filters(value_fp=fp)), fp)
    return out.withColumns({c: epoch(F.col(c)) for c in ("first_seen", "last_seen")})


@query(f"SELECT id::VARCHAR AS id, request_id FROM {_AUDIT} WHERE request_id ILIKE '%REQ-12%' OR user_id ILIKE '%REQ-12%'")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text search over the written log, by the trigrams of its clustered parts."""
    log, grams = _written_log(spark, sf_dir), logs.open_grams(spark, scratch(spark, "grams"), clusters=16)
    logs.index_grams(log, grams)
    return logs.search(log, grams, audit.Filters(search="REQ-12")).select("id", "request_id")


@query(f"SELECT id::VARCHAR AS id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM {_AUDIT} ORDER BY ts DESC, id::VARCHAR DESC LIMIT 150 OFFSET 300")
def log_seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the log, by tokens."""
    log, token = _written_log(spark, sf_dir), None
    for _ in range(3):
        page, token = logs.seek(log, 150, token)
    return page.select("id", epoch(F.col("ts")).alias("at"))


@query("SELECT DISTINCT 'e' || doc_id AS event_id, CASE WHEN doc_id % 3 = 0 THEN 'false_positive' ELSE 'confirmed' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS day FROM labels WHERE doc_id % 7 <> 0")
def log_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts through a versioned table: written, a third of them replaced, a seventh deleted."""
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    event = F.concat(F.lit("e"), F.col("doc_id").cast("string"))
    rows = lambda d, verdict, day: d.select(event.alias("event_id"), F.lit(verdict).alias("verdict"), F.lit("ann").alias("flagged_by"), F.lit(None).cast("string").alias("note"), F.lit(f"2026-01-0{day}").cast("timestamp").alias("created_at"))
    flags = logs.open_flags(spark, scratch(spark, "flags"))
    logs.flag(flags, rows(ids, "confirmed", 1))
    logs.flag(flags, rows(ids.where("doc_id % 3 = 0"), "confirmed", 1).unionByName(rows(ids.where("doc_id % 3 = 0"), "false_positive", 2)))
    flags.delete(ids.where("doc_id % 7 = 0").select(event.alias("event_id")))
    return flags.read().select("event_id", "verdict", F.dayofmonth("created_at").alias("day"))


@query(f"SELECT doc_id, start, length(m)::INT AS value_len, md5(m) AS value_md5 FROM {_placed(_EMAIL)}")
def cached_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of every document, all from the cache: a first pass over those of even number and a second over all have filled it."""
    docs, p = table(spark, sf_dir, "documents"), only("EMAIL_ADDRESS")
    kept = cache.open_cache(spark, scratch(spark, "cache"), clusters=16)
    for rows in (docs.where("doc_id % 2 = 0"), docs):
        cache.detect_cached(rows, p, kept)
    found = cache.detect_cached(docs, p, kept)
    return _exploded(found).select("doc_id", "s.start", F.char_length("s.value").alias("value_len"), F.md5("s.value").alias("value_md5"))


@query(f"SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM {_AUDIT} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of the log."""
    return audit.recent(audit_log(spark, sf_dir)).select("id", epoch(F.col("ts")).alias("at"))


@query(
    "SELECT d.doc_id AS id, CASE WHEN f.toxic IS NULL THEN NULL WHEN f.toxic = 1 THEN 'confirmed' ELSE 'false_positive' END AS verdict "
    "FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) f USING (doc_id)"
)
def flags_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer verdicts: an older one of a second reviewer gives way to the latest."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    new = labels.select(F.col("doc_id").alias("event_id"), F.when(F.col("toxic") == 1, "confirmed").otherwise("false_positive").alias("verdict"), F.lit(1).alias("flagged_by"), F.lit(None).cast("string").alias("note"), F.lit("2026-01-02").cast("timestamp").alias("created_at"))
    old = new.withColumns({"verdict": F.lit("confirmed"), "flagged_by": F.lit(2), "created_at": F.lit("2026-01-01").cast("timestamp")})
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return audit.with_flags(docs, audit.upsert_flag(old, new)).select("id", "verdict")


@query(f"SELECT CASE entity_type WHEN 'view' THEN 'contact' WHEN 'click' THEN 'contact' WHEN 'purchase' THEN 'finance' ELSE 'other' END AS category, count(*) AS n FROM {_AUDIT} GROUP BY 1")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by category; unknown entities are other."""
    names = spark.createDataFrame([("view", "contact"), ("click", "contact"), ("purchase", "finance")], "entity_type string, category string")
    return audit.with_category(audit_log(spark, sf_dir), names).groupBy("category").agg(F.count("*").alias("n"))


# --- identifiers from keys ---------------------------------------------------------

_N = "c_custkey"
_BIRTH = f"(DATE '1960-01-01' + CAST({_N} * 37 % 15000 AS INT))"
_GOVS = ", ".join(f"'{c}'" for c in list(v.GOVERNORATES)[:27])


def _sql_stem(shift: int) -> str:
    return f"(CASE WHEN year({_BIRTH}) < 2000 THEN '2' ELSE '3' END || strftime({_BIRTH}, '%y%m%d') || [{_GOVS}][{_N} % 27 + 1] || lpad(CAST(({_N} + {shift}) % 10000 AS VARCHAR), 4, '0'))"


def _sql_check(stem: str) -> str:
    total = " + ".join(f"CAST(substr({stem}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(v.NID_WEIGHTS))
    return f"((11 - ({total}) % 11) % 11)"


_NID = f"(SELECT c_custkey, CASE WHEN {_sql_check('a')} <> 10 THEN a || CAST({_sql_check('a')} AS VARCHAR) WHEN {_sql_check('b')} <> 10 THEN b || CAST({_sql_check('b')} AS VARCHAR) END AS nid FROM (SELECT c_custkey, {_sql_stem(0)} AS a, {_sql_stem(1)} AS b FROM customer))"
_BENT = f"(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN substr(nid, 1, 13) || CAST((CAST(substr(nid, 14, 1) AS INT) + 1) % 10 AS VARCHAR) WHEN c_custkey % 7 = 0 THEN substr(nid, 1, 3) || '13' || substr(nid, 6) ELSE nid END AS nid FROM {_NID})"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    birth = F.date_add(F.lit("1960-01-01").cast("date"), F.pmod(F.col("c_custkey") * 37, F.lit(15_000)).cast("int"))
    return c.withColumn("nid", synthetic.national_id(F.col("c_custkey"), birth))


@query(
    f"""SELECT c_custkey, strftime(born, '%Y-%m-%d') AS born, substr(nid, 8, 2) AS governorate, substr(nid, 10, 4) AS serial, CAST(substr(nid, 13, 1) AS INT) % 2 = 0 AS female,
  {_sql_check("nid")} = CAST(substr(nid, 14, 1) AS INT) AS checksum_ok FROM (
    SELECT *, try_strptime(CASE substr(nid, 1, 1) WHEN '2' THEN '19' ELSE '20' END || substr(nid, 2, 6), '%Y%m%d') AS born FROM {_BENT}) WHERE born IS NOT NULL"""
)
def nid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National ids of customers, some with a wrong check digit or month."""
    n, k = F.col("nid"), F.col("c_custkey")
    last = F.pmod(F.substring(n, 14, 1).cast("int") + 1, F.lit(10)).cast("string")
    bent = F.when(k % 5 == 0, F.concat(F.substring(n, 1, 13), last)).when(k % 7 == 0, F.concat(F.substring(n, 1, 3), F.lit("13"), F.substring(n, 6, 9))).otherwise(n)
    ids = _ids(spark, sf_dir).withColumn("nid", bent)
    p = ids.select("c_custkey", v.parse_nid(F.col("nid"), today()).alias("p")).where("p is not null")
    return p.select("c_custkey", F.date_format("p.birth_date", "yyyy-MM-dd").alias("born"), F.col("p.governorate_code").alias("governorate"), "p.serial", "p.female", "p.checksum_ok")


@query(f"SELECT c_custkey, length(nid)::INT AS n, {_sql_check('nid')} AS check_digit FROM {_NID}")
def nid_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits of synthetic national ids."""
    return _ids(spark, sf_dir).select("c_custkey", F.length("nid").alias("n"), v.nid_check_digit(F.col("nid")).alias("check_digit"))


_MOBILE = "(SELECT c_custkey, ['010', '011', '012', '015'][c_custkey % 4 + 1] || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS m FROM customer)"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE '+2' || m END AS e164 FROM {_MOBILE}")
def mobile_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile numbers in six forms, one of them wrong."""
    k = F.col("c_custkey")
    m = synthetic.mobile(k)
    local = F.substring(m, 2, 10)
    forms = [m, F.concat(F.lit("+20"), local), F.concat(F.lit("0020"), local), F.concat_ws("-", F.substring(m, 1, 3), F.substring(m, 4, 4), F.substring(m, 8, 4)), F.concat(F.lit("20 "), local), F.concat(F.lit("013"), F.substring(m, 4, 8))]
    form = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", v.mobile_e164(form).alias("e164"))


_BBAN = "lpad(CAST(c_custkey * 104729 AS VARCHAR), 25, '0')"


@query(f"SELECT c_custkey, lpad(CAST(98 - (CAST({_BBAN} || '141600' AS HUGEINT) % 97) AS VARCHAR), 2, '0') AS check_digits, c_custkey % 3 <> 0 AS valid FROM customer")
def iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IBANs with check digits; every third with one digit changed."""
    k = F.col("c_custkey")
    iban = synthetic.iban(k)
    last = F.pmod(F.substring(iban, 29, 1).cast("int") + 1, F.lit(10)).cast("string")
    bent = F.when(k % 3 == 0, F.concat(F.substring(iban, 1, 28), last)).otherwise(iban)
    return table(spark, sf_dir, "customer").select("c_custkey", F.substring(iban, 3, 2).alias("check_digits"), v.eg_iban_valid(bent).alias("valid"))


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS plausible FROM customer")
def tax_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax ids; every fourth of nine equal digits."""
    k = F.col("c_custkey")
    value = F.when(k % 4 == 0, F.repeat(F.pmod(k, F.lit(10)).cast("string"), F.lit(9))).otherwise(synthetic.tax_id(k))
    return table(spark, sf_dir, "customer").select("c_custkey", v.tax_id_plausible(value).alias("plausible"))


@query(f"SELECT c_custkey, substr({_sql_hmac('lower(regexp_replace(c_name, ' + chr(39) + '[^0-9A-Za-z]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '))')}, 1, 16) AS fp FROM customer")
def fingerprint_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed fingerprints of customers' names."""
    return table(spark, sf_dir, "customer").select("c_custkey", prepare.fingerprint(F.lit("PERSON"), F.col("c_name"), PEPPER).alias("fp"))


@query(f"SELECT c_custkey, substr(nid, 1, 4) || '******' || substr(nid, 11, 4) AS nid, repeat('*', 7) || substr(nid, 11, 4) AS tail, NULL::VARCHAR AS short FROM (SELECT c_custkey, substr(nid, 1, 14) AS nid FROM {_NID})".replace("repeat('*', 7)", "repeat('*', 10)"))
def preview_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of national ids, and of a value too short to have one."""
    n = F.col("nid")
    two = Preview("first_last", 4, 4)
    return _ids(spark, sf_dir).select("c_custkey", prepare.preview(n, two.mode, two.first, two.last).alias("nid"), prepare.preview(n, "last", 0, 4).alias("tail"), prepare.preview(F.substring(n, 1, 8), "first_last", 4, 4).alias("short"))


_POOL = ("John Doe", "Jane Roe", "Sam Poe", "Alex Coe", "Chris Loe")
_FP = "substr(sha256(c_name), 1, 16)"


@query(
    f"""SELECT c_custkey, [{", ".join(f"'{p}'" for p in _POOL)}][CAST(('0x' || fp)::UBIGINT % 5 AS INT) + 1] AS surrogate, '<PERSON:' || substr(fp, 1, 8) || '>' AS labelled, '<PERSON>' AS placeholder, '' AS redacted
  FROM (SELECT c_custkey, {_FP} AS fp FROM customer)"""
)
def replacement_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strategies write for a value."""
    fp = F.substring(F.sha2("c_name", 256), 1, 16)
    r = lambda s, pool=(): prepare.replacement(fp, "<PERSON>", s, None, pool)
    return table(spark, sf_dir, "customer").select("c_custkey", r("surrogate", _POOL).alias("surrogate"), r("labelled_fingerprint").alias("labelled"), r("placeholder").alias("placeholder"), r("redact").alias("redacted"))


_SPANS = """(SELECT l_orderkey AS text_id, CAST(l_partkey % 40 AS INT) AS start, CAST(l_partkey % 40 + 1 + l_suppkey % 25 AS INT) AS "end", l_discount AS score,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS specificity, l_returnflag || CAST(l_linenumber AS VARCHAR) AS entity_type FROM lineitem)"""


@query(
    f"""SELECT text_id, start, "end", score, specificity, entity_type FROM (
  SELECT *, max("end") OVER (PARTITION BY text_id ORDER BY start, "end" DESC, score DESC, specificity DESC, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {_SPANS})
  WHERE reached IS NULL OR reached < "end" """
)
def deconflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contained spans go; spans made from line items."""
    li = table(spark, sf_dir, "lineitem")
    start = F.pmod("l_partkey", F.lit(40)).cast("int")
    spans = li.select(F.col("l_orderkey").alias("text_id"), start.alias("start"), (start + 1 + F.pmod("l_suppkey", F.lit(25))).cast("int").alias("end"), F.col("l_discount").alias("score"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0).alias("specificity"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("entity_type"))
    return deconflict_rows(spans, "text_id")


# --- evaluation ---------------------------------------------------------------------


@query(
    """SELECT event_type AS variant, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INT) + 1] AS p95, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INT) + 1] AS p50
  FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)"""
)
def quantile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), "value")
    return evaluate.nearest_rank(e, "variant", "value", {"p95": 0.95, "p50": 0.5})


def _shape(kind: str, entities: tuple[str, ...]) -> str:
    names = ", ".join(f"'{e}'" for e in entities)
    return f"SELECT '{kind}' AS corpus, [{names}][CAST(CAST('0x' || substr(md5('7 {kind} ' || i), 1, 8) AS BIGINT) % {len(entities)} AS INT) + 1] AS entity_type FROM (SELECT c_custkey AS i FROM customer)"


# What the sentence shapes of each corpus hold, in their order; without context the general IBAN is surer. In long texts context comes from neighbours, so both count as one.
_SHAPES = " UNION ALL ".join(_shape(k, e) for k, e in {"arabic": ("EG_NATIONAL_ID", "EG_MOBILE", "EG_ADDRESS", "EG_IBAN"), "latin": ("EG_MOBILE", "EG_NATIONAL_ID", "IBAN_CODE", "EG_TAX_ID"), "mixed": ("EG_MOBILE", "EG_NATIONAL_ID", "EG_IBAN")}.items())


@query(f"WITH s AS ({_SHAPES}) SELECT corpus, entity_type, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'long', replace(entity_type, 'IBAN_CODE', 'EG_IBAN'), count(*) FROM s GROUP BY 2")
def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection over the corpora made for all customers, Arabic digits included: spans by corpus and entity."""
    p = baseline()
    texts = synthetic.corpus(dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id"))
    found = prepare.findings(prepare.prepare(detect(texts, p, today()), p, PEPPER), "corpus")
    entity = F.when(F.col("corpus") == "long", F.replace("entity_type", F.lit("IBAN_CODE"), F.lit("EG_IBAN"))).otherwise(F.col("entity_type"))
    return found.groupBy("corpus", entity.alias("entity_type")).agg(F.count("*").alias("n"))


def _share(k: int) -> str:
    """SQL: the share that synthetic rows draw by an event's id."""
    return f"CAST('0x' || substr(md5('7 audit {k} ' || event_id), 1, 8) AS BIGINT) / 4294967296.0"


def _by_weight() -> str:
    upto, cases = 0, []
    for name, w in reversed(synthetic.WEIGHTS.items()):
        upto += w
        cases.append(f"WHEN {_share(1)} < {upto} / {sum(synthetic.WEIGHTS.values())}.0 THEN '{name}'")
    return f"CASE {' '.join(cases)} END"


@query(
    f"""SELECT entity_type, user_id, count(*) AS n, count(DISTINCT request_id) AS requests, CAST(epoch(max(ts)) AS BIGINT) AS last_seen FROM (
  SELECT {_by_weight()} AS entity_type, 'user-' || CAST(floor({_share(2)} * 40) AS BIGINT) AS user_id, 'req-' || event_id AS request_id, TIMESTAMP '2026-09-19 12:00:00' - to_seconds(CAST(floor({_share(4)} * 1209600) AS BIGINT)) AS ts FROM events
  UNION ALL SELECT 'EG_NATIONAL_ID', 'user-7', 'paste-' || (i // 20), TIMESTAMP '2026-09-19 12:00:00' FROM range(60) AS t(i)
  UNION ALL SELECT 'EG_MOBILE', 'user-' || i, 'shared-' || i, TIMESTAMP '2026-09-19 12:00:00' - to_hours(i) FROM range(40) AS t(i)) GROUP BY ALL"""
)
def synthetic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic audit rows of all events' ids, by entity and user."""
    rows = synthetic.audit_rows(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))
    by = rows.groupBy("entity_type", "user_id").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("requests"), F.max("ts").alias("last_seen"))
    return by.withColumn("last_seen", epoch(F.col("last_seen")))


@query("SELECT doc_id, lower(translate(source, 'آأإٱةىیک', 'ااااهييك')) AS folded FROM documents")
def fold_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer fold of a column, native."""
    return table(spark, sf_dir, "documents").select("doc_id", fold(F.col("source")).alias("folded"))
