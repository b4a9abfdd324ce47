"""Versioned tables, the audit log in them, and the cache of detections."""

from __future__ import annotations

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitara.operators import audit
from sitara.operators.cache import detect_cached, open_cache
from sitara.operators.detect import detect
from sitara.plans.queries import only
from sitara.sources import audit_log
from sitara.sources.versioned import Conflict, Table

SCHEMA = "k string, v long"
DAY = datetime(2026, 3, 1)


def _t(spark, tmp_path, **more):
    return Table(spark, str(tmp_path / "t"), SCHEMA, "k", **more)


def _rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def _all(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_stay_readable(spark, tmp_path):
    t = _t(spark, tmp_path)
    assert t.read().count() == 0 and t.version().number == 0
    t.append(_rows(spark, ("a", 1), ("b", 2), (None, 3)))
    first = t.version()
    t.upsert(_rows(spark, ("a", 10), ("c", 4), (None, 30)))
    t.delete(_rows(spark, ("b", 0)))
    assert _all(t.read()) == [("a", 10), ("c", 4), (None, 30)] and _all(t.read(first)) == [("a", 1), ("b", 2), (None, 3)]
    t.vacuum(keep=1)
    assert _all(t.read()) == [("a", 10), ("c", 4), (None, 30)] and t.numbers() == [t.version().number]
    t.append(_rows(spark))
    assert t.read().count() == 3


def test_upsert_leaves_other_clusters_alone(spark, tmp_path):
    t = _t(spark, tmp_path, clusters=8)
    t.append(spark.range(200).select(F.col("id").cast("string").alias("k"), "id"). toDF("k", "v"))
    t.compact()
    before = set(t.read().inputFiles())
    t.upsert(_rows(spark, ("7", -7)))
    after = set(t.read().inputFiles())
    assert len(before - after) == len(after - before) == 1
    assert t.read().where("v = -7").count() == 1 and t.read().count() == 200


def test_writers_race(spark, tmp_path):
    """Upserts of one key's cluster and appends at once: none is lost, and every version is whole."""
    t = _t(spark, tmp_path, clusters=2)
    t.append(_rows(spark, ("x", 0)))
    t.compact()
    failed = []

    def work(n):
        try:
            own = Table(spark, str(tmp_path / "t"), SCHEMA, "k", clusters=2)
            for i in range(2):
                own.upsert(_rows(spark, (f"w{n}-{i}", n)))
            own.append(_rows(spark, (f"a{n}", n)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    for x in threads:
        x.start()
    seen = []
    while any(x.is_alive() for x in threads):
        v = t.version()
        seen.append((v.number, t.read(v).count(), sum(p.rows for p in v.parts if p.clusters is None)))
    for x in threads:
        x.join()
    assert not failed
    assert sorted(r.k for r in t.read().collect()) == sorted(["x", *[f"a{n}" for n in range(3)], *[f"w{n}-{i}" for n in range(3) for i in range(2)]])
    assert [c for _, c, _ in sorted(seen)] == sorted(c for _, c, _ in seen)


def test_a_manifest_is_written_once(spark, tmp_path):
    t = _t(spark, tmp_path)
    assert t.files.create_once(f"{t.path}/_versions/x", "a") and not t.files.create_once(f"{t.path}/_versions/x", "b")
    assert t.files.read(f"{t.path}/_versions/x") == "a" and t.files.names(f"{t.path}/_versions") == ["x"]


def test_conflict_is_told(spark, tmp_path, monkeypatch):
    t = _t(spark, tmp_path)
    monkeypatch.setattr(t.files, "create_once", lambda at, text: False)
    with pytest.raises(Conflict):
        t.append(_rows(spark, ("a", 1)))


def test_a_batch_is_written_once(spark, tmp_path):
    """A batch that fails after its append, before its checkpoint, comes again and is passed over."""
    t = _t(spark, tmp_path)
    assert t.append(_rows(spark, ("a", 1)), ("stream", 0))
    assert not t.append(_rows(spark, ("a", 1)), ("stream", 0))
    assert t.append(_rows(spark, ("a", 1)), ("other", 0)) and t.append(_rows(spark, ("b", 1)), ("stream", 1))
    t.compact()
    assert not t.append(_rows(spark, ("b", 1)), ("stream", 1))
    assert _all(t.read()) == [("a", 1), ("a", 1), ("b", 1)]


def _events(spark, n, days=5, values=40):
    names = [x.split()[0] for x in audit.EVENT_SCHEMA.split(", ")]
    made = {"id": F.md5(F.col("id").cast("string")), "ts": F.timestamp_seconds(F.lit(1_772_323_200) + F.col("id") * int(days * 86_400 / n)), "user_id": F.concat(F.lit("u"), (F.col("id") % 7).cast("string")), "value_fp": F.concat(F.lit("fp"), (F.col("id") % values).cast("string")), "action": F.lit("MASK"), "entity_type": F.lit("EMAIL_ADDRESS")}
    kinds = dict(x.rsplit(" ", 1) for x in audit.EVENT_SCHEMA.split(", "))
    return spark.range(n).select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names])


def _scanned(df):
    """Rows that the scan of a plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    log = audit_log.open_log(spark, str(tmp_path_factory.mktemp("log") / "audit"), clusters=20)
    events = _events(spark, 2000)
    for k in range(4):
        log.append(events.where(F.pmod(F.xxhash64("id"), F.lit(4)) == k))
    log.compact()
    return log


def test_a_pivot_opens_one_cluster(spark, log):
    every, events = log.read().inputFiles(), _events(spark, 2000)
    assert len(every) >= 60
    found = audit_log.find(log, audit.Filters(value_fp="fp3"))
    assert len(found.inputFiles()) <= 5 < len(every) / 10
    assert audit.fingerprint_summary(found, "fp3").first() == audit.fingerprint_summary(events, "fp3").first()
    day = audit_log.find(log, audit.Filters(value_fp="fp3", since=DAY + timedelta(days=1), until=DAY + timedelta(days=1, hours=23)))
    assert len(day.inputFiles()) == 1 and day.count() == events.where("value_fp = 'fp3' and ts between '2026-03-02' and '2026-03-02 23:00:00'").count()


def test_bloom_filters_pass_over_other_ids(spark, log):
    there = _events(spark, 2000).first()
    assert audit_log.event(log, there.id).count() == 1
    assert 0 < _scanned(audit_log.event(log, there.id)) < 200
    # An id between the least and the most of every file.
    assert _scanned(audit_log.event(log, there.id[:-1] + "~")) < 200


def test_pages_by_token(spark, tmp_path):
    log = audit_log.open_log(spark, str(tmp_path / "audit"), clusters=2)
    log.append(_events(spark, 900, days=10))
    log.compact()
    log.append(_events(spark, 30, days=1).withColumn("ts", F.lit("2026-03-05 12:00:00").cast("timestamp")).withColumn("id", F.concat("id", F.lit("x"))))
    token_version = log.version().number
    want = [r.id for r in log.read().orderBy(F.desc("ts"), F.desc("id")).collect()]
    got, files, token = [], [], None
    while True:
        page, token = audit_log.seek(log, 100, token)
        got += [r.id for r in page.collect()]
        files.append(len(page.inputFiles()))
        if len(got) == 200:
            log.append(_events(spark, 10))  # a walk goes on in its version
        if token is None:
            break
    assert got == want and max(files) <= files[0] + 6 < len(log.read(log.version(token_version)).inputFiles()) / 2
    late, _ = audit_log.seek(log, 5, filters=audit.Filters(user_id="u3"))
    assert [r.user_id for r in late.collect()] == ["u3"] * 5


def test_flags_through_the_table(spark, tmp_path):
    flags = audit_log.open_flags(spark, str(tmp_path / "flags"))
    row = lambda e, v, by, h: (e, v, by, None, DAY + timedelta(hours=h))
    put = lambda *rows: audit_log.flag(flags, spark.createDataFrame(list(rows), audit_log.FLAG_SCHEMA))
    put(row("e1", "confirmed", "ann", 1), row("e2", "confirmed", "ann", 1), row("e2", "false_positive", "bob", 2))
    put(row("e1", "false_positive", "ann", 3), row("e1", "confirmed", "ann", 2))
    assert {(r.event_id, r.flagged_by): r.verdict for r in flags.read().collect()} == {("e1", "ann"): "false_positive", ("e2", "ann"): "confirmed", ("e2", "bob"): "false_positive"}


def test_cached_detection(spark, tmp_path, monkeypatch):
    from sitara.operators import cache as cached

    seen = []
    monkeypatch.setattr(cached, "detect", lambda rows, *a, **b: (seen.append(rows.count()), detect(rows, *a, **b))[1])
    cache = open_cache(spark, str(tmp_path / "cache"), clusters=4)
    texts = spark.createDataFrame([(1, "mail a@b.com now"), (2, "nothing"), (3, None), (4, "mail a@b.com now")], "n int, text string")
    p = only("EMAIL_ADDRESS")
    want = {r.n: r.spans for r in detect(texts, p).collect()}
    for _ in range(2):
        assert {r.n: r.spans for r in detect_cached(texts, p, cache).collect()} == want
    assert seen == [3, 0]
    detect_cached(texts, only("CREDIT_CARD"), cache)
    assert seen == [3, 0, 3]
    assert {r.lang for r in detect_cached(texts, p, cache).collect()} == {"en"}
    assert "a@b.com" not in str(cache.read().collect())


def test_the_stream_writes_each_batch_once(spark, tmp_path):
    """The process dies after a batch's append and before its checkpoint: the batch comes again, also from the spill, and is written once."""
    from sitara.plans.queries import PEPPER
    from sitara.streaming import audit_stream as st

    src, schema = str(tmp_path / "in"), "request_id string, text_index int, text string"
    spark.createDataFrame([("r1", 0, "mail a@b.com"), ("r2", 0, "c@d.org and e@f.net")], schema).write.parquet(src)
    log = audit_log.open_log(spark, str(tmp_path / "audit"), clusters=4)
    sink = st.AuditSink(spark, log, st.Spill(spark, str(tmp_path / "spill")))
    policy = lambda: only("EMAIL_ADDRESS")

    def dies(events, batch):
        sink._append(events, batch)
        raise SystemError("lost")

    broken = st.AuditSink(spark, log, sink.spill)
    broken.write = dies
    for s in (broken, sink, sink):
        q = st.start(st.source(spark, src, schema), policy, PEPPER, s, str(tmp_path / "ck"), once=True)
        try:
            q.awaitTermination(120)
        except Exception as e:  # noqa: BLE001
            assert s is broken and "lost" in str(e)
    assert log.read().count() == 3 == log.read().select("id").distinct().count()
    events = log.read()
    with_batch = ("query", 5)
    sink.spill.append(events, with_batch)
    (segment,) = sink.spill.segments()
    (folder,) = sink.spill.batches(segment)
    assert log.append(sink.spill.read(folder), sink.spill.batch(folder))
    assert sink.replay() == 0 and sink.spill.segments() == [] and log.read().count() == 6
    assert st.health(sink)["readable"]


def test_distinct_events_of_a_stream(spark, tmp_path):
    from sitara.streaming import audit_stream as st

    rows = spark.createDataFrame([("a", DAY), ("a", DAY + timedelta(minutes=5)), ("b", DAY)], "id string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    out = []
    q = st.distinct_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda df, _: out.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
    q.awaitTermination(60)
    assert sorted(out) == ["a", "b"]


def test_search_by_trigrams(spark, tmp_path):
    """The rows of a scan of everything, from fewer files; also of loose rows and of parts that are not indexed yet."""
    log, grams = audit_log.open_log(spark, str(tmp_path / "audit"), clusters=10), audit_log.open_grams(spark, str(tmp_path / "grams"), clusters=4)
    events = _events(spark, 600, days=3).withColumn("request_id", F.concat(F.lit("Req-"), F.abs(F.hash("id")).cast("string")))
    log.append(events)
    log.compact()
    assert audit_log.index_grams(log, grams) == 3 and audit_log.index_grams(log, grams) == 0
    every = log.read()
    wanted = every.select("request_id").first().request_id[2:].upper()
    ids = lambda df: sorted(r.id for r in df.collect())
    for term in (wanted, "zzz", "u3", "_%", "req-"):
        f = audit.Filters(search=term)
        assert ids(audit_log.search(log, grams, f)) == ids(f.apply(every)), term
    assert len(audit_log.search(log, grams, audit.Filters(search=wanted)).inputFiles()) <= 3 < len(every.inputFiles())
    log.append(events.limit(5).withColumn("user_id", F.lit("ZZZ top")))
    assert audit_log.search(log, grams, audit.Filters(search="zzz t")).count() == 5
    log.compact()
    assert audit_log.search(log, grams, audit.Filters(search="zzz t")).count() == 5
    audit_log.index_grams(log, grams)
    found = audit_log.search(log, grams, audit.Filters(search="zzz t"))
    assert found.count() == 5 and len(found.inputFiles()) <= 5
