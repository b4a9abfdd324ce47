"""Answers from server-sent events over micro-batches against the batch parser."""

from __future__ import annotations

import json
import random

import pytest

from sitara.operators.conversations import parse_stream
from sitara.streaming import answers as a

SCHEMA = "request_id string, seq long, body binary"


def _frame(content) -> str:
    return f"data: {json.dumps({'choices': [{'delta': {'content': content}}]}, ensure_ascii=False)}\n\n"


WHOLE = {
    "r1": _frame("Hel") + _frame("lo é") + ": comment\n\n" + _frame(None) + "data: {broken\n\n" + _frame(" مرحبا 😀") + "data: [DONE]\n\n" + _frame("late"),
    "r2": _frame("data: x\ny") + "data: {}\n\n" + _frame("z") + "data: [DONE]",
    "r3": _frame("no end") + _frame("tail")[:-2],
}


def test_frames_cut_at_every_byte():
    for text in WHOLE.values():
        whole = text.encode()
        deltas, rest, ended = a.frames(b"", whole)
        for at in range(len(whole) + 1):
            one, tail, over = a.frames(b"", whole[:at])
            two, tail2, over2 = ([], b"", True) if over else a.frames(tail, whole[at:])
            assert (one + two, over2) == (deltas, ended) and (over or tail2 == rest)


def _run(spark, tmp_path, batches, idle_ms, wait=()):
    """Each list of rows is a micro-batch; the query stops and starts again between them."""
    import time

    src = tmp_path / "in"
    a.use_rocksdb(spark)
    out = []
    for k, rows in enumerate(batches):
        if k in wait:
            time.sleep(idle_ms / 1000 + 1)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = a.answers(spark.readStream.schema(SCHEMA).parquet(str(src)), idle_ms)
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    return out


def test_micro_batches_give_the_batch_result(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for r in ("r1", "r2"):
        whole = WHOLE[r].encode()
        cuts = sorted({0, len(whole), *rng.sample(range(len(whole)), 25)})
        rows += [(r, i, whole[lo:hi]) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rng.shuffle(rows)
    batches = [rows[:20], rows[20:35] + rows[:5], rows[35:], [("r1", 60, b"after"), (None, 0, b"x")]]
    got = _run(spark, tmp_path, batches, 600_000)
    bodies = spark.createDataFrame([(r, 0, t) for r, t in WHOLE.items() if r != "r3"], "request_id string, seq int, body string")
    assert sorted(got) == sorted((r.request_id, r.text, True) for r in parse_stream(bodies).collect())


def test_idle_answers_come_out_unfinished(spark, tmp_path):
    whole = WHOLE["r3"].encode()
    got = _run(spark, tmp_path, [[("r3", 0, whole[:9])], [("r3", 1, whole[9:])], [("r4", 0, b"data: [DONE]\n\n")]], 3_000, wait=(2,))
    assert sorted(got) == [("r3", "no endtail", False), ("r4", "", True)]


def test_a_state_store_is_asked_for(spark):
    spark.conf.set(a.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="RocksDB"):
        a.answers(spark.createDataFrame([], SCHEMA))
