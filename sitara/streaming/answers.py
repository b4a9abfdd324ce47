"""Server-sent events as a stream: bodies as the network cut them in, whole answers out.

State of a request: the bytes of a frame that has not ended yet, what was said
so far, bodies that came before their turn. An answer comes out at ``[DONE]``, or
with ``done`` false when nothing came for ``idle_ms``. Pieces of an answer are
a list in the state, so a micro-batch adds to it without reading it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUT = "request_id string, text string, done boolean"
IDLE_MS = 60_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_END, _HEAD, _DONE = b"\n\n", b"data: ", b"[DONE]"


def said(frame: bytes) -> str | None:
    """The delta of a frame; null for other frames and bad JSON."""
    if not frame.startswith(_HEAD):
        return None
    try:
        delta = json.loads(frame[len(_HEAD) :].decode())["choices"][0]["delta"]["content"]
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    return delta if delta is None or isinstance(delta, str) else json.dumps(delta)


def frames(tail: bytes, body: bytes) -> tuple[list[str], bytes, bool]:
    """Deltas of the frames that end with ``body``, the bytes of the one that has not, and whether the answer ended."""
    *whole, tail = (tail + body).split(_END)
    out = []
    for frame in whole:
        if frame.startswith(_HEAD) and frame[len(_HEAD) :].strip() == _DONE:
            return out, b"", True
        if (delta := said(frame)) is not None:
            out.append(delta)
    # Nothing can follow the mark in its frame.
    return out, tail, tail.startswith(_HEAD) and tail[len(_HEAD) :].strip() == _DONE


class Answers(StatefulProcessor):
    """Bodies of a request in the order of their numbers, from 0; one that came already is passed over, as is all after the end."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, ended boolean, tail binary")
        self.early = handle.getMapState("early", "seq long", "body binary")
        self.pieces = handle.getListState("pieces", "piece string")

    def _whole(self) -> str:
        return "".join(p[0] for p in self.pieces.get())

    def _timer(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        nth, ended, tail = self.at.get() if self.at.exists() else (0, False, b"")
        was_over, new = ended, []

        def take(body) -> None:
            nonlocal nth, tail, ended
            nth += 1
            deltas, tail, ended = frames(bytes(tail), bytes(body or b""))
            new.extend(deltas)

        for r in rows:
            if ended or r.seq is None or r.seq < nth:
                continue
            if r.seq > nth:
                self.early.updateValue((r.seq,), (r.body,))
                continue
            take(r.body)
            while not ended and self.early.exists() and self.early.containsKey((nth,)):
                (body,), seq = self.early.getValue((nth,)), nth
                self.early.removeKey((seq,))
                take(body)
        if new:
            self.pieces.appendValue(("".join(new),))
        self.at.update((nth, ended, bytes(tail)))
        if ended and not was_over:
            yield Row(request_id=key[0], text=self._whole(), done=True)
            self.pieces.clear()
            self.early.clear()
        # Kept for a while after the end too, so that what comes late is known to be late.
        self._timer(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, ended, tail = self.at.get() if self.at.exists() else (0, True, b"")
        if not ended:
            yield Row(request_id=key[0], text=self._whole() + (said(bytes(tail)) or ""), done=False)
        for s in (self.at, self.early, self.pieces):
            s.clear()

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that ``answers`` needs; for streams that start from now on."""
    spark.conf.set(PROVIDER, ROCKSDB)


def answers(chunks: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Whole answers (request_id, text, done) of a stream of bodies (request_id, seq from 0, body as text or bytes)."""
    if chunks.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}, or call use_rocksdb")
    rows = chunks.where("request_id IS NOT NULL").select("request_id", F.col("seq").cast("long").alias("seq"), F.col("body").cast("binary").alias("body"))
    return rows.groupBy("request_id").transformWithState(statefulProcessor=Answers(idle_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
