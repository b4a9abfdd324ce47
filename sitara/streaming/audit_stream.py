"""Streaming audit: texts in, audit rows out, with spill and replay.

Every micro-batch detects, masks and appends audit rows. If the table cannot
be written the rows go to numbered JSON segments; ``replay`` appends these,
oldest first, and deletes a segment only after its rows are in the table.

Into a plain folder delivery is at least once, and ``distinct_events`` drops
repeats by id. Into a versioned table it is exactly once: an append carries
the query and the number of its batch, or the segment's name, and the table passes
over one that it has.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitara.operators import audit, prepare
from sitara.operators.detect import detect
from sitara.sources.policy import Policy
from sitara.sources.versioned import Files, Table

SEGMENTS = 8
#: Files that one micro-batch takes at most; the rest waits for the next.
BATCH_FILES = 200
INTERVAL = "1 second"
log = logging.getLogger(__name__)


@dataclass
class Stats:
    written: int = 0
    spilled: int = 0
    dropped: int = 0
    replayed: int = 0
    failures: int = 0


#: Bytes from which on a segment takes no more batches.
SEGMENT_BYTES = 16 << 20


class Spill:
    """Segments of spilled batches: numbered folders, in each a folder of JSON lines for every batch.

    A segment takes batches until it has ``roll`` bytes; beyond ``most`` segments
    the oldest go. Beside its rows a batch has an index: whose it is, and how
    many rows, so what was dropped or waits is counted without reading rows.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = SEGMENTS, roll: int = SEGMENT_BYTES) -> None:
        self.spark, self.folder, self.most, self.roll = spark, folder.rstrip("/"), most, roll
        self.files = Files(spark, self.folder)

    def segments(self) -> list[str]:
        """Oldest first."""
        return sorted(f"{self.files.root}/{n}" for n in self.files.names(self.folder) if n.startswith("audit-"))

    def batches(self, segment: str) -> list[str]:
        """Folders of a segment's batches, oldest first."""
        return sorted(f"{segment}/{n}" for n in self.files.names(segment) if n.startswith("batch-"))

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds a batch to the last segment, or to a new one if that is full; gives the number of rows in old segments dropped."""
        have = self.segments()
        if have and self.files.length(have[-1]) < self.roll:
            segment = have[-1]
        else:
            segment = f"{self.files.root}/audit-{int(have[-1].rsplit('-', 1)[1]) + 1 if have else 0:08d}"
        at = f"{segment}/batch-{len(self.files.names(segment)):06d}-{uuid.uuid4().hex}"
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(at)
        self.files.create_once(f"{at}/_index.json", json.dumps({"writer": list(batch) if batch else [f"batch {at}", 0], "rows": seen.get["n"]}))
        lost = 0
        for old in self.segments()[: -self.most]:
            lost += self.rows(old)
            self.discard(old)
        return lost

    def index(self, batch: str) -> dict:
        """Of a batch whose writer died before its index: its rows are counted by reading them."""
        if "_index.json" not in self.files.names(batch):
            return {"writer": [f"batch {batch}", 0], "rows": self.read(batch).count()}
        return json.loads(self.files.read(f"{batch}/_index.json"))

    def rows(self, segment: str) -> int:
        return sum(self.index(b)["rows"] for b in self.batches(segment))

    def read(self, folder: str) -> DataFrame:
        """The rows of a segment or a batch; blank and corrupt lines are passed over."""
        return self.spark.read.schema(audit.EVENT_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(folder)

    def corrupt(self, folder: str) -> int:
        kinds = f"{audit.EVENT_SCHEMA}, broken string"
        parsed = F.from_json("value", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
        return self.spark.read.option("recursiveFileLookup", "true").text(folder).where(F.trim("value") != "").where(parsed["broken"].isNotNull()).count()

    def batch(self, folder: str) -> tuple[str, int]:
        """The writer that a replayed batch counts as: one of its own, named by the batch it holds."""
        query, n = self.index(folder)["writer"]
        return (f"spilled {query} {n}", 0)

    def pending(self) -> int:
        return sum(self.rows(s) for s in self.segments())

    def discard(self, folder: str) -> None:
        self.files.delete(folder)


class AuditSink:
    """What ``foreachBatch`` calls. ``append`` writes events; tests give one that fails.

    ``table`` is a folder, or a versioned table, which takes each batch once.
    """

    def __init__(self, spark: SparkSession, table: str | Table, spill: Spill, append: Callable[[DataFrame], None] | None = None) -> None:
        self.table, self.spill, self.stats = table, spill, Stats()
        self.append = append

    def _append(self, rows: DataFrame, batch: tuple[str, int] | None) -> bool:
        """Whether the rows were written; False for a batch that the table has."""
        if self.append is not None:
            self.append(rows)
        elif isinstance(self.table, Table):
            return self.table.append(rows, batch)
        else:
            rows.write.mode("append").parquet(self.table)
        return True

    def write(self, events: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """``batch``: the query and the number of the batch."""
        events = events.persist()
        try:
            n = events.count()
            try:
                self.stats.written += n if self._append(events, batch) else 0
            except Exception as e:  # fail open: the text path must not stop for the audit
                log.warning("audit append failed: %s", type(e).__name__)
                self.stats.failures += 1
                self.stats.dropped += self.spill.append(events, batch)
                self.stats.spilled += n
        finally:
            events.unpersist()

    def replay(self) -> int:
        """Appends spilled batches, oldest first; stops at the first failure, which keeps its batch and all after it."""
        done = 0
        try:
            for segment in self.spill.segments():
                for folder in self.spill.batches(segment):
                    # A batch that was appended but not deleted is known by its name.
                    n = self.spill.index(folder)["rows"]
                    done += n if self._append(self.spill.read(folder), self.spill.batch(folder)) else 0
                    self.spill.discard(folder)
                self.spill.discard(segment)
        except Exception as e:
            log.warning("audit replay stopped: %s", type(e).__name__)
            self.stats.failures += 1
        self.stats.replayed += done
        return done


def source(spark: SparkSession, folder: str, schema: str, files: int = BATCH_FILES) -> DataFrame:
    """A stream of the Parquet files of a folder, so many a micro-batch at most: a backlog is worked off in bounded steps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def start(texts: DataFrame, policy: Callable[[], Policy], pepper: bytes, sink: AuditSink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream over a streaming DataFrame of texts. The policy is asked for anew with each micro-batch, so changes hold from the next on."""

    def batch(rows: DataFrame, n: int) -> None:
        p = policy()
        sink.write(audit.to_events(prepare.prepare(detect(rows, p), p, pepper), batch=f"{checkpoint} {n}"), (checkpoint, n))
        sink.replay()

    w = texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=INTERVAL)).start()


def distinct_events(events: DataFrame) -> DataFrame:
    """Events once each, for readers of an at-least-once table."""
    return events.dropDuplicates(["id"])


def distinct_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, for streaming readers of an at-least-once folder; ids are forgotten when the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def settled(drafts: DataFrame, by: str = "conv_id", gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last text (columns ``by``, ts, text) before each pause of ``gap``: what is worth scanning while someone types."""
    w = drafts.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by)
    return w.agg(F.max(F.struct("ts", "text")).alias("last")).select(by, F.col("last.ts").alias("ts"), F.col("last.text").alias("text"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Streaming timeline: tumbling hours by entity, closed when the watermark has passed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "entity_type")
    return w.agg(F.count("*").alias("events"), F.count_if(F.col("action") == "BLOCK").alias("blocked")).select(F.col("w.start").alias("bucket"), "entity_type", "events", "blocked")


def drain(query: StreamingQuery, sink: AuditSink, seconds: float = 5.0) -> Stats:
    """Stops a stream: waits some seconds for what is under way, then replays what was spilled. Unread input stays for the next start, by the checkpoint; unwritten rows stay spilled."""
    until = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.05)
    query.stop()
    sink.replay()
    return sink.stats


def health(sink: AuditSink, query: StreamingQuery | None = None) -> dict[str, object]:
    """Counters of a sink, rows that wait in its spill, and whether its table can be read and its stream runs."""
    spark = sink.spill.spark
    try:
        sink.table.version() if isinstance(sink.table, Table) else spark.read.parquet(sink.table).schema
        readable = True
    except Exception as e:
        log.warning("audit table cannot be read: %s", type(e).__name__)
        readable = False
    return {**asdict(sink.stats), "pending": sink.spill.pending(), "readable": readable, "running": bool(query and query.isActive)}


def write_status(spark: SparkSession, path: str, stats: Stats) -> None:
    """A status marker that readers never see half written, on any of Spark's file systems."""
    jvm = spark.sparkContext._jvm
    target, rough = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if "://" in path else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    fs = rough.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(rough, True)
    out.write(bytearray(json.dumps(asdict(stats)).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(rough, target, options)


class RedactText(logging.Filter):
    """Keeps texts and values out of logs: named extras are replaced, long messages cut."""

    KEYS = frozenset(("text", "texts", "value", "masked", "message_text", "content", "spans"))

    def filter(self, record: logging.LogRecord) -> bool:
        for key in self.KEYS & set(record.__dict__):
            setattr(record, key, "[redacted]")
        record.msg = str(record.msg)[:500]
        return True
