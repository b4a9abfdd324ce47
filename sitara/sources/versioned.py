"""Tables of Parquet folders with versions, for upserts, exactly-once appends and look-ups that open few files.

A version is a small JSON manifest that names the table's parts. A writer
writes its Parquet files first, then publishes the next manifest under a name
that must not exist yet; if another writer was first, it looks at that version
and tries again. Readers take one manifest, so they see one version whole.

Rows come in as loose parts, one for each append. ``compact`` deals them to
clusters, folders of a day and a hash of the key, with Parquet Bloom filters
on the columns that look-ups name. ``upsert`` rewrites only the clusters that
hold its keys. A manifest has a line for each loose part and each clustered day,
not for each file.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Clusters of a day (or of the whole table, where it has no time).
CLUSTERS = 64
#: Parts of a day that are left side by side before a compaction joins them.
SIDE_BY_SIDE = 4
TRIES = 50
#: Writers whose last batches a manifest remembers.
WRITERS = 256


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


@dataclass(frozen=True)
class Part:
    """A folder of rows. ``clusters`` (null: loose rows) are those of its folders that count; times are ISO texts."""

    path: str
    rows: int
    least: str | None = None
    most: str | None = None
    clusters: tuple[int, ...] | None = None
    day: str | None = None

    def folders(self, clusters: set[int] | None = None) -> list[str]:
        if self.clusters is None:
            return [self.path]
        return [f"{self.path}/cluster={c}" for c in self.clusters if clusters is None or c in clusters]


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[Part, ...] = ()
    #: The last batch of each writer that counts its batches.
    done: dict[str, int] = field(default_factory=dict)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share; where all is one process, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sitara-")
    return f"{root.rstrip('/')}/sitara-tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


class Files:
    """What a table needs of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self._path(root)).toString()

    def _path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def length(self, folder: str) -> int:
        """Bytes of all files below a folder."""
        return self.fs.getContentSummary(self._path(folder)).getLength()

    def read(self, at: str) -> str:
        stream = self.fs.open(self._path(at))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_once(self, at: str, text: str) -> bool:
        """Writes a file whole, if there is none of its name; else False.

        Takes a file system whose rename does not overwrite; local disks, whose
        rename does, have links instead.
        """
        folder, name = at.rsplit("/", 1)
        rough = f"{folder}/_{uuid.uuid4().hex}"
        out = self.fs.create(self._path(rough), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                local = lambda p: self._path(p).toUri().getPath()
                try:
                    os.link(local(rough), local(at))
                except FileExistsError:
                    return False
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(at).toUri(), self.conf)
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            try:
                context.rename(self._path(rough), self._path(at), options)
            except Py4JJavaError as e:
                if "FileAlreadyExists" in e.java_exception.getClass().getName():
                    return False
                raise
            return True
        finally:
            self.delete(rough)

    def delete(self, at: str) -> None:
        self.fs.delete(self._path(at), True)


class Table:
    """A versioned table.

    ``key``: the column whose hash is a row's cluster. ``time``: a timestamp by
    which parts are known and clusters are kept by day. ``bloom``: columns with
    Bloom filters. Rows of a null key are a cluster of their own hash.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str, time: str | None = None, bloom: tuple[str, ...] = (), clusters: int = CLUSTERS) -> None:
        self.spark, self.key, self.time, self.bloom, self.n = spark, key, time, bloom, clusters
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if taken := {"day", "cluster"} & {f.name.lower() for f in self.schema.fields}:
            raise ValueError(f"names of folders cannot be columns: {sorted(taken)}")
        self.files = Files(spark, path)
        self.path = self.files.root

    # --- versions

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        return sorted(int(n[:12]) for n in self.files.names(f"{self.path}/_versions") if re.fullmatch(r"\d{12}\.json", n))

    def version(self, number: int | None = None) -> Version:
        """A version; the latest by default, an empty one for a new table."""
        if number is None:
            have = self.numbers()
            if not have:
                return Version()
            number = have[-1]
        got = json.loads(self.files.read(self._manifest(number)))
        parts = tuple(Part(**{**p, "clusters": None if p["clusters"] is None else tuple(p["clusters"])}) for p in got["parts"])
        return Version(number, parts, got["done"])

    def _publish(self, change: Callable[[Version], Version | None]) -> Version:
        """Publishes ``change`` of the latest version; asks anew if another writer was first. None: there is nothing to do."""
        for _ in range(TRIES):
            now = self.version()
            new = change(now)
            if new is None:
                return now
            new = replace(new, number=now.number + 1)
            if self.files.create_once(self._manifest(new.number), json.dumps({"parts": [asdict(p) for p in new.parts], "done": new.done})):
                return new
        raise Conflict(f"{TRIES} versions of others came first")

    # --- reading

    def cluster_of(self, value: object) -> int:
        kind = self.schema[self.key].dataType
        one = self.spark.createDataFrame([(value,)], T.StructType([T.StructField(self.key, kind)]))
        return one.select(self._cluster()).first()[0]

    def _cluster(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n)).cast("int")

    def _frame(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: Version | None = None, key: object = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Rows of a version. ``key``, ``since`` and ``until`` leave out files without such rows; all other rows of a file stay, so filter too."""
        version = version or self.version()
        clusters = None if key is None else {self.cluster_of(key)}
        lo, hi = (None if t is None else _iso(t) for t in (since, until))
        parts = [p for p in version.parts if not ((lo and p.most and p.most < lo) or (hi and p.least and p.least > hi))]
        return self._frame([f for p in parts for f in p.folders(clusters)])

    # --- writing

    def _writer(self, rows: DataFrame):
        w = rows.write
        for c in self.bloom:
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "100000")
        return w

    def _fit(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _loose(self, rows: DataFrame) -> Part:
        seen = Observation()
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        times = [F.min(self.time).alias("least"), F.max(self.time).alias("most")] if self.time else []
        self._writer(self._fit(rows).observe(seen, F.count(F.lit(1)).alias("n"), *times)).parquet(at)
        got = seen.get
        return Part(at, got["n"], _iso(got.get("least")), _iso(got.get("most")))

    def _clustered(self, rows: DataFrame) -> list[Part]:
        """Writes rows to folders of clusters, by day if there is a time; a large cluster is split over tasks by adaptive execution."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        day = F.coalesce(F.to_date(F.col(self.time)).cast("string"), F.lit("none")) if self.time else F.lit("all")
        names = ["day", "cluster"]
        dealt = self._fit(rows).withColumns({"day": day, "cluster": self._cluster()})
        order = [self.key, *([self.time] if self.time else [])]
        self._writer(dealt.hint("rebalance", *names).sortWithinPartitions(*names, *order)).partitionBy(*names).parquet(at)
        times = [F.min(self.time).alias("least"), F.max(self.time).alias("most")] if self.time else [F.lit(None).alias("least"), F.lit(None).alias("most")]
        whole = T.StructType([*self.schema.fields, T.StructField("day", T.StringType()), T.StructField("cluster", T.IntegerType())])
        written = self.spark.read.schema(whole).parquet(at)
        # A row for each day.
        found = written.groupBy("day").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("cluster")).alias("clusters"), *times).collect()
        return [Part(f"{at}/day={r.day}", r.n, _iso(r.least), _iso(r.most), tuple(r.clusters), r.day) for r in sorted(found, key=lambda r: r.day)]

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds rows. A batch (its writer's name and number) that is in the table, or an earlier one, is not written again: False."""
        past = lambda v: batch is not None and v.done.get(batch[0], -1) >= batch[1]
        if past(self.version()):
            return False
        part = self._loose(rows)
        added = []

        def change(now: Version) -> Version | None:
            added[:] = [not past(now)]
            if past(now):
                return None
            # A writer's entry moves to the end; those that were silent longest go.
            done = {k: n for k, n in now.done.items() if batch is None or k != batch[0]} | ({batch[0]: batch[1]} if batch else {})
            return Version(parts=(*now.parts, part) if part.rows else now.parts, done=dict(list(done.items())[-WRITERS:]))

        self._publish(change)
        if not added[0]:
            self.files.delete(part.path)
        return added[0]

    def compact(self, side_by_side: int = SIDE_BY_SIDE) -> Version:
        """Loose rows go to their clusters; days with several clustered parts are joined once they have ``side_by_side``."""
        for _ in range(TRIES):
            now = self.version()
            loose = [p for p in now.parts if p.clusters is None]
            days: dict[str | None, list[Part]] = {}
            for p in now.parts:
                if p.clusters is not None:
                    days.setdefault(p.day, []).append(p)
            many = [p for own in days.values() if len(own) >= side_by_side for p in own]
            old = loose + many
            if not old:
                return now
            new = self._clustered(self._frame([f for p in old for f in p.folders()]))
            if (done := self._swap(old, new)) is not None:
                return done
        raise Conflict("compaction never came first")

    def _swap(self, old: list[Part], new: list[Part]) -> Version | None:
        """Publishes new parts in the place of old ones; None, and new ones deleted, if an old one is gone meanwhile."""
        gone = []

        def change(now: Version) -> Version | None:
            gone[:] = [not set(old) <= set(now.parts)]
            return None if gone[0] else Version(parts=(*[p for p in now.parts if p not in set(old)], *new), done=now.done)

        done = self._publish(change)
        if gone[0]:
            for p in new:
                self.files.delete(p.path.rsplit("/", 1)[0])
            return None
        return done

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Version:
        """Replaces the rows of all clusters that hold one of ``keys`` by ``change`` of them; ``change`` must leave other keys' rows alone.

        If another writer changes one of these clusters meanwhile, the work is done anew on what that one wrote.
        """
        touched = {r[0] for r in keys.select(self._cluster()).distinct().collect()}
        for _ in range(TRIES):
            if any(p.clusters is None for p in self.version().parts):
                self.compact()
            now = self.version()
            own = [p for p in now.parts if p.clusters is not None and touched & set(p.clusters)]
            new = self._clustered(change(self._frame([f for p in own for f in p.folders(touched)])))
            # Rows of other clusters stay where they are.
            rest = [replace(p, clusters=left) for p in own if (left := tuple(c for c in p.clusters if c not in touched))]
            fresh = []

            def publish(latest: Version, own=own, rest=rest, new=new, fresh=fresh) -> Version | None:
                same = {p for p in latest.parts if p.clusters is None or touched & set(p.clusters)} == set(own)
                fresh[:] = [same]
                return Version(parts=(*[p for p in latest.parts if p not in set(own)], *rest, *new), done=latest.done) if same else None

            done = self._publish(publish)
            if fresh[0]:
                return done
            for p in new:
                self.files.delete(p.path.rsplit("/", 1)[0])
        raise Conflict("others changed these keys again and again")

    def upsert(self, new: DataFrame, by: list[str] | None = None, latest: list | None = None) -> Version:
        """``new`` rows take the place of those with equal ``by`` columns (the key among them; default: the key). Of several new rows the first by ``latest`` holds."""
        by = by or [self.key]
        new = self._fit(new)
        if latest:
            new = new.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*latest))).where("__nth = 1").drop("__nth")
        return self.rewrite(new, lambda old: _without(old, new, by).unionByName(new))

    def delete(self, keys: DataFrame, by: list[str] | None = None) -> Version:
        by = by or [self.key]
        return self.rewrite(keys, lambda old: _without(old, keys, by))

    def vacuum(self, keep: int = 10) -> int:
        """Deletes manifests before the last ``keep`` ones, and folders that no kept one names; how many folders.

        Folders of writers that have not published yet count as unnamed: run it when none writes.
        """
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.files.delete(self._manifest(n))
        named = {p.path.removeprefix(f"{self.path}/data/").split("/")[0] for n in numbers[-keep:] for p in self.version(n).parts}
        unnamed = [d for d in self.files.names(f"{self.path}/data") if d not in named]
        for d in unnamed:
            self.files.delete(f"{self.path}/data/{d}")
        return len(unnamed)


def _without(rows: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` columns, nulls equal, are those of none of ``others``."""
    names = {c: f"__{c}" for c in by}
    keys = others.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return rows.join(keys, same, "left_anti")


def _iso(t: datetime | None) -> str | None:
    return None if t is None else t.isoformat(timespec="microseconds")
