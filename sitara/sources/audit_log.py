"""The audit log as a versioned table: look-ups by value, id and page open the files that matter.

Appends of a stream carry its batch number, so a batch that comes again after
a failure is not written twice. Rows of a day are clustered by a hash of
``value_fp``; ids, requests and fingerprints have Bloom filters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.operators.audit import EVENT_COLUMNS, EVENT_SCHEMA, PAGE, PAGE_MOST, Filters
from sitara.sources.versioned import CLUSTERS, Part, Table, Version, _iso

BLOOM = ("value_fp", "id", "request_id")
#: Columns that a free-text search looks at, and what the index of their trigrams holds: where a trigram occurs.
IDENTITIES = ("user_id", "key_alias", "end_user_id", "request_id")
GRAM_SCHEMA = "gram string, part string, place int"
FLAG_SCHEMA = "event_id string, verdict string, flagged_by string, note string, created_at timestamp"


def open_log(spark: SparkSession, path: str, clusters: int = CLUSTERS) -> Table:
    return Table(spark, path, EVENT_SCHEMA, key="value_fp", time="ts", bloom=BLOOM, clusters=clusters)


def open_flags(spark: SparkSession, path: str, clusters: int = 16) -> Table:
    """Verdicts of reviewers, one for each event and reviewer."""
    return Table(spark, path, FLAG_SCHEMA, key="event_id", bloom=("event_id",), clusters=clusters)


def flag(flags: Table, new: DataFrame) -> Version:
    """Verdicts go in the place of older ones of the same event and reviewer; of several new ones the latest holds."""
    return flags.upsert(new, ["event_id", "flagged_by"], [F.desc("created_at"), F.desc("verdict")])


def find(log: Table, filters: Filters, version: Version | None = None) -> DataFrame:
    """Events that pass the filters, from files that can hold such: of the days, and for a value of its cluster."""
    return filters.apply(log.read(version, filters.value_fp, filters.since, filters.until))


def event(log: Table, id_: str) -> DataFrame:
    """An event by its id: Bloom filters let the scan pass over all row groups without it."""
    return log.read().where(F.col("id") == id_)


@dataclass(frozen=True)
class Token:
    """Where a page ended: the next one begins after it. It names the version, so a walk over pages sees one version."""

    ts: datetime
    id: str
    version: int


def _first_parts(parts: tuple[Part, ...], ts: str | None, limit: int) -> list[Part]:
    """Parts that hold the ``limit`` latest rows before a time (null: of all), by their numbers of rows and their times.

    Rows of parts that lie whole before ``ts`` and after all parts left out
    are sure to come first; as soon as these are enough, no more parts are needed.
    """
    late = sorted((p for p in parts if p.least is not None and (ts is None or p.least <= ts)), key=lambda p: p.most, reverse=True)
    for k in range(1, len(late)):
        rest = late[k].most
        if sum(p.rows for p in late[:k] if p.least > rest and (ts is None or p.most < ts)) >= limit:
            return late[:k]
    return late


def seek(log: Table, limit: int = PAGE, after: Token | None = None, filters: Filters | None = None) -> tuple[DataFrame, Token | None]:
    """A page of events, latest first, and the token of the next page (null after the last).

    Without filters a page opens the parts that its rows can lie in, however
    deep it is. With filters all parts up to the token's time are looked at.
    """
    if not 1 <= limit <= PAGE_MOST:
        raise ValueError(f"limit must be within 1 and {PAGE_MOST}")
    version = log.version(after.version if after else None)
    parts = version.parts if filters else tuple(_first_parts(version.parts, _iso(after.ts) if after else None, limit + 1))
    rows = find(log, filters or Filters(), Version(version.number, parts))
    if after:
        rows = rows.where((F.col("ts") < F.lit(after.ts)) | ((F.col("ts") == F.lit(after.ts)) & (F.col("id") < after.id)))
    page = rows.where("ts IS NOT NULL").select(*EVENT_COLUMNS).orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    last = page.select("ts", "id").collect()
    more = Token(last[-1].ts, last[-1].id, version.number) if len(last) == limit else None
    return page, more


def open_grams(spark: SparkSession, path: str, clusters: int = CLUSTERS) -> Table:
    """An index of the trigrams of identities, for free-text search."""
    return Table(spark, path, GRAM_SCHEMA, key="gram", bloom=("gram",), clusters=clusters)


def _name(log: Table, part: Part) -> str:
    return part.path.removeprefix(f"{log.path}/data/")


def _indexed(grams: Table) -> set[str]:
    """Names of the parts in the index: each has a row of the empty trigram."""
    return {r.part for r in grams.read(key="").where("gram = ''").select("part").distinct().collect()}


def index_grams(log: Table, grams: Table) -> int:
    """Adds the log's clustered parts that the index lacks; how many. Loose parts are few and are searched without it."""
    have = _indexed(grams)
    new = [p for p in log.version().parts if p.clusters is not None and _name(log, p) not in have]
    if new:
        # A part is a folder of a day, its clusters are folders in it.
        at = F.split(F.col("_metadata.file_path"), "/")
        rows = log._frame([f for p in new for f in p.folders()])
        placed = rows.select(*IDENTITIES, F.concat_ws("/", F.element_at(at, -4), F.element_at(at, -3)).alias("part"), F.regexp_extract(F.element_at(at, -2), "[0-9]+", 0).cast("int").alias("place"))
        of = lambda v: F.when(F.char_length(v) >= 3, F.transform(F.sequence(F.lit(1), F.char_length(v) - 2), lambda i: F.substring(v, i, 3))).otherwise(F.array().cast("array<string>"))
        found = F.array_distinct(F.concat(F.array(F.lit("")), *[of(F.lower(F.coalesce(c, F.lit("")))) for c in IDENTITIES]))
        grams.append(placed.select(F.explode(found).alias("gram"), "part", "place").distinct())
        grams.compact()
    return len(new)


def search(log: Table, grams: Table, filters: Filters) -> DataFrame:
    """``find`` by a free text, from clusters that hold all its trigrams, loose parts, and parts that the index lacks.

    Texts of fewer than three characters have no trigram: all files are looked at.
    """
    version, term = log.version(), filters.search or ""
    folded = log.spark.range(1).select(F.lower(F.lit(term))).first()[0]
    wanted = sorted({folded[i : i + 3] for i in range(len(folded) - 2)})
    if not wanted:
        return find(log, filters, version)
    hits = None
    for g in wanted:
        own = grams.read(key=g).where(F.col("gram") == g)
        hits = own if hits is None else hits.unionByName(own)
    # A row for each folder at most.
    at: dict[str, set[int]] = {}
    for r in hits.distinct().groupBy("part", "place").count().where(F.col("count") == len(wanted)).collect():
        at.setdefault(r.part, set()).add(r.place)
    have, parts = _indexed(grams), []
    for p in version.parts:
        if p.clusters is None or _name(log, p) not in have:
            parts.append(p)
        elif left := tuple(c for c in p.clusters if c in at.get(_name(log, p), ())):
            parts.append(replace(p, clusters=left))
    return find(log, filters, Version(version.number, tuple(parts)))
