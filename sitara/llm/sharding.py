"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows of each source are put in a seeded random order; the fractional rank
(rank + 1/2) / rows of the source spreads every source evenly over [0, 1);
all rows are sorted by it and cut into runs of equal length. Any stretch of
that order, and so every shard, holds each source in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitara.llm.common import BROADCAST_BYTES, bucket_starts, join_groups, materialize, pick_columns, ranked, shuffle_partitions, source_key, spread_rank

SHARDS = 24
SEED = 20240229


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every row: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: the row counts of shards differ by one at most, and
    so does each source's share of a shard from its share of all rows, up to
    one row. Slots count from 0 without gaps. ``grown_shard`` is null, as
    only the law ``key`` defines it.

    Null doc_id, text or source are values like others (a null text has 8
    bytes and the checksum of the empty text; null is a source of its own).
    Rows that agree in all these columns are interchangeable. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    pick_columns(docs, "doc_id", "text", "source")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        source_key(F.col("source")).alias("src"),
    )
    rows = materialize(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32")), "shard-rows")
    total = rows.count()
    by_source = rows.groupBy("src").agg(F.count("*").alias("n"))
    placed = spread_rank(rows, by_source, ["src"], "h", ["doc_id", "size", "text_crc32"], total)
    cells = 8 * shuffle_partitions(spark)
    at = (F.col("rank") + F.lit(0.5)) / F.col("n")
    placed = materialize(placed.withColumn("at", at).withColumn("cell", F.floor(F.col("at") * cells)).drop("rank", "n"), "shard-ranks")
    starts = bucket_starts(placed.groupBy("cell").agg(F.count("*").alias("cell_n")).withColumn("all", F.lit(0)), ["all"], "cell", "cell_n", "cell_start")
    order = [F.col(c) for c in ("at", "src", "h", "doc_id", "size", "text_crc32")]
    placed = ranked(join_groups(placed, starts.select("cell", "cell_start"), ["cell"], F.col("h"), 64 * cells <= BROADCAST_BYTES), ["cell"], order, "place")
    placed = placed.withColumn("place", F.col("place") + F.col("cell_start")).withColumn("shard", F.expr(f"place * {shards}L div {max(1, total)}L"))
    first = F.expr(f"(shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
