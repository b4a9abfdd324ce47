"""Detected spans kept by text, language and policy, so that what was seen before is not scanned again.

Rows hold a hash of the text, never the text, and spans without their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.operators.detect import detect, language
from sitara.sources.policy import Policy
from sitara.sources.versioned import CLUSTERS, Table

SPAN = "struct<start:int,end:int,entity_type:string,recognizer:string,score:double,context_term:string,action:string>"
CACHE_SCHEMA = f"text_hash string, policy_fp string, lang string, spans array<{SPAN}>"


def open_cache(spark: SparkSession, path: str, clusters: int = CLUSTERS) -> Table:
    return Table(spark, path, CACHE_SCHEMA, key="text_hash", bloom=("text_hash",), clusters=clusters)


def _with_values(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("value", F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def detect_cached(texts: DataFrame, policy: Policy, cache: Table, today: Column | None = None) -> DataFrame:
    """``detect``, but only for texts that the cache does not have under this policy; what is new goes into the cache.

    Rows of other policies stay in the cache but are never taken. A detection
    that depends on the day (birth dates) belongs to the policy it was made
    under: give policies of different days different caches.
    """
    fp = policy.fingerprint()
    body = F.coalesce(F.col("text"), F.lit(""))
    hint = F.col("lang_hint") if "lang_hint" in texts.columns else None
    keyed = texts.withColumns({"__hash": F.sha2(body, 256), "__lang": language(body, hint)})
    one = keyed.groupBy("__hash", "__lang").agg(F.any_value(body).alias("text"))
    version = cache.version()
    known = cache.read(version).where(F.col("policy_fp") == fp).select(F.col("text_hash").alias("__hash"), F.col("lang").alias("__lang"), "spans")
    misses = one.join(known.select("__hash", "__lang"), ["__hash", "__lang"], "left_anti").withColumn("lang_hint", F.col("__lang"))
    bare = F.transform("spans", lambda s: s.dropFields("value"))
    made = detect(misses, policy, today).select(F.col("__hash").alias("text_hash"), F.lit(fp).alias("policy_fp"), F.col("__lang").alias("lang"), bare.cast(f"array<{SPAN}>").alias("spans"))
    # The write scans; what it wrote is read for this batch and all later ones.
    cache.append(made)
    if len([p for p in cache.version().parts if p.clusters is None]) >= 8:
        cache.compact()
    now = cache.read().where(F.col("policy_fp") == fp).select(F.col("text_hash").alias("__hash"), F.col("lang").alias("__lang"), "spans")
    # Two batches at once may have written the same text.
    now = now.dropDuplicates(["__hash", "__lang"])
    out = keyed.join(now, ["__hash", "__lang"], "left")
    return out.withColumn("spans", _with_values(body, F.col("spans"))).withColumnRenamed("__lang", "lang").drop("__hash")
