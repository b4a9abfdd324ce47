"""Helpers shared by the corpus operators: the shared work folder, materialised
cuts of lineage, and distributed ranking without a window over a whole group."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a batch that a Python worker gets, unless the session sets another number.
BATCH_BYTES = 1 << 22
#: A word, in every contract of this subpackage: a run without ASCII white space.
NOT_WORD = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made and set if all of Spark
    runs in one process; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sitara-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session cuts Arrow batches by bytes too, as 10,000 long texts are too much for a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder and this application's, as a URI or path."""
    path = f"{shared_dir(spark)}/sitara/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Folders of this process that were not deleted yet.
_made: list[str] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        if p in _made:
            _made.remove(p)


def materialize(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors and computes
    ``df`` once however often the result is read. The folder of ``instead``,
    a table made here that is not needed any more, is deleted.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.made_at = path
    if instead is not None:
        release(instead)
    return out


def release(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``materialize`` made; nothing may read them later."""
    for t in tables:
        if path := getattr(t, "made_at", None):
            _delete(t.sparkSession, [path])


def mark() -> int:
    """How many folders there are now; see ``release_since``."""
    return len(_made)


def release_since(spark: SparkSession, begun: int, keep: DataFrame | None = None) -> None:
    """Delete all folders made since ``mark``, but that of ``keep``."""
    _delete(spark, [p for p in _made[begun:] if p != getattr(keep, "made_at", None)])


def clean(spark: SparkSession) -> None:
    """Delete all folders of this application, when its results are written."""
    _delete(spark, [f"{shared_dir(spark)}/sitara/{spark.sparkContext.applicationId}"])
    _made.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    """How many partitions the session deals shuffles to; the scale that buckets follow."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and for white space only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, without a list of them: each with the blanks around it becomes one letter."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.when(marks.startswith("x"), F.length(marks)).otherwise(F.lit(0)).cast("long")


def hash_sample(df: DataFrame, h: Column, most: int) -> DataFrame:
    """At most ``most`` rows, those of the least hashes.

    A threshold from the number of rows leaves about twice as many before
    they are sorted, so what tasks hand over does not grow with their number.
    """
    share = min(1.0, 2 * most / max(1, df.count()))
    return df.where(F.shiftrightunsigned(h, 1) <= F.lit(min(int(share * (1 << 63)), (1 << 63) - 1))).orderBy(h).limit(most)


#: Bytes of data up to which a table is broadcast, and parts that a key is dealt to where it is not.
BROADCAST_BYTES = 32 << 20
SALTS = 16


def weigh(df: DataFrame) -> int:
    """Bytes of data of a table: 16 for a number, 16 and its own for a text, 8 for each element of a list."""
    row = F.lit(0).cast("long")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        own = F.octet_length(c) + 16 if kind == "string" else F.size(c) * 8 + 16 if kind == "array" else F.lit(16)
        row = row + F.coalesce(own, F.lit(16)).cast("long")
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Marked for broadcast if its bytes are counted to be few; beyond, the join shuffles."""
    return F.broadcast(df) if weigh(df) <= (BROADCAST_BYTES if most is None else most) else df


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], spread: Column, few: bool | None = None) -> DataFrame:
    """Rows with the columns of their group (one row for a key, or some), whatever share of the rows a group has.

    Small tables of groups are broadcast (``few`` says that they are, else
    their bytes are counted). Larger ones are repeated for each of SALTS
    salts, and rows get one by ``spread``, so a group's rows go to many tasks.
    """
    if few if few is not None else weigh(groups) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), key)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(groups.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), [*key, "__salt"]).drop("__salt")


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with their row of ``table``, which has one for each key and, as ``n``, how many rows have it.

    Keys with a large share of ``total`` are few (four a shuffle partition at
    most, as their shares add up to all rows), so they are broadcast; rows of
    all other keys are shuffled to them.
    """
    hot = F.col("n") >= max(1_000, -(-total // (4 * shuffle_partitions(rows.sparkSession))))
    hot_rows = rows.join(F.broadcast(table.where(hot)), key)
    others = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot), key)
    return hot_rows.unionByName(others)


def pick_columns(df: DataFrame, *names: str) -> None:
    """Raise a clear error if a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with those of ``df`` (Spark ignores case)."""
    have = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in have:
        k += 1
        name = f"__{stem}_{k}"
    return name


def ranked(df: DataFrame, bucket: list[str], order: list[Column], name: str) -> DataFrame:
    """Row number from 0 within small buckets, by ``order``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)).cast("long") - 1)


#: Buckets that are summed in one go.
RUN = 64


def bucket_starts(counts: DataFrame, group: list[str], bucket: str, n: str, start: str) -> DataFrame:
    """For a table of counts per (group, bucket): rows in the earlier buckets of the group.

    ``counts`` has a row per bucket, a number that follows the shuffle
    partitions and not the rows. Sums run over runs of RUN buckets first, then
    inside each, so a large group's buckets meet in no one task.
    """
    run = F.floor(F.col(bucket) / RUN).alias("__run")
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy(*group, run).agg(F.sum(n).alias("__n")).withColumn("__begun", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, "__run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("__run", run).withColumn(start, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = summed.join(runs, [*group, "__run"])
    return joined.withColumn(start, (F.col(start) + F.col("__begun")).cast("long")).drop("__run", "__begun")


def source_key(source: Column) -> Column:
    """A source as a key without nulls that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def spread_rank(rows: DataFrame, groups: DataFrame, group: list[str], h: str, order: list[str], total: int) -> DataFrame:
    """Rank ``rank`` (from 0) of every row within its group by ``h``, then ``order``.

    ``groups`` has a row per group with its size ``n`` and may carry more
    columns, which the result keeps. A group is cut by the high bits of
    ``h`` into buckets in proportion to its share of all rows, so a group
    with a third of the rows is ranked by a third of the tasks; the
    counts of the buckets before a bucket give where its ranks start. These
    are as many as the buckets and groups, so one count of bytes decides how
    both are joined.
    """
    buckets = 8 * shuffle_partitions(rows.sparkSession)
    few = weigh(groups) + 64 * buckets <= BROADCAST_BYTES // 2
    share = F.ceil(F.col("n") * F.lit(float(buckets)) / F.lit(float(max(1, total))))
    unit = F.shiftrightunsigned(F.col(h), 33).cast("double") / F.lit(float(1 << 31))
    dealt = join_groups(rows, groups, group, F.col(h), few).withColumn("bucket", F.floor(unit * F.greatest(F.lit(1), share)).cast("long"))
    key = [*group, "bucket"]
    starts = bucket_starts(dealt.groupBy(*key).agg(F.count("*").alias("bucket_n")), group, "bucket", "bucket_n", "bucket_start")
    inside = ranked(join_groups(dealt, starts.select(*key, "bucket_start"), key, F.col(h), few), key, [F.shiftrightunsigned(F.col(h), 1), F.col(h), *[F.col(c) for c in order]], "rank")
    return inside.withColumn("rank", F.col("rank") + F.col("bucket_start")).drop("bucket", "bucket_start")
