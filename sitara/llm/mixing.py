"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every document gets a rate r, the expected number of its copies. Among all
rates in [0, 3] whose words reach the source's target, entropy balancing
takes those closest to 1 in relative entropy; by duality r = min(3, exp(l x))
with x the document's words over the source's mean and one multiplier l a
source. Newton iterations on the dual, each one grouped sum over the counts
of sizes, find l; a systematic rounding of the rates gives whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitara.llm.common import count_words, join_groups, materialize, pick_columns, source_key, spread_rank

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240301
#: Rates are whole numbers of millionths, so sums do not depend on their order.
UNIT = 1_000_000
TOLERANCE = 1e-5
#: A bracket of multipliers that is so narrow, relative to them, holds the same rates at both ends.
NARROW = 1e-13


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Columns added to documents: src, size, h. Names start with __mix_."""
    return docs.withColumns(
        {
            "__mix_src": source_key(F.col("source")),
            "__mix_size": count_words(F.col("text")),
            "__mix_h": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
        }
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target words of each source: src, source_size, target.

    Sources in code point order weigh 5, 2, 1, 5, ... and share the words of
    all; a target stops at ``most`` times its source's words and the excess
    is shared again. Sources reach their stop in ascending order of stop
    over weight, so the stopped ones are a prefix of that order.
    """
    everything = Window.partitionBy("all")
    by = sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("all", F.lit(0))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(everything.orderBy("src")) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", pick).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    order = everything.orderBy(F.col("stop") / F.col("w"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    by = by.withColumn("rate", F.greatest(rest, F.lit(0.0)) / F.sum("w").over(after))
    by = by.withColumn("stopped", F.col("rate") * F.col("w") >= F.col("stop"))
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("stop") / F.col("w"), F.col("src"), F.col("rate")))).over(everything)["rate"]
    return by.select("src", "source_size", F.when(F.col("stopped") | level.isNull(), F.col("stop")).otherwise(F.least(F.col("stop"), level * F.col("w"))).alias("target"))


def _rate(lam, size, mean, free, most: int):
    """Rate in millionths."""
    tilt = F.exp(F.least(lam * size / mean, F.lit(50.0)))
    return F.round(F.when(free, F.least(tilt, F.lit(float(most)))).otherwise(F.lit(float(most))) * UNIT).cast("long")


def balance(sizes: DataFrame, goal: DataFrame, most: int = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """Multiplier ``lam`` of each source: Newton on the logarithm of the words taken, kept inside a bracket.

    Every third iteration halves a bracket that has both ends, so the loop
    ends for every source: at the tolerance, or where the bracket is too
    narrow to change a rate (rates are whole millionths, so words taken move
    in steps). A bracket that lacks an end is doubled every fourth.
    """
    state = goal.join(sizes.groupBy("src").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)), F.lit(1))).alias("mean")), "src")
    state = state.withColumn("mean", F.greatest(F.col("mean"), F.lit(1.0)))
    state = state.withColumn("free", F.col("target") < F.col("source_size") * F.lit(most * (1 - 1e-9)))
    state = state.withColumn("lam", F.when(F.col("free") & (F.col("target") > 0), F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
    state = state.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "done": ~F.col("free") | (F.col("target") <= 0)})
    before = state = materialize(state, "mix-state")
    turn = 0
    while not state.where(~F.col("done")).isEmpty():
        turn += 1
        open_ = state.where(~F.col("done"))
        with_rate = sizes.join(open_, "src").withColumn("r", _rate(F.col("lam"), F.col("size"), F.col("mean"), F.col("free"), most))
        slope = F.when(F.col("r") < most * UNIT, F.col("n") * F.col("size") * F.round(F.col("r") * F.col("size") / F.col("mean")).cast("long")).otherwise(F.lit(0))
        got = with_rate.groupBy("src").agg(
            (F.sum((F.col("n") * F.col("size") * F.col("r")).cast("decimal(38,0)")) / UNIT).cast("double").alias("got"),
            (F.sum(slope.cast("decimal(38,0)")) / UNIT).cast("double").alias("slope"),
        )
        miss = F.col("target") - F.col("got")
        state = state.join(got, "src", "left")
        state = state.withColumns(
            {
                "done": F.col("done") | F.coalesce(F.abs(miss) <= F.col("target") * tolerance, F.lit(True)),
                "lo": F.when(miss > 0, F.col("lam")).otherwise(F.col("lo")),
                "hi": F.when(miss < 0, F.col("lam")).otherwise(F.col("hi")),
            }
        )
        step = F.when((F.col("got") > 0) & (F.col("slope") > 0), F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")).otherwise(F.signum(miss))
        reach = F.abs(F.col("lam")) + 1
        to = F.col("lam") + F.greatest(-reach, F.least(reach, step))
        outside = (F.col("lo").isNotNull() & (to <= F.col("lo"))) | (F.col("hi").isNotNull() & (to >= F.col("hi")))
        both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
        to = F.when(both & (outside | F.lit(turn % 3 == 0)), (F.col("lo") + F.col("hi")) / 2).otherwise(to)
        to = F.when(~both & F.lit(turn % 4 == 0), F.col("lam") + F.signum(miss) * reach).otherwise(to)
        narrow = both & (F.col("hi") - F.col("lo") <= NARROW * F.greatest(F.lit(1.0), F.abs("lam")))
        state = state.withColumn("done", F.col("done") | F.coalesce(narrow, F.lit(False)))
        state = state.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(to)).drop("got", "slope")
        state = materialize(state, "mix-state", instead=before)
        before = state
    return state


def copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Copies by source and size: src, size, source_size, target, base, h_last, n_last, torn.

    ``rows`` has src, size, h. A document takes ``base`` copies, and one more
    if its h, in unsigned order, is less than ``h_last``; of those whose h is
    ``h_last``, ``n_last`` take one more, which are not all of them if ``torn``.
    Sizes of a source in ascending order share a running sum of rates whose rounding says how many
    copies each size gets, so the words taken miss the sum of rates by half a
    document at most.
    """
    sizes = materialize(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "mix-sizes")
    state = balance(sizes, targets(sizes, weights, most), most)
    total = rows.count()
    before = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rated = sizes.join(state, "src").withColumn("r", _rate(F.col("lam"), F.col("size"), F.col("mean"), F.col("free"), most) * F.col("n"))
    rated = rated.withColumn("upto", F.sum("r").over(before) + UNIT // 2)
    rated = rated.withColumn("all_copies", F.expr(f"upto div {UNIT}L - (upto - r) div {UNIT}L"))
    # What rounding leaves of a target is made up by one document of the size that fits best.
    source = Window.partitionBy("src")
    rated = rated.withColumn("gap", F.col("target") - F.sum(F.col("all_copies") * F.col("size")).over(source))
    spare = F.when(F.col("gap") > 0, F.col("all_copies") < F.col("n") * most).otherwise(F.col("all_copies") > 0)
    fits = F.min(F.when(spare, F.struct(F.abs(F.abs("gap") - F.col("size")).alias("off"), F.col("size")))).over(source)
    rated = rated.withColumn("fits", fits)
    chosen = (F.col("size") == F.col("fits.size")) & (F.col("fits.off") < F.abs("gap"))
    rated = rated.withColumn("all_copies", F.col("all_copies") + F.when(chosen, F.signum("gap").cast("long")).otherwise(F.lit(0)))
    groups = rated.select("src", "size", "n", "source_size", "target", F.expr("all_copies div n").alias("base"), F.expr("all_copies % n").alias("extra"))
    groups = materialize(groups, "mix-groups")
    placed = spread_rank(rows.select("src", "size", "h"), groups.where("extra > 0").select("src", "size", "n", "extra"), ["src", "size"], "h", [], total)
    # Equal rows have one h; the last h that takes more copies may have rows for which there is none.
    by_h = placed.where(F.col("rank") <= F.col("extra")).groupBy("src", "size", "h").agg(F.count_if(F.col("rank") < F.col("extra")).alias("n_last"), (F.max("rank") == F.max("extra")).alias("torn"))
    last = by_h.where("n_last > 0").groupBy("src", "size").agg(F.max(F.struct(_unsigned(F.col("h")).alias("h_last"), "n_last", "torn")).alias("last")).select("src", "size", "last.*")
    return materialize(groups.join(last, ["src", "size"], "left").drop("extra", "n"), "mix-copies")


def _unsigned(h):
    """A long in an order in which its bits count as unsigned."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    Copies are whole numbers from 0 to ``most``; each source's words times
    copies come near its target. Null texts have size 0 and keep one copy;
    null is a source, the last. Rows with equal doc_id and text are as many
    documents; where only some of them take another copy, it does not matter
    which. Reruns agree whatever the partitioning: all sums are of whole
    numbers. An empty table gives an empty result; other columns stay as they
    are, unless they have one of the four names, which are replaced.

    ``columns`` are those of ``docs`` that the result keeps (default: all).
    Without the text among them, texts are read once.
    """
    pick_columns(docs, "doc_id", "text", "source")
    added = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() not in added]
    marked = sized(docs, seed)
    own = ["__mix_src", "__mix_size", "__mix_h"]
    if "text" not in keep:
        marked = materialize(marked.select(*[F.col(f"`{c}`") for c in keep], *own), "mix-rows")
        rows = marked.select([F.col(c).alias(c.removeprefix("__mix_")) for c in own])
    else:
        rows = materialize(marked.select([F.col(c).alias(c.removeprefix("__mix_")) for c in own]), "mix-rows")
    table = copies(rows, weights, most)
    table = table.select([F.col(c).alias(f"__mix_{c}") for c in table.columns])
    out = join_groups(marked, table, ["__mix_src", "__mix_size"], F.col("__mix_h"))
    own_h = _unsigned(F.col("__mix_h"))
    some = F.coalesce(F.col("__mix_torn") & (own_h == F.col("__mix_h_last")), F.lit(False))
    more = F.coalesce(own_h <= F.col("__mix_h_last"), F.lit(False))
    if table.where("__mix_torn").isEmpty():
        return _drawn(out, keep, more)
    return _drawn(out.where(~some), keep, more).unionByName(_drawn_of_equals(out.where(some), keep))


def _drawn(rows: DataFrame, keep: list[str], more: Column) -> DataFrame:
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__mix_size").alias("mix_size"),
        F.col("__mix_source_size").alias("mix_source_size"),
        F.col("__mix_target").alias("mix_target"),
        (F.col("__mix_base") + more.cast("long")).cast("int").alias("mix_copies"),
    )


def _drawn_of_equals(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``_drawn`` of rows that are equal in each source and size: the first n_last of them in some order take one more copy.

    The order is written down, as any row may come first; ranks are taken over
    buckets of it, so equal rows may be a third of all rows.
    """
    names = ["__mix_src", "__mix_size"]
    other = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in names]).alias("row")
    ties = materialize(rows.select(*[F.col(c).alias(c.removeprefix("__mix_")) for c in names], other, F.xxhash64(F.monotonically_increasing_id()).alias("h")), "mix-ties")
    groups = ties.groupBy("src", "size").agg(F.count("*").alias("n"))
    placed = spread_rank(ties, materialize(groups, "mix-tied"), ["src", "size"], "h", [], ties.count())
    back = placed.select(*[F.col(c.removeprefix("__mix_")).alias(c) for c in names], "row.*", F.col("rank").alias("__mix_rank"))
    return _drawn(back, keep, F.col("__mix_rank") < F.col("__mix_n_last"))
