"""Scores of span predictions against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A variant is accepted from this coverage on, up to so many false positives per sentence without entities.
COVERAGE, FALSE_POSITIVES = 0.80, 0.10
REGISTERS = ("egyptian", "mixed_script", "msa")
LABELS = ("PER", "LOC", "ORG")
#: A model tier whose 95th percentile is above this many milliseconds stays off.
SLOWEST_TIER_MS = 500.0
_MARKUP = r"\[([^\]\[]+)\]\((PER|LOC|ORG)\)"


def parse_markup(cases: DataFrame) -> DataFrame:
    """Marked text ``[surface](LABEL)`` -> plain text and ``gold`` spans (start, end, label)."""
    from sitara.functions.text import spans_of

    found = spans_of(F.col("marked"), _MARKUP)
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")

    def step(acc: Column, s: Column) -> Column:
        surface, label = F.regexp_extract(s["value"], _MARKUP, 1), F.regexp_extract(s["value"], _MARKUP, 2)
        start = s["start"] - acc["less"]
        span = F.struct(start.alias("start"), (start + F.char_length(surface)).alias("end"), label.alias("label"))
        return F.struct((acc["less"] + F.char_length(s["value"]) - F.char_length(surface)).alias("less"), F.concat(acc["out"], F.array(span)).alias("out"))

    gold = F.aggregate(found, F.struct(F.lit(0).alias("less"), empty.alias("out")), step, lambda acc: acc["out"])
    return cases.withColumns({"text": F.regexp_replace("marked", _MARKUP, "$1"), "gold": gold})


def gold_problems(cases: DataFrame) -> DataFrame:
    """Case ids given twice."""
    return cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


#: Spans are cut at every so many characters, and each stretch of a text is swept apart.
STRETCH = 1 << 16


def _cut(spans: DataFrame, *keep: str) -> DataFrame:
    """Spans in pieces: ``keep``, case_id, stretch, lo, hi."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    stretch = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor(last / STRETCH))).alias("stretch")
    at = lambda k: (F.col("stretch") + k) * STRETCH
    return spans.select("*", stretch).select(*keep, "case_id", "stretch", F.greatest(F.col("start"), at(0)).alias("lo"), F.least(F.col("end"), at(1)).alias("hi"))


#: Spans of one task of a sweep.
SWEPT = 200_000


def sweep_tasks(spans: DataFrame) -> int:
    """Tasks for a sweep over as many spans, so that what one of them sorts stays the same however many there are."""
    return max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-spans.count() // SWEPT))


def _stretches() -> tuple[Column, Column]:
    """The first and the last stretch that a span lies in."""
    return F.floor(F.col("start") / STRETCH), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / STRETCH)


def swept(spans: DataFrame, others: DataFrame, *keep: str, like: str | None = None, tasks: int | None = None) -> DataFrame:
    """A row for each stretch of text that a span (``turn`` 0, with ``keep``) or other (1) lies in: case_id, stretch, start, end, and for spans ``hit``: some other of the case and stretch overlaps; with ``like``, also ``typed``: one of equal ``like`` does.

    A sweep, not a join of pairs: of the others that begin before a span's end,
    the one that reaches farthest overlaps it if any does, and how far they reach
    is a running maximum. So a span has one row, at its end, and another one, at
    its beginning; both are whole in each of their stretches, and two that overlap
    share one. They are dealt by case and stretch once, to ``tasks`` (default:
    Spark's own number). A span without a place is in no stretch and hits nothing.
    """
    more = [like] if like else []
    laid = lambda rows, turn, *names: rows.select("case_id", "start", "end", *names, F.lit(turn).alias("turn"), F.explode_outer(F.sequence(*_stretches())).alias("stretch"))
    rows = laid(spans, 0, *dict.fromkeys([*keep, *more])).unionByName(laid(others.where(F.col("case_id").isNotNull()), 1, *more), allowMissingColumns=True)
    if tasks:
        rows = rows.repartition(tasks, "case_id", "stretch")
    # At one place: ends of spans, then beginnings of others.
    at, reach = F.when(F.col("turn") == 0, F.col("end")).otherwise(F.col("start")), F.max(F.when(F.col("turn") == 1, F.col("end")))
    for name, by in [("hit", []), *([("typed", more)] if like else [])]:
        upto = Window.partitionBy("case_id", "stretch", *by).orderBy(at, "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(name, F.coalesce((F.col("turn") == 0) & (reach.over(upto) > F.col("start")), F.lit(False)))
    return rows


def span_hits(gold: DataFrame, predictions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct gold spans with ``hit`` (some prediction overlaps) and ``typed`` (one of the same label does)."""
    keys = ["case_id", "register", "start", "end", "label"]
    each = swept(gold, predictions, "register", like="label", tasks=tasks).where("turn = 0").select(*keys, "hit", "typed")
    if tasks:
        each = each.repartition(tasks, *keys)
    # A label that is null is equal to none.
    return each.groupBy(*keys).agg(F.bool_or("hit").alias("hit"), (F.bool_or("typed") & F.col("label").isNotNull()).alias("typed"))


def coverage(hits: DataFrame) -> DataFrame:
    """Spans, hits and ratios overall, by register and by label."""
    sets = hits.groupingSets([[], ["register"], ["label"]], "register", "label")
    out = sets.agg(F.count("*").alias("spans"), F.count_if("hit").alias("covered"), F.count_if("typed").alias("covered_typed"))
    return out.withColumns({"coverage_any": ratio(F.col("covered"), F.col("spans")), "coverage_typed": ratio(F.col("covered_typed"), F.col("spans"))})


def character_coverage(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: characters of gold spans, those covered, and characters predicted outside; each once however often covered.

    A sweep over the ends of all spans of a stretch: how many of either kind are
    open says what the characters up to the next end are.
    """
    pieces = _cut(gold).withColumns({"g": F.lit(1), "p": F.lit(0)}).unionByName(_cut(predictions).withColumns({"g": F.lit(0), "p": F.lit(1)}))
    steps = F.inline(F.array(F.struct(F.col("lo").alias("x"), F.col("g").alias("g"), F.col("p").alias("p")), F.struct(F.col("hi").alias("x"), (-F.col("g")).alias("g"), (-F.col("p")).alias("p"))))
    # Equal ends of a stretch are one step.
    at = pieces.where("hi > lo").select("case_id", "stretch", steps).groupBy("case_id", "stretch", "x").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    order = Window.partitionBy("case_id", "stretch").orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = at.select((F.lead("x").over(order) - F.col("x")).alias("n"), (F.sum("g").over(upto) > 0).alias("g"), (F.sum("p").over(upto) > 0).alias("p"))
    chars = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")
    sums = open_.agg(chars(F.col("g")).alias("gold_chars"), chars(F.col("g") & F.col("p")).alias("covered_chars"), chars(F.col("p") & ~F.col("g")).alias("extra_chars"))
    return sums.withColumns({"char_recall": ratio(F.col("covered_chars"), F.col("gold_chars")), "over_mask_ratio": ratio(F.col("extra_chars"), F.col("gold_chars"))})


def gather(*rows: DataFrame) -> DataFrame:
    """One-row frames of numbers side by side, without a join: their columns as long rows, turned back by one aggregate."""
    names, long = [], None
    for r in rows:
        names += r.columns
        cells = r.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in r.columns])))
        long = cells if long is None else long.union(cells)
    return long.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def precision(cases: DataFrame, gold: DataFrame, predictions: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row: predictions, those that touch gold, and false ones per case without entities."""
    first, last = _stretches()
    counts = lambda **of: [of.get(n, F.lit(0)).cast("long").alias(n) for n in ("cases", "gold", "predicted", "true")]
    ours, own, begun = F.col("turn") == 0, F.col("own"), F.col("stretch").eqNullSafe(first)
    apart = ours & F.coalesce(first < last, F.lit(False))
    # A prediction counts for its case where it begins. One of several stretches has a row of its own besides, as it is true once wherever it is hit.
    rows = swept(predictions, gold, tasks=tasks).select("*", F.explode_outer(F.when(apart, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("own"))
    rows = rows.select("case_id", *[F.when(own, F.col(c)).alias(c) for c in ("start", "end")], *counts(gold=~ours, predicted=ours & begun, true=F.col("hit") & (own | ~apart)))
    rows = rows.unionByName(cases.select("case_id", *counts(cases=F.lit(1))), allowMissingColumns=True)
    by = rows.groupBy("case_id", "start", "end").agg(*[F.sum(n).alias(n) for n in ("cases", "gold", "predicted", "true")])
    # A case that is null has no gold and no predictions.
    whole, known = F.col("start").isNull(), F.col("case_id").isNotNull()
    clean = whole & (F.col("cases") > 0) & ((F.col("gold") == 0) | ~known)
    total = lambda which, n: F.coalesce(F.sum(F.when(which, F.col(n))), F.lit(0)).cast("double")
    true = F.when(whole, F.col("true")).when(F.col("true") > 0, F.col("predicted"))
    one = by.withColumn("true", true).agg(total(whole, "predicted").alias("predicted"), total(clean & known, "predicted").alias("false_in_clean"), total(clean, "cases").alias("clean_cases"), total(F.lit(True), "true").alias("true_spans"))
    return one.withColumns({"span_precision": ratio(F.col("true_spans"), F.col("predicted")), "fp_per_clean": ratio(F.col("false_in_clean"), F.col("clean_cases"))})


def nearest_rank(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """``by`` and a column for each quantile, by nearest rank, halves rounded to the even rank; an element of the data, never between two."""
    return at_ranks(rows, by, value, {name: F.rint(F.lit(q) * (F.col("n") - 1)) for name, q in quantiles.items()})


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """``by`` and a column for each rank (from 0, in terms of the group's size ``n``).

    Equal values of a group are counted once each; bucket by bucket of a
    group's range of values, running sums of the counts give the ranks, so no
    task holds a group. Nulls are ignored; a group of nulls has null quantiles.
    """
    counts = rows.groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count(F.col(value)).alias("c"))
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))
    # Places that cut the values of each group evenly; a bucket is the number of places below a value.
    pieces = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = counts.where("c > 0").groupBy("g").agg(F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 10_000).alias("places"))
    dealt = counts.where("c > 0").join(F.broadcast(places.withColumnRenamed("g", "g2")), F.col("g").eqNullSafe(F.col("g2")))
    dealt = dealt.select("g", "v", "c", F.size(F.filter("places", lambda x: x < F.col("v"))).alias("bucket"))
    before = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("g", "bucket").agg(F.sum("c").alias("b")).withColumn("start", F.coalesce(F.sum("b").over(before), F.lit(0)))
    starts = starts.select(F.col("g").alias("g2"), F.col("bucket").alias("b2"), "start")
    dealt = dealt.join(starts, F.col("g").eqNullSafe(F.col("g2")) & (F.col("bucket") == F.col("b2"))).drop("g2", "b2")
    inside = F.sum("c").over(Window.partitionBy("g", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = dealt.withColumn("last", F.col("start") + inside)
    ranked = ranked.join(F.broadcast(sizes.withColumnRenamed("g", "g2")), F.col("g").eqNullSafe(F.col("g2")))
    picked = [F.max(F.when((F.col("last") > k) & (F.col("last") - F.col("c") <= k), F.col("v"))).alias(name) for name, k in ranks.items()]
    found = ranked.groupBy("g").agg(*picked)
    all_ = sizes.select(F.col("g").alias("g2")).join(found, F.col("g").eqNullSafe(F.col("g2")), "left")
    return all_.select(F.col("g2").alias(by), *ranks)


def latency(runs: DataFrame, by: str = "variant", value: str = "latency_ms") -> DataFrame:
    """Median, 95th and 99th percentile, mean, maximum and throughput of timed runs."""
    v = F.col(value)
    means = runs.groupBy(F.col(by).alias("g3")).agg(F.avg(v).alias("mean_ms"), F.max(v).alias("max_ms"), (F.count("*") * 1000 / F.sum(v)).alias("per_second"))
    last = F.col("n") - 1
    ranks = at_ranks(runs, by, value, {"low": F.floor(last / 2), "high": F.ceil(last / 2), "p95_ms": F.rint(F.lit(0.95) * last), "p99_ms": F.rint(F.lit(0.99) * last)})
    ranks = ranks.withColumn("median_ms", (F.col("low") + F.col("high")) / 2)
    return ranks.join(means, F.col(by).eqNullSafe(F.col("g3"))).select(by, "median_ms", "p95_ms", "p99_ms", "mean_ms", "max_ms", "per_second")


def score_variant(cases: DataFrame, gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """All metrics of one variant in a row, with the verdict of the acceptance gate."""
    hits = span_hits(gold, predictions)
    total = hits.agg(F.count("*").alias("spans"), F.count_if("hit").alias("covered"), F.count_if("typed").alias("covered_typed"))
    total = total.select(ratio(F.col("covered"), F.col("spans")).alias("coverage_any"), ratio(F.col("covered_typed"), F.col("spans")).alias("coverage_typed"))
    out = gather(total, character_coverage(gold, predictions), precision(cases, gold, predictions))
    return out.withColumn("accepted", acceptable(F.col("coverage_any"), F.col("fp_per_clean")))


def acceptable(coverage_any: Column, fp_per_clean: Column) -> Column:
    return (coverage_any >= COVERAGE) & (fp_per_clean <= FALSE_POSITIVES)


def tier_verdict(available: Column, p95_ms: Column, limit: float = SLOWEST_TIER_MS) -> Column:
    """Whether a model tier may be on: ``unavailable``, ``too slow`` or ``on``."""
    return F.when(~F.coalesce(available, F.lit(False)), "unavailable").when(p95_ms > limit, "too slow").otherwise("on")


def compare_variants(runs: DataFrame, cases: DataFrame, gold: DataFrame, variants: list[str]) -> DataFrame:
    """A row per variant of ``runs`` (variant, case_id, latency_ms, spans): coverage, false positives, latency, gate.

    Variants are few; each is scored over all cases by joins and sums.
    """
    out = None
    for name in variants:
        own = runs.where(F.col("variant") == name)
        predictions = own.select("case_id", F.inline_outer("spans")).where(F.col("start").isNotNull())
        row = score_variant(cases, gold, predictions).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.join(latency(runs), "variant")


def rank_variants(scores: DataFrame) -> DataFrame:
    """Accepted variants in order: coverage to three places, then fewer false positives, speed, name."""
    kept = scores.where(acceptable(F.col("coverage_any"), F.col("fp_per_clean")))
    return kept.orderBy(F.desc(F.round("coverage_any", 3)), "fp_per_clean", "p95_ms", "variant")


def with_place(ranked: DataFrame) -> DataFrame:
    """Adds ``place`` from 1 to accepted variants; variants are tens by nature, so one task numbers them."""
    order = Window.orderBy(F.desc(F.round("coverage_any", 3)), "fp_per_clean", "p95_ms", "variant")
    return ranked.withColumn("place", F.row_number().over(order).cast("long"))


def register_order(register: Column) -> Column:
    out = F.lit(len(REGISTERS))
    for i, r in reversed(list(enumerate(REGISTERS))):
        out = F.when(register == r, i).otherwise(out)
    return out


def gold_summary(cases: DataFrame) -> DataFrame:
    """Cases, spans and cases without any, by register."""
    return cases.groupBy("register").agg(F.count("*").alias("cases"), F.sum(F.size("gold")).alias("spans"), F.count_if(F.size("gold") == 0).alias("negatives")).orderBy(register_order(F.col("register")))
