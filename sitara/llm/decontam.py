"""Benchmark decontamination with SimHash windows (DataFrame functions only).

A benchmark item of L words is sought in windows of L words. Windows and
items get a 64-bit SimHash over their five-word shingles; blocks of the
fingerprint are joined through all block values within the radius's share, so
no fingerprint within the radius is missed; an exact weighted Jaccard
similarity of the shingles decides.

Windows are laid where a shingle of the text is one of an item's: at
similarity 0.8 window and item share shingles, so a window without a common
one cannot match, and the others are never built.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitara.functions.text import let
from sitara.llm.common import join_groups, materialize, pick_columns, small

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in about 10 bits with a deviation of 3; more than RADIUS is rarer than 1 in 700.
RADIUS = 19
#: Widths of the blocks. One of five blocks differs in RADIUS // 5 = 3 bits at most.
BLOCKS = (13, 13, 13, 13, 12)


def normal_words(text: Column) -> Column:
    """Words in lower case, without punctuation."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, repeats included."""
    n = F.size(ws)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))


def simhash(hs: Column) -> Column:
    """64-bit SimHash: a bit is set if more than half of the hashes have it."""
    half = F.size(hs) / 2
    ones = lambda b: F.aggregate(hs, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
    set_ = lambda acc, b: F.when(ones(b) > half, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), set_)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater counts of shingles; 0 for two empty lists.

    Distinct shingles are intersected by hashing; only those that both lists repeat are counted.
    """
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))

    def repeated(xs: Column) -> Column:
        return let(F.array_sort(xs), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))

    more = F.aggregate(F.array_intersect(repeated(a), repeated(b)), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)) - 1)
    both = F.size(F.array_intersect(a, b)) + more
    return let(both, lambda n: F.when(F.size(a) + F.size(b) > 0, n / (F.size(a) + F.size(b) - n)).otherwise(F.lit(0.0)))


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, sum(BLOCKS[:k])).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1))


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)]


def _blocks(fp: Column, radius: int | None = None) -> Column:
    """(block, value) pairs of a fingerprint; with a radius, all values that some block must have within it."""
    if radius is None:
        return F.array(*[F.struct(F.lit(k).alias("block"), _block(fp, k).alias("value")) for k in range(len(BLOCKS))])
    most = radius // len(BLOCKS)

    def near(k: int) -> Column:
        flips = F.split(F.lit(",".join(map(str, _flips(BLOCKS[k], most)))), ",").cast("array<bigint>")
        return F.transform(flips, lambda x: F.struct(F.lit(k).alias("block"), _block(fp, k).bitwiseXOR(x).alias("value")))

    return F.concat(*[near(k) for k in range(len(BLOCKS))])


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, length, k (shingle size), hs, fp of the items with words; one row for each item_id and text."""
    pick_columns(benchmark, "item_id", "text")
    out = benchmark.select("item_id", normal_words(F.col("text")).alias("ws")).withColumn("length", F.size("ws")).where("length > 0")
    out = out.withColumn("k", F.least("length", F.lit(SHINGLE)))
    by_k = None
    for k in range(1, SHINGLE + 1):
        by_k = F.when(F.col("k") == k, shingles(F.col("ws"), k)) if by_k is None else by_k.when(F.col("k") == k, shingles(F.col("ws"), k))
    return out.withColumn("hs", by_k).select("item_id", "length", "k", "hs", simhash(F.col("hs")).alias("fp")).distinct()


def _text_key(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Matches of distinct texts: t1, t2 (two hashes of the text), item_id, length, start, similarity.

    ``start`` is the first word of the best window. Null and empty texts and
    items match nothing; a text shorter than an item is one window. Items with
    equal texts all match.
    """
    pick_columns(docs, "text")
    goal = materialize(items(benchmark), "items")
    sizes = sorted(r.k for r in goal.select("k").distinct().collect())
    if not sizes:
        return docs.sparkSession.createDataFrame([], "t1 long, t2 long, item_id long, length int, start int, similarity double")
    places = materialize(goal.select("length", "k", F.posexplode("hs").alias("offset", "h")).distinct(), "item-shingles")
    texts = docs.select(*_text_key(F.col("text")), normal_words(F.col("text")).alias("ws"))
    # Shingles of all sizes follow one another in one list, so all take one pass over the texts.
    # The number of words is a column before the generator, which else would carry all words along with each shingle.
    listed = texts.select("t1", "t2", F.size("ws").alias("n"), F.concat(*[shingles(F.col("ws"), k) for k in sizes]).alias("hs"))
    at = listed.select("t1", "t2", "n", F.posexplode_outer("hs").alias("p", "h")).where(F.col("h").isNotNull())
    found, first = join_groups(at, places, ["h"], F.col("p")), {}
    for k in sizes:
        first[k] = sum((F.greatest(F.col("n") - j + 1, F.lit(0)) for j in sizes if j < k), F.lit(0))
    p = F.col("p") - F.coalesce(*[F.when(F.col("k") == k, first[k]) for k in sizes])
    found = found.withColumn("p", p).where((F.col("p") >= 0) & (F.col("p") <= F.col("n") - F.col("k")))
    spots = found.select("t1", "t2", "length", F.greatest(F.col("p") - F.col("offset"), F.lit(0)).alias("start"), "k").distinct()
    spots = materialize(spots, "window-spots")
    lists = spots.groupBy("t1", "t2").agg(F.collect_list(F.struct("length", "start", "k")).alias("spots"))
    held = docs.select(*_text_key(F.col("text")), "text").join(small(lists), ["t1", "t2"])
    held = held.select("t1", "t2", "spots", normal_words(F.col("text")).alias("ws"))
    held = held.select("t1", "t2", "spots", *[shingles(F.col("ws"), k).alias(f"hs{k}") for k in sizes])

    def window(s: Column) -> Column:
        """A window's shingles are a run of its text's; cut before rows are made, so no window carries the text."""
        hs = F.coalesce(*[F.when(s["k"] == k, F.slice(F.col(f"hs{k}"), s["start"] + 1, s["length"] - k + 1)) for k in sizes])
        return F.struct(s["length"].alias("length"), s["start"].alias("start"), hs.alias("whs"))

    windows = held.select("t1", "t2", F.inline_outer(F.transform("spots", window))).where(F.size("whs") > 0)
    # Copies of a text, and a passage that many texts share, are one window: what is compared is its content.
    content = [F.xxhash64("whs").alias("c1"), F.xxhash64(F.lit(1), F.col("whs")).alias("c2")]
    windows = materialize(windows.select("t1", "t2", "length", "start", *content, "whs"), "windows")
    distinct = windows.groupBy("length", "c1", "c2").agg(F.min(F.struct("whs")).alias("w")).select("length", "c1", "c2", "w.whs")
    printed = materialize(distinct.withColumn("wfp", simhash(F.col("whs"))), "window-prints")
    # Items go under all values near theirs; the whole fingerprints are compared inside the join, so only close pairs leave it.
    sought = goal.select("item_id", "length", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("b")).select("item_id", "length", "fp", "b.block", "b.value")
    dealt = printed.select("length", "c1", "c2", "wfp", F.explode(_blocks(F.col("wfp"))).alias("b")).select("length", "c1", "c2", "wfp", "b.block", "b.value")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp"))) <= radius
    pairs = dealt.join(sought, ["length", "block", "value"]).where(near).select("length", "c1", "c2", "item_id").distinct()
    close = pairs.join(printed, ["length", "c1", "c2"]).join(goal.select("item_id", "length", "hs"), ["item_id", "length"])
    exact = close.withColumn("similarity", weighted_jaccard(F.col("whs"), F.col("hs"))).where(F.col("similarity") >= similarity)
    exact = materialize(exact.groupBy("length", "c1", "c2", "item_id").agg(F.max("similarity").alias("similarity")), "item-windows")
    all_ = windows.select("t1", "t2", "length", "start", "c1", "c2").join(exact, ["length", "c1", "c2"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "length")).alias("b")
    return all_.groupBy("t1", "t2", "item_id").agg(best).select("t1", "t2", "item_id", "b.length", (-F.col("b.s")).alias("start"), "b.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start, length of every row of ``docs`` that holds an item.

    Rows with null ids count like others; repeated rows give repeated matches.
    """
    pick_columns(docs, "doc_id", "text")
    found = materialize(matches(docs, benchmark, similarity, radius), "contaminated")
    rows = docs.select("doc_id", *_text_key(F.col("text")))
    return rows.join(small(found), ["t1", "t2"]).select("doc_id", "item_id", "similarity", "start", "length")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they are."""
    found = small(materialize(matches(docs, benchmark, similarity, radius).select("t1", "t2").distinct(), "contaminated"))
    names = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *_text_key(F.col("text")))
    return marked.join(found, ["t1", "t2"], "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
