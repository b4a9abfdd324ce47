"""Detection: text -> spans, with thresholds, suppression and deconfliction."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitara.functions.text import DIGITS, dominant_script, normalize
from sitara.operators import scan
from sitara.operators.recognizers import recognizers
from sitara.sources.policy import Policy

#: Policies whose expressions are kept.
KEPT = 16
#: Rows of one text that go to one task when distinct texts are joined back; and how many such texts are broadcast (80 bytes each).
HOT, HOT_BROADCAST = 100_000, 200_000


def language(text: Column, hint: Column | None = None, supported: tuple[str, ...] = ("ar", "en")) -> Column:
    """The hint if it is supported; else ar for mostly Arabic text, else en, else the first supported."""
    default = "en" if "en" in supported else sorted(supported)[0]
    guess = F.when((dominant_script(text) == "arabic") & F.lit("ar" in supported), "ar").otherwise(default)
    guess = F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(guess)
    return guess if hint is None else F.when(hint.isin(*supported), hint).otherwise(guess)


def _lookup(policy: Policy, what, kind: str, key: Column) -> Column:
    """A value by entity, from a literal map: a policy has tens of entities."""
    pairs = [x for n, e in policy.entities.items() for x in (F.lit(n), F.lit(what(e)).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), key)


def deconflict(spans: str = "spans") -> Column:
    """The array column ``spans`` without spans contained in a kept one; see ``scan.deconflicted``."""
    return F.expr(scan.deconflicted(spans))


def deconflict_rows(spans: DataFrame, *text: str) -> DataFrame:
    """The same over rows: drops a span whose end an earlier one of its text has reached.

    One window over each text's spans; no join of spans with spans.
    """
    order = [F.col("start"), F.col("end").desc(), F.col("score").desc(), F.col("specificity").desc(), F.col("entity_type")]
    before = Window.partitionBy(*text).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end").over(before)
    return spans.withColumn("__reached", reached).where(F.col("__reached").isNull() | (F.col("__reached") < F.col("end"))).drop("__reached")


_built: dict[tuple, tuple[Column, ...]] = {}


def _normalized() -> Column:
    """``normalize`` of the column ``__text``, built once."""
    key = (id(SparkContext._active_spark_context), "normalize")
    if key not in _built:
        _built[key] = (normalize(F.col("__text"), DIGITS),)
    return _built[key][0]


def _scan(policy: Policy, today: Column | None, entities: tuple[str, ...] | None) -> tuple[Column, Column, Column]:
    """The expressions of a scan: matches, their bases, spans. Built once for each policy, as a stream needs them for every micro-batch."""
    key = (id(SparkContext._active_spark_context), policy.fingerprint(), repr(policy.gazetteer), tuple(sorted(policy.entities)), repr(today), entities)
    if key not in _built:
        found = [r for r in recognizers(policy, today) if entities is None or r.entity in entities]
        if not found:
            none = F.expr(f"CAST(array() AS array<{scan.FOUND}>)")
            return none, none, none

        def base(m: Column) -> Column:
            out = F.when(m["r"] == 0, found[0].base(m["value"]))
            for k, r in enumerate(found[1:], 1):
                out = out.when(m["r"] == k, r.base(m["value"]))
            return m.withField("base", out)

        bases = F.filter(F.transform("__found", base), lambda m: m["base"].isNotNull())
        _built[key] = (F.expr(scan.matches(found)), F.when(F.size("__found") > 0, bases).otherwise(F.transform("__found", lambda m: m.withField("base", F.lit(None).cast("double")))), F.expr(scan.judged(found, policy)))
        while len(_built) > KEPT:
            del _built[next(iter(_built))]
    return _built[key]


def passing(spans: Column, policy: Policy) -> Column:
    """Spans of known entities at their threshold or above, in range, and not written by masking itself."""
    threshold = lambda s: _lookup(policy, lambda e: float(e.threshold), "double", s["entity_type"])

    def written(s: Column) -> Column:
        out = F.lit(False)
        for n, e in policy.entities.items():
            out = out | ((s["entity_type"] == n) & F.trim(s["value"]).isin(*sorted(e.vocabulary)))
        return out

    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & F.coalesce(s["score"] >= threshold(s), F.lit(False)) & ~written(s))


def detect(texts: DataFrame, policy: Policy, today: Column | None = None, extra: Column | None = None, entities: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``spans``: detected spans by place, with their values (never write these), and ``lang``.

    A narrow transformation: a row's spans stay in one array, so nothing
    shuffles. ``extra`` may add candidate spans from model taggers, in source
    places. ``entities`` are those asked for (default: all of the policy).
    Null and empty texts have no spans.
    """
    matches, bases, found = _scan(policy, today, entities)
    whole = texts.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    folded = whole.withColumn("__n", _normalized()).withColumns({"__folded": F.col("__n.text"), "__places": F.col("__n.offset_map")})
    kept = folded.withColumn("__digits", F.expr(scan.DIGITS_SIDE_BY_SIDE)).withColumn("__found", matches).withColumn("__judged", bases).withColumn("__found", found)
    if extra is not None:
        wanted = extra if entities is None else F.filter(extra, lambda s: s["entity_type"].isin(*entities))
        kept = kept.withColumn("__found", F.concat("__found", passing(wanted, policy)))
    out = kept.withColumn("spans", deconflict("__found")).drop("__found", "__judged", "__digits", "__text", "__n", "__folded", "__places")
    hint = F.col("lang_hint") if "lang_hint" in texts.columns else None
    return out.withColumn("lang", language(F.coalesce(F.col("text"), F.lit("")), hint))


def detect_distinct(texts: DataFrame, policy: Policy, today: Column | None = None) -> DataFrame:
    """``detect`` once for each distinct text, joined back by its hash: for chats that repeat themselves.

    Texts of more than HOT rows are told apart by a salt, so a text that a
    third of all rows share goes to as many tasks as its rows need. Their
    list has a row for each HOT rows at most, and its size is checked.
    """
    keyed = texts.withColumn("__key", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    distinct = keyed.groupBy("__key").agg(F.first(F.coalesce(F.col("text"), F.lit(""))).alias("text"), F.count("*").alias("__rows"))
    salts = F.expr(f"__rows div {HOT}L").alias("__salts")
    once = detect(distinct, policy, today).select("__key", "spans", "lang", F.explode_outer(F.sequence(F.lit(0).cast("long"), salts)).alias("__salt"))
    hot = keyed.groupBy("__key").agg(F.count("*").alias("__rows")).where(F.col("__rows") >= HOT).select("__key", salts)
    n_hot = hot.count()
    if n_hot:
        marked = keyed.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, "__key", "left")
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("__salts", F.lit(0).cast("long")) + 1)
        marked = marked.withColumn("__salt", salt).drop("__salts")
    else:
        marked = keyed.withColumn("__salt", F.lit(0).cast("long"))
    return marked.join(once, ["__key", "__salt"], "left").drop("__key", "__salt")
