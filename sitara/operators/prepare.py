"""From detected spans to what may be kept: fingerprints, previews, replacements; masking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.functions import validators as v
from sitara.functions.text import fold, let, normalize, splice
from sitara.operators import scan
from sitara.sources.policy import Policy, PolicyError

FINGERPRINT_DIGITS = 16
#: Secrets that stand in examples and must not be used.
EXAMPLE_PEPPERS = frozenset(("change-me", "changeme", "example", "please-change-this-pepper-before-use"))
_DIGITS = ("EG_NATIONAL_ID", "EG_TAX_ID", "CREDIT_CARD")
_IBANS = ("EG_IBAN", "IBAN_CODE")


def check_pepper(pepper: str | None, strict: bool = True) -> bytes:
    """The pepper's bytes; refuses none at all, and, if strict, short or example ones."""
    if not pepper:
        raise PolicyError("fingerprints need a pepper")
    if strict and (len(pepper) < 32 or pepper.lower() in EXAMPLE_PEPPERS):
        raise PolicyError("the pepper is too short or an example")
    return pepper.encode()


def _word_form(folded: Column) -> Column:
    return F.trim(F.regexp_replace(fold(folded), r"[^0-9a-z\x{0600}-\x{06FF}]+", " "))


def canonical(entity: Column, folded: Column) -> Column:
    """The form of a DIGITS-folded value that its fingerprint is made of: one for all ways to write it."""
    plain = v.digits(folded)
    mobile = F.coalesce(v.mobile_e164(folded), plain)
    iban = F.upper(F.regexp_replace(folded, "[^A-Za-z0-9]", ""))
    return F.when(entity.isin(*_DIGITS), plain).when(entity == "EG_MOBILE", mobile).when(entity.isin(*_IBANS), iban).otherwise(_word_form(folded))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC of text in hexadecimal, from nested SHA-256. The derived pads are as secret as the key: redact plans."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def fingerprint(entity: Column, folded: Column, pepper: bytes) -> Column:
    """16 hexadecimal digits; null for a value that its canonical form empties."""
    if not pepper:
        raise PolicyError("fingerprints need a pepper")
    return let(canonical(entity, folded), lambda form: F.when(form != "", F.substring(hmac_sha256(form, pepper), 1, FINGERPRINT_DIGITS)))


def preview(value: Column, mode: str, first: int = 0, last: int = 0) -> Column:
    """A value with its middle hidden, as long as itself; null if nothing would be hidden."""
    if mode == "none":
        return F.lit(None).cast("string")
    first = first if mode == "first_last" else 0
    hidden = F.char_length(value) - first - last
    tail = F.right(value, F.lit(last)) if last else F.lit("")
    return F.when(hidden >= 1, F.concat(F.substring(value, 1, first), F.repeat(F.lit("*"), hidden), tail))


def surrogate(fp: Column, pool: tuple[str, ...]) -> Column:
    """The member of the pool that a fingerprint picks."""
    at = F.pmod(F.conv(fp, 16, 10).cast("decimal(20,0)"), F.lit(len(pool)).cast("decimal(20,0)")).cast("int")
    return F.get(F.array(*[F.lit(p) for p in pool]), at)


def replacement(fp: Column, mark: str, strategy: str, value: str | None = None, pool: tuple[str, ...] = (), chars: int = 8) -> Column:
    """What stands for a value. A labelled fingerprint goes inside the placeholder's own bracket."""
    if strategy == "redact":
        return F.lit("")
    if strategy == "constant":
        return F.lit(value)
    if strategy == "labelled_fingerprint":
        closing = mark[-1] if mark[-1:] in (">", "]", ")", "}") else ""
        stem = mark.removesuffix(closing) if closing else mark
        return F.when(fp.isNotNull(), F.concat(F.lit(f"{stem}:"), F.substring(fp, 1, chars), F.lit(closing))).otherwise(F.lit(mark))
    if strategy == "surrogate":
        return F.coalesce(surrogate(fp, pool), F.lit(mark))
    return F.lit(mark)


def _by_entity(policy: Policy, entity: Column, make, default: Column) -> Column:
    out = None
    for n, e in policy.entities.items():
        out = F.when(entity == n, make(e)) if out is None else out.when(entity == n, make(e))
    return out.otherwise(default)


#: Expressions that prepare spans, by policy: a stream needs them for every micro-batch.
_built: dict[tuple, Column] = {}
KEPT = 64


def _once(key: tuple, make: Callable[[], Column]) -> Column:
    """The expression of a key, built at its first use."""
    key = (id(SparkContext._active_spark_context), *key)
    if key not in _built:
        _built[key] = make()
        while len(_built) > KEPT:
            del _built[next(iter(_built))]
    return _built[key]


def prepare(found: DataFrame, policy: Policy, pepper: bytes) -> DataFrame:
    """Spans without their values, and ``masked``, ``blocked``, ``entity_counts``, ``block_reasons``.

    Each span gets category, value_len, value_fp, preview and replacement;
    the value goes here. Partly overlapping spans to mask are joined before
    the text is cut, so masking never fails.
    """

    def one(s: Column) -> Column:
        # Folding a detected value: its characters are those of a folded text, or their sources.
        return let(let(_fold_native(s["value"]), lambda v: fingerprint(s["entity_type"], v, pepper)), lambda fp: kept(s, fp))

    def kept(s: Column, fp: Column) -> Column:
        shown = _by_entity(policy, s["entity_type"], lambda e: preview(s["value"], e.preview.mode, e.preview.first, e.preview.last), F.lit(None).cast("string"))
        stands = _by_entity(policy, s["entity_type"], lambda e: replacement(fp, e.mark, e.replacement.strategy, e.replacement.value, e.replacement.pool, e.replacement.fingerprint_chars), F.concat(F.lit("<"), s["entity_type"], F.lit(">")))
        category = _by_entity(policy, s["entity_type"], lambda e: F.lit(e.category), F.lit("other"))
        fields = {n: s[n] for n in ("start", "end", "entity_type", "recognizer", "score", "context_term", "action")}
        fields |= {"category": category, "value_len": F.char_length(s["value"]), "value_fp": fp, "preview": shown, "replacement": stands}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    key = (policy.fingerprint(), tuple(sorted(policy.entities)), hashlib.sha256(pepper or b"").digest())
    out = found.withColumn("spans", _once(key, lambda: F.transform("spans", one)))
    blocks = lambda: F.filter("spans", lambda s: s["action"] == "BLOCK")
    made = {"blocked": lambda: F.size(blocks()) > 0, "entity_counts": lambda: counts(F.col("spans")), "block_reasons": lambda: F.when(F.size(blocks()) > 0, counts(blocks()))}
    return masked(out).withColumns({n: _once((n,), make) for n, make in made.items()})


def _fold_native(value: Column) -> Column:
    """DIGITS fold of a short value without Python: invisible characters go, digits of all widths become ASCII."""
    from sitara.functions.text import _INVISIBLE_CLASS, DIGITS_FROM, DIGITS_TO

    wide = "".join(chr(0xFF10 + d) for d in range(10)) + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
    plain = "0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(value, f"[{_INVISIBLE_CLASS}]", ""), DIGITS_FROM + wide, DIGITS_TO + plain)


def counts(spans: Column) -> Column:
    """Map of entity to number of spans."""
    names = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"])))
    entity = F.transform(spans, lambda s: s["entity_type"])
    return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(entity, lambda e: e == n))))


def masked(texts: DataFrame, text: str = "text", spans: str = "spans", name: str = "masked") -> DataFrame:
    """Adds the text with all MASK spans replaced; null stays null. Partly overlapping spans go as one, under the first one's replacement."""
    cut = lambda: F.transform(F.filter(spans, lambda s: s["action"] == "MASK"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))
    whole = lambda: F.when(F.col(text).isNotNull(), F.when(F.size("__cut") > 0, splice(F.col(text), F.expr(scan.joined("__cut")))).otherwise(F.col(text)))
    return texts.withColumn("__cut", _once(("cut", spans), cut)).withColumn(name, _once(("whole", text), whole)).drop("__cut")


def findings(prepared: DataFrame, *keep: str) -> DataFrame:
    """A row per span, without values.

    The generator is an outer one: below an inner one the optimizer puts a
    test of the spans' size, and with it the whole detection once more.
    """
    return prepared.select(*keep, F.inline_outer("spans")).where(F.col("entity_type").isNotNull())


def entity_totals(prepared: DataFrame, *by: str) -> DataFrame:
    """Number of spans by entity and the given columns."""
    return findings(prepared, *by).groupBy(*by, "entity_type").agg(F.count("*").alias("n"))


def policy_view(spark: SparkSession, policy: Policy, example_fp: str = "9f75871d3d222bcb") -> DataFrame:
    """Entities with a worked example of what masking writes."""
    rows = policy.rows(spark)
    fp = F.lit(example_fp)
    shown = _by_entity(policy, F.col("entity_type"), lambda e: replacement(fp, e.mark, e.replacement.strategy, e.replacement.value, e.replacement.pool, e.replacement.fingerprint_chars), F.lit(None))
    return rows.select("entity_type", "category", "action", "threshold", "placeholder", "strategy", shown.alias("example"))


def normalized(texts: DataFrame, profile) -> DataFrame:
    """Adds ``normalized`` (text, offset_map)."""
    return texts.withColumn("normalized", normalize(F.col("text"), profile))
