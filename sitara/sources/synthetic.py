"""Synthetic identifiers and audit rows, as expressions over ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitara.functions import validators as v
from sitara.functions.text import let, to_arabic_digits

# Weights of the entities in synthetic audit rows.
WEIGHTS = {"EG_MOBILE": 28, "EMAIL_ADDRESS": 24, "AR_PERSON": 18, "EG_NATIONAL_ID": 12, "EG_ADDRESS": 8, "EG_IBAN": 5, "CREDIT_CARD": 3, "EG_PASSPORT": 2}


def national_id(n: Column, birth: Column) -> Column:
    """A valid national id from a number and a date of birth; the serial goes on where no check digit exists."""

    def at(k: Column) -> Column:
        code = F.element_at(F.array(*[F.lit(c) for c in list(v.GOVERNORATES)[:27]]), (F.pmod(n, F.lit(27)) + 1).cast("int"))
        century = F.when(F.year(birth) < 2000, "2").otherwise("3")
        return F.concat(century, F.date_format(birth, "yyMMdd"), code, F.lpad(F.pmod(k, F.lit(10_000)).cast("string"), 4, "0"))

    first, second = at(n), at(n + 1)
    whole = lambda stem: let(stem, lambda x: F.concat(x, v.nid_check_digit(x).cast("string")))
    return F.coalesce(whole(first), whole(second))


def mobile(n: Column) -> Column:
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("010", "011", "012", "015")]), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    return F.concat(prefix, F.lpad(F.pmod(n * 7919, F.lit(100_000_000)).cast("string"), 8, "0"))


def iban(n: Column) -> Column:
    bban = F.lpad((n * 104_729).cast("string"), 25, "0")
    return F.concat(F.lit("EG"), v.iban_check_digits(F.lit("EG"), bban), bban)


def tax_id(n: Column) -> Column:
    d = F.lpad(F.pmod(n * 7907 + 123_456_789, F.lit(1_000_000_000)).cast("string"), 9, "0")
    return F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 3))


def audit_rows(ids: DataFrame, users: int = 40, days: int = 14, end: str = "2026-09-19 12:00:00", seed: int = 7) -> DataFrame:
    """Background rows, one for each of ``ids`` (a column id); one user's bulk paste of 60 values in 3 requests, and one value that all users share."""
    spark, total = ids.sparkSession, sum(WEIGHTS.values())
    n = ids.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    u = lambda k: drawn(seed, f"audit {k}") / float(1 << 32)
    until, upto, entity = F.lit(end).cast("timestamp"), 0, F.lit(None).cast("string")
    for name, w in reversed(WEIGHTS.items()):
        upto += w
        entity = F.coalesce(entity, F.when(u(1) < upto / total, F.lit(name)))
    base = ids.select(
        "id", entity.alias("entity_type"), F.concat(F.lit("user-"), F.floor(u(2) * users)).alias("user_id"), F.concat(F.lit("req-"), "id").alias("request_id"), F.substring(F.sha2(F.concat(F.lit("v"), F.floor(u(3) * n / 2)), 256), 1, 16).alias("value_fp"), F.timestamp_seconds(F.unix_timestamp(until) - F.floor(u(4) * days * 86_400)).alias("ts")
    )
    paste = spark.range(60).select((F.col("id") + n).alias("id"), F.lit("EG_NATIONAL_ID"), F.lit("user-7"), F.concat(F.lit("paste-"), F.floor(F.col("id") / 20)), F.substring(F.sha2(F.concat(F.lit("p"), "id"), 256), 1, 16), until)
    shared = spark.range(users).select((F.col("id") + n + 60).alias("id"), F.lit("EG_MOBILE"), F.concat(F.lit("user-"), "id"), F.concat(F.lit("shared-"), "id"), F.lit("5a" * 8), F.timestamp_seconds(F.unix_timestamp(until) - F.col("id") * 3600))
    rows = base.union(paste).union(shared)
    return rows.select("id", "ts", "request_id", "user_id", "entity_type", F.lit("MASK").alias("action"), F.lit(0.9).alias("score"), "value_fp")


def seed(rows: DataFrame, table: str) -> None:
    """Writes rows as a new table; a table that is there already is left as it is, with an error."""
    rows.write.mode("errorifexists").parquet(table)


# Sentence shapes of the benchmark corpus.
TEMPLATES = {
    "arabic": ("رقم قومي {nid} للمريض", "موبايل العميل {mobile}", "العنوان 12 شارع الهرم، الجيزة", "الحساب البنكي {iban}"),
    "latin": ("please call {mobile} about the account", "national id {nid} on file", "wire to {iban} today", "tax id {tax}"),
    "mixed": ("العميل called from {mobile}", "رقم قومي {nid} please verify", "account {iban} حساب"),
}


def drawn(seed: int, what: str) -> Column:
    """A number below 2**32 by seed, purpose and the column id; other engines can compute it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} {what} "), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")


def corpus(ids: DataFrame, seed: int = 7) -> DataFrame:
    """Texts of four corpora, one of each of the first three for each of ``ids`` (a column id; the fourth joins 40 of the others); two fifths of those with Arabic letters have Arabic digits."""
    ids = ids.withColumn("birth", F.date_add(F.lit("1960-01-01").cast("date"), F.pmod(F.col("id") * 37, F.lit(15_000)).cast("int")))
    ids = ids.withColumns({"nid": national_id(F.col("id"), F.col("birth")), "mobile": mobile(F.col("id")), "iban": iban(F.col("id")), "tax": tax_id(F.col("id"))})
    made = []
    for kind, shapes in TEMPLATES.items():
        shape = F.get(F.array(*[F.lit(s) for s in shapes]), F.pmod(drawn(seed, kind), F.lit(len(shapes))).cast("int"))
        for name in ("nid", "mobile", "iban", "tax"):
            shape = F.replace(shape, F.lit("{" + name + "}"), F.col(name))
        made.append(F.struct(F.lit(kind).alias("corpus"), "id", shape.alias("text")))
    out = ids.select(F.inline(F.array(*made)))
    turned = F.when(F.contains("text", F.lit("ا")) & (F.pmod(drawn(seed, "digits"), F.lit(5)) < 2), to_arabic_digits(F.col("text"))).otherwise(F.col("text"))
    out = out.withColumn("text", turned)
    long = out.groupBy(F.lit("long").alias("corpus"), F.floor(F.col("id") / 14).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "corpus", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return out.union(long)
