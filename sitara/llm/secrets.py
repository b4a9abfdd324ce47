"""Secret scans: fixed patterns, and two character Markov models (DataFrame functions only).

One model describes random strings, the other ordinary words and identifiers;
both are counts of character pairs over labelled samples. A run of key-like
characters whose log-likelihood ratio speaks for the random model is a secret,
in addition to the spans of the fixed patterns. How far it must speak for it
is chosen on samples that the models were not trained on, so that ordinary
strings rarely pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitara.functions.text import laid_out, let
from sitara.llm.common import fresh_name, hash_sample, materialize, pick_columns, release, words

# Fixed patterns: kind, pattern, group whose length counts, least length. In the order of ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
#: The same spans as the patterns above with their least length, where the group is the whole match.
_SCAN = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Rows without this have no span of the kind; cheaper than cutting the text.
_GUARD = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}

#: Strings that the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Random by nature, but names of things: no secrets.
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate is a secret if the ratio exceeds a threshold, and another times its length. Both are the quantiles that let
#: FALSE_ALARMS of the ordinary held-out strings of 16 characters and more pass, but not below PRIOR and PER_CHAR (natural log).
FALSE_ALARMS = 0.0005
PRIOR = 8.0
PER_CHAR = 0.35
#: Every so-manieth string of a sample, by hash, is held out.
HELD_OUT = 5
#: A secret has so many different characters at least; runs of a few characters are ornament.
DISTINCT = 8
#: Pseudo-counts of each character pair: contexts that a sample hardly holds say little.
PSEUDO = 5.0
# Common words of program text, of which sample identifiers are made.
PROGRAM_WORDS = (
    "access action active add address after agent array async auth base batch before block body byte cache call change char check child class clear client close code "
    "column command commit connect content context control copy create cursor database date debug delete description device disable document domain driver edge element "
    "enable encode end entry error event exception execute export factory field file filter find first flag folder format frame function generator get global graph group "
    "handle hash header height host identifier image import initialize insert instance integer interface item iterator key label language last layer length level library "
    "limit line link list load local location lock log loop main make map match max member memory merge message method min model module name network next node number "
    "object offset open operation option order output package page parent parse password path pattern pause payload pending person phone pixel plugin point policy pool port position "
    "prefix previous price print priority private process product profile program project property protocol provider proxy public query queue random range rate read reader record "
    "reference refresh region register release remote remove render replace report request require reset resource response result retry return role root route rule schedule schema "
    "scope screen script search section select sender sequence serial server service session setting shadow shape share signal single size socket sort source space split stack start "
    "state static status storage store stream string style submit subscribe success suffix summary support switch symbol sync system table target task template test text thread time "
    "timeout title token topic total trace track transaction transfer transform trigger type unique unit update upload user utility valid validate value variable vector version view "
    "virtual visible volume warning weight widget width window worker wrapper write zone"
).split()
#: Documents whose words are the sample of ordinary strings, at most; and random strings made.
SAMPLE_DOCS = 500
RANDOM_STRINGS = 4000


def matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All leftmost matches with their places in code points: array of (start, kind_rank, end, kind, value)."""
    # A trailing blank keeps split from treating a match at the end as special.
    places = laid_out(F.split(F.concat(text, F.lit("\n")), pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.transform(places, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def base_spans(text: Column, kind: str) -> Column:
    rank = [b[0] for b in BASE].index(kind)
    _, _, group, least = BASE[rank]
    spans = matches(text, _SCAN[kind], kind, rank)
    if group:
        spans = F.filter(spans, lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, group)) >= least)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(_GUARD[kind]), spans).otherwise(none)


# --- the models ----------------------------------------------------------------


def samples(docs: DataFrame, labels: DataFrame, most_docs: int = SAMPLE_DOCS, strings: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled strings (random boolean, value): random keys, and ordinary words, identifiers, paths and addresses.

    Random strings are SHA-256 digests of a counter, in hexadecimal and base64,
    whole and without signs or cases. Ordinary strings are the words of the
    documents of at most ``most_docs`` labels of good quality (those whose
    ids have the least hashes), alone and joined to the word after them, and
    common words of program text, joined as names in code, paths and
    addresses are.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    forms = F.array(F.substring(digest, 1, 40), base64, F.regexp_replace(base64, "[+/]", ""), F.upper(F.regexp_replace(base64, "[+/]", "")), F.lower(F.regexp_replace(base64, "[+/]", "")))
    random = spark.range(strings).select(F.lit(True).alias("random"), F.explode(forms).alias("value"))
    good = labels.where((F.col("quality") > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    good = hash_sample(good, F.xxhash64("good_id"), most_docs)
    some = docs.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left_semi").select("text")
    kept = F.array_distinct(F.transform(words(F.col("text")), lambda w: F.regexp_replace(w, "[^A-Za-z0-9+/_=-]", "")))
    after = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(ws, i + 1), w).alias("x")))
    plain = some.select(kept.alias("ws")).select(F.inline(after(F.col("ws")))).where(F.length("w") >= 2)
    low, next_ = F.lower("w"), F.lower("x")
    joined = F.array(F.col("w"), F.concat_ws("_", low, next_), F.concat(low, F.initcap("x")), F.upper(F.concat_ws("_", "w", "x")), F.concat_ws("-", low, next_), F.concat(low, F.lit("/"), next_, F.lit("1")), F.concat_ws("-", low, next_, low))
    one = lambda name: F.explode(F.array(*[F.lit(w) for w in PROGRAM_WORDS])).alias(name)
    two = spark.range(1).select(one("a")).select("a", one("b"))
    names = F.array(F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat(F.initcap("a"), F.initcap("b")), F.concat_ws("-", "a", "b"), F.upper(F.concat_ws("_", "a", "b")), F.concat(F.lit("/"), "a", F.lit("/"), "b", F.lit("/v2/"), "a"), F.concat("a", F.lit("="), "b", F.lit("-2024-01-15")))
    return random.union(plain.select(F.lit(False), F.explode(joined))).union(two.select(F.lit(False), F.explode(names)))


def train(strings: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, a flat table of the alphabet's square.

    Characters are counted in Spark; a count for each pair and label, at most
    twice the square of the alphabet, reaches the driver.
    """
    n = len(ALPHABET)
    at = F.sequence(F.lit(1), F.char_length("value") - 1)
    pairs = strings.where(F.char_length("value") >= 2).select("random", "value", F.explode(at).alias("i"))
    pairs = pairs.select("random", F.expr("substring(value, i, 1)").alias("a"), F.expr("substring(value, i + 1, 1)").alias("b"))
    rows = pairs.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()
    counts = {True: [PSEUDO] * (n * n), False: [PSEUDO] * (n * n)}
    for r in rows:
        if r.a in ALPHABET and r.b in ALPHABET:
            counts[r.random][ALPHABET.index(r.a) * n + ALPHABET.index(r.b)] += r.n
    rate = {}
    for label, c in counts.items():
        rate[label] = [x / sum(c[i - i % n : i - i % n + n]) for i, x in enumerate(c)]
    return [round(math.log(a / b), 6) for a, b in zip(rate[True], rate[False], strict=True)]


def ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a candidate: random against ordinary."""
    n = len(ALPHABET)
    weights = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folds to a constant
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(weights, a * n + b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class Model:
    """Ratios of character pairs, and the thresholds of a candidate's ratio: as such, and for each character."""

    table: list[float]
    prior: float
    per_char: float


def calibrate(strings: DataFrame, table: list[float], false_alarms: float = FALSE_ALARMS) -> Model:
    """The thresholds that so large a share of ordinary strings (those a scan would judge) passes each of."""
    judged = strings.where(~F.col("random") & F.col("value").rlike(f"^{CANDIDATE}$")).select(ratio(F.col("value"), table).alias("r"), F.char_length("value").alias("n"))
    q = judged.agg(F.percentile("r", F.lit(1 - false_alarms)).alias("prior"), F.percentile(F.col("r") / F.col("n"), F.lit(1 - false_alarms)).alias("per_char")).first()
    return Model(table, round(max(PRIOR, q["prior"] or PRIOR), 6), round(max(PER_CHAR, q["per_char"] or PER_CHAR), 6))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """All rows of ``docs`` with ``secret_spans``: array of (start, rank, end, kind, value), by start, then kind.

    Kinds are assign, access, hex and markov; a markov span overlaps none of
    the others. Null and empty texts have none. Values stay in the array for
    masking; drop them before writing a report. Other columns, and repeated
    rows, stay as they are; a column named secret_spans is replaced.
    """
    pick_columns(docs, "text")
    base_name, keep = fresh_name(docs, "base"), [c for c in docs.columns if c.lower() != "secret_spans"]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[base_spans(text, kind) for kind, *_ in BASE])
    marked = docs.withColumn(base_name, base)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    more = F.filter(
        matches(text, CANDIDATE, "markov", len(BASE)),
        lambda s: ~F.exists(F.col(base_name), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & is_random(s["value"], model),
    )
    more = F.when(text.rlike(CANDIDATE), more).otherwise(none)
    return marked.select(*[F.col(f"`{c}`") for c in keep], F.array_sort(F.concat(F.col(base_name), more)).alias("secret_spans"))


def is_random(value: Column, model: Model) -> Column:
    """Whether a candidate is a random string; UUIDs and numbers (runs without a letter) are none."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT
    said = let(ratio(value, model.table), lambda r: (r > model.prior) & (r > F.char_length(value) * model.per_char))
    return varied & said & value.rlike("[A-Za-z]") & ~value.rlike(UUID)


def spans_text(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Ratios from four fifths of the labelled samples, thresholds from the rest.

    Without labels, or good ones, the ordinary strings are those of program
    words alone.
    """
    strings = materialize(samples(docs, labels).withColumn("held", F.pmod(F.xxhash64("value"), F.lit(HELD_OUT)) == 0), "secret-samples")
    model = calibrate(strings.where("held"), train(strings.where("NOT held").select("random", "value")))
    release(strings)
    return model
