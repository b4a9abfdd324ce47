"""Queries over whole tables with planted identifiers: what each recognizer finds, where, how sure and why.

Texts are SQL strings over keys that Spark and DuckDB read alike. The SQL of
a query says from the keys alone what must be found; it holds no pattern of
a recognizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.functions.text import DIACRITICS, DIGITS, GAZETTEER, INVISIBLE, LETTERS_FROM, LETTERS_TO, NAMES, TATWEEL, dominant_script, fold, normalize, script_segments, snippet, spans_of
from sitara.operators import conversations, evaluate, models, prepare
from sitara.operators.detect import detect, detect_distinct
from sitara.operators.recognizers import context_term
from sitara.plans.queries import _EMAIL, PEPPER, dealt, only, query, table, today
from sitara.sources.policy import CONTEXT, Policy, baseline, folded_terms, overlay, overlay_table

K = "c_custkey"
_ARABIC = "٠١٢٣٤٥٦٧٨٩"


def _digits(n: str, width: int) -> str:
    return f"lpad(CAST({n} AS STRING), {width}, '0')"


def _pick(n: str, *values: str) -> str:
    """One of some SQL strings by a number."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {n} % {len(values)} {cases} END"


def _texts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer"), K).select(K, F.expr(text).alias("text"))


def _found(texts: DataFrame, *entities: str, key: str = K) -> DataFrame:
    p = only(*entities)
    rows = detect(texts, p, today()).select(key, F.explode_outer("spans").alias("s")).where(F.col("s").isNotNull())
    return rows.select(key, "s.start", "s.end", F.round("s.score", 6).alias("score"), F.col("s.context_term").alias("term"), F.md5("s.value").alias("value_md5"))


def _expected(lead: str, value: str, tail: str, score: str, term: str, where: str, also: str = "") -> str:
    """Rows of what must be found: a value after its lead."""
    return f"""SELECT {K}, CAST(length(lead) AS INT) AS start, CAST(length(lead) + length(v) AS INT) AS "end", CAST({score} AS DOUBLE) AS score, term, md5(v) AS value_md5
  FROM (SELECT {K}, {lead} AS lead, {value} AS v, {term} AS term{also} FROM customer) WHERE {where}""".replace("DECIMAL(38,0)", "HUGEINT")


# --- national ids ------------------------------------------------------------------
# Days 1 to 28 and months 1 to 12 are dates; a third has Arabic digits, a seventh a hidden character inside.

_NID_STEM = f"'2' || {_digits(f'50 + {K} % 50', 2)} || {_digits(f'{K} % 14', 2)} || {_digits(f'1 + {K} % 28', 2)} || {_digits(f'{K} % 40', 2)} || {_digits(f'{K} * 31 % 10000', 4)}"
_NID_LAST = f"{K} * 7 % 11"
_NID_PLAIN = f"{_NID_STEM} || CAST({_NID_LAST} % 10 AS STRING)"
_NID_SHOWN = f"CASE WHEN {K} % 3 = 0 THEN translate({_NID_PLAIN}, '0123456789', '{_ARABIC}') WHEN {K} % 7 = 1 THEN substr({_NID_PLAIN}, 1, 5) || '‍' || substr({_NID_PLAIN}, 6) ELSE {_NID_PLAIN} END"
_NID_LEAD = _pick(K, "'national id: '", "'ref '", "'nid ' || repeat('z', 80) || ' '", "'الرقم القومي '", "'‎no. '")
_NID_TERM = f"CASE {K} % 5 WHEN 0 THEN 'national id' WHEN 3 THEN 'الرقم القومي' END"
_NID_TAIL = f"CASE WHEN {K} % 11 = 5 THEN '4' ELSE ' end' END"
_NID_SUM = " + ".join(f"CAST(substr(plain, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate((2, 7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)))


@query(
    _expected(
        _NID_LEAD,
        _NID_SHOWN,
        _NID_TAIL,
        f"CASE WHEN term IS NOT NULL OR (11 - ({_NID_SUM}) % 11) % 11 = CAST(substr(plain, 14, 1) AS INT) THEN 1.0 ELSE 0.85 END",
        _NID_TERM,
        f"{K} % 11 <> 5 AND {K} % 14 BETWEEN 1 AND 12 AND {K} % 40 BETWEEN 1 AND 35",
        f", {_NID_PLAIN} AS plain",
    )
)
def recognize_national_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National ids with and without context, in Arabic digits, with hidden characters, too long, of no date or region."""
    return _found(_texts(spark, sf_dir, f"{_NID_LEAD} || {_NID_SHOWN} || {_NID_TAIL}"), "EG_NATIONAL_ID")


# --- mobile numbers ----------------------------------------------------------------

_M8 = _digits(f"{K} * 7919 % 100000000", 8)
_M2 = _pick(K, "'0'", "'1'", "'2'", "'5'")
_MOBILE = _pick(
    K,
    f"'01' || {_M2} || {_M8}",
    f"'+20 1' || {_M2} || ' ' || substr({_M8}, 1, 4) || ' ' || substr({_M8}, 5, 4)",
    f"'0020-1' || {_M2} || '-' || substr({_M8}, 1, 4) || '-' || substr({_M8}, 5, 4)",
    f"'01' || {_M2} || '-' || substr({_M8}, 1, 4) || '.' || substr({_M8}, 5, 4)",
    f"'013' || {_M8}",
    f"'20.1' || {_M2} || {_M8}",
    f"'901' || {_M2} || {_M8}",
)
_MOBILE_LEAD = f"CASE {K} % 9 WHEN 0 THEN 'phone ' WHEN 1 THEN 'موبايل: ' ELSE 'see ' END"


@query(
    _expected(
        _MOBILE_LEAD,
        _MOBILE,
        "",
        f"CASE WHEN term IS NULL THEN CASE WHEN {K} % 7 IN (0, 3) THEN 0.6 ELSE 0.7 END ELSE CASE WHEN {K} % 7 IN (0, 3) THEN 0.95 ELSE 1.0 END END",
        f"CASE {K} % 9 WHEN 0 THEN 'phone' WHEN 1 THEN 'موبايل' END",
        f"{K} % 7 NOT IN (4, 6)",
    )
)
def recognize_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile numbers in five written forms, one with a wrong prefix and one inside a longer number."""
    return _found(_texts(spark, sf_dir, f"{_MOBILE_LEAD} || {_MOBILE} || ' now'"), "EG_MOBILE")


# --- accounts ----------------------------------------------------------------------

_BBAN = f"lpad(CAST({K} * 104729 AS STRING), 25, '0')"
_CHECK = f"lpad(CAST(98 - CAST((CAST({_BBAN} || '141600' AS DECIMAL(38,0)) % 97) AS INT) AS STRING), 2, '0')"
_IBAN_PLAIN = f"'EG' || {_CHECK} || {_BBAN}"
_IBAN = _pick(
    K,
    _IBAN_PLAIN,
    f"lower({_IBAN_PLAIN})",
    f"'EG' || {_CHECK} || ' ' || substr({_BBAN}, 1, 4) || ' ' || substr({_BBAN}, 5, 8) || '-' || substr({_BBAN}, 13, 13)",
    f"'EG' || {_CHECK} || substr({_BBAN}, 1, 24) || CAST((CAST(substr({_BBAN}, 25, 1) AS INT) + 1) % 10 AS STRING)",
    f"{_IBAN_PLAIN} || '7'",
)
_IBAN_LEAD = f"CASE {K} % 4 WHEN 0 THEN 'account ' WHEN 1 THEN 'حساب ' ELSE 'pay ' END"


@query(_expected(_IBAN_LEAD, _IBAN, "", "CASE WHEN term IS NULL THEN 0.8 ELSE 1.0 END", f"CASE {K} % 4 WHEN 0 THEN 'account' WHEN 1 THEN 'حساب' END", f"{K} % 5 < 3"))
def recognize_eg_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Egyptian account numbers plain, in lower case and in groups; with a wrong digit and one too long."""
    return _found(_texts(spark, sf_dir, f"{_IBAN_LEAD} || {_IBAN} || ' today'"), "EG_IBAN")


# 'GB' is 1611 in numbers; the account is of digits.
_GB = f"lpad(CAST({K} * 7907 AS STRING), 18, '0')"
_GB_CHECK = f"lpad(CAST(98 - CAST((CAST({_GB} || '161100' AS DECIMAL(38,0)) % 97) AS INT) AS STRING), 2, '0')"
_GB_IBAN = _pick(K, f"'GB' || {_GB_CHECK} || {_GB}", f"'GB' || {_GB_CHECK} || ' ' || substr({_GB}, 1, 4) || ' ' || substr({_GB}, 5, 14)", f"'GB' || {_GB_CHECK} || substr({_GB}, 1, 17) || CAST((CAST(substr({_GB}, 18, 1) AS INT) + 1) % 10 AS STRING)")


@query(_expected("'wire to '", _GB_IBAN, "", "1.0", "CAST(NULL AS STRING)", f"{K} % 3 < 2"))
def recognize_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """International account numbers; every third with a wrong digit."""
    return _found(_texts(spark, sf_dir, f"'wire to ' || {_GB_IBAN} || '.'"), "IBAN_CODE")


# --- numbers that need context -------------------------------------------------------

_T9 = _digits(f"{K} * 7907 % 899999999 + 100000000", 9)
_TAX = _pick(
    f"CAST(floor({K} / 4) AS BIGINT)",
    f"substr({_T9}, 1, 3) || '-' || substr({_T9}, 4, 3) || '-' || substr({_T9}, 7, 3)",
    _T9,
    f"substr({_T9}, 1, 3) || '/' || substr({_T9}, 4, 3) || '/' || substr({_T9}, 7, 3)",
    "'333-333-333'",
    f"'-' || {_T9}",
)
_TAX_LEAD = _pick(K, "'tax id '", "'order '", "'tax registration ' || repeat('y', 70) || ' '", "'الرقم الضريبي '")
_TAX_FORM = f"CAST(floor({K} / 4) AS BIGINT) % 5"


@query(_expected(_TAX_LEAD, _TAX, "", "0.65", f"CASE {K} % 4 WHEN 0 THEN 'tax id' WHEN 3 THEN 'الرقم الضريبي' END", f"term IS NOT NULL AND {_TAX_FORM} < 2 AND regexp_replace(v, '[^0-9]', '', 'g') NOT IN ('111111111', '222222222', '444444444', '555555555', '666666666', '777777777', '888888888', '999999999')"))
def recognize_tax_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax ids count only with context near by; other separators, equal digits and longer numbers do not."""
    return _found(_texts(spark, sf_dir, f"{_TAX_LEAD} || {_TAX} || ' x'"), "EG_TAX_ID")


_PASSPORT = _pick(f"CAST(floor({K} / 3) AS BIGINT)", f"'A' || {_digits(f'{K} * 7919 % 100000000', 8)}", f"'a' || {_digits(f'{K} * 7919 % 100000000', 8)}", f"'Z' || {_digits(f'{K} * 7919 % 100000000', 8)}", f"'B' || {_digits(f'{K}', 9)}")
_PASSPORT_LEAD = _pick(K, "'passport '", "'build '", "'جواز سفر '")


@query(_expected(_PASSPORT_LEAD, _PASSPORT, "", "0.65", f"CASE {K} % 3 WHEN 0 THEN 'passport' WHEN 2 THEN 'جواز' END", f"term IS NOT NULL AND CAST(floor({K} / 3) AS BIGINT) % 4 IN (0, 2)"))
def recognize_passport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passports: one capital letter and eight digits, with context."""
    return _found(_texts(spark, sf_dir, f"{_PASSPORT_LEAD} || {_PASSPORT} || ' ok'"), "EG_PASSPORT")


_STREET = f"CASE WHEN {K} % 3 = 0 THEN CAST({K} % 90 + 1 AS STRING) || ' ' ELSE '' END || 'شارع النور رقم ' || CAST({K} AS STRING)"
_PLACE = f"CASE WHEN {K} % 4 < 2 THEN '، الجيزة' ELSE '' END"
_ADDRESS_LEAD = f"CASE WHEN {K} % 5 < 2 THEN 'السكن: ' WHEN {K} % 5 = 2 THEN 'السكن ' || repeat('ب', 60) || ' ' ELSE 'قرب ' END"


@query(_expected(_ADDRESS_LEAD, f"{_STREET} || {_PLACE}", "", f"CASE WHEN term IS NOT NULL AND {K} % 4 < 2 THEN 1.0 WHEN term IS NOT NULL THEN 0.8 ELSE 0.65 END", f"CASE WHEN {K} % 5 < 2 THEN 'السكن' END", f"term IS NOT NULL OR {K} % 4 < 2"))
def recognize_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by street marker; a place named in them, or context, makes them sure enough."""
    return _found(_texts(spark, sf_dir, f"{_ADDRESS_LEAD} || {_STREET} || {_PLACE} || '. ثم كلام'"), "EG_ADDRESS")


# --- folds and context ---------------------------------------------------------------

_WRITTEN = f"c_name || ' {_ARABIC[3]}' || translate(CAST({K} AS STRING), '0123456789', '{_ARABIC}') || ' مُحَمّد أحمد ـ مصطفى' || CASE WHEN {K} % 2 = 0 THEN '​' ELSE '' END || 'ة'"
_ASCII = f"translate(t, '{_ARABIC}۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"
_HIDDEN = "[" + "".join(map(chr, INVISIBLE)) + "]"
_MARKS = "[" + chr(TATWEEL) + "".join(f"{chr(a)}-{chr(b)}" for a, b in DIACRITICS) + "]"


@query(
    f"""SELECT {K}, d AS digits, n AS names, translate(n, '{LETTERS_FROM}', '{LETTERS_TO}') AS gazetteer,
  array_to_string(list_filter(range(length(t)), lambda i: NOT regexp_matches(substr(t, i + 1, 1), '{_HIDDEN}')), ',') AS places
  FROM (SELECT *, regexp_replace(d, '{_MARKS}', '', 'g') AS n FROM (SELECT *, regexp_replace({_ASCII}, '{_HIDDEN}', '', 'g') AS d FROM (SELECT {K}, {_WRITTEN} AS t FROM customer)))"""
)
def normalize_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three folds of names in Arabic writing forms, and the places that characters came from."""
    rows = _texts(spark, sf_dir, _WRITTEN)
    out = rows.withColumns({p.name: normalize(F.col("text"), p) for p in (DIGITS, NAMES, GAZETTEER)})
    every = F.transform(F.sequence(F.lit(1), F.char_length("text")), lambda i: i - 1)
    places = F.coalesce(F.col("digits.offset_map"), every)
    return out.select(K, F.col("digits.text").alias("digits"), F.col("names.text").alias("names"), F.col("gazetteer.text").alias("gazetteer"), F.array_join(places, ",").alias("places"))


_CTX = f"repeat('a ', {K} % 50) || CASE {K} % 3 WHEN 0 THEN 'TAX id ' WHEN 1 THEN 'الرقم الضريبى ' ELSE 'order ' END || repeat('b ', {K} % 41) || '123-456-789 end'"


@query(
    f"""SELECT {K}, CASE WHEN near AND {K} % 3 = 0 THEN 'tax id' WHEN near AND {K} % 3 = 1 THEN 'الرقم الضريبي' END AS term, CAST(p - 1 - greatest(p - 1 - 40, 0) AS INT) AS context_offset
  FROM (SELECT {K}, strpos(t, '123-456-789') AS p, {K} % 41 * 2 + CASE {K} % 3 WHEN 0 THEN 7 ELSE 14 END <= 64 AS near FROM (SELECT {K}, {_CTX} AS t FROM customer))"""
)
def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms up to 64 characters before a value speak for it; farther ones do not."""
    one = _texts(spark, sf_dir, _CTX).select(K, "text", F.explode(spans_of(F.col("text"), "123-456-789")).alias("s"))
    term = context_term(F.col("text"), F.col("s.start"), F.col("s.end"), folded_terms(CONTEXT["tax"]))
    return one.select(K, term.alias("term"), snippet(F.col("text"), F.col("s.start"), F.col("s.end"))["context_offset"].alias("context_offset"))


_SEGMENTED = f"repeat('ab ', 1 + {K} % 3) || 'سلام ' || repeat('x', {K} % 2) || '12 ' || CASE WHEN {K} % 5 = 0 THEN 'مرحبا كلام عربي طويل' ELSE 'tail' END"


@query(
    f"""SELECT {K}, CASE WHEN arabic * 5 >= letters THEN 'arabic' ELSE 'latin' END AS script,
  CAST(2 + CASE WHEN {K} % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN {K} % 5 = 0 THEN CASE WHEN {K} % 2 = 1 THEN 1 ELSE 0 END ELSE CASE WHEN {K} % 2 = 1 THEN 0 ELSE 1 END END AS INT) AS n_segments,
  CAST(3 * (1 + {K} % 3) AS INT) AS first_end
  FROM (SELECT {K}, length(regexp_replace(t, '[^a-zء-ي]', '', 'g')) AS letters, length(regexp_replace(t, '[^ء-ي]', '', 'g')) AS arabic FROM (SELECT {K}, {_SEGMENTED} AS t FROM customer))"""
)
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant script, runs of one script, and where the first ends."""
    rows = _texts(spark, sf_dir, _SEGMENTED)
    return rows.select(K, dominant_script(F.col("text")).alias("script"), F.size(script_segments(F.col("text"))).alias("n_segments"), F.get(script_segments(F.col("text")), F.lit(0))["end"].alias("first_end"))


_FOLDED = f"translate(lower(c_name), '{LETTERS_FROM}', '{LETTERS_TO}')"


@query(f"SELECT {K}, {_FOLDED} || 'اهي' AS folded FROM customer")
def fold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer fold and lower case."""
    return table(spark, sf_dir, "customer").select(K, fold(F.concat("c_name", F.lit("أةى"))).alias("folded"))


# --- policy ------------------------------------------------------------------------


@query(
    """SELECT 'NATION_' || n_nationkey || '_X' AS entity_type, CASE WHEN n_nationkey % 2 = 0 THEN 'location' ELSE 'other' END AS category, CASE WHEN n_nationkey % 3 = 0 THEN 'BLOCK' ELSE 'MASK' END AS action,
  CAST(0.5 + CASE WHEN n_nationkey % 5 = 0 THEN 0.25 ELSE 0 END AS DOUBLE) AS threshold, '<NATION_' || n_nationkey || '_X>' AS placeholder FROM nation WHERE n_nationkey % 4 <> 1 AND n_nationkey % 7 <> 2"""
)
def policy_overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom entities from a table over the baseline: some off, some refused for want of a prompt."""
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("NATION_"), n.cast("string"), F.lit("_X")).alias("entity_type"),
        F.when(n % 7 != 2, F.concat(F.lit("nation "), n.cast("string"))).alias("gliner_prompt"),
        F.when(n % 2 == 0, "LOCATION").alias("category"),
        F.when(n % 3 == 0, "block").alias("action"),
        F.when(n % 5 == 0, 0.75).alias("score_threshold"),
        (n % 4 != 1).alias("enabled"),
    )
    merged, _ = overlay_table(baseline(), rows)
    return merged.rows(spark).where(F.col("entity_type").startswith("NATION_")).select("entity_type", "category", "action", "threshold", "placeholder")


_MAILED = f"'write to ' || CASE WHEN {K} % 3 = 0 THEN 'someone@example.org' ELSE 'c' || CAST({K} AS STRING) || '@example.com' END"


@query(f"SELECT {K}, CASE WHEN {K} % 3 = 0 THEN 0 ELSE 1 END AS n, {K} % 3 <> 0 AS blocked FROM customer")
def vocabulary_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surrogate that masking wrote is not found again; other addresses block."""
    merged, _ = overlay(baseline(), [{"entity_type": "EMAIL_ADDRESS", "action": "BLOCK", "replacement_strategy": "surrogate", "replacement_pool": ["someone@example.org", "nobody@example.org"]}])
    p = Policy({"EMAIL_ADDRESS": merged.entities["EMAIL_ADDRESS"]}, merged.gazetteer)
    return prepare.prepare(detect(_texts(spark, sf_dir, _MAILED), p, today()), p, PEPPER).select(K, F.size("spans").alias("n"), "blocked")


# --- conversations -----------------------------------------------------------------

_TURN = "text || CASE WHEN turn % 2 = 0 THEN ' mail u' || CAST(conv_id % 50 AS STRING) || '@example.org now' ELSE '' END"
_TURNS = f"(SELECT conv_id, turn, role, {_TURN} AS text FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_TURN).alias("text"))


@query(f"SELECT conv_id, turn, role, md5(regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g')) AS masked_md5 FROM {_TURNS}")
def conversation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns masked, each distinct text scanned once."""
    p = only("EMAIL_ADDRESS", "EG_NATIONAL_ID", "EG_MOBILE")
    return conversations.mask_turns(_turns(spark, sf_dir), p, PEPPER, today()).select("conv_id", "turn", "role", F.md5("masked").alias("masked_md5"))


@query(f"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '{_EMAIL}')) AS INT) AS n_spans, CAST(coalesce(nullif(strpos(text, regexp_extract(text, '{_EMAIL}')), 0) - 1, -1) AS INT) AS first_start FROM (SELECT conv_id, turn, text FROM {_TURNS}) WHERE regexp_matches(text, '{_EMAIL}') UNION ALL SELECT conv_id, turn, 0, -1 FROM {_TURNS} WHERE NOT regexp_matches(text, '{_EMAIL}')")
def dedupe_detect_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection over distinct texts, joined back to every turn."""
    found = detect_distinct(_turns(spark, sf_dir), only("EMAIL_ADDRESS"), today())
    return found.select("conv_id", "turn", F.size("spans").alias("n_spans"), F.coalesce(F.get("spans", F.lit(0))["start"], F.lit(-1)).alias("first_start"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested requests: user turns as texts, the others as tool-call arguments."""
    t = _turns(spark, sf_dir)
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    call = F.struct(F.lit("c").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("f").alias("name"), F.col("text").alias("arguments")).alias("function"))
    called = F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", call.alias("call")))))
    by = t.groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(said.alias("said"), called.alias("called"))
    meta = F.create_map(F.lit("user_api_key_user_id"), F.concat(F.lit("u"), "request_id"))
    none = F.lit(None).cast("map<string,string>")
    return by.select("request_id", F.transform("said", lambda x: x["text"]).alias("texts"), F.transform("called", lambda x: x["call"]).alias("tool_calls"), meta.alias("metadata"), none.alias("fallback_metadata"))


@query(f"SELECT CAST(conv_id AS VARCHAR) AS request_id, CASE role WHEN 'user' THEN 'content' ELSE 'tool_call.args' END AS field, count(*) AS n, sum(length(text))::BIGINT AS chars FROM {_TURNS} WHERE text <> '' GROUP BY ALL")
def request_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of nested requests."""
    return conversations.flatten_request(_requests(spark, sf_dir)).groupBy("request_id", "field").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


_ORDERED = f"coalesce(md5(string_agg(regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g'), '|' ORDER BY turn) FILTER (role OP 'user')), md5(''))"


@query(
    f"""SELECT CAST(conv_id AS VARCHAR) AS request_id, {_ORDERED.replace("OP", "=")} AS texts_md5, {_ORDERED.replace("OP", "<>")} AS calls_md5,
  sum(len(regexp_extract_all(text, '{_EMAIL}')))::BIGINT AS n_spans, 'u' || CAST(conv_id AS VARCHAR) AS user_id, false AS blocked FROM {_TURNS} GROUP BY conv_id"""
)
def request_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested requests masked in place: every text and argument, in order."""
    out = conversations.mask_requests(_requests(spark, sf_dir), only("EMAIL_ADDRESS"), PEPPER, today())
    user = conversations.identity(F.col("metadata"), F.col("fallback_metadata"))[0]
    calls = F.transform("tool_calls", lambda c: c["function"]["arguments"])
    n = F.coalesce(F.try_element_at("entity_counts", F.lit("EMAIL_ADDRESS")), F.lit(0)).cast("long")
    return out.select("request_id", F.md5(F.array_join("texts", "|")).alias("texts_md5"), F.md5(F.array_join(calls, "|")).alias("calls_md5"), n.alias("n_spans"), user, "blocked")


@query("SELECT CAST(conv_id AS VARCHAR) AS request_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations WHERE conv_id % 4 <> 3 OR turn < 2 GROUP BY conv_id")
def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent events joined to texts: a frame per turn, broken ones between; every fourth ends after two turns."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("request_id"), "conv_id", F.col("turn").alias("seq"), "text")
    delta = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))
    frame = F.concat(F.lit("data: "), F.to_json(delta), F.lit("\n\ndata: {broken\n\n: note"))
    done = F.when((F.col("conv_id") % 4 == 3) & (F.col("seq") == 2), F.concat(F.lit("data: [DONE]\n\n"), frame)).otherwise(frame)
    out = conversations.parse_stream(t.select("request_id", "seq", done.alias("body")))
    return out.select("request_id", F.md5("text").alias("text_md5"))


# --- evaluation: gold spans and predictions from line items ---------------------------

_CASE = "CAST(l_orderkey AS STRING)"
_REGISTER = "CASE l_orderkey % 3 WHEN 0 THEN 'egyptian' WHEN 1 THEN 'mixed_script' ELSE 'msa' END"


def _label(n: str) -> str:
    return f"CASE {n} % 3 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' ELSE 'ORG' END"


_S, _E = "CAST(l_partkey % 50 AS INT)", "CAST(l_partkey % 50 + 1 + l_suppkey % 9 AS INT)"
_PS, _PE = "CAST(l_suppkey % 55 AS INT)", "CAST(l_suppkey % 55 + 1 + l_partkey % 6 AS INT)"
_GOLD = f"(SELECT {_CASE} AS case_id, {_REGISTER} AS register, {_S} AS s, {_E} AS e, {_label('l_linenumber')} AS label FROM lineitem WHERE l_linenumber < 6)"
_PRED = f"(SELECT {_CASE} AS case_id, {_PS} AS s, {_PE} AS e, {_label('l_partkey')} AS label FROM lineitem WHERE l_linenumber > 2)"
_HITS = f"(SELECT g.case_id, g.register, g.s, g.e, g.label, coalesce(bool_or(p.s IS NOT NULL), false) AS hit, coalesce(bool_or(p.label = g.label), false) AS typed FROM {_GOLD} g LEFT JOIN {_PRED} p ON p.case_id = g.case_id AND p.s < g.e AND g.s < p.e GROUP BY ALL)"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Order keys stay numbers here, which are dealt and sorted faster than their digits.
    li = table(spark, sf_dir, "lineitem").where("l_linenumber < 6")
    return li.selectExpr("l_orderkey AS case_id", f"{_REGISTER} AS register", f"{_S} AS start", f"{_E} AS end", f"{_label('l_linenumber')} AS label")


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 2")
    return li.selectExpr("l_orderkey AS case_id", f"{_PS} AS start", f"{_PE} AS end", f"{_label('l_partkey')} AS label")


def _sweeps(spark: SparkSession, sf_dir: str) -> int:
    return evaluate.sweep_tasks(table(spark, sf_dir, "lineitem"))


@query(
    f"""SELECT register, label, count(*) AS spans, count(*) FILTER (hit) AS covered, count(*) FILTER (typed) AS covered_typed,
  coalesce(count(*) FILTER (hit) / nullif(count(*), 0)::DOUBLE, 0) AS coverage_any, coalesce(count(*) FILTER (typed) / nullif(count(*), 0)::DOUBLE, 0) AS coverage_typed
  FROM {_HITS} GROUP BY GROUPING SETS ((), (register), (label))"""
)
def coverage_by_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage overall, by register and by label."""
    return evaluate.coverage(evaluate.span_hits(_gold(spark, sf_dir), _pred(spark, sf_dir), _sweeps(spark, sf_dir)))


def _sql_chars(t: str) -> str:
    return f"(SELECT DISTINCT case_id, unnest(range(s, e)) AS c FROM {t})"


@query(
    f"""SELECT g::BIGINT AS gold_chars, i::BIGINT AS covered_chars, x::BIGINT AS extra_chars, i / g::DOUBLE AS char_recall, x / g::DOUBLE AS over_mask_ratio FROM (
  SELECT (SELECT count(*) FROM {_sql_chars(_GOLD)}) AS g, (SELECT count(*) FROM {_sql_chars(_GOLD)} JOIN {_sql_chars(_PRED)} USING (case_id, c)) AS i,
  (SELECT count(*) FROM {_sql_chars(_PRED)} ANTI JOIN {_sql_chars(_GOLD)} USING (case_id, c)) AS x)"""
)
def char_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of gold spans covered, each once."""
    return evaluate.character_coverage(_gold(spark, sf_dir), _pred(spark, sf_dir))


_SOME_GOLD = f"(SELECT * FROM {_GOLD} WHERE CAST(case_id AS BIGINT) % 10 <> 7)"


@query(
    f"""SELECT (SELECT count(*) FROM {_PRED}) AS predicted, (SELECT count(*) FROM {_PRED} p SEMI JOIN {_SOME_GOLD} g ON g.case_id = p.case_id AND p.s < g.e AND g.s < p.e) AS true_spans,
  (SELECT count(*) FROM {_PRED} p ANTI JOIN {_SOME_GOLD} g ON g.case_id = p.case_id) AS false_in_clean"""
)
def span_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that touch gold, and those in cases without any (every tenth)."""
    # A case is given once for each of its lines: that shows in the number of clean cases only, which is not returned.
    cases = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS case_id")
    gold = _gold(spark, sf_dir).where("case_id % 10 <> 7")
    more = evaluate.precision(cases, gold, _pred(spark, sf_dir), _sweeps(spark, sf_dir))
    return more.select(*[F.col(c).cast("long").alias(c) for c in ("predicted", "true_spans", "false_in_clean")])


_MARKED = f"CASE WHEN {K} % 4 = 0 THEN 'nothing here ' || c_name ELSE 'met [' || c_name || '](PER) in [town ' || CAST({K} % 90 AS STRING) || '](LOC) [x](MISC)' END"


@query(
    f"""SELECT {K}, md5(CASE WHEN {K} % 4 = 0 THEN 'nothing here ' || c_name ELSE 'met ' || c_name || ' in town ' || CAST({K} % 90 AS STRING) || ' [x](MISC)' END) AS text_md5,
  CASE WHEN {K} % 4 = 0 THEN '' ELSE 'PER:4:' || CAST(4 + length(c_name) AS STRING) || ',LOC:' || CAST(8 + length(c_name) AS STRING) || ':' || CAST(8 + length(c_name) + length('town ' || CAST({K} % 90 AS STRING)) AS STRING) END AS gold FROM customer"""
)
def gold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked texts parsed to plain text and gold spans."""
    cases = table(spark, sf_dir, "customer").selectExpr(K, f"{_MARKED} AS marked")
    out = evaluate.parse_markup(cases)
    spans = F.array_join(F.transform("gold", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(K, F.md5("text").alias("text_md5"), spans.alias("gold"))


@query(f"SELECT register, count(*) AS cases, sum(n)::BIGINT AS spans, count(*) FILTER (n = 0) AS negatives FROM (SELECT CASE {K} % 3 WHEN 0 THEN 'egyptian' WHEN 1 THEN 'mixed_script' ELSE 'msa' END AS register, CASE WHEN {K} % 4 = 0 THEN 0 ELSE 2 END AS n FROM customer) GROUP BY register")
def gold_by_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, spans and cases without any, by register."""
    register = f"CASE {K} % 3 WHEN 0 THEN 'egyptian' WHEN 1 THEN 'mixed_script' ELSE 'msa' END AS register"
    return evaluate.gold_summary(evaluate.parse_markup(table(spark, sf_dir, "customer").selectExpr(K, register, f"{_MARKED} AS marked")))


@query("SELECT variant, row_number() OVER (ORDER BY c DESC, f, p, variant) AS place FROM (SELECT s_name AS variant, s_suppkey % 30 AS c, s_suppkey % 4 AS f, s_acctbal AS p FROM supplier) WHERE c >= 10 AND f <= 2")
def variant_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted variants in order, with their place."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_name AS variant", "round(0.7 + (s_suppkey % 30) / 100.0, 2) AS coverage_any", "round((s_suppkey % 4) * 0.05, 2) AS fp_per_clean", "s_acctbal AS p95_ms")
    return evaluate.with_place(evaluate.rank_variants(rows)).select("variant", "place")


_LABEL = "CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN 'O' WHEN 1 THEN 'B-PER' WHEN 2 THEN 'I-PER' WHEN 3 THEN 'I-PER' WHEN 4 THEN 'B-LOC' ELSE 'I-LOC' END"
_LINES = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber"
_TOKENS = f"SELECT CAST(l_orderkey AS STRING) AS case_id, l_linenumber AS pos, {_LABEL} AS label, 0.4 + l_quantity / 100 AS score, CAST(l_linenumber * 6 AS INT) AS s, CAST(l_linenumber * 6 + l_suppkey % 5 AS INT) AS e FROM ({_LINES})"


@query(
    f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS i, label[3:] AS name FROM ({_TOKENS}) WHERE s < e),
  run AS (SELECT case_id, i, label, name, score, s, e, CASE WHEN label = 'O' THEN 0 ELSE 1 END AS island FROM t WHERE i = 1
    UNION ALL SELECT t.case_id, t.i, t.label, t.name, t.score, t.s, t.e, CASE WHEN t.label = 'O' THEN run.island WHEN t.label[1] = 'I' AND run.label <> 'O' AND run.name = t.name THEN run.island ELSE run.island + 1 END
    FROM run JOIN t ON t.case_id = run.case_id AND t.i = run.i + 1)
  SELECT case_id, min(s) AS start, max(e) AS "end", min(name) AS label, min(score) AS score FROM run WHERE label <> 'O' GROUP BY case_id, island HAVING min(score) >= 0.5"""
)
def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token labels to spans."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    tokens = lines.selectExpr("CAST(l_orderkey AS STRING) AS case_id", "l_linenumber AS pos", f"{_LABEL} AS label", "0.4 + l_quantity / 100 AS score", "CAST(l_linenumber * 6 AS INT) AS start", "CAST(l_linenumber * 6 + l_suppkey % 5 AS INT) AS end")
    return models.bio_rows(tokens)


_NAMED = f"CASE WHEN {K} % 2 = 0 THEN 'عميل ' || c_mktsegment || ' مع محمد رقم ' ELSE 'عميل بدون اسم ' END || CAST({K} AS STRING)"


@query(
    f"""SELECT {K}, 'AR_PERSON' AS entity_type, CAST(strpos(t, 'محمد') - 1 AS INT) AS start, CAST(strpos(t, 'محمد') + 3 AS INT) AS "end", CAST(0.9 AS DOUBLE) AS score FROM (SELECT {K}, {_NAMED} AS t FROM customer) WHERE {K} % 2 = 0"""
)
def ner_dictionary_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model tier with a dictionary in the model's place: names in Arabic runs of every text; the same name in a Latin run is not its business."""
    p = Policy({"AR_PERSON": baseline().entities["AR_PERSON"]}, baseline().gazetteer)
    rows = _texts(spark, sf_dir, _NAMED)
    tag = models.tag_spans(lambda: models.DictionaryTagger({"محمد": "PER", "MACHINERY": "PER", "BUILDING": "PER"}), "arabic", models.LABELS)
    extra = F.transform(tag(F.col("text")), lambda s: s.withField("action", F.lit("MASK")).withField("value", F.substring("text", s["start"] + 1, s["end"] - s["start"])))
    found = prepare.prepare(detect(rows, p, today(), extra), p, PEPPER)
    return prepare.findings(found, K).select(K, "entity_type", "start", "end", "score")
