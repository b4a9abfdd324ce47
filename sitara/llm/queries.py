"""The registered queries of the corpus operators: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.llm import codes, decontam, html, licenses, lm, mixing, ppm, quality, secrets, sharding, simhash, tokens, trie
from sitara.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))).select("text"))
    # The scores are written, so that the model's files can go.
    scored = materialize(lm.score(docs, model), "lm-scores")
    lm.release(spark, model)
    return scored.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(quality.measure(_table(spark, sf_dir, "documents"), "doc_id", "lang"), "quality")
    out = quality.judge(measured, quality.fit(measured, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, _table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(simhash.fingerprints(_table(spark, sf_dir, "documents")), "prints")
    return simhash.groups(prints).select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = tokens.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read(spark, files)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs, _table(spark, sf_dir, "labels")))
    spans = F.col("secret_spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    n = lambda kind: F.size(F.filter(kinds, lambda x: x == kind)).cast("long").alias(f"n_{kind}")
    counts = [n(kind) for kind in ("assign", "access", "hex")]
    base = F.filter(spans, lambda s: s["kind"] != "markov")
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(spans).alias("spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.fit(docs))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(_table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = ppm.train(docs.where(~ppm.held_out(F.col("doc_id"))))
    found = ppm.predict(docs, model, columns=["doc_id"])
    return found.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash": op6_simhash,
    "op7_token_files": op7_token_files,
    "op8_secret_scan": op8_secret_scan,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_language_id": op12_language_id,
    "op13_vector_codes": op13_vector_codes,
}

# --- what SQL can say of them: the same operators over whole tables, in the columns that DuckDB can compute


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document, as sharding counts it."""
    return op2_sharding(spark, sf_dir).select("doc_id", "size", "law")


def sharding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each shard, and its slots without gaps."""
    by = op2_sharding(spark, sf_dir).groupBy("shard")
    return by.agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


def sharding_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each shard in proportion: none is off by more than a row (plus one for rounding at either end)."""
    placed = sharding.interleave(_table(spark, sf_dir, "documents")).groupBy("source", "shard").agg(F.count("*").alias("n"))
    return placed.groupBy("source").agg((F.max("n") - F.min("n") <= 2).alias("even"), F.sum("n").alias("n"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the base verdict of every document."""
    return op3_quality_rules(spark, sf_dir).drop("kept")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans of every document."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document, and its source's size and target."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


_WORD = r"[^\x20\x09-\x0D]+"
_SIZED = f"(SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents)"
_ASSIGN = secrets.ASSIGN.replace("'", "''")

SQL_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "sharding_sizes": (sharding_sizes, "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, 'rows' AS law FROM documents"),
    "sharding_counts": (
        sharding_counts,
        """SELECT s::INT AS shard, n, n AS slots, 0::BIGINT AS first, n - 1 AS last FROM (SELECT s, ((s + 1) * total + 23) // 24 - (s * total + 23) // 24 AS n
  FROM range(24) AS t(s), (SELECT count(*) AS total FROM documents)) WHERE n > 0""",
    ),
    "sharding_mixture": (sharding_mixture, "SELECT source, true AS even, count(*)::BIGINT AS n FROM documents GROUP BY source"),
    "quality_base": (
        quality_base,
        f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
  w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) > 1 AS again FROM w WHERE i + 2 <= len(ws)),
  r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE again) GROUP BY doc_id),
  m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d)
  SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN r USING (doc_id)""",
    ),
    "secret_base": (
        secret_base,
        f"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    ),
    "mixing_targets": (
        mixing_targets,
        f"""WITH s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM {_SIZED} GROUP BY source),
  b AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3 * source_size AS stop FROM s),
  o AS (SELECT *, greatest(sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
    / sum(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM b),
  l AS (SELECT min_by(rate, stop / w) AS level FROM o WHERE rate * w < stop)
  SELECT doc_id, size, source_size::BIGINT AS source_size, round(CASE WHEN rate * w >= stop OR level IS NULL THEN stop ELSE least(stop, level * w) END, 3) AS target
  FROM {_SIZED} AS d JOIN o ON d.source IS NOT DISTINCT FROM o.source CROSS JOIN l""",
    ),
}
#: crc32 of the decimal digits of c, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda q, z: xor(q >> 1, 3988292384::BIGINT * (q & 1)))), 4294967295::BIGINT)"""
_TRIE = f"""WITH t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT c, ts, ({_CRC} % 9)::INT AS h FROM t),
  r AS (SELECT h.c, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN t AS b ON b.c = h.c - h.c % 5),
  m AS MATERIALIZED (SELECT c, d, len(ts) = d AS ends, ts[1:d] AS prefix, coalesce(strlen(ts[d].t), 0) AS n FROM (SELECT c, ts, unnest(range(len(ts) + 1))::BIGINT AS d FROM r)),
  n AS MATERIALIZED (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, prefix),
  o AS MATERIALIZED (SELECT m.c, m.d, n.conv_id FROM m JOIN n ON m.d = n.d AND m.prefix = n.prefix),
  k AS MATERIALIZED (SELECT n.*, p.conv_id AS parent FROM n LEFT JOIN o AS p ON p.c = n.conv_id AND p.d = n.d - 1),
  c AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
  s AS (SELECT a.conv_id, a.d, sum((k.n_convs - 1) * k.n) AS saved, count(*) FILTER (c.n_children IS NULL) AS leaves
    FROM k LEFT JOIN c ON c.conv_id = k.conv_id AND c.d = k.d JOIN o AS a ON a.c = k.conv_id AND a.d <= k.d GROUP BY ALL)
  SELECT k.conv_id, k.d AS depth, k.parent AS parent_conv_id, k.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends_sha256
  FROM k JOIN s ON s.conv_id = k.conv_id AND s.d = k.d LEFT JOIN c ON c.conv_id = k.conv_id AND c.d = k.d"""


def _codes_sql() -> str:
    assign = """SELECT v.vec_id, v.p, v.s, min((d, b.e)) AS near FROM v JOIN b{r} AS b ON b.p = v.p,
    LATERAL (SELECT list_sum(list_transform(list_zip(v.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) GROUP BY v.vec_id, v.p, v.s"""
    rounds = "".join(
        f"""  a{r} AS MATERIALIZED ({assign.format(r=r)}),
  b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM b{r} AS b LEFT JOIN (SELECT p, e, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS s
    FROM (SELECT p, near[2] AS e, i, sum(s[i]) AS t, count(*) AS n FROM a{r}, range(1, len(s) + 1) AS g(i) GROUP BY ALL) GROUP BY p, e) AS m ON m.p = b.p AND m.e = b.e),
"""
        for r in range(6)
    )
    return f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  v AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS s FROM k, range(8) AS g(p)),
  b0 AS MATERIALIZED (SELECT p, e, s FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) JOIN v USING (vec_id) WHERE e < 16),
{rounds}  a6 AS MATERIALIZED ({assign.format(r=6)}),
  f AS (SELECT vec_id, string_agg(printf('%02x', near[2]), '' ORDER BY p) AS code, sum(near[1])::BIGINT AS error FROM a6 GROUP BY vec_id)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256 FROM f JOIN k USING (vec_id)"""


QUERIES |= {name: query for name, (query, _) in SQL_QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in SQL_QUERIES.items()} | {"op11_conversation_trie": _TRIE, "op13_vector_codes": _codes_sql()}
