from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sitara.functions import text as t


def _script(c: str) -> str | None:
    if unicodedata.category(c)[0] != "L":
        return None
    return "arabic" if any(a <= ord(c) <= b for a, b in t.ARABIC_BLOCKS) else "latin"


def _segments(s: str) -> list[tuple]:
    runs, script = [], None
    for i, c in enumerate(s):
        k = _script(c)
        if k and k != script:
            runs.append([k, 0 if not runs else i, i])
            script = k
        if runs:
            runs[-1][2] = i + 1
    return [tuple(r) for r in runs]


def _random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = "abcXYZ 0123٠١٢۳۴ أإآةىمحمد ـًّ​‎ﷲﻻ①２Ａ😀.,،\n"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(41))) for _ in range(n)]


TEXTS = ["", "please translate محمد for me", "Hello محمد، 25 سنة world", "123 !!!", "😀 أنا 01012345678", *_random_texts(150, 20240917)]


@pytest.mark.parametrize("profile", [t.DIGITS, t.NAMES, t.GAZETTEER])
def test_normalize_matches_char_by_char(spark, profile):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TEXTS)], "i int, text string").withColumn("n", t.normalize(F.col("text"), profile))
    for r in df.collect():
        text, places = t.fold_text(r.text, profile)
        assert r.n["text"] == text, r.text
        got = r.n["offset_map"]
        assert (list(range(len(text))) if got is None else list(got)) == places
        assert places == sorted(places) and all(0 <= p < len(r.text) for p in places)


def test_normalize_known(spark):
    assert t.fold_text("ـــمحمد", t.NAMES) == ("محمد", [3, 4, 5, 6])
    assert t.fold_text("ﻻ", t.NAMES)[1] == [0, 0]
    assert t.fold_text("ـــــ", t.NAMES) == ("", [])
    assert t.fold_text("أحمد مصطفى", t.GAZETTEER)[0] == "احمد مصطفي"


def test_scripts(spark):
    rows = spark.createDataFrame([(s,) for s in TEXTS], "text string").select("text", t.dominant_script(F.col("text")).alias("d"), t.script_segments(F.col("text")).alias("s")).collect()
    for r in rows:
        letters = [k for k in map(_script, r.text) if k]
        assert r.d == ("arabic" if letters and letters.count("arabic") / len(letters) >= 0.2 else "latin")
        assert [tuple(x) for x in r.s] == _segments(r.text), r.text


def test_script_segments_of_a_long_text(spark):
    df = spark.createDataFrame([("abc محمد " * 40_000,)], "text string")
    assert df.select(F.size(t.script_segments(F.col("text")))).first()[0] == 80_000


def test_spans_and_splice(spark):
    import re

    pattern = r"(?<![0-9+])01[0125][0-9]{8}(?![0-9])"
    texts = ["😀 01012345678 and 01112345678", "none", "901012345678 01012345678", ""]
    df = spark.createDataFrame([(s,) for s in texts], "text string").withColumn("s", t.spans_of(F.col("text"), pattern))
    df = df.withColumn("m", t.splice(F.col("text"), F.transform("s", lambda s: F.struct(s["start"], s["end"], F.lit("<X>").alias("replacement")))))
    for r in df.collect():
        assert [(s.start, s.end) for s in r.s] == [m.span() for m in re.finditer(pattern, r.text)]
        assert r.m == re.sub(pattern, "<X>", r.text)


@pytest.mark.parametrize("spans", [[(0, 5), (3, 8)], [(0, 10), (2, 4)], [(0, 5), (0, 5)], [(-1, 3)], [(0, 99)], [(5, 3)]])
def test_splice_refuses(spark, spans):
    made = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("x").alias("replacement")) for a, b in spans])
    with pytest.raises(Exception, match="overlap or leave"):
        spark.createDataFrame([("short text",)], "text string").select(t.splice(F.col("text"), made)).collect()


def test_pieces_strip_snippet(spark):
    df = spark.createDataFrame([("a bb  c",)], "text string")
    one = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end")))
    r = df.select(t.pieces(F.col("text"), one).alias("p"), t.strip_spans(F.col("text"), one).alias("s"), t.snippet(F.col("text"), F.lit(2), F.lit(4), 1).alias("c")).first()
    assert [(p.kind, p.text) for p in r.p] == [("plain", "a "), ("span", "bb"), ("plain", "  c")]
    assert r.s == "a c" and r.c.context == " bb " and r.c.context_offset == 1


@pytest.mark.parametrize("profile", [t.DIGITS, t.GAZETTEER])
def test_every_character_folds_as_in_python(spark, profile):
    """All code points, one by one between letters, and many in a row; nothing of it runs in Python."""
    points = [chr(p) for p in range(1, 0x110000) if not 0xD800 <= p <= 0xDFFF and unicodedata.category(chr(p)) not in ("Cn", "Co")]
    texts = ["a" + x + "b" for x in points if x in t._changes(profile)] + ["".join(points[i : i + 200]) for i in range(0, len(points), 200)]
    df = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("n", t.normalize(F.col("text"), profile))
    assert "Eval" not in df._jdf.queryExecution().executedPlan().toString().replace("Evaluate", "")
    for r in df.collect():
        text, places = t.fold_text(r.text, profile)
        assert r.n["text"] == text, r.text
        assert (list(range(len(text))) if r.n["offset_map"] is None else list(r.n["offset_map"])) == places


def test_cuts_at_any_changed_character(spark):
    """Pieces are cut by a mark that every fold drops, so texts that hold it, or other characters that go or grow, keep their places."""
    texts = ["​", "a​b", "​​a​", "x­ﬁ​½y‍", "مُحَمّد​ أحمد ـ ﷺ", "​ﬀ"]
    for profile in (t.DIGITS, t.NAMES, t.GAZETTEER):
        rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", t.normalize(F.col("t"), profile).alias("n")).collect()
        for r in rows:
            want, places = t.fold_text(r.t, profile)
            assert (r.n.text, r.n.offset_map) == (want, places)


def test_texts_of_one_file_are_dealt_to_all_cores(spark, sf_dir):
    from sitara.plans.queries import QUERIES

    for name in ("normalize_profiles", "recognize_address", "recognize_national_id"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
