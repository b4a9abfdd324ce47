"""Language identification against context trees of plain dictionaries, and on texts that were held out."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitara.llm import ppm

SCHEMA = "doc_id long, text string, lang string, Score string"


class Tree:
    """A language's contexts: bytes before (zeros at a text's beginning) to counts of the byte after."""

    def __init__(self, texts: list[str], order: int, languages: int, cells: int):
        self.order, self.seen, self.follow = order, Counter(), defaultdict(Counter)
        total = 0
        for t in texts:
            b = bytes(order) + t.encode()
            total += len(b) - order
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.follow[b[i - k : i]][b[i]] += 1
        self.least = max(1, math.ceil(total / max(1, cells // languages**2)))

    def bits(self, context: bytes, byte: int, known: set[bytes]) -> int:
        """In parts of 2**-16, each step rounded."""
        seen = self.follow.get(context, {})
        n, q = sum(seen.values()), len(seen)
        kept = {s: c for s, c in seen.items() if c >= self.least}
        step = lambda p: round(-math.log2(p) * 65536)
        if n >= self.least and byte in kept:
            return step(kept[byte] / (n + q))
        escape = step((q + n - sum(kept.values())) / (n + q)) if n >= self.least else 0
        return escape + (self.bits(context[1:], byte, known) if context else 8 * 65536)

    def length(self, text: str) -> int:
        b = bytes(self.order) + text.encode()
        return sum(self.bits(b[i - self.order : i], b[i], set()) for i in range(self.order, len(b)))


def _texts(n, seed):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "er ", "on", " "], "fr": ["é", "que", "ion ", " ", "le"], "ar": ["ال", "م", "ن ", "و"]}
    return [("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(0, 40))), lang) for lang in rng.choices(list(parts), k=n)]


ODD = [(None, "en"), ("text of no language", None), ("", "fr"), ("a", "en"), ("12 34 !", "en"), ("ab\0c", "fr"), ("the " * 70_000, "en")]


@pytest.mark.parametrize(("order", "cells"), [(4, 1 << 21), (2, 400), (3, 2000)])
def test_code_lengths(spark, monkeypatch, order, cells):
    """Every text's length in every language, with all statistics and with few, over edges of chunks."""
    rows = _texts(60, 1) + ODD[:-1]
    docs = spark.createDataFrame([(i, t, lang, "") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    model = ppm.train(docs, order=order, cells=cells)
    assert model.langs == ["ar", "en", "fr"]
    trees = [Tree([t for t, x in rows if x == lang and t is not None], order, 3, cells) for lang in model.langs]
    probes = [t for t, _ in rows if t] + ["unseen ÿ words", "x", "\0", "theque"]
    want = np.array([[tree.length(t) for tree in trees] for t in probes])
    for chunk in (1 << 18, 7, 1):
        monkeypatch.setattr(ppm, "CHUNK", chunk)
        assert np.abs(model.lengths(pa.array(["", *probes, None]))[1:-1] - want).max() <= 1  # a last bit of log2
    for m, table in enumerate(model.tables):
        assert table.n * len(model.langs) <= 2 * cells, m


def test_probabilities_sum_to_one_or_less(spark):
    docs = spark.createDataFrame([(i, t, lang, "") for i, (t, lang) in enumerate(_texts(80, 2))], SCHEMA)
    model = ppm.train(docs, order=2, cells=900)
    for head in ("th", "qu", "", "zz"):
        texts = [head.encode() + bytes([b]) for b in range(256)]
        whole = pa.array(texts, pa.binary()).view(pa.string())
        cost = model.lengths(whole) - model.lengths(pa.array([head]))
        assert (np.exp2(-cost / ppm.UNIT).sum(axis=0) <= 1.001).all()


def test_defined_results(spark):
    rows = _texts(60, 3) + ODD
    docs = spark.createDataFrame([(i, t, lang, "z") for i, (t, lang) in enumerate(rows)] + [(0, *rows[0], "z")], SCHEMA)
    model = ppm.train(docs)
    found = ppm.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits"]
    got = found.collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.langs and 0 < r.score <= 1
    nothing = ppm.train(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in ppm.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert ppm.predict(docs.where("false"), model).collect() == []


def test_counts_are_handed_over_in_parts(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(lang, t) for t, lang in _texts(200, 4)], strict=True)], ["lang", "text"])
    whole = lambda: Counter({(r["lang"], r["gram"]): r["n"] for b in ppm._count(4)(iter([batch, batch])) for r in b.to_pylist()})
    want = whole()
    monkeypatch.setattr(ppm, "HELD", 20)
    monkeypatch.setattr(ppm, "CHUNK", 50)
    parts = Counter()
    for n, b in enumerate(ppm._count(4)(iter([batch, batch]))):
        for r in b.to_pylist():
            parts[r["lang"], r["gram"]] += r["n"]
    assert n > 1 and parts == want


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ppm.train(docs.where(~ppm.held_out(F.col("doc_id"))))
    got = ppm.predict(docs, model).where(ppm.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    judged = [r for r in got if r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.97 * len(judged)
