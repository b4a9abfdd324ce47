"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph (lines with words up to a blank one; single lines and overlapping
windows of it are judged too) is a sparse vector of word one- and two-grams. A logistic
regression over families, an unknown class (licence language of no listed
family) and ordinary text is fitted by proximal gradient steps with an L1
penalty, and its probabilities are calibrated by a temperature on held-out
samples. A predicted family counts only if the paragraph also holds enough of
one of the family's templates; otherwise it is unknown.

Wrapped notices and those inside long lines are found in windows of a few
sizes over the words of a paragraph; the widest hold whole licence texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitara.llm.blocks import Block, mix, span_hashes, text_blocks
from sitara.llm.common import bounded_batches, hash_sample, pick_columns

# Notices in common use, by family. "unknown" is licence language of other origins.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "This project is licensed under the terms of the MIT license.",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "isc": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "unknown": (
        "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential. See the license agreement for terms of use.",
        "Licensed under the terms of the vendor's software licence agreement.",
        "This file is distributed under its own licence.",
        "Copyright holders reserve all rights not expressly granted by this license.",
    ),
}
CLASSES = (*TEMPLATES, "none")
#: A family needs this calibrated probability, and this share of a template's two-grams.
LEAST_PROBABILITY = 0.5
LEAST_SHARE = 0.7
#: Licence language of no confirmed family must still share so much of some template's two-grams.
UNKNOWN_SHARE = 0.3
#: Words of the windows, which begin every half window; a notice of up to half a window lies in one.
WINDOWS = (8, 16, 32, 64, 128, 256, 512)
#: Variants of each template; documents of any length whose paragraphs are the sample of ordinary text, so many of each
#: at most, picked by their hashes, and of a longer paragraph a run of so many words.
VARIANTS = 24
SAMPLE_DOCS = 400
SAMPLE_PARAGRAPHS = 8
SAMPLE_WORDS = 200
SEED = 5

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass
class Grams:
    """Words of a block by paragraph: ``line`` of each word, ``one`` their hashes, ``two`` those of pairs (0 across lines)."""

    line: np.ndarray
    one: np.ndarray
    two: np.ndarray
    line_doc: np.ndarray
    row: np.ndarray | None = None  # number of the line in the block, blank ones counted
    bare: np.ndarray | None = None  # words of punctuation only


def grams(b: Block) -> Grams:
    """Words without outer punctuation, hashed; paragraphs are the lines that hold a word."""
    starts, ends = b.starts.copy(), b.ends.copy()
    for _ in range(4):
        starts = starts + ((ends > starts) & _PUNCT[b.data[np.minimum(starts, len(b.data) - 1)]]) if len(starts) else starts
        ends = ends - ((ends > starts) & _PUNCT[b.data[np.maximum(ends - 1, 0)]]) if len(ends) else ends
    feed = np.flatnonzero(b.data == 0x0A)
    doc = b.word_doc()
    raw = np.searchsorted(feed, b.starts).astype(np.int64) * (b.n + 1) + doc
    new = np.concatenate(([True], raw[1:] != raw[:-1])) if len(raw) else np.zeros(0, bool)
    line = np.cumsum(new) - 1
    one = span_hashes(b.data, starts, ends)
    two = np.zeros(len(one), np.uint64)
    same = np.flatnonzero(line[1:] == line[:-1])
    two[same] = mix(mix(one[same]) + one[same + 1])
    return Grams(line, one, two, doc[new], np.searchsorted(feed, b.starts), starts == ends)


@dataclass
class Classifier:
    """``vocab``: sorted gram hashes with a weight; ``weights`` by gram and class; ``templates``: two-grams by family."""

    vocab: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[frozenset[int]]]

    def features(self, g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, column, value) of all features: counts over the root of the paragraph's length."""
        n = len(g.line_doc)
        length = np.bincount(g.line, minlength=n)
        found = []
        for h in (g.one, g.two):
            at = np.minimum(np.searchsorted(self.vocab, h), max(0, len(self.vocab) - 1))
            ok = np.flatnonzero(self.vocab[at] == h) if len(self.vocab) else np.zeros(0, np.int64)
            found.append((g.line[ok], at[ok]))
        line, col = (np.concatenate(x) for x in zip(*found, strict=True))
        return line, col, 1.0 / np.sqrt(length[line])

    def logits(self, g: Grams) -> np.ndarray:
        out = np.tile(self.bias, (len(g.line_doc), 1))
        line, col, value = self.features(g)
        np.add.at(out, line, self.weights[col] * value[:, None])
        return out

    def probabilities(self, g: Grams) -> np.ndarray:
        return _softmax(self.logits(g) / self.temperature)

    def confirm(self, family: str, two: np.ndarray) -> float:
        """The greatest share of a template of the family that the paragraph holds."""
        have = set(two.tolist())
        return max((len(t & have) / len(t) for t in self.templates.get(family, ()) if t), default=0.0)


def window_grams(model: Classifier, g: Grams) -> tuple[Grams, np.ndarray, np.ndarray]:
    """Windows of joined lines as paragraphs of their own, with their first and last words in ``g``.

    Left out are windows whose pairs cannot reach UNKNOWN_SHARE of any
    template, as those are never confirmed.
    """
    weight: dict[int, float] = {}
    for t in (t for ts in model.templates.values() for t in ts):
        for h in t:
            weight[h] = max(weight.get(h, 0.0), 1.0 / len(t))
    known = np.array(sorted(weight), dtype=np.uint64)
    worth = np.array([weight[int(h)] for h in known])
    keep = np.flatnonzero(~g.bare)
    one, line, row = g.one[keep], g.line[keep], g.row[keep]
    n, doc = len(one), g.line_doc[line]
    new = np.ones(n, dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] > row[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [n])))
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    two = np.zeros(n, np.uint64)
    inner = np.flatnonzero(~new)
    two[inner] = mix(mix(one[inner - 1]) + one[inner])
    value = np.zeros(n)
    for h in (one, two):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        value += np.where(known[at] == h, worth[at], 0.0)
    sums = np.concatenate(([0.0], np.cumsum(value)))
    starts, ends = [], []
    for width in WINDOWS:
        s = np.flatnonzero((np.arange(n) - begin) % (width // 2) == 0)
        e = np.minimum(s + width, end[s])
        ok = sums[e] - sums[s] >= UNKNOWN_SHARE - 1e-9
        starts.append(s[ok])
        ends.append(e[ok])
    s, e = np.concatenate(starts), np.concatenate(ends)
    length = e - s
    unit = np.repeat(np.arange(len(s)), length)
    word = np.repeat(s, length) + np.arange(len(unit)) - np.repeat(np.cumsum(length) - length, length)
    pairs = np.where(word == s[unit], np.uint64(0), two[word])
    return Grams(unit, one[word], pairs, doc[s]), keep[s], keep[e - 1]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _grams_of(texts: list[str]) -> Grams:
    """Each text as one paragraph."""
    joined = pa.array([" ".join(t.split()) for t in texts], pa.string())
    parts, shift = [], 0
    for b in text_blocks(joined, lower=True):
        g = grams(b)
        parts.append(Grams(g.line_doc[g.line] + shift, g.one, g.two, np.arange(b.n) + shift))
        shift += b.n
    return Grams(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("line", "one", "two", "line_doc")))


def _variants(rng: np.random.Generator, template: str, ordinary: list[str], n: int) -> list[str]:
    """A template as it is met: alone, in other cases, with words around it or a few missing."""
    out, ws = [template], template.split()
    for _ in range(n - 1):
        kept = [w for w in ws if len(ws) < 6 or rng.random() > 0.06]
        around = ordinary[int(rng.integers(len(ordinary)))].split() if ordinary and rng.random() < 0.5 else []
        cut = int(rng.integers(0, min(len(around), 2 * len(ws)) + 1))
        text = " ".join([*around[:cut], *kept] if rng.random() < 0.5 else [*kept, *around[:cut]])
        out.append(text.upper() if rng.random() < 0.1 else text)
    return out


def _some_paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of each text that do not speak of licences: those of the least checksums, and of a long one the run of words that its checksum picks."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            lines = [p for p in (text or "").split("\n") if p.strip() and not any(k in p.lower() for k in ("licen", "copyright", "rights reserved", "spdx"))]
            for h, p in sorted((zlib.crc32(p.encode()), p) for p in lines)[:SAMPLE_PARAGRAPHS]:
                ws = p.split()
                at = h % max(1, len(ws) - SAMPLE_WORDS + 1)
                out.append(" ".join(ws[at : at + SAMPLE_WORDS]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["p"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = SEED) -> Classifier:
    """Fit on the templates' variants and on ordinary paragraphs of at most ``sample_docs`` texts (those with the least hashes).

    Sample paragraphs that speak of licences are left out of the ordinary
    ones. The sample is the only part of the corpus that reaches the driver.
    """
    pick_columns(docs, "doc_id", "text")
    drawn = hash_sample(docs.select("doc_id", "text").withColumn("h", F.xxhash64("doc_id", "text")), F.col("h"), sample_docs)
    rng = np.random.default_rng(seed)
    ordinary = sorted(r.p for r in drawn.select("text").mapInArrow(_some_paragraphs, "p string").collect())
    ordinary = ordinary or ["nothing of note is written here"]
    order = rng.permutation(len(ordinary))
    texts, labels = [ordinary[i] for i in order], [len(CLASSES) - 1] * len(order)
    for c, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            made = _variants(rng, template, ordinary, VARIANTS)
            texts += made
            labels += [c] * len(made)
    y = np.array(labels)
    plain = _grams_of([t for ts in TEMPLATES.values() for t in ts])
    vocab = np.unique(np.concatenate((plain.one, plain.two[plain.two > 0])))
    two_of = {f: [frozenset(g.two[g.two > 0].tolist()) or frozenset(g.one.tolist()) for g in (_grams_of([t]) for t in ts)] for f, ts in TEMPLATES.items()}
    model = Classifier(vocab, np.zeros((len(vocab), len(CLASSES))), np.zeros(len(CLASSES)), 1.0, two_of)
    line, col, value = model.features(_grams_of(texts))
    x = np.zeros((len(texts), len(vocab)), dtype=np.float32)
    np.add.at(x, (line, col), value.astype(np.float32))
    held = rng.random(len(texts)) < 0.2
    _fit(model, x[~held], y[~held])
    z = x[held] @ model.weights + model.bias
    scale = np.geomspace(0.2, 5.0, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[held]], 1e-12)).mean() if len(z) else 0.0 for t in scale]
    model.temperature = float(scale[int(np.argmin(loss))]) if len(z) else 1.0
    used = np.abs(model.weights).sum(axis=1) > 0
    model.vocab, model.weights = model.vocab[used], model.weights[used]
    return model


def _fit(model: Classifier, x: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 2e-5) -> None:
    """Accelerated proximal gradient steps on the mean log-loss, classes weighed alike."""
    one = np.eye(len(CLASSES), dtype=np.float32)[y]
    weigh = (1.0 / np.maximum(one.sum(axis=0), 1))[y]
    weigh = (weigh / weigh.sum())[:, None]
    rate = 2.0 / max(1e-9, float((weigh * (x * x).sum(axis=1, keepdims=True)).sum() + 1))
    w, b = model.weights, model.bias
    v, c, t = w.copy(), b.copy(), 1.0
    for _ in range(steps):
        err = weigh * (_softmax(x @ v + c) - one)
        w_new, b_new = v - rate * 40 * (x.T @ err), c - rate * 40 * err.sum(axis=0)
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * 40 * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    model.weights, model.bias = w, b


RESULT = "n_paragraphs long, n_license long, license string, probability double, similarity double"


def _paragraphs(g: Grams, n: int) -> np.ndarray:
    """Runs of lines with words, by text; a blank line or the text's end closes one."""
    if not len(g.line):
        return np.zeros(n, np.int64)
    new = np.concatenate(([True], (g.line[1:] != g.line[:-1]) & ((g.line_doc[g.line[1:]] != g.line_doc[g.line[:-1]]) | (g.row[1:] > g.row[:-1] + 1))))
    return np.bincount(g.line_doc[g.line[new]], minlength=n)


def _scan_batch(model: Classifier, texts: pa.Array) -> pa.StructArray:
    cols: tuple[list, ...] = ([], [], [], [], [])
    none = len(CLASSES) - 1
    for b in text_blocks(texts, lower=True):
        g = grams(b)
        p = model.probabilities(g)
        paragraphs = _paragraphs(g, b.n)
        found: list[dict[str, int]] = [{} for _ in range(b.n)]
        told: dict[int, list[tuple[int, int, str]]] = {}
        best = np.zeros(b.n), np.zeros(b.n)
        borders = np.searchsorted(g.line, np.arange(len(g.line_doc) + 1))
        for i in np.flatnonzero(1 - p[:, none] >= LEAST_PROBABILITY):
            c, doc = int(np.argmax(p[i, :none])), g.line_doc[i]
            two = g.two[borders[i] : borders[i + 1]]
            share = model.confirm(CLASSES[c], two)
            sure = p[i, c] >= LEAST_PROBABILITY and share >= LEAST_SHARE
            if not sure and max(model.confirm(family, two) for family in TEMPLATES) < UNKNOWN_SHARE:
                continue
            name = CLASSES[c] if sure else "unknown"
            found[doc][name] = found[doc].get(name, 0) + 1
            told.setdefault(doc, []).append((int(borders[i]), int(borders[i + 1]) - 1, name))
            if sure or best[0][doc] == 0:
                best[0][doc], best[1][doc] = max(best[0][doc], p[i, c]), max(best[1][doc], share)
        w, low, high = window_grams(model, g)
        p = model.probabilities(w)
        borders = np.searchsorted(w.line, np.arange(len(w.line_doc) + 1))
        sought = []
        for i in np.flatnonzero(1 - p[:, none] >= LEAST_PROBABILITY):
            c = int(np.argmax(p[i, :none]))
            two = w.two[borders[i] : borders[i + 1]]
            share = model.confirm(CLASSES[c], two)
            sure = p[i, c] >= LEAST_PROBABILITY and share >= LEAST_SHARE
            if sure or max(model.confirm(family, two) for family in TEMPLATES) >= UNKNOWN_SHARE:
                sought.append((not sure, -share, int(high[i] - low[i]), i, c))
        # The surest and shortest windows come first; one that touches a span of its family extends it, of another yields to it.
        for unsure, share, _, i, c in sorted(sought):
            doc, name, a, z = w.line_doc[i], "unknown" if unsure else CLASSES[c], int(low[i]), int(high[i])
            spans = told.setdefault(doc, [])
            beside = [x for x in spans if x[0] <= z + 1 and x[1] >= a - 1]
            same = [x for x in beside if x[2] == name]
            others = [x for x in beside if x[2] not in (name, "unknown") and x[1] - x[0] < WINDOWS[-1]]
            if others or (unsure and beside):
                continue
            gone = [x for x in beside if x[2] in (name, "unknown")]
            for x in gone:
                spans.remove(x)
                found[doc][x[2]] -= 1
            for x in same:
                a, z = min(a, x[0]), max(z, x[1])
            spans.append((a, z, name))
            found[doc][name] = found[doc].get(name, 0) + max(1, len(same))
            if not unsure or best[0][doc] == 0:
                best[0][doc], best[1][doc] = max(best[0][doc], p[i, c]), max(best[1][doc], -share)
        found = [{k: v for k, v in f.items() if v} for f in found]
        cols[0].extend(paragraphs.tolist())
        cols[1].extend(sum(f.values()) for f in found)
        cols[2].extend(",".join(sorted(f)) if f else "none" for f in found)
        cols[3].extend(np.round(best[0], 6).tolist())
        cols[4].extend(np.round(best[1], 6).tolist())
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_paragraphs, n_license, license, probability, similarity of every row.

    ``license`` is the sorted list of families found, joined by commas;
    ``unknown`` stands for licence language without a confirmed family, and
    ``none`` for a text without any. Null and empty texts have no paragraphs.
    Repeated rows give equal results; other columns are ignored.
    """
    pick_columns(docs, "doc_id", "text")
    run = F.arrow_udf(lambda texts: _scan_batch(model, texts), RESULT)
    return bounded_batches(docs).select("doc_id", run(F.coalesce(F.col("text"), F.lit(""))).alias("s")).select("doc_id", "s.*")
