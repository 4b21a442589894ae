"""Licence scans by a trained paragraph classifier.

A sparse multinomial logistic regression on word uni- and bigrams tells licence families and an unknown class apart.
It is trained on notices made from templates, on look-alikes, and on a bounded sample of the corpus' own paragraphs as
unknown; its confidence is calibrated by a temperature on held-out paragraphs. A prediction stands only if the
paragraph also shares enough word pairs with one of the family's templates: its names, or the grant, condition and
warranty paragraphs of its text. Lines that no template confirms alone are judged again, joined with their neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import Block, U, block_of, blocks, lean, mix
from .toxicity import _is_in, _letters

#: Licence families and the names that notices give them.
FAMILIES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 license", "Apache-2.0"),
    "BSD": ("the BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "the BSD license", "BSD-3-Clause", "BSD-2-Clause"),
    "CC-BY": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0", "CC-BY-4.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0", "CC-BY-SA-4.0"),
    "CC0": ("CC0 1.0", "the CC0 1.0 Universal public domain dedication", "Creative Commons Zero", "CC0-1.0"),
    "GPL": ("the GNU General Public License, version 3", "the GNU General Public License version 2", "the GNU GPL v3", "GPL-3.0", "GPL-3.0-or-later", "GPL-2.0-only"),
    "LGPL": ("the GNU Lesser General Public License, version 3", "the GNU LGPL v2.1", "LGPL-3.0", "LGPL-2.1-or-later"),
    "AGPL": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL-3.0", "AGPL-3.0-or-later"),
    "MIT": ("the MIT License", "the MIT/X11 license", "an MIT-style license", "MIT"),
    "MPL": ("the Mozilla Public License, version 2.0", "the MPL 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "ISC": ("the ISC License", "the ISC licence terms"),
    "EPL": ("the Eclipse Public License, version 2.0", "the Eclipse Public License v1.0", "EPL-2.0", "EPL-1.0"),
    "Unlicense": ("the Unlicense", "the Unlicense public domain dedication"),
    "BSL": ("the Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
}
#: Grants, conditions and warranty clauses of the families' texts. A clause that several families share
#: is given to the first of them only.
BODIES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
        "Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program.",
        "THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN OTHERWISE STATED IN WRITING THE COPYRIGHT HOLDERS AND/OR OTHER PARTIES PROVIDE THE PROGRAM \"AS IS\" WITHOUT WARRANTY OF ANY KIND, EITHER EXPRESSED OR IMPLIED.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License. You must inform recipients that the Source Code Form of the Covered Software is governed by the terms of this License, and how they can obtain a copy of this License.",
        "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
        "Subject to the terms of this Agreement, each Contributor hereby grants Recipient a non-exclusive, worldwide, royalty-free copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, Distribute and sublicense the Contribution of such Contributor, if any, and such Derivative Works.",
        "EXCEPT AS EXPRESSLY SET FORTH IN THIS AGREEMENT, AND TO THE EXTENT PERMITTED BY APPLICABLE LAW, THE PROGRAM IS PROVIDED ON AN \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, EITHER EXPRESS OR IMPLIED INCLUDING, WITHOUT LIMITATION, ANY WARRANTIES OR CONDITIONS OF TITLE, NON-INFRINGEMENT, MERCHANTABILITY OR FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
    ),
    "BSL": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    "CC-BY": (
        "You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material for any purpose, even commercially. You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
        "Subject to the terms and conditions of this Public License, the Licensor hereby grants You a worldwide, royalty-free, non-sublicensable, non-exclusive, irrevocable license to exercise the Licensed Rights in the Licensed Material to reproduce and Share the Licensed Material, in whole or in part; and produce, reproduce, and Share Adapted Material.",
        "Unless otherwise separately undertaken by the Licensor, to the extent possible, the Licensor offers the Licensed Material as-is and as-available, and makes no representations or warranties of any kind concerning the Licensed Material, whether express, implied, statutory, or other.",
    ),
    "CC-BY-NC": (
        "You may not use the material for commercial purposes.",
        "the Licensor hereby grants You a worldwide, royalty-free, non-sublicensable, non-exclusive, irrevocable license to reproduce and Share the Licensed Material, in whole or in part, for NonCommercial purposes only; and produce, reproduce, and Share Adapted Material for NonCommercial purposes only.",
    ),
    "CC-BY-SA": (
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
        "The Adapter's License You apply must be a Creative Commons license with the same License Elements, this version or later, or a BY-SA Compatible License.",
    ),
    "CC0": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights and associated claims and causes of action in the Work.",
        "Affirmer offers the Work as-is and makes no representations or warranties of any kind concerning the Work, express, implied, statutory or otherwise, including without limitation warranties of title, merchantability, fitness for a particular purpose, non infringement, or the absence of latent or other defects.",
    ),
}
#: Sentences that give notice of a licence.
FRAMES = (
    "Licensed under {}.",
    "Released under {}.",
    "This work is licensed under {}.",
    "This software is distributed under the terms of {}.",
    "This file is made available under {}.",
    "The content is published under {}.",
    "You may use this work under {}.",
    "SPDX-License-Identifier: {}",
    "License: {}",
)
#: Sentences with the words of notices that give none.
LOOK_ALIKES = (
    "The restaurant is licensed to serve alcohol until midnight.",
    "Her driver's license was renewed under version two of the form.",
    "The album was released under a new label in public.",
    "General terms of work are available in the public office.",
    "The Apache helicopter was released in version 64.",
    "He studied at MIT and published a work on public transport.",
    "A license plate is required under the law.",
    "This software version was released in 2004.",
    "The commons is a creative place for attribution of blame.",
    "All rights reserved.",
    "The permission was granted under terms that nobody knew.",
)
UNKNOWN = "unknown"
#: Paragraphs of the corpus that train the unknown class, at most; made notices per family; share of a paragraph's or
#: a template's word pairs, whichever has fewer, that have to be shared; word pairs that a part of a body shares at
#: least; training texts made of each body.
SAMPLE, MADE, CONFIRM, LEAST_PAIRS, CUTS = 4000, 200, 0.6, 8, 24
#: Words of a sampled paragraph, of a longer one as many from anywhere in it.
STRETCH = 400
_COMMON = 0.02


def _ngrams(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph (line, counted through the block) and hash of each word, then each word pair; words' paragraphs."""
    start, end = _letters(b)
    words = b.span_hash(start, end)
    lines = np.concatenate([[0], np.cumsum(b.data == 10)])[b.start] + b.doc_of_word()  # a text ends a line too
    same = lines[1:] == lines[:-1]
    pairs = mix(words[:-1] * U(3) + mix(words[1:]))[same] if len(words) else words
    return np.concatenate([lines, lines[1:][same]]), np.concatenate([words, pairs]), lines


def _of(texts: list[str]) -> Block:
    raw = [t.replace("\n", " ").encode() for t in texts]
    return block_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lower=True)


@dataclass
class Model:
    known: np.ndarray
    weight: np.ndarray  # features, then one for each band of the number of other words, then the bias; by class
    classes: list[str]
    temperature: float

    def probabilities(self, paragraph: np.ndarray, feature_hash: np.ndarray, words_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paragraphs that hold a known feature, and the calibrated probability of each class; all others are unknown."""
        hit = np.flatnonzero(_is_in(self.known, feature_hash))
        pairs = np.unique(np.stack([paragraph[hit], np.searchsorted(self.known, feature_hash[hit])]), axis=1)
        where, at = np.unique(pairs[0], return_inverse=True)
        x = np.zeros((len(where), len(self.classes)))
        for k in range(x.shape[1]):
            x[:, k] = np.bincount(at, weights=self.weight[pairs[1], k], minlength=len(where))
        size = np.searchsorted(words_of, where, "right") - np.searchsorted(words_of, where)
        x = (x + self.weight[len(self.known) + _band(size)] + self.weight[-1]) / self.temperature
        p = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
        return where, p / p.sum(1, keepdims=True)


def _band(words: np.ndarray) -> np.ndarray:
    return np.searchsorted([6, 10, 16, 30, 60], words, "right")


_BANDS = 6


def train(corpus: list[str], seed: int = 5) -> Model:
    """The classifier; ``corpus``: paragraphs that stand for everything else."""
    rng = np.random.default_rng(seed)
    classes = [*FAMILIES, UNKNOWN]
    plain = [w for t in corpus for w in t.split()] or ["word"]
    texts, y = [], []

    def noisy(t: str) -> str:
        w = t.split()
        if rng.random() < 0.3 and len(w) > 4:
            w.pop(int(rng.integers(len(w))))
        if rng.random() < 0.3:
            w = [plain[i] for i in rng.integers(len(plain), size=rng.integers(1, 8))] + w
        if rng.random() < 0.3:
            w += [plain[i] for i in rng.integers(len(plain), size=rng.integers(1, 8))]
        return " ".join(w)

    for k, names in enumerate(FAMILIES.values()):
        for i in range(MADE):
            texts.append(noisy(FRAMES[i % len(FRAMES)].format(names[int(rng.integers(len(names)))])))
            y.append(k)
    for k, family in enumerate(FAMILIES):
        for body in BODIES[family]:
            w = body.split()
            for i in range(CUTS):  # whole, and in pieces as wrapped lines are
                size = len(w) if i % 3 == 0 else int(rng.integers(7, 40))
                at = int(rng.integers(max(1, len(w) - size + 1)))
                texts.append(noisy(" ".join(w[at : at + size])))
                y.append(k)
    for t in LOOK_ALIKES * 12:
        texts.append(noisy(t))
        y.append(len(FAMILIES))
    texts += corpus
    y += [len(FAMILIES)] * len(corpus)
    y = np.array(y)
    paragraph, seen, words_of = _ngrams(_of(texts))
    pairs = np.unique(np.stack([paragraph.astype(U), seen]), axis=1)
    made = np.isin(pairs[0].astype(np.int64), np.flatnonzero(np.arange(len(texts)) < len(texts) - len(corpus)))
    values, counts = np.unique(pairs[1][made], return_counts=True)
    common, often = np.unique(pairs[1][~made], return_counts=True)
    known = np.setdiff1d(values[counts >= 3], common[often > max(2, _COMMON * len(corpus))])
    hit = _is_in(known, pairs[1])
    row, col = pairs[0][hit].astype(np.int64), np.searchsorted(known, pairs[1][hit])
    size = np.bincount(words_of, minlength=len(texts))
    n = len(known) + _BANDS + 1
    rows, cols = np.concatenate([row, np.arange(len(texts)), np.arange(len(texts))]), np.concatenate([col, len(known) + _band(size), np.full(len(texts), n - 1)])
    held = rng.random(len(texts)) < 0.2
    use = ~held[rows]
    target = np.eye(len(classes))[y]
    w, grown = np.zeros((n, len(classes))), np.full((n, len(classes)), 1e-6)
    balance = 1 / np.sqrt(np.bincount(y, minlength=len(classes)))[y]

    def logits() -> np.ndarray:
        return np.stack([np.bincount(rows, weights=w[cols, k], minlength=len(texts)) for k in range(len(classes))], axis=1)

    def softmax(x: np.ndarray) -> np.ndarray:
        p = np.exp(x - x.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for _ in range(120):
        error = (softmax(logits()) - target) * balance[:, None]
        g = np.stack([np.bincount(cols[use], weights=error[rows[use], k], minlength=n) for k in range(len(classes))], axis=1) + 1e-4 * w
        grown += g * g
        w -= 0.5 * g / np.sqrt(grown)
    x = logits()[held]
    grid = np.array([0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0])
    loss = [-np.log(softmax(x / t)[np.arange(len(x)), y[held]] + 1e-12).mean() for t in grid]
    return Model(known, w, classes, float(grid[int(np.argmin(loss))]))


_WORD = re.compile(r"[a-z0-9]+")


def _pairs(text: str) -> frozenset[tuple[str, str]]:
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


_BODY_PAIRS = {family: [_pairs(x) for x in bodies] for family, bodies in BODIES.items()}


def confirm(text: str, family: str, part: bool = False) -> float:
    """The best share of word pairs, of the shorter of the two, that the text has in common with a template.

    Of a body's pairs the share counts, unless the text may be a ``part`` of it and has LEAST_PAIRS in common.
    """
    words = _WORD.findall(text.lower())
    mine, best = set(zip(words, words[1:], strict=False)), 0.0
    for name in FAMILIES[family]:
        of = _WORD.findall(name.lower())
        if len(of) == 1:  # a name without pairs is there or not
            best = max(best, float(of[0] in words))
        elif mine:
            theirs = set(zip(of, of[1:], strict=False))
            best = max(best, len(mine & theirs) / min(len(mine), len(theirs)))
    for theirs in _BODY_PAIRS[family]:
        both = len(mine & theirs)
        best = max(best, both / len(theirs))
        if part and both >= LEAST_PAIRS:
            best = max(best, both / min(len(mine), len(theirs)))
    return best


def _is_body(text: str) -> bool:
    mine = _pairs(text)
    return any(len(mine & t) >= min(LEAST_PAIRS, len(t)) and len(mine & t) >= CONFIRM * min(len(mine), len(t)) for bodies in _BODY_PAIRS.values() for t in bodies)


def _gives_licence(text: str) -> bool:
    """Whether a template confirms a paragraph that speaks of a licence: it must not train the unknown class."""
    return _is_body(text) or bool(_NAMED.search(text)) and any(confirm(text, family) >= CONFIRM for family in FAMILIES)


_NAMED = re.compile(r"(?i)licen[sc]e|copyright|public domain|creative commons|\bCC[ -0]")


def fit(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Model:
    """The model, with about ``sample`` paragraphs of the corpus as unknown, twice as many at most; the driver holds them.

    A text is chosen by its hash, and a paragraph of it too, so rows that repeat, null texts among them, add nothing.
    Paragraphs that only sound like a licence stay: they are the hard cases.
    """
    n = docs.count()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(F.lit("licence"), F.col(text_col)).alias("hash"))
    some = texts.where(F.pmod("hash", F.lit(1_000_000)) < F.lit(int(min(1.0, sample / max(1, n)) * 1_000_000)))
    line = some.select("hash", F.expr("split(element_at(split(text, '\\n'), cast(1 + pmod(xxhash64(hash), size(split(text, '\\n'))) AS int)), '[ \\t]+')").alias("w"))
    part = F.slice("w", (F.lit(1) + F.pmod(F.xxhash64(F.lit("part"), "hash"), F.greatest(F.lit(1), F.size("w") - STRETCH + 1))).cast("int"), F.lit(STRETCH))
    rows = line.select("hash", F.array_join(part, " ").alias("line")).groupBy("hash").agg(F.min("line").alias("line")).orderBy("hash").limit(2 * sample)
    return train(sorted(r["line"] for r in rows.collect() if r["line"].strip() and not _gives_licence(r["line"])))


def license_paragraphs(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, confidence, overlap, text): the paragraphs (lines, from 0) that give a licence.

    Whole texts are scanned; null and empty texts have none. A paragraph counts if a family has the highest
    probability, at least ``least``, and a template of it confirms (CONFIRM). Adjacent lines that look like a licence
    but do not count alone are one paragraph, if need be with the line before or after; it has its first line's
    number. Repeated rows are reported each.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, line, family, sure, overlap, texts = [], [], [], [], [], []
            for b in blocks(batch.column(1), lower=True):
                if not len(b.hashes):
                    continue
                paragraph, seen, words_of = _ngrams(b)
                where, p = model.probabilities(paragraph, seen, words_of)
                if not len(where):
                    continue
                licence = np.flatnonzero(1 - p[:, -1] >= least)
                if not len(licence):
                    continue
                breaks, docs_of = np.concatenate([[0], np.cumsum(b.data == 10)]), b.doc_of_word()

                def span(x: int, y: int, b=b, words_of=words_of) -> str:
                    i, j = np.searchsorted(words_of, x), np.searchsorted(words_of, y, "right") - 1
                    return b.data[b.start[i] : b.end[j]].tobytes().decode(errors="replace")

                def doc(x: int, words_of=words_of, docs_of=docs_of) -> int:
                    """The text of a line with words, else -1."""
                    i = np.searchsorted(words_of, x)
                    return int(docs_of[i]) if i < len(words_of) and words_of[i] == x else -1

                def add(x: int, text: str, k: int, c: float, share: float, b=b, breaks=breaks, words_of=words_of, doc=doc) -> None:
                    d = doc(x)
                    row.append(d + b.rows)
                    line.append(int(breaks[b.start[np.searchsorted(words_of, x)]] - breaks[b.text_at[d]]))
                    family.append(model.classes[k])
                    sure.append(c)
                    overlap.append(share)
                    texts.append(text)

                taken, runs = set(), []
                for x, q in zip(where[licence].tolist(), p[licence], strict=True):
                    k = int(q.argmax())
                    if k < len(model.classes) - 1 and q[k] >= least and (share := confirm(text := span(x, x), model.classes[k])) >= CONFIRM:
                        add(x, text, k, float(q[k]), share)
                        taken.add(x)
                    elif runs and runs[-1][1] == x - 1 and doc(x) == doc(x - 1):
                        runs[-1][1] = x
                    else:
                        runs.append([x, x])
                tries = []
                for r, (x, y) in enumerate(runs):
                    before = x - 1 not in taken and x > 0 and doc(x - 1) == doc(x)
                    after = y + 1 not in taken and doc(y + 1) == doc(x)
                    ways = [(x, y), *[(x, y + 1)] * after, *[(x - 1, y)] * before, *[(x - 1, y + 1)] * (before and after)]
                    tries += [(r, *way, span(*way)) for way in ways]
                if tries:
                    at, seen, words_of = _ngrams(_of([t for *_, t in tries]))
                    at, p = model.probabilities(at, seen, words_of)
                    done = set()
                    for i, q in zip(at.tolist(), p, strict=True):
                        r, x, y, text = tries[i]
                        k = int(q.argmax())
                        if r in done or not taken.isdisjoint(range(x, y + 1)) or k == len(model.classes) - 1 or q[k] < least:
                            continue
                        if (share := confirm(text, model.classes[k], part=True)) >= CONFIRM:
                            add(x, text, k, float(q[k]), share)
                            taken.update(range(x, y + 1))
                            done.add(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(line, pa.int64()), pa.array(family, pa.string()), pa.array(sure, pa.float64()), pa.array(overlap, pa.float64()), pa.array(texts, pa.string())], ["doc_id", "paragraph", "family", "confidence", "overlap", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(go), f"doc_id {kind}, paragraph long, family string, confidence double, overlap double, text string")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, confidence): every licence paragraph of every document. See license_paragraphs()."""
    found = license_paragraphs(docs, model or fit(docs))
    return found.select("doc_id", "paragraph", "family", F.round("confidence", 6).alias("confidence"))
