"""Licence scans: sparse word n-gram logistic regression over paragraphs, confirmed by templates.

A paragraph is a block of lines up to one without words; it is read in overlapping
windows, so that a notice may be wrapped over lines and stand anywhere in it.
Features are the one- to three-word grams of the templates; a softmax with a class
for anything else is trained on templates in varied surroundings against windows of
the corpus.  Its temperature is set on templates left out of a first fit, the bar
that a family must reach against the other class on windows left out.  A predicted
family counts only if one of its templates is found; its words are then taken out
and the window is asked again, so several licences of one notice are all named.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm import textkit as tk
from spanline.llm.lines import line_words

# How the families are commonly named in notices, and what their texts begin with.
TEMPLATES = {
    "agpl-3.0": [
        "licensed under the GNU Affero General Public License, version 3",
        "GNU AGPLv3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "released under the Apache 2.0 license",
        "available under Apache-2.0",
        "you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "bsd": [
        "released under the BSD License",
        "licensed under the 3-clause BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
        "available under the Creative Commons Attribution License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "available under the Creative Commons Attribution-NonCommercial License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        "available under the Creative Commons Attribution-NonCommercial-NoDerivatives License",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "available under the Creative Commons Attribution-NonCommercial-ShareAlike License",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0",
        "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "available under the Creative Commons Attribution-NoDerivatives License",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "available under the Creative Commons Attribution-ShareAlike License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": ["dedicated to the public domain under CC0 1.0", "released under Creative Commons Zero", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0"],
    "epl": [
        "licensed under the Eclipse Public License",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE",
    ],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2",
        "released under the GPLv2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "released under the GPLv3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "isc": [
        "released under the ISC License",
        "licensed under the ISC license",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "released under the LGPL",
        "SPDX-License-Identifier: LGPL-3.0",
        "SPDX-License-Identifier: LGPL-2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "mit": [
        "Released under the MIT License",
        "licensed under the MIT License",
        "distributed under the terms of the MIT licence",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": ["All rights reserved. No part may be reproduced without written permission", "proprietary and confidential, all rights reserved"],
    "unlicense": [
        "released into the public domain under the Unlicense",
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
    ],
}
ORDERS = (1, 2, 3)
#: Words of a window, and from one window to the next; no template is longer than what two of them share.
WINDOW, STRIDE = 64, 32
#: Share of a template's word pairs that must be found.
FOUND = 0.6


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted table: a byte map on the low bits first, then a search for the few left."""
    seen = np.zeros(1 << 16, bool)
    seen[table & np.uint64(0xFFFF)] = True
    out = seen[x & np.uint64(0xFFFF)]
    at = np.flatnonzero(out)
    p = np.minimum(np.searchsorted(table, x[at]), len(table) - 1)
    out[at] = table[p] == x[at]
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k-word grams, of different orders kept apart."""
    return tk.mix(tk.gram_hashes(h, k) + np.uint64(k))


def spelled(h: np.ndarray) -> np.ndarray:
    """Word hashes with one spelling of licence and license, and of their forms."""
    british, american = spellings()
    at = np.searchsorted(british, h)
    at[at == len(british)] = 0
    return np.where(british[at] == h, american[at], h)


@lru_cache(maxsize=1)
def spellings() -> tuple[np.ndarray, np.ndarray]:
    forms = ["licence", "licences", "licenced", "license", "licenses", "licensed"]
    data = np.frombuffer(" ".join(forms).encode(), np.uint8)
    h, _ = tk.word_hashes(data, np.array([0, len(data)]), tk.ALNUM)
    by = np.argsort(h[:3])
    return h[:3][by], h[3:][by]


def hashed(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, data, offs in tk.slices(pa.array(texts, pa.string())):
        h, first = tk.word_hashes(data, offs, tk.ALNUM)
        h = spelled(h)
        out += [h[first[i] : first[i + 1]] for i in range(len(offs) - 1)]
    return out


def paragraphs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in the row, first word, word hashes) of the blocks of lines with words; ``first`` has one more at the end."""
    row, _, h, first = line_words(data, offs)
    some = np.diff(first) > 0
    begins = some & np.append(True, ~some[:-1] | (row[1:] != row[:-1]))[: len(some)]
    at = np.flatnonzero(begins)
    of = row[at]
    head = np.searchsorted(of, np.arange(len(offs) - 1))
    return of, np.arange(len(of)) - head[of] if len(of) else of, np.append(first[at], len(h)), spelled(h)


class Scanner:
    """The vocabulary, the weights, the calibration, and the templates' grams."""

    def __init__(self, background: list[str], seed: int = 0, per_template: int = 30, rounds: int = 120):
        self.families = sorted(TEMPLATES)
        words = [hashed(TEMPLATES[f]) for f in self.families]
        self.templates = [(i, np.unique(grams(w, 2))) for i, ws in enumerate(words) for w in ws]
        self.vocab = np.unique(np.concatenate([grams(w, k) for ws in words for w in ws for k in ORDERS if len(w) >= k]))
        self.pairs = np.unique(np.concatenate([t for _, t in self.templates]))
        self.template_pairs = [(f, np.searchsorted(self.pairs, t)) for f, t in self.templates]
        rng = np.random.default_rng(seed)
        plain = [w for h in hashed(background) for w in (h[i : i + WINDOW] for i in range(0, len(h), WINDOW))] or [np.arange(1, 40, dtype=np.uint64)]
        none = len(self.families)
        # One template of each family that has three is left out of the first fit, and a quarter of the rest.
        unseen = [(i, ws[1]) for i, ws in enumerate(words) if len(ws) > 2]
        first = [(i, w) for i, ws in enumerate(words) for j, w in enumerate(ws) if len(ws) <= 2 or j != 1]
        other = self._others(plain, words, rng)
        kept = rng.random(len(other)) < 0.75
        self._fit(*self._examples(first, [o for o, k in zip(other, kept, strict=True) if k], plain, rng, per_template), rounds)
        late = [o for o, k in zip(other, kept, strict=True) if not k] or other
        self._calibrate(*self._examples(unseen, late, plain, rng, per_template))
        self._fit(*self._examples([(i, w) for i, ws in enumerate(words) for w in ws], other, plain, rng, per_template), rounds)
        assert len(self.b) == none + 1

    def _piece(self, plain, rng) -> np.ndarray:
        p = plain[rng.integers(len(plain))]
        a = rng.integers(0, len(p))
        return p[a : a + rng.integers(0, 12)]

    def _others(self, plain, words, rng) -> list[np.ndarray]:
        """Windows of the corpus, and the templates' words out of order, which say nothing."""
        every = np.concatenate([w for ws in words for w in ws])
        loose = [np.concatenate([self._piece(plain, rng), rng.choice(every, rng.integers(1, 8)), self._piece(plain, rng)]) for _ in range(max(200, len(plain) // 4))]
        return [*plain, *loose]

    def _examples(self, chosen, other, plain, rng, per_template: int):
        examples, labels = list(other), [len(self.families)] * len(other)
        for i, w in chosen:
            for _ in range(per_template):
                keep = w[rng.random(len(w)) > rng.choice([0, 0.1])] if len(w) > 5 else w
                examples.append(np.concatenate([self._piece(plain, rng), keep, self._piece(plain, rng)]))
                labels.append(i)
        return examples, np.array(labels)

    def features(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of the distinct grams of the vocabulary in each row."""
        row = tk.row_of(first)
        rows, cols = [], []
        for k in ORDERS:
            g = grams(h, k)
            at = np.flatnonzero(member(g, self.vocab))
            at = at[row[at] == row[at + k - 1]]
            rows.append(row[at])
            cols.append(np.searchsorted(self.vocab, g[at]))
        both = np.unique(np.stack([np.concatenate(rows), np.concatenate(cols)]), axis=1)
        return both[0], both[1]

    def logits(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """``row`` must rise."""
        return self.b + sums(self.w[col], row, n)

    def _rows(self, examples):
        first = np.concatenate([[0], np.cumsum([len(e) for e in examples])])
        return self.features(np.concatenate(examples), first)

    def _fit(self, examples, y, rounds: int, rate: float = 4.0, momentum: float = 0.9, decay: float = 1e-4) -> None:
        """Gradient descent with momentum on the log loss, classes of equal weight."""
        self.w, self.b = np.zeros((len(self.vocab), len(self.families) + 1)), np.zeros(len(self.families) + 1)
        row, col = self._rows(examples)
        by = np.argsort(col, kind="stable")
        weight = 1.0 / np.bincount(y, minlength=len(self.b)).clip(1)[y]
        weight /= weight.sum()
        step_w, step_b = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(rounds):
            p = softmax(self.logits(row, col, len(y)))
            p[np.arange(len(y)), y] -= 1
            p *= weight[:, None]
            step_w = momentum * step_w - rate * (sums(p[row[by]], col[by], len(self.vocab)) + decay * self.w)
            step_b = momentum * step_b - rate * p.sum(axis=0)
            self.w += step_w
            self.b += step_b

    def _calibrate(self, examples, y) -> None:
        """The temperature of least log loss on what the fit hasn't seen, and the bar that one in a hundred of the other windows reaches, 0.5 at least."""
        row, col = self._rows(examples)
        z = self.logits(row, col, len(y))
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        self.temperature = min(np.geomspace(0.1, 10, 41), key=loss)
        odds = self.against_other(z[y == len(self.families)])
        self.bar = max(0.5, float(np.quantile(odds.max(axis=1), 0.99))) if len(odds) else 0.5

    def against_other(self, z: np.ndarray) -> np.ndarray:
        """Each family's probability if there were only it and the other class."""
        return 1 / (1 + np.exp(-(z[:, :-1] - z[:, -1:]) / self.temperature))

    def scan(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(paragraph, family, probability, share of the template found), the best of each paragraph's windows."""
        size = np.diff(first)
        count = np.maximum(1, -(-(size - STRIDE) // STRIDE))
        of = np.repeat(np.arange(len(size)), count)
        begin = first[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(begin + WINDOW, first[of + 1])
        # Without one pair of words of a template none can be confirmed.
        hits = np.concatenate([[0], np.cumsum(member(grams(h, 2), self.pairs)), [0]]) if len(h) > 1 else np.zeros(len(h) + 2, np.int64)
        some = np.flatnonzero(hits[np.maximum(end - 1, begin)] > hits[begin])
        best: dict[tuple[int, int], tuple[float, float]] = {}
        if len(some):  # all windows at once; few are likely to have a family
            windows = [h[begin[i] : end[i]] for i in some.tolist()]
            odds = self.against_other(self.logits(*self._rows(windows), len(windows)))
            for i in np.flatnonzero(odds.max(axis=1) >= self.bar).tolist():
                for f, p, share in self.families_in(windows[i]):
                    key = (int(of[some[i]]), f)
                    best[key] = max(best.get(key, (0.0, 0.0)), (p, share))
        return [(r, f, p, s) for (r, f), (p, s) in sorted(best.items())]

    def found_in(self, own: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(score, share, family, template) of the templates of which FOUND or more stand in a window of these word pairs, best first.

        The score is the pairs found, less two for each that is missing.
        """
        seen = np.isin(self.pairs, own)
        out = []
        for t, (f, at) in enumerate(self.template_pairs):
            n = int(seen[at].sum())
            if n >= FOUND * len(at):
                out.append((n - 2 * (len(at) - n), n / len(at), f, t))
        return sorted(out, reverse=True)

    def families_in(self, w: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """(family, probability, share) for a window: the best confirmed first, its words then taken out.

        Of templates that stand in the window that of the best score counts: a
        family's notice may be part of another's, which is then the longer one.  It must
        be of a family that the regression finds likely.
        """
        while len(w) > 1:
            own = grams(w, 2)
            found = self.found_in(own)
            if not found:
                return
            p = self.against_other(self.logits(*self._rows([w]), 1))[0]
            for _, share, f, t in found:
                at = np.flatnonzero(np.isin(own, self.templates[t][1]))
                runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
                longest = max(runs, key=len)  # words that another notice shares stay where they stand
                if p[f] >= self.bar:
                    yield f, float(p[f]), share
                    w = np.delete(w, np.append(longest, longest[-1] + 1))
                    break
            else:
                return


def sums(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of x added up by ``at``, which rises, below n."""
    out = np.zeros((n, x.shape[1]))
    if len(at):
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[begin]] = np.add.reduceat(x, begin, axis=0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample_docs: int = 400, sample_chars: int = 2000, seed: int = 0, text: str = "text") -> Scanner:
    """A scanner whose other class has seen paragraphs of a bounded sample of documents.

    The sample is ``sample_docs`` documents at most, those of the smallest hashes of
    doc_id, and ``sample_chars`` characters from the start of each; lines in
    which a template stands as it is are left out of it.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.left(F.col(text).cast("string"), F.lit(sample_chars)).alias("body"), F.xxhash64("doc_id").alias("draw"))
    sample = rows.orderBy("draw", "body").limit(sample_docs).toArrow().column("body").to_pylist()
    known = [t.lower() for ts in TEMPLATES.values() for t in ts]
    return Scanner([x for b in sample for x in b.split("\n") if x.strip() and not any(k in x.lower() for k in known)], seed)


OUT = "doc_id {}, n_paragraphs long, hits array<struct<paragraph:long,family:string,probability:double,similarity:double>>"


def scan(docs: DataFrame, scanner: Scanner, text: str = "text") -> DataFrame:
    """doc_id, n_paragraphs (blocks of lines with words) and hits for every row, over whole texts.

    Null and empty texts have no paragraphs.  Repeated rows are scanned alike; a null
    doc_id stays; extra columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    src = docs.select("doc_id", F.col(text).cast("string").alias("_text"))
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            count, hits = [], []
            for _, data, offs in tk.slices(b.column(1)):
                row, number, first, h = paragraphs(data, offs)
                count += np.bincount(row, minlength=len(offs) - 1).tolist()
                found: list[list] = [[] for _ in range(len(offs) - 1)]
                for r, f, p, s in own.scan(h, first) if len(row) else ():
                    found[row[r]].append({"paragraph": int(number[r]), "family": own.families[f], "probability": p, "similarity": s})
                hits += found
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(hits, kind)], names=["doc_id", "n_paragraphs", "hits"])

    return src.mapInArrow(run, OUT.format(src.schema["doc_id"].dataType.simpleString()))
