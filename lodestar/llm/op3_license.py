"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are separated by blank lines, so that a statement may wrap; they are looked at in overlapping windows, and line by line. A
sparse logistic regression over hashed word unigrams and bigrams names a licence family, ``unknown`` (terms of use of no known
family) or nothing. It learns from PARAGRAPHS (what the licences themselves say), from statements that a small grammar
makes of their names, from other terms, and from text of the corpus; its probabilities are calibrated on statements held out
from training. A named family counts only if one of its TEMPLATES, a list apart from what it learned from, is in the
window; otherwise it is unknown. Statements that something is *not* under a licence don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import words
from lodestar.llm.common import bounded_batches, documents

NONE, UNKNOWN = "none", "unknown"
# What the licences are called, and what their own texts say.
NAMES: dict[str, list[str]] = {
    "apache": ["apache license", "apache license version 2.0", "apache 2.0 license", "apache software license", "asl 2.0"],
    "mit": ["mit license", "mit licence", "expat license", "mit style license"],
    "gpl": ["gnu general public license", "gnu general public license version 3", "gnu gpl", "gnu gpl version 2 or later", "gpl v3", "gplv2", "gplv3 license"],
    "lgpl": ["gnu lesser general public license", "gnu lesser general public license version 2.1", "lgpl version 2.1", "gnu lgpl", "lgplv3"],
    "agpl": ["gnu affero general public license", "gnu affero general public license version 3", "agpl version 3", "gnu agpl", "agplv3"],
    "bsd": ["bsd license", "bsd 3 clause license", "bsd 2 clause license", "new bsd license", "simplified bsd license"],
    "mpl": ["mozilla public license", "mozilla public license version 2.0", "mpl 2.0", "mpl version 1.1"],
    "cc-by": ["cc by 4.0", "cc by 3.0 license", "creative commons attribution license", "creative commons attribution 4.0 international license"],
    "cc-by-sa": ["cc by sa 4.0", "cc by sa 3.0 license", "creative commons attribution share alike license", "creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["cc by nc 4.0", "cc by nc license", "creative commons attribution non commercial license", "creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nd": ["cc by nd 4.0", "cc by nd license", "creative commons attribution no derivatives license", "creative commons attribution noderivatives 4.0 international license"],
    "cc0": ["cc0 1.0", "cc0 1.0 universal", "creative commons zero", "cc0 public domain dedication"],
    "isc": ["isc license", "isc licence"],
    "unlicense": ["unlicense", "unlicense license"],
    "cddl": ["common development and distribution license", "cddl version 1.0", "cddl 1.1"],
    "wtfpl": ["do what the fuck you want to public license", "wtfpl version 2", "wtfpl"],
    "epl": ["eclipse public license", "eclipse public license version 2.0", "epl 2.0"],
    "boost": ["boost software license", "boost software license version 1.0"],
    "zlib": ["zlib license", "zlib libpng license"],
}
SPDX: dict[str, list[str]] = {
    "apache": ["apache 2.0"], "mit": ["mit"], "gpl": ["gpl 2.0 only", "gpl 2.0 or later", "gpl 3.0 only", "gpl 3.0 or later"], "lgpl": ["lgpl 2.1 only", "lgpl 2.1 or later", "lgpl 3.0 or later"],
    "agpl": ["agpl 3.0 only", "agpl 3.0 or later"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "mpl": ["mpl 2.0"], "cc-by": ["cc by 4.0"], "cc-by-sa": ["cc by sa 4.0"], "cc-by-nc": ["cc by nc 4.0"],
    "cc-by-nd": ["cc by nd 4.0"], "cc0": ["cc0 1.0"], "isc": ["isc"], "unlicense": ["unlicense"], "cddl": ["cddl 1.0", "cddl 1.1"], "wtfpl": ["wtfpl"], "epl": ["epl 1.0", "epl 2.0"], "boost": ["bsl 1.0"], "zlib": ["zlib"],
}
PARAGRAPHS: dict[str, list[str]] = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0."],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose"],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https www eclipse org legal epl 2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https www boost org LICENSE_1_0.txt"],
    "zlib": ["This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.", "Copyright 2020 by the authors. All rights reserved.", "All rights reserved.", "This document is proprietary and confidential. Unauthorised copying of this file is strictly prohibited."],
}
#: What confirms a family, each enough by itself: word sequences that only it has. Longer ones of other families rule shorter ones out.
TEMPLATES: dict[str, list[str]] = {
    "apache": ["apache license", "apache software license", "apache 2.0", "asl 2.0"],
    "mit": ["mit license", "mit licence", "expat license", "mit style license", "spdx license identifier mit", "permission is hereby granted free of charge to any person obtaining a copy", "rights to use copy modify merge publish distribute sublicense"],
    "gpl": ["gnu general public license", "gnu gpl", "gpl v3", "gpl v2", "gplv2", "gplv3", "gpl 2.0", "gpl 3.0"],
    "lgpl": ["gnu lesser general public license", "gnu lgpl", "lgpl version", "lgpl 2.1", "lgpl 3.0", "lgpl v3", "lgplv3"],
    "agpl": ["gnu affero general public license", "gnu agpl", "agpl version", "agpl 3.0", "agpl v3", "agplv3"],
    "bsd": ["bsd license", "bsd 3 clause", "bsd 2 clause", "redistribution and use in source and binary forms with or without modification", "redistributions of source code must retain the above copyright notice"],
    "mpl": ["mozilla public license", "mpl 2.0", "mpl version 1.1"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-sa": ["cc by sa", "attribution share alike", "attribution sharealike"],
    "cc-by-nc": ["cc by nc", "attribution non commercial", "attribution noncommercial"],
    "cc-by-nd": ["cc by nd", "attribution no derivatives", "attribution noderivatives"],
    "cc0": ["cc0 1.0", "creative commons zero", "cc0 public domain", "dedicated all copyright and related and neighboring rights"],
    "isc": ["isc license", "isc licence", "spdx license identifier isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"],
    "unlicense": ["the unlicense", "unlicense license", "spdx license identifier unlicense", "free and unencumbered software"],
    "cddl": ["common development and distribution license", "cddl version", "cddl 1.0", "cddl 1.1"],
    "wtfpl": ["do what the fuck you want to public license", "wtfpl"],
    "epl": ["eclipse public license", "epl 2.0", "epl 1.0"],
    "boost": ["boost software license", "spdx license identifier bsl 1.0"],
    "zlib": ["zlib license", "zlib libpng license", "spdx license identifier zlib", "permission is granted to anyone to use this software for any purpose including commercial applications"],
    "proprietary": ["all rights reserved", "proprietary and confidential", "no part of this work may be reproduced", "no part of this publication may be reproduced", "unauthorised copying of this file is strictly prohibited"],
}
NOT = ["not", "never", "isn", "aren", "wasn", "neither", "nor", "no longer"]
VERBS = ["released", "licensed", "licenced", "distributed", "available", "covered", "published", "offered", "provided", "subject", "under"]
#: Words of which one must be in a pair that speaks for unknown terms.
TERM_WORDS = ["license", "licence", "licensed", "licenced", "terms", "permission", "conditions", "distributed", "released", "agreement"]
OTHER_TERMS = [
    "use of this material is subject to the terms of the site agreement", "licensed under the terms of our partner agreement", "you may copy this text for personal use only",
    "distributed under a licence of the author", "released under a custom license", "this document is licensed to the members of the society", "see the license file for the conditions of use",
    "permission to quote is granted to subscribers", "licensed content from our suppliers applies here", "by using this work you accept the licence terms below", "this work is licensed under the village public license",
]
NOT_TERMS = [
    "she renewed her driving license in march", "the license plate of the car was missing", "a fishing licence costs ten pounds", "the general public was not amused", "poetic license is a fine thing",
    "the apache helicopter landed", "students at mit built a robot", "he moved from berkeley to boston", "the creative commons room is upstairs", "version 2.0 of the program came out", "all rights and all wrongs were discussed",
    "he reserved a table for four", "the foundation published a list of public places", "she was granted permission to leave early", "free of charge and open to any person", "work is the source of all things", "copyright is a chapter of the course",
]
BITS = 16
WIDTH, STRIDE = 20, 8
#: Pieces of corpus text, of so many characters, that training takes at most.
SAMPLE, PIECE = 1500, 400
#: Statements of each family that training makes.
EACH = 90
#: Least calibrated probability of any terms: of a family that a template confirms, and of unknown ones.
LIKELY, CONFIDENT = 0.1, 0.5
#: Characters that are looked at together, and that parts of one line share: a window's worth of words.
LONG, OVERLAP = 1 << 19, 300
#: Different pairs of any terms that unknown ones need; words between a negation and what it denies.
TERMS, REACH = 2, 3


def _features(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word and of the pair it begins, and whether that pair stays in its line."""
    mask = np.uint64((1 << BITS) - 1)
    pair = np.zeros(len(h), np.uint64)
    inside = np.zeros(len(h), bool)
    if len(h) > 1:
        pair[:-1] = words.mixed(h[:-1] * words.BASE + h[1:])
        inside[:-1] = line[1:] == line[:-1]
    return ((h >> np.uint64(20)) & mask).astype(np.int64), ((pair >> np.uint64(20)) & mask).astype(np.int64), inside


class Classifier:
    """Multinomial logistic regression over hashed features; a window's score is its features' sum over a root of its length."""

    def __init__(self, classes: list[str]) -> None:
        self.classes = classes
        self.weight = np.zeros((1 << BITS, len(classes)))
        self.bias = np.zeros(len(classes))
        self.temperature = 1.0

    def train(self, windows: list[tuple[np.ndarray, int]], rng: np.random.Generator, epochs: int = 6, rate: float = 0.5) -> None:
        seen, seen_bias = np.full_like(self.weight, 1e-6), np.full_like(self.bias, 1e-6)
        share = np.bincount([y for _, y in windows], minlength=len(self.classes))
        for _ in range(epochs):
            for i in rng.permutation(len(windows)):
                x, y = windows[i]
                scale = len(x) ** -0.5
                z = self.bias + self.weight[x].sum(axis=0) * scale
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                p *= min(4.0, (len(windows) / len(self.classes) / share[y]) ** 0.5)
                seen[x] += (p * scale) ** 2
                self.weight[x] -= rate * p * scale / np.sqrt(seen[x])
                seen_bias += p * p
                self.bias -= rate * p / np.sqrt(seen_bias)

    def calibrate(self, windows: list[tuple[np.ndarray, int]]) -> None:
        """The temperature under which windows that weren't trained on are most likely."""
        z = np.array([self.bias + self.weight[x].sum(axis=0) * len(x) ** -0.5 for x, _ in windows])
        y = np.array([y for _, y in windows])

        def loss(t: float) -> float:
            s = z / t
            s -= s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        self.temperature = min(np.geomspace(0.25, 8, 41), key=loss)

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _windows(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the windows over each line's words."""
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.r_[0, np.flatnonzero(line[1:] != line[:-1]) + 1]
    end = np.r_[first[1:], len(line)]
    many = np.maximum(1, -(-(end - first - WIDTH) // STRIDE) + 1)
    of = np.repeat(np.arange(len(first)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    begin = first[of] + nth * STRIDE
    return begin, np.minimum(begin + WIDTH, end[of])


def _vectors(texts: list[str]) -> Iterator[np.ndarray]:
    for t in texts:
        for h, _, (line, _), _, _ in words.blocks([t], paragraphs=True):
            uni, pair, inside = _features(h, line)
            for b, e in zip(*(x.tolist() for x in _windows(line)), strict=True):
                yield np.r_[uni[b:e], pair[b:e][inside[b:e] & (np.arange(b, e) < e - 1)]]


def fit(corpus: list[str], seed: int = 3) -> Classifier:
    """Train on the licences' paragraphs, on statements of their names and, as text without any, pieces of the corpus."""
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    classes = [NONE, UNKNOWN, *families]
    plain = np.array([w for t in corpus for w in t.split()] or ["and", "of", "it", "was", "here"])
    some = lambda n: " ".join(rng.choice(plain, n)) if n else ""
    works = ["this work is", "this file is", "the text is", "the code below is", "our dataset is", "this library is", "it is", ""]
    verbs = ["licensed under the", "licensed under", "released under the", "distributed under the terms of the", "available under the", "published under a", "covered by the", "subject to the"]
    closings = ["see below", "by the authors", "for details see the website", "", "", ""]

    def within(core: str) -> str:
        """The statement amid the corpus, as a window may see it."""
        core = " ".join(w for w in core.split() if rng.random() > 0.03)
        spare = max(0, WIDTH - len(core.split()) - 2)
        before = int(rng.integers(0, spare + 1)) * (rng.random() < 0.6)
        return f"{some(before)} {core} {some(int(rng.integers(0, spare - before + 1)) * (rng.random() < 0.6))}"

    def said(name: str) -> str:
        return within(" ".join([str(rng.choice(works)), str(rng.choice(verbs)), name, str(rng.choice(closings))]))

    def piece(text: str) -> str:
        """A part of a licence's own paragraph, as long as a window or shorter."""
        w = text.split()
        begin = int(rng.integers(0, max(1, len(w) - 14)))
        return within(" ".join(w[begin : begin + int(rng.integers(14, WIDTH + 1))]))

    made: list[tuple[str, str]] = []
    for family in families:
        names, tags = NAMES.get(family, []), SPDX.get(family, [])
        makers = [*([lambda: said(str(rng.choice(names)))] if names else []), *([lambda: within("spdx license identifier " + str(rng.choice(tags)))] if tags else [])]
        makers += [lambda: piece(str(rng.choice(PARAGRAPHS[family])))] if family in PARAGRAPHS else []
        made += [(makers[k % len(makers)](), family) for k in range(EACH)]
    made += [(within(str(rng.choice(OTHER_TERMS))), UNKNOWN) for _ in range(2 * EACH)]
    made += [(within(str(rng.choice(NOT_TERMS))), NONE) for _ in range(2 * EACH)]
    triggers = ("licens", "licenc", "copyright", "all rights", "public domain")
    made += [(t, NONE) for t in corpus if not any(w in t.lower() for w in triggers)]
    made += [(" ".join([str(rng.choice(works)), some(int(rng.integers(1, 12)))]), NONE) for _ in range(2 * EACH)]
    examples = [(np.unique(v), classes.index(y)) for t, y in made for v in _vectors([t]) if len(v)]
    held = rng.random(len(examples)) < 0.2
    model = Classifier(classes)
    model.train([x for x, h in zip(examples, held, strict=True) if not h], rng)
    model.calibrate([x for x, h in zip(examples, held, strict=True) if h])
    return model


def _parts(text: str) -> Iterator[str]:
    """Parts of about LONG characters, cut at the end of a paragraph; within one that is longer, at a blank, with OVERLAP."""
    at = 0
    while len(text) - at > LONG:
        to = text.rfind("\n\n", at, at + LONG) + 2
        if to <= at + 1:
            to = text.rfind(" ", at + LONG // 2, at + LONG) + 1 or at + LONG
            yield text[at:to]
            at = to - OVERLAP
        else:
            yield text[at:to]
            at = to
    yield text[at:]


def _hashed(phrase: str) -> list[int]:
    return next(words.blocks([phrase]))[0].tolist()


class Scanner:
    def __init__(self, model: Classifier) -> None:
        self.model = model
        self.weight = model.weight.astype(np.float32)
        #: by first word: (family, the whole sequence)
        self.templates: dict[int, list[tuple[str, list[int]]]] = {}
        for family, phrases in TEMPLATES.items():
            for p in phrases:
                h = _hashed(p)
                self.templates.setdefault(h[0], []).append((family, h))
        self.no, self.verbs = ({h for w in of for h in _hashed(w)[:1]} for of in (NOT, VERBS))
        word = np.array([_hashed(w)[0] for w in TERM_WORDS], np.uint64)
        pairs = []
        for p in [*OTHER_TERMS, *(n for names in NAMES.values() for n in names)]:
            h = np.array(_hashed(p), np.uint64)
            g, at = words.grams(h, np.zeros(len(h), np.int64), 2)
            pairs.append(g[np.isin(h[at], word) | np.isin(h[at + 1], word)])
        self.terms = np.unique(np.concatenate(pairs))

    def confirmed(self, h: list[int]) -> dict[str, int]:
        """The families with a template in these words, and the words of the longest; what lies in a longer one of another
        family doesn't count, nor does what a negation before it denies."""
        found: list[tuple[int, int, str]] = []
        for i, x in enumerate(h):
            found += [(i, i + len(t), family) for family, t in self.templates.get(x, ()) if h[i : i + len(t)] == t]
        best: dict[str, int] = {}
        for a, z, family in found:
            within = any(b <= a and z <= y and y - b > z - a and other != family for b, y, other in found)
            if not within and not self._denied(h, a):
                best[family] = max(best.get(family, 0), z - a)
        return best

    def _denied(self, h: list[int], at: int) -> bool:
        """If the verb that leads to the words at ``at`` has a negation shortly before it."""
        verb = next((k for k in range(at - 1, max(-1, at - 8), -1) if h[k] in self.verbs), None)
        while verb is not None and verb > 0 and h[verb - 1] in self.verbs:
            verb -= 1
        return verb is not None and any(x in self.no for x in h[max(0, verb - REACH) : verb])

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, float, float]]:
        """(text number, paragraph, family or unknown, probability, words of a template), the best of each paragraph and family.

        Texts beyond LONG characters go in parts that end with a paragraph, so that memory doesn't follow the longest text.
        """
        parts = [(t, p) for t, text in enumerate(texts) for p in _parts(text or "")]
        for p, line, family, chance, share in self._scan([p for _, p in parts]):
            yield parts[p][0], line, family, chance, share

    def _scan(self, texts: list[str]) -> Iterator[tuple[int, int, str, float, float]]:
        for h, of, (line, own_line), _, _ in words.blocks(texts, paragraphs=True):
            if not len(h):
                continue
            uni, pair, inside = _features(h, line)
            pairs = np.where(inside[:, None], self.weight[pair], 0)
            sums = np.zeros((len(h) + 1, len(self.model.classes)))
            np.cumsum(self.weight[uni] + pairs, axis=0, out=sums[1:], dtype=np.float64)
            # over paragraphs, for statements that wrap, and over lines, for those that stand alone
            begin, end = np.unique(np.concatenate([np.stack(_windows(line)), np.stack(_windows(own_line))], axis=1), axis=1)
            n_pairs = np.r_[0, np.cumsum(inside)]
            inner = end - 1  # the pair that a window's last word begins lies outside
            size = (end - begin) + n_pairs[inner] - n_pairs[begin]
            z = self.model.bias + (sums[end] - sums[begin] - pairs[inner]) / np.sqrt(size)[:, None]
            maybe = np.flatnonzero(z[:, 1:].max(axis=1) > z[:, 0] - 5 * self.model.temperature)  # others are below LIKELY by far
            best: dict[tuple[int, int, str], tuple[float, int]] = {}
            for k, p in zip(maybe.tolist(), self.model.probabilities(z[maybe]), strict=True):
                b, e = int(begin[k]), int(end[k])
                top = 1 + int(p[1:].argmax())
                family, share = self.model.classes[top], 0
                if top > 1:
                    lo, hi = max(b - 12, 0), min(e + 12, len(h))  # a template may begin or end beside the window
                    near = h[lo:hi][line[lo:hi] == line[b]].tolist()
                    named = self.confirmed(near)
                    share = named.get(family, 0)
                    if not share and len(named) == 1:  # the template tells siblings apart better than the rest of the window
                        [(family, share)] = named.items()
                    if 1 - p[0] < LIKELY or not share:
                        family = UNKNOWN
                        if any(self._denied(near, k) for k in range(len(near)) if near[k] in self.templates):
                            continue
                if family == UNKNOWN and (1 - p[0] < CONFIDENT or np.isin(self.terms, words.grams(h[b:e], line[b:e], 2)[0]).sum() < TERMS):
                    continue
                key = (int(of[b]), int(line[b]), family)
                chance = float(p[self.model.classes.index(family)]) if family == self.model.classes[top] else float(1 - p[0])
                if chance > best.get(key, (-1.0, 0))[0]:
                    best[key] = (chance, share)
            named = {k[:2] for k in best if k[2] != UNKNOWN}
            for (t, n, family), (chance, share) in sorted(best.items()):
                if family != UNKNOWN or (t, n) not in named:
                    yield t, n, family, chance, share


def sample(df: DataFrame, text_col: str = "text", seed: int = 3) -> list[str]:
    """Pieces of the corpus for training, from rows drawn by hash: SAMPLE of PIECE characters at most."""
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).filter("text <> ''")
    n = rows.count()
    if not n:
        return []
    unit = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    begin = F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.greatest(F.lit(1), F.char_length("text") - PIECE)).cast("int") + 1
    some = rows.filter(unit < min(1.0, 0.8 * SAMPLE / n)).select(F.col("text").substr(begin, F.lit(PIECE)).alias("piece"))
    # copies count once, and the same ones stay on every run
    return sorted(r.piece for r in some.distinct().orderBy(F.xxhash64(F.lit(seed + 2), "piece"), "piece").limit(SAMPLE).collect())


def summary(found: list[tuple[str, float]]) -> tuple[str | None, float | None, str, int, int]:
    """A text's best family and its probability (ties: by name), all known families, statements, and unknown ones of these."""
    known = [x for x in found if x[0] != UNKNOWN]
    best = min(known or found, key=lambda x: (-x[1], x[0]), default=(None, None))
    return *best, ",".join(sorted({x[0] for x in known})), len(found), len(found) - len(known)


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """One row per input row: ``id_col``, family, confidence, families, n_statements, n_unknown.

    ``family`` is the one with the highest calibrated probability (ties: by name), ``unknown`` if there are only terms of
    no known family, null without any; ``families`` all known ones, comma-joined. Null and empty texts have none; null
    ids and repeated rows are rows like others; an empty table gives an empty result; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(fit(sample(df, text_col, seed), seed))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for b in batches:
            found: dict[int, list[tuple[str, float]]] = {}
            for t, _, family, chance, _ in scanner(b.column("text").to_pylist()):
                found.setdefault(t, []).append((family, chance))
            out = []
            for i in range(b.num_rows):
                out.append(summary(found.get(i, [])))
            kinds = [pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
            made = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *made], ["id", "family", "confidence", "families", "n_statements", "n_unknown"])

    found = rows.mapInArrow(run, f"id {kind}, family string, confidence double, families string, n_statements long, n_unknown long")
    return found.withColumnRenamed("id", id_col)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
