"""Licence scans: a trained paragraph classifier with template confirmation.

Sparse word n-grams (one to three words) of licence templates are the features
of a softmax regression over licence families and an unknown class. It is
trained here on damaged copies of the templates, and for the unknown class on
look-alikes, their damaged copies and scattered licence words; it reads nothing
of the corpus, so every corpus gets the same model. A temperature and the least
probability of a family are set on whole templates and look-alikes that a fit
hasn't seen: each of FOLDS fits leaves a part of them out. A prediction counts
where the words also hold enough of a template of that family, in order.

Paragraphs are lines; a line that ends without a full stop is joined with the
next one (hard-wrapped notices). A paragraph has every notice that is found in
it: the whole paragraph is classified, then overlapping windows of its words
around template sequences. What a found notice covers is its span; it is left
out, and the words on both sides are searched in the same way. Null and empty
texts have no paragraphs. Repeated rows and null ids give a row each, an empty
table an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Notices of licence families as they are usually worded.
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "This code is distributed under the terms of the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "odbl": (
        "This database is made available under the Open Database License.",
        "Any rights in individual contents of the database are licensed under the Database Contents License.",
        "SPDX-License-Identifier: ODbL-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Copyright notice: all rights reserved.",
    ),
}
#: Names of licences, which stand in short notices of the wordings below.
NAMES = {
    "apache": ("the Apache License, Version 2.0", "the Apache 2.0 license", "the Apache License"),
    "mit": ("the MIT License", "the MIT/X11 license", "an MIT-style license"),
    "bsd": ("the BSD 3-Clause License", "the BSD 2-Clause license", "the BSD license"),
    "gpl": ("the GNU General Public License, version 3", "the GPL version 2 or later", "the GNU GPL v3", "the GPLv3"),
    "lgpl": ("the GNU Lesser General Public License, version 2.1", "the LGPL version 3", "the GNU LGPL"),
    "agpl": ("the GNU Affero General Public License, version 3", "the AGPL version 3", "the GNU AGPL"),
    "mpl": ("the Mozilla Public License 2.0", "the MPL 2.0"),
    "cc-by": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "isc": ("the ISC License", "an ISC-style license"),
    "epl": ("the Eclipse Public License 2.0", "the EPL 2.0"),
    "boost": ("the Boost Software License, Version 1.0", "the Boost license"),
    "zlib": ("the zlib License", "the zlib/libpng license"),
    "unlicense": ("the Unlicense", "the Unlicense license"),
    "odbl": ("the Open Database License", "the ODbL 1.0"),
}
WORDINGS = ("Licensed under {}.", "Released under {}.", "This project is licensed under {}.", "Distributed under the terms of {}.", "This work is made available under {}.")
#: All templates of each family.
TEMPLATES = {family: tuple(dict.fromkeys([*notices, *(w.format(name) for name in NAMES.get(family, ()) for w in WORDINGS)])) for family, notices in NOTICES.items()}
#: Sentences with licence words that license nothing.
LOOKALIKES = (
    "The driver lost his license after the accident last week.",
    "She is a licensed physician in the general hospital of this city.",
    "The public library is free and open to the general public under new terms.",
    "Software version 3 was released under pressure in the first quarter.",
    "The terms of the agreement are subject to the law of the land.",
    "He was licensed to sell wine under the new law.",
    "Redistribution of income is the source of many forms of use.",
    "You may not use this door except in case of fire.",
    "All seats are reserved for the members of the foundation.",
    "The permission to build on this land was granted free of charge by the town.",
    "Copies of the letter were made and distributed to any person in the room.",
    "The work was released to the public in the spring of the third year.",
    "No part of the old wall may be removed without written notice.",
    "In no event did the authors of the report claim any damages.",
    "The source of the river and the form of the valley are subject to change.",
    "The conditions are met when redistribution and use of water are permitted.",
    "An open database of birds was made available to the members of the society.",
    "The software is provided with a printed manual and a warranty of two years.",
    "He waived all rights to the house, and the neighbours reserved the garden.",
    "This program is published by the local theatre and modified every week.",
    "A general public meeting on the terms of the new law is held on Monday.",
    "The eclipse was seen by the public in version after version of the tale.",
    "International trade and attribution of the painting remain under dispute.",
    "The commons is creative ground, licensed by the council for markets.",
    "Boost your software sales, said the notice above the door of the shop.",
)
#: Words of ordinary sentences, which stand around notices in training.
FILLER = (
    "a about after again all almost along also always and another any are around as at away back be because been before began below between both but by came can child children city close come could day did different do door down each earth "
    "end enough even every eye far father feet few find first follow food for found from garden gave get girl give go good great grow had hand hard has have he head hear help her here high him his home house how if important in into is it its "
    "just keep kind know land large last late learn leave left letter life light like line little live long look made make man many may me mean men might mile more morning most mother mountain move much must my name near need never new next night no "
    "now number of off often old on once one only open or other our out over own page paper part people place plant play point press read right river road room run said same saw say school sea second see seem sentence set she should show side "
    "small so some something sometimes song soon sound spell stand start state still stop story study such take talk tell than that the their them then there these they thing think this those thought three through time to together too took tree turn "
    "two under until up us use very walk want was watch water way we well went were what when where which while white who why will with without word work world would write year you young your"
).split()

UNKNOWN = "unknown"
WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
COPIES, STEPS, FOLD_STEPS, DECAY = 16, 250, 120, 1e-4
FOLDS = 3
TEMPERATURES = (0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)
#: Least share of a template's three-word sequences that a confirmed paragraph holds.
CONFIRM = 0.5
FALSE_RATE, LEAST, MOST = 0.002, 0.3, 0.9
OPEN_LINE = re.compile(r"[^.!?:;\s]\s*$")
#: Lengths in words of the windows of a paragraph; they overlap by half. Stretches without template sequences of GAP words part the windows' groups.
WINDOWS, GAP = (48, 24, 12, 6, 2), 12


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def paragraphs(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of all paragraphs with a word, in code points."""
    if not text:
        return
    start, at = None, 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            start = at if start is None else start
            if not OPEN_LINE.search(line.rstrip()[-1:]):
                yield start, end
                start = None
        elif start is not None:
            yield start, at - 1
            start = None
        at = end + 1
    if start is not None:
        yield start, len(text)


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    temperature: float
    least: float
    single: frozenset

    def probabilities(self, found: list[list[int]]) -> np.ndarray:
        z = np.array([self.weights[f].sum(axis=0) + self.weights[-1] for f in found]) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def features(self, words: list[str]) -> list[int]:
        """Numbers of the known n-grams; longer ones are built only from known words."""
        if self.single.isdisjoint(words):
            return []
        known, out, v = [w in self.single for w in words], set(), self.vocabulary
        for i, k in enumerate(known):
            if k:
                out.add(v[words[i]])
                if i + 1 < len(words) and known[i + 1]:
                    if (g := v.get(pair := words[i] + " " + words[i + 1])) is not None:
                        out.add(g)
                    if i + 2 < len(words) and known[i + 2] and (g := v.get(pair + " " + words[i + 2])) is not None:
                        out.add(g)
        return sorted(out)

    def classify(self, paragraph: str) -> tuple[str, float] | None:
        """The confirmed family of a paragraph as a whole and its probability."""
        return self.family(words_of(paragraph))

    def family(self, words: list[str]) -> tuple[str, float] | None:
        """The confirmed family of words and its probability."""
        found = self.features(words)
        if not found:
            return None
        p = self.probabilities([found])[0]
        best = int(p.argmax())
        if self.families[best] == UNKNOWN or p[best] < self.least or not confirmed(words, self.families[best]):
            return None
        return self.families[best], float(p[best])

    def classify_all(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(start, end, family, probability) of all notices among a paragraph's words, in order."""
        out: list[tuple[int, int, str, float]] = []
        parts = [(0, len(words))] if anchors(words) else []
        while parts:
            at, stop = parts.pop()
            part = words[at:stop]
            whole = self.family(part)
            for s, e in [(0, len(part))] if whole else groups(part):
                piece, cut = part[s:e], []
                for start, end, family, p in [(0, len(piece), *whole)] if whole else self._windows(piece):
                    for a, b in covered(piece[start:end], family):
                        cut.append((start + a, start + b))
                        out.append((at + s + start + a, at + s + start + b, family, p))
                done = 0
                for a, b in sorted(cut) + [(len(piece), len(piece))] * bool(cut):
                    if done < a and anchors(piece[done:a]):
                        parts.append((at + s + done, at + s + a))
                    done = max(done, b)
        return _merged(out)

    def _windows(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(start, end, family, probability) of the windows with a confirmed family, of the largest length that has any."""
        for size in WINDOWS:
            starts = range(0, max(1, len(words) - size // 2), size // 2)
            if found := [(at, at + size, *f) for at in starts if (f := self.family(words[at : at + size]))]:
                return found
        return []


def _merged(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Notices of one family that overlap, in windows that do, are one."""
    out: list[tuple[int, int, str, float]] = []
    for start, end, family, p in sorted(found, key=lambda x: (x[2], x[0], x[1])):
        if out and out[-1][2] == family and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1]), family, max(p, out[-1][3])
        else:
            out.append((start, end, family, p))
    return sorted(out)


def _sequences(words: list[str]) -> list[tuple[str, ...]]:
    """Three-word sequences; all words where they are fewer."""
    return [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))]


#: The sequences of each family's templates, and the first words of those of all; nothing is confirmed without one.
SEQUENCES = {family: {q for t in templates for q in _sequences(words_of(t))} for family, templates in TEMPLATES.items()}
TRIPLES = frozenset(q for qs in SEQUENCES.values() for q in qs if len(q) == 3)
TAGS = {q for qs in SEQUENCES.values() for q in qs if len(q) < 3}
TAG_WORDS = frozenset(q[0] for q in TAGS)


#: The sequences and the words of each template.
WANTED = {family: [(frozenset(_sequences(words_of(t))), frozenset(words_of(t))) for t in templates] for family, templates in TEMPLATES.items()}


def anchors(words: list[str]) -> list[int]:
    """Where words of a template begin."""
    out = [i for i, q in enumerate(zip(words, words[1:], words[2:], strict=False)) if q in TRIPLES]
    return out + [i for i, w in enumerate(words) if w in TAG_WORDS] if not TAG_WORDS.isdisjoint(words) else out


def groups(words: list[str]) -> list[tuple[int, int]]:
    """Stretches (start, end) of words around anchors, with GAP words on each side; those that meet are one."""
    out: list[tuple[int, int]] = []
    for at in sorted(anchors(words)):
        s, e = max(0, at - GAP), min(len(words), at + 3 + GAP)
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], e
        else:
            out.append((s, e))
    return out


def covered(words: list[str], family: str) -> list[tuple[int, int]]:
    """Runs (start, end) of words in sequences of the family's templates: those that confirm it alone, or else the longest ones."""
    known, runs = SEQUENCES[family], []
    for i in range(len(words)):
        for n in (3, 2):
            if tuple(words[i : i + n]) in known:
                end = min(i + n, len(words))
                if runs and i < runs[-1][1]:
                    runs[-1] = runs[-1][0], max(runs[-1][1], end)
                else:
                    runs.append((i, end))
                break
    longest = max((e - s for s, e in runs), default=0)
    return [r for r in runs if confirmed(words[r[0] : r[1]], family)] or [r for r in runs if r[1] - r[0] == longest] or [(0, len(words))]


def confirmed(words: list[str], family: str) -> bool:
    """Whether the words hold enough of a template of the family."""
    have = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} | {tuple(words)}
    return any(len(want & have) >= CONFIRM * len(want) or (len(own) <= 4 and own <= set(words)) for want, own in WANTED[family])


def _damaged(template: list[str], filler: np.ndarray, rng: np.random.Generator) -> list[str]:
    """A copy with some words lost or changed, perhaps cut, between other words."""
    kept = [w if rng.random() > 0.06 else str(rng.choice(filler)) for w in template if rng.random() > 0.04]
    if len(kept) > 14 and rng.random() < 0.4:
        kept = kept[: int(len(kept) * rng.uniform(0.6, 1))]
    around = lambda: rng.choice(filler, rng.integers(0, 12)).tolist()
    return around() + kept + around()


@dataclass
class Examples:
    """Training texts: their words, class and the number of the sentence that they come from."""

    words: list[list[str]]
    classes: np.ndarray
    sources: np.ndarray


def _examples(seed: int) -> Examples:
    """Damaged copies of all sentences, the look-alikes as they are, and scattered licence words (with sources of their own)."""
    rng, filler = np.random.default_rng(seed), np.array(FILLER, object)
    unknown = len(TEMPLATES)
    # A family's templates get numbers in turn, so that a fold leaves out one or two of each.
    sentences = [(k, i, words_of(t)) for k, ts in enumerate(TEMPLATES.values()) for i, t in enumerate(ts)] + [(unknown, i, words_of(t)) for i, t in enumerate(LOOKALIKES)]
    rows = [(_damaged(words, filler, rng), k, i) for k, i, words in sentences for _ in range(COPIES)] + [(words, k, i) for k, i, words in sentences if k == unknown]
    scattered = np.array(sorted({w for k, _, words in sentences if k != unknown for w in words}), object)
    rows += [(rng.choice(scattered, rng.integers(2, 12)).tolist() + rng.choice(filler, rng.integers(0, 12)).tolist(), unknown, i) for i in range(60 * COPIES)]
    return Examples([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def _untrained(examples: Examples, part: np.ndarray) -> Model:
    """A model without weights whose features are the n-grams of the licence texts among some examples."""
    licensed = [w for w, k, use in zip(examples.words, examples.classes, part, strict=True) if use and k < len(TEMPLATES)]
    known = {g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t))}
    vocabulary = {g: i for i, g in enumerate(sorted({g for words in licensed for g in grams(words)} & known))}
    single = frozenset(g for g in vocabulary if " " not in g)
    return Model([*TEMPLATES, UNKNOWN], vocabulary, np.zeros((len(vocabulary) + 1, len(TEMPLATES) + 1)), 1.0, LEAST, single)


def _matrix(model: Model, texts: list[list[str]]) -> np.ndarray:
    x = np.zeros((len(texts), len(model.vocabulary) + 1), np.float32)
    for i, words in enumerate(texts):
        x[i, model.features(words)] = 1
    x[:, -1] = 1
    return x


def fit(seed: int = 3) -> Model:
    """The model of the templates; its threshold and temperature come from sentences that FOLDS fits didn't see."""
    examples = _examples(seed)
    z, y = [], []
    for fold in range(FOLDS):
        test = examples.sources % FOLDS == fold
        model = _untrained(examples, ~test)
        model.weights = _regression(_matrix(model, [w for w, t in zip(examples.words, test, strict=True) if not t]), examples.classes[~test], len(model.families), FOLD_STEPS)
        z.append((_matrix(model, [w for w, t in zip(examples.words, test, strict=True) if t]) @ model.weights).astype(np.float64))
        y.append(examples.classes[test])
    z, y = np.concatenate(z), np.concatenate(y)
    model = _untrained(examples, np.ones(len(y), bool))
    model.weights = _regression(_matrix(model, examples.words), examples.classes, len(model.families), STEPS)

    def log_p(t: float) -> np.ndarray:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    model.temperature = TEMPERATURES[int(np.argmin([-log_p(t)[np.arange(len(y)), y].mean() for t in TEMPERATURES]))]
    false = np.sort(np.exp(log_p(model.temperature)[y == len(TEMPLATES), :-1]).max(axis=1))
    model.least = float(np.clip(false[int((1 - FALSE_RATE) * (len(false) - 1))], LEAST, MOST))
    return model


def _regression(x: np.ndarray, y: np.ndarray, classes: int, steps: int) -> np.ndarray:
    """Softmax regression by accelerated gradient steps."""
    hot = np.eye(classes, dtype=np.float32)[y]
    w = ahead = np.zeros((x.shape[1], classes), np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 2.0 * len(y) / float(np.linalg.norm(x @ v) ** 2)
    for step in range(steps):
        z = x @ ahead
        e = np.exp(z - z.max(axis=1, keepdims=True))
        w, before = ahead - rate * (x.T @ (e / e.sum(axis=1, keepdims=True) - hot) / len(y) + DECAY * ahead), w
        ahead = w + np.float32(step / (step + 3)) * (w - before)
    return w


def scan_text(text: str | None, model: Model) -> list[tuple[str, int, int, float]]:
    """(family, start, end, probability) of all notices, in code points, from their first word to their last."""
    out = []
    for s, e in paragraphs(text):
        # Offsets hold as lower case changes the length of few letters, none of a word's; those paragraphs are mapped letter by letter.
        part = text[s:e]
        low = part.lower()
        if len(low) != len(part):
            low = "".join(c.lower() if len(c.lower()) == 1 else " " for c in part)
        places = [m.span() for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in places]
        if model.single.isdisjoint(words):
            continue
        out += [(family, s + places[a][0], s + places[b - 1][1], p) for a, b, family, p in model.classify_all(words)]
    return out


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_notices, families, spans) of every row; families sorted, spans as family:start:end in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({x[0] for x in f})) for f in found], pa.string()),
                    pa.array([",".join(f"{k}:{s}:{e}" for k, s, e, _ in f) for f in found], pa.string()),
                ],
                names=[id_col, "n_notices", "families", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_notices long, families string, spans string")
