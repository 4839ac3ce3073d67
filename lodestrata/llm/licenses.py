"""Licence scan: a trained classifier of paragraphs, confirmed by comparison with templates.

Paragraphs are lines. Features are word n-grams (one to three words) that occur in the notices below and hold at least one
word that isn't a function word; a paragraph is the sparse set of those it has. Notices are the templates, and short ones
made by a rule from licences' names and identifiers. The features follow from these fixed texts alone: how common a notice
is in the documents doesn't change whether it is scored. A softmax regression over these sparse rows has a class for each
family, one for licences that are none of them (``unknown``) and one for ordinary text. It is trained on the notices,
varied by seeded rules (words dropped, cut short, put into running text, behind a copyright line), against ordinary lines
from a bounded sample of the documents, everyday sentences that use words of licences, and scrambled notices, which have
the words of a licence but not its phrases. Notices in which an invented name stands are ``unknown``.

Calibration is cross-fitted in five parts: copies of the families, ordinary lines, and of the other licences *whole
licences* with all their notices are held back in turn. A temperature fits the probabilities of what was held back, and
``least`` is the probability that all but one in a hundred of the held back licences' notices stay under, counting those
that the comparison with templates confirms as a family (0 if there are no more than that).

A paragraph whose probability of being ordinary is half or more is none. Else the likeliest family is confirmed if its
calibrated probability is over ``least`` and reaches that of ``unknown``, and the comparison agrees: the paragraph names the
family (by name or SPDX identifier) and no other, or follows one of its longer templates. It follows a template if the words of
their common blocks make up ``likeness`` of the shorter of the two, and the words that tell licences of one text apart
(versions, and qualifiers such as Affero or NoDerivatives) are the same on both sides. Clauses that licences share
(``SHARED``, such as the opening of the BSD texts) count as the family only in a document where another paragraph is
confirmed as that family. What isn't confirmed is ``unknown``: it reads like a licence, but not surely like one of these.
Equal probabilities go to the family that comes first in ``TEMPLATES``, and among a document's paragraphs to the first.

Scanning is one pass over whole texts without a shuffle; paragraphs without a feature have a score that is known in
advance. Null and empty texts have no paragraphs. Rows that repeat a doc_id are scanned each, and so are rows without one.
An empty table gives no rows (the classifier then knows no ordinary text but the fixed sentences and scrambled notices).
Other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, record_batch, table, tune

#: Notices by which texts state their licence, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "bsd-3-clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "public-domain": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced or distributed in any form without the prior written permission of the publisher.",
        "This software is confidential and proprietary information; unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Clauses of a family that other licences have too.
SHARED = {
    "bsd-3-clause": [
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
}
#: Names by which short notices call a family.
NAMES = {
    "apache-2.0": ["Apache License 2.0", "Apache Software License 2.0", "Apache 2.0"],
    "mit": ["MIT License", "MIT licence", "Expat License"],
    "gpl-3.0": ["GNU General Public License 3", "GNU GPL 3", "GPL 3"],
    "lgpl-2.1": ["GNU Lesser General Public License 2.1", "GNU LGPL 2.1", "LGPL 2.1"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Revised BSD License", "Modified BSD License", "BSD-3-Clause"],
    "mpl-2.0": ["Mozilla Public License 2.0", "MPL 2.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "public-domain": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero 1.0", "The Unlicense"],
    "proprietary": ["All rights reserved"],
}
#: SPDX identifiers of the families.
IDENTIFIERS = {
    "apache-2.0": ["Apache-2.0"],
    "mit": ["MIT"],
    "gpl-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "bsd-3-clause": ["BSD-3-Clause"],
    "mpl-2.0": ["MPL-2.0"],
    "cc-by-nc-4.0": ["CC-BY-NC-4.0"],
    "cc-by-4.0": ["CC-BY-4.0"],
    "cc-by-sa-4.0": ["CC-BY-SA-4.0"],
    "public-domain": ["CC0-1.0", "Unlicense"],
}
#: Notices, names and identifiers of licences that are none of the families, though some share most words
#: with one.
OTHERS = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "lgpl-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mpl-1.1": [
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
        "Licensed under the Mozilla Public License, version 1.1.",
    ],
    "apache-1.1": ["Licensed under the Apache License, Version 1.1."],
    "cc-by-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-sa-3.0": ["Licensed under CC BY-SA 3.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "eupl-1.2": ["Licensed under the EUPL, version 1.2."],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "perl": ["This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself."],
    "busl": ["Use of this software is governed by the Business Source License."],
}
OTHER_NAMES = {
    "agpl-3.0": ["GNU Affero General Public License 3", "GNU AGPL 3", "AGPL 3"],
    "gpl-2.0": ["GNU General Public License 2", "GNU GPL 2", "GPL 2"],
    "lgpl-3.0": ["GNU Lesser General Public License 3", "LGPL 3"],
    "mpl-1.1": ["Mozilla Public License 1.1", "MPL 1.1"],
    "apache-1.1": ["Apache License 1.1", "Apache Software License 1.1"],
    "bsd-2-clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "cc-by-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "CC BY-NC-ND 4.0"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0"],
    "cc-by-sa-3.0": ["CC BY-SA 3.0"],
    "isc": ["ISC License"],
    "zlib": ["zlib License"],
    "epl-2.0": ["Eclipse Public License 2.0", "EPL 2.0"],
    "eupl-1.2": ["European Union Public Licence 1.2", "EUPL 1.2"],
    "ofl-1.1": ["SIL Open Font License 1.1"],
    "artistic-2.0": ["Artistic License 2.0"],
    "boost-1.0": ["Boost Software License 1.0"],
    "cddl-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"],
    "busl": ["Business Source License 1.1"],
}
OTHER_IDENTIFIERS = {
    "agpl-3.0": ["AGPL-3.0-only"], "gpl-2.0": ["GPL-2.0-only"], "lgpl-3.0": ["LGPL-3.0-or-later"], "bsd-2-clause": ["BSD-2-Clause"], "isc": ["ISC"], "zlib": ["Zlib"], "epl-2.0": ["EPL-2.0"], "cc-by-nd-4.0": ["CC-BY-ND-4.0"],
}
#: The sentences in which names stand, and the line of an identifier.
FRAMES = [
    "{}", "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Distributed under the terms of the {}.",
    "This project is licensed under the {} - see the LICENSE file for details.", "License: {}", "This work is made available under the {}, or (at your option) any later version.",
]
IDENTIFIED = "SPDX-License-Identifier: {}"
#: Everyday sentences with words that licences use too.
EVERYDAY = [
    "He lost his driving license after the accident and had to apply for a new licence.",
    "A fishing license is required by state law for everyone over sixteen.",
    "The restaurant was granted a liquor license under certain conditions last year.",
    "All the seats in the front row were reserved for guests of the author.",
    "Human rights are reserved for no single nation and must be granted to everyone.",
    "The rights of the public were discussed at length, and all files were made available.",
    "She asked for permission to use the copy machine, which was granted free of charge.",
    "The software was free, but its distribution to other offices was limited by the network.",
    "The author of the book sold the copyright to a publisher in London for a small fee.",
    "The general public was not permitted to enter the building without written permission.",
    "The MIT campus in Cambridge is open to the public, and visitors may obtain a map there.",
    "An Apache helicopter of version two was delivered to the foundation of the museum.",
    "Mozilla and the Free Software Foundation held a conference on public policy.",
    "The police checked the license plate of the car and the driver's documentation.",
    "In the domain of public health, warranties are less important than trust.",
    "The contract was subject to the conditions of sale and to applicable law.",
    "They work under the terms of an agreement that neither side wanted to modify.",
    "A universal translator would waive all need for interpreters, to the extent possible.",
    "Creative people in common rooms share their work without restriction or limitation.",
    "The doctor has a license to practice medicine and wrote a notice to all persons.",
    "This version of the story was published in the source material, including all names.",
    "The commercial use of the land is prohibited by the city, and copies of the map are distributed.",
    "The company released the third version of its product under a new name.",
    "He hereby promises to merge the two files and to publish the form in the paper.",
]
NONE, UNKNOWN = "none", "unknown"
#: Documents whose lines stand for ordinary text in training, and lines of theirs that are used. Lines are whole; those
#: beyond ``LONGEST`` characters aren't drawn.
SAMPLE_DOCUMENTS, SAMPLE_LINES, LONGEST, SEED = 400, 4000, 20_000, 3

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_VERSION = re.compile(r"\d{1,2}(?:\.\d+)*")
_NUMBERED = re.compile(r"([a-z]*?)v?(\d{1,2}(?:\.\d+)*?)(?:\.0)*")
#: Words that make another licence of the same text.
_QUALIFIERS = frozenset("affero lesser sa sharealike nc noncommercial nd noderivatives noderivs".split())


def words(text: str) -> list[str]:
    """Lower-case words; a version is its number without trailing zeros, and a word apart: GPLv3, GPL version 3.0, GPL-3.0."""
    out: list[str] = []
    for w in _WORD.findall(text.lower()):
        m = _NUMBERED.fullmatch(w) if w[-1].isdigit() else None
        if m is None or (m[1] and len(m[1]) + len(m[2]) == len(w)):  # not a version, or one that belongs to the word, as in cc0
            out.append(w)
            continue
        if not m[1] and out and out[-1] in ("version", "v", "ver"):
            out.pop()
        out += [m[1], m[2]] if m[1] else [m[2]]
    return out


#: Words too common in any English text to hint at a licence by themselves.
_FUNCTION_WORDS = frozenset("a an and any are as at be by can for from has have if in is it its may no nor not of on one or out part that the this to under was which with you your".split())
#: A paragraph without one of these has no feature.
TELLING = frozenset(w for by in (TEMPLATES, SHARED, NAMES, IDENTIFIERS, OTHERS, OTHER_NAMES, OTHER_IDENTIFIERS) for ts in by.values() for t in ts for w in words(t)) - _FUNCTION_WORDS | {"license", "licensed", "spdx", "identifier"}


@dataclass
class Classifier:
    """``weights`` has a row for each feature and one more, the bias, and a column for each family, unknown and none."""

    families: list[str]
    features: dict[tuple[str, ...], int]
    weights: np.ndarray
    temperature: float = 1.0
    least: float = 0.5
    likeness: float = 0.75

    def rows(self, text: list[str]) -> list[int]:
        """The features of a paragraph."""
        get, found = self.features.get, set()
        for n in (1, 2, 3):
            found.update(k for k in map(get, zip(*(text[i:] for i in range(n)), strict=False)) if k is not None)
        return sorted(found)

    def probabilities(self, rows: list[int]) -> np.ndarray:
        return _softmax((self.weights[-1] + self.weights[rows].sum(0))[None] / self.temperature)[0]

    def judge(self, text: list[str]) -> tuple[str, str, float, float] | None:
        """(family or unknown, likeliest family, probability, likeness to its template) of a paragraph; None if ordinary."""
        found = self._judged(text)
        return None if found is None else found[:4]

    def _judged(self, text: list[str]) -> tuple[str, str, float, float, bool] | None:
        """As ``judge``, and whether it is a clause that the likeliest family shares with other licences."""
        if TELLING.isdisjoint(text):
            return None
        rows = self.rows(text)
        if not rows:
            return None
        p = self.probabilities(rows)
        if p[-1] >= 0.5:
            return None
        k = int(np.argmax(p[:-2]))
        agrees, like, shared = confirmed(text, self.families[k], self.likeness)
        sure = agrees and p[k] > self.least and p[k] >= p[-2]
        return self.families[k] if sure and not shared else UNKNOWN, self.families[k], float(p[k]), like, sure and shared

    def document(self, lines: list[str]) -> list[tuple[int, str, str, float, float]]:
        """(paragraph from 0, and what ``judge`` says of it), shared clauses by what the document's other paragraphs say."""
        found = [(i, *hit) for i, line in enumerate(lines) if (hit := self._judged(words(line)))]
        named = {family for _, family, *_ in found}
        return [(i, likeliest if shared and likeliest in named else family, likeliest, p, like) for i, family, likeliest, p, like, shared in found]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _template_words(family: str) -> list[list[str]]:
    return [words(t) for t in TEMPLATES[family]]


_NAMED = {f: [tuple(words(n)) for n in names] for f, names in NAMES.items()}
_IDENTIFIED = {f: {tuple(words(n)) for n in names} for f, names in IDENTIFIERS.items()}
_SPDX = tuple(words(IDENTIFIED.format("")))


def _places(text: list[str], phrase: tuple[str, ...]) -> list[int]:
    return [i for i in range(len(text) - len(phrase) + 1) if text[i] == phrase[0] and tuple(text[i : i + len(phrase)]) == phrase]


def _names(text: list[str], family: str) -> bool:
    """Whether the words name the family, without a qualifier beside the name that makes another licence of it."""
    for name in _NAMED[family]:
        for i in _places(text, name):
            beside = {*text[max(0, i - 2) : i], *text[i + len(name) : i + len(name) + 2]}
            if not beside & (_QUALIFIERS - set(name)):
                return True
    return False


def confirmed(text: list[str], family: str, likeness: float) -> tuple[bool, float, bool]:
    """Whether some words are a notice of the family, their likeness to its nearest template, and whether that is a clause
    it shares with other licences."""
    marked = _places(text, _SPDX)
    if marked:
        same = tuple(text[marked[0] + len(_SPDX) :]) in _IDENTIFIED.get(family, ())
        return same, float(same), False
    named = {f for f in _NAMED if f != "proprietary" and _names(text, f)} if not _NAME_WORDS.isdisjoint(text) else set()
    if len(named - {family}):
        return False, 0.0, False
    if family in named or (family == "proprietary" and _names(text, family)):
        return True, 1.0, False
    # of a short template little but the name tells whose it is
    long = [t for t in _template_words(family) if len(t) > SHORT or not _names(t, family)]
    own = max((_compared(text, t) for t in long), default=(False, 0.0))
    common = max((_compared(text, words(t)) for t in SHARED.get(family, ())), default=(False, 0.0))
    if common > own:
        return common[0] and common[1] >= likeness, common[1], True
    return own[0] and own[1] >= likeness, own[1], False


#: Templates of so many words that state a name of the family are met by the name alone.
SHORT = 12
_NAME_WORDS = frozenset(n[0] for names in _NAMED.values() for n in names)


def _marks(text: Sequence[str]) -> tuple[set[str], set[str]]:
    """The versions and the qualifiers among some words."""
    return {w for w in text if _VERSION.fullmatch(w)}, _QUALIFIERS.intersection(text)


def _compared(text: list[str], template: list[str]) -> tuple[bool, float]:
    """Whether what tells licences apart is the same on both sides, and the words in common blocks over the words of the
    shorter side; long texts are compared around the template's words."""
    own = set(template)
    near = [i for i, w in enumerate(text) if w in own or (i and text[i - 1] in own)]
    blocks = difflib.SequenceMatcher(None, template, [text[i] for i in near], autojunk=False).get_matching_blocks()
    blocks = [b for b in blocks if b.size > 1]
    if not blocks:
        return False, 0.0
    # the part that follows the template; where that breaks off before its end, what comes instead of the rest too
    first, last = blocks[0], blocks[-1]
    begin, end = near[first.b], near[last.b + last.size - 1] + 1
    if last.a + last.size < len(template):
        end += 3
    if first.a:
        begin = max(0, begin - 3)
    versions, qualifiers = _marks(text[begin:end])
    wanted = _marks(template)
    agrees = qualifiers == wanted[1] and (not wanted[0] or versions == wanted[0])
    return agrees, sum(b.size for b in blocks) / min(len(template), max(len(text), 4))


def _varied(rng: np.random.Generator, template: list[str], ordinary: list[list[str]]) -> list[str]:
    out = [w for w in template if rng.random() > 0.06 or w in _QUALIFIERS or _VERSION.fullmatch(w)]
    if len(out) > 12 and rng.random() < 0.5:
        n = int(rng.integers(10, len(out)))
        at = int(rng.integers(0, len(out) - n + 1))
        out = out[at : at + n]
    if ordinary and rng.random() < 0.5:
        around = ordinary[int(rng.integers(len(ordinary)))][:60]
        cut = int(rng.integers(0, len(around) + 1))
        out = [*around[:cut], *out, *around[cut:]]
    elif rng.random() < 0.3:
        out = ["copyright", str(int(rng.integers(1990, 2030))), *(["all", "rights", "reserved"] if rng.random() < 0.5 else []), *out]
    return out


class _Sparse:
    """Rows of features in one array, each ending with the bias."""

    def __init__(self, rows: list[list[int]], bias: int):
        self.rows = [np.array([*r, bias], np.int64) for r in rows]

    def sums(self, weights: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the weights of some rows, their features, and each row's number of features."""
        ids = np.concatenate([self.rows[i] for i in which])
        sizes = np.array([len(self.rows[i]) for i in which])
        return np.add.reduceat(weights[ids], np.cumsum(sizes) - sizes), ids, sizes


def _fitted(x: _Sparse, labels: np.ndarray, rows: np.ndarray, shape: tuple[int, int], rng: np.random.Generator, epochs: int, rate: float, decay: float) -> np.ndarray:
    """Weights by AdaGrad on the softmax loss, classes weighing by the root of their size."""
    weights, squares = np.zeros(shape), np.full(shape, 1e-6)
    weight = 1 / np.sqrt(np.bincount(labels[rows], minlength=shape[1])[labels].clip(1))
    weight /= weight[rows].mean()
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // 384)):
            z, ids, sizes = x.sums(weights, batch)
            error = _softmax(z)
            error[np.arange(len(batch)), labels[batch]] -= 1
            error *= (weight[batch] / len(batch))[:, None]
            order = np.argsort(ids, kind="stable")
            head = np.flatnonzero(np.diff(ids[order], prepend=-1))
            some = ids[order][head]
            slope = np.add.reduceat(np.repeat(error, sizes, axis=0)[order], head) + decay * weights[some]
            squares[some] += slope**2
            weights[some] -= rate * slope / np.sqrt(squares[some])
    return weights


def notices(without: frozenset[str] = frozenset()) -> list[tuple[str, str, list[str]]]:
    """(family or unknown, licence, words) of all fixed notices; none of the other licences ``without``."""
    out = [(f, f, words(t)) for by in (TEMPLATES, SHARED) for f, ts in by.items() for t in ts]
    out += [(UNKNOWN, o, words(t)) for o, ts in OTHERS.items() for t in ts]
    for kind, by, frames in ((None, NAMES, FRAMES), (None, IDENTIFIERS, [IDENTIFIED]), (UNKNOWN, OTHER_NAMES, FRAMES), (UNKNOWN, OTHER_IDENTIFIERS, [IDENTIFIED])):
        out += [(kind or f, f, words(frame.format(n))) for f, names in by.items() for n in names for frame in frames]
    return [x for x in out if x[0] != UNKNOWN or x[1] not in without]


#: Parts of the cross-fitting, and for each copy of a notice lines of scattered words and notices of invented licences.
FOLDS, SCATTERED, INVENTED = 5, 50, 16


def train(ordinary_texts: list[str], copies: int = 25, epochs: int = 10, rate: float = 0.3, decay: float = 1e-5, seed: int = SEED, without: frozenset[str] = frozenset()) -> Classifier:
    """A classifier from the fixed notices and the lines of some ordinary texts; short notices have a fifth of the
    ``copies``. Other licences named in ``without`` are left out."""
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    unknown, none = len(families), len(families) + 1
    grams = lambda t: {g for n in (1, 2, 3) for g in zip(*(t[i:] for i in range(n)), strict=False)}
    known = notices(without)
    others = sorted({licence for kind, licence, _ in known if kind == UNKNOWN})
    phrases = [grams(t) for *_, t in known]
    lines = [w for t in ordinary_texts for x in t.split("\n") if (w := words(x))]
    holders: dict[tuple[str, ...], list[int]] = {}
    for k, p in enumerate(phrases):
        for g in p:
            holders.setdefault(g, []).append(k)

    def quotes(line: list[str]) -> bool:
        if TELLING.isdisjoint(line):
            return False
        shared = Counter(k for g in grams(line) for k in holders.get(g, ()))
        return any(n > 0.5 * len(phrases[k]) for k, n in shared.items())

    # lines that quote a notice are not ordinary
    lines = [x for x in lines if not quotes(x)]
    features = sorted({g for p in phrases for g in p if not TELLING.isdisjoint(g)})
    model = Classifier(families, {g: i for i, g in enumerate(features)}, np.zeros((len(features) + 1, len(families) + 2)))
    rows, texts, labels, parts, marks = [], [], [], [], []

    def add(text: list[str], label: int, part: int, notice: Sequence[str] = ()) -> None:
        marks.append(_marks(notice))
        rows.append(model.rows(text))
        texts.append(text)
        labels.append(label)
        parts.append(part % FOLDS)

    for kind, licence, t in known:
        label = unknown if kind == UNKNOWN else families.index(kind)
        for c in range(copies if len(t) > 12 else max(1, copies // 5)):
            part = others.index(licence) if kind == UNKNOWN else c
            add(_varied(rng, t, lines) if c else t, label, part, t)
            if c < copies // 2 and len(t) > 6:  # the same words without the phrases
                add([t[i] for i in rng.permutation(len(t))][: max(3, len(t) // 2)], none, part)
    everyday = [words(t) for t in EVERYDAY]
    for i, t in enumerate(everyday):
        for _ in range(copies // 2):
            add([w for w in t if rng.random() > 0.1] + everyday[int(rng.integers(len(everyday)))][: int(rng.integers(0, 12))], none, i)
    for i, at in enumerate(rng.permutation(len(lines))[:SAMPLE_LINES]):
        add(lines[at], none, i)
    telling, small = [w for *_, t in known for w in t if w in TELLING], sorted(_FUNCTION_WORDS)
    for i in range(copies * SCATTERED):  # words of licences by themselves, among others
        own = [telling[k] for k in rng.integers(0, len(telling), rng.integers(1, 9))] + [small[k] for k in rng.integers(0, len(small), rng.integers(0, 16))]
        add([own[k] for k in rng.permutation(len(own))], none, i)
    for i in range(copies * INVENTED):  # licences of which nobody has heard
        name = ["~"] * int(rng.integers(1, 4)) + [[], ["license"], ["licence"], ["public", "license"], ["software", "license"]][int(rng.integers(5))] + ([str(int(rng.integers(1, 5)))] if rng.random() < 0.6 else [])
        frame = FRAMES[int(rng.integers(0 if name[-1] != "~" else 1, len(FRAMES)))].split("{}")
        add([*words(frame[0]), *name, *words(frame[1])], unknown, i)
    x, y, parts = _Sparse(rows, len(features)), np.array(labels), np.array(parts)
    z = np.zeros((len(y), len(families) + 2))
    for part in range(FOLDS):
        back = np.flatnonzero(parts == part)
        z[back] = x.sums(_fitted(x, y, np.flatnonzero(parts != part), model.weights.shape, rng, epochs, rate, decay), back)[0]
    model.weights = _fitted(x, y, np.arange(len(y)), model.weights.shape, rng, epochs, rate, decay)
    loss = lambda t: -float(np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).sum())
    model.temperature = float(min(np.exp(np.linspace(-1.5, 1.5, 61)), key=loss))
    strange = np.flatnonzero(y == unknown)
    p = _softmax(z[strange] / model.temperature)
    best = p[:, :unknown].argmax(1)
    passes = (p[:, none] < 0.5) & (p[np.arange(len(p)), best] >= p[:, unknown])
    # a cut that lost the version or qualifier which tells the licence apart is a notice of no licence in particular
    whole = [all(a >= b for a, b in zip(_marks(texts[i]), marks[i], strict=True)) for i in strange]
    taken = [p[i, best[i]] if passes[i] and confirmed(texts[strange[i]], families[best[i]], model.likeness)[0] else 0.0 for i in np.flatnonzero(whole)] or [0.0]
    model.least = float(np.quantile(taken, 0.99, method="higher"))
    return model


def trained(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_lines: int = SAMPLE_LINES) -> Classifier:
    """A classifier whose ordinary text comes from the ``sample_documents`` documents with the least hashed ids: at most
    ``sample_lines`` of their lines of up to ``LONGEST`` characters, those with the least hashes, each of them whole."""
    ids = [r[0] for r in docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample_documents).collect()]
    lines = docs.where(F.col("doc_id").isin(ids)).select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") <= LONGEST).distinct()
    return train([r[0] for r in lines.orderBy(F.xxhash64(F.lit(SEED), "line"), "line").limit(sample_lines).collect()])


_HITS = "array<struct<paragraph:int,family:string,likeliest:string,probability:double,likeness:double>>"
_HIT = pyarrow.struct([("paragraph", pyarrow.int32()), ("family", pyarrow.string()), ("likeliest", pyarrow.string()), ("probability", pyarrow.float64()), ("likeness", pyarrow.float64())])


def scanned(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_paragraphs, hits (paragraph from 0, family or unknown, likeliest family, probability, likeness)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the notices
    tune(docs.sparkSession)

    def scan(batches):
        document = held.value.document
        for batch in batches:
            counts, hits = [], []
            for text in batch["text"].to_pylist():
                lines = text.split("\n") if text else []
                counts.append(sum(1 for x in lines if x.strip()))
                hits.append([dict(zip(_HIT.names, hit, strict=True)) for hit in document(lines)])
            yield record_batch(doc_id=batch["doc_id"], n_paragraphs=pyarrow.array(counts, pyarrow.int32()), hits=pyarrow.array(hits, pyarrow.list_(_HIT)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(scan), f"doc_id long, n_paragraphs int, hits {_HITS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its licence family (unknown, or none), and what it rests on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scanned(docs, trained(docs))
    best = F.sort_array(F.transform("hits", lambda h: F.struct((h["family"] != UNKNOWN).alias("sure"), h["probability"].alias("probability"), (-h["paragraph"]).alias("back"), h["family"].alias("family"), h["likeness"].alias("likeness"))), asc=False)
    named = found.withColumn("best", F.when(F.size("hits") > 0, best[0]))
    return named.select(
        "doc_id", "n_paragraphs", F.size("hits").alias("n_licence_paragraphs"), F.coalesce("best.family", F.lit(NONE)).alias("family"), (-F.col("best.back")).alias("paragraph"),
        F.round("best.probability", 6).alias("probability"), F.round("best.likeness", 6).alias("likeness"),
    )
