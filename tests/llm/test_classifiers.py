import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import licenses, toxicity

from .fixtures import corpus, frame


def labelled(spark, n=900):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        own, kind = [rng.choice(words) for _ in range(30)], rng.random()
        if kind < 0.25:
            own[rng.randrange(30)] = "insult"
            own[rng.randrange(30)] = "group"
            own += ["insult", "group"]
        elif kind < 0.5:
            own[rng.randrange(30)] = "insult"
        elif kind < 0.75:
            own[rng.randrange(30)] = "group"
        rows.append((i, " ".join(own)))
        labels.append((i, int({"insult", "group"} <= set(own))))
    return rows, labels


def test_interactions_are_learned(spark):
    rows, labels = labelled(spark)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, marks)
    got = {r.doc_id: r.toxicity for r in toxicity.scored(docs, machine).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = sum((got[i] >= 0.5) != y for i, y in held)
    assert wrong <= len(held) * 0.05
    kept = toxicity.clean(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_pure_interactions_are_learned():
    rng = np.random.default_rng(0)
    for kind in ("xor", "both"):
        rows, labels = [], []
        for _ in range(6000):
            own = set(rng.choice(np.arange(10, 2000), 30, replace=False).tolist())
            a, b = rng.random() < 0.5, rng.random() < 0.5
            own |= {1} if a else set()
            own |= {2} if b else set()
            rows.append(np.array(sorted(own)))
            labels.append(float(a != b if kind == "xor" else a and b))
        labels = np.array(labels)
        machine = toxicity.fit(rows[:4800], labels[:4800])
        assert ((machine.scores(rows[4800:]) >= 0.5) == (labels[4800:] == 1)).mean() >= 0.95
        assert machine.factors[[1, 2]].any()


def test_scores_of_the_query_are_those_of_pair_sums(spark, tmp_path):
    rows, labels = labelled(spark, 300)
    rows = [*rows, (2**60 + 1, "insult group"), (None, "insult group"), (None, None), (5, "another text")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    machine = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), marks)
    want = []
    for i, t in rows:
        own = toxicity.terms([(t or "").encode()])[0]
        v = machine.factors[own].astype(float)
        raw = machine.intercept + float(machine.weights[own].astype(float).sum()) + sum(float(v[a] @ v[b]) for a in range(len(own)) for b in range(a + 1, len(own)) if v[a].any() and v[b].any())
        score = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        want.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(score, 4), int(score >= 0.5)))
    got = [(str(r.doc_id), bool(r.held_out), round(r.score, 4), r.predicted) for r in toxicity.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_scores_are_the_formula():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 3)))
    row = np.array([1, 7, 30])
    pairs = sum(m.factors[a] @ m.factors[b] for k, a in enumerate(row) for b in row[k + 1 :])
    assert np.isclose(m.raw([row, row[:0]]), [0.3 + m.weights[row].sum() + pairs, 0.3]).all()


def test_odd_texts_and_missing_labels(spark):
    docs = frame(spark, corpus(1, 20) + [(5, "again"), (5, "again")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 1)], "doc_id long, toxic int")
    for marks in (none, odd):
        out = toxicity.scored(docs, toxicity.train(docs, marks))
        assert out.count() == docs.count() and out.where("toxicity is null or toxicity > 0.5").count() == 0
    assert toxicity.scored(docs.where("doc_id < 0"), toxicity.train(docs, none)).count() == 0


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    plain = "the of and to in that people water house green little over under work time year city river from with law file copy rights free".split()
    return licenses.train(["\n".join(" ".join(rng.choice(plain + [f"x{rng.randrange(500)}"] * 20) for _ in range(25)) for _ in range(4)) for _ in range(150)])


def test_families_are_told_apart(model):
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert model.judge(licenses.words(text))[0] == family
            assert model.judge(licenses.words("x1 x2 the river " + text + " of x9 people"))[0] == family


def test_what_reads_like_a_licence_but_is_none_is_not_named(model):
    assert model.judge(licenses.words("the people of the city had free water under the law of that year")) is None
    for text in ("software license version copyright permission granted conditions warranties", "licensed under the terms of the Obscure Vendor Agreement of 1987, which nobody kept"):
        found = model.judge(licenses.words(text))
        assert found is None or found[0] == licenses.UNKNOWN


NEAR = {
    "AGPL": "This file is part of it and is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "GPL-2": "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    "GPL-2 short": "This work is licensed under the GNU General Public License, version 2.",
    "MPL 1.1": "Licensed under the Mozilla Public License, version 1.1.",
    "MPL 1.1 long": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/1.1/.",
    "CC BY 3.0": "This work is licensed under a Creative Commons Attribution 3.0 International License.",
    "CC BY 3.0 short": "Licensed under CC BY 3.0.",
    "CC BY-ND": "This work is licensed under a Creative Commons Attribution-NoDerivs 4.0 International License.",
    "CC BY-NC-ND": "Licensed under CC BY-NC-ND 4.0.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache 1.1": "Licensed under the Apache License, Version 1.1.",
}


@pytest.mark.parametrize("name", NEAR)
def test_near_misses_are_unknown(model, name):
    found = model.judge(licenses.words(NEAR[name]))
    assert found and found[0] == licenses.UNKNOWN


#: Notices as people write them, and what they say.
PROBES = [
    ("Licensed under the GNU General Public License v3.0", "gpl-3.0"),
    ("Distributed under the GPL, version 3 or later", "gpl-3.0"),
    ("Released under GPLv3", "gpl-3.0"),
    ("GNU GPL version 2 or later", "unknown"),
    ("Apache License 2.0", "apache-2.0"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: GPL-2.0-only", "unknown"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "unknown"),
    ("Dual licensed under the MIT license and the Apache License 2.0", "unknown"),
    ("Copyright 2020 Foo. All rights reserved. Licensed under the MIT License.", "mit"),
    ("(c) 2021 Acme Inc. All rights reserved.", "proprietary"),
    ("This program is licensed under LGPL v2.1", "lgpl-2.1"),
    ("Released under CC0 1.0 Universal", "public-domain"),
    ("Licensed under the ISC License", "unknown"),
    ("The driver showed his license to the police, and all rights were reserved for the public", None),
    ("She renewed her license at the office before the version expired", None),
    ("His poetic license was too free for the general public", None),
    ("He was licensed to fly under the old rules", None),
    ("The board granted permission to build on the site free of charge", None),
    ("The gun license was valid for a year and all conditions were met", None),
    ("A new version of the software was released to the public under the name Phoenix", None),
]


@pytest.mark.parametrize("text,want", PROBES)
def test_short_names_identifiers_and_everyday_words(model, text, want):
    assert text not in licenses.EVERYDAY
    found = model.judge(licenses.words(text))
    assert (found and found[0]) == want


def test_versions_are_one_word():
    for text in ("GPLv3", "GPL v3.0", "GPL version 3", "gpl-3.0", "GPL 3"):
        assert licenses.words(text) == ["gpl", "3"]
    assert licenses.words("CC0 1.0 v2.1 version of x9") == ["cc0", "1", "2.1", "version", "of", "x9"]
    assert licenses.words("") == [] and licenses.words("3.0") == ["3"] and licenses.words("version v") == ["version", "v"]


def test_licences_that_were_never_trained_on_are_not_named():
    every = sorted({licence for kind, licence, _ in licenses.notices() if kind == licenses.UNKNOWN})
    plain = ["\n".join(f"the work of x{i} under law and y{i * 7 % 50} in the city" for i in range(k, k + 20)) for k in range(0, 400, 20)]
    named, missed, n = 0, 0, 0
    for part in range(3):
        out = frozenset(every[part::3])
        model = licenses.train(plain, without=out)
        held = [t for kind, licence, t in licenses.notices() if kind == licenses.UNKNOWN and licence in out]
        assert not {tuple(t) for t in held} & {tuple(t) for *_, t in licenses.notices(out)}
        n += len(held)
        found = [model.judge(t) for t in held]
        named += sum(f is not None and f[0] != licenses.UNKNOWN for f in found)
        missed += sum(f is None and len(t) > 4 for f, t in zip(found, held, strict=True))  # a bare name says nothing
    assert n > 250 and named <= 0.01 * n and missed <= 0.05 * n, (named, missed, n)


def test_shared_clauses_need_the_rest_of_the_document(model):
    opening, third = licenses.SHARED["bsd-3-clause"][1], licenses.TEMPLATES["bsd-3-clause"][0]
    assert model.judge(licenses.words(opening))[0] == licenses.UNKNOWN
    family = lambda lines: [(h[0], h[1]) for h in model.document(lines)]
    assert family([opening, "x1 x2"]) == [(0, "unknown")]
    assert family([opening, "x1 x2", third]) == [(0, "bsd-3-clause"), (2, "bsd-3-clause")]
    assert family([opening, licenses.TEMPLATES["mit"][0]]) == [(0, "unknown"), (1, "mit")]
    assert family(["BSD 2-Clause License", *licenses.SHARED["bsd-3-clause"][1:]]) == [(k, "unknown") for k in range(4)]


def test_the_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(5)
    plain = [" ".join(rng.choice(["the", "of", "license", "rights", "public", *(f"x{k}" for k in range(60))]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    some = [t for t, _ in PROBES] + list(NEAR.values()) + [t for by in (licenses.TEMPLATES, licenses.SHARED) for ts in by.values() for t in ts]
    texts = ["\n".join(rng.choice(some) if rng.random() < 0.2 else rng.choice(plain) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = [*enumerate(texts), (500, None), (501, ""), (502, " \n\n"), (7, texts[7]), (None, some[0]), (503, f"{some[0]}\n{some[0]}")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    model = licenses.trained(spark.read.parquet(str(tmp_path / "documents.parquet")))
    names = [*model.families, "unknown", "none"]
    grams = {g: [float(x) for x in model.weights[i]] for g, i in model.features.items()}

    def judged(line):  # each n-gram of the vocabulary is looked for, and the probabilities are added up one by one
        own = licenses.words(line)
        has = {g for n in (1, 2, 3) for g in (tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if g in grams}
        if not has:
            return None
        raw = [(float(model.weights[-1][k]) + sum(grams[g][k] for g in has)) / model.temperature for k in range(len(names))]
        p = [1 / sum(np.exp(b - a) for b in raw) for a in raw]
        if p[-1] >= 0.5:
            return None
        k = max(range(len(model.families)), key=lambda k: (p[k], -k))
        agrees, like, shared = licenses.confirmed(own, names[k], model.likeness)
        return names[k] if agrees and p[k] > model.least and p[k] >= p[-2] else "unknown", names[k], p[k], like, shared

    want = []
    for i, text in rows:
        lines = (text or "").split("\n")
        hits = [(k, *found) for k, line in enumerate(lines) if (found := judged(line))]
        named = {h[1] for h in hits if not h[5]}
        hits = [(k, "unknown" if shared and f not in named else f, p, like) for k, f, _, p, like, shared in hits]
        best = min(hits, key=lambda h: (h[1] == "unknown", -h[2], h[0]), default=(None, "none", None, None))
        want.append((str(i), sum(1 for x in lines if x.strip()), len(hits), best[1], str(best[0]), round(best[2] or 0, 4), round(best[3] or 0, 4)))
    got = [(str(r.doc_id), r.n_paragraphs, r.n_licence_paragraphs, r.family, str(r.paragraph), round(r.probability or 0, 4), round(r.likeness or 0, 4)) for r in licenses.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert len({w[3] for w in want}) > 8


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_each_line_that_is_a_template_is_named(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    family = {t: f for f, ts in licenses.TEMPLATES.items() for t in ts}
    want = {(r.doc_id, k, family[x]) for r in docs.where("text rlike '[Ll]icens|rights reserved'").collect() for k, x in enumerate(r.text.split("\n")) if x in family}
    hits = licenses.scanned(docs, licenses.trained(docs)).where("size(hits) > 0").collect()
    assert want <= {(r.doc_id, h.paragraph, h.family) for r in hits for h in r.hits} and want


def test_ids_survive_the_scan(spark, model):
    note = licenses.TEMPLATES["mit"][0]
    rows = [(2**60 + 1, note), (None, note), (3, "a"), (3, note)]
    got = sorted((str(r.doc_id), [h.family for h in r.hits]) for r in licenses.scanned(frame(spark, rows), model).collect())
    assert got == [(str(2**60 + 1), ["mit"]), ("3", []), ("3", ["mit"]), ("None", ["mit"])]


def test_scan_of_odd_texts(spark, model):
    note = licenses.TEMPLATES["mit"][0]
    rows = [(1, None), (2, ""), (3, f"hello\n\n{note}\nbye"), (3, f"hello\n\n{note}\nbye"), (4, "x " * 50_000 + note)]
    got = {r.doc_id: r for r in licenses.scanned(frame(spark, rows), model).collect()}
    assert got[1].n_paragraphs == got[2].n_paragraphs == 0 and not got[1].hits
    assert got[3].n_paragraphs == 3 and [(h.paragraph, h.family) for h in got[3].hits] == [(2, "mit")]
    assert [h.family for h in got[4].hits] == ["mit"]
    assert licenses.scanned(frame(spark, rows).where("doc_id > 9"), model).count() == 0
    licenses.train([])


def test_a_notice_in_a_third_of_the_documents_is_found():
    rng = random.Random(2)
    for family, note in (("mit", licenses.TEMPLATES["mit"][0]), ("apache-2.0", licenses.TEMPLATES["apache-2.0"][0])):
        texts = ["\n".join([" ".join(f"x{rng.randrange(500)}" for _ in range(20)), *([note] if i % 3 == 0 else [])]) for i in range(150)]
        found = licenses.train(texts).judge(licenses.words(note))
        assert found and found[0] == family


def test_lines_that_quote_a_template_are_left_out_of_large_samples_too():
    rng = random.Random(4)
    plain = ["\n".join(f"the work of x{rng.randrange(500)} under law" for _ in range(520)) for _ in range(100)]
    noted = [t + "\n" + licenses.TEMPLATES["apache-2.0"][0] for t in plain]
    assert np.array_equal(licenses.train(plain).weights, licenses.train(noted).weights)


def test_a_very_long_text_is_scored_whole(spark):
    rng = np.random.default_rng(0)
    machine = toxicity.Machine(-1.0, np.zeros(toxicity.FEATURES), np.zeros((toxicity.FEATURES, 2)))
    own = toxicity.terms([b"insult"])[0]
    machine.weights[own] = 3.0
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, 400_000).tolist())
    docs = frame(spark, [(1, text), (2, text + " insult"), (3, None)])
    got = {r.doc_id: r.toxicity >= 0.5 for r in toxicity.scored(docs, machine).collect()}
    assert got == {1: False, 2: True, 3: False}
    # training takes whole rows too
    assert toxicity._hashed(docs.withColumn("label", F.lit(1))).where("doc_id = 2").select(F.length("terms")).first()[0] == 4 * len(toxicity.terms([(text + " insult").encode()])[0])


def test_terms_left_out_of_the_pair_search_have_no_surprising_pair():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % 300).astype(np.int32) for _ in range(1500)]
    for least in (3.0, 6.0):
        rest = np.where(rng.random(1500) < 0.2, 0.9, -0.1) + 0.3 * np.array([(7 in r) and (9 in r) for r in rows])
        every = toxicity._paired(rows, rest, np.arange(300), 300, least)
        some = toxicity._pairable(rows, rest, 300, least)
        assert set(every) <= set(some) and len(some) < 300
        assert toxicity._paired(rows, rest, some, 300, least).tolist() == every.tolist()
    assert len(every) and not len(toxicity._pairable([], rest[:0], 300, 3.0))


def test_a_rare_pair_beyond_thousands_of_common_terms_is_found():
    rng = np.random.default_rng(4)
    insult, group = 5000, 5001
    rows, labels = [], []
    for k in range(4000):
        words = rng.choice(3000, 150, replace=False)  # each of 3000 terms is in some 200 rows
        both = k % 20 == 0
        extra = [insult, group] if both else [insult] if k % 20 in (1, 2) else [group] if k % 20 in (3, 4) else []
        rows.append(np.unique(np.append(words, extra)).astype(np.int32))
        labels.append(float(both or k % 97 == 0))
    machine = toxicity.fit(rows, np.array(labels), features=8192, least_surprise=1e9, steps=200)
    assert machine.factors[insult] @ machine.factors[group] > 0.1
    alone, pair = machine.scores([np.array([insult]), np.array([insult, group])])
    assert pair > 0.5 > alone


def test_training_rows_are_whole_and_bounded_by_bytes(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: seen.update(rows=rows, labels=labels))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    whole = seen["rows"]
    toxicity.train(docs, labels, max_bytes=sum(4 * len(r) for r in whole) // 2)
    assert 0 < len(seen["rows"]) < len(whole) and len(seen["rows"]) == len(seen["labels"])
    assert {r.tobytes() for r in seen["rows"]} <= {r.tobytes() for r in whole}
