"""Licence scans, quality, toxicity, language and language-model scores against brute force or held-out labels."""

import math
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import common, language_id, language_model, licences, quality, toxicity


# --- licences


def plain_reading(text, capitals):
    L = licences
    joined = re.sub(L.WRAPPED, r"\1 \2", re.sub(L.COMMENT, "", text))
    joined = (re.sub(L.WRAPPED_CAPITAL, r"\1 \2", joined) if capitals else joined).translate(str.maketrans(L.CAPITALS, L.SMALL))
    lines = [s for s in map(L.normalised, re.sub(L.SENTENCE_END, "\\1\n", joined).split("\n")) if s]
    kept = [(at, s) for at, s in enumerate(lines) if not re.search(L.LIST_MARK, s)]
    ids = []
    for _, s in kept:
        terms = [L.TAG + re.sub(L.EXCEPTION, "", t) for t in re.split(L.BETWEEN, s[len(L.TAG):])] if s.startswith(L.TAG) else [re.sub(L.NAMED, L.NAMELESS, s)]
        ids.append({L.KNOWN[t] for t in terms if t in L.KNOWN})
    found = [
        (r, c, i, len(w)) for r, c, w in L.RULES for i in range(len(ids) - len(w) + 1) if all(x in ids[i + k] for k, x in enumerate(w))
    ]
    outer = [m for m in found if not any(o[3] > m[3] and o[2] <= m[2] and o[2] + o[3] >= m[2] + m[3] for o in found)]
    return {m[0] for m in found}, [(r, c, kept[i][0], n) for r, c, i, n in outer]


def plain_scan(text):
    if text is None:
        return []
    (rules, found), (others, more) = plain_reading(text, False), plain_reading(text, True)
    new = others - rules
    return [m for m in found if not any(m[0] in licences.HOLDS[o] for o in new)] + [m for m in more if m[0] in new]


def test_anchors_and_rules_cover_every_sentence():
    assert all(any(a in " ".join(licences.SENTENCES.get(n, "license") for n in wanted).lower() for a in licences.ANCHORS) for _, _, wanted in licences.RULES)
    assert {n for _, _, wanted in licences.RULES for n in wanted} == set(licences.KNOWN.values())
    assert len(licences.KNOWN) == len(licences.SENTENCES) + sum(map(len, licences.SPDX.values()))


def test_scan(spark, documents, no_documents):
    s = licences.SENTENCES
    wrapped = s["mit-grant"].replace(" of this", "\n   of this").replace(" to deal", "\nto deal")
    texts = [
        s["rights"], f"Some words. {s['mit-released']} More.\n{s['cc-by-nc']}", f"{wrapped}\n\n{s['mit-notice']}",
        f"{s['mit-notice']}\n{s['mit-grant']}", s["rights"] * 3, f"{s['rights']}\n{s['mit-released']}", s["rights"].upper() + "!!",
        f"{s['apache-named']}\n{s['apache-comply']}\n{s['apache-copy']}\n\n http://x", "no licence here", "licence to rights", None, "",
        "x. " * 5000 + s["gpl3-work"] + " y." * 5000, "\x0b".join([s["rights"]] * 2), "SPDX-License-Identifier: MIT" + "\nCode",
    ]
    rows = [(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, s["rights"], 1, "r"), (0, texts[0], 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, rule string").repartition(3)
    want = [(i, *m) for i, t, *_ in rows for m in plain_scan(t)]
    got = licences.scan(df)
    assert got.columns == ["doc_id", "rule", "licence", "first", "sentences"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 12
    assert licences.scan(no_documents).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_scan_whatever_stands_between_words(spark):
    # Lines that go on in small letters are joined, but none after a line of one letter.
    line_end = lambda t: re.sub(r"(?<![.!?;:])(?<!\b\w) (?=[a-z(\"])", "\n", t)
    ways = [line_end] + [lambda t, gap=gap: t.replace(" ", gap) for gap in ("  ", "-", "\u00a0")]
    alone = {w[0]: r for r, _, w in licences.RULES if len(w) == 1 and w[0] in licences.SENTENCES}
    rows = [(f"{name}/{k}", way(licences.SENTENCES[name])) for name in alone for k, way in enumerate(ways)]
    anchored = "(?i)" + "|".join(licences.ANCHORS)
    assert all(re.search(anchored, way(text)) for name, text in licences.SENTENCES.items() for way in ways if name in alone)
    got = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.rule) for r in got) == sorted((i, alone[i.split("/")[0]]) for i, _ in rows)


BSD = """Copyright (c) 2001, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""


def test_scan_of_numbered_notices(spark):
    s = licences.SENTENCES
    texts = [BSD.format(*marks) for marks in (("1.", "2."), ("a.", "b."), ("*", "*"), ("11.", "12."), ("Some words.", "2."))]
    texts.append(f"1. {s['mit-grant']}\n2. {s['mit-notice']}\n3. {s['cc-by']}")
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.rule, r.first, r.sentences) for r in rows)
    want = [(i, "bsd-text", 3, 3) for i in range(4)] + [(i, "reserved-line", 2, 1) for i in range(5)]
    assert found == sorted(want + [(5, "mit-text", 1, 2), (5, "cc-by-line", 5, 1)])


#: Published notices and the licence that a reader takes them for.
NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.""",
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": BSD.replace("THIS SOFTWARE", """{2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE"""),
    "BSD-4-Clause": BSD.replace("THIS SOFTWARE", """{2} All advertising materials mentioning features or use of this software must display the following acknowledgement:
   This product includes software developed by the Example Organization.

THIS SOFTWARE"""),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
}
TAGS = {
    "SPDX-License-Identifier: BSD-3-Clause": {"BSD-3-Clause"}, "// SPDX-License-Identifier: GPL-2.0-only": {"GPL-2.0-only"},
    "/* SPDX-License-Identifier: MIT OR Apache-2.0 */": {"MIT", "Apache-2.0"}, "# SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": {"GPL-2.0-only"},
    "<!-- SPDX-License-Identifier: (MPL-2.0 AND ISC) OR CC0-1.0 -->": {"MPL-2.0", "ISC", "CC0-1.0"}, "SPDX-License-Identifier: none": set(),
}


def dressed(text, how):
    """A notice wrapped at 72 characters, in a comment, or numbered in another way."""
    marks = {"letters": ("a.", "b.", "c."), "stars": ("*", "*", "*")}.get(how, ("1.", "2.", "3."))
    text = text.format(*marks) if "{0}" in text else text
    if how != "plain":
        parts = [" ".join(p.split()) for p in re.split(r"(?<=acknowledgement:)\n|\n(?=\s*\n|\d\.|[abc]\. |\* )", text)]
        text = "\n".join(line for p in parts for line in (textwrap.wrap(p, 72) or [""]))
    lead = {"block": " * ", "hash": "# ", "slashes": "// ", "dashes": "-- "}.get(how, "")
    text = "\n".join((lead + line).rstrip() for line in text.split("\n"))
    return f"/*\n{text}\n */\nint main() {{}}" if how == "block" else text


def test_published_notices(spark, tmp_path):
    rows, want = [], {}
    for licence, text in NOTICES.items():
        for how in ("plain", "wrapped", "letters", "stars", "block", "hash", "slashes", "dashes"):
            want[len(rows)] = {licence}
            rows.append((len(rows), dressed(text, how)))
    for text, found in TAGS.items():
        want[len(rows)] = found
        rows.append((len(rows), text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in licences.scan(df).collect()]
    assert sorted(got) == sorted((i, *m) for i, t in rows for m in plain_scan(t))
    found = {i: {c for d, _, c, *_ in got if d == i and c != "all-rights-reserved"} for i in want}
    assert found == want
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert sorted(con.execute(licences.scan_sql()).fetchall()) == sorted(got)


# --- the helper that finds a threshold


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [float(i % 7) for i in range(100)], [math.sin(i) * 10**(i % 5) for i in range(500)]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    for k in {1, len(values) // 2 or 1, len(values)}:
        assert common.kth_largest(df, "v", k, buckets=4, gather=3) == sorted(values, reverse=True)[k - 1]
    assert common.kth_largest(df, "v", len(values) + 1) is None


# --- quality


def junk(prose, seed):
    return [" ".join(w.upper() + "!!" for w in prose(seed).split()), " ".join([prose(seed).split()[0]] * 40), " ".join(w + "$$$" for w in prose(seed).split())][seed % 3]


@pytest.fixture(scope="module")
def mixed(spark, prose):
    rows = [(i, junk(prose, i) if i % 5 == 0 else prose(i), "k", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, row long").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 2)] + [(3, None, None), (None, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return df, labels


def test_quality(mixed, documents, no_documents):
    df, labels = mixed
    rows = {r.doc_id: r for r in quality.decisions(df, labels).collect()}
    assert len(rows) == 400
    held_out = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0 or i % 2]
    assert np.mean([rows[i].kept == (i % 5 != 0) for i in held_out]) > 0.97
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    # weights by hand
    raw = np.bincount(np.concatenate([quality.buckets_of(r.text) for r in df.collect()]), minlength=quality.BUCKETS) + 1.0
    sample = quality.labelled(df, labels).where("quality = 1 and part <> 0").collect()
    good = np.bincount(np.concatenate([quality.buckets_of(r.text.decode()) for r in sample]), minlength=quality.BUCKETS) + 1.0
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    for r in df.where("doc_id < 20").collect():
        assert rows[r.doc_id].log_weight == pytest.approx(quality.GRAMS * ratio[quality.buckets_of(r.text)].mean())
    # exactly k rows, those with the largest keys
    for k in (0, 1, 57, 400, 1000):
        some = [r for r in quality.decisions(df, labels, k=k).collect() if r.kept]
        assert {r.doc_id for r in some} == {r.doc_id for r in sorted(rows.values(), key=lambda r: -r.key)[:k]}
    assert quality.decisions(documents, labels).count() == documents.count()
    assert quality.decisions(no_documents, labels).count() == 0
    assert quality.keep_good(documents, labels.limit(0)).count() == documents.count()


def test_gumbel_noise(spark):
    df = spark.range(20_000).select(quality.perturbed(F.lit(0.0), F.col("id"), 3).alias("g"))
    mean, sd = df.agg(F.avg("g"), F.stddev("g")).first()
    assert abs(mean - 0.5772) < 0.05 and abs(sd - math.pi / math.sqrt(6)) < 0.05


# --- toxicity


@pytest.fixture(scope="module")
def insulted(spark, prose):
    bad = [f"gralk{e}" for e in ("", "s", "er", "ed", "ing", "ish")] + ["vomp", "zutter"]
    rows = []
    for i in range(600):
        words = prose(i, 20 + i % 90).split()
        if i % 6 == 0:
            for k in range(2 + len(words) // 30):
                words.insert((i * 7 + k * 13) % len(words), bad[(i // 6 + k) % len(bad)])
        rows.append((i, " ".join(words), 1.0, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic int").repartition(4)
    return df, spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")


def test_toxicity(insulted, documents, no_documents):
    df, labels = insulted
    model = toxicity.fit(df, labels)
    rows = toxicity.scores(df, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    clean = toxicity.not_toxic(df, labels)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows if not r.predicted}
    text = df.where("doc_id = 6").first().text
    words = toxicity.words_of(text)
    assert model.difference(text) == pytest.approx(np.mean([model.ratio(h, w) for h, w in zip([""] + words, words)]))
    edge = toxicity.scores(documents, model).collect()
    assert len(edge) == documents.count() and all(r.predicted == 0 for r in edge)
    assert toxicity.scores(no_documents, model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert all(r.predicted == 0 for r in toxicity.scores(df, toxicity.fit(df, few)).collect())


def class_models(toxic, ordinary):
    """P(word | before) of both classes and the words of the vocabulary, from the definitions."""

    def counted(texts):
        triples = set()
        for t in texts:
            w = toxicity.words_of(t)
            triples.update(zip(["", ""] + w, [""] + w, w))
        pairs = Counter((h, w) for _, h, w in triples)
        return pairs, Counter(w for _, w in pairs)

    pairs, words = zip(counted(toxic), counted(ordinary))
    totals = [sum(w.values()) for w in words]
    vocabulary = sorted(set(words[0]) | set(words[1]))

    def excess(n, t, m, u):
        common = min(n / t, m / u if u else 0) * t if t else 0
        return max(n - toxicity.DOUBLE * common - toxicity.CHANCE * math.sqrt(common + 1), 0)

    def of_words(c, w):
        return excess(words[c][w], totals[c], words[1 - c][w], totals[1 - c])

    shared = {w: words[0][w] + words[1][w] - of_words(0, w) - of_words(1, w) for w in vocabulary}
    freed = sum(min(n, 0.75) for n in shared.values())

    def p1(w):
        return (max(shared.get(w, 0) - 0.75, 0) + freed / (len(vocabulary) + 1)) / sum(shared.values())

    both = {p: 2 * min(n, pairs[1][p]) for p, n in pairs[0].items() if p in pairs[1]}

    def p2(h, w):
        t = sum(n for (g, _), n in both.items() if g == h)
        if not t:
            return p1(w)
        kinds = sum(g == h for g, _ in both)
        return (max(both.get((h, w), 0) - 0.75, 0) + 0.75 * kinds * p1(w)) / t

    def p_class(c, h, w):
        rest = totals[c] - sum(of_words(c, v) for v in vocabulary)
        marginal = lambda v: (of_words(c, v) + rest * p1(v)) / totals[c] / p1(v)
        norm = sum(p2(h, v) * marginal(v) for v in [*vocabulary, "?"])
        p = p2(h, w) * marginal(w) / norm
        t, u = (sum(n for (g, _), n in pairs[k].items() if g == h) for k in (c, 1 - c))
        if not t:
            return p
        more = {v: excess(pairs[c][h, v], t, pairs[1 - c][h, v], u) for v in vocabulary}
        return (more.get(w, 0) + (t - sum(more.values())) * p) / t

    return p_class, vocabulary


@pytest.mark.parametrize("double,chance", [(1.0, 0.3), (2.0, 1.0), (1.0, 0.1)])
def test_toxicity_equals_kneser_ney_by_hand(spark, monkeypatch, double, chance):
    monkeypatch.setattr(toxicity, "DOUBLE", double)
    monkeypatch.setattr(toxicity, "CHANCE", chance)
    monkeypatch.setattr(toxicity, "PAIR_CHANCE", chance)
    rng = np.random.default_rng(8)
    plain, rude = "the a river stone to go see very old".split(), "fool dolt".split()
    make = lambda extra: " ".join(rng.choice(plain + extra, 14))
    toxic, ordinary = [make(rude + rude) for _ in range(9)] + ["you fool you fool"], [make([]) for _ in range(10)] + ["you see"]
    df = spark.createDataFrame([(1, t) for t in toxic] + [(0, t) for t in ordinary], "toxic int, text string")
    model = toxicity.fitted(df.withColumn("text", F.col("text").cast("binary")))
    p, vocabulary = class_models(toxic, ordinary)
    for h in ["", "new", *vocabulary]:
        for c in (0, 1):
            assert sum(p(c, h, w) for w in [*vocabulary, "?"]) == pytest.approx(1)
        for w in ["other", *vocabulary]:
            assert model.ratio(h, w) == pytest.approx(math.log(p(0, h, w) / p(1, h, w)), abs=1e-9)
    assert model.words and model.pairs and model.words["fool"] > 0
    words = "the fool see new river you fool".split()
    want = np.mean([math.log(p(0, h, w) / p(1, h, w)) for h, w in zip([""] + words, words)])
    assert model.difference("The fool, see NEW river: you fool") == pytest.approx(want)


def test_samples_hold_one_text_of_an_id(insulted, prose):
    """A third of all rows has one id, which is labelled toxic and of bad quality, and calibrates both models."""
    df, labels = insulted
    spark = df.sparkSession
    order = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(toxicity.CALIBRATE)) == 0
    hot = spark.range(1000, 2000).where(order & (common.fold("id", 5) != 0)).first().id
    many = spark.createDataFrame([(hot, prose(5000 + i), 1.0, 0) for i in range(300)], df.schema)
    more = labels.unionByName(spark.createDataFrame([(hot, 0, 1)], labels.schema))
    copies = {r.text for r in many.collect()}
    for sampled in (toxicity.sample(df.unionByName(many), more), quality.labelled(df.unionByName(many), more)):
        texts = [r.text.decode() for r in sampled.collect()]
        assert sum(t in copies for t in texts) == 1
    assert toxicity.CALIBRATE == quality.CALIBRATE
    # One id sets no line: the other texts are told apart as before.
    rows = toxicity.scores(df, toxicity.fit(df.unionByName(many), more)).where("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in rows]) > 0.97


def test_toxicity_on_labels(spark, sf_01):
    docs, labels = (spark.read.parquet(f"{sf_01}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scores(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    clean = [r.predicted for r in rows if r.held_out and not r.toxic]
    assert np.mean(clean) < 0.05
    assert np.mean([r.predicted for r in rows if r.held_out and r.toxic]) > 0.6


# --- language


def test_language(spark, sf_01, documents, no_documents):
    docs = spark.read.parquet(f"{sf_01}/documents.parquet")
    held = common.fold("doc_id", 3) == 1
    model = language_id.fit(docs, ~held)
    rows = language_id.predictions(docs, model, held).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    edge = {r.doc_id: r for r in language_id.predictions(documents, model, held).collect()}
    assert edge[13].lang_pred == edge[14].lang_pred == edge[16].lang_pred == "und" and edge[13].score == 0
    assert edge[17].lang_pred == edge[0].lang_pred == "en"
    assert language_id.predictions(no_documents, model, held).count() == 0
    nothing = language_id.fit(no_documents, ~held)
    assert {r.lang_pred for r in language_id.predictions(documents, nothing, held).collect()} == {"und"}


def test_kernel_is_shared_ngrams(spark):
    texts = ["the river and the bridge", "der fluss und die brücke", "the water and the light", "das wasser und das licht"]
    model = language_id.fit_texts(texts, ["en", "de", "en", "de"])
    grams = lambda t: {t[i : i + n].lower() for n in language_id.LENGTHS for i in range(len(t) - n + 1)}
    sets = [grams(t) for t in texts]
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    found = model.presence(texts)
    assert np.allclose(found @ found.T, want, atol=1e-6)
    assert model.predict(["the light", "das licht", "12 !"])[0] == ["en", "de", "und"]


@pytest.fixture(scope="module")
def many_languages():
    """A text and its language: 70 languages, of which two at a time share a script of 12 letters."""
    import random

    def make(language: int, seed: int) -> str:
        letters = [chr(0x4E00 + 40 * (language // 2) + k) for k in range(12)]
        words = random.Random(language)
        known = ["".join(words.choice(letters) for _ in range(5)) for _ in range(20)]
        return " ".join(random.Random(1000 * language + seed).choices(known, k=40))

    return [(100 * k + i, make(k, i), f"l{k}") for k in range(70) for i in range(8)]


def test_every_language_is_learned(spark, many_languages):
    # One language has fewer texts than the others, and the texts of another without letters are the first in order.
    rows = [r for r in many_languages if r[2] != "l69" or r[0] % 100 in (0, 1, 2, 7)]
    rows += [(10_000 + i, "12 !", "l0") for i in range(language_id.SAMPLE * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = F.col("doc_id") % 100 == 7
    model = language_id.fit(docs, ~held)
    assert model.languages == sorted({r[2] for r in many_languages})
    want = {i: name for i, t, name in rows if i % 100 == 7 and t != "12 !"}
    got = {r.doc_id: r.lang_pred for r in language_id.predictions(docs, model, held).collect() if r.doc_id in want}
    assert got == want and len(want) == 70


def test_one_id_on_many_rows_leaves_the_other_languages(spark, many_languages):
    rows = [(0, t, "a") for _, t, _ in many_languages[:8]] * 200 + [(1, t, "b") for _, t, _ in many_languages[8:16]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == ["a", "b"] and model.predict([many_languages[8][1]])[0] == ["b"]


def test_kernel_of_many_scripts(many_languages):
    texts = [t for _, t, _ in many_languages[::4]]
    model = language_id.fit_texts(texts, [name for _, _, name in many_languages[::4]])
    grams = [{t[i : i + n].lower() for n in language_id.LENGTHS for i in range(len(t) - n + 1)} for t in texts]
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in grams] for a in grams]
    found = model.presence(texts)
    assert np.allclose(found @ found.T, want, atol=1e-6)


# --- language model


def plain_scores(rows, learn, escape):
    cut = lambda t: (t or "").encode().lower().split() + [None]
    words, pairs, firsts = Counter(), Counter(), Counter()
    for i, t in rows:
        if learn(i):
            w = cut(t)
            words.update(w)
            pairs.update(zip(["start", *w], w))
            firsts.update(["start", *w[:-1]])
    n, v = sum(words.values()), len(words)
    rate = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for i, t in rows:
        w = cut(t)
        score = 0.0
        for h, x in zip(["start", *w], w):
            c = words[h] if h != "start" else firsts["start"]
            if not c:
                score += math.log10(rate(x))
                continue
            e = escape[int(language_model.octaves(np.array([c]))[0]) // language_model.STEPS]
            score += math.log10((1 - e) * pairs[h, x] / c + e * rate(x)) if pairs[h, x] else math.log10(e) + math.log10(rate(x))
        out.append((i, not learn(i), len(w), sum(x in words for x in w), n, sum(math.log10(rate(x)) for x in w), score))
    return out


@pytest.mark.parametrize("block", [200, 8 << 20])
def test_language_model(documents, no_documents, monkeypatch, block):
    monkeypatch.setattr(language_model, "BLOCK", block)
    monkeypatch.setattr(language_model, "RANGE", 100)
    escape = {}
    real = language_model.escapes
    monkeypatch.setattr(language_model, "escapes", lambda gains: escape.setdefault("e", real(gains)))
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    got = language_model.held_out_scores(documents)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = sorted(map(tuple, got.collect()), key=lambda r: tuple(map(str, r[:4])))
    want = sorted(plain_scores(rows, learn, escape["e"]), key=lambda r: tuple(map(str, r[:4])))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want])
    assert language_model.held_out_scores(no_documents).count() == 0


def test_every_state_sums_to_one():
    # (1 - e) * shares of the seen pairs + e * rates of all words, seen pairs having both parts.
    words = np.array([5.0, 3.0, 2.0, 4.0])
    first, second, pairs = np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([3.0, 2.0, 3.0])
    machine = language_model.Automaton(words, pairs, first, second, 14, 4, np.full(64, 0.3))
    for state in (0, 1):
        seen = {s: 10 ** a for f, s, a in zip(first, second, machine.arc) if f == state}
        total = sum(seen.get(w, 10 ** (machine.fail[state] + machine.word[w])) for w in range(4))
        unseen = 0.5 / (14 + 0.5 * 5)
        assert total + 0.3 * unseen == pytest.approx(1)


def test_held_out_texts_gain(spark, sf_01):
    rows = language_model.held_out_scores(spark.read.parquet(f"{sf_01}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


def test_planes():
    numbers = np.array([0, 1, 255, 256, 2**40, 2**63], np.uint64)
    assert (language_model.unplanes(language_model.planes(numbers)) == numbers).all()
