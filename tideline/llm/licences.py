"""Licence scans by sentences and rules, in DataFrame functions only.

A text is cut into sentences, each sentence is normalised and looked up among known licence sentences, and the
sequence of identifiers is matched against rules: a rule is the sequence of identifiers that a licence notice has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The wording of public licence notices, a sentence each (normalised before use).
SENTENCES = {
    "rights": "All rights reserved.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software."
    ),
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-named": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-short": "Licensed under the GNU General Public License, version 3.",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-use": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-neither": "Neither the name may be used to endorse or promote products derived from this software.",
    "bsd-advertising": (
        "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
    ),
    "gpl-program": "This program is free software;",
    "gpl-library": "This library is free software;",
    "gpl-modify": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the"
        " Free Software Foundation;"
    ),
    "gpl2-modify": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as"
        " published by the Free Software Foundation."
    ),
    "lgpl-modify": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published"
        " by the Free Software Foundation;"
    ),
    "either-2": "either version 2 of the License, or (at your option) any later version.",
    "either-21": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "agpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "two-zero": "2.0.",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "epl2": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
        " which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "epl2-http": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
        " which is available at http://www.eclipse.org/legal/epl-2.0"
    ),
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to"
        " alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "public-domain": "This work is dedicated to the public domain.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Identifiers that may stand in an SPDX tag; some have an older spelling.
SPDX = {
    "mit": ["MIT"], "apache": ["Apache-2.0"], "gpl3": ["GPL-3.0-only", "GPL-3.0"], "gpl3-later": ["GPL-3.0-or-later"],
    "gpl2": ["GPL-2.0-only", "GPL-2.0"], "gpl2-later": ["GPL-2.0-or-later"], "lgpl2": ["LGPL-2.1-only", "LGPL-2.1"],
    "lgpl2-later": ["LGPL-2.1-or-later"], "lgpl3": ["LGPL-3.0-only", "LGPL-3.0"], "lgpl3-later": ["LGPL-3.0-or-later"],
    "agpl3": ["AGPL-3.0-only", "AGPL-3.0"], "agpl3-later": ["AGPL-3.0-or-later"], "mpl2": ["MPL-2.0"],
    "bsd2": ["BSD-2-Clause"], "bsd3": ["BSD-3-Clause"], "isc": ["ISC"], "zlib": ["Zlib"], "boost": ["BSL-1.0"],
    "epl2": ["EPL-2.0"], "unlicense": ["Unlicense"], "cc0": ["CC0-1.0"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"],
}

#: Rules in order: name, licence, identifiers of consecutive sentences.
RULES = [
    ("mit-text", "MIT", ("mit-grant", "mit-notice")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-neither")),
    ("bsd4-text", "BSD-4-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("bsd-text", "BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("zlib-text", "Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("gpl2-header", "GPL-2.0-or-later", ("gpl-program", "gpl-modify", "either-2")),
    ("gpl2-only-header", "GPL-2.0-only", ("gpl-program", "gpl2-modify")),
    ("lgpl2-header", "LGPL-2.1-or-later", ("gpl-library", "lgpl-modify", "either-21")),
    ("lgpl3-header", "LGPL-3.0-or-later", ("lgpl3-free",)),
    ("agpl-header", "AGPL-3.0-or-later", ("agpl-free",)),
    ("mpl-header", "MPL-2.0", ("mpl-subject", "two-zero")),
    ("boost-line", "BSL-1.0", ("boost",)),
    ("epl2-line", "EPL-2.0", ("epl2",)),
    ("epl2-http-line", "EPL-2.0", ("epl2-http",)),
    ("apache-header", "Apache-2.0", ("apache-named", "apache-comply", "apache-copy")),
    ("gpl-header", "GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("mit-line-reserved", "MIT", ("rights", "mit-released")),
    ("mit-line", "MIT", ("mit-released",)),
    ("mit-licensed-line", "MIT", ("mit-licensed",)),
    ("mit-grant-only", "MIT", ("mit-grant",)),
    ("apache-line", "Apache-2.0", ("apache-short",)),
    ("apache-named-only", "Apache-2.0", ("apache-named",)),
    ("gpl3-work-line", "GPL-3.0-only", ("gpl3-work",)),
    ("gpl3-line", "GPL-3.0-only", ("gpl3-short",)),
    ("gpl-free-only", "GPL-3.0-or-later", ("gpl-free",)),
    ("cc-by-line", "CC-BY-4.0", ("cc-by",)),
    ("cc-by-work-line", "CC-BY-4.0", ("cc-by-work",)),
    ("cc-by-sa-line", "CC-BY-SA-4.0", ("cc-by-sa",)),
    ("cc-by-nc-line", "CC-BY-NC-4.0", ("cc-by-nc",)),
    ("isc-text", "ISC", ("isc-grant",)),
    ("public-domain-line", "public-domain", ("public-domain",)),
    ("unlicense-line", "Unlicense", ("unlicense",)),
    ("reserved-line", "all-rights-reserved", ("rights",)),
] + [(f"spdx-{name}", found[0], (f"spdx-{name}",)) for name, found in SPDX.items()]

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What stands before the lines of a notice in source code.
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)[ \t]*"

#: A line that goes on in small letters, a quotation or a bracket is joined; then a sentence ends at a line end, or at
#: a sign followed by white space. A text is read a second time with lines joined that begin with a capital after
#: a line of 40 characters and more without an end, for notices that are wrapped there.
WRAPPED = r"([^.!?;:\n])[ \t\r]*\n[ \t]*([a-z(\"])"
WRAPPED_CAPITAL = r"([^\n]{39}[^.!?;:\n])[ \t\r]*\n[ \t]*([A-Z])"
SENTENCE_END = r"([.!?;])[ \t\r\n\f\x0B]+"
NOT_WORD = "[^a-z0-9]+"

#: A sentence with a name in it, and how it is known.
NAMED = (
    r"^neither the names? of .* may be used to endorse or promote products derived from this software"
    r"(?: without (?:specific )?prior written permission)?$"
)
NAMELESS = "neither the name may be used to endorse or promote products derived from this software"

#: An SPDX tag names one or several licences, each perhaps with an exception.
TAG = "spdx license identifier "
BETWEEN, EXCEPTION = " (?:or|and) ", " with .*"

#: A mark of a list stands alone as a sentence ("1. Redistributions of ..."); rules look past it.
LIST_MARK = "^([0-9]+|[a-z])$"

#: Every sentence above holds one of these, in any case of letters; texts without them are not cut up. Each is within one
#: word, as anything may stand between words.
ANCHORS = ("licen", "rights", "permission", "redistribut", "domain", "notice", "hope", "software")


def normalised(sentence: str) -> str:
    """A-Z in lower case, then every run of other characters than a-z and 0-9 as one blank, none at the ends."""
    return re.sub(NOT_WORD, " ", sentence.translate(str.maketrans(CAPITALS, SMALL))).strip(" ")


KNOWN = {normalised(text): name for name, text in SENTENCES.items()}
KNOWN |= {TAG + normalised(spelling): f"spdx-{name}" for name, found in SPDX.items() for spelling in found}


def sentences(text: Column, capitals: bool = False) -> Column:
    """Normalised sentences of a text in order, without those that have no a-z and 0-9."""
    joined = F.regexp_replace(F.regexp_replace(text, COMMENT, ""), WRAPPED, "$1 $2")
    if capitals:
        joined = F.regexp_replace(joined, WRAPPED_CAPITAL, "$1 $2")
    lines = F.split(F.regexp_replace(F.translate(joined, CAPITALS, SMALL), SENTENCE_END, "$1\n"), "\n")
    return F.filter(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, NOT_WORD, " "))), lambda s: s != "")


#: The rules that each rule holds, itself left out.
HOLDS = {
    rule: [
        other for other, _, part in RULES
        if len(part) < len(wanted) and any(wanted[i : i + len(part)] == part for i in range(len(wanted)))
    ]
    for rule, _, wanted in RULES
}


def keys(sentence: Column) -> Column:
    """What a normalised sentence is looked up by: itself, without a name, or each licence of an SPDX tag."""
    terms = F.split(F.substring(sentence, len(TAG) + 1, 1 << 30), BETWEEN)
    tags = F.array_distinct(F.transform(terms, lambda t: F.concat(F.lit(TAG), F.regexp_replace(t, EXCEPTION, ""))))
    plain = F.array(F.when(sentence.startswith("neither"), F.regexp_replace(sentence, NAMED, NAMELESS)).otherwise(sentence))
    return F.when(sentence.startswith(TAG), tags).otherwise(plain)


def _constant(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of fixed values; its size does not depend on any data."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*structs))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence notices of whole texts: doc_id, rule, licence, first (sentence from 0) and sentences, a row per match.

    A match inside a longer match is not reported. Texts without a notice, NULL and empty texts give no row; repeated
    rows give their matches again and a NULL id is kept. Further columns are not read. Only known licence sentences
    are shuffled: each votes for the place where a rule that holds it would begin, and a rule is there if it has all
    its votes. Marks of comments before lines, and marks of a list between the sentences of a rule, are looked past; ``first``
    counts marks of lists and ``sentences`` does not. A notice that only the second reading has is placed in that.
    """
    spark = docs.sparkSession
    anchored = F.col("text").rlike("(?i)" + "|".join(ANCHORS))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(anchored)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    readings = F.array(*[F.struct(F.lit(r).alias("reading"), sentences(F.col("text"), bool(r)).alias("every")) for r in (0, 1)])
    read = numbered.withColumn("readings", readings)
    same = F.col("readings")[0]["every"] == F.col("readings")[1]["every"]
    every = read.select("row", "doc_id", F.inline(F.when(same, F.slice("readings", 1, 1)).otherwise(F.col("readings"))))
    kept = F.filter(F.transform("every", lambda s, i: F.struct(i.alias("at"), s.alias("sentence"))), lambda s: ~s["sentence"].rlike(LIST_MARK))
    cut = every.select("row", "doc_id", "reading", F.posexplode(kept).alias("pos", "s"))
    cut = cut.select("row", "doc_id", "reading", "pos", "s.at", F.explode(keys(F.col("s.sentence"))).alias("sentence"))
    known = _constant(spark, ["sentence", "id"], list(KNOWN.items()))
    ids = cut.join(known, "sentence").select("row", "doc_id", "reading", "pos", "at", "id")
    rules = _constant(
        spark, ["rule", "licence", "place", "sentences", "id", "holds"],
        [(rule, licence, k, len(wanted), name, ",".join(HOLDS[rule])) for rule, licence, wanted in RULES for k, name in enumerate(wanted)],
    )
    found = (
        ids.join(rules, "id")
        .groupBy("row", "doc_id", "reading", "rule", "licence", "holds", (F.col("pos") - F.col("place")).alias("begin"), "sentences")
        .agg(F.count("*").alias("votes"), F.min("at").alias("first")).where(F.col("votes") == F.col("sentences"))
    )
    match = F.struct("rule", "licence", "first", "sentences", "begin", "reading", "holds")
    first_has = lambda rule: F.exists("found", lambda o: (o["reading"] == 0) & (o["rule"] == rule))
    inside = lambda m: F.exists("found", lambda o: F.when(
        o["reading"] == m["reading"],
        (o["sentences"] > m["sentences"]) & (o["begin"] <= m["begin"]) & (o["begin"] + o["sentences"] >= m["begin"] + m["sentences"]),
    ).when(m["reading"] == 1, o["rule"] == m["rule"]).otherwise(F.find_in_set(m["rule"], o["holds"]).cast("boolean") & ~first_has(o["rule"])))
    by_row = found.groupBy("row", "doc_id").agg(F.collect_list(match).alias("found"))  # of one text
    return by_row.select("doc_id", F.inline(F.filter("found", lambda m: ~inside(m)))).drop("begin", "reading", "holds")


def scan_sql() -> str:
    """The same for the table ``documents`` as a relational division, for comparison."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(text)}, {quote(name)})" for text, name in KNOWN.items())
    rules = ", ".join(
        f"({quote(rule)}, {quote(licence)}, {k}, {len(wanted)}, {quote(name)})"
        for rule, licence, wanted in RULES for k, name in enumerate(wanted)
    )
    holds = ", ".join(f"({quote(rule)}, {quote(part)})" for rule, parts in HOLDS.items() for part in parts)

    def cut(joined: str) -> str:
        return f"""list_filter(list_transform(string_split(
            regexp_replace(translate({joined}, '{CAPITALS}', '{SMALL}'), {quote(SENTENCE_END)}, '\\1' || chr(10), 'g'), chr(10)),
            lambda s: trim(regexp_replace(s, '{NOT_WORD}', ' ', 'g'), ' ')), lambda s: s <> '')"""

    return f"""
    WITH known(sentence, id) AS (VALUES {known}),
    rules(rule, licence, place, n, id) AS (VALUES {rules}),
    holds(rule, part) AS (VALUES {holds}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
    bare AS (SELECT r, doc_id, regexp_replace(regexp_replace(text, {quote(COMMENT)}, '', 'g'), {quote(WRAPPED)}, '\\1 \\2', 'g') AS t FROM docs),
    readings AS (
        SELECT r, doc_id, 0 AS reading, {cut("t")} AS sentences FROM bare
        UNION ALL
        SELECT r, doc_id, 1, {cut(f"regexp_replace(t, {quote(WRAPPED_CAPITAL)}, '{chr(92)}1 {chr(92)}2', 'g')")} FROM bare),
    every AS (SELECT r, doc_id, reading, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS spot FROM readings),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY r, reading ORDER BY spot) AS pos FROM every
        WHERE NOT regexp_matches(sentence, '{LIST_MARK}')),
    keyed AS (
        SELECT r, doc_id, reading, pos, spot, regexp_replace(sentence, {quote(NAMED)}, '{NAMELESS}') AS sentence FROM placed
        WHERE NOT starts_with(sentence, '{TAG}')
        UNION ALL
        SELECT DISTINCT r, doc_id, reading, pos, spot, '{TAG}' || regexp_replace(term, '{EXCEPTION}', '') FROM (
            SELECT *, unnest(string_split_regex(sentence[{len(TAG) + 1}:], '{BETWEEN}')) AS term FROM placed
            WHERE starts_with(sentence, '{TAG}'))),
    ids AS (SELECT r, doc_id, reading, pos, spot, id FROM keyed JOIN known USING (sentence)),
    found AS (
        SELECT r, any_value(doc_id) AS doc_id, reading, rule, licence, pos - place AS start, min(spot) AS first, n
        FROM ids JOIN rules USING (id) GROUP BY r, reading, rule, licence, pos - place, n HAVING count(*) = n)
    SELECT doc_id, rule, licence, CAST(first AS INTEGER) AS first, CAST(n AS INTEGER) AS sentences FROM found f
    WHERE NOT EXISTS (
        SELECT 1 FROM found o WHERE o.r = f.r AND o.reading = f.reading AND o.n > f.n AND o.start <= f.start AND o.start + o.n >= f.start + f.n)
    AND NOT (reading = 1 AND EXISTS (SELECT 1 FROM found o WHERE o.r = f.r AND o.reading = 0 AND o.rule = f.rule))
    AND NOT (reading = 0 AND EXISTS (
        SELECT 1 FROM found o JOIN holds h ON h.rule = o.rule AND h.part = f.rule WHERE o.r = f.r AND o.reading = 1
        AND NOT EXISTS (SELECT 1 FROM found p WHERE p.r = f.r AND p.reading = 0 AND p.rule = o.rule)))
    """
