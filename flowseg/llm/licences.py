"""Licence recognition by sentences: known sentences get identifiers, sequences of identifiers are matched by rules.

A text is cut twice, into sentences (single line breaks count as blanks, as in
wrapped notices, empty lines end a sentence; so does a colon or semicolon, and
sentences with one inside are known by the parts that it leaves) and into lines (as in headers). Every unit is normalised: lower case,
runs of other characters than letters and digits become one space, and the
many ways to say "this is released under" become one word, numbers of clauses go,
and so does whoever is named in "neither the name of". A list of licences
("under either A or B", an SPDX expression) becomes one unit each. Known units map to
an identifier; the others drop out of the sequence. A rule names identifiers
that must follow each other in the sequence, others may stand between them.
Rules are tried in order, each as often as it fits from the left, and a match uses up
the places it took and no others: a rule for three clauses comes before the one for
two, and a two-clause text after a three-clause one is still seen. An
identifier is one character there and every step of a rule runs to the next place of
its character without a way back, so the work grows with the sequence's length.

All of it is one expression a row: nothing is exploded or shuffled. Texts
without any of ``MARKERS``, one of which every known sentence holds, are not cut.

Edge cases: a NULL or empty text has no identifiers and no licences. A
sentence that occurs twice gives its identifier twice; a licence is named once.
Very long texts are read whole. Equal rows and rows without an id get a result each, an
empty table an empty one, other columns stay under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseg.llm.common import fresh

# Names of licences as notices put them, and what they stand for.
NAMES = {
    "mit license": "MIT",
    "mit": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "isc license": "ISC",
    "zlib license": "Zlib",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu general public license v2 0": "GPL-2.0",
    "gnu general public license v3 0": "GPL-3.0",
    "gnu lesser general public license version 2 1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "boost software license version 1 0": "BSL-1.0",
    "creative commons zero v1 0 universal": "CC0-1.0",
    "cc0 1 0": "CC0-1.0",
}
NAMES |= {f"cc {kind.replace('-', ' ')} {v[0]} {v[2]}": f"CC-{kind.upper()}-{v}" for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("2.0", "3.0", "4.0")}
_GNU = {"GPL": ("general", ("2", "3")), "LGPL": ("lesser general", ("2.1", "3")), "AGPL": ("affero general", ("3",))}
#: What "version 2" of a GNU licence is called.
GNU_LATER = {(short, v): f"{short}-{v if '.' in v else v + '.0'}-or-later" for short, (_, versions) in _GNU.items() for v in versions}
SPDX = sorted({*NAMES.values(), *GNU_LATER.values(), "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "Unlicense"})
# Sentences of licence texts, normalised.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "you may not use this file except in compliance with the license": "apache-use",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "apache license version 2 0 january 2004": "apache-text",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-form",
}
# The sentence of the GNU notices; marks cut it after "software", and in some notices after "foundation".
GNU_SUBJECTS = ("this program is free software ", "this library is free software ", "")
GNU_GRANT = "you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation"
GNU_VERSION = "either version {v} of the license or at your option any later version"
for _short, (_kind, _versions) in _GNU.items():
    for _subject in GNU_SUBJECTS:
        _grant = _subject + GNU_GRANT.format(kind=_kind)
        SENTENCES[_grant] = f"{_short}-grant"
        for _v in _versions:
            SENTENCES[f"{_grant} {GNU_VERSION.format(v=_v.replace('.', ' '))}"] = f"{_short}-{_v}-later"
            SENTENCES[GNU_VERSION.format(v=_v.replace(".", " "))] = f"version-{_v}-later"
MARKERS = ("licen", "software", "copyright", "warrant", "redistribut", "under")
UNDER = r"^(?:(?:this|the) (?:\w+ ){1,3}is |it is )?(?:dual )?(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"
#: Numbers of clauses, and whoever is named before the contributors.
LED = r"^(?:[0-9a-z]{1,3} )?(?:(?=redistributions |the above )|neither the names? of .+? (?=nor the names of its contributors ))"
#: Units that may list licences: the word before them, and what separates them.
LISTS = {"under ": r"^under (?:either (?:of )?)?(?:the )?", "spdx license identifier ": "^spdx license identifier "}
BETWEEN = r" (?:or|and|with) (?:the )?(?!later\b|any later\b)| at your option$"
#: Tried in this order.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    *[(name, [f"{k}-{v}-later", *hope]) for hope in (["gpl-hope"], []) for (k, v), name in GNU_LATER.items()],
    *[(name, [f"{k}-grant", f"version-{v}-later", *hope]) for hope in (["gpl-hope"], []) for (k, v), name in GNU_LATER.items()],
    ("Apache-2.0", ["apache-text"]),
    ("Apache-2.0", ["under-Apache-2.0", "apache-use", "apache-basis"]),
    ("Apache-2.0", ["apache-use", "apache-basis"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense-grant"]),
]
#: Rules of one identifier that no other rule uses but to confirm: what is left of them after the rules.
NAMED = {f"under-{v}": v for v in NAMES.values()} | {f"spdx-{v}": v for v in SPDX}


def normalised(text: str) -> str:
    """The rule in Python, for tables and tests."""
    import re

    return re.sub(LED, "", re.sub(UNDER, "under ", re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()))


def known_units() -> dict[str, str]:
    """Normalised sentences and their identifiers."""
    known = {f"under {k}": f"under-{v}" for k, v in NAMES.items()}
    known |= {f"spdx license identifier {normalised(v)}": f"spdx-{v}" for v in SPDX}
    return known | SENTENCES


def characters() -> dict[str, str]:
    """One letter beyond ASCII for every identifier."""
    return {name: chr(0x100 + i) for i, name in enumerate(sorted({*known_units().values(), *(i for _, ids in RULES for i in ids)}))}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _listed(unit: Column) -> Column:
    """A unit for every licence that a unit lists; other units as they are."""
    out = F.array(unit)
    for head, start in LISTS.items():
        each = F.transform(F.split(F.regexp_replace(unit, start, ""), BETWEEN), lambda x: F.concat(F.lit(head), F.trim(x)))
        out = F.when(unit.startswith(head), each).otherwise(out)
    return out


def _identifiers(units: Column) -> Column:
    """The known units' identifiers, in order."""
    known = _map(known_units())

    def plain(u: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(u, "[^a-z0-9]+", " ")), UNDER, "under "), LED, "")

    single = F.flatten(F.transform(F.transform(units, plain), _listed))
    return F.filter(F.transform(single, lambda u: F.try_element_at(known, u)), lambda x: x.isNotNull())


def _licences(identifiers: Column) -> Column:
    """Fold of the rules over the sequence, then the names that are left."""
    letters = characters()
    sequence = F.array_join(F.transform(identifiers, lambda i: F.try_element_at(_map(letters), i)), "")
    rules = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                # every match begins where the one before ended
                F.lit("\\G" + "".join(f"([^{letters[i]}]*+){letters[i]}" for i in ids)).alias("pattern"),
                F.lit("".join(f"${n}" for n in range(1, len(ids) + 1))).alias("kept"),
            )
            for name, ids in RULES
        ]
    )

    def merge(state: Column, rule: Column) -> Column:
        rest = F.regexp_replace(state["rest"], rule["pattern"], rule["kept"])
        return F.struct(
            rest.alias("rest"),
            F.when(F.length(rest) < F.length(state["rest"]), F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    named = _map({letters[i]: name for i, name in NAMED.items()})
    left = F.aggregate(
        rules,
        F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found")),
        merge,
        lambda state: F.concat(state["found"], F.transform(F.array_distinct(F.split(state["rest"], "")), lambda c: F.try_element_at(named, c))),
    )
    return F.filter(F.array_distinct(left), lambda x: x.isNotNull())


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``licence_sentences`` and ``licence_lines`` (identifiers in order) and ``licences`` (names in alphabetical order)."""
    (low,) = fresh(docs, "_low")
    none = F.array().cast("array<string>")
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.col(low).contains(m)
    # "v." before a number ends no sentence
    sentences = F.split(F.col(low), r"(?!(?<=\bv)[.]\s+[0-9])[.!?:;][\"')\]]*\s|\n[ \t\r]*\n")
    lines = F.split(F.col(low), r"[\r\n]+")
    return (
        docs.withColumn(low, F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("licence_sentences", F.when(marked, _identifiers(sentences)).otherwise(none))
        .withColumn("licence_lines", F.when(marked, _identifiers(lines)).otherwise(none))
        .drop(low)
        .withColumn(
            "licences",
            F.when(
                (F.size("licence_sentences") > 0) | (F.size("licence_lines") > 0),
                F.array_sort(F.array_distinct(F.concat(_licences(F.col("licence_sentences")), _licences(F.col("licence_lines"))))),
            ).otherwise(none),
        )
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (joined by commas), n_sentences (known sentences) of every document."""
    found = recognise(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        F.greatest(F.size("licence_sentences"), F.size("licence_lines")).cast("long").alias("n_sentences"),
        F.array_join("licence_sentences", ",").alias("sentence_ids"),
        F.array_join("licence_lines", ",").alias("line_ids"),
    )
