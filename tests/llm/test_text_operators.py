"""Language identification, byte-level BPE, decontamination and licences on small tables."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from flowseg.llm import byte_bpe, decontaminate, language_id, licences, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


STRANGE = [None, "", " ", "\n\n  x", "naïve café", "日本語 𝄞 text", "a" * 3000, "\u0000\u001f", "it's we'll  ends ", "x\u001cy\u0085z", "٣٤ ½ Ⅷ"]


def test_bpe_equals_the_library(spark, tokens, library):
    rng = random.Random(5)
    texts = STRANGE + ["".join(rng.choice(" aeiotnsr'\n0?!éßж日-=") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "twice"), (None, "twice")], DOCS).withColumn("bpe", F.lit(1)).repartition(3)
    got = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, name="_bpe").select("doc_id", "text", "_bpe.*").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    full = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, name="_bpe", digests=False).select("text", "_bpe.*").collect()
    assert all(r["decoded"] == (r["text"] or "") and np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "") for r in full)
    assert byte_bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_appends_and_edits_keep_the_table_exact(tokens):
    vocabulary, rng = byte_bpe.Vocabulary(tokens), random.Random(3)
    letters = b"thereinationsx "
    table = byte_bpe.PrefixTable(vocabulary, b"the nation")
    for _ in range(200):
        if rng.random() < 0.5:
            table.append(bytes(rng.choices(letters, k=rng.randint(0, 6))))
        else:
            a, b = sorted(rng.randint(0, len(table.data)) for _ in range(2))
            table.replace(a, min(b, a + 5), bytes(rng.choices(letters, k=rng.randint(0, 5))))
        assert table.ids() == vocabulary.encode(table.data)
    long = byte_bpe.PrefixTable(vocabulary, b"the relation of nations " * 300)
    assert long.replace(50, 52, b"xyz") < 400


def test_plain_pattern_splits_alike():
    fast, full = byte_bpe.plain_pattern(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    text = "".join(chr(i) + " " * (i % 3) + chr((i * 7) % 0x250) for i in range(0x250))
    assert fast.findall(text) == full.findall(text)


def sentence(rng, lang):
    parts = {"en": "the of and ing tion th er re an on is wh".split(), "de": "der die und sch ein ung keit ich en ver ß ü".split(), "fr": "le de et la que ment tion eau é è re en".split()}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 80)))


def test_language_is_learned_from_the_rest_and_found(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang), lang) for i, lang in enumerate(rng.choices(["en", "de", "fr"], weights=[6, 2, 2], k=600))]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 ½ ²!!", "fr"), (None, rows[0][1], rows[0][2]), (1003, rows[0][1], None), (1004, "The", None)]
    docs = spark.createDataFrame(rows + odd, DOCS + ", lang string").withColumn("score", F.lit("own")).repartition(3)
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    judged = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(judged) > 80 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in judged) >= 0.98 * len(judged)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["accepted"]) == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert by[None]["held_out"] is False and all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.keep_accepted(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (1000, 1001, 1002)").isEmpty()
    assert kept.filter("doc_id < 600").count() >= 590
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_long_text_is_read_whole():
    rng = random.Random(2)
    guess = language_id.Classifier({k: language_id.letters(" ".join(sentence(rng, k) for _ in range(100))) for k in ("en", "de")})
    assert guess(sentence(rng, "en") + " " + " ".join(sentence(rng, "de") for _ in range(50)))[0] == "de"
    assert language_id.Classifier({"en": b"the of and"})("the") == ("en", 1.0)


def edited(words, edits, rng):
    out = list(words)
    for e in range(edits):
        p = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[p] = f"other{e}"
        elif kind == 1:
            out.insert(p, f"more{e}")
        else:
            del out[p]
    return out


def slow_edits(item, text, most):
    """Smallest edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(min(row), most + 1)


def test_edits_equal_the_plain_recursion():
    rng = random.Random(4)
    for _ in range(300):
        item = [rng.randint(1, 5) for _ in range(rng.randint(1, 12))]
        text = [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        d, start, end = decontaminate.edits(np.array(item), np.array(text, dtype=np.int64), 4)
        assert d == slow_edits(item, text, 4)
        if d <= 4:
            assert slow_edits(item, text[start:end], 4) == d


def test_passages_are_found_and_others_left(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: rng.choices(vocabulary, weights=[1 / (k + 3) for k in range(400)], k=n)
    items = [(i, prose(rng.randint(14, 60))) for i in range(40)]
    docs, truth = [], set()
    for d in range(240):
        text = prose(rng.randint(0, 300))
        if d % 3 == 0:
            i, item = rng.choice(items)
            at = rng.randint(0, len(text))
            text = text[:at] + edited(item, (d // 3 % 3) * len(item) // 20, rng) + text[at:]
            truth.add((d, i))
        docs.append((d, " ".join(text).upper() if d % 2 else ", ".join(text)))
    docs += [(900, None), (901, ""), (None, " ".join(items[0][1])), (902, "w1")]
    given = [(i, " ".join(w)) for i, w in items] + [(77, None), (78, ""), (79, "w1 w2")]
    table = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(given, "item_id long, text string")
    got = decontaminate.passages(table, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert (None, 0) in found
    exact = {(d, i) for d, i in truth if d // 3 % 3 == 0}
    assert exact <= found and len(truth & found) >= 0.95 * len(truth)
    words = {d: decontaminate.words(t) for d, t in docs}
    by_item = dict(items)
    for r in got:  # every hit is one by brute force as well
        assert slow_edits(by_item[r["item_id"]], words[r["doc_id"]][r["first_word"] : r["end_word"]], 99) == r["edits"] <= 0.2 * r["item_words"]
    every = {(d, i) for d, w in words.items() for i, x in items if len(w) and slow_edits(x, w, int(0.2 * len(x))) <= int(0.2 * len(x))}
    assert found <= every and len(found) >= 0.95 * len(every)
    kept = decontaminate.keep_clean(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    assert decontaminate.passages(table, bench.limit(0)).count() == 0
    assert decontaminate.passages(table.limit(0), bench).count() == 0


def test_items_without_their_first_words_are_found_where_documents_start():
    rng = random.Random(11)
    items = [(i, [f"i{i}w{k}" for k in range(30)]) for i in range(40)]
    match = decontaminate.Matcher([(i, " ".join(w)) for i, w in items])
    for lost in (1, 2, 3):
        texts = [" ".join(w[lost:] + [f"x{rng.randrange(99)}" for _ in range(20)]) for _, w in items]
        hits = match(["some words before", *texts, "and after"])
        found = [h for h in hits[1:-1] if h]
        assert len(found) >= 0.95 * len(items) and not hits[0] and not hits[-1]
        for (i, _), h in zip(items, hits[1:-1]):
            assert all(x == (i, lost, 30, 0, 30 - lost) for x in h)


def test_items_in_blocks_give_the_same(spark):
    items = [(i, " ".join(f"a{i}b{k}" for k in range(12))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, block_bytes=600))
    assert len(blocks) > 3 and sorted(x for b in blocks for x in b) == items


def test_short_items_and_unspaced_scripts_are_met_word_for_word():
    rng = random.Random(8)
    items = [(i, [f"s{rng.randrange(6)}" for _ in range(rng.randint(1, 10))]) for i in range(60)]
    match = decontaminate.Matcher([(i, " ".join(w)) for i, w in items])
    texts = [[f"s{rng.randrange(6)}" for _ in range(rng.randint(0, 60))] for _ in range(80)]
    for text, hits in zip(texts, match([" ".join(t) for t in texts])):
        want = {(i, next(k for k in range(len(text)) if text[k : k + len(w)] == w)) for i, w in items
                if 4 <= len(w) < 8 and any(text[k : k + len(w)] == w for k in range(len(text)))}
        assert {(i, a) for i, d, n, a, b in hits if n < 8} == want and all(d == 0 and b == a + n for _, d, n, a, b in hits if n < 8)
    chinese = "今天天气很好我们一起去公园散步吧"
    (hits,) = decontaminate.Matcher([(1, chinese), (2, "ไปเที่ยวทะเลกันเถอะวันนี้")])(["前言。" + chinese.replace("很", "真") + "！结束"])
    assert [(h[0], h[1]) for h in hits] == [(1, 1)] and decontaminate.words("Ab1日本 c") == ["ab1", "日", "本", "c"]


def test_equal_items_count_once(spark):
    text = " ".join(f"word{k}" for k in range(20))
    bench = spark.createDataFrame([(7, text), (3, text), (None, text), (5, "quite another item, with eight words or more"), (6, None)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench.union(bench.crossJoin(spark.range(500)).select("item_id", "text")), block_bytes=600))
    assert sorted(x[0] for b in blocks for x in b) == [3, 5]
    docs = spark.createDataFrame([(1, "so " + text), (1, text), (2, "nothing")], DOCS)
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in decontaminate.passages(docs, bench).collect()) == [(1, 3, 0), (1, 3, 1)]
    assert {(r["item_id"], r["found_as"]) for r in decontaminate.equal_items(bench).collect()} == {(7, 3), (3, 3), (None, 3), (5, 5)}


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
BSD3 = BSD2 + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


def test_licences(spark):
    cases = {
        None: "", "": "", "no such words": "", "a license is mentioned": "",
        "Some text.\nLicensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "end. This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "x\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nReleased under the MIT License.": "Apache-2.0,MIT",
        "# SPDX-License-Identifier: BSD-3-Clause\ncode": "BSD-3-Clause",
        MIT: "MIT", BSD2: "BSD-2-Clause", BSD3: "BSD-3-Clause", "Intro.\n" + BSD3 + "\n" + MIT: "BSD-3-Clause,MIT",
    }
    rows = [(i, t) for i, t in enumerate(cases)] + [(None, MIT), (None, MIT)]
    got = licences.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["licences"] for r in got if r["doc_id"] is not None}
    assert {i: want for i, want in enumerate(cases.values())} == by
    assert [r["licences"] for r in got if r["doc_id"] is None] == ["MIT", "MIT"]
    clash = spark.createDataFrame([(1, "Released under the MIT License.")], DOCS).withColumn("_low", F.lit(1))
    assert licences.recognise(clash).select("_low", "licences").first()["licences"] == ["MIT"]
    assert all(any(m in k for m in licences.MARKERS) for k in licences.known_units())


GPL = """    This program is free software{a} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{b} either version {v} of the License, or
    (at your option) any later version.
"""
HOPE = """
    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v.{gap}{v}. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/{v}/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions."""


def test_wrapped_notices_of_every_rule(spark):
    cases = {}
    for v in (2, 3):
        for a in ";:":
            for b in ";,":
                grant = GPL.format(a=a, b=b, v=v)
                cases[grant] = cases["Intro.\n\n" + grant + HOPE] = f"GPL-{v}.0-or-later"
    cases |= {GPL.format(a=";", b=";", v=4) + HOPE: "", HOPE: "", GPL.format(a=";", b=";", v=2).replace("General", "Lesser General"): ""}
    cases |= {MPL.format(gap=" ", v="2.0"): "MPL-2.0", MPL.format(gap="\n", v="2.0"): "MPL-2.0", MPL.format(gap=" ", v="1.1"): ""}
    cases |= {ISC: "ISC", APACHE: "Apache-2.0", MIT: "MIT", BSD2: "BSD-2-Clause", BSD3: "BSD-3-Clause"}
    cases["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it."] = "Unlicense"
    for v in sorted(set(licences.NAMES.values())):
        name = next(n for n, w in licences.NAMES.items() if w == v)
        cases[f"Some text. This work is\nlicensed under the {name}.\nMore text."] = v
    for v in licences.SPDX:
        cases[f"/* SPDX-License-Identifier: {v} */\ncode"] = v
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame(list(enumerate(cases)), DOCS)).collect()}
    assert got == dict(enumerate(cases.values()))


NAMES_CLAUSE = " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_holders_lists_and_repeated_notices(spark):
    two_then_three, three_then_two = BSD2 + "\n\n" + BSD3, BSD3 + "\n\n" + BSD2
    lesser = GPL.replace("General", "Lesser General").replace("program", "library")
    cases = {
        BSD2 + "\n3. Neither the name of the Example University" + NAMES_CLAUSE: "BSD-3-Clause",
        BSD2 + "\n * Neither the name of Example Inc." + NAMES_CLAUSE: "BSD-3-Clause",
        BSD2.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "b) Redistributions in"): "BSD-2-Clause",
        two_then_three: "BSD-2-Clause,BSD-3-Clause", three_then_two: "BSD-2-Clause,BSD-3-Clause",
        "\n\n".join([BSD2] * 1000): "BSD-2-Clause", "\n\n".join([BSD2] * 999 + [BSD3]): "BSD-2-Clause,BSD-3-Clause",
        lesser.format(a=";", b=";", v="2.1") + HOPE: "LGPL-2.1-or-later", lesser.format(a=":", b=",", v=3): "LGPL-3.0-or-later",
        GPL.replace("General", "Affero General").format(a=":", b=",", v=3) + HOPE: "AGPL-3.0-or-later",
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode": "Apache-2.0,MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later AND BSD-3-Clause\n": "BSD-3-Clause,GPL-2.0-or-later",
        "Text.\n\nLicensed under either of the Apache License, Version 2.0 or the MIT license at your option.": "Apache-2.0,MIT",
        "\n          Apache License\n    Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\n TERMS": "Apache-2.0",
    }
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame(list(enumerate(cases)), DOCS)).collect()}
    assert got == dict(enumerate(cases.values()))
    assert licences.scan(spark.createDataFrame([], DOCS)).count() == 0
    dotted = spark.createDataFrame([("MIT" * 3, "Released under the MIT License.", 1)], "`a.b` string, text string, `licences.x` int")
    assert licences.recognise(dotted).select("licences").first()["licences"] == ["MIT"]


def _match_by_places(ids):
    """Rules over a list of identifiers, places struck off one by one."""
    left, found = list(ids), set()
    for name, rule in licences.RULES:
        start = 0
        while True:
            places, at = [], start
            for want in rule:
                while at < len(left) and left[at] != want:
                    at += 1
                if at == len(left):
                    places = None
                    break
                places.append(at)
                at += 1
            if places is None:
                break
            found.add(name)
            for place in places:
                left[place] = None
            start = at
    return sorted(found | {licences.NAMED[i] for i in left if i in licences.NAMED})


def test_rules_equal_a_search_by_places(spark):
    rng = random.Random(11)
    known = licences.known_units()
    units = {i: u for u, i in known.items()}
    used = sorted({i for _, rule in licences.RULES for i in rule} | {"under-MIT", "spdx-Zlib", "mit-warranty"})
    rows, want = [], []
    for n in range(400):
        pool = rng.sample(used, rng.randint(1, 8))
        ids = [rng.choice(pool) for _ in range(rng.randint(0, 25))]
        rows.append((n, "\n\n".join(units[i] + "." if not i.startswith("spdx") else units[i] for i in ids)))
        want.append((",".join(_match_by_places(ids)), ",".join(ids)))
    got = licences.scan(spark.createDataFrame(rows, DOCS).repartition(3)).orderBy("doc_id").collect()
    assert [(r["licences"], r["sentence_ids"]) for r in got] == want


def _sql(rows):
    frame = pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], dtype="Int64"), "text": pd.array([t for _, t in rows], dtype="string")})
    with duckdb.connect() as con:
        con.register("documents", frame)
        relation = con.sql(queries.ORACLES["op6_licences"])
        return relation.columns, relation.fetchall()


def test_licences_equal_their_sql(spark):
    """Sentences, names, lists, headers and made sequences, wrapped or not; NULL, empty and repeated texts."""
    rng = random.Random(5)
    units = sorted(licences.known_units())
    lists = ["Licensed under the MIT License or the Apache License, Version 2.0 at your option", "under GPL-2.0 or any later version", "This is released under the MIT license or the later one"]
    notes = ["SPDX-License-Identifier: MIT OR Apache-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later", "2. Redistributions of source code must retain", "v. 2.0", "is v.\n\n2 under", *lists]
    notes += ["Neither the name of the Some Lab nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"]
    texts = [None, "", "under", "software", *notes]
    for _ in range(300):
        some = [rng.choice([rng.choice(units), rng.choice(notes), "nothing of the kind", "the software"]) for _ in range(rng.randint(1, 12))]
        texts.append("".join(x + rng.choice([".\n", ". ", "\n\n", "\n", "; ", ": ", ".) ", "!\x0b"]) for x in some))
    rows = [*enumerate(texts), (0, texts[5]), (None, texts[5])]
    frame = licences.scan(spark.createDataFrame(rows, DOCS).repartition(3))
    names, want = _sql(rows)
    got = sorted([tuple(r) for r in frame.select(*names).collect()], key=str)
    assert got == sorted(want, key=str) and sum(bool(r[1]) for r in got) > 100


def test_combining_marks_belong_to_words():
    assert language_id.letters("हिन्दी, 12 भाषा!").decode() == "हिन्दी भाषा"
