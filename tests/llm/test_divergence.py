"""Source divergence against plain counting."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowseg.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def audited(rows):
    docs, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for at, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)):
            docs[lang, term].add(at)
            counts[lang, source][term] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (own, t), d in docs.items() if own == lang and len(d) >= 3)
        sources = sorted(g[1] for g in groups if g[0] == lang)

        def p(count, total):
            return 1 + 10**9 * (count + 1) // (total + len(kept))

        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        for s in sources:
            pair, term = [], []
            for o in sources:
                if o != s:
                    value = 0
                    for t in kept:
                        a, b = p(counts[lang, s][t], n[s]), p(counts[lang, o][t], n[o])
                        value += (a - b) ** 2 // b
                    pair.append((-value, o.encode(), o))
            for t in kept:
                a, b = p(counts[lang, s][t], n[s]), p(sum(counts[lang, o][t] for o in sources), sum(n.values()))
                if counts[lang, s][t] and a > b:
                    term.append((-((a - b) ** 2 // b), t.encode(), t))
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:200])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1)}
    return out


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(i, *row, "clash") for i, row in enumerate(rows)], DOCS)
    got = divergence.audit(df.repartition(parts) if rows else df).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got}


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "naïve", "ÄRGER", "ärger", "語", "x9y", "don't", "a_b", "İ"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = []
    for i in range(n):
        own = rng.sample(words, 60)
        rows.append((rng.choice([" ", ", ", "\n\t", "\x00", "…"]).join(rng.choice(own) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "", None])))
    return rows


@pytest.mark.parametrize("piece, held, shard", [(4 << 20, 400_000, 200_000), (300, 40, 50)])
def test_divergence(spark, piece, held, shard):
    rows = texts(1)
    rows += [(" ".join(["alpha"] * 20_000 + ["long"]), "en", "a")] + [("copy of a text", "en", "b")] * 30
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("one two", "fr", "c")]  # a language without kept terms
    df = spark.createDataFrame([(i, *row, "clash") for i, row in enumerate(rows)], DOCS).repartition(4)
    got = divergence.divergences(divergence.term_counts(df, piece, held), shard_rows=shard).collect()
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got}
    want = audited(rows)
    assert got == want
    assert {r for r in want if r[0] == "fr"} == {("fr", s, "pair", o, 0, i) for s, others in (("a", "bc"), ("b", "ac"), ("c", "ab")) for i, o in enumerate(others, 1)}


def test_only_the_200_best_terms_are_reported(spark):
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcde"]
    rows = [(" ".join(words), "en", "a")] * 3 + [(" ".join(words[:10] * 400), "en", "b")] * 3
    want = audited(rows)
    assert found(spark, rows) == want and sum(r[2] == "term" and r[1] == "a" for r in want) == 200


def test_nothing_and_a_lone_source(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a a b", None, None)] * 2 + [("b", None, None)]) == audited([("a a b", "", "")] * 2 + [("b", "", "")])


def test_counts_beyond_64_bits_once_scaled():
    counts = np.array([[5, 2**40, 2**55]], dtype=np.int64)
    total = 2**56 + 17
    assert divergence._scaled(counts, total).tolist() == [[1 + 10**9 * (int(c) + 1) // total for c in counts[0]]]
