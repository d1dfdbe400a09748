"""Language identification against a plain version that shares no code with it."""

import random
import unicodedata
import zlib

import pytest
import xxhash
import zstandard

from flowseg.llm import language_id


def plain_letters(text):
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    words = " ".join(w for w in kept.split(" ") if w)
    return words.encode() if any(unicodedata.category(c)[0] == "L" for c in words) else b""


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def brute(rows):
    """(doc_id, held_out, language, score) of rows few enough for the sample to hold all texts up to 1,000 bytes each."""
    kinds = {(lang, text) for d, text, lang in rows if lang is not None and not is_held_out(d) and plain_letters(text)}
    drawn = lambda text: (xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(b"sample", 42)) + 2**63) % 2**64
    samples = {}
    for lang, text in sorted(kinds, key=lambda x: (x[0], drawn(x[1]))):
        own = plain_letters(text)
        cut = max(0, len(own) - 1000) // 2
        samples.setdefault(lang, []).append(own[cut : cut + 1000])
    coders = {
        lang: zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(b" ".join(parts), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        for lang, parts in samples.items()
    }
    out = []
    for d, text, _ in rows:
        data, paid = plain_letters(text), dict.fromkeys(coders, 0.0)
        for at in range(0, len(data), 512):
            block = data[at : at + 512]
            sizes = {lang: len(c.compress(block)) for lang, c in coders.items()}
            for lang, size in sizes.items():
                paid[lang] += min(0.15, size / min(sizes.values()) - 1) * len(block)
        order = sorted(paid, key=lambda lang: (paid[lang], lang))
        if not data or not order:
            best = ("und", 0.0)
        elif len(order) == 1:
            best = (order[0], 1.0)
        else:
            best = (order[0], (paid[order[1]] - paid[order[0]]) / (0.15 * len(data)))
        out.append((d, is_held_out(d), *best))
    return out


def made(languages):
    rng = random.Random(7)
    words = {lang: ["".join(rng.choices("abcdefghijklmnoprstuvwz" + lang, k=rng.randint(2, 8))) for _ in range(150)] for lang in languages}
    rows = []
    for i in range(90):
        lang = languages[i % len(languages)]
        rows.append((i, ", ".join(rng.choices(words[lang], k=rng.choice([3, 30, 120]))) + " 42.", None if i % 10 == 9 else lang))
    rows += [rows[0], rows[0], (None, rows[1][1], rows[1][2]), (200, None, "x"), (201, "", "x"), (202, "12 - 34", "x"), (203, "हिन्दी भाषा", None)]
    both = [w for lang in languages for w in words[lang][:40]]
    return rows + [(204, " ".join(both * 5), None), (205, " ".join(rng.choices(words[languages[0]], k=4000)), None)]


@pytest.mark.parametrize("languages", [["éà", "øå", "ßü"], ["éà"]])
def test_predictions_equal_the_plain_version(spark, languages):
    """Labels in three languages, and in one; without letters, by combining marks, mixed, and long."""
    rows = made(languages)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = brute(rows)
    assert len(got) == len(want) and any(w[1] for w in want)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-12)
