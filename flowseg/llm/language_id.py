"""Language identification by compression: the dictionary under which a text gets smallest names its language.

Every learned language has a raw-content zstandard dictionary made of sample
texts. A text is reduced to lower-case letters and single spaces, cut into
small blocks, and each block is compressed on its own with each dictionary, so
that a long text can't replace the dictionary by its own words. In each block
a language pays for the share by which it is larger than the smallest, up to
``MOST``: a passage that some dictionary happens to hold decides its block only.
The language that pays least over the whole text wins; what the second pays
more, of the most there is to pay, is the margin, and a narrow margin is a
rejection.

Edge cases: a NULL, empty or letterless text is ``und`` with score 0 and is
rejected. Equal sizes go to the language first in the alphabet, with margin 0.
Without any labelled text every document is ``und``. A single learned
language has score 1. A NULL doc_id counts as not held out. Very long texts are
judged whole, block by block. More than ``MAX_LANGUAGES`` languages to learn are an
error, since every text is compressed once for each. An empty table gives no rows,
repeated rows the same result each, and columns with clashing names are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowseg.functions.columns import quoted
from flowseg.llm.common import fresh, id_remainder

DICTIONARY_BYTES = 112_640  #: bound of the sample that is learned from, in bytes a language
MAX_LANGUAGES = 1_000
PIECE_BYTES = 1_000  #: of one text at most, from its middle, so that the sample is varied
MIDDLE = 8 * PIECE_BYTES  #: characters of a text, from its middle, that the piece is taken from
BLOCK_BYTES = 512
LEVEL = 12
MOST = 0.15
MOST_ODD = 16  #: different characters of a text, neither ASCII nor letters, that are replaced one by one
MIN_MARGIN = 0.05
HELD_OUT = (4, 2)

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_ASCII = bytes(i if 97 <= i < 123 else 32 for i in range(128)) + bytes(range(128, 256))  # other ASCII characters become a space


def letters(text: str | None) -> bytes:
    """Lower-case letters with their combining marks; every other run becomes one space. Empty if there is no letter."""
    lower = (text or "").lower()
    kinds = set() if lower.isascii() else set(lower)
    odd = [c for c in kinds if not c.isascii() and _OTHER.match(c)]
    if len(odd) > MOST_ODD:
        kept = _OTHER.sub(" ", lower).strip()
        return kept.encode() if any(c.isalpha() for c in kept) else b""
    if kinds and not any(c.isalpha() for c in kinds.difference(odd)):
        return b""
    for c in odd:
        lower = lower.replace(c, " ")
    return b" ".join(lower.encode().translate(_ASCII).split())


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(id_remainder(doc_id, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, from different texts in hash order up to ``DICTIONARY_BYTES``.

    The sample is drawn by the hash of the text: rows below a cut of the hash
    range, whose width follows from the number of different texts, are ranked
    by it. Only these few rows are shuffled, each cut to ``MIDDLE`` characters first, and
    at most the sample reaches the driver.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    drawn = F.xxhash64(F.lit("sample"), F.col("text"))
    sizes = rows.groupBy("lang").agg(
        F.approx_count_distinct(drawn).alias("n"), F.avg(F.length("text")).alias("mean")
    )
    found = sizes.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return {}
    cut = F.lit(-1.0)
    for r in found:  # eight times the rows that should be needed
        share = 8 * (DICTIONARY_BYTES / min(PIECE_BYTES, max(r["mean"], 1)) + 25) / r["n"]
        cut = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, share))).otherwise(cut)
    middle = F.greatest(F.lit(0), F.floor((F.length("text") - MIDDLE) / 2)).cast("int") + 1
    chosen = rows.filter((drawn / F.lit(2.0**64) + 0.5) <= cut).withColumn("drawn", drawn)
    few = chosen.withColumn("text", F.substr("text", middle, F.lit(MIDDLE))).dropDuplicates()
    before = F.sum(F.least(F.length("text"), F.lit(PIECE_BYTES))).over(W.partitionBy("lang").orderBy("drawn", "text").rowsBetween(W.unboundedPreceding, -1))
    sample = few.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 2 * DICTIONARY_BYTES)
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample.collect():
        own = letters(r["text"])
        start = max(0, len(own) - PIECE_BYTES) // 2
        parts.setdefault(r["lang"], []).append((r["before"], own[start : start + PIECE_BYTES]))
    # zstandard finds what is last in a dictionary most cheaply; the order has no other meaning
    return {k: b" ".join(t for _, t in sorted(v))[:DICTIONARY_BYTES] for k, v in sorted(parts.items())}


class Classifier:
    """Sizes of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.coders = []
        for name in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and the margin."""
        data = letters(text)
        if not data or not self.languages:
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        paid = [0.0] * len(self.coders)
        for i in range(0, len(data), BLOCK_BYTES):
            block = data[i : i + BLOCK_BYTES]
            sizes = [len(c.compress(block)) for c in self.coders]
            least = min(sizes)
            for k, size in enumerate(sizes):
                paid[k] += min(size / least - 1, MOST) * len(block)
        first, second = sorted(range(len(paid)), key=lambda k: (paid[k], k))[:2]
        return self.languages[first], (paid[second] - paid[first]) / (MOST * len(data))


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (the margin) and ``accepted`` to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARY_BYTES a language at most

    @F.pandas_udf("lang string, margin double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        guess = Classifier(sent.value)
        for texts in batches:
            yield pd.DataFrame([guess(t) for t in texts], columns=["lang", "margin"])

    (got,) = fresh(docs, "_guess")
    return (
        docs.withColumn(got, predict(F.col(text)))
        .withColumn("lang_pred", F.col(f"{got}.lang"))
        .withColumn("score", F.col(f"{got}.margin"))
        .withColumn("accepted", F.col(f"{got}.margin") >= MIN_MARGIN)
        .drop(got)
    )


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out, predicts all: doc_id, held_out, lang_pred, score, accepted."""
    dictionaries = learn(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return classify(rows, dictionaries).drop("text")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is clear, with their columns as they are."""
    dictionaries = learn(docs.filter(~held_out(F.col("doc_id"))))
    (work,) = fresh(docs, "_text")
    names = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), F.col("text").alias(work))
    return classify(rows, dictionaries, work).filter("accepted").select(*names)
