"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts become sequences of lower-case words. A CGK walk embeds a sequence in
Hamming space: at step j it puts out the word it stands on and moves on by one
if a random bit of (j, word) says so. Sequences of small edit distance get
embeddings of small Hamming distance. Each repetition has its own random bits,
number of steps and place in each item where the walk starts, and compares a
few sampled steps of the embedding of every document window with those of the
items. A window of the item's size around an agreement is a candidate; the
edit distance in words is then worked out exactly, over all parts of the window.

A window is given up at the first sampled step at which no item has its word,
so most are looked at for a step or two. A passage equal to the item meets it
in every repetition. ``REPETITIONS`` is set for a recall of 0.95 where a tenth of
the words are edited (tests/llm measures it).

Words are runs of letters and digits; scripts written without spaces count by
the character. An item of fewer than ``MIN_WORDS`` words, for whose few words a share of
edits means nothing, is looked up as it is, word for word. One of fewer than ``LEAST_WORDS``
words, among them NULL and empty ones, is an answer rather than a passage and never
matches: any text holds it. A NULL or empty document has no passage. Very long texts are
searched whole, in portions of whole texts.

Items of equal text count once, under their smallest id (NULL only where none has one);
``equal_items`` says which ids stand together. The items are taken to the driver in blocks
of at most ``BLOCK_BYTES`` of different texts; each block is a pass over the documents, whose
texts are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize
from flowseg.llm.byte_bpe import portions

MAX_EDITS = 0.2  #: share of an item's words
MIN_WORDS = 8  #: of an item that may be met with edits
LEAST_WORDS = 4  #: of an item that may be met at all
REPETITIONS = 9
SAMPLES = 5
STEPS = (9, 16)  #: steps of a walk, from and below
BLOCK_BYTES = 8_000_000

# Thai to Myanmar, Khmer, kana, and Chinese characters
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; single characters in scripts without spaces."""
    return _WORD.findall((text or "").lower())


def edits(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int]:
    """Smallest edit distance of the item to a part of the window, and where that part starts and ends.

    The first such end and the latest start for it. ``most + 1`` if it is over ``most``.
    """
    at = np.arange(len(window) + 1)
    row, start = np.zeros(len(at), dtype=np.int64), at
    for i, word in enumerate(item, 1):
        best = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (window != word))))
        from_left = np.concatenate(([0], np.where(row[:-1] + (window != word) <= row[1:] + 1, start[:-1], start[1:])))
        row = np.minimum.accumulate(best - at) + at  # words of the window that the item lacks
        source = np.maximum.accumulate(np.where(row == best, at, 0))
        start = from_left[source]
        if row.min() > most:
            return most + 1, 0, 0
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


class _Ids(dict):
    """Numbers of the items' words; zero for every other word."""

    def __missing__(self, word: str) -> int:
        return 0


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], repetitions: int = REPETITIONS, seed: int = 7):
        split = [(i, words(t)) for i, t in items]
        split = sorted(((i, w) for i, w in split if len(w) >= LEAST_WORDS), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids = _Ids((w, n) for n, w in enumerate(sorted({w for _, ws in split for w in ws}), 1))
        self.items = [(i, np.array([self.ids[w] for w in ws], dtype=np.int64)) for i, ws in split]
        self.reach = max([0, *(len(x) for _, x in self.items)]) * 2 + STEPS[1] + 2
        flat = np.concatenate([np.concatenate((x, np.zeros(self.reach, dtype=np.int64))) for _, x in self.items] or [np.zeros(0, dtype=np.int64)])
        begin = np.cumsum([0] + [len(x) + self.reach for _, x in self.items])[:-1]
        sizes = np.array([len(x) for _, x in self.items], dtype=np.int64)
        rng, self.rounds = np.random.default_rng(seed), []
        # items that are looked up word for word: by number of words, their keys in order and which items they are
        self.mix, self.lookups = np.random.default_rng(seed + 1).integers(0, 1 << 62, MIN_WORDS, dtype=np.int64) * 2 + 1, []
        for n in range(LEAST_WORDS, MIN_WORDS):
            short = np.flatnonzero(sizes == n)
            if len(short):
                keys = self._keys(np.concatenate([self.items[i][1] for i in short]), n)[::n]
                self.lookups.append((n, np.sort(keys), short[np.argsort(keys, kind="stable")]))
        for _ in range(repetitions if self.items else 0):
            steps = int(rng.integers(*STEPS))
            walk = {
                "samples": [0, *np.sort(rng.choice(np.arange(1, steps), SAMPLES - 1, replace=False)).tolist()],
                **{k: rng.integers(0, 1 << 62, steps, dtype=np.int64) * 2 + 1 for k in ("odd", "add", "mix")},
            }
            room = np.maximum(sizes - steps // 2, 1)
            offset = (rng.random(len(sizes)) * room).astype(np.int64)  # where in the window the walk starts
            keys, _ = self._walk(flat, begin + offset, walk, None)
            order = np.argsort(keys[-1], kind="stable")
            first = np.zeros(len(self.ids) + 1, dtype=bool)
            first[flat[begin + offset]] = True
            self.rounds.append((walk, first, [np.unique(k) for k in keys], keys[-1][order], order, offset))

    def _keys(self, flat: np.ndarray, n: int) -> np.ndarray:
        """A key for every n words that follow each other."""
        with np.errstate(over="ignore"):
            return sum((flat[k : len(flat) - n + 1 + k] * self.mix[k] for k in range(n)), np.zeros(max(len(flat) - n + 1, 0), dtype=np.int64))

    @staticmethod
    def _walk(flat, at, walk, prefixes):
        """Keys after each sample. With ``prefixes``, positions whose key so far no item has are given up."""
        key, out, here = np.zeros(len(at), dtype=np.int64), [], at
        with np.errstate(over="ignore"):
            for j in range(walk["samples"][-1] + 1):
                word = flat[here]
                if j in walk["samples"]:
                    key = (key ^ word) * walk["mix"][j]
                    key ^= (key >> 29) & 0x7FFFFFFFF
                    if prefixes is not None:
                        some = prefixes[len(out)]
                        same = some[np.minimum(np.searchsorted(some, key), len(some) - 1)] == key
                        key, here, word, at = key[same], here[same], word[same], at[same]
                    out.append(key)
                here = here + ((word * walk["odd"][j] + walk["add"][j]) < 0)
        return out, at

    def _candidates(self, flat: np.ndarray, begin: np.ndarray) -> dict[int, np.ndarray]:
        """Windows' first positions by item: those that agree in all samples of some repetition.

        A window starts in the text that was met: at its first word (of ``begin``) if the item has more words before.
        """
        known, pairs = np.flatnonzero(flat), []
        for n, keys, items in self.lookups:
            here = self._keys(flat, n)
            low, high = np.searchsorted(keys, here), np.searchsorted(keys, here, side="right")
            at = np.flatnonzero(high > low)
            times = (high - low)[at]
            pairs.append(items[np.repeat(low[at] - np.cumsum(times) + times, times) + np.arange(times.sum())] * len(flat) + np.repeat(at, times))
        for walk, first, prefixes, keys, order, offset in self.rounds:
            at = known[first[flat[known]]]
            found, at = self._walk(flat, at, walk, prefixes)
            low, high = np.searchsorted(keys, found[-1]), np.searchsorted(keys, found[-1], side="right")
            times = high - low
            item = order[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
            first_word = begin[np.searchsorted(begin, at, side="right") - 1]
            pairs.append(item * len(flat) + np.maximum(np.repeat(at, times) - offset[item], np.repeat(first_word, times)))
        item, at = np.divmod(np.unique(np.concatenate(pairs)), len(flat))
        cuts = np.flatnonzero(np.diff(item)) + 1
        return {int(i[0]): p for i, p in zip(np.split(item, cuts), np.split(at, cuts)) if len(i)}

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int, int]]]:
        """For each text: (item id, edits, item words, first word, word after the last), the best passage of each item."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        ids, begin, pad = [], [0], [0] * self.reach
        for t in texts:
            ids.extend(map(self.ids.__getitem__, words(t)))
            ids += pad  # a window never runs into the next text
            begin.append(len(ids))
        flat, begins = np.array(ids, dtype=np.int64), np.array(begin)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, at in self._candidates(flat, begins).items():
            item = self.items[i][1]
            most = int(MAX_EDITS * len(item)) if len(item) >= MIN_WORDS else 0
            different = np.unique(item)
            own = np.full(len(self.ids) + 1, len(different), dtype=np.int64)
            own[different] = np.arange(len(different))
            doc = np.searchsorted(begins, at, side="right") - 1
            low = np.maximum(at - most, begins[doc])
            high = np.minimum(at + len(item) + most, begins[doc + 1] - self.reach)
            for k in range(0, len(at), 10_000):  # an edit takes one of the item's different words away at most
                grid = low[k : k + 10_000, None] + np.arange(len(item) + 2 * most)
                local = np.where(grid < high[k : k + 10_000, None], own[flat[np.minimum(grid, len(flat) - 1)]], len(different))
                met = np.zeros((len(grid), len(different) + 1), dtype=bool)
                met[np.arange(len(grid))[:, None], local] = True
                for n in (np.flatnonzero(met[:, :-1].sum(axis=1) >= len(different) - most) + k).tolist():
                    d, start, end = edits(item, flat[low[n] : high[n]], most)
                    key, start, end = (int(doc[n]), i), int(low[n]) + start, int(low[n]) + end
                    if d <= most and (key not in best or (d, start) < best[key][:2]):
                        best[key] = (d, start, end)
        for (doc, i), (d, start, end) in sorted(best.items()):
            out[doc].append((self.items[i][0], d, len(self.items[i][1]), start - begin[doc], end - begin[doc]))
        return out


def _different(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(i, t): every text once, with the smallest id of the items that have it."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    return rows.groupBy("t").agg(F.min("i").alias("i")).select("i", "t")


def equal_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, found_as): the id under which passages of an item are reported, for every item that has a text."""
    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("t"))
    return own.join(_different(items, item_id, text), "t").select("item_id", F.col("i").alias("found_as"))


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The different items in blocks of bounded size, one at a time on the driver."""
    rows = materialize(_different(items, item_id, text))
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    count = -(-size // (block_bytes // 2))
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("t"), F.lit(count)) == k) if count > 1 else rows
        yield [(r["i"], r["t"]) for r in part.collect()]


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, item_words, similarity, first_word, end_word: the best passage of each item in each document."""
    out = None
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int, item_words int, similarity double, first_word long, end_word long"
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES

        def find(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            match = Matcher(sent.value)
            for rows in batches:
                ids, made, at = rows["doc_id"].tolist(), [], 0
                for some in portions(rows["text"]):
                    for hits in match(some):
                        made += [(ids[at], i, d, n, 1 - d / n, a, b) for i, d, n, a, b in hits]
                        at += 1
                yield pd.DataFrame(made, columns=["doc_id", "item_id", "edits", "item_words", "similarity", "first_word", "end_word"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.range(0).selectExpr(*[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")])


def contaminated(items: list[tuple[int, str]], docs: DataFrame, text: str = "text") -> Column:
    """Whether a text holds a passage of one of these items."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(sent.value)
        for texts in batches:
            yield pd.Series([bool(h) for some in portions(texts) for h in match(some)], dtype=bool)

    return found(F.col(text))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any passage of the items."""
    for block in item_blocks(items):
        docs = docs.filter(~contaminated(block, docs))
    return docs
