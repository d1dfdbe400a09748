"""Katz backoff language model of any order: Good-Turing discounts, exactly normalised backoff weights, stored tables.

``train`` counts the n-grams of every order and writes the model below one path:
words with count, probability and number (``grams/order=1``), longer n-grams with
their counts and the contexts with total and backoff weight (``packed``, a row for each
bucket of contexts), bigrams and weights of hot words (``hot``, ``hot_weights``).
``Model.grams`` and ``Model.weights`` show them as one row a key. ``score`` looks tokens up
in the stored tables: a token whose n-gram is known is done, the others take their context's
weight and ask the next lower order, down to single words. The tables score any
other table as well (``load``).

Texts become blocks, rows of packed arrays of bounded size. A block sends its words, by
ranges of their hashes, to the table of words and gets their numbers and counts. Then each
block sends its n-grams, equal ones once, to the bucket of the word before, where all
orders from 2 on and all contexts of that word are: a trie read backwards, each level
numbers of words below their parents. Training merges a bucket's messages; scoring asks the bucket's
part of the model message by message and returns sums by document.

A word with over ``hot`` occurrences (a quarter of a bucket, ``HOT_SHARE`` of all) would crowd its bucket. Its n-grams go to the buckets of
the last two words before, where they are whole from order 3 on. Its bigrams
are counted by an aggregation and joined to the blocks, so they travel with the message;
there are at most tokens / ``hot`` hot words. Buckets are done in ``PORTIONS``
portions and shuffle files and working tables go as soon as nothing reads them: blocks, model and
one portion's messages are there at a time. Words are told apart by 64-bit hashes, n-grams by the words' numbers.

The discounts are Katz's form of Good-Turing's for counts up to ``DEPTH``, an
order's own. Where the formula gives no value between 0 and 1 for each of them
(small tables), r - 1/2 out of r is kept. A context all of whose n-grams occur
too often for a discount leaves nothing to go back to; half a count is set aside
for it. Single words are discounted too; what that leaves is the probability of the
one unknown word. So the probabilities after any context add up to 1 over the
known words, the end and the unknown word. A text's first words have the start,
as often as needed, before them.

Edge cases: a NULL or empty text has one token, the end. A NULL doc_id is not
held out. Repeated rows count and are scored each. Very long texts are read whole, a block each.
Other columns are left aside. Without training texts every token is unknown, N is 0 and
every score 0; an empty table has an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from flowseg.functions.tables import discard, scratch_path, shuffles_cleared
from flowseg.llm.common import id_remainder

HELD_OUT = (5, 1)
ORDER = 3
DEPTH = 5  #: counts up to this are discounted
START, END = 0, 1  #: in place of a word's hash
UNKNOWN = 1  #: number of words that the model doesn't have; START's is 0
BLOCK_BYTES = 10 << 20  #: of text, about
BUCKET_TOKENS = 2_000_000
HOT_SHARE = 0.005  #: of all tokens; a word with more is hot in small tables too
PORTIONS = 3
SKIPPED, NO_ID = 1, 2  #: flags of a text: not counted, without id


@dataclass
class Model:
    """Tables of orders 1 to n (``weights`` from 2 on), tokens and kinds counted, the unknown word's probability.

    And where it is, its buckets, the count from which a word is hot, the texts counted, the discounts
    and the divisor of order 1, and the hot words' numbers, totals and weights.
    """

    grams: list[DataFrame]
    weights: list[DataFrame]
    tokens: int
    kinds: int
    unknown: float
    path: str
    buckets: int
    hot: float
    texts: int
    factors: list[np.ndarray]
    size: float
    hots: tuple[np.ndarray, np.ndarray, np.ndarray]


def discounts(n: dict[int, int]) -> np.ndarray:
    """Factors for counts 0 to DEPTH from the numbers of kinds that occur r times; larger counts keep 1."""
    out = np.array([0.0] + [(r - 0.5) / r for r in range(1, DEPTH + 1)])
    if n.get(1, 0):
        tail = (DEPTH + 1) * n.get(DEPTH + 1, 0) / n[1]
        good = []
        for r in range(1, DEPTH + 1):
            here = n.get(r, 0)
            good.append(((r + 1) * n.get(r + 1, 0) / (r * here) - tail) / (1 - tail) if here and tail != 1 else 0.0)
        if all(0 < g < 1 for g in good):
            out[1:] = good
    return out


def kept(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts * np.where(counts <= DEPTH, factors[np.minimum(counts, DEPTH)], 1.0)


def pack(values: np.ndarray) -> bytes:
    """Type, then the bytes by place, compressed. Whole numbers must not be negative and get the narrowest type."""
    if values.dtype.kind != "f":
        top = int(values.max()) if len(values) else 0
        values = values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return values.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    """Whole numbers as 64 bits."""
    kind = np.dtype(data[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), dtype=np.uint8)
    out = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return out if kind.kind == "f" else out.astype(np.int64)


def _stored(df: DataFrame, path: str) -> DataFrame:
    with shuffles_cleared(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _collected(df: DataFrame) -> list[Row]:
    """Few rows, by way of a table: collecting leaves shuffle files."""
    path = scratch_path(df.sparkSession, "katz-few")
    rows = _stored(df, path).collect()
    discard(df.sparkSession, path)
    return rows


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def encode(docs: DataFrame, *keep: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Written once, to ``path``: ``row`` (a number of its own for every row), the columns to keep, ``words`` (hashes, then the end)."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    split = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    words = F.concat(F.transform(split, lambda w: F.xxhash64(w)), F.array(F.lit(END).cast("long")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, words.alias("words"))
    return _stored(rows, path or scratch_path(docs.sparkSession, "katz-words"))


def _names(n: int) -> list[str]:
    return [f"w{k}" for k in range(1, n + 1)]


# Blocks ---------------------------------------------------------------------


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words and the end, each token's place among them, tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "")
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    sizes = upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]] + 1
    coded = flat.filter(real).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, seed=42) for w in coded.dictionary.cast("binary" if coded.dictionary.type == pa.string() else "large_binary").to_pylist()], dtype=np.uint64)  # as F.xxhash64
    tokens = np.full(int(sizes.sum()), len(hashes), dtype=np.int64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[np.cumsum(sizes) - 1] = False
    tokens[inner] = coded.indices.to_numpy()
    return np.append(hashes.view(np.int64), END), tokens, sizes


def _coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts that are hashes already."""
    hashes, tokens = np.unique(words.flatten().to_numpy(), return_inverse=True)
    return hashes, tokens, pc.list_value_length(words).to_numpy().astype(np.int64)


_PACKED = "block long, ids binary, flags binary, sizes binary, tokens binary, words array<long>, counts array<long>"


def _packed(rows: DataFrame, path: str) -> DataFrame:
    """Blocks of the rows ``id``, ``flags`` and either ``text`` or ``words``, with the words (by hash) and their counts in what is counted; written to ``path``."""
    by_text = "text" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("text" if by_text else "words")
            length = pc.fill_null(pc.binary_length(own) if by_text else pc.multiply(pc.list_value_length(own), 8), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(length.astype(np.int64))
            total = max(int(upto[-1]), 1)
            part = upto * -(-total // BLOCK_BYTES) // (total + 1)  # blocks of equal size
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                hashes, tokens, sizes = (_split if by_text else _coded)(own.slice(a, b - a))
                order = np.argsort(hashes.view(np.uint64))
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                hashes, tokens = hashes[order], rank[tokens]
                flags = batch.column("flags").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
                counted = np.repeat(flags & SKIPPED == 0, sizes)
                counts = np.bincount(tokens[counted], minlength=len(hashes))
                ids = batch.column("id").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64).view(np.float64)  # any 64 bits
                columns = [[block], [pack(ids)], [pack(flags)], [pack(sizes)], [pack(tokens)], [hashes], [counts]]
                kinds = [pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _PACKED.split(", ")])
                block += 1

    return _stored(rows.mapInArrow(run, _PACKED), path)


def _from_encoded(encoded: DataFrame, path: str) -> DataFrame:
    return _packed(encoded.select(F.col("row").alias("id"), F.lit(0).alias("flags"), "words"), path)


def _before(tokens: np.ndarray, sizes: np.ndarray, steps: int, start: int) -> np.ndarray:
    """The token so many steps before each, ``start`` before a text's first."""
    out = np.full_like(tokens, start)
    out[steps:] = tokens[:-steps] if steps else tokens
    first = np.cumsum(sizes) - sizes
    for k in range(steps):
        at = first[sizes > k] + k
        out[at] = start
    return out


_PAIRS = "block long, before_at long, at long, before long, w long, times long"


def _hot_pairs(packed: DataFrame, hashes: np.ndarray) -> DataFrame:
    """A block's different bigrams after hot words (sorted hashes): places in the block (the start's is -1), hashes, times counted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for r in rows.itertuples(index=False):
                words, sizes, tokens = np.append(np.asarray(r.words), START), unpack(r.sizes), unpack(r.tokens)
                start = len(words) - 1
                before = _before(tokens, sizes, 1, start)
                some = np.isin(words, hashes)[before]
                counted = np.repeat(unpack(r.flags) & SKIPPED == 0, sizes)[some]
                pair, same = np.unique(before[some] * len(words) + tokens[some], return_inverse=True)
                v, w = pair // len(words), pair % len(words)
                times = np.bincount(same, weights=counted, minlength=len(pair)).astype(np.int64)
                yield pd.DataFrame({"block": r.block, "before_at": np.where(v == start, -1, v), "at": w, "before": words[v], "w": words[w], "times": times})

    return packed.select("block", "flags", "sizes", "tokens", "words").mapInPandas(run, _PAIRS)


_SENT = "block long, share long, words binary"
_NUMBERS = "block long, share long, numbers binary, counts binary"


def _share(hashes: np.ndarray, shares: int) -> np.ndarray:
    """Equal ranges of unsigned hashes; as ``_share_column``."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _share_column(word: str, shares: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(word, 32) * F.lit(shares).cast("long"), 32)


def _numbers(packed: DataFrame, model: Model) -> DataFrame:
    """For each block and share of hashes: the words' numbers and counts."""
    shares = model.buckets

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for block, words in zip(rows["block"], rows["words"]):
                words = np.asarray(words)
                share = _share(words, shares)
                cuts = np.append(np.flatnonzero(np.diff(share, prepend=-1)), len(share)).tolist()
                yield _frame([(block, int(share[a]), pack(words[a:b].view(np.float64))) for a, b in zip(cuts, cuts[1:])], _SENT)

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = right["w1"].to_numpy().view(np.uint64)
        order, out = np.argsort(known), []
        known, number, count = np.append(known[order], 0), np.append(right["number"].to_numpy()[order], 0), np.append(right["count"].to_numpy()[order], 0)
        for r in left.itertuples(index=False):
            words = unpack(r.words).view(np.uint64)
            at = np.searchsorted(known[:-1], words)
            seen = (known[at] == words) & (at < len(known) - 1)
            out.append((r.block, r.share, pack(np.where(seen, number[at], UNKNOWN)), pack(np.where(seen, count[at], 0))))
        return _frame(out, _NUMBERS)

    sent = packed.select("block", "words").mapInPandas(send, _SENT)
    words = model.grams[0].select(_share_column("w1", shares).alias("share"), "w1", "number", "count")
    return sent.groupBy("share").cogroup(words.groupBy("share")).applyInPandas(find, _NUMBERS)


_BLOCK = "block long, ids binary, flags binary, sizes binary, base binary, known binary, single binary, tokens binary, numbers binary, counts binary, pairs binary, pair_counts binary"


def _probability(counts: np.ndarray, model: Model) -> np.ndarray:
    """Of single words, by their counts."""
    return np.where(counts > 0, kept(counts, model.factors[1]) / max(model.size, 1e-300), model.unknown)


def _pairs_packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A block's hot bigrams as its share -1: places before (the start's is 0, others one more) and places, counts."""
    places = np.concatenate([rows["before_at"].to_numpy() + 1, rows["at"].to_numpy()])
    return _frame([(int(key[0]), -1, pack(places), pack(rows["count"].to_numpy()))], _NUMBERS)


def _numbered(packed: DataFrame, model: Model, pairs: DataFrame | None, path: str) -> DataFrame:
    """Blocks whose words are the model's numbers, with the counts of words and of hot words' bigrams; what each text gets from order 1; written to ``path``."""
    spark = packed.sparkSession
    asked = _numbers(packed, model)
    if pairs is not None:
        hot = spark.read.parquet(f"{model.path}/hot").select(F.col("w1").alias("before"), F.col("w2").alias("w"), "count")
        found = pairs.join(hot, ["before", "w"]).select("block", "before_at", "at", "count")
        asked = asked.unionByName(found.groupBy("block").applyInPandas(_pairs_packed, _NUMBERS))
    plain = _plain(model)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right, out = right.sort_values("share"), []
        hot = right["share"] < 0
        number, count = (np.concatenate([unpack(x) for x in right.loc[~hot, c]]) for c in ("numbers", "counts"))
        numbers, first, place = np.unique(number, return_index=True, return_inverse=True)
        numbers, counts, code = np.append(START, numbers), np.append(plain.texts, count[first]), place + 1
        before = at = pair_counts = np.zeros(0, np.int64)
        for x, n in zip(right.loc[hot, "numbers"], right.loc[hot, "counts"]):
            (before, at), pair_counts = unpack(x).reshape(2, -1), unpack(n)
        pair = np.where(before == 0, 0, code[np.maximum(before - 1, 0)]) * len(numbers) + code[at]
        order = np.argsort(pair)
        for r in left.itertuples(index=False):
            sizes, tokens = unpack(r.sizes), code[unpack(r.tokens)]
            doc, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
            sums = [np.bincount(doc, weights=x[tokens], minlength=n) for x in (np.log10(counts + 0.5), counts > 0, np.log10(_probability(counts, plain)))]
            row = (r.block, r.ids, r.flags, r.sizes, pack(sums[0]), pack(sums[1].astype(np.int64)), pack(sums[2]), pack(tokens), pack(numbers), pack(counts), pack(pair[order]), pack(pair_counts[order]))
            out.append(row)
        return _frame(out, _BLOCK)

    left = packed.select(F.col("block").alias("block"), "ids", "flags", "sizes", "tokens")  # a column of its own, for the cogroup
    return _stored(left.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(run, _BLOCK), path)


def _portions(model: Model) -> int:
    return min(PORTIONS, model.buckets)


def _plain(model: Model) -> Model:
    """What tasks need."""
    return Model([], [], model.tokens, model.kinds, model.unknown, model.path, model.buckets, model.hot, model.texts, model.factors, model.size, model.hots)


# Messages -------------------------------------------------------------------


def _spread(values: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    """Order by the columns: of one number where they fit into 63 bits, if need be as ranks."""
    columns = list(columns)
    bits = [int(c.max()).bit_length() for c in columns]
    for k in range(len(columns)):
        if sum(bits) <= 63:
            key = columns[0].copy()
            for c, b in zip(columns[1:], bits[1:]):
                key = (key << b) | c
            return np.argsort(key)
        columns[k] = np.unique(columns[k], return_inverse=True)[1]
        bits[k] = int(columns[k].max()).bit_length()
    return np.lexsort(columns[::-1])


def _sorted_columns(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns in their order, without other columns that have to follow."""
    bits = [int(c.max()).bit_length() for c in columns]
    if sum(bits) > 63:
        by = _sorted(columns)
        return [c[by] for c in columns]
    key = columns[0].copy()
    for c, b in zip(columns[1:], bits[1:]):
        key = (key << b) | c
    key.sort()
    out = []
    for b in bits[::-1]:
        out.append(key & ((1 << b) - 1))
        key = key >> b
    return out[::-1]


def _levels(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each number of leading columns, where a new combination starts."""
    out, new = [], np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        out.append(np.flatnonzero(new))
    return out


def _children(parents: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the starts each parent has."""
    return np.diff(np.append(np.searchsorted(starts, parents), len(starts)))


def _trie(columns: list[np.ndarray], starts: list[np.ndarray]) -> list[bytes]:
    """Level by level the numbers and, from the second on, how many there are below each parent."""
    out = [pack(columns[0][starts[0]])]
    for k in range(1, len(columns)):
        out += [pack(_children(starts[k - 1], starts[k])), pack(columns[k][starts[k]])]
    return out


_MESSAGE = "block long, bucket long, parts array<binary>"


def _messages(blocks: DataFrame, model: Model, order: int, portion: int, training: bool) -> DataFrame:
    """A block's different n-grams by bucket.

    Parts: a trie of the contexts, read backwards; counts of the words at its first level; n-grams of each context, their words' places
    in the following two (numbers and counts); times; counts of hot words' bigrams; for scoring, the texts of all times.
    """
    plain = _plain(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for r in rows.itertuples(index=False):
                out = list(sent(r))
                if out:
                    yield _frame(out, _MESSAGE)

    def sent(r: tuple) -> Iterator[tuple]:
        sizes, numbers, counts = unpack(r.sizes), unpack(r.numbers), unpack(r.counts)
        tokens = unpack(r.tokens)
        v, u = _before(tokens, sizes, 1, 0), _before(tokens, sizes, 2, 0)
        own, other = _spread(numbers, plain.buckets), numbers * 1_000_003
        bucket, is_hot = own[v], counts > plain.hot
        at = np.flatnonzero(is_hot[v])
        bucket[at] = _spread(other[v[at]] + numbers[u[at]], plain.buckets)
        some = bucket % PORTIONS == portion
        doc = np.repeat(np.arange(len(sizes)), sizes)
        if training:
            some &= (unpack(r.flags) & SKIPPED == 0)[doc]
        some = np.flatnonzero(some)
        if not len(some):
            return
        columns = [bucket[some], v[some]]
        for k in range(2, order):
            columns.append((u if k == 2 else _before(tokens, sizes, k, 0))[some])
        columns.append(tokens[some])
        if training:
            bucket, *columns = _sorted_columns(columns)
        else:
            by = _sorted(columns)
            (bucket, *columns), doc = [c[by] for c in columns], doc[some][by]
        used, rank = np.zeros(len(numbers), dtype=bool), np.empty(len(numbers), np.int64)
        pairs, pair_counts = unpack(r.pairs), unpack(r.pair_counts)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            own = [c[a:b] for c in columns]
            starts = _levels(own)
            firsts = starts[-1]
            context, word = [numbers[c] for c in own[:-1]], own[-1][firsts]
            used[word] = True
            kinds = np.flatnonzero(used)
            rank[kinds], used[kinds] = np.arange(len(kinds)), False
            place, before = rank[word], own[0][firsts]
            ask = is_hot[before]
            pair = before[ask] * len(numbers) + word[ask]
            found = np.zeros(len(pair), np.int64)
            if len(pairs):
                near = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                found = np.where(pairs[near] == pair, pair_counts[near], 0)
            parts = [*_trie(context, starts[:-1]), pack(counts[own[0][starts[0]]]), pack(_children(starts[-2], firsts)), pack(place), pack(numbers[kinds]), pack(counts[kinds])]
            parts += [pack(np.diff(np.append(firsts, b - a))), pack(found)]
            yield r.block, int(bucket[a]), parts if training else [*parts, pack(doc[a:b])]

    columns = ["block", "sizes", "tokens", "numbers", "counts", "pairs", "pair_counts", *["flags"] * training]
    return blocks.select(*columns).mapInPandas(run, _MESSAGE)


class _Message:
    """A message's parts: ``levels`` (parents, numbers) of the contexts, ``leaf`` (contexts of the n-grams) and arrays by n-gram."""

    def __init__(self, parts: list[bytes], order: int, hot: float):
        x = [unpack(p) for p in parts]
        self.levels = [(np.zeros(len(x[0]), np.int64), x[0])]
        for k in range(2, order):
            self.levels.append((np.repeat(np.arange(len(x[2 * k - 3])), x[2 * k - 3]), x[2 * k - 2]))
        self.before_counts, lengths, place, numbers, counts, self.times, found, *docs = x[2 * order - 3 :]
        self.leaf = np.repeat(np.arange(len(lengths)), lengths)
        self.word, self.word_count = numbers[place], counts[place]
        self.ups = [self.leaf]  # contexts by n-gram, longest first
        for parents, _ in self.levels[:0:-1]:
            self.ups.append(parents[self.ups[-1]])
        self.is_hot = (self.before_counts > hot)[self.ups[-1]]
        self.pair_count = np.zeros(len(self.leaf), np.int64)
        self.pair_count[self.is_hot] = found
        self.docs = docs[0] if docs else None

    def columns(self) -> list[np.ndarray]:
        """Numbers of the words, from the one before backwards, then the word's."""
        return [numbers[up] for (_, numbers), up in zip(self.levels, self.ups[::-1])] + [self.word]


# Training -------------------------------------------------------------------


class _Counts:
    """A bucket's n-grams of the top order, sorted, each once, and what follows for the lower orders."""

    def __init__(self, columns: list[np.ndarray], times: np.ndarray):
        order = len(columns)
        self.starts = _levels(columns[:-1])
        n = len(times)
        self.columns, self.contexts = columns, []
        for s in self.starts:
            of = np.zeros(n, np.int64)
            of[s[1:]] = 1
            self.contexts.append(np.cumsum(of))
        self.keys, self.place, self.counts = [], [], []  # of order 2 and so on: context and word, each row's place, counts
        for k in range(2, order + 1):
            key = (self.contexts[k - 2] << 32) | columns[-1]
            key, place = (key, np.arange(n)) if k == order else np.unique(key, return_inverse=True)
            self.keys.append(key)
            self.place.append(place)
            self.counts.append(times if k == order else np.bincount(place, weights=times, minlength=len(key)).astype(np.int64))


_COUNTED = "bucket long, kinds array<long>, parts array<binary>"
_MODEL = "bucket long, parts array<binary>"


def _count(messages: DataFrame, order: int, hot: float) -> DataFrame:
    """A row a bucket: n-grams of the top order with what the messages know of their words; kinds by low count of every order from 2 on."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [_Message(p, order, hot) for p in rows["parts"]]
        columns = [np.concatenate(c) for c in zip(*[m.columns() for m in found])]
        more = [np.concatenate(x) for x in zip(*[(m.times, m.word_count, m.before_counts[m.ups[-1]], m.pair_count) for m in found])]
        by = _sorted(columns)
        columns, more = [c[by] for c in columns], [c[by] for c in more]
        firsts = _levels(columns)[-1]
        times = np.add.reduceat(more[0], firsts)
        columns = [c[firsts] for c in columns]
        word_count, before_count, pair_count = (c[firsts] for c in more[1:])
        counts = _Counts(columns, times)
        kinds = []
        for k, (keys, n) in enumerate(zip(counts.keys, counts.counts)):
            if not k:  # those of hot words are counted elsewhere
                n = n[before_count[counts.starts[0]][keys >> 32] <= hot]
            kinds += np.bincount(np.minimum(n, DEPTH + 2), minlength=DEPTH + 3)[1 : DEPTH + 2].tolist()
        parts = [*_trie(columns, [*counts.starts, np.arange(len(times))]), pack(times), pack(word_count), pack(before_count[counts.starts[0]]), pack(pair_count[before_count > hot])]
        return _frame([(int(key[0]), kinds, parts)], _COUNTED)

    return messages.groupBy("bucket").applyInPandas(run, _COUNTED)


def _flat(parts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns of a trie of so many levels, and its further parts."""
    x = [unpack(p) for p in parts]
    columns = [x[0]]
    for k in range(1, order):
        columns = [np.repeat(c, x[2 * k - 1]) for c in columns] + [x[2 * k]]
    return columns, x[2 * order - 1 :]


def _weigh(counted: DataFrame, model: Model, order: int) -> DataFrame:
    """The model's row for each bucket.

    Parts: the contexts' trie; for each length of contexts twice their totals (odd: half a count is set aside) and their weights; for each
    order from 2 on n-grams of each context, words, counts. Bigrams of hot words are not among them.
    """
    plain = _plain(model)

    def row(r: tuple) -> tuple:
        columns, (times, word_count, before_count, found) = _flat(r.parts, order)
        c = _Counts(columns, times)
        is_hot = before_count > plain.hot
        numbers, totals, hot_weights = plain.hots
        lower = _probability(word_count, plain)
        values, leaves = [], []
        for k in range(2, order + 1):
            keys, counts, place, n = c.keys[k - 2], c.counts[k - 2].copy(), c.place[k - 2], len(c.starts[k - 2])
            context, first = keys >> 32, np.empty(len(keys), np.int64)
            first[place] = np.arange(len(place))
            if k == 2:
                pairs = np.zeros(len(times), np.int64)
                pairs[is_hot[c.contexts[0]]] = found
                counts = np.where(is_hot[context], pairs[first], counts)
            left = kept(counts, plain.factors[k])
            total = np.bincount(context, weights=counts, minlength=n)
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, context, counts)
            total = total + np.where(least > DEPTH, 0.5, 0.0)
            mass = np.bincount(context, weights=counts - left, minlength=n) + np.where(least > DEPTH, 0.5, 0.0)
            weight = mass / total / np.maximum(1 - np.bincount(context, weights=lower[first], minlength=n), 1e-300)
            stored = np.ones(len(keys), dtype=bool)
            if k == 2 and is_hot.any():
                at = np.searchsorted(numbers, columns[0][c.starts[0]][is_hot])
                total[is_hot], weight[is_hot] = totals[at], hot_weights[at]
                stored = ~is_hot[context]
            lower = (left / total[context])[place]
            values += [pack(np.rint(total * 2).astype(np.int64)), pack(weight)]
            leaves += [pack(np.bincount(context[stored], minlength=n)), pack(keys[stored] & 0xFFFFFFFF), pack(counts[stored])]
        return r.bucket, [*_trie(columns[:-1], c.starts), *values, *leaves]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for r in rows.itertuples(index=False):
                yield _frame([row(r)], _MODEL)

    return counted.select("bucket", "parts").mapInPandas(run, _MODEL)


class _Part:
    """A bucket's part of the model: sorted keys of contexts (parent and word) and n-grams (context and word), their values."""

    def __init__(self, parts: list[bytes] | None, order: int):
        if parts is None:
            empty, weights = np.zeros(0, np.int64), np.zeros(0)
            self.contexts, self.totals, self.weights, self.keys, self.counts = ([x] * order for x in (empty, weights, weights, empty, empty))
            return
        x = [unpack(p) for p in parts]
        self.contexts = [x[0]]
        for k in range(2, order):
            self.contexts.append((np.repeat(np.arange(len(x[2 * k - 3])), x[2 * k - 3]) << 32) | x[2 * k - 2])
        x = x[2 * order - 3 :]
        self.totals, self.weights = [x[2 * k] / 2 for k in range(order - 1)], [x[2 * k + 1] for k in range(order - 1)]
        x = x[2 * order - 2 :]
        self.keys = [(np.repeat(np.arange(len(x[3 * k])), x[3 * k]) << 32) | x[3 * k + 1] for k in range(order - 1)]
        self.counts = [x[3 * k + 2] for k in range(order - 1)]


def _discounted(counts: DataFrame) -> tuple[dict[int, int], np.ndarray, Column]:
    """Numbers of kinds by low count, their factors, and the column of discounted counts."""
    low = counts.filter(F.col("count") <= DEPTH + 1).groupBy("count").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = {r["count"]: r["kinds"] for r in _collected(low)}  # six rows at most
    factors = discounts(kinds)
    return kinds, factors, _kept(factors)


def _kept(factors: np.ndarray) -> Column:
    out = F.col("count").cast("double")
    for r in range(1, DEPTH + 1):
        out = F.when(F.col("count") == r, F.lit(float(r * factors[r]))).otherwise(out)
    return out


def _words(packed: DataFrame, path: str, work: str, bucket_tokens: int) -> Model:
    """The table of words and a model that has nothing else yet. Numbers: frequent words' are small."""
    spark = packed.sparkSession
    sums = packed.select(F.inline(F.arrays_zip("words", "counts"))).filter("counts > 0").groupBy(F.col("words").alias("w1")).agg(F.sum("counts").alias("count"))
    placed = sums.sortWithinPartitions(F.desc("count"), "w1").withColumn("at", F.monotonically_increasing_id())
    counts = _stored(placed, f"{work}/order=1")
    kinds_by_count, factors, left_over = _discounted(counts)
    part = F.shiftright("at", 33)
    (totals,) = _collected(counts.agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("kinds"), F.max(part).alias("part"), F.max(F.when(F.col("w1") == END, F.col("count"))).alias("texts")))
    tokens, kinds, parts = totals["tokens"] or 0, totals["kinds"], (totals["part"] or 0) + 1
    left = sum(r * n * (1 - factors[r]) for r, n in kinds_by_count.items() if r <= DEPTH)
    size = tokens if left > 0 else tokens + 0.5  # every kind occurs often: one kind more, seen half a time
    unknown = float((left if left > 0 else 0.5) / size) if tokens else 1.0
    number = (F.col("at") - F.shiftleft(part, 33)) * parts + part + 2
    single = counts.select("w1", "count", (left_over / F.lit(float(size))).alias("p"), F.col("count").alias("last_count"), number.alias("number"))
    grams = _stored(single, f"{path}/grams/order=1")
    discard(spark, f"{work}/order=1")
    none = np.zeros(0)
    return Model([grams], [], tokens, kinds, unknown, path, max(1, -(-tokens // bucket_tokens)), min(bucket_tokens / 4, tokens * HOT_SHARE), totals["texts"] or 0, [factors, factors], float(size), (none.astype(np.int64), none, none))


def _hot_words(model: Model) -> list[Row]:
    """At most tokens / hot of them; the start is hot with as many texts."""
    rows = _collected(model.grams[0].filter((F.col("count") > model.hot) & (F.col("w1") != END)).select("w1", "number"))
    return [*rows, *([Row(w1=START, number=START)] if model.texts > model.hot else [])]


def _hot_table(packed: DataFrame, model: Model, work: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Hot words' bigrams of each block, and all counted ones with their words' probabilities."""
    hashes = np.sort(np.array([r["w1"] for r in _hot_words(model)], dtype=np.int64))
    if not len(hashes):
        return None, None
    pairs = _stored(_hot_pairs(packed, hashes), f"{work}/pairs")
    counts = pairs.groupBy(F.col("before").alias("w1"), F.col("w").alias("w2")).agg(F.sum("times").alias("count")).filter("count > 0")
    lower = model.grams[0].select(F.col("w1").alias("w2"), F.col("p").alias("lower"), "last_count")
    return pairs, _stored(counts.join(lower, "w2").select("w1", "w2", "count", "lower", "last_count"), f"{model.path}/hot")


def _train(packed: DataFrame, path: str, work: str, order: int, bucket_tokens: int) -> tuple[Model, DataFrame]:
    """The model, written below ``path``, and the numbered blocks, in ``work``. Skipped texts are in the blocks, but not counted."""
    spark = packed.sparkSession
    model = _words(packed, path, work, bucket_tokens)
    pairs, hot = _hot_table(packed, model, work) if order > 1 else (None, None)
    blocks = _numbered(packed, model, pairs, f"{work}/blocks")
    for done in ("packed", "pairs"):
        discard(spark, f"{work}/{done}")
    if order > 1:
        counted = [_stored(_count(_messages(blocks, model, order, j, True), order, model.hot), f"{work}/counts/portion={j}") for j in range(_portions(model))]
        kinds = np.zeros((order - 1, DEPTH + 1), np.int64)
        for c in counted:
            (sums,) = _collected(c.agg(*[F.sum(F.col("kinds")[i]).alias(f"k{i}") for i in range(kinds.size)]))
            kinds += np.array([x or 0 for x in sums], np.int64).reshape(kinds.shape)
        if hot is not None:
            for r in _collected(hot.filter(F.col("count") <= DEPTH + 1).groupBy("count").agg(F.count(F.lit(1)).alias("kinds"))):
                kinds[0, r["count"] - 1] += r["kinds"]
        model.factors += [discounts(dict(enumerate(k.tolist(), 1))) for k in kinds]
        if hot is not None:
            _weigh_hot(hot, model)
        for j, c in enumerate(counted):
            _stored(_weigh(c, model, order), f"{path}/packed/portion={j}")
            discard(spark, f"{work}/counts/portion={j}")
    settings = [(order, model.tokens, model.kinds, model.unknown, model.buckets, model.hot, model.texts, model.size, [f.tolist() for f in model.factors], len(model.hots[0]))]
    schema = "order int, tokens long, kinds long, unknown double, buckets long, hot double, texts long, size double, factors array<array<double>>, hots int"
    spark.createDataFrame(settings, schema).coalesce(1).write.parquet(f"{path}/settings")
    return load(spark, path), blocks


def _weigh_hot(hot: DataFrame, model: Model) -> None:
    left = _kept(model.factors[2])
    sums = hot.groupBy("w1").agg(F.sum("count").alias("total"), F.min("count").alias("least"), F.sum(F.col("count") - left).alias("mass"), F.sum("lower").alias("used"))
    aside = F.when(F.col("least") > DEPTH, 0.5).otherwise(0.0)
    total = F.col("total") + aside
    weight = (F.col("mass") + aside) / total / F.greatest(1 - F.col("used"), F.lit(1e-300))
    numbers = model.grams[0].sparkSession.createDataFrame(_hot_words(model), "w1 long, number long")
    _stored(sums.join(numbers, "w1").select("w1", "number", total.alias("total"), weight.alias("weight")).coalesce(1), f"{model.path}/hot_weights")
    model.hots = _hots(model.grams[0].sparkSession, model.path)


def _hots(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = sorted(tuple(r) for r in _collected(spark.read.parquet(f"{path}/hot_weights").select("number", "total", "weight")))
    return tuple(np.array(x, dtype=t) for x, t in zip(zip(*rows), (np.int64, float, float)))


def train(encoded: DataFrame, path: str, order: int = ORDER, bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """Counts, probabilities and weights of ``words``, written below ``path``."""
    spark = encoded.sparkSession
    work = scratch_path(spark, "katz-work")
    model, _ = _train(_from_encoded(encoded, f"{work}/packed"), path, work, order, bucket_tokens)
    discard(spark, work)
    return model


def _shown(spark: SparkSession, model: Model, order: int, n: int) -> tuple[DataFrame, DataFrame]:
    """The n-grams and the weights of their contexts, one row a key."""
    plain = _plain(model)
    packed = spark.read.schema(_MODEL).parquet(*[f"{model.path}/packed/portion={j}" for j in range(_portions(model))])
    hot = len(model.hots[0]) > 0 and n == 2
    own = _names(n)

    def numbers(part: _Part, at: np.ndarray, length: int) -> list[np.ndarray]:
        """Of the words of contexts, the first first."""
        out = []
        for k in range(length - 1, -1, -1):
            out.append(part.contexts[k][at] & 0xFFFFFFFF)
            at = part.contexts[k][at] >> 32
        return out

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for p in rows["parts"]:
                part = _Part(p, order)
                context, count = part.keys[n - 2] >> 32, part.counts[n - 2]
                words = [*numbers(part, context, n - 1), part.keys[n - 2] & 0xFFFFFFFF]
                yield pd.DataFrame(dict(zip(own, words)) | {"count": count, "p": kept(count, plain.factors[n]) / part.totals[n - 2][context]})

    def weights(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for p in rows["parts"]:
                part = _Part(p, order)
                words = numbers(part, np.arange(len(part.totals[n - 2])), n - 1)
                frame = pd.DataFrame(dict(zip(own, words)) | {"total": part.totals[n - 2], "weight": part.weights[n - 2]})
                yield frame[~frame["w1"].isin(plain.hots[0])] if hot else frame

    names = model.grams[0].select("number", "w1", "last_count").unionByName(spark.createDataFrame([(START, START, 0)], "number long, w1 long, last_count long"))

    def named(df: DataFrame, words: list[str], *more: str) -> DataFrame:
        for w in words:
            df = df.join(names.select(F.col("number").alias(w), F.col("w1").alias(f"_{w}"), F.col("last_count").alias(f"_count_{w}")), w)
        return df.select(*[F.col(f"_{w}").alias(w) for w in words], *more, *([F.col(f"_count_{own[-1]}").alias("last_count")] if words == own else []))

    shown = named(packed.mapInPandas(grams, f"{', '.join(f'{w} long' for w in own)}, count long, p double"), own, "count", "p")
    weighed = named(packed.mapInPandas(weights, f"{', '.join(f'{w} long' for w in own[:-1])}, total double, weight double"), own[:-1], "total", "weight")
    if hot:
        more = spark.read.parquet(f"{model.path}/hot_weights")
        counts = spark.read.parquet(f"{model.path}/hot").join(more.select("w1", "total"), "w1")
        shown = shown.unionByName(counts.select("w1", "w2", "count", (_kept(plain.factors[2]) / F.col("total")).alias("p"), "last_count"))
        weighed = weighed.unionByName(more.select("w1", "total", "weight"))
    return shown, weighed


def load(spark: SparkSession, path: str) -> Model:
    """The model that ``train`` wrote."""
    row = spark.read.parquet(f"{path}/settings").first()
    words = spark.read.schema("w1 long, count long, p double, last_count long, number long").parquet(f"{path}/grams/order=1")
    none = np.zeros(0)
    hots = _hots(spark, path) if row["hots"] else (none.astype(np.int64), none, none)
    model = Model([words], [], row["tokens"], row["kinds"], row["unknown"], path, row["buckets"], row["hot"], row["texts"], [np.array(f) for f in row["factors"]], row["size"], hots)
    for n in range(2, row["order"] + 1):
        grams, weights = _shown(spark, model, row["order"], n)
        model.grams.append(grams)
        model.weights.append(weights)
    return model


# Scoring --------------------------------------------------------------------

_ANSWER = "block long, docs binary, sums binary"


def _answers(messages: DataFrame, packed: DataFrame, model: Model, order: int) -> DataFrame:
    """For each message sums of its texts' log10 probabilities."""
    plain = _plain(model)

    def found(keys: np.ndarray, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where there is none."""
        if not len(keys):
            return np.full(len(words), -1)
        ask = (parents << 32) | words
        at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
        return np.where((parents >= 0) & (keys[at] == ask), at, -1)

    def answer(r: tuple, part: _Part) -> tuple:
        m = _Message(r.parts, order, plain.hot)
        places = []
        for k, (parents, numbers) in enumerate(m.levels):
            places.append(found(part.contexts[k], places[-1][parents] if k else parents, numbers))
        value, open_ = np.zeros(len(m.leaf)), np.arange(len(m.leaf))
        for n in range(order, 1, -1):
            at = places[n - 2][m.ups[order - n][open_]]
            place = found(part.keys[n - 2], at, m.word[open_])
            count = np.where(place >= 0, part.counts[n - 2][place] if len(part.counts[n - 2]) else 0, 0)
            total, weight = (np.where(at >= 0, x[at] if len(x) else 1.0, 1.0) for x in (part.totals[n - 2], part.weights[n - 2]))
            if n == 2 and m.is_hot.any():
                numbers, totals, weights = plain.hots
                hot = m.is_hot[open_]
                own = np.searchsorted(numbers, m.levels[0][1][m.ups[-1][open_[hot]]])
                count[hot], total[hot], weight[hot] = m.pair_count[open_[hot]], totals[own], weights[own]
            seen = count > 0
            value[open_] += np.log10(np.where(seen, kept(count, plain.factors[n]) / total, weight))
            open_ = open_[~seen]
        value[open_] += np.log10(_probability(m.word_count[open_], plain))
        sums = np.bincount(m.docs, weights=np.repeat(value, m.times))
        docs = np.flatnonzero(np.bincount(m.docs))
        return r.block, pack(docs), pack(sums[docs])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        part = _Part(right["parts"].iloc[0] if len(right) else None, order)
        return _frame([answer(r, part) for r in left.itertuples(index=False)], _ANSWER)

    return messages.groupBy("bucket").cogroup(packed.groupBy("bucket")).applyInPandas(run, _ANSWER)


_SUMS = "id long, flags int, n_tokens long, n_known long, base double, score double"


def _scores(blocks: DataFrame, model: Model, work: str) -> DataFrame:
    """Of every text: id, flags, tokens, known ones, their words' logarithms, log10 probability."""
    spark, order = blocks.sparkSession, len(model.grams)
    parts = []
    for j in range(_portions(model) if order > 1 else 0):
        packed = spark.read.schema(_MODEL).parquet(f"{model.path}/packed/portion={j}")
        parts.append(_stored(_answers(_messages(blocks, model, order, j, False), packed, model, order), f"{work}/answers/portion={j}"))
    answers = parts[0] if parts else spark.createDataFrame([], _ANSWER)
    for more in parts[1:]:
        answers = answers.unionByName(more)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (r,) = left.itertuples(index=False)
        sizes = unpack(r.sizes)
        score = np.zeros(len(sizes)) if order > 1 else unpack(r.single)
        for docs, sums in zip(right["docs"], right["sums"]):
            score[unpack(docs)] += unpack(sums)
        return pd.DataFrame({"id": unpack(r.ids).view(np.int64), "flags": unpack(r.flags), "n_tokens": sizes, "n_known": unpack(r.known), "base": unpack(r.base), "score": score})

    left = blocks.select(F.col("block").alias("block"), "ids", "flags", "sizes", "base", "known", "single")
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, _SUMS)


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """row, n_known (tokens whose word was counted), base (logarithms of their words' counts and a half), score (log10 probability)."""
    spark = encoded.sparkSession
    work = scratch_path(spark, "katz-work")
    packed = _from_encoded(encoded, f"{work}/packed")
    hashes = np.sort(np.array([r["w1"] for r in _hot_words(model)], dtype=np.int64))
    pairs = _hot_pairs(packed, hashes) if len(hashes) and len(model.grams) > 1 else None
    blocks = _numbered(packed, model, pairs, f"{work}/blocks")
    discard(spark, f"{work}/packed")
    rows = _stored(_scores(blocks, model, work).select(F.col("id").alias("row"), "n_known", "base", "score"), scratch_path(spark, "katz-scores"))
    discard(spark, work)
    return rows


def score_documents(docs: DataFrame, order: int = ORDER, path: str | None = None, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; the model stays below ``path``."""
    spark = docs.sparkSession
    work = scratch_path(spark, "katz-work")
    held = F.coalesce(id_remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    flags = F.when(held, SKIPPED).otherwise(0) + F.when(F.col("doc_id").isNull(), NO_ID).otherwise(0)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), flags.alias("flags"), "text")
    model, blocks = _train(_packed(rows, f"{work}/packed"), path or scratch_path(spark, "katz"), work, order, bucket_tokens)
    constant = float(np.log10(model.tokens + 0.5 * (model.kinds + 1)))
    scored = _scores(blocks, model, work).select(
        F.when(F.col("flags").bitwiseAND(NO_ID) == 0, F.col("id")).alias("doc_id"),
        (F.col("flags").bitwiseAND(SKIPPED) != 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * constant).alias("base_score"),
        "score",
    )
    scored = _stored(scored, scratch_path(spark, "katz-scored"))
    discard(spark, work)
    return scored
