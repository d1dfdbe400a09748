"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that can end
its encoding: the token t for which the encoding of what precedes t ends in a
token that may stand before t. Two tokens may stand side by side if merging
their bytes in rank order gives just the two. So a table with the last token
of each prefix is filled from left to right and read back from the end. The
table of a longer text starts with the table of the shorter one, so appending
is exact, and after an edit the table is filled anew only until it agrees with
the old one over the longest token's length (``PrefixTable``).

Edge cases: a NULL text is the empty text, which has no tokens, the SHA-256 of
nothing, and decodes to nothing. Pieces of any length take time in proportion.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_PIECES = 600_000
CACHED_LENGTH = 48
CACHED_PAIRS = 1_000
PORTION = 4_000_000  #: characters whose pieces are held at a time
NO_RANK = 1 << 40
PLAIN = 0x250  #: texts of smaller characters are split by the standard library's faster engine


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def parts_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes ``token``; None if merging its bytes doesn't end in it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        merges = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        best = min(merges)
        if best >= ranks[token]:
            return None
        at = merges.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Vocabulary:
    """Tokens with what the tables need: suffixes of tokens, and the tokens at the inner borders."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        #: by the tokens that BPE itself makes: those ending and those starting it, each with the rank that absorbs it
        self.ends: list[list[tuple[bytes, int]] | None] = [None] * len(tokens)
        self.starts: list[list[tuple[bytes, int]] | None] = [None] * len(tokens)
        self.suffixes: dict[bytes, int] = {}
        for t in sorted(tokens, key=len):
            i = self.ranks[t]
            if len(t) == 1:
                self.ends[i] = self.starts[i] = [(t, NO_RANK)]
            elif (two := parts_of(t, self.ranks)) is not None:
                a, b = (self.ranks[x] for x in two)
                if self.ends[b] is None or self.starts[a] is None:
                    continue
                self.ends[i] = [(t, NO_RANK), *((x, min(r, i)) for x, r in self.ends[b])]
                self.starts[i] = [(t, NO_RANK), *((x, min(r, i)) for x, r in self.starts[a])]
            else:
                continue
            for k in range(len(t) - 1):
                self.suffixes.setdefault(t[k + 1 :], -1)
            self.suffixes[t] = i
        self.known: list[dict[int, bool]] = [{} for _ in tokens]

    def fits(self, a: int, b: int) -> bool:
        """Whether a may stand before b: no merge across the border comes before both are whole.

        Of two equal merges that overlap the left one is made, hence ``<`` on the left and ``<=`` on the right.
        """
        got, ranks = True, self.ranks
        for x, absorbed in self.ends[a]:
            for y, taken in self.starts[b]:
                m = ranks.get(x + y, NO_RANK)
                if m < absorbed and m <= taken:
                    got = False
        if len(self.known[a]) >= CACHED_PAIRS:
            self.known[a].clear()
        self.known[a][b] = got
        return got

    def fill(self, data: bytes, table: list[int], until: int) -> None:
        """Extends the table by the one token that ends each prefix, up to ``data[:until]``."""
        token_of, known = self.suffixes.get, self.known
        for end in range(len(table) + 1, until + 1):
            start = end - 1
            while True:
                token = token_of(data[start:end])
                if token is None:
                    raise ValueError("no token ends this prefix")
                if token >= 0:
                    if not start:
                        break
                    before = table[start - 1]
                    good = known[before].get(token)
                    if good or good is None and self.fits(before, token):
                        break
                start -= 1
            table.append(token)

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token itself is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        table: list[int] = []
        self.fill(data, table, len(data))
        return self.read_back(table)

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of pieces in order; each starts with the table of what it shares with the one before."""
        before, table = b"", []
        for data in pieces:
            whole = self.ranks.get(data)
            if whole is not None:
                yield [whole]
                continue
            same, most = 0, min(len(before), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            del table[same:]
            self.fill(data, table, len(data))
            before = data
            yield self.read_back(table)

    def read_back(self, table: list[int]) -> list[int]:
        ids, end = [], len(table)
        while end:
            ids.append(table[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]


class PrefixTable:
    """The table of one piece, kept for appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the table so far stays."""
        self.data += more
        self.vocabulary.fill(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` for ``data[start:end]``; returns how many prefixes were worked out anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same, done = old[:start], 0, 0
        changed_until = start + len(new)
        while len(self.last) < len(self.data):
            at = len(self.last)
            self.vocabulary.fill(self.data, self.last, at + 1)
            done += 1
            same = same + 1 if at >= changed_until and self.last[at] == old[at - shift] else 0
            if same >= self.vocabulary.longest:
                self.last += old[at - shift + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return [whole] if whole is not None else self.vocabulary.read_back(self.last)


def _ranges(belongs) -> str:
    """The characters below ``PLAIN`` that belong, as ranges for a character class."""
    out, first = "", None
    for i in range(PLAIN + 1):
        inside = i < PLAIN and belongs(chr(i))
        if inside and first is None:
            first = i
        elif not inside and first is not None:
            out, first = out + f"\\u{first:04x}-\\u{i - 1:04x}", None
    return out


def plain_pattern(pattern: str) -> re.Pattern:
    r"""The pattern for texts of characters below ``PLAIN``, with \p{L}, \p{N}, \s and \S written as ranges."""
    ranges = {r"\p{L}": _ranges(lambda c: unicodedata.category(c)[0] == "L"), r"\p{N}": _ranges(lambda c: unicodedata.category(c)[0] == "N")}
    blank = regex.compile(r"\s")
    ranges[r"\s"] = _ranges(lambda c: blank.match(c) is not None)
    ranges[r"\S"] = _ranges(lambda c: blank.match(c) is None)
    out, inside = "", False
    for part in re.findall(r"\\p\{.\}|\\.|.", pattern, re.S):
        inside = part == "[" or inside and part != "]"
        out += part if part not in ranges else ranges[part] if inside else f"[{ranges[part]}]"
    return re.compile(out)


class Tokenizer:
    """Splits text by a pattern and encodes every match on its own; keeps the ids of pieces met so far, up to a bound."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.vocabulary = Vocabulary(tokens)
        self.pattern, self.plain = regex.compile(pattern), plain_pattern(pattern)
        self.beyond = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. New pieces of all texts are worked out in order."""
        split = [(self.pattern if self.beyond.search(t) else self.plain).findall(t) for t in texts]
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        pieces = self.pieces
        new = sorted({p.encode() for p in set().union(*split) if p not in pieces})
        for data, ids in zip(new, self.vocabulary.encode_sorted(new)):
            pieces[data.decode()] = struct.pack(f"<{len(ids)}I", *ids)
        for parts in split:
            yield b"".join([pieces[p] for p in parts])
        for data in new:
            if len(data) > CACHED_LENGTH:
                del pieces[data.decode()]

    def decode(self, packed: bytes) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


def portions(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in lists of about ``PORTION`` characters; a longer text is a list of its own."""
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= PORTION:
            yield some
            some, size = [], 0
    if some:
        yield some


_loaded: dict[str, Tokenizer] = {}


def tokenizer(tokens: list[bytes], pattern: str) -> Tokenizer:
    """One tokenizer in each worker process, so that its pieces serve later tasks too."""
    key = hashlib.sha256(b"\0".join([pattern.encode(), *tokens])).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(tokens, pattern)
    return _loaded[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", name: str = "bpe", digests: bool = True) -> DataFrame:
    """Adds a struct ``name``: n_tokens, and ids with the text decoded from them, as digests or in full.

    In full: ``ids`` (binary, little-endian 32-bit) and ``decoded`` (string).
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file, about 1 MB

    def coded(texts: pd.Series) -> Iterator[tuple[int, bytes, bytes]]:
        coder = tokenizer(sent.value, pattern)
        for some in portions(texts):
            for packed in coder.encode(some):
                yield len(packed) // 4, packed, coder.decode(packed)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = [(n, hashlib.sha256(p).hexdigest(), hashlib.sha256(d).hexdigest()) for n, p, d in coded(texts)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    @F.pandas_udf("n_tokens long, ids binary, decoded string")
    def full(texts: pd.Series) -> pd.DataFrame:
        rows = [(n, p, d.decode()) for n, p, d in coded(texts)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded"])

    return docs.withColumn(name, (digest if digests else full)(F.col(text)))
