"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are 64 bits over XXH64 of word shingles. Documents with equal
fingerprints collapse first, by one aggregation. Two fingerprints that differ
in at most 2 bits agree in at least two of four 16-bit blocks, so each one is
filed under its six pairs of blocks and joined with those filed under the same
32 bits; the Hamming distance is then verified.

A file with more than ``FILE_ROWS`` fingerprints isn't paired. Its members
differ in the other 32 bits only, and two of them lie within 2 bits exactly if
they have a common neighbour within 1 bit. So each is filed anew under itself
and its 32 one-bit neighbours there; all members of such a file are linked to
its smallest. A file of different fingerprints has 33 members at most. That is
exact as well, and the work stays in proportion to the rows.

Edge cases: a NULL or empty text has fingerprint zero, which links like any
other. Rows with a NULL doc_id take part; the component's id is the smallest
id there is, NULL if there is none. Repeated rows get the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseg.functions.columns import quoted
from flowseg.functions.tables import materialize
from flowseg.llm.common import fresh, text_key
from flowseg.llm.components import components

DISTANCE = 2
FILE_ROWS = 64
SEED = 42
_PIECE = 1 << 15
_BLOCKS = [(0xFFFF << s) - (1 << 64 if s == 48 else 0) for s in (0, 16, 32, 48)]
_PAIRS = [(i, j) for i in range(4) for j in range(i)]


def shingles(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, in pieces; of a shorter text, that of all its words; none of a text without words."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _PIECE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _PIECE], ends[i : i + _PIECE])], dtype="<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingles(text, width):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(text: str) -> Column:
    """Fingerprints of a text column, as signed 64-bit integers."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64))

    return made(F.col(text))


def links(prints: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``DISTANCE``; ``prints`` has different values ``f``."""
    filed = prints.select(
        "f",
        F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(_BLOCKS[i] | _BLOCKS[j])) for i, j in _PAIRS])).alias("p", "k"),
    )
    sizes = filed.groupBy("p", "k").agg(F.count("*").alias("n")).filter("n > 1")
    filed = materialize(filed.join(sizes, ["p", "k"]))
    small = filed.filter(F.col("n") <= file_rows).select("p", "k", "f")
    paired = (
        small.withColumnRenamed("f", "a")
        .join(small.withColumnRenamed("f", "b"), ["p", "k"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
        .select("a", "b")
    )
    flips = []
    for i, j in _PAIRS:
        bits = [b for b in range(64) if b // 16 not in (i, j)]
        flips.append(F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in bits]))
    near = (
        filed.filter(F.col("n") > file_rows)
        .select("p", "f", F.explode(F.element_at(F.array(*flips), F.col("p") + 1)).alias("bit"))
        .select("p", "f", F.col("f").bitwiseXOR(F.col("bit")).alias("z"))
    )
    least = near.groupBy("p", "z").agg(F.min("f").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = near.join(least, ["p", "z"]).filter("a != f").select("a", F.col("f").alias("b"))
    met = met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return paired.unionByName(met).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    rows = materialize(docs.select("doc_id", fingerprints("text").alias("f")))
    firsts = materialize(rows.groupBy("f").agg(F.min("doc_id").alias("first")))
    roots = _with_root(firsts)
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(roots.join(least, "root").select("f", "component_id"))
    return rows.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def _with_root(firsts: DataFrame) -> DataFrame:
    """``firsts`` (one row a fingerprint ``f``) with the root of its class, itself if it has no link."""
    found = components(links(firsts.select("f"))).withColumnRenamed("node", "f")
    return firsts.join(found, "f", "left").withColumn("root", F.coalesce("root", "f"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class: that with the smallest doc_id (a NULL id last), then the smallest hash of its text.

    Of repeated rows with that id and text, one stays. Groups are worked out on
    ids and hashes, and rows without a partner leave before the last joins; only
    the join with the rows to drop meets the texts.
    """
    key, again = fresh(docs, "_key", "_n")
    mark = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_key(F.col("text")).alias("text"))
    rows = materialize(docs.select(F.col("doc_id").alias("d"), mark.alias("m"), fingerprints("text").alias("f")))
    first = F.min(F.struct(F.col("d").isNull(), "d", "m")).alias("first")
    roots = _with_root(materialize(rows.groupBy("f").agg(first, F.count("*").alias("n"))))
    groups = roots.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("n")).filter("n > 1").select("root", "best")
    named = materialize(roots.join(groups, "root").select("f", F.col("best.m").alias("kept")))
    judged = materialize(rows.join(named, "f").select(F.col("m").alias(key), (F.col("m") == F.col("kept")).alias("stays")))
    keyed = docs.withColumn(key, mark)
    # the rows to drop grow with the input: the same join at every size, texts dealt once by their key
    out = keyed.join(judged.filter("NOT stays").select(key).hint("merge"), key, "left_anti")
    repeated = materialize(judged.filter("stays").groupBy(key).agg(F.count("*").alias(again)).filter(F.col(again) > 1).select(key))
    if not repeated.isEmpty():
        out = out.join(repeated, key, "left_anti").unionByName(out.join(repeated, key, "left_semi").dropDuplicates([key]))
    return out.select(*[quoted(c) for c in docs.columns])
