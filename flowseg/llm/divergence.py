"""How far the sources of a language differ in their terms, in whole numbers, from Arrow kernels.

Terms are counted where the texts are: in ``mapInArrow``, each batch goes through
``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and a hash
``group_by``, first by text, which gives the texts a term is in, then by language and
source. A task keeps merging its counts and hands them on when there are more than
``HELD_ROWS`` of them, so what is shuffled are partial counts, not terms. They are
merged by key; terms in fewer than ``least_docs`` texts of their language go.

What is left is dealt by hash of the term into shards of about ``SHARD_ROWS`` counts,
with all sources of the language beside each. A shard is a matrix of sources by terms,
gone through in runs of terms of at most ``CELLS`` cells; it gives its share of every
pair's divergence and its own best terms of every source. Shares add up, best terms compete. So neither a frequent term nor a large source fills
a task: a shard holds one count a term and source at most.

With V kept terms, N occurrences of them and a count c, p = 1 + floor(10^9 (c + 1) / (N + V));
the difference of p to q is floor((p - q)^2 / q).

Edge cases: NULL text, language and source are ''. A group without kept terms has its
pairs, with the values that counts of 0 give. Repeated rows count as often as they are
there; ids aren't looked at. Texts are taken whole: a batch is cut between texts only,
and a text longer than ``BATCH_BYTES`` is a batch of its own. Ties go to the smaller item
in UTF-8. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowseg.functions.tables import lookup_join, materialize

# What separates terms, the unit of p, and how many terms are reported.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
TOP_TERMS = 200

LEAST_DOCS = 3
BATCH_BYTES = 4 << 20
HELD_ROWS = 400_000
SHARD_ROWS = 200_000
CELLS = 1 << 19  # of sources by terms, held at a time
_COUNTS = "lang string, source string, term string, n long, docs long"
_PART = "lang string, source string, part string, item string, value long"
_KEYS = ["lang", "source", "term"]


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most`` bytes of text, of one row at least.

    Rows are taken, not sliced: a slice that is cast keeps its first offset, which ``ascii_lower`` doesn't look at.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.take(pa.array(np.arange(at, end)))
        at = end


def _terms(batch: pa.RecordBatch) -> pa.Table:
    """Counts by language, source and term, and the number of texts with the term. Each group has a row for the empty term."""
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text").cast(pa.large_string())), SEPARATORS)
    words = pc.list_flatten(lists).dictionary_encode()
    by_text = pa.table({"row": pc.list_parent_indices(lists), "code": words.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    found = pa.table({"group": group[by_text["row"].to_numpy()], "code": by_text["code"], "n": by_text["count_all"]})
    counts = found.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])

    def named(groups: np.ndarray, terms: pa.Array, n: pa.Array, docs: pa.Array) -> pa.Table:
        lang, source = (d.dictionary.take(pa.array(i)).cast(pa.string()) for d, i in ((langs, groups // len(sources.dictionary)), (sources, groups % len(sources.dictionary))))
        return pa.table({"lang": lang, "source": source, "term": terms, "n": n, "docs": docs})

    terms = named(counts["group"].to_numpy(), words.dictionary.take(counts["code"].combine_chunks()).cast(pa.string()), counts["n_sum"], counts["n_count"])
    every = np.unique(group)
    zeros = pa.array(np.zeros(len(every), dtype=np.int64))
    seen = named(every, pa.array([""] * len(every), type=pa.string()), zeros, zeros)
    return pa.concat_tables([terms.filter(pc.not_equal(terms["term"], "")), seen])


def _merged(tables: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return table.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch], batch_bytes: int, held_rows: int) -> Iterator[pa.RecordBatch]:
    """A task's counts by language, source and term."""
    held: list[pa.Table] = []
    for batch in batches:
        for piece in _pieces(batch, batch_bytes):
            held.append(_terms(piece))
            if sum(len(t) for t in held) > held_rows:
                held = [_merged(held)]
                if len(held[0]) > held_rows // 2:
                    yield from held.pop().to_batches(max_chunksize=65_536)
    if held:
        yield from _merged(held).to_batches(max_chunksize=65_536)


def term_counts(docs: DataFrame, batch_bytes: int = BATCH_BYTES, held_rows: int = HELD_ROWS) -> DataFrame:
    """lang, source, term, n (occurrences), docs (texts): merged, a row for each; '' as term marks a group that is there."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    partial = docs.select(*text.values()).mapInArrow(lambda batches: _counted(batches, batch_bytes, held_rows), _COUNTS)
    return materialize(partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _scaled(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT (c + 1) / total), exactly."""
    safe = counts < 2**63 // UNIT - 2
    out = 1 + UNIT * (np.where(safe, counts, 0) + 1) // total
    for at in np.argwhere(~safe):
        out[tuple(at)] = 1 + UNIT * (int(counts[tuple(at)]) + 1) // total
    return out


def _shard(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
    """One shard of a language: its share of each pair of sources, and its best terms of each source."""
    sources = groups["source"].to_pylist()
    totals, vocabulary = groups["total"].to_pylist(), groups["vocabulary"][0].as_py()
    place = {s: i for i, s in enumerate(sources)}
    words = entries["term"].combine_chunks().dictionary_encode()
    codes = words.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    rows, codes = np.array([place[s] for s in entries["source"].to_pylist()], dtype=np.int64)[order], codes[order]
    n = entries["n"].to_numpy()[order]
    shares = [[0] * len(sources) for _ in sources]
    best: list[list[tuple[int, str]]] = [[] for _ in sources]
    width = max(1, CELLS // len(sources))
    for start in range(0, len(words.dictionary), width):
        terms = words.dictionary.slice(start, width)
        own = slice(*np.searchsorted(codes, [start, start + len(terms)]).tolist())
        counts = np.zeros((len(sources), len(terms)), dtype=np.int64)
        counts[rows[own], codes[own] - start] = n[own]
        p = np.ones_like(counts)
        whole = np.ones((1, len(terms)), dtype=np.int64)
        if vocabulary:
            whole = _scaled(counts.sum(axis=0, keepdims=True), sum(totals) + vocabulary)
            p = np.concatenate([_scaled(counts[i : i + 1], totals[i] + vocabulary) for i in range(len(sources))])
        for i in range(len(sources)):
            shares[i] = [u + v for u, v in zip(shares[i], ((p[i] - p) ** 2 // p).sum(axis=1).tolist())]
            more = np.flatnonzero((counts[i] > 0) & (p[i] > whole[0]))
            value = (p[i, more] - whole[0, more]) ** 2 // whole[0, more]
            best[i] += zip(value.tolist(), terms.take(pa.array(more)).to_pylist())
            if len(best[i]) > TOP_TERMS:
                least = sorted((v for v, _ in best[i]), reverse=True)[TOP_TERMS - 1]
                best[i] = [x for x in best[i] if x[0] >= least]
    out: list[tuple[str, str, str, int]] = []
    for i, source in enumerate(sources):
        out += [(source, "pair", other, v) for j, (other, v) in enumerate(zip(sources, shares[i])) if j != i]
        out += [(source, "term", t, v) for v, t in best[i]]
    columns = list(zip(*out)) or [(), (), (), ()]
    names = ("source", "part", "item")
    made = {n: pa.array(c, type=pa.string()) for n, c in zip(names, columns)} | {"value": pa.array(columns[3], type=pa.int64())}
    return pa.table({"lang": pa.array([groups["lang"][0].as_py()] * len(out), type=pa.string())} | made)


def divergences(counts: DataFrame, least_docs: int = LEAST_DOCS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank from ``term_counts``."""
    terms = counts.filter("term != ''")
    known = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term")
    kept = materialize(terms.join(known, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    spread = kept.groupBy("lang").agg(F.count("*").alias("rows"))
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("vocabulary"))
    langs = materialize(
        spread.join(vocabulary, "lang").select("lang", "rows", "vocabulary", F.ceil(F.col("rows") / shard_rows).cast("int").alias("shards"))
    )
    groups = counts.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    beside = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"),
        F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("shard"),
    )
    dealt = lookup_join(kept, langs, "lang", "rows").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    found = materialize(dealt.groupBy("lang", "shard").cogroup(beside.groupBy("lang", "shard")).applyInArrow(_shard, _PART))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    top = found.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(top)


def audit(docs: DataFrame) -> DataFrame:
    """Divergence between the sources of each language, and of each source's terms from its language."""
    return divergences(term_counts(docs))
