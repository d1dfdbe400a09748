"""Exact top-k by inner product with a vector-approximation file.

Vectors of integers get a second, smaller table in which each component is one
of ``CELLS`` cells of its dimension's range. A cell bounds its component from
both sides, so a scan of the cells bounds every score. In each task a vector
is passed on only if its upper bound reaches the k-th best lower bound met so
far; over all tasks, only if it reaches the k-th best lower bound of all. Exact
vectors are then read in order of their bounds in two rounds: the first few
of each query, and after that every vector whose bound reaches the k-th exact
score found. What is left out can't be among the k best.

Equal vectors are one row of both tables, with their k + 1 smallest ids: no more
of them can be in a result. Queries are taken in blocks of at most
``QUERY_BLOCK`` different vectors, which are sent to the scanning tasks.

Edge cases: vectors that are NULL or hold NULL or non-finite components take no
part, neither as queries nor as candidates; nor do rows with a NULL id.
Only vectors of a query's length are its candidates. Repeated rows of one id
and vector are one candidate, and a query once; a query's own id is never its
candidate. Ties go to the smaller id. Bounds are doubles, widened by what rounding
may have taken from them where scores may pass 2**51. Where scores may pass 2**62, exact
ones are worked out in integers of any size; only a result that doesn't fit
64 bits is an error, as is a component beyond 2**56.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize

CELLS = 64
QUERY_BLOCK = 4_096
FIRST_ROUND = 16
CHUNK = 2_000_000  #: bounds held at a time in a task
SALTS = 16  #: shares of a query's rows that are ranked apart
LARGEST = 1 << 56  #: a component; 2**14 products of two of them fit 38 digits


def integer_vectors(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, vec: floor(scale * x) of every component, for vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    large = F.raise_error(F.lit("a component is too large for exact scores")).cast("long")
    floor = F.transform(x, lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale).cast("long")).otherwise(large))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable & F.col("vec_id").isNotNull(), floor).alias("vec")).filter(
        "vec IS NOT NULL AND vec_id IS NOT NULL"
    )


def different_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """One row a vector: ``v`` (its smallest id), ``ids`` (the ``keep`` smallest, ascending), vec, dim."""
    number = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    few = vectors.distinct().withColumn("n", number).filter(F.col("n") <= keep)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("v"), "ids", "vec", F.size("vec").alias("dim"))


def _cells(vectors: DataFrame) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The approximations (v, dim, cells) and, by length, each dimension's lower end and cell width."""
    ends = (
        vectors.select("dim", F.posexplode("vec").alias("i", "x")).groupBy("dim", "i").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    )
    grids: dict[int, tuple[np.ndarray, np.ndarray]] = {r["dim"]: (np.zeros(r["dim"], np.int64), np.ones(r["dim"], np.int64)) for r in ends}
    for r in ends:
        grids[r["dim"]][0][r["i"]] = r["low"]
        grids[r["dim"]][1][r["i"]] = (r["high"] - r["low"]) // CELLS + 1
    for r in vectors.select("dim").distinct().collect():
        grids.setdefault(r["dim"], (np.zeros(0, np.int64), np.ones(0, np.int64)))

    @F.pandas_udf("binary")
    def quantised(vecs: pd.Series) -> pd.Series:
        return pd.Series([((v - grids[len(v)][0]) // grids[len(v)][1]).astype(np.uint8).tobytes() for v in vecs])

    return vectors.select("v", "dim", quantised("vec").alias("cells")), grids


def _largest_score(low: np.ndarray, width: np.ndarray) -> int:
    """A bound of every score's size, and of that of the terms it is made of."""
    return sum(max(abs(a), abs(a + CELLS * w)) ** 2 for a, w in zip(low.tolist(), width.tolist()))


def _bounds(cells: DataFrame, grids: dict, sent, dim: int, k: int) -> DataFrame:
    """(q, v, lower, upper) that may be among a query's k best, judged by what the task has met so far."""
    low, width = grids[dim]
    largest = _largest_score(low, width)
    exact = largest < 1 << 51  # up to 3 of them add up
    slack = 0.0 if exact else float(largest) * (dim + 8) * 2.0**-50
    if not exact:
        low, width = low.astype(np.float64), width.astype(np.float64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, queries = sent.value
        if not exact:
            queries = queries.astype(np.float64)
        base = (queries @ low).astype(np.float64)
        weights = (queries * width).astype(np.float64)
        below = np.minimum(queries, 0) @ (width - 1) - slack
        above = np.maximum(queries, 0) @ (width - 1) + slack
        kth = np.full(len(names), -np.inf)
        tops = np.full((len(names), k), -np.inf)
        step = max(1, CHUNK // max(1, len(names)))
        for rows in batches:
            for at in range(0, len(rows), step):
                part = rows.iloc[at : at + step]
                codes = np.frombuffer(b"".join(part["cells"]), dtype=np.uint8).reshape(len(part), dim).astype(np.float64)
                scores = weights @ codes.T + base[:, None]
                best = np.sort(scores, axis=1)[:, ::-1][:, :k] if scores.shape[1] <= k else -np.partition(-scores, k - 1, axis=1)[:, :k]
                tops = -np.sort(-np.concatenate((tops, best + below[:, None]), axis=1), axis=1)[:, :k]
                kth = tops[:, k - 1]
                q, i = np.nonzero(scores + above[:, None] >= kth[:, None])
                score = scores[q, i]
                yield pd.DataFrame({"q": names[q], "v": part["v"].to_numpy()[i], "lower": score + below[q], "upper": score + above[q]})

    return cells.select("v", "cells").mapInPandas(scan, "q long, v long, lower double, upper double")


def _exact(pairs: DataFrame, vectors: DataFrame, sent, wide: bool) -> DataFrame:
    """(q, v, ids, score) of the pairs, from the exact vectors; ``wide`` scores are decimals."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, queries = sent.value
        order = np.argsort(names)
        for rows in batches:
            if len(rows):
                q = order[np.searchsorted(names, rows["q"].to_numpy(), sorter=order)]
                exact = np.stack(rows["vec"].to_list()) if len(rows["vec"].iloc[0]) else np.zeros((len(rows), 0), np.int64)
                if wide:
                    scores = [Decimal(sum(a * b for a, b in zip(x, y))) for x, y in zip(queries[q].tolist(), exact.tolist())]
                else:
                    scores = (queries[q] * exact).sum(axis=1)
                yield pd.DataFrame({"q": rows["q"], "v": rows["v"], "ids": rows["ids"], "score": scores})

    joined = pairs.select("q", "v").join(vectors.select("v", "ids", "vec"), "v").select("q", "v", "ids", "vec")
    return joined.mapInPandas(score, f"q long, v long, ids array<long>, score {'decimal(38,0)' if wide else 'long'}")


def _best(rows: DataFrame, by: Column, n: int) -> DataFrame:
    """The n best rows of each query: of shares of its rows first, so that no task meets them all."""
    for group in (["q", F.pmod(F.xxhash64("v"), F.lit(SALTS))], ["q"]):
        number = F.row_number().over(W.partitionBy(*group).orderBy(by.desc(), "v"))
        rows = rows.withColumn("_n", number).filter(F.col("_n") <= n).drop("_n")
    return rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for every query.

    ``vectors`` has vec_id and vec as from ``integer_vectors``; ``queries`` are some of its rows.
    """
    spark = vectors.sparkSession
    n = k + 1  # the query's own vector counts here and is taken out at the end
    different = materialize(different_vectors(vectors, n))
    cells, grids = _cells(different)
    cells = materialize(cells)
    asked = materialize(queries.select("vec_id", "vec").distinct().join(different.select("vec", "v", "dim"), "vec").select("vec_id", "v", "dim"))
    wanted = asked.select("v", "dim").distinct().join(different.select("v", "vec"), "v")
    wanted = materialize(wanted.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(2**31 - 1))))
    wide = any(_largest_score(*grid) >= 1 << 62 for grid in grids.values())
    found = None
    for dim, count in sorted((r["dim"], r["count"]) for r in wanted.groupBy("dim").count().collect()):
        blocks = -(-2 * count // query_block) if count > query_block else 1
        own = different.filter(F.col("dim") == dim)
        for b in range(blocks):
            block = wanted.filter((F.col("dim") == dim) & (F.col("part") % blocks == b)).select("v", "vec").collect()  # QUERY_BLOCK at most
            if not block:
                continue
            names = np.array([r["v"] for r in block], dtype=np.int64)
            sent = spark.sparkContext.broadcast((names, np.array([r["vec"] for r in block], dtype=np.int64).reshape(len(block), dim)))
            bounds = materialize(_bounds(cells.filter(F.col("dim") == dim), grids, sent, dim, n))
            # one row a query of the block, so QUERY_BLOCK at most are broadcast
            floor = _best(bounds, F.col("lower"), n).groupBy("q").agg(F.when(F.count("*") >= n, F.min("lower")).alias("floor"))
            left = bounds.join(F.broadcast(floor), "q").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
            left = materialize(left.select("q", "v", "upper"))
            heads = materialize(_best(left, F.col("upper"), FIRST_ROUND))
            first = materialize(_exact(heads, own, sent, wide))
            certain = _best(first, F.col("score"), n).groupBy("q").agg(F.when(F.count("*") >= n, F.min("score")).alias("floor"))
            place = F.struct("upper", -F.col("v"))  # the order of the first round, backwards
            limits = heads.groupBy("q").agg(F.min(place).alias("last")).join(certain, "q")
            rest = left.join(F.broadcast(limits), "q").filter((place < F.col("last")) & (F.col("floor").isNull() | (F.col("upper") >= F.col("floor").cast("double"))))
            part = first.unionByName(_exact(rest, own, sent, wide))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.range(0).selectExpr("id AS query_id", "CAST(NULL AS int) AS rank", "id AS vec_id", "id AS score")
    # ties between different vectors go by id, so ids are ranked, n of each query and vector at most
    ids = materialize(_best(found.select("q", F.explode("ids").alias("v"), "score"), F.col("score"), n))
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(ids, "q").filter("v <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "v"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("v").alias("vec_id"), F.col("score").cast("long").alias("score"))
