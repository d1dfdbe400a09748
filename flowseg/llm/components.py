"""Connected components of a graph given by edges, in a few rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize

CHUNK = 200_000  #: edges that a task contracts at a time


def _contracted(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The components of these edges as stars: every node but the smallest, tied to the smallest."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        for end in (i, j, label[i], label[j]):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    tied = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[label[tied]], "b": nodes[tied]})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contracts the edges of a task, in chunks of bounded size."""
    held, n = [], 0
    for edges in batches:
        held.append(edges)
        n += len(edges)
        if n >= CHUNK:
            yield _contracted(*(np.concatenate([e[c].to_numpy() for e in held]) for c in "ab"))
            held, n = [], 0
    if n:
        yield _contracted(*(np.concatenate([e[c].to_numpy() for e in held]) for c in "ab"))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours to the smallest node next to them: the larger ones, or the smaller ones with the node itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # every edge is met at its smaller end, where the larger end is the neighbour to tie
        return edges.join(least, "a").select(F.col("m").alias("a"), "b").distinct()
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of the edges (a, b).

    Nodes are 64-bit integers. Alternates large and small stars until every edge
    leads from a root to a node; the number of rounds is logarithmic in the
    longest path. Before each round, tasks contract what they hold, which
    shortens the paths without a shuffle. Each round is written to the shared folder. The joined side has one row a node, so a
    node with many edges is a skewed left side that Spark can split.
    """
    now = materialize(
        edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
        now = materialize(_stars(_stars(now.mapInPandas(_contract, now.schema), True), False))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
