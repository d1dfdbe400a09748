"""Exact minimum spanning trees under the Chebyshev distance.

Edges are compared by (weight, smaller node, larger node). That order is total,
so the tree is unique and every step below is deterministic.

Groups that fit one task are done there. Larger ones go by dual-tree Boruvka over
the tree of cuts (``blocks``):

1. In its task, a block contracts what it can answer for: a component whose
   lightest edge inside the block is shorter than its way to the region's faces
   takes that edge, since nothing outside the block is as near.
2. In rounds, each component but the group's largest takes its lightest edge to another
   one. What is left of the blocks' own trees, and of trees across neighbouring
   blocks, bounds it: every component has its own radius. Only tiles within that
   radius are asked (``tiles``). Components that took edges merge.

An edge that is the lightest one out of some component belongs to the tree, so the
largest may wait: the others halve their number in a round, and their vectors alone search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseg.functions.tables import follow_pointers, materialize, with_row_index
from flowseg.operators.blocks import BLOCK, cut_space, tasks
from flowseg.operators.tiles import lightest_edges, with_tiles

TASK_ROWS = 500_000  # edges or nodes that one task may hold
EDGE_SCHEMA = "g string, a long, b long, w double"
_LOCAL_SCHEMA = "g string, blk long, node long, arr array<double>, c long, ext double, a long, b long, w double, taken boolean"
_CHAIN_SCHEMA = "g string, a long, b long, w double"


def distinct_vectors(points: DataFrame) -> DataFrame:
    """``(g, arr, mult, node)``: one row per vector and group, numbered in sorted order.

    Copies of a vector are linked by edges of weight 0, so one of them stands for all.
    """
    distinct = points.groupBy("g", "arr").agg(F.count(F.lit(1)).alias("mult"))
    return with_row_index(distinct, "g", "arr", name="node")


def _tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree edges (i, j, w) of the rows of ``x``; ties go to the smaller index pair."""
    n = len(x)
    rest = np.arange(1, n)  # vertices outside the tree, in the first m places
    coords = np.ascontiguousarray(x[1:].T)
    weight = np.full(n - 1, np.inf)
    pair = np.full(n - 1, np.iinfo(np.int64).max)
    source = np.zeros(n - 1, dtype=np.int64)
    starts, ends = np.zeros(n - 1, dtype=np.int64), np.zeros(n - 1, dtype=np.int64)
    weights = np.zeros(n - 1)
    here, at = 0, x[0]
    for m in range(n - 1, 0, -1):
        dist = np.abs(coords[:, :m] - at[:, None]).max(axis=0)
        code = np.minimum(rest[:m], here) * n + np.maximum(rest[:m], here)
        closer = (dist < weight[:m]) | ((dist == weight[:m]) & (code < pair[:m]))
        weight[:m][closer], pair[:m][closer], source[:m][closer] = dist[closer], code[closer], here
        tied = np.flatnonzero(weight[:m] == weight[:m].min())
        j = tied[np.argmin(pair[tied])]
        step = n - 1 - m
        starts[step], ends[step], weights[step] = source[j], rest[j], weight[j]
        here, at = rest[j], coords[:, j].copy()
        last = m - 1
        for column in (rest, weight, pair, source):
            column[j] = column[last]
        coords[:, j] = coords[:, last]
    return starts, ends, weights


def _within(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tree of one block."""
    pdf = pdf.sort_values("node", ignore_index=True)
    nodes = pdf["node"].to_numpy()
    i, j, w = _tree(np.stack(pdf["arr"].to_numpy()))
    return pd.DataFrame(
        {"g": pdf["g"].iloc[0], "a": nodes[np.minimum(i, j)], "b": nodes[np.maximum(i, j)], "w": w},
        columns=["g", "a", "b", "w"],
    )


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges between two neighbouring blocks that belong to their common tree."""
    pdf = pdf.sort_values("node", ignore_index=True)
    nodes, blocks = pdf["node"].to_numpy(), pdf["blk"].to_numpy()
    i, j, w = _tree(np.stack(pdf["arr"].to_numpy()))
    across = blocks[i] != blocks[j]
    i, j, w = i[across], j[across], w[across]
    return pd.DataFrame({"g": pdf["g"].iloc[0], "a": nodes[np.minimum(i, j)], "b": nodes[np.maximum(i, j)], "w": w}, columns=["g", "a", "b", "w"])


def _roots(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The smallest member of the component of each of ``n`` nodes."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for u, v in pairs:
        u, v = find(u), find(v)
        root[max(u, v)] = min(u, v)
    return np.array([find(v) for v in range(n)], dtype=np.int64)


def _contracted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's vectors with their components, its tree's edges with whether they are taken, side by side.

    ``ext`` is the least way of a vector out of the block's region.
    """
    pdf = pdf.sort_values("node", ignore_index=True)
    nodes, x = pdf["node"].to_numpy(), np.stack(pdf["arr"].to_numpy())
    ext = np.minimum(x - np.asarray(pdf["rlow"].iloc[0]), np.asarray(pdf["rhigh"].iloc[0]) - x).min(axis=1)
    i, j, w = _tree(x)
    i, j = np.minimum(i, j), np.maximum(i, j)
    order = np.lexsort((j, i, w))
    i, j, w = i[order], j[order], w[order]
    m, comp, taken = len(w), np.arange(len(nodes)), np.zeros(len(w), dtype=bool)
    while m:
        reach = np.full(len(nodes), np.inf)
        np.minimum.at(reach, comp, ext)
        first = np.full(len(nodes), m)
        alive = np.flatnonzero(comp[i] != comp[j])  # edges in order, so their places rank them
        np.minimum.at(first, comp[i[alive]], alive)
        np.minimum.at(first, comp[j[alive]], alive)
        known = np.flatnonzero(first < m)
        sure = np.unique(first[known[w[first[known]] < reach[known]]])
        if not len(sure):
            break
        taken[sure] = True
        comp = _roots(len(nodes), list(zip(comp[i[sure]].tolist(), comp[j[sure]].tolist())))[comp]
    out = pdf[["g", "blk", "node", "arr"]].assign(c=nodes[comp], ext=ext)
    edges = pd.DataFrame({"a": pd.array(nodes[i], dtype="Int64"), "b": pd.array(nodes[j], dtype="Int64"), "w": w, "taken": pd.array(taken, dtype="boolean")})
    return pd.concat([out, edges], axis=1)[[c.split()[0] for c in _LOCAL_SCHEMA.split(", ")]]


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components (c, root) of a group's picks (c, to)."""
    names, flat = np.unique(pdf[["c", "to"]].to_numpy().ravel(), return_inverse=True)
    roots = _roots(len(names), list(map(tuple, flat.reshape(-1, 2).tolist())))
    return pd.DataFrame({"g": pdf["g"].iloc[0], "c": names, "root": names[roots]}, columns=["g", "c", "root"])


def _merge(picks: DataFrame, rows: int) -> DataFrame:
    """(g, c, root) for every component; groups of up to ``rows`` picks in a task, larger ones by pointers."""
    if picks.groupBy("g").count().filter(F.col("count") > rows).isEmpty():
        return materialize(picks.select("g", "c", "to").groupBy("g").applyInPandas(_merged, "g string, c long, root long"))
    # two components that picked the same edge would point at each other: the smaller is the root
    back = picks.select("g", F.col("c").alias("to"), F.col("to").alias("back"))
    pointers = picks.join(back, ["g", "to"]).select(
        "g", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")
    )
    return follow_pointers(materialize(pointers), ["g"], "c", "root")


def _relabelled(live: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges between the merged components, the lightest of each pair."""
    at_a = roots.select("g", F.col("c").alias("ca"), F.col("root").alias("ra"))
    at_b = roots.select("g", F.col("c").alias("cb"), F.col("root").alias("rb"))
    return materialize(
        live.join(at_a, ["g", "ca"])
        .join(at_b, ["g", "cb"])
        .filter(F.col("ra") != F.col("rb"))
        .groupBy("g", F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"))
        .agg(F.min(F.struct("w", "a", "b")).alias("e"))
        .select("g", "e.a", "e.b", "e.w", "ca", "cb")
    )


def _ends(edges: DataFrame) -> DataFrame:
    """Every edge from both of its components: (g, c, w, a, b, to)."""
    one = edges.select("g", F.col("ca").alias("c"), "w", "a", "b", F.col("cb").alias("to"))
    return one.unionByName(edges.select("g", F.col("cb").alias("c"), "w", "a", "b", F.col("ca").alias("to")))


def _block_trees(nodes: DataFrame, dims: int, block: int, rows: int, formed: list[int] | None, tile: int | None) -> DataFrame:
    blocks = cut_space(nodes, dims, block)
    n = tasks(nodes, 1 << 20)
    regions = blocks.regions.join(blocks.tree.filter("blk IS NOT NULL").select("g", "cell"), ["g", "cell"]).select("g", "blk", "rlow", "rhigh")
    local = blocks.vectors.join(regions, ["g", "blk"]).repartition(n, "g", "blk").groupBy("g", "blk").applyInPandas(_contracted, _LOCAL_SCHEMA)
    local = materialize(local)
    vectors = materialize(with_tiles(local.select("g", "blk", "node", "arr", "c", "ext"), dims, tile))
    found = [local.filter("taken").select("g", "a", "b", "w")]
    # neighbours in number, also over blocks' ends, so that the edges known at the start span each group
    numbers = blocks.vectors.select("g", "blk").distinct()
    nearby = numbers.select("g", F.col("blk").alias("p"), (F.col("blk") + 1).alias("q")).join(numbers.select("g", F.col("blk").alias("q")), ["g", "q"], "left_semi")
    sides = nearby.withColumn("blk", F.explode(F.array("p", "q"))).join(blocks.vectors, ["g", "blk"])
    chain = materialize(sides.repartition(n, "g", "p", "q").groupBy("g", "p", "q").applyInPandas(_between, _CHAIN_SCHEMA))
    known = local.filter("NOT taken").select("g", "a", "b", "w").unionByName(chain)
    label = vectors.select("g", "node", "c")
    live = known.join(label.select("g", F.col("node").alias("a"), F.col("c").alias("ca")), ["g", "a"]).join(
        label.select("g", F.col("node").alias("b"), F.col("c").alias("cb")), ["g", "b"]
    )
    live = materialize(live.filter("ca != cb"))
    while not live.isEmpty():
        best = materialize(_ends(live).groupBy("g", "c").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")))
        # the largest component waits; a vector of another asks if the bound leads out of its block's region
        sizes = vectors.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))
        largest = materialize(sizes.groupBy("g").agg(F.max(F.struct("n", "c"))["c"].alias("c")))
        bounds = best.select("g", "c", F.col("e.w").alias("bound")).join(largest, ["g", "c"], "left_anti")
        asking = vectors.join(best.select("g").distinct(), "g", "left_semi").join(bounds, ["g", "c"], "left").withColumn("bound", F.when(F.col("ext") <= F.col("bound"), F.col("bound")))
        met = lightest_edges(asking, formed).select("g", "a", "b", "w", F.col("c").alias("ca"), F.col("to").alias("cb"))
        every = live.unionByName(materialize(met))
        picks = _ends(every).join(largest, ["g", "c"], "left_anti").groupBy("g", "c").agg(F.min(F.struct("w", "a", "b", "to")).alias("e"))
        picks = materialize(picks.select("g", "c", "e.*"))
        found.append(picks.select("g", "a", "b", "w").distinct())
        picks = picks.select("g", "c", "to").unionByName(largest.join(picks.select("g").distinct(), "g").select("g", "c", F.col("c").alias("to")))
        roots = _merge(picks, rows)
        live = _relabelled(every, roots)
        moved = vectors.join(roots, ["g", "c"], "left")
        vectors = materialize(moved.select("g", "blk", "tile", "node", "arr", F.coalesce("root", "c").alias("c"), "ext"))
    tree = found[0]
    for part in found[1:]:
        tree = tree.unionByName(part)
    return materialize(tree)


def spanning_tree(
    nodes: DataFrame, dims: int, block: int = BLOCK, rows: int = TASK_ROWS, formed: list[int] | None = None, tile: int | None = None
) -> DataFrame:
    """``(g, a, b, w)``: the minimum spanning tree of every group of ``distinct_vectors``.

    ``formed`` gets the number of pairs of tiles that meet in each round.
    """
    groups, most = nodes.groupBy("g").count().agg(F.count(F.lit(1)), F.max("count")).first()
    if not most or most <= block:
        whole = nodes.select("g", "node", "arr").repartition(tasks(nodes, groups), "g")
        return materialize(whole.groupBy("g").applyInPandas(_within, EDGE_SCHEMA))
    return _block_trees(nodes, dims, block, rows, formed, tile)
