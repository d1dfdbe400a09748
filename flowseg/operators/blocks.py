"""Blocks of space and the tree of cuts: who lies near whom, by bounding boxes.

Space is cut along the widest coordinate, again and again, into blocks of bounded
size. A cut leaves two things behind: the region between its planes, which no other
block's vector enters, and a place in the tree of cuts, whose nodes have the
bounding boxes of what is below them.

A search starts from a box in some block with a radius. Where the radius stays
inside the region of the block, or of a node above it, nothing outside can be met,
so the search climbs only as far as the radius leaves regions, and from there
descends to the boxes within it. Its cost follows from what is near, not from how
many blocks there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize, with_row_index

BLOCK = 2048  # vectors per block
CHUNK = 250_000  # distances held at a time in a task, few enough for a cache
_CUTS = [k / 8 for k in range(1, 8)]


@dataclass(frozen=True)
class Blocks:
    """``vectors`` (g, node, arr, blk), ``regions`` (g, blk, cell, rlow, rhigh), one row for the block and each node
    above it but the root, ``tree`` (g, cell, parent, blk, low, high) of all nodes but the roots, and the ``depth`` of the tree."""

    vectors: DataFrame
    regions: DataFrame
    tree: DataFrame
    depth: int


def tasks(df: DataFrame, groups: int) -> int:
    """Partitions for CPU-heavy groups: about one group each, within reason for the cluster."""
    return max(1, min(groups, 8 * df.sparkSession.sparkContext.defaultParallelism))


def boxes(cells: DataFrame, dims: int, *keys: str) -> DataFrame:
    """Number of vectors and bounding box per cell."""
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(F.col("arr")[k]) for k in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("arr")[k]) for k in range(dims)]).alias("high"),
    )


def cut_space(nodes: DataFrame, dims: int, block: int = BLOCK) -> Blocks:
    """Blocks of at most ``block`` vectors of a group.

    Cells that are too large are cut into up to eight slices along their widest
    coordinate, at approximate quantiles; distinct vectors always leave one to
    cut. Block numbers follow the order of the cuts, so neighbours in number are
    neighbours in space.
    """
    cells = nodes.select("g", "node", "arr", F.lit("").alias("cell"))
    everywhere = [F.array(*[F.lit(x)] * dims) for x in (-np.inf, np.inf)]
    level = nodes.select("g", F.lit("").alias("cell"), everywhere[0].alias("rlow"), everywhere[1].alias("rhigh")).distinct()
    regions, depth = [], 0
    while True:
        spreads = F.zip_with("high", "low", lambda h, l: h - l)
        # at most (all vectors / block) cells are too large
        large = materialize(
            boxes(cells, dims, "g", "cell").filter(F.col("n") > block)
            .withColumn("axis", F.array_position(spreads, F.array_max(spreads)).cast("int") - 1)
            .select("g", "cell", "n", "axis", F.get("low", F.col("axis")).alias("lo"), F.get("high", F.col("axis")).alias("hi"))
        )
        if large.isEmpty():
            break
        depth += 1
        cells = materialize(cells)
        coordinate = F.get("arr", F.col("axis"))
        quantiles = (
            cells.join(F.broadcast(large), ["g", "cell"])
            .groupBy("g", "cell")
            .agg(F.percentile_approx(coordinate, _CUTS).alias("marks"))
        )
        # two, four or eight slices; where all marks equal the top value, the middle of the range
        marks = (
            F.when(F.col("n") <= 2 * block, F.array(F.get("marks", F.lit(3))))
            .when(F.col("n") <= 4 * block, F.array(*[F.get("marks", F.lit(k)) for k in (1, 3, 5)]))
            .otherwise(F.col("marks"))
        )
        inner = F.filter(F.array_distinct(marks), lambda m: m < F.col("hi"))
        middle = (F.col("lo") + F.col("hi")) / 2
        cuts = large.join(quantiles, ["g", "cell"]).select(
            "g", "cell", "axis",
            F.when(F.size(inner) > 0, inner)
            .otherwise(F.array(F.when(middle < F.col("hi"), middle).otherwise(F.col("lo"))))
            .alias("cuts"),
        )
        cuts = materialize(cuts)
        slices = F.size(F.filter("cuts", lambda c: c < F.get("arr", F.col("axis"))))
        cells = materialize(
            cells.join(F.broadcast(cuts), ["g", "cell"], "left").select(
                "g", "node", "arr", F.concat("cell", F.coalesce(slices.cast("string"), F.lit(""))).alias("cell")
            )
        )
        level = materialize(_sliced(level.join(cuts, ["g", "cell"])))
        regions.append(level)
    names = with_row_index(cells.select("g", "cell").distinct(), "g", "cell", name="blk")
    names = materialize(names)
    vectors = materialize(cells.join(names, ["g", "cell"]).drop("cell"))
    above = names.select("g", "blk", F.explode(F.transform(F.sequence(F.lit(1), F.length("cell")), lambda k: F.substr("cell", F.lit(1), k))).alias("above"), "cell")
    own = boxes(vectors, dims, "g", "blk").join(above, ["g", "blk"])
    tree = own.groupBy("g", F.col("above").alias("cell")).agg(
        F.max(F.when(F.col("cell") == F.col("above"), F.col("blk"))).alias("blk"),
        F.array(*[F.min(F.col("low")[k]) for k in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("high")[k]) for k in range(dims)]).alias("high"),
    )
    tree = materialize(tree.withColumn("parent", F.substr("cell", F.lit(1), F.length("cell") - 1)))
    every = regions[0]
    for more in regions[1:]:
        every = every.unionByName(more)
    placed = above.select("g", "blk", F.col("above").alias("cell")).join(every, ["g", "cell"])
    return Blocks(vectors, materialize(placed), tree, depth)


def _sliced(cut: DataFrame) -> DataFrame:
    """The regions of the slices: between two neighbouring cuts on the axis, elsewhere as before."""
    ends = F.concat(F.array(F.get("rlow", F.col("axis"))), "cuts", F.array(F.get("rhigh", F.col("axis"))))
    slices = cut.select("g", "cell", "axis", "rlow", "rhigh", ends.alias("ends"), F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("k"))

    def replaced(side: str, k: Column) -> Column:
        return F.transform(side, lambda x, i: F.when(i == F.col("axis"), F.get("ends", k)).otherwise(x)).alias(side)

    return slices.select("g", F.concat("cell", F.col("k").cast("string")).alias("cell"), replaced("rlow", F.col("k")), replaced("rhigh", F.col("k") + 1))


def gap(low: str, high: str, other_low: str, other_high: str) -> Column:
    """Chebyshev distance of two boxes, negative where they overlap."""
    one = F.array_max(F.zip_with(other_low, high, lambda l, h: l - h))
    return F.greatest(one, F.array_max(F.zip_with(low, other_high, lambda l, h: l - h)))


def inside(low: str, high: str) -> Column:
    """How far a box is from leaving the region (rlow, rhigh)."""
    return F.least(F.array_min(F.zip_with(low, "rlow", lambda x, r: x - r)), F.array_min(F.zip_with("rhigh", high, lambda r, x: r - x)))


def visits(blocks: Blocks, queries: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(g, p, c, bound, low, high, q, low_q, high_q): the blocks q within ``bound`` of the boxes of ``queries`` (g, p, c, bound, low, high).

    ``p`` is the box's own block, which isn't visited. A ``tree`` with a column ``pure`` leaves out the
    nodes whose vectors all belong to the query's own ``c``.
    """
    tree = blocks.tree.withColumn("pure", F.lit(None).cast("long")) if tree is None else tree
    below = tree.select("g", "parent", F.col("cell").alias("to"), F.col("blk").alias("q"), F.col("low").alias("low_q"), F.col("high").alias("high_q"), "pure")
    wanted = (gap("low", "high", "low_q", "high_q") <= F.col("bound")) & ~F.col("pure").eqNullSafe(F.col("c"))
    names = ["g", "p", "c", "bound", "low", "high"]
    regions = blocks.regions.withColumnRenamed("blk", "p")
    left = queries.join(regions, ["g", "p"]).filter(inside("low", "high") <= F.col("bound"))
    left = left.select(*names, F.col("cell").alias("own"), F.substr("cell", F.lit(1), F.length("cell") - 1).alias("parent"))
    front = left.join(below, ["g", "parent"]).filter((F.col("to") != F.col("own")) & wanted)
    found = None
    for _ in range(blocks.depth):
        front = materialize(front.select(*names, "q", "low_q", "high_q", F.col("to").alias("parent")))
        met = front.filter("q IS NOT NULL").drop("parent")
        found = met if found is None else found.unionByName(met)
        open_nodes = front.filter("q IS NULL")
        if open_nodes.isEmpty():
            break
        front = open_nodes.drop("q", "low_q", "high_q").join(below, ["g", "parent"]).filter(wanted)
    return found


def nearest(x: np.ndarray, y: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance from every row of ``x`` to the nearest of ``y`` that belongs to another component, and its place, the first of several."""
    w, to = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    step = max(1, CHUNK // max(1, len(y)))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        dist = np.zeros((len(x[part]), len(y)))
        for k in range(x.shape[1]):
            np.maximum(dist, np.abs(x[part, k, None] - y[None, :, k]), out=dist)
        dist[c[part, None] == d[None, :]] = np.inf
        to[part] = dist.argmin(axis=1)
        w[part] = dist[np.arange(len(dist)), to[part]]
    return w, to
