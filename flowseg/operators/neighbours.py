"""Nearest neighbours: for every vector the distance to the nearest other one of its group, without a tree.

A vector's own block gives a first radius. Only vectors whose radius leads out of
the block's region search on, in the tiles whose boxes lie within it (``tiles``);
others stay at home. A vector that is alone in its block starts with the far
corner of a neighbouring block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize
from flowseg.operators.blocks import BLOCK, cut_space, nearest, tasks
from flowseg.operators.tiles import lightest_edges, with_tiles

_SCHEMA = "g string, blk long, node long, arr array<double>, w double, ext double"


def _at_home(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distance to the nearest of the same block, infinite for a lone vector, and the least way out of the region."""
    x = np.stack(pdf["arr"].to_numpy())
    own = np.arange(len(x))
    ext = np.full(len(x), np.inf)
    if "rlow" in pdf.columns:
        ext = np.minimum(x - np.asarray(pdf["rlow"].iloc[0]), np.asarray(pdf["rhigh"].iloc[0]) - x).min(axis=1, initial=np.inf)
    return pdf[["g", "blk", "node", "arr"]].assign(w=nearest(x, x, own, own)[0], ext=ext)


def nearest_distances(nodes: DataFrame, dims: int, block: int = BLOCK, tile: int | None = None) -> DataFrame:
    """``(g, node, w)`` for ``distinct_vectors``; NULL where a group has one vector only."""
    groups, most = nodes.groupBy("g").count().agg(F.count(F.lit(1)), F.max("count")).first()
    if not most or most <= block:
        whole = nodes.select("g", F.lit(0).cast("long").alias("blk"), "node", "arr").repartition(tasks(nodes, groups), "g")
        near = whole.groupBy("g").applyInPandas(_at_home, _SCHEMA)
        return near.select("g", "node", F.when(F.col("w") < np.inf, F.col("w")).alias("w"))

    blocks = cut_space(nodes, dims, block)
    leaves = blocks.tree.filter("blk IS NOT NULL")
    regions = blocks.regions.join(leaves.select("g", "cell"), ["g", "cell"]).select("g", "blk", "rlow", "rhigh")
    home = blocks.vectors.join(regions, ["g", "blk"]).repartition(tasks(nodes, 1 << 20), "g", "blk").groupBy("g", "blk")
    home = materialize(home.applyInPandas(_at_home, _SCHEMA))
    far = leaves.select("g", F.explode(F.array(F.col("blk") - 1, F.col("blk") + 1)).alias("blk"), F.col("low").alias("low_n"), F.col("high").alias("high_n"))
    corner = F.greatest(F.array_max(F.zip_with("high_n", "arr", lambda h, x: h - x)), F.array_max(F.zip_with("arr", "low_n", lambda x, l: x - l)))
    alone = home.filter(F.col("w") == np.inf).join(far, ["g", "blk"]).groupBy("g", "node").agg(F.min(corner).alias("bound"))
    known = home.join(alone, ["g", "node"], "left").withColumn("bound", F.least("w", "bound"))
    asking = known.select("g", "blk", "node", "arr", F.col("node").alias("c"), "ext", F.when(F.col("ext") <= F.col("bound"), F.col("bound")).alias("bound"))
    across = lightest_edges(with_tiles(asking, dims, tile)).groupBy("g", F.col("c").alias("node")).agg(F.min("w").alias("outside"))
    return home.join(across, ["g", "node"], "left").select("g", "node", F.least("w", "outside").alias("w"))
