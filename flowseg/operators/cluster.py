"""Micro-segments: density clusters (OPTICS, xi method) of feature vectors.

With two samples per core point, a point's core distance is the distance to its
nearest neighbour, so the reachability of a point equals its distance to the
predecessor and the plot is the visiting order of the minimum spanning tree.
The steps are: tree (``spanning``), order (``ordering``), clusters (``xi``). Groups of up to
a block's rows take them together, many groups at a time (``groups``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseg.functions.columns import as_double_array, quoted
from flowseg.functions.tables import is_small, lookup_join, materialize, with_row_index
from flowseg.operators.blocks import BLOCK
from flowseg.operators.groups import small_labels, small_plots, split_by_size
from flowseg.operators.neighbours import nearest_distances
from flowseg.operators.ordering import visiting_order
from flowseg.operators.spanning import TASK_ROWS, distinct_vectors, spanning_tree
from flowseg.operators.xi import PLOT_BLOCK, xi_labels
from flowseg.specs import OPTICS_MIN_SAMPLES, OPTICS_XI

NOISE = -1


def _points(df: DataFrame, id_col: str, vector: str, group_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(g, id, arr)`` and the groups' sizes ``(g, n)``; the group columns travel as one JSON key. A vector without a distance raises."""
    key = F.to_json(F.struct(*[quoted(c) for c in group_cols]), {"ignoreNullFields": "false"}) if group_cols else F.lit("")
    points = df.select(key.alias("g"), quoted(id_col).alias("id"), as_double_array(df, vector).alias("arr"))
    unusable = F.col("arr").isNull() | F.exists("arr", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sizes = materialize(points.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(unusable.cast("long")).alias("bad")))
    bad = sizes.agg(F.sum("bad")).first()[0]
    if bad:
        raise ValueError(f"{bad} vectors in {vector!r} are NULL or hold NULL or non-finite components")
    return points, sizes.select("g", "n")


def _restore_groups(df: DataFrame, source: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    if not group_cols:
        return df.drop("g")
    schema = source.select(*[quoted(c) for c in group_cols]).schema
    parsed = df.withColumn("_g", F.from_json("g", schema))
    rest = [c for c in df.columns if c != "g"]
    return parsed.select(*[F.col("_g").getField(c).alias(c) for c in group_cols], *rest)


def _nodes(points: DataFrame) -> tuple[DataFrame, int]:
    """Distinct vectors and their length."""
    nodes = distinct_vectors(points)
    first = nodes.select(F.size("arr").alias("d")).first()
    return nodes, first["d"] if first else 0


def _plot(points: DataFrame, block: int, rows: int) -> DataFrame:
    """``(g, id, pos, r, pred)``: the reachability plot over all points, copies included.

    Copies of a vector follow its first visit at distance 0, in order of id.
    """
    nodes, dims = _nodes(points)
    edges = spanning_tree(nodes, dims, block, rows)
    order = visiting_order(nodes.select("g", "node", "mult"), edges, rows)
    placed = materialize(
        order.join(nodes, ["g", "node"]).select(F.struct("g", "arr").alias("k"), "node", "mult", "pos", "w", "pred")
    )
    n_nodes, most = placed.agg(F.count(F.lit(1)), F.max("mult")).first()
    found = lookup_join(points.withColumn("k", F.struct("g", "arr")), placed, "k", "mult", lookup_rows=n_nodes).drop("k", "arr")
    if not most or most == 1:
        return found.select("g", "id", "pos", F.col("w").alias("r"), "pred")
    alone = found.filter(F.col("mult") == 1).withColumn("nth", F.lit(0).cast("long"))
    ranked = materialize(with_row_index(found.filter(F.col("mult") > 1), "node", "id", name="_i"))
    firsts = ranked.groupBy("node").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_c"))
    numbered = lookup_join(ranked, materialize(firsts), "node", "_c").withColumn("nth", F.col("_i") - F.col("_first"))
    counted = alone.unionByName(numbered.drop("_i", "_first", "_c"))
    repeat = F.col("nth") > 0
    return counted.select(
        "g",
        "id",
        (F.col("pos") + F.col("nth")).alias("pos"),
        F.when(repeat, F.lit(0.0)).otherwise(F.col("w")).alias("r"),
        F.when(repeat, F.col("pos")).otherwise(F.col("pred")).alias("pred"),
    )


def _numbered(labels: DataFrame) -> DataFrame:
    """``(g, id, cluster_id)`` with clusters numbered through all groups, in the order of their keys."""
    numbers = with_row_index(labels.filter(F.col("cluster_id") != NOISE).select("g", "cluster_id").distinct(), "g", "cluster_id", name="_n")
    found = labels.join(numbers, ["g", "cluster_id"], "left")
    return found.select("g", "id", F.coalesce(F.col("_n"), F.lit(NOISE)).cast("int").alias("cluster_id"))


def _numbered_parts(labels: DataFrame) -> DataFrame:
    """The same of labels whose partitions have numbered their own clusters: only one count per partition is gathered."""
    counts = labels.groupBy("part").agg((F.max("nth") + 1).alias("k")).orderBy("part").collect()
    starts, total = [], 0
    for part, k in counts:
        starts.append((part, total))
        total += k
    offsets = labels.sparkSession.createDataFrame(starts, "part int, _start long")
    number = F.when(F.col("nth") < 0, F.lit(NOISE)).otherwise(F.col("nth") + F.col("_start"))
    return labels.join(F.broadcast(offsets), "part").select("g", "id", number.cast("int").alias("cluster_id"))


def _check_samples(min_samples: int) -> None:
    if min_samples != OPTICS_MIN_SAMPLES:
        raise ValueError("the reachability plot equals the spanning tree order for min_samples=2 only")


def reachability(
    df: DataFrame,
    id_col: str,
    vector: str,
    group_cols: Sequence[str] = (),
    block: int = BLOCK,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``(group..., id, ord, reachability, predecessor)``; NULL reachability starts a group."""
    small, large = split_by_size(*_points(df, id_col, vector, group_cols), block)
    plots = ([] if small is None else [small_plots(small)]) + ([] if large is None else [_plot(large, block, task_rows)])
    plot = materialize(reduce(DataFrame.unionByName, plots))
    names = plot.select("g", F.col("pos").alias("pred"), F.col("id").alias("predecessor"))
    out = plot.join(names, ["g", "pred"], "left").select(
        "g", F.col("id").alias(id_col), F.col("pos").alias("ord"),
        F.when(F.col("pred") >= 0, F.col("r")).alias("reachability"), "predecessor",
    )
    return _restore_groups(out, df, group_cols)


def core_distance(
    df: DataFrame,
    id_col: str,
    vector: str,
    group_cols: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """``(group..., id, core_distance)``: distance to the nearest other point, NULL where there is none."""
    points, _ = _points(df, id_col, vector, group_cols)
    nodes, dims = _nodes(points)
    nearest = nearest_distances(nodes, dims, block)
    known = materialize(
        nodes.join(nearest, ["g", "node"], "left").select(
            F.struct("g", "arr").alias("k"), "mult",
            F.when(F.col("mult") > 1, F.lit(0.0)).otherwise(F.col("w")).alias("core_distance"),
        )
    )
    out = lookup_join(points.withColumn("k", F.struct("g", "arr")), known, "k", "mult")
    return _restore_groups(out.select("g", F.col("id").alias(id_col), "core_distance"), df, group_cols)


def optics_segments(
    df: DataFrame,
    id_col: str,
    vector: str,
    group_cols: Sequence[str] = (),
    xi: float = OPTICS_XI,
    min_samples: int = OPTICS_MIN_SAMPLES,
    min_cluster_size: int | None = None,
    block: int = BLOCK,
    task_rows: int = TASK_ROWS,
    plot_block: int = PLOT_BLOCK,
    through: bool = False,
) -> DataFrame:
    """``(group..., id, cluster_id)`` for every row; -1 is noise.

    Groups are clustered independently, and their clusters are numbered in each group or
    ``through`` all groups, in the order of their keys. Equal input gives equal labels under any
    partitioning: the walk starts at the smallest vector and ties go to the
    smaller vectors.
    """
    _check_samples(min_samples)
    min_size = max(2, min_cluster_size or min_samples)
    small, large = split_by_size(*_points(df, id_col, vector, group_cols), block)
    found = []
    if small is not None:
        found.append(materialize(small_labels(small, xi, min_samples, min_size)))
    if large is not None:
        plot = materialize(_plot(large, block, task_rows))
        labels = xi_labels(plot.select("g", "pos", "r", "pred"), xi, min_samples, min_size, plot_block)
        found.append(plot.join(labels, ["g", "pos"]).select("g", "id", "cluster_id"))
    if through and large is None:
        out = _numbered_parts(found[0])
    else:
        out = reduce(DataFrame.unionByName, [part.select("g", "id", "cluster_id") for part in found])
        out = _numbered(materialize(out)) if through else out
    return _restore_groups(out.select("g", F.col("id").alias(id_col), "cluster_id"), df, group_cols)


def attach_clusters(sample: DataFrame, clusters: DataFrame, uid: str) -> DataFrame:
    """Left join of the sample with its cluster ids; the id keeps the sample's type."""
    typed = clusters.withColumn(uid, quoted(uid).cast(sample.schema[uid].dataType))
    return sample.join(typed, uid, "left")


def flows_in_clusters(flows: DataFrame, clusters: DataFrame, uid: str, cluster: str = "cluster_id") -> DataFrame:
    """All flows that have a cluster id; a cluster table of checked size is broadcast."""
    slim = materialize(clusters.select(quoted(uid).cast(flows.schema[uid].dataType).alias(uid), cluster))
    return flows.join(F.broadcast(slim) if is_small(slim) else slim, uid, "inner")


def largest_clusters(clusters: DataFrame, top: int | None = 10, cluster: str = "cluster_id") -> DataFrame:
    """Cluster sizes without noise, largest first."""
    sizes = (
        clusters.filter(F.col(cluster) != NOISE)
        .groupBy(cluster)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), cluster)
    )
    return sizes.limit(top) if top else sizes


def summary(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row: points, clusters, noise points and their percentage."""
    noise = F.coalesce(F.sum((F.col(cluster) == NOISE).cast("long")), F.lit(0))
    points = F.count(F.lit(1))
    return clusters.agg(
        points.alias("n_points"),
        F.countDistinct(F.when(F.col(cluster) != NOISE, F.col(cluster))).alias("n_clusters"),
        noise.alias("n_noise"),
        F.when(points > 0, F.round(noise / points * 100, 2)).otherwise(0.0).alias("noise_pct"),
    )
