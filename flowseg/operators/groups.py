"""Plots and clusters of many small groups, which a task takes a batch at a time.

A tree grown from the smallest vector by the lightest edge that leaves it is the spanning
tree, and the order in which it grows is the visiting order, so one pass over a group gives
both. Groups of about one size grow side by side in arrays: what a group costs is
its distances, not calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.operators.blocks import tasks
from flowseg.operators.spanning import _tree
from flowseg.operators.xi import label_plots

ALONE = 256  # vectors; a group with more of them grows alone
SIDE_BY_SIDE = 1 << 15  # vectors of groups that grow together
BATCH_ROWS, BATCH_BYTES = 1 << 16, 32 << 20  # of whole groups, held in a task


def _grow(coords: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, distance and predecessor of the vectors of groups side by side, ``coords`` by component, group and place.

    Groups come by size. Ties go to the smaller pair of places, as in the tree of a block.
    """
    _, n, m = coords.shape
    rows, place = np.arange(n), np.arange(m)
    order, w, source = np.zeros((n, m), dtype=np.int64), np.full((n, m), np.inf), np.full((n, m), -1)
    none = np.iinfo(np.int64).max
    weight, pair, known = np.full((n, m), np.inf), np.full((n, m), none), np.zeros((n, m), dtype=np.int64)
    outside = place < sizes[:, None]
    outside[:, 0] = False
    here = np.zeros(n, dtype=np.int64)
    for step in range(1, m):
        dist = np.zeros((n, m))
        for c in coords:
            np.maximum(dist, np.abs(c - c[rows, here][:, None]), out=dist)
        code = np.minimum(place, here[:, None]) * m + np.maximum(place, here[:, None])
        closer = outside & ((dist < weight) | ((dist == weight) & (code < pair)))
        np.copyto(weight, dist, where=closer)
        np.copyto(pair, code, where=closer)
        np.copyto(known, here[:, None], where=closer)
        least = weight.min(axis=1)
        here = np.where(weight == least[:, None], pair, none).argmin(axis=1)
        order[:, step], w[:, step], source[:, step] = here, least, known[rows, here]
        outside[rows, here], weight[rows, here], pair[rows, here] = False, np.inf, none
    return order, w, source


def walks(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visiting order of groups of sorted distinct vectors behind each other, ``sizes`` long.

    Returns, for the k-th visited vector of each group, its place in the group, its distance to
    the predecessor and the predecessor's place; infinite and -1 at the first.
    """
    at = np.cumsum(sizes) - sizes
    order, w, source = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf), np.full(len(x), -1)
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 1]
    alone = sizes[by_size] > ALONE
    for k in by_size[alone].tolist():
        own = slice(at[k] + 1, at[k] + sizes[k])
        source[own], order[own], w[own] = _tree(x[at[k] : at[k] + sizes[k]])
    rest, done = by_size[~alone], 0
    while done < len(rest):
        # as many as fit when filled up to the size of the last
        filled = np.arange(1, len(rest) - done + 1) * sizes[rest[done:]]
        some = rest[done : done + max(1, int(np.searchsorted(filled, SIDE_BY_SIDE, side="right")))]
        done += len(some)
        n = sizes[some][:, None]
        own = np.arange(n.max())
        places = at[some][:, None] + np.minimum(own, n - 1)
        found = _grow(np.ascontiguousarray(np.moveaxis(x[places], 2, 0)), sizes[some])
        used = own < n
        for to, part in zip((order, w, source), found):
            to[places[used]] = part[used]
    return order, w, source


def plots(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reachability plots of groups of rows behind each other: the rows' positions, and distances and predecessors by position.

    Positions count through all groups. Copies of a vector follow its first visit at distance 0, in the order of the rows.
    """
    group = np.repeat(np.arange(len(sizes)), sizes)
    by_vector = np.lexsort((*x.T[::-1], group))
    x, group = x[by_vector], group[by_vector]
    fresh = np.append(True, (np.diff(group) > 0) | (x[1:] != x[:-1]).any(axis=1))
    start = np.flatnonzero(fresh)
    copies = np.diff(np.append(start, len(x)))
    vectors = np.bincount(group[start], minlength=len(sizes))
    at = np.repeat(np.cumsum(vectors) - vectors, vectors)
    order, w, source = walks(x[start], vectors)
    visited = at + order
    place = np.empty(len(start), dtype=np.int64)  # of a vector's first row in the plot
    place[visited] = np.cumsum(copies[visited]) - copies[visited]
    r, pred = np.zeros(len(x)), np.repeat(place[visited], copies[visited])
    r[place[visited]] = w
    pred[place[visited]] = np.where(source < 0, -1, place[at + np.maximum(source, 0)])
    pos = np.empty(len(x), dtype=np.int64)
    vector = np.cumsum(fresh) - 1
    pos[by_vector] = place[vector] + np.arange(len(x)) - start[vector]
    return pos, r, pred


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' sizes, from rows sorted by group."""
    def cut(held: list) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        g = rows["g"].combine_chunks() if rows["g"].num_chunks != 1 else rows["g"].chunk(0)
        first = np.append(0, np.flatnonzero(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)) + 1)
        return rows, first

    held, due = [], BATCH_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < due and sum(b.nbytes for b in held) < BATCH_BYTES:
            continue
        rows, first = cut(held)
        if first[-1]:
            yield rows[: first[-1]], np.diff(first)
        held = rows[first[-1] :].to_batches()
    if held:
        rows, first = cut(held)
        yield rows, np.diff(np.append(first, len(rows)))


def _vectors(rows: pa.Table, sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of groups whose vectors are of one length: their rows, vectors and sizes."""
    arr = rows["arr"].combine_chunks()
    arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr
    length = pc.list_value_length(arr).to_numpy()
    first = np.cumsum(sizes) - sizes
    if (length != np.repeat(length[first], sizes)).any():
        raise ValueError("vectors of different lengths in a group")
    values, at = arr.flatten().to_numpy(), np.append(0, np.cumsum(length))
    turns = np.append(np.flatnonzero(np.append(True, np.diff(length[first]) != 0)), len(sizes))
    for i, j in zip(turns[:-1], turns[1:]):
        own = slice(first[i], first[j - 1] + sizes[j - 1])
        yield own, values[at[own.start] : at[own.stop]].reshape(own.stop - own.start, length[first[i]]), sizes[i:j]


def _mapped(points: DataFrame, work, *fields: T.StructField) -> DataFrame:
    """(g, id) with the columns that ``work`` gives for the rows, vectors and sizes of whole groups. Partitions follow the order of groups."""
    schema = T.StructType([points.schema["g"], points.schema["id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for rows, sizes in _whole_groups(batches):
            for own, x, some in _vectors(rows, sizes):
                part = rows.select(["g", "id"])[own]
                for name, column in work(x, some, state).items():
                    part = part.append_column(name, pa.array(column))
                yield from part.combine_chunks().to_batches()

    placed = points.select("g", "id", "arr").repartitionByRange(tasks(points, 1 << 20), "g").sortWithinPartitions("g", "id")
    return placed.mapInArrow(run, schema)


def small_plots(points: DataFrame) -> DataFrame:
    """``(g, id, pos, r, pred)``: the reachability plots of groups that fit a task."""
    def work(x: np.ndarray, sizes: np.ndarray, _: dict) -> dict[str, np.ndarray]:
        pos, r, pred = plots(x, sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        return {"pos": pos - first, "r": r[pos], "pred": np.where(pred < 0, -1, pred - first)[pos]}

    fields = [T.StructField("pos", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("pred", T.LongType())]
    return _mapped(points, work, *fields)


def small_labels(points: DataFrame, xi: float, gap: int, min_size: int) -> DataFrame:
    """``(g, id, cluster_id, part, nth)``: the clusters of groups that fit a task, -1 is noise.

    ``nth`` numbers them through the groups of the partition ``part``, in the order of the groups, as partitions are.
    """
    def work(x: np.ndarray, sizes: np.ndarray, state: dict) -> dict[str, np.ndarray]:
        pos, r, pred = plots(x, sizes)
        labels, counts = label_plots(r, pred, sizes, xi, gap, min_size)
        labels = labels[pos]
        before = state.get("clusters", 0)
        state["clusters"] = before + int(counts.sum())
        nth = np.where(labels < 0, -1, labels + np.repeat(before + np.cumsum(counts) - counts, sizes))
        part = np.full(len(x), TaskContext.get().partitionId(), dtype=np.int32)
        return {"cluster_id": labels.astype(np.int32), "part": part, "nth": nth}

    fields = [T.StructField("cluster_id", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())]
    return _mapped(points, work, *fields)


def split_by_size(points: DataFrame, sizes: DataFrame, rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The points of groups of at most ``rows`` rows, and those of larger ones; None where there are none."""
    large = sizes.filter(F.col("n") > rows).select("g")  # at most (all rows / rows) groups
    n_groups, n_large = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") > rows).cast("long")), F.lit(0))).first()
    if not n_large:
        return points, None
    if n_large == n_groups:
        return None, points
    return points.join(F.broadcast(large), "g", "left_anti"), points.join(F.broadcast(large), "g", "left_semi")
