"""Visiting order of a spanning tree: always the lightest edge that leaves the visited part.

A light component, once entered, is visited whole before any heavier edge is
taken. So the order of a tree splits at any weight: order the tree whose
vertices are the light components, then each component on its own. Groups too
large for one task are split this way until all parts fit.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseg.functions.tables import follow_pointers, materialize, with_row_index
from flowseg.operators.blocks import tasks
from flowseg.operators.spanning import TASK_ROWS

ORDER_SCHEMA = "g string, node long, w double, pos long, pred long"
_PART = ["g", "low", "high", "top"]  # a part: edge ranks in (low, high], entered at vertex top


def _visit(n: int, start: int, heads: np.ndarray, tails: np.ndarray, keys: list) -> tuple[list, list, list]:
    """Visiting order, predecessors and edges taken, over undirected edges with sortable keys."""
    near: list[list] = [[] for _ in range(n)]
    for e, (u, v) in enumerate(zip(heads.tolist(), tails.tolist())):
        near[u].append((keys[e], v, u, e))
        near[v].append((keys[e], u, v, e))
    seen = [False] * n
    order, before, taken = [], [-1] * n, [-1] * n
    queue = [((), start, -1, -1)]
    while queue:
        _, v, u, e = heapq.heappop(queue)
        if seen[v]:
            continue
        seen[v], before[v], taken[v] = True, u, e
        order.append(v)
        for item in near[v]:
            if not seen[item[1]]:
                heapq.heappush(queue, item)
    return order, before, taken


def _offsets(order: list, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), dtype=np.int64)
    out[order] = np.cumsum(sizes[order]) - sizes[order]
    return out


def _order_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Order of a whole group: rows with a NULL ``b`` are nodes, the others edges."""
    is_edge = pdf["b"].notna()
    nodes = pdf.loc[~is_edge, ["a", "mult"]].sort_values("a")
    ids = nodes["a"].to_numpy()
    edges = pdf[is_edge]
    a = np.searchsorted(ids, edges["a"].to_numpy())
    b = np.searchsorted(ids, edges["b"].to_numpy(dtype="int64"))
    w = edges["w"].to_numpy()
    order, before, taken = _visit(len(ids), 0, a, b, list(zip(w.tolist(), a.tolist(), b.tolist())))
    before, taken = np.array(before), np.array(taken)
    root = before < 0
    pos = _offsets(order, nodes["mult"].to_numpy())
    out = pd.DataFrame({"node": ids, "w": np.where(root, np.inf, np.append(w, np.inf)[taken]), "pos": pos})
    out["pred"] = np.where(root, -1, pos[before])
    out.insert(0, "g", pdf["g"].iloc[0])
    return out


def _order_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Offsets inside one part, given parents and edge ranks."""
    pdf = pdf.sort_values("v", ignore_index=True)
    ids = pdf["v"].to_numpy()
    child = np.flatnonzero(pdf["par"].notna().to_numpy())
    parent = np.searchsorted(ids, pdf["par"].to_numpy(dtype="float64", na_value=np.nan)[child].astype("int64"))
    ranks = pdf["rank"].to_numpy(dtype="float64", na_value=np.nan)[child].astype("int64")
    start = int(np.searchsorted(ids, pdf["top"].iloc[0]))
    order, _, _ = _visit(len(ids), start, child, parent, [(k,) for k in ranks.tolist()])
    out = pdf[_PART + ["v"]].copy()
    out["off"] = _offsets(order, pdf["size"].to_numpy())
    return out


def root_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(g, node, parent)``: parents when the tree hangs from the group's smallest node.

    The tour that walks every edge in both directions is a linked list; its
    ranks, by pointer doubling, tell which direction of an edge comes first.
    """
    arcs = edges.select("g", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select("g", F.col("b").alias("u"), F.col("a").alias("v"))
    )
    arcs = materialize(with_row_index(arcs, "g", "u", "v", name="i"))
    span = arcs.groupBy("g", "u").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    back = arcs.select("g", F.col("v").alias("u"), F.col("u").alias("v"), F.col("i").alias("j"))
    starts = (
        nodes.groupBy("g").agg(F.min("node").alias("u")).join(span, ["g", "u"]).select(F.col("first").alias("_start"))
    )
    # after u->v comes the arc that follows v->u around v; `back` holds v->u under its index j
    turned = (
        arcs.join(back.withColumnRenamed("j", "rev"), ["g", "u", "v"])
        .join(span.select("g", F.col("u").alias("v"), "first", "last"), ["g", "v"])
        .select("i", F.when(F.col("rev") < F.col("last"), F.col("rev") + 1).otherwise(F.col("first")).alias("next"))
    )
    ended = turned.join(starts.withColumnRenamed("_start", "next"), "next", "left_semi").select("i", F.lit(None).cast("long").alias("next"))
    going = turned.join(starts.withColumnRenamed("_start", "next"), "next", "left_anti").select("i", "next")
    ranked = materialize(ended.unionByName(going).withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
    while not ranked.filter(F.col("next").isNotNull()).isEmpty():
        ahead = ranked.select(F.col("i").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        moving = ranked.filter(F.col("next").isNotNull()).join(ahead, "next")
        moving = moving.select("i", F.col("next2").alias("next"), (F.col("left") + F.col("left2")).alias("left"))
        ranked = materialize(ranked.filter(F.col("next").isNull()).unionByName(moving))
    placed = arcs.join(ranked.select("i", "left"), "i")
    other = placed.select("g", F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("left2"))
    return (
        placed.join(other, ["g", "u", "v"])
        .filter(F.col("left") > F.col("left2"))
        .select("g", F.col("v").alias("node"), F.col("u").alias("parent"))
    )


def _split(parts: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Parts that fit, and of the others the split and their successors."""
    sizes = parts.groupBy(*_PART).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("rank", 0.5).alias("mid"), F.max("rank").alias("most")
    )
    # at most (all rows / rows) parts are too large, so this side is small by construction
    large = materialize(
        sizes.filter(F.col("n") > rows).select(*_PART, F.least("mid", F.col("most") - 1).alias("cut"))
    )
    if large.isEmpty():
        return parts, None, None
    fits = parts.join(F.broadcast(large), _PART, "left_anti")
    big = materialize(parts.join(F.broadcast(large), _PART))
    light = F.col("rank") <= F.col("cut")
    tops = follow_pointers(
        materialize(big.select(*_PART, "v", F.when(light, F.col("par")).otherwise(F.col("v")).alias("head"))),
        _PART, "v", "head",
    )
    split = materialize(big.join(tops, [*_PART, "v"]))
    comps = split.groupBy(*_PART, "cut", "head").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("members"))
    comps = materialize(comps)
    is_head = F.col("v") == F.col("head")
    single = comps.filter(F.col("members") == 1).select(*_PART, "head")
    inner = split.join(single, [*_PART, "head"], "left_anti").select(
        "g", "low", F.col("cut").alias("high"), F.col("head").alias("top"), "v",
        F.when(~is_head, F.col("par")).alias("par"),
        F.when(~is_head, F.col("rank")).alias("rank"), "size",
    )
    heads = split.filter(is_head).select(*_PART, "cut", "v", "par", "rank")
    over = split.select(*_PART, F.col("v").alias("par"), F.col("head").alias("par_head"))
    hung = heads.filter(F.col("par").isNotNull()).join(over, [*_PART, "par"]).select(*_PART, "cut", "v", F.col("par_head").alias("par"), "rank")
    roots = heads.filter(F.col("par").isNull())
    outer = (
        hung.unionByName(roots.select(*hung.columns))
        .join(comps.select(*_PART, F.col("head").alias("v"), "size"), [*_PART, "v"])
        .select("g", F.col("cut").alias("low"), "high", "top", "v", "par", "rank", "size")
    )
    return fits, split, materialize(inner.unionByName(outer))


def _order_large(nodes: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """Order of groups of any size, by splitting at middle weights."""
    ranked = materialize(with_row_index(edges, "g", "w", "a", "b", name="rank"))
    parents = root_tree(edges, nodes)
    ends = F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")
    hung = materialize(
        nodes.select("g", "node", "mult")
        .join(parents, ["g", "node"], "left")
        .select("g", "node", "mult", "parent", *ends)
        .join(ranked, ["g", "a", "b"], "left")
        .select("g", "node", "mult", "parent", "w", "rank")
    )
    tops = hung.groupBy("g").agg(F.min("node").alias("top"), F.max("rank").alias("high"))  # one row per group
    parts = hung.join(tops, "g").select(
        "g", F.lit(-1).cast("long").alias("low"), "high", "top", F.col("node").alias("v"), F.col("parent").alias("par"),
        "rank", F.col("mult").alias("size"),
    )
    whole = tops.select("g", F.lit(-1).cast("long").alias("low"), "high", "top")
    done, splits = [], []
    while parts is not None:
        fits, split, parts = _split(parts, rows)
        done.append(fits)
        if split is not None:
            splits.append(split)
    leaves = done[0]
    for d in done[1:]:
        leaves = leaves.unionByName(d)
    n_tasks = 8 * nodes.sparkSession.sparkContext.defaultParallelism
    solved = materialize(
        leaves.repartition(n_tasks, *_PART)
        .groupBy(*_PART)
        .applyInPandas(_order_part, "g string, low long, high long, top long, v long, off long")
    )
    for split in reversed(splits):
        outer = solved.select("g", F.col("low").alias("cut"), "high", "top", F.col("v").alias("head"), F.col("off").alias("outer"))
        inner = solved.select("g", "low", F.col("high").alias("cut"), F.col("top").alias("head"), "v", F.col("off").alias("inner"))
        upper = (
            split.select(*_PART, "cut", "v", "head")
            .join(outer, ["g", "cut", "high", "top", "head"])
            .join(inner, ["g", "low", "cut", "head", "v"], "left")
            .select(*_PART, "v", (F.col("outer") + F.coalesce("inner", F.lit(0))).alias("off"))
        )
        solved = materialize(solved.unionByName(upper))
    final = solved.join(whole, _PART, "left_semi").select("g", F.col("v").alias("node"), F.col("off").alias("pos"))
    final = materialize(final)
    at = final.select("g", F.col("node").alias("parent"), F.col("pos").alias("pred"))
    return (
        hung.join(final, ["g", "node"])
        .join(at, ["g", "parent"], "left")
        .select("g", "node", F.coalesce("w", F.lit(float("inf"))).alias("w"), "pos", F.coalesce("pred", F.lit(-1)).alias("pred"))
    )


def visiting_order(nodes: DataFrame, edges: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``(g, node, w, pos, pred)`` for nodes ``(g, node, mult)`` and tree edges ``(g, a, b, w)``.

    The walk starts at the smallest node of the group, with infinite ``w`` and
    ``pred`` -1; elsewhere these are the edge to and the position of the
    predecessor. ``pos`` counts a node ``mult`` times.
    """
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > rows).select("g")
    whole = (
        nodes.select("g", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"), "mult")
        .unionByName(edges.select("g", "a", "b", "w", F.lit(None).cast("long").alias("mult")))
    )
    # by number, not by size: small rows of many groups are much work
    whole = whole.repartition(tasks(nodes, 1 << 20), "g")
    if large.isEmpty():
        return whole.groupBy("g").applyInPandas(_order_group, ORDER_SCHEMA)
    large = materialize(large)  # at most (all rows / rows) groups
    small = whole.join(F.broadcast(large), "g", "left_anti").groupBy("g").applyInPandas(_order_group, ORDER_SCHEMA)
    big = _order_large(
        nodes.join(F.broadcast(large), "g", "left_semi"), edges.join(F.broadcast(large), "g", "left_semi"), rows
    )
    return small.unionByName(big)
