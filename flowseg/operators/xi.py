"""Clusters of a reachability plot by steep areas (xi method), block by block.

The plot is cut into blocks where no steep area is interrupted. What a block
must know of the earlier ones is short: the steep-down areas still open. Each
open area starts at most (1 - xi) times as high as the one before it, so their
number is bounded by the range of a double, whatever the length of the plot.
The choice among overlapping clusters needs only the end of the last one taken.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize
from flowseg.operators.blocks import tasks

PLOT_BLOCK = 1 << 18  # positions per block
LABEL_SCHEMA = "g string, pos long, cluster_id int"
_OPEN_SCHEMA = "g string, b long, peak double, start long, end long, mib double, heights array<double>"
_CAND_SCHEMA = "g string, b long, us long, ue long, ds long, c0 long, c1 long"


def steep_areas(r: np.ndarray, after: np.ndarray, xi: float, gap: int, plot: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """Maximal steep areas ``(start, end, is_down)`` in plot order.

    ``r`` holds the reachability, ``after`` that of the next position. An area
    joins steep points with at most ``gap`` flat ones in between and no step in
    the other direction. ``plot`` tells several plots behind each other apart.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = r / after
    areas = []
    for steep, against, is_down in (
        (ratio >= 1 / (1 - xi), ratio < 1, True),
        (ratio <= 1 - xi, ratio > 1, False),
    ):
        at = np.flatnonzero(steep)
        if not len(at):
            continue
        turns = np.cumsum(against)
        fresh = np.append(True, (np.diff(at) - 1 > gap) | (np.diff(turns[at]) > 0))
        if plot is not None:
            fresh[1:] |= np.diff(plot[at]) > 0
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(at)) - 1
        areas += [(s, e, is_down) for s, e in zip(at[first].tolist(), at[last].tolist())]
    return sorted(areas)


class _Down:
    """A steep-down area that may still begin a cluster."""

    __slots__ = ("start", "end", "mib", "heights")

    def __init__(self, start: int, end: int, mib: float, heights) -> None:
        self.start, self.end, self.mib, self.heights = start, end, mib, heights


def _cluster_span(down: _Down, us: int, ue: int, level: float, r, pred, base: int, xi: float, min_size: int):
    """Start and end of the cluster between a down and an up area, or None.

    ``r`` and ``pred`` cover the block from position ``base`` on.
    """
    keep = 1 - xi
    c0, c1, top = down.start, ue, down.heights[0]
    if top * keep >= level:
        while c0 < down.end and down.heights[c0 + 1 - down.start] > level:
            c0 += 1
    elif level * keep >= top:
        while c1 > us and r[c1 - 1 - base] > top:
            c1 -= 1
    # shrink until the end was reached from inside the cluster
    while c1 >= us and c1 > c0:
        if down.heights[c0 - down.start] > r[c1 - base] or pred[c1 - base] >= c0:
            break
        c1 -= 1
    else:
        return None
    return (c0, c1) if c1 - c0 + 1 >= min_size else None


def _peaks(r: np.ndarray, areas: list, first: np.ndarray) -> list[float]:
    """Highest point from the end of the area before, or from the plot's ``first`` position, to the start of each area."""
    if not areas:
        return []
    bounds = np.array([(s, e) for s, e, _ in areas])
    since = np.maximum(np.append(0, bounds[:-1, 1] + 1), first)
    spans = np.stack([since, bounds[:, 0] + 1], axis=1).ravel()
    return np.maximum.reduceat(np.append(r, -np.inf), spans)[::2].tolist()


def _walk(areas: list, peaks: list, downs: list[_Down], r: list, after: list, pred: list, base: int, xi: float, min_size: int, want_open: bool):
    """Candidate clusters along the steep areas, and the down areas left open.

    Per up area only the latest valid down area matters: all clusters of an up
    area overlap, and so does any later cluster that begins before one taken.
    """
    keep, found = 1 - xi, []
    for (s, e, is_down), peak in zip(areas, peaks):
        still = []
        for d in downs:
            d.mib = max(d.mib, peak)
            if d.mib <= d.heights[0] * keep and d.mib != np.inf:
                still.append(d)
        downs = still
        if is_down:
            downs.append(_Down(base + s, base + e, 0.0, r[s : e + 1]))
        elif not want_open:
            level = after[e]
            for d in reversed(downs):
                if d.mib > level * keep:
                    break  # earlier areas span even higher points
                span = _cluster_span(d, base + s, base + e, level, r, pred, base, xi, min_size)
                if span:
                    found.append((base + s, base + e, d.start, *span))
                    break
    return found, downs


def _scan(block: pd.DataFrame, incoming: list[_Down], xi: float, gap: int, min_size: int, want_open: bool):
    """Candidate clusters of one block, or the areas it leaves open."""
    block = block.sort_values("pos", ignore_index=True)
    r, after = block["r"].to_numpy(), block["after"].to_numpy()
    areas = steep_areas(r, after, xi, gap)
    plot = (r.tolist(), after.tolist(), block["pred"].tolist(), int(block["pos"].iloc[0]))
    found, downs = _walk(areas, _peaks(r, areas, np.zeros(len(areas), dtype=np.int64)), list(incoming), *plot, xi, min_size, want_open)
    if not want_open:
        return found
    since = areas[-1][1] + 1 if areas else 0
    if since < len(r):
        peak = r[since:].max()
        for d in downs:
            d.mib = max(d.mib, peak)
    return [d for d in downs if d.mib <= d.heights[0] * (1 - xi)], float(r.max())


def _pick(found: list, last: int) -> list:
    """Disjoint clusters in plot order, given the end of the last one taken before."""
    taken = []
    for us, ue, ds, c0, c1 in found:
        if ds > last:
            taken.append((c0, c1))
            last = ue
    return taken


# --- one block per group --------------------------------------------------


def _label_group(pdf: pd.DataFrame, xi: float, gap: int, min_size: int) -> pd.DataFrame:
    pdf = pdf.sort_values("pos", ignore_index=True)
    pdf["after"] = np.append(pdf["r"].to_numpy()[1:], np.inf)
    labels = np.full(len(pdf), -1, dtype=np.int32)
    for label, (c0, c1) in enumerate(_pick(_scan(pdf, [], xi, gap, min_size, False), -1)):
        labels[c0 : c1 + 1] = label
    return pd.DataFrame({"g": pdf["g"], "pos": pdf["pos"], "cluster_id": labels})


def label_plots(r: np.ndarray, pred: np.ndarray, sizes: np.ndarray, xi: float, gap: int, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels of several plots behind each other, ``sizes`` long, and the number of clusters in each.

    ``pred`` counts through all of them.
    """
    ends = np.cumsum(sizes)
    after = np.append(r[1:], np.inf)
    after[ends - 1] = np.inf
    plot = np.repeat(np.arange(len(sizes)), sizes)
    areas = steep_areas(r, after, xi, gap, plot)
    of = plot[[s for s, _, _ in areas]] if areas else np.zeros(0, dtype=np.int64)
    peaks = _peaks(r, areas, (ends - sizes)[of])
    marks, counts = np.zeros(len(r) + 1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    whole = (r.tolist(), after.tolist(), pred.tolist(), 0)
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(of) > 0)), len(of)) if areas else [0]
    for i, j in zip(cuts[:-1], cuts[1:]):
        taken = _pick(_walk(areas[i:j], peaks[i:j], [], *whole, xi, min_size, False)[0], -1)
        for label, (c0, c1) in enumerate(taken, 1):
            marks[c0] += label
            marks[c1 + 1] -= label
        counts[of[i]] = len(taken)
    return np.cumsum(marks[:-1]) - 1, counts


# --- many blocks per group ------------------------------------------------


def _find_cut(pdf: pd.DataFrame, xi: float, gap: int, block: int) -> pd.DataFrame:
    """First position of a fixed block at which no steep area is under way."""
    pdf = pdf.sort_values("pos", ignore_index=True)
    pos = pdf["pos"].to_numpy()
    inside = np.zeros(len(pos), dtype=bool)
    for s, e, _ in steep_areas(pdf["r"].to_numpy(), pdf["after"].to_numpy(), xi, gap):
        inside[s + 1 : e + 1] = True
    blk = int(pdf["blk"].iloc[0])
    free = np.flatnonzero(~inside & (pos // block == blk))
    return pd.DataFrame({"g": pdf["g"].iloc[:1], "blk": [blk], "cut": [pos[free[0]] if len(free) else -1]})


def _open_areas(pdf: pd.DataFrame, xi: float, gap: int, min_size: int) -> pd.DataFrame:
    """Areas a block leaves open; a first row without start carries its peak."""
    downs, peak = _scan(pdf, [], xi, gap, min_size, True)
    rows = [(None, None, None, None)] + [(d.start, d.end, d.mib, d.heights) for d in downs]
    out = pd.DataFrame(rows, columns=["start", "end", "mib", "heights"]).astype({"start": "Int64", "end": "Int64"})
    out.insert(0, "peak", peak)
    out.insert(0, "b", int(pdf["b"].iloc[0]))
    out.insert(0, "g", pdf["g"].iloc[0])
    return out


def _hand_over(pdf: pd.DataFrame, xi: float) -> pd.DataFrame:
    """Open areas each block receives, from the summaries of all blocks of a group."""
    downs: list[_Down] = []
    rows = []
    for b, part in pdf.sort_values(["b", "start"], na_position="first").groupby("b", sort=True):
        rows += [(int(b), d.start, d.end, d.mib, d.heights) for d in downs]
        peak = part["peak"].iloc[0]
        for d in downs:
            d.mib = max(d.mib, peak)
        downs = [d for d in downs if d.mib <= d.heights[0] * (1 - xi)]
        for _, x in part[part["start"].notna()].iterrows():
            downs.append(_Down(int(x["start"]), int(x["end"]), float(x["mib"]), list(x["heights"])))
    out = pd.DataFrame(rows, columns=["b", "start", "end", "mib", "heights"])
    out.insert(1, "peak", np.nan)
    out.insert(0, "g", pdf["g"].iloc[0])
    return out


def _block_candidates(pdf: pd.DataFrame, opened: pd.DataFrame, xi: float, gap: int, min_size: int) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame(columns=["g", "b", "us", "ue", "ds", "c0", "c1"])
    opened = opened.sort_values("start")
    downs = [_Down(int(x.start), int(x.end), float(x.mib), list(x.heights)) for x in opened.itertuples()]
    out = pd.DataFrame(_scan(pdf, downs, xi, gap, min_size, False), columns=["us", "ue", "ds", "c0", "c1"])
    out.insert(0, "b", int(pdf["b"].iloc[0]))
    out.insert(0, "g", pdf["g"].iloc[0])
    return out


def _transitions(pdf: pd.DataFrame) -> pd.DataFrame:
    """How a block's choice depends on the last cluster end before it.

    One row ``(upto, last, taken)`` per case: for an incoming end below ``upto``
    (and not below the smaller ones) the block takes ``taken`` clusters, the last
    ending at ``last``. Only starts before the block tell cases apart.
    """
    pdf = pdf.sort_values("us", ignore_index=True)
    us, ue, ds = (pdf[c].to_numpy() for c in ("us", "ue", "ds"))
    n = len(pdf)
    follow: dict[int, tuple[int, int]] = {}

    def run(k: int) -> tuple[int, int]:
        chain = []
        while k < n and k not in follow:
            chain.append(k)
            nxt = k + 1
            while nxt < n and ds[nxt] <= ue[k]:
                nxt += 1
            k = nxt
        last, taken = follow[k] if k < n else (-1, 0)
        for c in reversed(chain):
            last, taken = (last if taken else int(ue[c])), taken + 1
            follow[c] = (last, taken)
        return last, taken

    rows, reach = [], -1
    for k in range(n):
        if ds[k] > reach:  # first choice for every incoming end from `reach` up to this start
            rows.append((int(ds[k]), *run(k)))
            reach = int(ds[k])
            if ds[k] >= us[0]:
                break  # starts inside the block: taken whatever came before
    out = pd.DataFrame(rows, columns=["upto", "last", "taken"])
    out.insert(0, "b", int(pdf["b"].iloc[0]))
    out.insert(0, "g", pdf["g"].iloc[0])
    return out


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Last cluster end and number of clusters before each block of a group."""
    last, count, rows = -1, 0, []
    for b, part in pdf.sort_values(["b", "upto"]).groupby("b", sort=True):
        rows.append((int(b), last, count))
        case = part[part["upto"] > last]
        if len(case):
            last, count = int(case["last"].iloc[0]), count + int(case["taken"].iloc[0])
    out = pd.DataFrame(rows, columns=["b", "last", "count"])
    out.insert(0, "g", pdf["g"].iloc[0])
    return out


def _number(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("us")
    found = list(pdf[["us", "ue", "ds", "c0", "c1"]].itertuples(index=False, name=None))
    taken = _pick(found, int(pdf["last"].iloc[0]))
    out = pd.DataFrame(taken, columns=["c0", "c1"])
    out["cluster_id"] = np.arange(len(out)) + int(pdf["count"].iloc[0])
    out.insert(0, "g", pdf["g"].iloc[0])
    return out


def _spread(points: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    points = points.sort_values("pos", ignore_index=True)
    labels = np.full(len(points), -1, dtype=np.int32)
    if len(points) and len(spans):
        pos = points["pos"].to_numpy()
        for c0, c1, label in spans[["c0", "c1", "cluster_id"]].itertuples(index=False, name=None):
            labels[np.searchsorted(pos, c0) : np.searchsorted(pos, c1, side="right")] = label
    return pd.DataFrame({"g": points["g"], "pos": points["pos"], "cluster_id": labels})


def _long_labels(plot: DataFrame, xi: float, gap: int, min_size: int, block: int) -> DataFrame:
    ahead = plot.select("g", (F.col("pos") - 1).alias("pos"), F.col("r").alias("after"))
    plot = materialize(
        plot.join(ahead, ["g", "pos"], "left")
        .withColumn("after", F.coalesce("after", F.lit(float("inf"))))
        .withColumn("blk", F.floor(F.col("pos") / block).cast("long"))
    )
    halo = gap + 2
    near = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-halo, 0, halo)]), lambda d: F.floor((F.col("pos") + d) / block).cast("long")))
    cuts = (
        plot.withColumn("blk", F.explode(near))
        .groupBy("g", "blk")
        .applyInPandas(lambda pdf: _find_cut(pdf, xi, gap, block), "g string, blk long, cut long")
        .filter("cut >= 0")
    )
    # one row per block: a block starts at its cut, or joins the one before
    blocks = Window.partitionBy("g").orderBy("blk")
    spans = materialize(cuts.withColumn("before", F.lag("blk").over(blocks)))
    every = plot.groupBy("g", "blk").agg(F.lit(1).alias("_")).drop("_").join(spans, ["g", "blk"], "left")
    every = every.withColumn("before", F.coalesce("before", F.last("blk", True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))))
    plot = materialize(
        plot.join(F.broadcast(materialize(every)), ["g", "blk"])
        .withColumn("b", F.when(F.col("pos") >= F.col("cut"), F.col("blk")).otherwise(F.col("before")))
        .drop("cut", "before")
    )
    opened = plot.groupBy("g", "b").applyInPandas(lambda pdf: _open_areas(pdf, xi, gap, min_size), _OPEN_SCHEMA)
    incoming = opened.groupBy("g").applyInPandas(lambda pdf: _hand_over(pdf, xi), _OPEN_SCHEMA)  # block summaries only
    found = materialize(
        plot.groupBy("g", "b")
        .cogroup(materialize(incoming).groupBy("g", "b"))
        .applyInPandas(lambda pdf, open_: _block_candidates(pdf, open_, xi, gap, min_size), _CAND_SCHEMA)
    )
    cases = found.groupBy("g", "b").applyInPandas(_transitions, "g string, b long, upto long, last long, taken long")
    state = cases.groupBy("g").applyInPandas(_chain, "g string, b long, last long, count long")  # block summaries only
    chosen = (
        found.join(F.broadcast(materialize(state)), ["g", "b"])
        .groupBy("g", "b")
        .applyInPandas(_number, "g string, c0 long, c1 long, cluster_id int")
    )
    pieces = chosen.withColumn(
        "blk", F.explode(F.sequence(F.floor(F.col("c0") / block).cast("long"), F.floor(F.col("c1") / block).cast("long")))
    )
    return plot.select("g", "pos", "blk").groupBy("g", "blk").cogroup(pieces.groupBy("g", "blk")).applyInPandas(_spread, LABEL_SCHEMA)


def xi_labels(plot: DataFrame, xi: float, min_samples: int, min_size: int, block: int = PLOT_BLOCK) -> DataFrame:
    """``(g, pos, cluster_id)`` for a plot ``(g, pos, r, pred)``; -1 is noise.

    Positions are dense from 0 per group; ``r`` is infinite at 0, ``pred`` is the
    position of the predecessor (-1 at 0).
    """
    longest = plot.agg(F.max("pos")).first()[0]
    if longest is None or longest < block:
        # by number, not by size: small rows of many groups are much work
        return plot.repartition(tasks(plot, 1 << 20), "g").groupBy("g").applyInPandas(lambda pdf: _label_group(pdf, xi, min_samples, min_size), LABEL_SCHEMA)
    return _long_labels(plot, xi, min_samples, min_size, block)
