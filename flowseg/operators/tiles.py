"""Lightest edges between components, by tiles: packed runs of blocks that meet in pairs.

Blocks that follow each other form a tile of bounded size, stored as one row. A task holds
two tiles at most, so what is shuffled grows with the pairs of tiles and not with
the vectors times the blocks that each of them has to ask. That matters in many
dimensions, where most blocks are near each other.

In a pair, bitmaps of the vectors below a few marks of each coordinate leave, by one
"and" a coordinate, those whose every coordinate is within the asking vector's radius or
nearly so. Exact distances are taken of these alone. The bitmaps only leave out what is too far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize
from flowseg.operators.blocks import gap, tasks

TILE = 16_384  # vectors
TILE_BYTES = 8 << 20  # of coordinates
EDGES = "g string, c long, to long, a long, b long, w double"
_MARKS = 64  # of a coordinate
_BATCH = 64  # asking vectors at a time
_FEW = 24  # vectors left, each, that are not filtered further
_NEAR = 1 << 20  # coordinates compared at a time
_PACK = (
    "g string, tile long, low array<double>, high array<double>, blow array<array<double>>, bhigh array<array<double>>, reach array<double>, "
    "x binary, single boolean, node binary, c binary, bound binary, fc array<long>, fto array<long>, fa array<long>, fb array<long>, fw array<double>"
)


def tile_rows(dims: int) -> int:
    return max(64, min(TILE, TILE_BYTES // (8 * max(dims, 1))))


def with_tiles(vectors: DataFrame, dims: int, rows: int | None = None) -> DataFrame:
    """``vectors`` with the number of their tile: blocks in order of their numbers, up to ``rows`` vectors and a block more."""
    sizes = vectors.groupBy("g", "blk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("blk")) - F.col("n")  # one row per block
    return vectors.join(sizes.select("g", "blk", F.floor(before / (rows or tile_rows(dims))).cast("long").alias("tile")), ["g", "blk"])


class _Bitmaps:
    """For every coordinate the vectors below each mark, as bits."""

    def __init__(self, y: np.ndarray):
        n, dims = y.shape
        self.marks, self.below = [], []
        places = np.unique(np.arange(1, _MARKS) * n // _MARKS)
        for k in range(dims):
            marks = np.unique(np.partition(y[:, k], places)[places])
            bins = np.searchsorted(marks, y[:, k], side="right").astype(np.int16)
            bits = np.packbits(bins[None, :] < np.arange(len(marks) + 2, dtype=np.int16)[:, None], axis=1, bitorder="little")
            padded = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
            padded[:, : bits.shape[1]] = bits
            self.marks.append(marks)
            self.below.append(padded.view(np.uint64))

    def near(self, x: np.ndarray, r: np.ndarray, without: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places (in ``x``, in the tile) of pairs that may lie within ``r``; ``without`` are bits to leave out."""
        slack = 4 * np.finfo(np.float64).eps * (np.abs(x) + r[:, None])
        low, high = x - r[:, None] - slack, x + r[:, None] + slack
        first = [np.searchsorted(m, low[:, k], side="right") for k, m in enumerate(self.marks)]
        last = [np.searchsorted(m, high[:, k], side="right") + 1 for k, m in enumerate(self.marks)]
        wide = [(last[k] - first[k]).sum() / (len(m) + 1) for k, m in enumerate(self.marks)]
        left = None
        for done, k in enumerate(np.argsort(wide, kind="stable").tolist()):
            part = self.below[k].take(last[k], axis=0)
            part ^= self.below[k].take(first[k], axis=0)
            if left is None:
                left = part
                for at, bits in enumerate(without):
                    if bits is not None:
                        left[at] &= ~bits
            else:
                left &= part
            if done % 8 == 7 and np.bitwise_count(left).sum() <= _FEW * len(x):
                break
        i, byte = np.nonzero(left.view(np.uint8))
        at, bit = np.nonzero(np.unpackbits(left.view(np.uint8)[i, byte][:, None], axis=1, bitorder="little"))
        return i[at], byte[at] * 8 + bit


def search(x: np.ndarray, nodes: np.ndarray, c: np.ndarray, bound: np.ndarray, y: np.ndarray, to_nodes: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    """(c, to, a, b, w): of every component of ``x`` its lightest edge to another one of ``y``, if not above the least bound of its vectors.

    A vector whose ``bound`` is NaN doesn't ask. Ties go to the smaller pair of nodes.
    """
    asks = np.flatnonzero(bound >= np.maximum(y.min(axis=0) - x, x - y.max(axis=0)).max(axis=1))
    found = []
    if len(asks):
        names, comp = np.unique(c[asks], return_inverse=True)
        best = np.full(len(names), np.inf)
        np.minimum.at(best, comp, bound[asks])
        bits = _Bitmaps(y)
        held, sizes = np.unique(d, return_counts=True)
        own = {}
        for name in held[sizes > max(64, len(d) // 256)]:  # 256 at most
            mask = np.zeros(bits.below[0].shape[1] * 64, dtype=np.uint8)
            mask[: len(d)] = d == name
            own[int(name)] = np.packbits(mask, bitorder="little").view(np.uint64)
        step = max(1, _NEAR // x.shape[1])
        for start in range(0, len(asks), _BATCH):
            rows, comps = asks[start : start + _BATCH], comp[start : start + _BATCH]
            i, j = bits.near(x[rows], best[comps], [own.get(int(name)) for name in c[rows]])
            other = c[rows][i] != d[j]
            i, j = i[other], j[other]
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                w = np.abs(x[rows[p]] - y[q]).max(axis=1)
                close = w <= best[comps[p]]
                p, q, w = p[close], q[close], w[close]
                np.minimum.at(best, comps[p], w)
                light = w <= best[comps[p]]
                p, q, w = rows[p[light]], q[light], w[light]
                found.append((c[p], d[q], np.minimum(nodes[p], to_nodes[q]), np.maximum(nodes[p], to_nodes[q]), w))
    empty = [np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0)]
    out = pd.DataFrame(dict(zip(["c", "to", "a", "b", "w"], map(np.concatenate, zip(empty, *found)))))
    return out.sort_values(["c", "w", "a", "b"]).drop_duplicates("c")


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile in one row, with its blocks' boxes of asking vectors and the lightest edges inside the tile."""
    pdf = pdf.sort_values(["blk", "node"], ignore_index=True)
    x, nodes, c = np.stack(pdf["arr"].to_numpy()), pdf["node"].to_numpy(), pdf["c"].to_numpy()
    bound = pdf["bound"].to_numpy(dtype="float64", na_value=np.nan)
    found = search(x, nodes, c, bound, x, nodes, c)
    best = pd.Series(c).map(found.set_index("c")["w"]).to_numpy(dtype="float64")
    bound = np.where(np.isnan(bound), np.nan, np.fmin(bound, best))
    bound[pdf["ext"].to_numpy() > bound] = np.nan  # nobody outside the block is as near
    asks = np.flatnonzero(~np.isnan(bound))
    starts = np.flatnonzero(np.diff(pdf["blk"].to_numpy()[asks], prepend=-1)) if len(asks) else asks
    boxes = [f.reduceat(x[asks], starts, axis=0).tolist() if len(asks) else [] for f in (np.minimum, np.maximum)]
    single = bool((x == x.astype(np.float32)).all())
    row = {
        "g": pdf["g"].iloc[0], "tile": pdf["tile"].iloc[0], "low": x.min(axis=0), "high": x.max(axis=0),
        "blow": boxes[0], "bhigh": boxes[1], "reach": np.maximum.reduceat(bound[asks], starts) if len(asks) else np.zeros(0),
        "x": x.astype(np.float32 if single else np.float64).tobytes(), "single": single,
        "node": nodes.tobytes(), "c": c.tobytes(), "bound": bound.tobytes(),
        "fc": found["c"].to_numpy(), "fto": found["to"].to_numpy(), "fa": found["a"].to_numpy(), "fb": found["b"].to_numpy(), "fw": found["w"].to_numpy(),
    }
    return pd.DataFrame([row])


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lightest edges between two tiles, from both of them."""
    sides = []
    for row in pdf.sort_values("tile").itertuples():
        nodes = np.frombuffer(row.node, dtype=np.int64)
        x = np.frombuffer(row.x, dtype=np.float32 if row.single else np.float64).reshape(len(nodes), -1).astype(np.float64)
        sides.append((x, nodes, np.frombuffer(row.c, dtype=np.int64), np.frombuffer(row.bound, dtype=np.float64)))
    one, two = sides
    out = pd.concat([search(*one, *two[:3]), search(*two, *one[:3])])
    out.insert(0, "g", pdf["g"].iloc[0])
    return out


def lightest_edges(vectors: DataFrame, met: list[int] | None = None) -> DataFrame:
    """(g, c, to, a, b, w): among them, of each component with an edge within its bound, the lightest one to another component.

    ``vectors`` (g, blk, tile, node, arr, c, ext, bound): a NULL ``bound`` doesn't ask, ``ext`` is the way out of
    the block. Inside the block, pairs may be left out where ``bound`` is known from a lightest edge of the block.
    ``met`` gets the number of pairs of tiles, each with itself among them.
    """
    n = tasks(vectors, 1 << 20)
    columns = vectors.select("g", "blk", "tile", "node", "arr", "c", "ext", "bound")
    packs = materialize(columns.repartition(n, "g", "tile").groupBy("g", "tile").applyInPandas(_packed, _PACK))
    here = packs.select("g", F.explode(F.arrays_zip("fc", "fto", "fa", "fb", "fw")).alias("f"))
    here = here.select("g", *[F.col(f"f.f{name}").alias(name) for name in ("c", "to", "a", "b", "w")])
    asking = packs.select("g", F.col("tile").alias("p"), F.explode(F.arrays_zip("blow", "bhigh", "reach")).alias("box"))
    asking = asking.select("g", "p", F.col("box.blow").alias("blow"), F.col("box.bhigh").alias("bhigh"), F.col("box.reach").alias("reach"))
    asked = packs.select("g", F.col("tile").alias("q"), "low", "high")
    pairs = asking.join(F.broadcast(asked), "g").filter((F.col("p") != F.col("q")) & (gap("blow", "bhigh", "low", "high") <= F.col("reach")))
    pairs = materialize(pairs.select("g", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct())
    if met is not None:
        met.append(pairs.count() + packs.count())
    sides = packs.select("g", "tile", "x", "single", "node", "c", "bound").join(
        F.broadcast(pairs.withColumn("tile", F.explode(F.array("p", "q")))), ["g", "tile"]
    )
    across = sides.repartition(n, "g", "p", "q").groupBy("g", "p", "q").applyInPandas(_met, EDGES)
    return here.unionByName(across)
