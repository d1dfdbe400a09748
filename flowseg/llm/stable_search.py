"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square stopping test.

Inner products become distances: within a band of lengths (an octave around a power
of two, whose longest vector has length M) every vector gets one more coordinate that fills it
up to length M, and a query is stretched to length M. The squared distance is
then 2 M (M - s) with s the product with the query of length 1, so near means large.

A Gaussian projection to ``AXES`` coordinates is 2-stable: the squared projected
distance of two vectors over their squared distance is chi-square with ``AXES``
degrees of freedom. A kd-tree over the projections gives a query's neighbours
there in order. They are verified with their own vectors until the next one's
squared projected distance exceeds ``quantile(CONFIDENCE)`` times the squared distance
of the k-th best verified so far: whatever is nearer than that one has been met by
then with a probability of at least ``CONFIDENCE``.

The upper levels of the tree are cut from a sample of about ``SAMPLE`` rows a
length and band (a share of all by hash) into at most ``CELLS`` cells; every row is
filed. A cell is split by hash into pieces of about ``PIECE_BYTES``, so copies of one
vector may fill a cell but not a task. A piece is one row of the index table: ids, vectors,
projections in leaf order and the leaves' boxes. Queries are sent in blocks of at
most ``QUERY_BLOCK`` and ``BLOCK_NUMBERS`` components. A first pass finds each query's nearest piece by its box and
the k best there; with that bound, the second pass opens only pieces and leaves
within the stopping radius, nearest first. Tasks emit the k best a query.

Edge cases: rows with a NULL id, and vectors that are NULL, zero or hold NULL or
non-finite components, or whose length is not finite, take no part, neither as
queries nor as candidates. Only vectors with a query's number of components are its
candidates. Repeated rows of one id and vector are one candidate, and a query once;
a query's own id is never its candidate. Scores are computed from the original
vectors, equal vectors get equal scores, and ties go to the smaller id. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize

AXES = 8
CONFIDENCE = 0.97
SAMPLE = 16_384
CELLS = 1_024
PIECE_BYTES = 2 << 20
LEAF = 64
QUERY_BLOCK = 4_096
BLOCK_NUMBERS = 1 << 20
SEED = 42
_FIRST_LEAVES = 4
_PIECE = (
    "dim int, band int, top double, piece long, low array<double>, high array<double>, "
    "ids binary, vecs binary, points binary, starts binary, lows binary, highs binary"
)
_FOUND = "q long, vec_id long, score double"


def quantile(p: float, axes: int = AXES) -> float:
    """The p-quantile of chi-square with an even number of degrees of freedom."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, axes // 2):
            term *= x / 2 / i
            total += term
        return 1.0 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(dim: int, axes: int = AXES) -> np.ndarray:
    """The projection of ``dim`` components and the filling one, the same in every task."""
    return np.random.default_rng((SEED, dim)).standard_normal((dim + 1, axes))


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id, vec, dim, size (length) and band (its octave) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), F.transform(x, lambda v: v + 0.0)).alias("vec"))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    sized = rows.filter("vec_id IS NOT NULL AND vec IS NOT NULL").distinct().withColumn("dim", F.size("vec")).withColumn("size", size)
    return sized.filter((F.col("size") > 0) & (F.col("size") < float("inf"))).withColumn("band", F.floor(F.log2("size") + 0.5).cast("int"))


def _projected(vecs: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Projections of vectors, filled up to length ``top``."""
    filled = np.sqrt(np.maximum(top**2 - (vecs**2).sum(axis=1), 0.0))
    made = directions(vecs.shape[1])
    return vecs @ made[:-1] + filled[:, None] * made[-1]


def _cuts(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """The tree's upper levels as a heap of (axis, value): the widest axis is cut in the middle; a level has twice the cells."""
    heap: list[tuple[int, float]] = []
    level = [points]
    while len(level) < cells:
        following = []
        for part in level:
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            heap.append((axis, value))
            right = part[:, axis] > value if len(part) else np.zeros(0, dtype=bool)
            following += [part[~right], part[right]]
        level = following
    return heap


def _cell_of(points: np.ndarray, heap: list[tuple[int, float]]) -> np.ndarray:
    """Cell numbers by descent."""
    at = np.zeros(len(points), dtype=np.int64)
    if not heap:
        return at
    axes, values = np.array([h[0] for h in heap]), np.array([h[1] for h in heap])
    for _ in range((len(heap) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] > values[at])
    return at - len(heap)


def _leaves(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[int]]:
    """Row order and starts of the leaves of a kd-tree that cuts the widest axis in the middle."""
    order, starts, open_parts = [], [0], [np.arange(len(points))]
    while open_parts:
        rows = open_parts.pop()
        if len(rows) <= leaf:
            order.append(rows)
            starts.append(starts[-1] + len(rows))
            continue
        axis = np.argmax(np.ptp(points[rows], axis=0))
        rows = rows[np.argsort(points[rows, axis], kind="stable")]
        open_parts += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return np.concatenate(order), starts


def _piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of the index."""
    first = pdf.iloc[0]
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    points = np.stack(pdf["point"].to_list())
    order, starts = _leaves(points)
    points, at = points[order], starts[:-1]
    lows, highs = np.minimum.reduceat(points, at), np.maximum.reduceat(points, at)
    packed = {
        "dim": first["dim"], "band": first["band"], "top": first["top"], "piece": first["piece"],
        "low": lows.min(axis=0), "high": highs.max(axis=0),
        "ids": pdf["vec_id"].to_numpy()[order].tobytes(), "vecs": np.stack(pdf["vec"].to_list())[order].tobytes(),
        "points": points.tobytes(), "starts": np.array(starts, dtype=np.int64).tobytes(), "lows": lows.tobytes(), "highs": highs.tobytes(),
    }
    return pd.DataFrame({k: [v] for k, v in packed.items()})


def build_index(vectors: DataFrame) -> DataFrame:
    """The index table of ``usable_vectors``: one row a piece. It can be stored and searched by any number of queries."""
    vectors = materialize(vectors)
    tops = materialize(vectors.groupBy("dim", "band").agg(F.max("size").alias("top"), F.count("*").alias("n")))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["point"] = None
            for _, at in rows.groupby("dim").indices.items():
                made = _projected(np.stack(rows["vec"].iloc[at].to_list()), rows["top"].to_numpy()[at])
                rows.iloc[at, rows.columns.get_loc("point")] = pd.Series(list(made), index=rows.index[at])
            yield rows

    schema = "vec_id long, vec array<double>, dim int, band int, top double, n long, point array<double>"
    placed = materialize(vectors.join(tops, ["dim", "band"]).select("vec_id", "vec", "dim", "band", "top", "n").mapInPandas(project, schema))

    drawn = F.pmod(F.xxhash64("vec_id", "point"), F.lit(1 << 40))
    sample = placed.filter(drawn * F.col("n") < F.lit(SAMPLE) * F.lit(float(1 << 40)))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = int(pdf["n"].iloc[0]) * int(pdf["dim"].iloc[0]) * 8 // PIECE_BYTES
        cells = min(CELLS, 1 << wanted.bit_length(), max(1, len(pdf) // 16))
        heap = _cuts(np.stack(pdf["point"].to_list()), 1 << (cells.bit_length() - 1))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "band": [pdf["band"].iloc[0]], "axes": [[h[0] for h in heap]], "values": [[h[1] for h in heap]]})

    trees = materialize(sample.select("dim", "band", "n", "point").groupBy("dim", "band").applyInPandas(cut, "dim int, band int, axes array<int>, values array<double>"))

    @F.pandas_udf("long")
    def cell(points: pd.Series, axes: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros(len(points), dtype=np.int64)
        groups: dict[bytes, list[int]] = {}
        for i, (a, v) in enumerate(zip(axes, values)):
            groups.setdefault(np.asarray(a).tobytes() + np.asarray(v).tobytes(), []).append(i)
        for at in groups.values():
            heap = list(zip(axes.iloc[at[0]], values.iloc[at[0]]))
            out[at] = _cell_of(np.stack(points.iloc[at].to_list()), heap)
        return pd.Series(out)

    filed = materialize(placed.join(trees, ["dim", "band"]).withColumn("cell", cell("point", "axes", "values")).drop("axes", "values", "n"))
    sizes = materialize(filed.groupBy("dim", "band", "cell").agg(F.count("*").alias("rows")))
    pieces = F.ceil(F.col("rows") * F.col("dim") * 8 / PIECE_BYTES)
    split = filed.join(sizes, ["dim", "band", "cell"]).withColumn(
        "piece", F.xxhash64("dim", "band", "cell", F.pmod(F.xxhash64("vec_id", "vec"), pieces))
    )
    return materialize(split.groupBy("dim", "band", "top", "piece").applyInPandas(_piece, _PIECE))


class _Piece:
    """A row of the index, unpacked."""

    def __init__(self, row) -> None:
        self.top = row.top
        self.ids = np.frombuffer(row.ids, dtype=np.int64)
        self.vecs = np.frombuffer(row.vecs).reshape(-1, row.dim)
        self.points, self.lows, self.highs = (np.frombuffer(x).reshape(-1, AXES) for x in (row.points, row.lows, row.highs))
        self.starts = np.frombuffer(row.starts, dtype=np.int64)


def _box_distance(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes (boxes by row)."""
    away = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0.0)
    return (away**2).sum(axis=2)


def _radius(stop: float, top: float, kth: float, length: float) -> float:
    """Squared projected distance beyond which a query of this length stops; a little wider than its bound, for rounded coordinates."""
    return stop * 2 * top * (max(top - kth / length, 0.0) + 1e-9 * top) if kth > -np.inf else np.inf


def _search(piece: _Piece, vec: np.ndarray, point: np.ndarray, own_id: int, length: float, kth: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a piece's rows that may be among the ``k`` best; ``kth`` is a bound known before."""
    nearest = _box_distance(piece.lows, piece.highs, point[None])[0]
    order = np.argsort(nearest, kind="stable")
    ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
    at, step = 0, _FIRST_LEAVES
    while at < len(order):
        radius = _radius(stop, piece.top, kth, length)
        opened = [j for j in order[at : at + step] if nearest[j] <= radius]
        if not opened:
            break
        rows = np.concatenate([np.arange(piece.starts[j], piece.starts[j + 1]) for j in opened])
        if radius < np.inf:
            rows = rows[((piece.points[rows] - point) ** 2).sum(axis=1) <= radius]
        rows = rows[piece.ids[rows] != own_id]
        exact = (piece.vecs[rows] * vec).sum(axis=1)
        good = exact >= kth
        ids, scores = np.concatenate((ids, piece.ids[rows[good]])), np.concatenate((scores, exact[good]))
        if len(ids) >= k:
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            kth = max(kth, scores[-1])
        at, step = at + step, step * 2
    return ids, scores


def _points_for(queries: dict, top: float) -> np.ndarray:
    """Projections of the queries at length ``top``."""
    scale = (top / queries["sizes"])[:, None]
    return (queries["vecs"] * scale) @ directions(queries["vecs"].shape[1])[:-1]


def _nearest_piece(index: DataFrame, sent) -> DataFrame:
    """For every query of the block its nearest piece among those of a task, by box."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = sent.value
        n = len(queries["ids"])
        best, name = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
        points: dict[float, np.ndarray] = {}
        for rows in batches:
            for row in rows.itertuples():
                if row.top not in points:
                    points = {row.top: _points_for(queries, row.top)}
                # a box of a shorter band is as far as its products are small
                far = _box_distance(np.asarray(row.low)[None], np.asarray(row.high)[None], points[row.top])[:, 0] / row.top**2
                closer = (far < best) | ((far == best) & (row.piece < name))
                best[closer], name[closer] = far[closer], row.piece
        met = np.flatnonzero(best < np.inf)
        yield pd.DataFrame({"q": met, "piece": name[met], "far": best[met]})

    found = index.select("top", "piece", "low", "high").mapInPandas(near, "q long, piece long, far double")
    return found.groupBy("q").agg(F.min(F.struct("far", "piece")).alias("m")).select("q", F.col("m.piece").alias("piece"))


def _scan(index: DataFrame, sent, k: int, stop: float) -> DataFrame:
    """(q, vec_id, score): each task's ``k`` best of every query of the block; a piece with ``asked`` is searched for these queries alone."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = sent.value
        n = len(queries["ids"])
        kth = queries["kth"].copy()
        held = {}
        for rows in batches:
            for row in rows.itertuples():
                piece, points = _Piece(row), _points_for(queries, row.top)
                asked = np.arange(n) if row.asked is None else np.asarray(row.asked)
                far = _box_distance(np.asarray(row.low)[None], np.asarray(row.high)[None], points[asked])[:, 0]
                for j, q in enumerate(asked.tolist()):
                    if far[j] > _radius(stop, row.top, kth[q], queries["sizes"][q]):
                        continue
                    ids, scores = _search(piece, queries["vecs"][q], points[q], queries["ids"][q], queries["sizes"][q], kth[q], k, stop)
                    if len(ids):
                        old = held.get(q, (ids[:0], scores[:0]))
                        ids, scores = np.concatenate((old[0], ids)), np.concatenate((old[1], scores))
                        best = np.lexsort((ids, -scores))[:k]
                        held[q] = ids[best], scores[best]
                        if len(best) == k:
                            kth[q] = max(kth[q], scores[best[-1]])
        for q, (ids, scores) in held.items():
            yield pd.DataFrame({"q": q, "vec_id": ids, "score": scores})

    columns = ["dim", "top", "low", "high", "ids", "vecs", "points", "starts", "lows", "highs", "asked"]
    return index.select(*columns).mapInPandas(scan, _FOUND)


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, confidence: float = CONFIDENCE, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of the index with the largest inner products found for every query.

    ``queries`` has the columns of ``usable_vectors``.
    """
    spark, stop = queries.sparkSession, quantile(confidence)
    asked = materialize(queries.select("vec_id", "vec", "dim", "size").distinct().withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(2**31 - 1))))
    found = None
    for dim, count in sorted((r["dim"], r["count"]) for r in asked.groupBy("dim").count().collect()):
        own = index.filter(F.col("dim") == dim)
        size = max(1, min(block, BLOCK_NUMBERS // dim))
        blocks = -(-2 * count // size) if count > size else 1
        for b in range(blocks):
            taken = asked.filter((F.col("dim") == dim) & (F.col("part") % blocks == b)).select("vec_id", "vec", "size").collect()  # about half of QUERY_BLOCK, or less
            if not taken:
                continue
            held = {"ids": np.array([r["vec_id"] for r in taken]), "vecs": np.array([r["vec"] for r in taken]), "sizes": np.array([r["size"] for r in taken])}
            held["kth"] = np.full(len(taken), -np.inf)
            sent = spark.sparkContext.broadcast(held)
            homes = _nearest_piece(own, sent).groupBy("piece").agg(F.collect_list("q").alias("asked"))
            first = _best(_scan(own.join(F.broadcast(homes), "piece"), sent, k, stop), k)  # homes has the block's queries, once each
            for r in first.groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k).collect():  # one row a query of the block
                held["kth"][r["q"]] = r["kth"]
            again = spark.sparkContext.broadcast(held)
            names = spark.createDataFrame(list(enumerate(held["ids"].tolist())), "q long, query_id long")
            best = materialize(_best(_scan(own.withColumn("asked", F.lit(None).cast("array<long>")), again, k, stop), k).join(names, "q"))
            part = best.select("query_id", F.col("n").alias("rank"), "vec_id", "score")
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("n", order).filter(F.col("n") <= k)
