"""Hard negatives by slots: one scan answers the overlapping score windows of all of an anchor's positives.

An anchor's positives are its best rows of the same label. Each of them asks for
the best rows of another label whose score lies in a window: ``low`` to ``high``
hundredths of its own score. The windows' upper limits, descending, split all
scores into disjoint slots, so a candidate falls in one slot of an anchor and is
compared and sent once, however many windows hold it. Tasks keep the best
``negatives`` of each slot while they scan (the combiner); slots are merged by
key; then, from the lowest slot up, each slot's rows are put before what is kept
of the slots below (a suffix merge), which leaves for every window its best rows
below the upper limit. Rows under the lower limit are the tail of that list and
are cut off.

Lower limits fall with upper ones. So a score under the lower limit of its own
slot's window is under those of all windows that hold the slot, and isn't kept.

Anchors are taken in blocks of at most ``ANCHOR_BLOCK`` and ``BLOCK_NUMBERS``
components, which are sent to the scanning tasks with their limits; the work is anchors times rows, as asked for.

Edge cases: rows with a NULL id, label or vector, or with a NULL or non-finite
component (also one that leaves the range of a double when scaled), take no part,
neither do anchors among them. Rows of an anchor's own id are never its
candidates. Repeated rows of one id, label and vector count once; an id with
several vectors is several rows, and several anchors. Only vectors of an anchor's
length are its candidates. Ties go to the smaller id. Scores are exact whatever
the components; beyond 64 bits they count as the nearest 64-bit number. An empty
table, or one without anchors, positives or negatives, gives no rows. Further
columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize

ANCHOR_BLOCK = 4_096
BLOCK_NUMBERS = 1 << 20
CHUNK = 1_000_000  #: scores held at a time in a task
_EXACT = 2.0**53
_LONG = np.iinfo(np.int64)
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def labelled_vectors(table: DataFrame, label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """vec_id, label, vec (``floor(scale * x)`` of every component, as doubles without fractions) of the rows that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * scale)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < _EXACT, F.floor(v).cast("double")).otherwise(v))  # larger doubles are whole
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.when(F.coalesce(usable, F.lit(False)), whole).alias("vec"),
    )
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").distinct()


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole doubles, as 64-bit integers."""
    dims = max(1, a.shape[1])
    most = np.abs(a).max(initial=0.0)
    size = np.abs(b).max(axis=1, initial=0.0)
    small = size * most * dims < _EXACT
    if small.all():
        return np.rint(a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), dtype=np.int64)
    out[:, small] = np.rint(a @ b[small].T).astype(np.int64)
    left = [[int(v) for v in row] for row in a]
    for j in np.flatnonzero(~small).tolist():
        right = [int(v) for v in b[j]]
        out[:, j] = [min(max(sum(u * v for u, v in zip(row, right)), _LONG.min), _LONG.max) for row in left]
    return out


class _Best:
    """The ``k`` best (highest score, then smallest id) of each key met so far."""

    def __init__(self, keys: int, k: int) -> None:
        self.k = k
        self.kth = np.full(keys, _LONG.min)
        self.rows = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        good = score >= self.kth[key]
        key, score, vec_id = (np.concatenate((a, b[good])) for a, b in zip(self.rows, (key, score, vec_id)))
        order = np.lexsort((vec_id, ~score, key))
        key, score, vec_id = key[order], score[order], vec_id[order]
        first = np.searchsorted(key, key)
        place = np.arange(len(key)) - first
        full = place == self.k - 1
        self.kth[key[full]] = score[full]
        kept = place < self.k
        self.rows = key[kept], score[kept], vec_id[kept]


def _scanned(rows: DataFrame, sent, k: int, keys: int, chosen) -> DataFrame:
    """(key, score, vec_id): each task's ``k`` best of every key; ``chosen`` says which scores of a chunk belong to which key."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = sent.value
        best = _Best(keys, k)
        step = max(1, CHUNK // max(1, len(block["ids"])))
        dims = block["vecs"].shape[1]
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                ids, labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
                vecs = np.stack(part["vec"].to_list()) if dims else np.zeros((len(part), 0))
                scores = exact_scores(block["vecs"], vecs)
                other = block["ids"][:, None] != ids
                same = block["labels"][:, None] == labels
                a, i, key = chosen(block, scores, other, same)
                best.add(key, scores[a, i], ids[i])
        yield pd.DataFrame(dict(zip(("key", "score", "vec_id"), best.rows)))

    return rows.select("vec_id", "label", "vec").mapInPandas(scan, "key long, score long, vec_id long")


def _merged(best: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("n", order).filter(F.col("n") <= k)


def _same_label(block: dict, scores: np.ndarray, other: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
    a, i = np.nonzero(other & same)
    return a, i, a


def _in_slot(block: dict, scores: np.ndarray, other: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
    """The slot is the last window whose upper limit reaches the score."""
    a, i = np.nonzero(other & ~same & (scores <= block["upper"][:, :1]))
    score = scores[a, i]
    slot = (score[:, None] <= block["upper"][a]).sum(axis=1) - 1
    good = score >= block["lower"][a, slot]
    a, i, slot = a[good], i[good], slot[good]
    return a, i, a * block["upper"].shape[1] + slot


def _limits(positives: list, anchors: int, slots: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the windows, by anchor in descending order; places without a positive hold no score."""
    lower = np.full((anchors, slots), _LONG.max)
    upper = np.full((anchors, slots), _LONG.min)
    for r in positives:
        lower[r["key"], r["n"] - 1] = -(-low * r["score"] // 100)
        upper[r["key"], r["n"] - 1] = high * r["score"] // 100
    return lower, upper


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and vec as from ``labelled_vectors``; ``anchors`` are some of its rows.
    Limits are whole hundredths with 0 <= ``low`` <= ``high`` <= 100.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("windows need 0 <= low <= high <= 100")
    spark = vectors.sparkSession
    rows = materialize(vectors.withColumn("dim", F.size("vec")))
    asked = materialize(anchors.select("vec_id", "label", "vec").distinct().withColumn("dim", F.size("vec")).withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(2**31 - 1))))
    found = None
    for dim, count in sorted((r["dim"], r["count"]) for r in asked.groupBy("dim").count().collect()):
        own = rows.filter(F.col("dim") == dim)
        size = max(1, min(block, BLOCK_NUMBERS // max(1, dim)))
        blocks = -(-2 * count // size) if count > size else 1
        for b in range(blocks):
            taken = asked.filter((F.col("dim") == dim) & (F.col("part") % blocks == b)).collect()  # about half of ANCHOR_BLOCK, or less
            if not taken:
                continue
            n = len(taken)
            matrix = np.array([r["vec"] for r in taken], dtype=np.float64).reshape(n, dim)
            held = {"ids": np.array([r["vec_id"] for r in taken]), "labels": np.array([r["label"] for r in taken]), "vecs": matrix}
            best = _merged(_scanned(own, spark.sparkContext.broadcast(held), positives, n, _same_label), positives)
            matched = best.collect()  # `positives` rows an anchor of the block
            lower, upper = _limits(matched, n, positives, low, high)
            sent = spark.sparkContext.broadcast(held | {"lower": lower, "upper": upper})
            slots = materialize(_merged(_scanned(own, sent, negatives, n * positives, _in_slot), negatives))
            names = held["ids"].tolist()
            windows = [(r["key"], names[r["key"]], r["n"] - 1, r["vec_id"], r["score"], int(lower[r["key"], r["n"] - 1])) for r in matched]
            asks = spark.createDataFrame(windows, "a long, anchor_id long, w int, positive_id long, positive_score long, lower long")
            part = _answers(slots, asks, positives, negatives)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], _OUT) if found is None else found


def _answers(slots: DataFrame, asks: DataFrame, positives: int, negatives: int) -> DataFrame:
    """For every window (a, w) its best rows: suffix merges of an anchor's slots, which hold ``positives * negatives`` rows at most."""
    kept = slots.select(
        F.floor(F.col("key") / positives).alias("a"),
        F.struct((F.col("key") % positives).cast("int").alias("slot"), "n", F.col("vec_id").alias("id"), "score").alias("x"),
    )
    gathered = kept.groupBy("a").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    kind = f"array<array<{gathered.schema['xs'].dataType.elementType.simpleString()}>>"

    def merged(suffixes: Column, slot: Column) -> Column:
        own = F.filter("xs", lambda x: x["slot"] == slot)
        below = F.coalesce(F.get(suffixes, F.lit(0)), F.filter("xs", lambda x: F.lit(False)))
        return F.concat(F.array(F.slice(F.concat(own, below), 1, negatives)), suffixes)

    suffixes = F.aggregate(F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)), F.array().cast(kind), merged)
    answers = gathered.select("a", F.posexplode(suffixes).alias("w", "best"))
    return (
        asks.join(answers, ["a", "w"])
        .select("*", F.posexplode(F.filter("best", lambda x: x["score"] >= F.col("lower"))).alias("i", "x"))
        .select("anchor_id", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
    )
