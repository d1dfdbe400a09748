"""Counts, means and co-moments of many columns in one pass, missing values imputed on the way.

Each task centres what it reads and merges it with what it has (pairwise, so sums of
large squares never meet), and hands on one row. Values are counted from a pivot, the
mean of a few first rows, so that missing ones, held as 0, lie among them. Beside the
values it follows where they are present. The imputed table is linear in these two:
with fill ``f``, ``y = x + f (1 - p)``. So its moments come from the same matrix once the
means are known, without a second pass: standard deviations, correlations and the
principal axes follow from it.

Only ``(2 d)^2`` numbers a task are shuffled, and ``MERGED`` such rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.functions.columns import usable

MERGED = 16
PIVOT_ROWS = 1_024
_SCHEMA = "part long, n long, mean binary, co binary"


@dataclass(frozen=True)
class Moments:
    """Of the imputed columns: rows, fills, means and co-moments (sums of products of deviations)."""

    names: list[str]
    n: int
    fills: dict[str, float | int]
    mean: np.ndarray
    co: np.ndarray

    def deviations(self) -> np.ndarray:
        """Sample deviations; 0 for a constant column, and for a single row."""
        spread = np.diag(self.co)
        noise = 1e-12 * self.n * np.maximum(self.mean**2, 0.0)  # what rounding leaves of a constant
        return np.sqrt(np.where(spread > noise, spread, 0.0) / max(self.n - 1, 1))

    def correlations(self) -> np.ndarray:
        """Pearson correlations, 1 on the diagonal, NaN with a constant column."""
        d = self.deviations() * np.sqrt(max(self.n - 1, 1))
        d = np.where(d > 0, d, np.nan)
        r = self.co / np.outer(d, d)
        np.fill_diagonal(r, 1.0)
        return r

    def scaled_covariance(self) -> np.ndarray:
        """Covariance of the standardized columns: their correlations, 0 for constant ones."""
        return np.nan_to_num(np.where(np.eye(len(self.names)) > 0, (self.deviations() > 0) * 1.0, self.correlations()))


def _joined(a: tuple, b: tuple) -> tuple:
    """Moments of two parts together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _row(part: int, held: tuple) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [held[0]], "mean": [held[1].tobytes()], "co": [held[2].tobytes()]})


def _read(mean: bytes, co: bytes, n: int) -> tuple:
    middle = np.frombuffer(mean)
    return n, middle, np.frombuffer(co).reshape(len(middle), len(middle))


def filled_moments(df: DataFrame, cols: list[str]) -> Moments:
    """Moments of ``cols`` with missing values (NULL, NaN, infinite) replaced by the column's mean, truncated in whole-number columns.

    A column without any usable value raises.
    """
    types = {f.name: f.dataType for f in df.schema}
    d = len(cols)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = (0, np.zeros(2 * d), np.zeros((2 * d, 2 * d)))
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64, na_value=np.nan)
            there = ~np.isnan(x)
            z = np.hstack([np.where(there, x, 0.0), there])
            if len(z):
                middle = z.mean(axis=0)
                held = _joined(held, (len(z), middle, (z - middle).T @ (z - middle)))
        if held[0]:
            yield _row(TaskContext.get().partitionId() % MERGED, held)

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        held = (0, None, None)
        for r in parts.sort_values("n").itertuples():
            held = _joined(held, _read(r.mean, r.co, r.n))
        return _row(int(parts["part"].iloc[0]), held)

    values = df.select(*[usable(c, types[c]).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = values.limit(PIVOT_ROWS).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in values.columns]).first()
    pivot = np.array(first, dtype=np.float64)
    found = values.select(*[(F.col(c) - p).alias(c) for c, p in zip(values.columns, pivot.tolist())]).mapInPandas(partial, _SCHEMA).groupBy("part").applyInPandas(merged, _SCHEMA)
    held = (0, np.zeros(2 * d), np.zeros((2 * d, 2 * d)))
    for r in sorted(found.collect(), key=lambda r: r["part"]):  # MERGED rows at most
        held = _joined(held, _read(r["mean"], r["co"], r["n"]))
    n, middle, co = held
    share = middle[d:]
    empty = [c for c, s in zip(cols, share) if s <= 0]
    if empty:
        raise ValueError(f"no usable value to average in {empty}")
    means = pivot + middle[:d] / share
    fills = [float(m) if isinstance(types[c], T.FractionalType) else int(round(m, 9)) for c, m in zip(cols, means)]
    above = np.array(fills, dtype=np.float64) - pivot
    linear = np.hstack([np.eye(d), -np.diag(above)])
    return Moments(list(cols), n, dict(zip(cols, fills)), pivot + above + linear @ middle, linear @ co @ linear.T)
