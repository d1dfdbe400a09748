"""Principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_size(df: DataFrame, vector: str) -> int:
    """Length of a vector column, from its metadata or, failing that, one row."""
    attrs = df.schema[vector].metadata.get("ml_attr", {})
    if "num_attrs" in attrs:
        return attrs["num_attrs"]
    return len(df.select(vector).first()[0])


def fit_pca(df: DataFrame, k: int, vector: str = "scaled_features", out: str = "pca_features") -> PCAModel:
    return PCA(k=k, inputCol=vector, outputCol=out).fit(df.select(vector))


def explained_variance(df: DataFrame, vector: str = "scaled_features") -> list[float]:
    """Share of the variance of every component, largest first."""
    return fit_pca(df, vector_size(df, vector), vector).explainedVariance.toArray().tolist()


def choose_k(shares: list[float], target: float) -> int:
    """Fewest components whose shares reach the target; all of them if none do."""
    total = 0.0
    for k, share in enumerate(shares, start=1):
        total += share
        if total >= target:
            return k
    return len(shares)


def pca_project(
    df: DataFrame, k: int, vector: str = "scaled_features", out: str = "pca_features", fit_on: DataFrame | None = None
) -> DataFrame:
    """Fit on all rows (or ``fit_on``) and add the k components."""
    return fit_pca(fit_on if fit_on is not None else df, k, vector, out).transform(df)


def shares_table(df: DataFrame, shares: list[float]) -> DataFrame:
    """The shares with their running total as ``(component, share, cumulative)``."""
    rows, total = [], 0.0
    for i, s in enumerate(shares, start=1):
        total += s
        rows.append((i, float(s), float(total)))
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double").orderBy(
        F.col("component")
    )
