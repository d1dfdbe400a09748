"""Sampling, splitting and class weights.

Random choices are hashes of the row id, so they do not depend on how the rows
are partitioned and repeat exactly when a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowseg.functions.columns import hash_below, row_hash
from flowseg.functions.tables import materialize, with_row_index
from flowseg.specs import CLUSTER_SAMPLE_FRACTION, SEED, TRAIN_FRACTION

WINDOW_ROWS = 10_000  # of a class that one task may rank
_PREFIX = 4  # hex digits of the hash histogram: 65,536 buckets


def fraction_sample(df: DataFrame, uid: str, fraction: float, seed: int = SEED) -> DataFrame:
    """A Bernoulli sample without replacement: a filter, no shuffle."""
    return df.filter(hash_below(row_hash(seed, uid), fraction))


def _smallest_hashes(df: DataFrame, uid: str, n: int, label: str | None, seed: int, window_rows: int) -> DataFrame:
    """Per class the n rows with the smallest hash (ties by id).

    A histogram over hash prefixes finds the bucket that holds the n-th row, so
    only about n rows per class reach the ranking, whatever the class size. Up
    to ``window_rows`` of a class are ranked in a task; more get their places from
    a distributed index over all classes, less the place of their class's first.
    """
    hashed = (
        df.withColumn("_g", F.col(label) if label else F.lit(0))
        .withColumn("_h", row_hash(seed, uid))
        .withColumn("_p", F.substring("_h", 1, _PREFIX))
    )
    buckets = hashed.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        buckets.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        .filter(F.col("_before") < n)
        .groupBy("_g")
        .agg(F.max("_p").alias("_cut"))
    )
    near = hashed.join(F.broadcast(cuts), "_g").filter(F.col("_p") <= F.col("_cut"))  # one row per class
    if n <= window_rows:
        rank = Window.partitionBy("_g").orderBy("_h", uid)
        ranked = near.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= n)
    else:
        places = materialize(with_row_index(near, "_g", "_h", uid, name="_i"))
        firsts = places.groupBy("_g").agg(F.min("_i").alias("_first"))  # one row per class
        ranked = places.join(F.broadcast(firsts), "_g").withColumn("_rank", F.col("_i") - F.col("_first")).filter(F.col("_rank") < n)
    return ranked.drop("_g", "_h", "_p", "_cut", "_rank", "_i", "_first")


def capped_sample(
    df: DataFrame, uid: str, n: int, fraction: float = CLUSTER_SAMPLE_FRACTION, seed: int = SEED, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """A fraction of the rows, and of those at most n."""
    return _smallest_hashes(fraction_sample(df, uid, fraction, seed), uid, n, None, seed, window_rows)


def balanced_sample(
    df: DataFrame, uid: str, label: str, n: int, seed: int = SEED, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """n // 2 rows of class 0 and as many of class 1 (all, where a class has fewer)."""
    return _smallest_hashes(df.filter(F.col(label).isin(0, 1)), uid, n // 2, label, seed, window_rows)


def train_test_split(
    df: DataFrame, uid: str, train: float = TRAIN_FRACTION, seed: int = SEED, method: str = "hash"
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that cover the table; ``random`` uses Spark's own partition-bound split."""
    if method == "random":
        first, second = df.randomSplit([train, 1.0 - train], seed=seed)
        return first, second
    inside = hash_below(row_hash(seed, uid), train)
    return df.filter(inside), df.filter(~inside)


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class, in one aggregation; only the classes reach the driver."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def undersample_majority(
    df: DataFrame, uid: str, label: str, seed: int = SEED, majority: int = 1, minority: int = 0
) -> DataFrame:
    """All minority rows plus a sample of the majority of about the same size."""
    counts = class_counts(df, label)
    few, many = counts.get(minority, 0), counts.get(majority, 0)
    if few == 0 or many == 0:
        raise ValueError(f"cannot balance classes with {few} and {many} rows")
    # another seed than the split: a split leaves only part of the hash range behind
    picked = hash_below(row_hash(seed + 1, uid), min(1.0, few / many))
    return df.filter((F.col(label) == minority) | ((F.col(label) == majority) & picked))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with weight = total / (classes x n)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    total = F.sum("n").over(everything)
    classes = F.count(F.lit(1)).over(everything)
    return counts.withColumn("weight", total / (classes * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "class_weight", weights: DataFrame | None = None) -> DataFrame:
    """Attach the weight of each row's class; both classes must occur."""
    weights = weights if weights is not None else class_weights(df, label)
    known = {r[label]: r["weight"] for r in weights.select(label, "weight").collect()}  # one row per class
    if not {0, 1} <= set(known):
        raise ValueError(f"class weights need both classes, got {sorted(known, key=str)}")
    weight = F.lit(None).cast("double")
    for value, share in known.items():
        if value is not None:
            weight = F.when(F.col(label) == value, F.lit(share)).otherwise(weight)
    return df.withColumn(out, weight)
