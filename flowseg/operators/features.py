"""Feature preparation: label encoding, imputation, scaling, correlation pruning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.functions.columns import quoted, usable
from flowseg.functions.tables import BROADCAST_ROWS, is_small, lookup_join, materialize, with_row_index
from flowseg.operators.moments import Moments
from flowseg.specs import PRUNE_THRESHOLD, REPORT_THRESHOLD

INDEX_SUFFIX = "_idx"


def string_columns(df: DataFrame, protected: Iterable[str] = ()) -> list[str]:
    keep_out = set(protected)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keep_out]


def numeric_columns(df: DataFrame, protected: Iterable[str] = ()) -> list[str]:
    keep_out = set(protected)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keep_out]


# --- label encoding -------------------------------------------------------


def fit_labels(df: DataFrame, cols: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Dictionary ``(col, value, n, label_idx)``: most frequent value first, ties by value.

    All columns are counted in one scan. The numbering is a window per column
    while the dictionary has at most ``rows`` rows and a distributed row index beyond that.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), quoted(c).alias("value")) for c in cols]))
    counts = materialize(
        df.select(pairs.alias("p"))
        .select("p.col", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("col", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if is_small(counts, rows):
        order = Window.partitionBy("col").orderBy(F.desc("n"), "value")
        return materialize(counts.withColumn("label_idx", F.row_number().over(order).cast("long") - 1))
    ranked = with_row_index(counts, "col", F.desc("n"), "value", name="_r")  # reads a stored table
    first = F.lit(0)
    for r in ranked.groupBy("col").agg(F.min("_r").alias("_first")).collect():  # one row per column
        first = F.when(F.col("col") == r["col"], F.lit(r["_first"])).otherwise(first)
    return ranked.select("col", "value", "n", (F.col("_r") - first).alias("label_idx"))


def apply_labels(
    df: DataFrame, dictionary: DataFrame, cols: list[str], suffix: str = INDEX_SUFFIX, rows: int = BROADCAST_ROWS, position: str | None = None
) -> DataFrame:
    """Add ``<col><suffix>``; NULL and unseen values get the number of known labels.

    Columns of at most ``rows`` labels look theirs up in a broadcast. All others go
    together: their values leave the table as (row, column, value), meet the
    dictionary in one join, and the codes come back by row, so the table itself is
    dealt once, however many such columns there are. ``position`` names a stored
    column with a number of its own for every row; without one, the table is written with it.
    """
    sizes = {r["col"]: r["n_labels"] for r in dictionary.groupBy("col").agg(F.count(F.lit(1)).alias("n_labels")).collect()}
    large = [c for c in cols if sizes.get(c, 0) > rows]
    for c in cols:
        if c in large:
            continue
        one = dictionary.filter(F.col("col") == c).select(F.col("value").alias(c), F.col("label_idx").alias("_label"))
        known = F.coalesce(F.col("_label").cast("double"), F.lit(float(sizes.get(c, 0))))
        df = df.join(F.broadcast(one), c, "left").withColumn(c + suffix, known).drop("_label")
    if not large:
        return df
    if position is None:
        placed = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    else:
        placed = df.withColumn("_row", quoted(position))
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), quoted(c).alias("value")) for i, c in enumerate(large)]))
    narrow = placed.select("_row", values.alias("_k")).filter("_k.value IS NOT NULL")
    number = F.array_position(F.array(*[F.lit(c) for c in large]), F.col("col")).cast("int") - 1
    codes = dictionary.filter(F.col("col").isin(large)).select(F.struct(number.alias("col"), "value").alias("_k"), "n", "label_idx")
    found = lookup_join(narrow, codes, "_k", "n", rows, sum(sizes[c] for c in large), "_row")
    names = [f"_code{i}" for i in range(len(large))]
    rejoined = found.groupBy("_row").agg(*[F.max(F.when(F.col("_k.col") == i, F.col("label_idx"))).alias(n) for i, n in enumerate(names)])
    out = placed.join(rejoined, "_row", "left")
    for c, n in zip(large, names):
        out = out.withColumn(c + suffix, F.coalesce(F.col(n).cast("double"), F.lit(float(sizes[c]))))
    return out.drop("_row", *names)


def label_encode(
    df: DataFrame, cols: list[str], suffix: str = INDEX_SUFFIX, fit_on: DataFrame | None = None, rows: int = BROADCAST_ROWS,
    position: str | None = None,
) -> DataFrame:
    """Frequency-ordered label codes beside the original string columns; ``position`` as in ``apply_labels``."""
    if not cols:
        return df
    dictionary = fit_labels(fit_on if fit_on is not None else df, cols, rows)
    return apply_labels(df, dictionary, cols, suffix, rows, position).select(
        *[quoted(c) for c in df.columns], *[quoted(c + suffix) for c in cols]
    )


# --- imputation -----------------------------------------------------------


def column_means(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Mean of the usable values per column, in one aggregation; an empty column raises."""
    types = {f.name: f.dataType for f in df.schema}
    row = df.agg(*[F.avg(usable(c, types[c])).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    means = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    empty = [c for c, m in means.items() if m is None]
    if empty:
        raise ValueError(f"no usable value to average in {empty}")
    return means


def impute_mean(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Missing numbers become the column mean; whole-number columns get it truncated."""
    if not cols:
        return df
    means = column_means(fit_on if fit_on is not None else df, cols)
    types = {f.name: f.dataType for f in df.schema}
    return fill_missing(df, {c: means[c] if isinstance(types[c], T.FractionalType) else int(means[c]) for c in cols})


def fill_missing(df: DataFrame, fills: dict[str, float | int]) -> DataFrame:
    """Missing numbers replaced by the given ones."""
    types = {f.name: f.dataType for f in df.schema}
    filled = {c: F.coalesce(usable(c, types[c]), F.lit(fill).cast(types[c])).alias(c) for c, fill in fills.items()}
    return df.select(*[filled.get(c, quoted(c)) for c in df.columns])


# --- vectors --------------------------------------------------------------


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Concatenate numeric and vector columns into one vector."""
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def fit_scaler(df: DataFrame, vector: str = "features", out: str = "scaled_features") -> StandardScalerModel:
    return StandardScaler(inputCol=vector, outputCol=out, withMean=True, withStd=True).fit(df.select(vector))


def standardize(
    df: DataFrame, vector: str = "features", out: str = "scaled_features", fit_on: DataFrame | None = None
) -> DataFrame:
    """(x - mean) / sample deviation per component; a constant component becomes 0."""
    return fit_scaler(fit_on if fit_on is not None else df, vector, out).transform(df)


def scale_by_moments(df: DataFrame, moments: Moments, names: list[str], out: str = "scaled_features") -> DataFrame:
    """``standardize`` of the named columns with means and deviations that are known already."""
    place = {c: i for i, c in enumerate(moments.names)}
    means, deviations = moments.mean.tolist(), moments.deviations().tolist()
    scaled = [
        (quoted(c).cast("double") - means[place[c]]) / deviations[place[c]] if deviations[place[c]] > 0 else F.lit(0.0)
        for c in names
    ]
    size = {"ml_attr": {"num_attrs": len(names)}}
    return df.select(*[quoted(c) for c in df.columns], array_to_vector(F.array(*scaled)).alias(out, metadata=size))


# --- correlation ----------------------------------------------------------


def correlation_matrix(df: DataFrame, cols: list[str], vector: str = "scaled_features") -> DataFrame:
    """Pearson correlations as ``(i, j, col_i, col_j, r)`` for all d x d pairs.

    Only the d x d matrix passes through the driver, never rows.
    """
    return correlation_table(df, cols, Correlation.corr(df.select(vector), vector, "pearson").first()[0].toArray())


def correlation_table(df: DataFrame, cols: list[str], matrix) -> DataFrame:
    """A d x d matrix as rows ``(i, j, col_i, col_j, r)``."""
    rows = [
        (i, j, cols[i], cols[j], float(matrix[i, j])) for i in range(len(cols)) for j in range(len(cols))
    ]
    return df.sparkSession.createDataFrame(rows, "i int, j int, col_i string, col_j string, r double")


def correlated_pairs(corr: DataFrame, threshold: float = REPORT_THRESHOLD) -> DataFrame:
    """Column pairs with |r| above the threshold, strongest first."""
    strength = F.abs("r")
    return (
        corr.filter((F.col("i") < F.col("j")) & ~F.isnan("r") & (strength > threshold))
        .select("col_i", "col_j", strength.alias("abs_r"))
        .orderBy(F.desc("abs_r"), "col_i", "col_j")
    )


def prune_list(corr: DataFrame, threshold: float = PRUNE_THRESHOLD) -> DataFrame:
    """The earlier column of every pair with |r| at or above the threshold; NaN never counts."""
    return (
        corr.filter((F.col("i") < F.col("j")) & ~F.isnan("r") & (F.abs("r") >= threshold))
        .select("i", F.col("col_i").alias("dropped"))
        .distinct()
    )


def prune_correlated(
    df: DataFrame, corr: DataFrame, cols: list[str], threshold: float = PRUNE_THRESHOLD
) -> tuple[DataFrame, list[str], list[str]]:
    """Drop redundant feature columns; returns the table, the kept and the dropped names."""
    dropped = [r["dropped"] for r in prune_list(corr, threshold).orderBy("i").collect()]  # at most d names
    gone = set(dropped)
    return df.drop(*dropped), [c for c in cols if c not in gone], dropped


def save_feature_names(df_or_spark, names: list[str], path: str) -> None:
    """Ordered feature names as JSON rows ``(pos, name)``."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    spark.createDataFrame(list(enumerate(names)), "pos int, name string").coalesce(1).write.mode("overwrite").json(path)
