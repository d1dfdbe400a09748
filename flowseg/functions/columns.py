"""Column expressions: hashing for stable sampling, distances, vector access."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEX_DIGITS = 15  # of a hash, compared with a threshold: 60 bits
_HEX_SPAN = 16**HEX_DIGITS


def row_hash(seed: int, *cols: str) -> Column:
    """md5 of ``seed:col:col...``; depends on the row only, never on its partition."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_cut(fraction: float) -> str:
    """Hex digits such that a uniform hash lies below them with this probability."""
    return f"{min(int(fraction * _HEX_SPAN), _HEX_SPAN - 1):0{HEX_DIGITS}x}"


def hash_below(hashed: Column, fraction: float) -> Column:
    """True for the given share of uniform hashes."""
    if fraction >= 1.0:
        return F.lit(True)
    return F.substring(hashed, 1, HEX_DIGITS) < F.lit(hash_cut(fraction))


def chebyshev(a: Column, b: Column) -> Column:
    """Largest coordinate difference of two arrays."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def as_double_array(df: DataFrame, name: str) -> Column:
    """An ML vector or numeric array column as ``array<double>``, with -0.0 folded into 0.0."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        arr = vector_to_array(F.col(name))
    else:
        arr = F.col(name).cast("array<double>")
    return F.transform(arr, lambda x: x + F.lit(0.0))


def quoted(name: str) -> Column:
    """A column by its literal name, also when the name holds dots, slashes or dashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def usable(name: str, dtype: T.DataType) -> Column:
    """The value, or NULL where it is missing: NULL, NaN or infinite."""
    c = quoted(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return c
