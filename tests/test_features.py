import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.operators import features, reduce


def test_columns_by_type(spark):
    df = spark.createDataFrame([], "a string, b int, c double, d bigint, e string")
    assert features.string_columns(df, {"e"}) == ["a"]
    assert features.numeric_columns(df, {"c"}) == ["b", "d"]


@pytest.mark.parametrize("small", [True, False])
def test_label_encode(spark, small):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y"), ("c", "y"), ("c", "x")], "s string, t string")
    out = features.label_encode(df, ["s", "t"], rows=200_000 if small else 0)
    assert out.columns == ["s", "t", "s_idx", "t_idx"]
    got = {(r["s"], r["t"]): (r["s_idx"], r["t_idx"]) for r in out.collect()}
    assert got == {("b", "x"): (2.0, 0.0), ("a", "x"): (1.0, 0.0), (None, "y"): (3.0, 1.0), ("c", "y"): (0.0, 1.0), ("c", "x"): (0.0, 0.0)}


@pytest.mark.parametrize("rows", [200_000, 1])
def test_label_encode_unseen_value(spark, rows):
    train = spark.createDataFrame([("a",), ("b",)], "s string")
    other = spark.createDataFrame([("z",), ("a",), (None,)], "s string")
    found = features.label_encode(other, ["s"], fit_on=train, rows=rows).collect()
    assert {r["s"]: r["s_idx"] for r in found} == {"z": 2.0, "a": 0.0, None: 2.0}


def test_impute_mean(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2**60), (2, None, None), (None, 4.0, 2**60), (4, float("nan"), 2**60), (2, float("inf"), 2**60)],
        "i int, d double, l bigint",
    )
    out = features.impute_mean(df, ["i", "d", "l"])
    assert out.schema["i"].dataType == T.IntegerType()
    assert [tuple(r) for r in out.collect()] == [
        (1, 1.0, 2**60), (2, 2.5, 2**60), (2, 4.0, 2**60), (4, 2.5, 2**60), (2, 2.5, 2**60)
    ]


def test_impute_needs_a_value(spark):
    df = spark.createDataFrame([(None,), (None,)], "i int")
    with pytest.raises(ValueError):
        features.impute_mean(df, ["i"])


def _standardized(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "a int, k int")
    return features.standardize(features.assemble(df, ["a", "k"]))


def test_standardize(spark):
    rows = _standardized(spark).select(vector_to_array("scaled_features").alias("v")).collect()
    assert [r["v"] for r in rows] == [[-1.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


def test_prune_drops_the_earlier_column_and_never_on_nan(spark):
    df = spark.createDataFrame([(float(i), float(i), 7.0, float(i * i % 5)) for i in range(8)], "a double, b double, k double, z double")
    cols = df.columns
    corr = features.correlation_matrix(features.assemble(df, cols, "scaled_features"), cols)
    assert math.isnan(corr.filter("col_i = 'a' and col_j = 'k'").first()["r"])
    out, kept, dropped = features.prune_correlated(df, corr, cols)
    assert (kept, dropped, out.columns) == (["b", "k", "z"], ["a"], ["b", "k", "z"])
    assert [tuple(r)[:2] for r in features.correlated_pairs(corr).collect()] == [("a", "b")]


def test_feature_names_round_trip(spark, tmp_path):
    features.save_feature_names(spark, ["z", "a/s"], str(tmp_path / "n"))
    got = spark.read.json(str(tmp_path / "n")).orderBy("pos").collect()
    assert [r["name"] for r in got] == ["z", "a/s"]


def test_choose_k():
    assert reduce.choose_k([0.6, 0.3, 0.1], 0.89) == 2
    assert reduce.choose_k([0.6, 0.3, 0.1], 2.0) == 3


def test_vector_size_without_metadata(spark):
    df = spark.createDataFrame([(Vectors.dense(1.0, 2.0, 3.0),)], ["v"])
    assert reduce.vector_size(df, "v") == 3
    assert reduce.vector_size(_standardized(spark), "scaled_features") == 2
