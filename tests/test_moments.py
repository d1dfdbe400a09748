import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array

from flowseg.operators import features, moments


def _rows(seed, n=400):
    rng = np.random.default_rng(seed)
    a = rng.normal(1e6, 3, n)
    x = pd.DataFrame({"a": a, "b": rng.integers(0, 9, n), "c": a * 2 + rng.normal(0, 1, n), "k": 7.5})
    missing = {c: rng.random(n) < p for c, p in (("a", 0.1), ("b", 0.3), ("c", 0.0), ("k", 0.5))}
    return x, missing


@pytest.mark.parametrize("parts", [1, 7])
def test_moments_are_those_of_the_imputed_table(spark, parts):
    x, missing = _rows(3)
    rows = [
        tuple(None if missing[c][i] and i % 2 else (float("nan") if missing[c][i] and c != "b" else (None if missing[c][i] else v)) for c, v in zip(x.columns, (float(r[0]), int(r[1]), float(r[2]), float(r[3]))))
        for i, r in enumerate(x.itertuples(index=False))
    ]
    df = spark.createDataFrame(rows, "a double, b int, c double, k double").repartition(parts)
    got = moments.filled_moments(df, ["a", "b", "c", "k"])
    filled = x.astype(float)
    for c in x.columns:
        mean = filled[c][~missing[c]].mean()
        filled.loc[missing[c], c] = int(mean) if c == "b" else mean
    assert got.n == 400 and got.fills["b"] == int(filled["b"][~missing["b"]].mean())
    assert np.allclose(got.mean, filled.mean())
    assert np.allclose(got.deviations(), [*filled[["a", "b", "c"]].std(), 0.0], rtol=1e-6)
    r = got.correlations()
    assert np.allclose(r[:3, :3], filled[["a", "b", "c"]].corr(), atol=1e-6) and np.isnan(r[0, 3]) and r[3, 3] == 1.0
    assert np.allclose(np.diag(got.scaled_covariance()), [1, 1, 1, 0])
    scaled = features.scale_by_moments(features.fill_missing(df, got.fills), got, ["a", "c", "k"]).select(vector_to_array("scaled_features").alias("v"))
    want = features.standardize(features.assemble(features.impute_mean(df, ["a", "b", "c", "k"]), ["a", "c", "k"])).select(vector_to_array("scaled_features").alias("v"))
    one, two = (np.array(sorted(r["v"] for r in d.collect())) for d in (scaled, want))
    assert np.allclose(one, two, atol=1e-5)


def test_moments_of_little(spark):
    df = spark.createDataFrame([(1.0, 5), (float("inf"), 5)], "a double, b long")
    got = moments.filled_moments(df, ["a", "b"])
    assert got.n == 2 and got.fills == {"a": 1.0, "b": 5} and got.deviations().tolist() == [0.0, 0.0]
    with pytest.raises(ValueError, match="'a'"):
        moments.filled_moments(df.filter("a > 2"), ["a", "b"])
    with pytest.raises(ValueError):
        moments.filled_moments(df.limit(0), ["b"])
