import pytest
from pyspark.sql import functions as F

from flowseg.operators import sample


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(F.concat(F.lit("u"), "id").alias("uid"), (F.col("id") % 10 == 0).cast("int").alias("label"))


def _ids(df):
    return sorted(r["uid"] for r in df.select("uid").collect())


def test_hash_choices_ignore_partitioning(rows):
    other = rows.repartition(9)
    for pick in (
        lambda d: sample.fraction_sample(d, "uid", 0.3),
        lambda d: sample.capped_sample(d, "uid", 40, 0.5),
        lambda d: sample.balanced_sample(d, "uid", "label", 60),
        lambda d: sample.train_test_split(d, "uid")[0],
        lambda d: sample.undersample_majority(d, "uid", "label", majority=0, minority=1),
    ):
        assert _ids(pick(rows)) == _ids(pick(other))


def test_sizes(rows):
    assert sample.fraction_sample(rows, "uid", 1.0).count() == 3000
    assert abs(sample.fraction_sample(rows, "uid", 0.3).count() - 900) < 120
    assert sample.capped_sample(rows, "uid", 40, 0.5).count() == 40
    counts = sample.balanced_sample(rows, "uid", "label", 60).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in counts} == {0: 30, 1: 30}
    # a class with too few rows is taken whole
    assert sample.balanced_sample(rows, "uid", "label", 1000).filter("label = 1").count() == 300


def test_large_samples_are_the_same(rows):
    for n in (60, 1000):
        window, ranked = (sample.balanced_sample(rows, "uid", "label", n, window_rows=w) for w in (10_000, 1))
        assert window.columns == ranked.columns and _ids(window) == _ids(ranked)
    assert _ids(sample.capped_sample(rows, "uid", 40, 0.5, window_rows=1)) == _ids(sample.capped_sample(rows, "uid", 40, 0.5))


@pytest.mark.parametrize("method", ["hash", "random"])
def test_split_covers_the_table_once(rows, method):
    train, test = sample.train_test_split(rows, "uid", method=method)
    assert sorted(_ids(train) + _ids(test)) == _ids(rows)
    assert abs(train.count() - 2100) < 120


def test_undersample(rows, spark):
    out = sample.undersample_majority(rows, "uid", "label", majority=0, minority=1)
    counts = sample.class_counts(out, "label")
    assert counts[1] == 300 and abs(counts[0] - 300) < 70
    # the majority is already the smaller class: everything stays
    assert sample.undersample_majority(rows, "uid", "label").count() == 3000
    one_class = spark.createDataFrame([("a", 0), ("b", 0)], "uid string, label int")
    with pytest.raises(ValueError):
        sample.undersample_majority(one_class, "uid", "label")


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    weights = {r["label"]: r["weight"] for r in sample.class_weights(df, "label").collect()}
    assert weights == {0: pytest.approx(4 / 6), 1: 2.0}
    assert sorted(r["class_weight"] for r in sample.with_class_weight(df, "label").collect())[-1] == 2.0
    with pytest.raises(ValueError):
        sample.with_class_weight(df.filter("label = 0"), "label")
