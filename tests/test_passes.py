"""How often steps that fit something read or write their rows."""

from dataclasses import replace

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowseg.functions import tables
from flowseg.operators import classify, features
from flowseg.plans import jobs
from flowseg.plans.flows import SPEC


def _counted(spark, df):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(count, df.schema), seen


def test_tree_computes_its_rows_once(spark):
    rows, seen = _counted(spark, spark.range(80).select((F.col("id") % 9).cast("double").alias("x"), (F.col("id") % 9 > 4).cast("int").alias("label")))
    model = classify.train_tree(rows.select(array_to_vector(F.array("x")).alias("scaled_features"), "label"), "label")
    assert seen.value == 80 and model.depth == 1


def _flows(spark):
    n = F.col("id")
    return spark.range(70).select(
        n.cast("string").alias("uid"), (n % 5).cast("string").alias("src_ip"), (n % 7).cast("string").alias("dst_ip"), (n % 11).cast("int").alias("dst_port"),
        F.when(n % 3 > 0, (n % 3).cast("string")).alias("proto"), F.when(n % 4 > 0, n % 4 - 1).alias("resp_bytes"), (n % 2).cast("int").alias("label"),
    )


def test_preprocess_computes_the_flows_once(spark):
    rows, seen = _counted(spark, _flows(spark))
    done = jobs.preprocess(rows, SPEC)
    assert done.table.count() == 70 and done.scale(done.plain).exceptAll(done.table).isEmpty()
    assert seen.value == 70 and "scaled_features" not in done.plain.columns


@pytest.mark.parametrize("small", [True, False])
def test_scaled_vector_after_the_join_is_the_same(spark, monkeypatch, small):
    """Also with a profile that isn't broadcast."""
    done = jobs.preprocess(_flows(spark), replace(SPEC, response_bytes="resp_bytes"))
    first = jobs.enrich_table(done.table, SPEC)
    if not small:
        join = tables.lookup_join
        monkeypatch.setattr(jobs, "is_small", lambda *_: False)
        monkeypatch.setattr("flowseg.operators.enrich.lookup_join", lambda df, lookup, key, weight, rows: join(df, lookup, key, weight, 0))
    later = jobs.enrich_table(done.plain, SPEC, ["uid", *done.names], done.scale)
    assert set(later.columns) == {"src_ip", "uid", *done.names, *jobs.enrich.PROFILE, "scaled_features", "enriched_features"}

    def vectors(df):
        return {r["uid"]: r["enriched_features"].toArray().round(9).tolist() for r in df.select("uid", "enriched_features").collect()}

    assert len(vectors(first)) == 70 and vectors(later) == vectors(first)


@pytest.mark.parametrize("heavy, nulls, written", [(1, 0, 0), (3_000, 0, 1), (1, 3_000, 1)])
def test_rows_are_written_only_for_salts(spark, monkeypatch, heavy, nulls, written):
    """A key, or NULL, with more than a share of the rows."""
    calls = []
    key = F.when(F.col("id") >= nulls, F.when(F.col("id") < nulls + heavy, F.lit(0)).otherwise(F.col("id"))).alias("k")
    df = spark.range(4_000).select(key)
    lookup = tables.materialize(df.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    store = tables.materialize
    monkeypatch.setattr(tables, "materialize", lambda x: calls.append(1) or store(x))
    out = tables.lookup_join(df, lookup, "k", "n", rows=0)
    assert len(calls) == written
    assert out.count() == 4_000 and out.filter("k IS NULL AND n IS NULL").count() == nulls and out.agg(F.max("n")).first()[0] == heavy


def test_large_dictionary_is_written_once(spark, monkeypatch):
    """With a stored place the rows aren't written for it, and the numbered dictionary isn't either."""
    df = tables.materialize(spark.range(90).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), F.col("id") % 23)).alias("a"), F.col("id").cast("string").alias("b")))
    plain = features.label_encode(df, ["a", "b"])
    calls = []
    store = features.materialize
    monkeypatch.setattr(features, "materialize", lambda x: calls.append(1) or store(x))
    found = features.label_encode(df, ["a", "b"], rows=5, position="id")
    assert len(calls) == 1
    assert found.count() == 90 and found.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("heavy", [1, 3_000])
def test_large_lookups_meet_sorted_by_hash(spark, heavy):
    df = tables.materialize(spark.range(4_000).select(F.when(F.col("id") < heavy, F.lit(0)).otherwise(F.col("id")).cast("string").alias("k")))
    lookup = tables.materialize(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    out = tables.lookup_join(df, lookup.hint("merge"), "k", "n", rows=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_lookup_hash" in plan and out.columns == ["k", "n"] and out.count() == 4_000
