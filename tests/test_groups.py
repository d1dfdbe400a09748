"""Many small groups are clustered side by side, with the same plots, labels and numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowseg.operators import cluster
from tests import brute


def _groups(seed, n):
    """Groups of 1 to 40 rows, many of their vectors tied or equal."""
    rng = np.random.default_rng(seed)
    return [np.round(rng.uniform(0, 6, (rng.integers(1, 41), 2)), int(seed) % 2) for _ in range(n)]


@pytest.mark.parametrize("seed, most", [(1, 256), (2, 256), (3, 9)])
def test_batches_of_groups_have_the_brute_force_plots_and_labels(monkeypatch, seed, most):
    from flowseg.operators import groups, xi

    monkeypatch.setattr(groups, "ALONE", most)
    monkeypatch.setattr(groups, "SIDE_BY_SIDE", 200)
    parts = [x + 0.0 for x in _groups(seed, 40)]
    sizes = np.array([len(x) for x in parts])
    pos, r, pred = groups.plots(np.concatenate(parts), sizes)
    labels, counts = xi.label_plots(r, pred, sizes, 0.05, 2, 2)
    first = 0
    for x, n in zip(parts, counts):
        own = slice(first, first + len(x))
        rank = sorted(range(len(x)), key=lambda i: (tuple(x[i]), i))
        order, reach, before = brute.optics_plot(x[rank])
        assert np.argsort(pos[own]).tolist() == [rank[o] for o in order]
        assert r[own].tolist() == list(reach)
        want = brute.xi_clusters(np.array(reach), np.array(before))
        assert labels[own].tolist() == want.tolist() and n == want.max() + 1
        first += len(x)


def _frame(spark, parts):
    rows = [(f"k{k:03d}", f"p{i:02d}", x.tolist()) for k, part in enumerate(parts) for i, x in enumerate(part)]
    return spark.createDataFrame(rows, "k string, id string, v array<double>").repartition(5, "id")


def test_small_groups_need_no_task_or_call_each(spark, monkeypatch):
    """Neither the tree, nor the order, nor the labels go group by group."""
    def refused(*_, **__):
        raise AssertionError("group by group")

    for step in ("spanning_tree", "visiting_order", "xi_labels"):
        monkeypatch.setattr(cluster, step, refused)
    df = _frame(spark, _groups(4, 30))
    assert cluster.optics_segments(df, "id", "v", ["k"]).count() == df.count()


@pytest.mark.parametrize("block", [2048, 30, 1])
def test_clusters_are_numbered_through_groups_of_any_size(spark, block):
    parts = _groups(5, 6)
    df = _frame(spark, parts)
    got = {(r["k"], r["id"]): r["cluster_id"] for r in cluster.optics_segments(df, "id", "v", ["k"], through=True, block=block).collect()}
    want, total = {}, 0
    for k, x in enumerate(parts):
        rank = sorted(range(len(x)), key=lambda i: (tuple(x[i]), i))
        order, reach, pred = brute.optics_plot(x[rank])
        labels = brute.xi_clusters(np.array(reach), np.array(pred))
        want |= {(f"k{k:03d}", f"p{rank[o]:02d}"): -1 if c < 0 else c + total for o, c in zip(order, labels.tolist())}
        total += labels.max() + 1
    assert got == want


def test_groups_of_other_lengths_and_a_null_key(spark):
    df = spark.createDataFrame([(None, i, [float(i % 3)]) for i in range(6)] + [("b", i, [float(i % 2), 1.0]) for i in range(5)], "k string, id int, v array<double>")
    got = cluster.optics_segments(df, "id", "v", ["k"])
    assert got.groupBy("k").count().orderBy("k").collect() == [(None, 6), ("b", 5)]
    with pytest.raises(Exception, match="different lengths"):
        cluster.optics_segments(df.withColumn("k", F.lit("a")), "id", "v", ["k"]).count()
