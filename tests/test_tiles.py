import numpy as np
import pytest
from pyspark.sql import functions as F

from flowseg.operators import spanning, tiles
from flowseg.operators.blocks import nearest
from flowseg.operators.neighbours import nearest_distances


def _lightest(x, nodes, c, bound, y, to_nodes, d):
    """By all pairs: of every component the lightest edge to another one that isn't above its bound."""
    best = {}
    for i in np.flatnonzero(~np.isnan(bound)):
        for j in np.flatnonzero(d != c[i]):
            w = np.abs(x[i] - y[j]).max()
            if w <= bound[i]:
                edge = (w, min(nodes[i], to_nodes[j]), max(nodes[i], to_nodes[j]), d[j])
                best[c[i]] = min(best.get(c[i], edge), edge)
    return best


@pytest.mark.parametrize("dims", [1, 2, 9, 40])
@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("comps", [3, 1000])
def test_search_is_brute_force(dims, ties, comps):
    """Large and small components, ties, an outlier that reaches everything, vectors that don't ask."""
    rng = np.random.default_rng(dims + comps)
    x, y = rng.normal(0, 1, (150, dims)), rng.normal(0.2, 1, (170, dims))
    if ties:
        x, y = np.round(x), np.round(y)
    x[7] = 1e6
    c, d = rng.integers(0, comps, 150), rng.integers(0, comps, 170)
    bound = rng.choice([0.3, 1.0, 4.0], comps)[c]
    c[7], bound[7] = comps, 2e6
    bound[rng.random(150) < 0.3] = np.nan
    nodes, to_nodes = rng.permutation(150), 150 + rng.permutation(170)
    want = _lightest(x, nodes, c, bound, y, to_nodes, d)
    got = tiles.search(x, nodes, c, bound, y, to_nodes, d)
    assert {r.c: (r.w, r.a, r.b, r.to) for r in got.itertuples()} == want


def _nodes(spark, x):
    return spark.createDataFrame([("", v, 1, i) for i, v in enumerate(x.tolist())], "g string, arr array<double>, mult long, node long")


def test_many_dimensions_meet_by_tiles_and_are_exact(spark):
    """Where all blocks are near each other, the meetings follow from the tiles, not from the pairs of blocks."""
    x = np.random.default_rng(3).normal(0, 1, (400, 24))
    formed = []
    tree = spanning.spanning_tree(_nodes(spark, x), 24, block=40, formed=formed, tile=150).collect()
    i, j, w = spanning._tree(x)
    assert {(r["a"], r["b"], r["w"]) for r in tree} == {(min(a, b), max(a, b), v) for a, b, v in zip(i.tolist(), j.tolist(), w.tolist())}
    assert 1 < max(formed) <= 10  # of 4 tiles at most; blocks formed up to 90 pairs and more


def test_nearest_over_many_tiles(spark):
    x = np.random.default_rng(4).normal(0, 1, (200, 5))
    x[:, 4] = np.round(x[:, 4])
    own = np.arange(len(x))
    got = {r["node"]: r["w"] for r in nearest_distances(_nodes(spark, x), 5, block=20, tile=50).collect()}
    assert got == dict(enumerate(nearest(x, x, own, own)[0].tolist()))


def test_tiles_are_bounded(spark):
    rows = [("a", b, i) for b in range(6) for i in range(10)] + [("b", 9, 1)]
    got = tiles.with_tiles(spark.createDataFrame(rows, "g string, blk long, i long"), 2, rows=25).groupBy("g", "tile").agg(F.count("*").alias("n")).collect()
    assert {(r["g"], r["tile"]): r["n"] for r in got} == {("a", 0): 30, ("a", 1): 20, ("a", 2): 10, ("b", 0): 1}
