import numpy as np
import pytest
from pyspark.sql import functions as F

from flowseg.operators import cluster
from tests import brute

TINY = dict(block=8, task_rows=14)


def _blobs(seed, copies=True):
    """Three blobs and stray points, with copies and one vector that holds a third of the rows."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, (14, 3)) for c in (0, 3, 8)] + [rng.uniform(-4, 12, (9, 3))])
    if copies:
        x = np.concatenate([x, x[:3], np.repeat(x[20:21], 26, axis=0)])
    return x


def _frame(spark, x, key="a"):
    rows = [(f"p{i:04d}", key, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id string, k string, v array<double>")


def _sorted(x):
    """Rows in the operator's order: by vector, then by id."""
    return sorted(range(len(x)), key=lambda i: (tuple(x[i]), i))


@pytest.mark.parametrize("sizes", [{}, TINY], ids=["one task", "many tasks"])
def test_reachability_is_the_brute_force_plot(spark, sizes):
    x = _blobs(1)
    rank = _sorted(x)
    order, reach, pred = brute.optics_plot(x[rank])
    got = cluster.reachability(_frame(spark, x), "id", "v", **sizes).orderBy("ord").collect()
    names = [f"p{rank[o]:04d}" for o in order]
    assert [g["id"] for g in got] == names
    assert [g["ord"] for g in got] == list(range(len(x)))
    assert got[0]["reachability"] is None and got[0]["predecessor"] is None
    assert np.allclose([g["reachability"] for g in got[1:]], reach[1:], atol=0)
    assert [g["predecessor"] for g in got[1:]] == [names[p] for p in pred[1:]]
    assert np.isclose(sum(reach[1:]), brute.tree_weight(x))


@pytest.mark.parametrize("sizes", [{}, {**TINY, "plot_block": 9}], ids=["one task", "many tasks"])
@pytest.mark.parametrize("min_size", [2, 10])
def test_segments_are_the_brute_force_labels(spark, sizes, min_size):
    x = _blobs(2)
    rank = _sorted(x)
    order, reach, pred = brute.optics_plot(x[rank])
    labels = brute.xi_clusters(reach, pred, min_size=min_size)
    got = cluster.optics_segments(_frame(spark, x), "id", "v", min_cluster_size=min_size, **sizes)
    got = {r["id"]: r["cluster_id"] for r in got.collect()}
    assert got == {f"p{rank[o]:04d}": labels[k] for k, o in enumerate(order)}


@pytest.mark.parametrize("seed", range(8))
def test_block_scan_matches_brute_force_on_random_plots(seed):
    """The pure block logic, without Spark: any cut positions give the same labels."""
    from flowseg.operators import xi as X
    import pandas as pd

    rng = np.random.default_rng(seed)
    n = 400
    kinds = [rng.uniform(0, 1, n), rng.lognormal(0, 2, n), np.round(rng.uniform(0, 1, n), 1), np.abs(np.cumsum(rng.normal(0, 1, n)))]
    r = kinds[seed % 4]
    r[0] = np.inf
    pred = np.array([-1] + [rng.integers(max(0, i - 6), i) for i in range(1, n)])
    want = brute.xi_clusters(r, pred)
    plot = pd.DataFrame({"g": "", "pos": np.arange(n), "r": r, "pred": pred})
    assert X._label_group(plot.copy(), 0.05, 2, 2)["cluster_id"].tolist() == want.tolist()

    plot["after"] = np.append(r[1:], np.inf)
    size = 23
    cuts = []
    for blk in range(-(-n // size)):
        near = plot[(plot.pos >= blk * size - 4) & (plot.pos < (blk + 1) * size + 4)].assign(blk=blk)
        cut = X._find_cut(near, 0.05, 2, size)["cut"].iloc[0]
        if cut >= 0:
            cuts.append((blk, cut))
    starts = np.array([c for _, c in cuts])
    plot["b"] = np.array([b for b, _ in cuts])[np.searchsorted(starts, plot.pos, side="right") - 1]
    blocks = [p for _, p in plot.groupby("b")]
    handed = X._hand_over(pd.concat([X._open_areas(p, 0.05, 2, 2) for p in blocks]), 0.05)
    found = pd.concat(
        [X._block_candidates(p, handed[handed.b == p.b.iloc[0]], 0.05, 2, 2) for p in blocks]
    ).astype({c: "int64" for c in ("b", "us", "ue", "ds", "c0", "c1")})
    cases = pd.concat([X._transitions(p) for _, p in found.groupby("b")])
    state = X._chain(cases).set_index("b")
    spans = pd.concat(
        [X._number(p.assign(last=state.loc[b, "last"], count=state.loc[b, "count"])) for b, p in found.groupby("b")]
    )
    assert X._spread(plot, spans)["cluster_id"].tolist() == want.tolist()


def _nodes(spark, x):
    from flowseg.operators import spanning

    points = _frame(spark, x).select(F.lit("").alias("g"), "id", F.col("v").alias("arr"))
    return spanning.distinct_vectors(points)


def test_blocks_are_bounded_and_visits_are_what_is_near(spark):
    """Tied coordinates, far apart blobs: every block fits, regions keep others out, and a search meets exactly the boxes in reach."""
    from flowseg.operators import blocks as B

    rng = np.random.default_rng(7)
    x = np.concatenate([np.round(rng.normal(c, 1.0, (40, 3)), 1) for c in range(0, 80, 10)])
    x[:, 1] = np.where(x[:, 0] < 40, 0.0, x[:, 1])
    nodes = _nodes(spark, x)
    cut = B.cut_space(nodes, 3, block=16)
    sizes = [r["count"] for r in cut.vectors.groupBy("blk").count().collect()]
    assert max(sizes) <= 16 and sum(sizes) == nodes.count() == cut.vectors.select("node").distinct().count()
    rows = cut.vectors.collect()
    for r in cut.regions.filter("length(cell) > 0").collect():
        within = lambda v: all(l < a <= h for l, a, h in zip(r["rlow"], v, r["rhigh"]))
        assert all(within(v["arr"]) for v in rows if v["blk"] == r["blk"])
    leaves = {r["cell"]: r for r in cut.tree.filter("blk IS NOT NULL").collect()}
    own = {(r["blk"]): r for r in cut.regions.collect() if r["cell"] in leaves}
    for blk, r in own.items():
        inside = [v["blk"] for v in rows if all(l < a <= h for l, a, h in zip(r["rlow"], v["arr"], r["rhigh"]))]
        assert set(inside) == {blk}
    boxes = {r["blk"]: (np.array(r["low"]), np.array(r["high"])) for r in leaves.values()}
    queries = spark.createDataFrame([("", p, p, 2.0, b[0].tolist(), b[1].tolist()) for p, b in boxes.items()], "g string, p long, c long, bound double, low array<double>, high array<double>")
    met = [(r["p"], r["q"]) for r in B.visits(cut, queries).collect()]
    near = {(p, q) for p in boxes for q in boxes if p != q and max((boxes[q][0] - boxes[p][1]).max(), (boxes[p][0] - boxes[q][1]).max()) <= 2.0}
    assert len(met) == len(set(met)) and set(met) == near and len(near) < len(boxes) * (len(boxes) - 1) / 3


@pytest.mark.parametrize("outlier", [False, True])
def test_block_pairs_grow_with_the_blocks(spark, outlier):
    """Uniform points, with and without one far away: block pairs a block stay about the same from 16 blocks to 64."""
    from flowseg.operators import spanning

    pairs = {512: np.inf}
    for n in (2048,) if outlier else (512, 2048):
        rng = np.random.default_rng(n)
        x = rng.uniform(0, np.sqrt(n), (n, 2))
        if outlier:
            x = np.concatenate([x, [[1e4, 1e4]]])
        formed = []
        nodes = _nodes(spark, x)
        tree = spanning.spanning_tree(nodes, 2, block=32, formed=formed).collect()
        assert len(tree) == len({(r["a"], r["b"]) for r in tree}) == len(x) - 1
        sorted_x = x[_sorted(x)]
        i, j, w = spanning._tree(sorted_x)
        assert {(r["a"], r["b"], r["w"]) for r in tree} == {(min(a, b), max(a, b), v) for a, b, v in zip(i.tolist(), j.tolist(), w.tolist())}
        pairs[n] = max(formed)
    assert pairs[2048] < 6 * pairs[512] and pairs[2048] < 2048 / 32 * 20


def test_groups_are_independent(spark):
    x, y = _blobs(3, copies=False)[:30], _blobs(4, copies=False)[:40]
    both = _frame(spark, x, "a").unionByName(_frame(spark, y, "b"))
    got = cluster.optics_segments(both, "id", "v", ["k"], **TINY, plot_block=9)
    for key, part in (("a", x), ("b", y)):
        alone = {r["id"]: r["cluster_id"] for r in cluster.optics_segments(_frame(spark, part), "id", "v").collect()}
        assert {r["id"]: r["cluster_id"] for r in got.filter(F.col("k") == key).collect()} == alone


@pytest.mark.parametrize("sizes", [{}, TINY], ids=["one task", "many tasks"])
def test_core_distance_is_the_nearest_neighbour(spark, sizes):
    sizes = {k: v for k, v in sizes.items() if k == "block"}
    x = _blobs(5)
    d = brute.distances(x)
    np.fill_diagonal(d, np.inf)
    got = {r["id"]: r["core_distance"] for r in cluster.core_distance(_frame(spark, x), "id", "v", **sizes).collect()}
    assert got == {f"p{i:04d}": w for i, w in enumerate(d.min(axis=1))}


def test_partitioning_does_not_matter(spark):
    df = _frame(spark, _blobs(6))
    one = sorted(cluster.optics_segments(df.coalesce(1), "id", "v").collect())
    many = sorted(cluster.optics_segments(df.repartition(7, "id"), "id", "v", **TINY).collect())
    assert one == many


def test_small_inputs(spark):
    one = _frame(spark, np.zeros((1, 3)))
    assert [r["cluster_id"] for r in cluster.optics_segments(one, "id", "v").collect()] == [-1]
    same = _frame(spark, np.ones((6, 3)))
    order, reach, pred = brute.optics_plot(np.ones((6, 3)))
    want = brute.xi_clusters(reach, pred).tolist()
    assert [r["cluster_id"] for r in cluster.optics_segments(same, "id", "v").orderBy("id").collect()] == want
    empty = _frame(spark, np.zeros((0, 3)))
    assert cluster.optics_segments(empty, "id", "v").count() == 0


def test_only_two_samples(spark):
    with pytest.raises(ValueError):
        cluster.optics_segments(_frame(spark, np.zeros((2, 3))), "id", "v", min_samples=5)


def test_reports_and_joins(spark):
    c = spark.createDataFrame([("1", 0), ("2", 0), ("3", 1), ("4", -1)], "uid string, cluster_id int")
    assert [tuple(r) for r in cluster.largest_clusters(c).collect()] == [(0, 2), (1, 1)]
    assert tuple(cluster.summary(c).first()) == (4, 2, 1, 25.0)
    assert tuple(cluster.summary(c.filter("false")).first()) == (0, 0, 0, 0.0)
    flows = spark.createDataFrame([(1,), (2,), (9,)], "uid long")
    left = cluster.attach_clusters(flows, c, "uid")
    assert left.schema["uid"].dataType.typeName() == "long"
    assert sorted(map(tuple, left.collect())) == [(1, 0), (2, 0), (9, None)]
    assert sorted(map(tuple, cluster.flows_in_clusters(flows, c, "uid").collect())) == [(1, 0), (2, 0)]
