"""Approximate search and hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowseg.llm import hard_negatives, stable_search

VECTORS = "vec_id long, embedding array<double>, label int, vec string"


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    return (centres[rng.integers(0, 8, n)] + 0.5 * rng.normal(size=(n, dims))) * rng.choice([0.3, 1.0, 5.0], size=(n, 1))


def nearest(rows, k):
    want = {}
    for q, x in rows:
        if q % 20 == 0:
            scores = sorted((-float((np.array(x) * np.array(y)).sum()), i) for i, y in rows if i != q and len(y) == len(x))
            want[q] = [(i, -s) for s, i in scores[:k]]
    return want


def searched(spark, rows, k=20, **limits):
    df = spark.createDataFrame([(i, x, 0, "clash") for i, x in rows], VECTORS).repartition(3)
    vectors = stable_search.usable_vectors(df)
    got = stable_search.nearest(stable_search.build_index(vectors), vectors.filter("vec_id % 20 = 0"), k, **limits).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_quantile_of_chi_square():
    # tabled values, 8 degrees of freedom
    assert stable_search.quantile(0.95) == pytest.approx(15.507, abs=1e-3)
    assert stable_search.quantile(0.5) == pytest.approx(7.344, abs=1e-3)


@pytest.mark.parametrize("piece, block", [(2 << 20, 4_096), (20_000, 20)])
def test_search_finds_what_is_near(spark, monkeypatch, piece, block):
    monkeypatch.setattr(stable_search, "PIECE_BYTES", piece)
    rows = list(enumerate(clustered(1_500, 24, 3).tolist()))
    got, want = searched(spark, rows, block=block), nearest(rows, 20)
    assert got.keys() == want.keys()
    met = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert met >= 0.95 * 20 * len(want)
    scores = {(q, i): s for q in want for i, s in ((i, float((np.array(rows[q][1]) * np.array(x)).sum())) for i, x in rows)}
    assert all(s == scores[q, i] for q, found in got.items() for i, s in found)
    assert all(found == sorted(found, key=lambda x: (-x[1], x[0])) for found in got.values())


def test_all_are_verified_where_confidence_asks_for_it(spark):
    rows = list(enumerate(clustered(300, 6, 4).tolist()))
    assert searched(spark, rows, confidence=1 - 1e-15) == nearest(rows, 20)


def test_search_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(stable_search, "PIECE_BYTES", 2_000)
    nan, inf = float("nan"), float("inf")
    odd = [(0, None), (20, [0.0, 0.0]), (40, [1.0, None]), (60, [nan, 1.0]), (1, [inf, 1.0]), (2, [1e300, 1e300]), (None, [1.0, 1.0])]
    copies = [(i, [1.0, 2.0]) for i in range(100, 400)] + [(100, [1.0, 2.0])] * 5
    few = [(80, [1.0, 0.0, 0.0]), (81, [0.0, 1.0, 0.0]), (500, []), (520, [3.0])]
    got = searched(spark, odd + copies + few, 3)
    assert got.pop(80) == [(81, 0.0)]
    assert got.keys() == {100, 120, 140, 160, 180, 200, 220, 240, 260, 280, 300, 320, 340, 360, 380}
    assert got.pop(100) == [(101, 5.0), (102, 5.0), (103, 5.0)]
    assert all(found == [(100, 5.0), (101, 5.0), (102, 5.0)] for found in got.values())
    assert searched(spark, []) == {} and searched(spark, odd) == {}


def mined(rows, anchors):
    """anchor, positive, rank, negative, both scores, by the contract's own words."""
    rows = list({(i, label, tuple(int(np.floor(256 * c)) for c in x)) for i, label, x in rows})
    out = []
    for i, label, x in rows:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other == label) for j, other, y in rows if j != i and len(y) == len(x))
        for positive, j, _ in [s for s in scored if s[2]][:5]:
            fit = [(n, k) for n, k, same in scored if not same and 50 * -positive <= 100 * -n <= 95 * -positive]
            out += [(i, j, r, k, -positive, -n) for r, (n, k) in enumerate(fit[:3], 1)]
    return sorted(out)


def negatives(spark, rows, **limits):
    df = spark.createDataFrame([(i, x, label, "clash") for i, label, x in rows], VECTORS).repartition(3)
    vectors = hard_negatives.labelled_vectors(df)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hard_negatives.mine(vectors, vectors.filter("vec_id % 5 = 0"), **limits).select(*names).collect())


@pytest.mark.parametrize("block", [4_096, 7])
def test_hard_negatives(spark, block):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.uniform(-0.2, 0.6) for _ in range(4)]) for i in range(200)]
    rows += [(200 + i, i % 3, rows[i % 7][2]) for i in range(60)]  # ties
    rows += rows[:40] + [(i, 2, [0.5, 0.5]) for i in range(300, 306)] + [(306, 1, [0.4, 0.4])]
    want = mined(rows, lambda i: i % 5 == 0)
    assert len(want) > 300 and negatives(spark, rows, block=block) == want


def test_hard_negatives_of_unusual_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None, [1.0]), (5, 1, None), (10, 1, [None]), (15, 1, [nan]), (20, 1, [inf]), (25, 1, [1e308]), (None, 1, [1.0]), (30, 1, []), (31, 1, []), (32, 2, [])]
    empty = [(30, 31, 1, 32, 0, 0)]  # vectors without components have score 0, in the window of 0
    assert negatives(spark, odd) == empty and negatives(spark, []) == []
    far = [(i, x) for i, x in ((35, 1e5), (36, 2e5), (37, 1.5e5), (38, 9e8), (39, 7e8), (41, 1e9), (42, 6e8))]
    large = [(i, i % 2, [x, 1.0]) for i, x in far]
    assert negatives(spark, odd + large) == sorted(empty + mined(large, lambda i: i % 5 == 0))
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([], "vec_id long, label long, vec array<double>"), None, low=60, high=50)


def test_scores_beyond_64_bits_count_as_the_nearest():
    a, b = np.array([[2.0**62, 1.0]]), np.array([[2.0**62, 3.0], [-(2.0**62), 0.0], [2.0, 5.0], [0.5 * 2.0**53, 1.0]])
    a2 = np.array([[2.0**53, 1.0]])
    assert hard_negatives.exact_scores(a, b).tolist() == [[2**63 - 1, -(2**63), 2**63 - 1, 2**63 - 1]]
    assert hard_negatives.exact_scores(a2, np.array([[3.0, 5.0]])).tolist() == [[3 * 2**53 + 5]]


def test_slots_are_combined_in_tasks(spark):
    """A task hands on ``negatives`` rows a slot, however many it reads."""
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.uniform(0.2, 0.6) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame([(i, x, label, "") for i, label, x in rows], VECTORS).coalesce(1)
    vectors = hard_negatives.labelled_vectors(df).filter("vec_id < 400").coalesce(1).withColumn("dim", F.size("vec"))
    block = {"ids": np.array([0]), "labels": np.array([0]), "vecs": np.floor(256 * np.array([rows[0][2]])), "upper": np.array([[30_000, 20_000]]), "lower": np.array([[0, 0]])}
    best = hard_negatives._scanned(vectors, spark.sparkContext.broadcast(block), 3, 2, hard_negatives._in_slot).collect()
    assert len(best) <= 6 and all((20_000 < r["score"] <= 30_000) == (r["key"] == 0) for r in best)
