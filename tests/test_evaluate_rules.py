import pytest

from flowseg.operators import enrich, evaluate, rules

FIVE = {"SIP": "s", "SPort": "sp", "DIP": "d", "DPort": "dp", "Proto": "p"}


def _predictions(spark, tp, tn, fp, fn):
    rows = [(1, 1.0)] * tp + [(0, 0.0)] * tn + [(0, 1.0)] * fp + [(1, 0.0)] * fn
    return spark.createDataFrame(rows, "label int, prediction double")


def test_metrics(spark):
    m = evaluate.binary_metrics(_predictions(spark, 3, 4, 1, 2), "label").first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["total"]) == (3, 4, 1, 2, 10)
    assert m["accuracy"] == pytest.approx(0.7) and m["sensitivity"] == pytest.approx(0.6)
    assert m["specificity"] == pytest.approx(0.8) and m["precision"] == pytest.approx(0.75)
    assert m["f1"] == pytest.approx(2 / 3)


def test_metrics_of_nothing_are_zero(spark):
    m = evaluate.binary_metrics(_predictions(spark, 0, 0, 0, 0), "label").first().asDict()
    assert all(v == 0 for v in m.values())


def test_breakdowns(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "A", 2.0), (1, 1.0, "A", 4.0), (1, 0.0, "A", 6.0), (0, 1.0, "Benign", 8.0), (0, 0.0, "Benign", 1.0), (1, 1.0, None, 3.0)],
        "label int, prediction double, attack string, duration double",
    )
    got = [tuple(r) for r in evaluate.attack_breakdown(df, "label", "attack").collect()]
    assert got == [(None, 1.0, 1, 1, 100.0), ("A", 0.0, 1, 3, 33.33), ("A", 1.0, 2, 3, 66.67)]
    assert [tuple(r) for r in evaluate.benign_breakdown(df, "label").collect()] == [(0.0, 1), (1.0, 1)]
    means = {r["analysis_group"]: (r["flow_count"], r["duration"]) for r in evaluate.outcome_feature_means(df, "label", "attack").collect()}
    assert means == {
        evaluate.FALSE_POSITIVE: (1, 8.0), evaluate.TRUE_NEGATIVE: (1, 1.0), "FN-A": (1, 6.0), "TP-A": (2, 3.0)
    }
    assert evaluate.attack_breakdown(df, "label", None) is None
    assert evaluate.attack_breakdown(df, "label", "no_such") is None
    assert evaluate.outcome_feature_means(df.drop("duration"), "label", "attack") is None


def test_rules(spark):
    rows = [(0.0, 1, "a"), (0.0, -1, "b"), (1.0, 1, "c"), (0.0, None, "d"), (1.0, None, "e"), (0.0, 1, "a"), (1.0, 1, "a")]
    df = spark.createDataFrame([(p, c, n, 1, "t", 80, "tcp") for p, c, n in rows], "prediction double, cluster_id int, s string, sp int, d string, dp int, p string")
    table = rules.rule_table(df, FIVE)
    assert table.columns == ["Micro-segment", "SIP", "SPort", "DIP", "DPort", "Proto", "Action"]
    got = [(r["Micro-segment"], r["SIP"], r["Action"]) for r in table.collect()]
    assert got == [(None, "e", "Block"), (-1, "b", "Block"), (1, "a", "Allow"), (1, "a", "Block"), (1, "c", "Block")]
    both = rules.allow_rules(df, FIVE).unionByName(rules.block_rules(df, FIVE))
    assert sorted(map(str, both.collect())) == sorted(map(str, table.collect()))


@pytest.mark.parametrize("rows", [100, 1])
def test_profile_and_join(spark, rows):
    df = spark.createDataFrame(
        [("a", "x", 1, 0), ("a", "y", 1, None), ("a", "x", 2, 5), ("a", None, 2, 0), ("b", "x", 1, 7)], "s string, d string, p int, r int"
    )
    profile = enrich.source_profile(df, "s", "d", "p", "r")
    assert sorted(map(tuple, profile.collect())) == [("a", 2, 2, 4, 0.5), ("b", 1, 1, 1, 0.0)]
    wide = enrich.add_behaviour(df, profile, "s", rows)
    assert sorted((r["s"], r["total_flows"]) for r in wide.collect()) == [("a", 4)] * 4 + [("b", 1)]
    rough = enrich.source_profile(df, "s", "d", "p", "r", exact=False)
    assert {r["s"]: r["distinct_dst_ips"] for r in rough.collect()} == {"a": 2, "b": 1}
