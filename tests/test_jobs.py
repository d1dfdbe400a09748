import random
from dataclasses import replace

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.operators import classify
from flowseg.plans import jobs
from flowseg.sources import load, load_flows, read_zeek_lines, stage
from flowseg.specs import SPECS

ATTACKS = {"iot23": ["DDoS", "C&C"], "iotid20": ["Mirai", "Scan"], "unsw": ["Fuzzers", "DoS"]}


def _value(rng, field, spec, hit):
    if field.name == spec.label:
        return {"iot23": ["Benign", "Malicious"], "iotid20": ["Normal", "Anomaly"], "unsw": ["0", "1"]}[spec.name][hit]
    if field.name == spec.attack:
        return rng.choice(ATTACKS[spec.name]) if hit else "-"
    if field.name in spec.five_tuple.values() and isinstance(field.dataType, T.StringType):
        return rng.choice(["tcp", "udp"]) if "proto" in field.name.lower() else f"10.0.0.{rng.randint(1, 6)}"
    if rng.random() < 0.05:
        return "-"
    if isinstance(field.dataType, T.StringType):
        return rng.choice("abc")
    shift = 50 * hit
    if isinstance(field.dataType, T.DoubleType):
        return f"{rng.uniform(0, 100) + shift:.3f}"
    return str(rng.randint(0, 100) + shift)


def _write(spec, folder, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        hit = int(rng.random() < 0.4)
        row = [_value(rng, f, spec, hit) for f in spec.schema]
        if spec.kind == "zeek":
            row[1] = f"C{i}"
        rows.append(row)
    if spec.kind == "zeek":
        for k in range(2):
            place = folder / "opt" / f"capture-{k}" / "bro"
            place.mkdir(parents=True)
            part = rows[k::2]
            text = "\n".join(("\t" if i % 2 else "  ").join(r) for i, r in enumerate(part))
            (place / "conn.log.labeled").write_text("#separator\n" + text + "\n1 2 3\n")
            (place / "dns.log").write_text("not a connection log\n")
    elif spec.header:
        head = ",".join(f"c{i}" for i in range(len(spec.schema)))
        (folder / spec.file_glob).write_text("\n".join([head, *map(",".join, rows)]) + "\n")
    else:
        for k in range(1, 5):
            (folder / f"UNSW-NB15_{k}.csv").write_text("\n".join(map(",".join, rows[k - 1 :: 4])) + "\n")
        (folder / "UNSW-NB15_LIST.csv").write_text("not,flows\n")


@pytest.fixture(scope="module", params=list(SPECS))
def spec(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    # a larger share of the rows than by default reaches the clustering of this small table
    spec = replace(SPECS[request.param].at(str(folder)), sample_method="balanced", sample_size=60)
    _write(spec, folder)
    return spec


def test_from_logs_to_rules(spark, spec):
    flows = load_flows(spark, spec)
    assert flows.count() == 400
    assert flows.select(spec.uid).distinct().count() == 400
    assert {r[0] for r in flows.select(spec.label).distinct().collect()} == {0, 1}

    table = jobs.preprocess_job(spark, spec)
    names = [r["name"] for r in spark.read.json(spec.stage(jobs.FEATURE_NAMES)).orderBy("pos").collect()]
    assert not set(names) & spec.protected and len(names) == len(set(names))
    arr = table.select(vector_to_array("scaled_features").alias("v"))
    stats = arr.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_samp("col").alias("s")).collect()
    assert len(stats) == len(names)
    assert all(abs(r["m"]) < 1e-9 and (abs(r["s"] - 1) < 1e-9 or r["s"] == 0) for r in stats)
    numbers = [c for c in names if c in spec.schema.names]
    assert table.filter(" OR ".join(f"`{c}` IS NULL" for c in numbers)).count() == 0
    # the rules need the words, not their codes
    assert table.schema[spec.five_tuple["SIP"]].dataType == T.StringType()

    reduced = jobs.reduce_job(spark, spec)
    width = len(reduced.first()["pca_features"])
    assert width == spec.pca_k if spec.pca_k else 1 <= width <= len(names)
    assert "scaled_features" not in reduced.columns

    clusters = jobs.cluster_job(spark, spec)
    assert clusters.columns == [spec.uid, "cluster_id"] and clusters.count() == 60
    assert clusters.filter("cluster_id IS NULL").count() == 0

    found, reports = jobs.rules_job(spark, spec)
    assert found.count() > 0 and {r[0] for r in found.select("Action").distinct().collect()} <= {"Allow", "Block"}
    assert spark.read.option("header", True).csv(spec.stage(jobs.RULES)).count() == found.count()
    assert reports["metrics"].first()["total"] == 400 - jobs.sample.train_test_split(table, spec.uid)[0].count()
    assert reports["metrics"].first()["accuracy"] > 0.6
    assert (reports["outcome_means"] is not None) == (spec.name == "iot23")
    model = classify.load_model(spark, spec.stage(jobs.TREE))
    assert model.numFeatures == len(names)
    assert classify.describe_model(spark, model).first()["n_features"] == len(names)

    enriched, _ = jobs.enriched_job(spark, spec, "weighted")
    assert enriched.numFeatures == len(names) + 4


def test_all_jobs_in_one_call_reuse_finished_stages(spark, spec):
    first, _ = jobs.run_all(spark, spec)
    again, _ = jobs.run_all(spark, spec)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_enrichment_guards(spark, tmp_path):
    spec = SPECS["iot23"].at(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        jobs.enriched_job(spark, spec)
    with pytest.raises(ValueError):
        jobs.enrich_table(spark.range(3), spec)
    with pytest.raises(FileNotFoundError):
        read_zeek_lines(spark, str(tmp_path)).count()
    with pytest.raises(ValueError):
        jobs.train(spark.range(3), spec, "no such strategy")


def test_stage_is_built_once(spark, tmp_path):
    path = str(tmp_path / "s")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert stage(spark, path, build).count() == 5
    assert stage(spark, path, build).count() == 5 and len(calls) == 1
    for settings, n in (("a", 2), ("a", 2), ("b", 3), ("a", 4), (None, 4)):
        assert stage(spark, path, build, settings).count() == 5 and len(calls) == n
    assert load(spark, path).count() == 5


def test_models_fitted_on_the_training_part_only(spark, spec):
    flows = load_flows(spark, spec)
    train, _ = jobs.sample.train_test_split(flows, spec.uid)
    done = jobs.preprocess(flows, spec, fit_on=train)
    scaled_train, _ = jobs.sample.train_test_split(done.table, spec.uid)
    arr = scaled_train.select(vector_to_array("scaled_features").alias("v")).select(F.posexplode("v"))
    means = [r["m"] for r in arr.groupBy("pos").agg(F.avg("col").alias("m")).collect()]
    assert all(abs(m) < 1e-9 for m in means)
    assert done.table.count() == 400


def test_pruned_vector(spark, spec):
    flows = load_flows(spark, spec)
    number = next(c for c in ("orig_bytes", "Flow_Duration", "sbytes") if c in flows.columns)
    done = jobs.preprocess(flows.withColumn("twin", F.col(number) * 2), spec, prune_vector=True)
    assert done.dropped and not set(done.dropped) & set(done.names)
    assert len(done.table.first()["scaled_features"]) == len(done.names)


def test_all_rows_are_clustered_and_numbered_through_groups(spark):
    rng = random.Random(1)
    rows = [
        (f"{g}{c}{i}", g, [10.0 * c + rng.random(), rng.random()])
        for g in ("a", None, "b") for c in range(2) for i in range(12)
    ]
    df = spark.createDataFrame(rows, "uid string, site string, pca_features array<double>")
    spec = replace(SPECS["iot23"], uid="uid")
    assert spec.sample_size is None and jobs.cluster_table(df, spec).count() == len(rows)
    got = jobs.cluster_table(df, spec, ("site",)).join(df, "uid").collect()
    assert len(got) == len(rows)
    sites = {}
    for r in got:
        if r["cluster_id"] != -1:
            sites.setdefault(r["cluster_id"], set()).add(r["site"])
    assert sorted(sites) == list(range(len(sites))) and all(len(s) == 1 for s in sites.values())
    assert {s for own in sites.values() for s in own} == {"a", None, "b"}


@pytest.mark.parametrize("vector", [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]])
def test_vectors_without_a_distance_are_refused(spark, vector):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, vector)], "uid int, v array<double>")
    with pytest.raises(ValueError, match="1 vectors"):
        jobs.cluster.optics_segments(df, "uid", "v")
