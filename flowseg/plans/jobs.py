"""The jobs: preprocess, reduce, cluster, train, derive rules, enrich.

Every job reads and writes stage tables below the dataset's folder, so a job can
run alone once the ones before it have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseg.functions.columns import quoted
from flowseg.functions.tables import is_small, materialize
from flowseg.operators import classify, cluster, enrich, evaluate, features, moments, reduce, rules, sample
from flowseg.operators.features import INDEX_SUFFIX
from flowseg.sources import load, load_flows, save, stage, stage_mark
from flowseg.specs import PCA_SAMPLE_FRACTION, FlowSpec

PREPROCESSED = "preprocessed_data"
REDUCED = "pca_data"
CLUSTERED = "optics_clustered"
TREE = "dt_model"
RULES = "firewall_rules.csv"
FEATURE_NAMES = "feature_names.json"


@dataclass(frozen=True)
class Preprocessed:
    """A scaled table, the names of its vector's components, and the redundant ones.

    ``plain`` is the table without the vector, which ``scale`` adds to any table with its columns.
    """

    table: DataFrame
    names: list[str]
    dropped: list[str]
    plain: DataFrame
    scale: Callable[[DataFrame], DataFrame]


def preprocess(flows: DataFrame, spec: FlowSpec, prune_vector: bool = False, fit_on: DataFrame | None = None) -> Preprocessed:
    """Encode, impute, scale, and prune redundant features where asked for.

    Source columns keep their names; string features gain a code column.
    ``prune_vector`` takes redundant features out of the vector and of its
    names; the table keeps their columns, so that
    later steps still find those they need. ``fit_on`` fits every model on other rows (a
    training part) than it is applied to.

    The flows are written once. Codes from a dictionary that is broadcast, fills and the
    vector are added wherever the table is read; codes from a larger one are written.
    """
    flows = materialize(flows)

    def fitted(apply):
        return apply(flows), None if fit_on is None else apply(fit_on)

    strings = features.string_columns(flows, spec.protected)
    codes = {c: c + INDEX_SUFFIX for c in strings}
    if strings:
        dictionary = features.fit_labels(flows if fit_on is None else fit_on, strings)
        table, train = fitted(lambda df: features.apply_labels(df, dictionary, strings))
        if not is_small(dictionary):
            table = materialize(table)
    else:
        table, train = flows, fit_on
    numbers = features.numeric_columns(table, spec.protected | {c for c in codes.values()})
    names = numbers + [codes[c] for c in strings]
    # the moments of the encoded columns say all that is fitted from here on
    known = moments.filled_moments(table if train is None else train, names)
    filled = features.fill_missing(table, known.fills)
    dropped: list[str] = []
    if prune_vector:
        corr = features.correlation_table(table, names, known.correlations())
        dropped = [r["dropped"] for r in features.prune_list(corr).orderBy("i").collect()]
    kept = [c for c in names if c not in set(dropped)]

    def scale(df: DataFrame) -> DataFrame:
        return features.scale_by_moments(df, known, kept)

    return Preprocessed(scale(filled), kept, dropped, filled, scale)


def preprocess_job(spark: SparkSession, spec: FlowSpec, prune_vector: bool = False) -> DataFrame:
    """Load and preprocess a dataset, or read the stage stored with the same settings."""
    def build() -> DataFrame:
        done = preprocess(load_flows(spark, spec), spec, prune_vector)
        features.save_feature_names(spark, done.names, spec.stage(FEATURE_NAMES))
        return done.table

    settings = replace(spec, pca_variance=None, pca_k=None, sample_size=None, sample_method="")
    return stage(spark, spec.stage(PREPROCESSED), build, repr((settings, prune_vector)))


def reduce_table(table: DataFrame, spec: FlowSpec) -> DataFrame:
    """Replace the scaled vector by its principal components."""
    k = spec.pca_k
    if k is None:
        shares = reduce.explained_variance(sample.fraction_sample(table, spec.uid, PCA_SAMPLE_FRACTION))
        k = reduce.choose_k(shares, spec.pca_variance)
    k = min(k, reduce.vector_size(table, "scaled_features"))
    return reduce.pca_project(table, k).drop("scaled_features")


def reduce_job(spark: SparkSession, spec: FlowSpec) -> DataFrame:
    source = spec.stage(PREPROCESSED)
    settings = repr((spec.pca_variance, spec.pca_k, spec.uid, stage_mark(spark, source)))
    return stage(spark, spec.stage(REDUCED), lambda: reduce_table(load(spark, source), spec), settings)


def cluster_sample(table: DataFrame, spec: FlowSpec) -> DataFrame:
    """The rows to cluster: balanced over the classes, or a capped fraction."""
    if spec.sample_method == "balanced":
        picked = sample.balanced_sample(table, spec.uid, spec.label, spec.sample_size)
    else:
        picked = sample.capped_sample(table, spec.uid, spec.sample_size)
    return picked.select(spec.uid, "pca_features")


def cluster_table(table: DataFrame, spec: FlowSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """``(uid, cluster_id)`` of all rows, or of a sample where the spec gives its size.

    With ``group_cols``, groups are clustered independently, and clusters are
    numbered through all groups.
    """
    picked = materialize(
        (table if spec.sample_size is None else cluster_sample(table, spec)).select(
            *dict.fromkeys([spec.uid, *group_cols, "pca_features"])
        )
    )
    found = cluster.optics_segments(picked, spec.uid, "pca_features", group_cols, through=bool(group_cols))
    found = found.select(quoted(spec.uid), "cluster_id")
    return cluster.attach_clusters(picked.select(quoted(spec.uid)), found, spec.uid)


def cluster_job(spark: SparkSession, spec: FlowSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Cluster the reduced table and store the segments."""
    save(cluster_table(load(spark, spec.stage(REDUCED)), spec, group_cols), spec.stage(CLUSTERED))
    return load(spark, spec.stage(CLUSTERED))


STRATEGIES = ("plain", "undersample", "weighted")


def train(
    table: DataFrame,
    spec: FlowSpec,
    strategy: str = "plain",
    enriched: bool = False,
    split_method: str = "hash",
    **tree,
) -> tuple[DecisionTreeClassificationModel, DataFrame]:
    """Fit a tree on the training part; returns it with the predicted test part.

    The test part keeps the original class mix under every strategy.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")
    vector = "enriched_features" if enriched else "scaled_features"
    fit_part, test_part = sample.train_test_split(table, spec.uid, method=split_method)
    weight = None
    if strategy == "undersample":
        fit_part = sample.undersample_majority(fit_part, spec.uid, spec.label)
    elif strategy == "weighted":
        weight = "class_weight"
        fit_part = sample.with_class_weight(fit_part.select(vector, spec.label), spec.label, weight)
    model = classify.train_tree(fit_part, spec.label, vector, weight, **tree)
    return model, classify.predict(model, test_part)


def reports(predictions: DataFrame, spec: FlowSpec) -> dict[str, DataFrame | None]:
    """All evaluation tables of one set of predictions, scored once."""
    wanted = {spec.label, "prediction", spec.attack}
    wanted |= {f for f in evaluate.OUTCOME_FEATURES} | {f + INDEX_SUFFIX for f in evaluate.OUTCOME_FEATURES}
    slim = materialize(predictions.select(*[c for c in predictions.columns if c in wanted]))
    codes = {f: f + INDEX_SUFFIX for f in evaluate.OUTCOME_FEATURES if f + INDEX_SUFFIX in slim.columns}
    return {
        "confusion": evaluate.confusion(slim, spec.label),
        "metrics": evaluate.binary_metrics(slim, spec.label),
        "benign": evaluate.benign_breakdown(slim, spec.label) if spec.attack in slim.columns else None,
        "attacks": evaluate.attack_breakdown(slim, spec.label, spec.attack),
        "outcome_means": evaluate.outcome_feature_means(slim, spec.label, spec.attack, sources=codes),
    }


def rules_job(spark: SparkSession, spec: FlowSpec, strategy: str = "plain") -> tuple[DataFrame, dict[str, DataFrame | None]]:
    """Train on all flows, store the tree, and turn the clustered flows into rules."""
    table = load(spark, spec.stage(PREPROCESSED))
    model, tested = train(table, spec, strategy)
    classify.save_model(model, spec.stage(TREE))
    segments = load(spark, spec.stage(CLUSTERED))
    clustered = cluster.flows_in_clusters(table, segments, spec.uid)
    found = materialize(rules.rule_table(classify.predict(model, clustered), spec.five_tuple))
    rules.write_rules(found, spec.stage(RULES))
    about = {"largest_clusters": cluster.largest_clusters(segments), "cluster_summary": cluster.summary(segments)}
    return found, reports(tested, spec) | about


def enrich_table(
    table: DataFrame, spec: FlowSpec, columns: list[str] | None = None, scale: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Add the behaviour profile of its source to every flow and to its vector.

    Only ``columns`` and the source go on, if given. ``scale`` adds the vector where the
    table has none yet: after the join, so that it is neither shuffled nor written.
    """
    source = spec.five_tuple["SIP"]
    if source not in table.columns:
        raise ValueError(f"no source column {source!r} in {table.columns}")
    profile = materialize(
        enrich.source_profile(table, source, spec.five_tuple["DIP"], spec.five_tuple["DPort"], spec.response_bytes)
    )
    narrow = table if columns is None else table.select(*[quoted(c) for c in dict.fromkeys([source, *columns])])
    wide = enrich.add_behaviour(narrow, profile, source, written=True)
    if not is_small(profile):
        wide = materialize(wide)
    return enrich.rescale_behaviour(wide if scale is None else scale(wide))


def enriched_job(
    spark: SparkSession, spec: FlowSpec, strategy: str = "plain"
) -> tuple[DecisionTreeClassificationModel, dict[str, DataFrame | None]]:
    """Train on enriched vectors; needs the plain tree, so that there is something to compare with."""
    classify.load_model(spark, spec.stage(TREE))
    table = enrich_table(load(spark, spec.stage(PREPROCESSED)), spec)
    model, tested = train(table, spec, strategy, enriched=True)
    return model, reports(tested, spec)


def run_all(spark: SparkSession, spec: FlowSpec, group_cols: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, DataFrame | None]]:
    """From raw logs to rules."""
    preprocess_job(spark, spec)
    reduce_job(spark, spec)
    cluster_job(spark, spec, group_cols)
    return rules_job(spark, spec)
