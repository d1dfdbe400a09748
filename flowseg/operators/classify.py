"""Decision trees over feature vectors."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.sql import DataFrame, SparkSession

from flowseg.functions.tables import materialize
from flowseg.sources.stages import path_exists
from flowseg.specs import SEED, TREE_IMPURITY, TREE_MAX_BINS, TREE_MAX_DEPTH, TREE_MIN_INSTANCES


def train_tree(
    train: DataFrame,
    label: str,
    features: str = "scaled_features",
    weight: str | None = None,
    max_depth: int = TREE_MAX_DEPTH,
    max_bins: int = TREE_MAX_BINS,
    seed: int = SEED,
    memory_mb: int = 1024,
) -> DecisionTreeClassificationModel:
    """Fit a binary tree; only the needed columns enter the training set.

    The fit reads its rows several times (classes, weights, splits, tree), so they are written first.
    A deep tree with many bins has large histograms, hence the memory: more of
    it means more tree nodes per pass over the data, and the same tree.
    """
    tree = DecisionTreeClassifier(
        featuresCol=features,
        labelCol=label,
        maxDepth=max_depth,
        maxBins=max_bins,
        minInstancesPerNode=TREE_MIN_INSTANCES,
        impurity=TREE_IMPURITY,
        seed=seed,
        maxMemoryInMB=memory_mb,
        cacheNodeIds=False,
    )
    columns = [features, label]
    if weight:
        tree = tree.setWeightCol(weight)
        columns.append(weight)
    return tree.fit(materialize(train.select(*columns)))


def predict(model: DecisionTreeClassificationModel, df: DataFrame) -> DataFrame:
    """Adds rawPrediction, probability and prediction."""
    return model.transform(df)


def save_model(model: DecisionTreeClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> DecisionTreeClassificationModel:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no tree at {path}; train one first")
    return DecisionTreeClassificationModel.load(path)


def describe_model(spark: SparkSession, model: DecisionTreeClassificationModel) -> DataFrame:
    """One row with the depth, the number of nodes and of features."""
    return spark.createDataFrame(
        [(model.depth, model.numNodes, model.numFeatures)], "depth int, n_nodes int, n_features int"
    )
