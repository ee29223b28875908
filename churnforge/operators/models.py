"""Model training, comparison and tuning with Spark ML.

Estimators read an assembled vector column; their metrics go through
the same aggregation operators as every other table (evaluate.py), so
class-1 precision/recall/F1 and exact AUC are defined once.
"""

from __future__ import annotations

import itertools
import threading
import time
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.operators import evaluate as EV
from churnforge.operators.forest import GrownForest, fit_forest, voted
from churnforge.session import boosting_partitions, cut_lineage, scratch_path

SEED = 42
# Execution-only settings for tree learners (the fitted model is unchanged):
# a larger node-statistics budget means fewer passes over the data per level;
# deep forests also cache node ids between levels instead of re-walking trees.
TREE_EXEC = {"maxMemoryInMB": 1024}
FOREST_EXEC = {"cacheNodeIds": True, "maxMemoryInMB": 1024, "checkpointInterval": 10}

# The parameter grids that are searched. The small ones (3 folds,
# AUC) tune the chosen learner; the full ones (5 folds, F1) search a learner on
# its own. Depth 30 stands for unlimited. Minimum split sizes, column sampling per
# tree and leaf regularisation have no counterpart in Spark ML; where a grid of
# these had several points, the points that would coincide here are left out.
SMALL_GRIDS: dict[str, list[dict]] = {
    "random_forest": [{"numTrees": 100, "maxDepth": 30}, {"numTrees": 100, "maxDepth": 10}],
    "gbt": [{"maxIter": 100, "maxDepth": 3}, {"maxIter": 100, "maxDepth": 5}],
    "logistic_regression": [{"regParam": 0.0}, {"regParam": 0.01}],
}


def _points(**values: list) -> list[dict]:
    return [dict(zip(values, point)) for point in itertools.product(*values.values())]


FULL_GRIDS: dict[str, list[dict]] = {
    "random_forest": _points(numTrees=[100, 200], maxDepth=[5, 10, 30], minInstancesPerNode=[1, 2]),
    "gbt": _points(maxIter=[100, 200], maxDepth=[3, 5, 7], stepSize=[0.1, 0.2], subsamplingRate=[0.8, 1.0]),
    "gbt_categorical": _points(maxIter=[100, 200], maxDepth=[3, 5, 7], stepSize=[0.1, 0.2]),
}


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


#: Trees times training rows of one fit of a forest, and nodes that score rows in
#: one pass: the driver builds and holds the nodes of no more trees at a time.
FOREST_ROWS, FOREST_NODES = 2_000_000, 1_000_000
#: From so many rows on a forest beyond that is grown in the executors (forest.py).
GROWN_ROWS = 20_000
_part_fits = threading.Lock()                # side by side, parts would add up in the driver


class Forest(RandomForestClassifier):
    """A forest whose trees grow with the rows, and whose fit keeps within a
    bounded driver: a small one is fitted as a whole, one of many trees on few
    rows in parts of a few trees with a seed each, which stay in shared storage,
    and one on many rows is grown in the executors."""

    def _fit(self, dataset: DataFrame):
        rows = dataset.count()
        trees, at_once = self.getNumTrees(), max(1, FOREST_ROWS // max(1, rows))
        if trees <= at_once:
            return super()._fit(dataset)
        if rows >= GROWN_ROWS and (classes := self._classes(dataset)):
            return fit_forest(dataset, self.getFeaturesCol(), self.getLabelCol(), rows, trees=trees, depth=self.getMaxDepth(),
                              bins=self.getMaxBins(), least=self.getMinInstancesPerNode(), min_gain=self.getMinInfoGain(),
                              rate=self.getSubsamplingRate(), seed=self.getSeed(), classes=classes)
        spark, parts, importance = dataset.sparkSession, [], 0.0
        with _part_fits:
            for n, first in enumerate(range(0, trees, at_once)):
                own = {self.numTrees: min(at_once, trees - first), self.seed: self.getSeed() + 1_000_003 * n}
                model = super(Forest, self.copy(own))._fit(dataset)
                grown = sum(t.numNodes > 1 for t in model.trees)      # a tree without a split has no importances
                importance = importance + grown * model.featureImportances.toArray()
                parts.append((scratch_path(spark, "forest"), model.totalNumNodes))
                model.write().save(parts[-1][0])
        total = importance.sum()
        return ForestInParts(parts, DenseVector(importance / total if total else importance))


    def _classes(self, dataset: DataFrame) -> int | None:
        """The number of classes, or None where the executors do not know the settings, features or labels."""
        own = (self.getImpurity(), self.getFeatureSubsetStrategy(), self.getBootstrap(), self.getMinWeightFractionPerNode())
        nominal = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal")
        if own != ("gini", "auto", True, 0.0) or self.getMaxBins() > 256 or nominal or self.isSet("weightCol") or self.isSet("thresholds"):
            return None
        label = F.col(self.getLabelCol())
        odd = F.count_if(label.isNull() | (label != F.floor(label)) | (label < 0) | (label > 255))
        found = dataset.agg(F.max(label).alias("last"), odd.alias("odd")).first()
        return None if found["odd"] else int(found["last"]) + 1


class ForestInParts:
    """A fitted forest as saved parts (path, nodes). Rows are scored by adding up
    the trees' votes, in passes of a bounded number of nodes."""

    def __init__(self, parts: list[tuple[str, int]], importances: DenseVector):
        self.parts, self.featureImportances = parts, importances

    def transform(self, df: DataFrame) -> DataFrame:
        out, held, votes = df, 0, None
        for path, nodes in self.parts:
            if held and held + nodes > FOREST_NODES:
                out, held = cut_lineage(out), 0
            scored = RandomForestClassificationModel.load(path).transform(out)
            own = vector_to_array("rawPrediction")
            votes = own if votes is None else F.zip_with("_votes", own, lambda a, b: a + b)
            out, held = scored.select(*df.columns, votes.alias("_votes")), held + nodes
        return voted(out, df.columns)


def estimators(label: str = "label") -> dict[str, Estimator]:
    """The compared learners (reference: forest, boosted trees; plus LR)."""
    return {
        "random_forest": Forest(labelCol=label, featuresCol="features", numTrees=100,
                                maxDepth=30, minInstancesPerNode=1, seed=SEED, **FOREST_EXEC),
        "gbt": GBTClassifier(labelCol=label, featuresCol="features", maxIter=100, maxDepth=5,
                             stepSize=0.3, seed=SEED, **TREE_EXEC),
        "logistic_regression": LogisticRegression(labelCol=label, featuresCol="features", maxIter=100),
    }


def score(model, df: DataFrame, keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """(keep..., prediction int, probability of class 1)."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("probability"))


def metrics(scored: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """accuracy, class-1 precision, recall, F1 and AUC per group."""
    rep = EV.classification_report(scored, group, label, "prediction")
    one = rep.where(F.col("class") == "1").select(*group, "precision", "recall", "f1")
    acc = rep.where(F.col("class") == "accuracy").select(*group, F.col("precision").alias("accuracy"))
    auc = EV.roc_auc(scored.withColumnRenamed("probability", "score"), group, label, "score")
    return one.join(acc, list(group)).join(auc, list(group))


def reloaded(model, spark: SparkSession):
    """The model as saved in shared storage: it carries no training summary, and
    so nothing of the session's earlier tables into the tasks that score."""
    if isinstance(model, (ForestInParts, GrownForest)):
        return model                           # saved in parts already
    path = scratch_path(spark, "model")
    model.write().save(path)
    return type(model).load(path)


def dealt_for(est: Estimator, train: DataFrame, id_col: str) -> DataFrame:
    """A training table dealt as the learner wants it: boosted trees on few parts."""
    return cut_lineage(boosting_partitions(train, id_col)) if isinstance(est, GBTClassifier) else train


def compare(parts: dict[str, DataFrame], ests: dict[str, Estimator], **how) -> tuple[DataFrame, dict]:
    """The table and the models of :func:`compare_scored`."""
    table, _, models = compare_scored(parts, ests, **how)
    return table, models


def compare_scored(parts: dict[str, DataFrame], ests: dict[str, Estimator], label: str = "label", id_col: str = "id",
                   folds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Fit each estimator on parts['train'], score every part once, measure all.

    parts: 'train', 'valid' and 'test' with features, label and id. Returns the
    table (model, model_order, train_accuracy, valid_auc, valid_f1, cv_auc,
    cv_f1, test accuracy/precision/recall/f1/auc rounded to 4, train_time,
    inference_time), the scored rows (label, prediction, probability, model,
    part) and the fitted models. ``folds`` are training rows with
    features and a fold column; cv_auc and cv_f1 are the means over the folds of
    held-out scores (null without folds). inference_time is the wall time of
    scoring the test part into a sink that keeps nothing. All scores, those of
    the folds too, are rows of one written table.
    """
    from churnforge.operators.tuning import Learner, fold_scores
    spark = parts["train"].sparkSession
    store, times, models = scratch_path(spark, "scores"), [], {}
    # one after the other: each fit has the executors to itself, so that times can be compared
    for order, (name, est) in enumerate(ests.items()):
        train = dealt_for(est, parts["train"], id_col)
        t0 = time.time()
        model = est.fit(train)
        t_fit = time.time() - t0
        model = models[name] = reloaded(model, spark)
        t0 = time.time()
        score(model, parts["test"], (id_col, label)).write.format("noop").mode("overwrite").save()
        times.append((name, order, t_fit, time.time() - t0))
        for part, df in parts.items():
            score(model, df, (F.col(label).cast("int").alias("label"),)).write.parquet(f"{store}/model={name}/part={part}")
    if folds is not None:
        cv = scratch_path(spark, "fold-scores")
        held = fold_scores({name: Learner(dealt_for(est, folds, id_col), est, [{}]) for name, est in ests.items()}, cv, label=label)
        held.select("label", "prediction", "probability", F.col("learner").alias("model"),
                    F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("part")).write.mode("append").partitionBy(
                        "model", "part").parquet(store)
    scored = spark.read.schema("label int, prediction int, probability double, model string, part string").parquet(store)
    m = cut_lineage(metrics(scored, ["model", "part"], "label"))
    t = spark.createDataFrame(times, "model string, model_order int, train_time double, inference_time double")
    test = m.where("part = 'test'").select("model", "accuracy", "precision", "recall", "f1", "auc")
    train = m.where("part = 'train'").select("model", F.col("accuracy").alias("train_accuracy"))
    valid = m.where("part = 'valid'").select("model", F.col("auc").alias("valid_auc"), F.col("f1").alias("valid_f1"))
    cv = m.where("part like 'fold%'").groupBy("model").agg(F.avg("auc").alias("cv_auc"), F.avg("f1").alias("cv_f1"))
    res = t.join(test, "model").join(train, "model").join(valid, "model").join(cv, "model", "left")
    cols = ["train_accuracy", "valid_auc", "valid_f1", "cv_auc", "cv_f1", "accuracy", "precision", "recall", "f1", "auc"]
    return res.select("model", "model_order", *[F.round(c, 4).alias(c) for c in cols],
                      "train_time", "inference_time"), scored, models


def search(train: DataFrame, fold_col: str, est: Estimator, grid: Sequence[dict], metric: str = "auc",
           features: Sequence[str] | None = None, resample: Callable[[DataFrame], DataFrame] | None = None,
           label: str = "label", store: str | None = None) -> DataFrame:
    """Grid search of one learner with k-fold CV on a precomputed (stratified)
    fold column: (point, params, fold, n, metric value, mean, is_best). ``store``
    is where the scores are kept, a fresh folder by default (tuning.py)."""
    from churnforge.operators.tuning import Learner, search_all
    store = store or scratch_path(train.sparkSession, "search")
    return search_all({"learner": Learner(train, est, grid)}, metric, store, fold_col=fold_col, label=label,
                      features=features, resample=resample).drop("learner")


def best_params(table: DataFrame, grid: Sequence[dict]) -> dict:
    return grid[table.where("is_best").first()["point"]]


def tree_importance(model, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance) from the normalised impurity gain vector, all features."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")


def lr_coefficients(model, names: Sequence[str], spark: SparkSession) -> DataFrame:
    coef = model.coefficients.toArray().tolist()
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, coef)], "feature string, coefficient double")
    return df.withColumn("abs_coefficient", F.abs("coefficient"))


def model_importance(model, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance, signed) of any compared learner: impurity gain for
    tree learners, absolute coefficients (with sign) for the linear one."""
    if hasattr(model, "featureImportances"):
        return tree_importance(model, names, spark).withColumn("signed", F.lit(None).cast("double"))
    return lr_coefficients(model, names, spark).select(
        "feature", F.col("abs_coefficient").alias("importance"), F.col("coefficient").alias("signed"))
