"""Metric operators: golden confusion matrix, AUC vs brute force, ties."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from churnforge.operators import evaluate as EV


def _cm_rows(tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return [(i, a, p) for i, (a, p) in enumerate(rows)]


def test_golden_report(spark):
    # confusion matrix behind the reference's stored best-model report
    df = spark.createDataFrame(_cm_rows(885, 150, 153, 221), "id long, label int, prediction int")
    df = df.withColumn("g", F.lit("m"))
    rep = {r["class"]: r for r in EV.classification_report(df, ["g"]).collect()}
    assert rep["1"]["precision"] == pytest.approx(0.59569, abs=1e-5)
    assert rep["1"]["recall"] == pytest.approx(0.59091, abs=1e-5)
    assert rep["0"]["precision"] == pytest.approx(0.85260, abs=1e-5)
    assert rep["0"]["recall"] == pytest.approx(0.85507, abs=1e-5)
    assert rep["accuracy"]["f1"] == pytest.approx(0.78495, abs=1e-5)
    assert rep["1"]["support"] == 374 and rep["0"]["support"] == 1035
    cm = {(r["actual"], r["predicted"]): r["n"] for r in EV.confusion_matrix(df, ["g"]).collect()}
    assert cm == {(0, 0): 885, (0, 1): 150, (1, 0): 153, (1, 1): 221}


def test_zero_division(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "id long, label int, prediction int").withColumn("g", F.lit(1))
    rep = {r["class"]: r for r in EV.classification_report(df, ["g"]).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["f1"] == 0.0


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_brute_force_with_ties(spark, seed):
    rnd = random.Random(seed)
    pairs = [(round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(300)]   # many ties
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(pairs)], "id long, score double, label int")
    got = EV.roc_auc(df.withColumn("g", F.lit(0)), ["g"]).first()["auc"]
    assert got == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_auc_global_group(spark):
    pairs = [(0.1, 0), (0.4, 1), (0.5, 0), (0.8, 1)]
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(pairs)], "id long, score double, label int")
    assert EV.roc_auc(df, []).first()["auc"] == pytest.approx(0.75)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2, 1), (2, 0.9, 1)], "id long, score double, label int")
    assert EV.roc_auc(df, []).first()["auc"] is None
