"""Forests grown in the executors: whole trees, the same wherever a node is grown, as good as the library's."""

import numpy as np
import pytest

from churnforge.operators import forest as FO
from churnforge.operators import models as M
from churnforge.session import cut_lineage

NAMES = ["a", "b", "c", "flag", "same"]


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    n = 1600
    x = np.column_stack([rng.normal(size=(n, 3)), rng.integers(0, 2, n), np.full(n, 2.0)])
    y = (x[:, 0] * x[:, 1] + x[:, 3] + rng.normal(size=n) * 0.5 > 0.5).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label int, " + ", ".join(f"{c} double" for c in NAMES))
    return cut_lineage(M.assemble(df, NAMES).repartition(3, "id").sortWithinPartitions("id"))


def _fit(made, monkeypatch, trees=12, **point):
    monkeypatch.setattr(M, "FOREST_ROWS", 0)
    monkeypatch.setattr(M, "GROWN_ROWS", 100)
    est = M.estimators()["random_forest"].setNumTrees(trees)
    return est.copy({est.getParam(k): v for k, v in point.items()}).fit(made.where("id % 4 > 0"))


def _auc(model, rows):
    scored = M.score(model, rows).selectExpr("1 as g", "label", "prediction", "probability")
    return M.metrics(scored, ["g"], "label").first()["auc"]


def test_a_forest_of_many_rows_is_grown_in_the_executors(spark, made, monkeypatch):
    held = made.where("id % 4 = 0")
    model = _fit(made, monkeypatch)
    assert isinstance(model, FO.GrownForest) and model.getNumTrees == 12 and M.reloaded(model, spark) is model
    assert sorted(t for t, _, _ in model.nodes) == list(range(12))
    scored = model.transform(held).select("id", "rawPrediction", "probability", "prediction").collect()
    assert len(scored) == 400
    for r in scored:
        assert abs(sum(r["rawPrediction"]) - 12) < 1e-9 and abs(r["probability"][1] - r["rawPrediction"][1] / 12) < 1e-9
        assert r["prediction"] == float(r["probability"][1] > 0.5)
    imp = model.featureImportances.toArray()
    assert abs(imp.sum() - 1) < 1e-9 and imp[NAMES.index("same")] == 0 and imp.min() >= 0
    monkeypatch.setattr(M, "FOREST_ROWS", 10**9)
    own = M.estimators()["random_forest"].setNumTrees(12).fit(made.where("id % 4 > 0"))
    assert _auc(model, held) > _auc(own, held) - 0.02 and sum(n for _, _, n in model.nodes) > 0.8 * own.totalNumNodes


def test_nodes_are_the_same_wherever_they_are_grown(made, monkeypatch):
    """Nodes of more rows than a task may hold are split by the whole table's
    histograms; the scores, in groups of few nodes, are those of whole trees."""
    held = made.where("id % 4 = 0")
    want = {r["id"]: r["probability"] for r in M.score(_fit(made, monkeypatch, maxDepth=6), held).collect()}
    monkeypatch.setattr(FO, "TASK_BYTES", 3500)
    monkeypatch.setattr(FO, "PASS_NODES", 7)
    monkeypatch.setattr(FO, "SCORE_NODES", 40)
    model = _fit(made, monkeypatch, maxDepth=6)
    assert len(model.nodes) > 24 and len(model._groups()) > 3 and max(len(t.feature) for t in model.tops.values()) > 3
    got = {r["id"]: r["probability"] for r in M.score(model, held).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_a_missing_feature_is_an_error_in_training_as_in_the_library(made, monkeypatch):
    gap = M.assemble(made.drop("features").selectExpr("id", "label", "IF(id = 77, double('NaN'), a) a", "b", "c", "flag", "same"), NAMES)
    with pytest.raises(Exception, match="NaN"):
        _fit(gap, monkeypatch)
    monkeypatch.setattr(M, "FOREST_ROWS", 10**9)
    with pytest.raises(Exception, match="NaN"):
        M.estimators()["random_forest"].setNumTrees(2).fit(gap)


def test_the_best_split_is_the_best(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (200, 2)).astype(np.uint8), rng.integers(0, 2, 200)
    w = rng.integers(1, 4, 200)
    spec = FO.Spec(1, 1, 8, 5, 0.0, 1.0, 7, 2, [np.arange(5.0), np.arange(5.0)])

    def gini(at):
        p = np.bincount(y[at], w[at], 2) / w[at].sum()
        return 1 - (p * p).sum()

    def gain(f, b):
        low = x[:, f] <= b
        share = w[low].sum() / w.sum()
        return gini(np.ones(200, bool)) - share * gini(low) - (1 - share) * gini(~low)

    best = max((gain(f, b), f, b) for f in range(2) for b in range(5))
    monkeypatch.setattr(FO.Nodes, "pruned", lambda self: self)
    nodes = FO.grow(x, y, w, 0, 1, spec)
    assert (nodes.feature[0], nodes.cut[0]) == best[1:] and abs(nodes.gain[0] - best[0] * w.sum()) < 1e-9
    low = x[:, best[1]] <= best[2]
    assert (nodes.counts[1] == np.bincount(y[low], w[low], 2)).all() and len(nodes.feature) == 3


def test_sibling_leaves_of_one_prediction_merge():
    nodes = FO.Nodes(np.array([0, -1, 1, -1, -1]), np.zeros(5, int), np.array([1, 0, 3, 0, 0]),
                     np.array([[5.0, 6], [5, 0], [0, 6], [0, 2], [0, 4]]), np.array([4.0, 0, 1, 0, 0]))
    kept = nodes.pruned()
    assert kept.feature.tolist() == [0, -1, -1] and kept.counts.tolist() == [[5, 6], [5, 0], [0, 6]]
    assert kept.gains(2).tolist() == [4.0, 0.0]


def test_cuts_are_the_librarys(spark):
    """Midpoints of few values, one at each quantile of many."""
    assert FO.quantile_cuts(np.array([3.0, 1, 1, 2, np.nan]), 31).tolist() == [1.5, 2.5]
    assert FO.quantile_cuts(np.array([4.0, 4]), 31).tolist() == []
    cuts = FO.quantile_cuts(np.arange(1000.0), 4)
    assert len(cuts) == 4 and np.allclose(cuts, [199.5, 399.5, 599.5, 799.5], atol=1)


def test_settings_the_executors_do_not_know_stay_with_the_library(made, monkeypatch):
    monkeypatch.setattr(M, "FOREST_ROWS", 4000)
    monkeypatch.setattr(M, "GROWN_ROWS", 100)
    est = M.estimators()["random_forest"].setNumTrees(4).setMaxDepth(2).setImpurity("entropy")
    assert isinstance(est.fit(made), M.ForestInParts)
