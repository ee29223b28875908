"""Resumable search, shared boosting fits, patience, target statistics, wide columns."""

import hashlib
import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import Observation
from pyspark.sql import functions as F

from churnforge.operators import encode as EN
from churnforge.operators import models as M
from churnforge.operators import tuning as TU
from churnforge.operators.lsh import brute_force_knn, lsh_knn, recall_of
from churnforge.operators.profile import unique_profile, wide_corr
from churnforge.operators.ranking import exact_quantiles
from churnforge.session import boosting_partitions, cut_lineage, scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(240):
        a, b = rng.random(), rng.random()
        data.append((i, a, b, int(a + 0.3 * rng.random() > 0.7), i % 3, rng.choice(["x", "y", None])))
    df = spark.createDataFrame(data, "id long, a double, b double, label int, fold int, kind string")
    return cut_lineage(M.assemble(df, ["a", "b"]).coalesce(1))


def gbt(**how):
    return GBTClassifier(labelCol="label", featuresCol="features", maxDepth=2, seed=1, **how)


def test_first_rounds_equal_a_shorter_fit(rows):
    long, short = gbt(maxIter=8).fit(rows), gbt(maxIter=3).fit(rows)
    cut = TU.first_rounds(long, 3)
    assert cut.getNumTrees == 3 and long.getNumTrees == 8
    a, b = ({r["id"]: r["probability"] for r in M.score(m, rows).collect()} for m in (cut, short))
    assert a == b


def test_a_killed_search_goes_on(spark, rows, monkeypatch):
    """What is written is not fitted again; an unfinished point is."""
    store = scratch_path(spark, "search-test")
    grid = [{"maxIter": 2}, {"maxIter": 4}, {"maxIter": 2, "maxDepth": 1}]
    learners = {"gbt": TU.Learner(rows, gbt(), grid)}
    fits, armed = [], [True]
    fit = GBTClassifier.fit

    def counted(self, data, params=None):
        fits.append(self.getMaxIter())
        if armed and len(fits) == 4:
            raise RuntimeError("killed")
        return fit(self, data, params)

    monkeypatch.setattr(GBTClassifier, "fit", counted)
    with pytest.raises(RuntimeError, match="killed"):
        TU.fold_scores(learners, store, parallel=1)
    armed.clear()
    found = TU.search_all(learners, "auc", store, parallel=2)
    assert len(fits) == 7                          # two fits a fold serve three points; one fit was lost
    out = found.collect()
    assert sorted((r["point"], r["fold"]) for r in out) == [(p, f) for p in range(3) for f in range(3)]
    assert sum(r["n"] for r in out) == 3 * 240 and len({r["point"] for r in out if r["is_best"]}) == 1
    fits.clear()
    again = TU.search_all(learners, "auc", store).collect()
    assert not fits and sorted(map(str, again)) == sorted(map(str, out))
    fresh = TU.search_all(learners, "auc", scratch_path(spark, "search-test")).collect()
    assert {(r["point"], r["fold"]): r["auc"] for r in fresh} == {(r["point"], r["fold"]): r["auc"] for r in out}


def test_search_of_one_learner_with_resampling(rows):
    lr = LogisticRegression(labelCol="label", featuresCol="features")
    out = M.search(rows.drop("features"), "fold", lr, [{"regParam": 0.0}, {"regParam": 0.5}], "f1", ["a", "b"],
                   lambda df: df.unionByName(df.where("label = 1"))).collect()
    assert len(out) == 6 and all(0 <= r["f1"] <= 1 for r in out)


def test_comparison_has_cross_validated_scores(rows):
    parts = {"train": rows.where("fold > 0"), "valid": rows.where("fold = 0"), "test": rows.where("fold = 0")}
    table, scored, models = M.compare_scored(parts, {"gbt": gbt(maxIter=3)}, folds=rows)
    r = table.first()
    assert 0.5 < r["cv_auc"] <= 1 and 0 < r["cv_f1"] <= 1 and r["valid_auc"] == r["auc"]
    sizes = {x["part"]: x["count"] for x in scored.groupBy("part").count().collect()}
    assert sizes == {"train": 160, "valid": 80, "test": 80, "fold0": 80, "fold1": 80, "fold2": 80}
    assert M.compare(parts, {"gbt": gbt(maxIter=2)})[0].first()["cv_auc"] is None


def test_a_large_forest_is_fitted_in_parts(spark, rows, monkeypatch):
    """Parts have all trees between them; their votes add up to the forest's scores."""
    est = M.estimators()["random_forest"].setNumTrees(10).setMaxDepth(4)
    whole = est.fit(rows)
    assert whole.getNumTrees == 10                      # a small one is one model, as ever
    monkeypatch.setattr(M, "FOREST_ROWS", 4 * rows.count())
    monkeypatch.setattr(M, "FOREST_NODES", 60)
    model = est.fit(rows)
    parts = [M.RandomForestClassificationModel.load(p) for p, _ in model.parts]
    assert [p.getNumTrees for p in parts] == [4, 4, 2] and len({p.trees[0].toDebugString for p in parts}) == 3
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9 and M.reloaded(model, spark) is model
    got = {r["id"]: r for r in M.score(model, rows).collect()}
    for r in rows.select("id", "features").collect():
        p = sum(m.predictRaw(r["features"])[1] for m in parts) / 10
        assert abs(got[r["id"]]["probability"] - p) < 1e-9 and got[r["id"]]["prediction"] == int(p > 0.5)


def test_deep_forests_of_a_search_take_turns(spark, rows, monkeypatch):
    """The driver holds one deep forest at a time, shallow ones and other learners go on beside it."""
    now, most, lock, fit = [], [], threading.Lock(), M.Forest._fit

    def watched(self, data):
        with lock:
            now.append(self.getMaxDepth())
            most.append(sorted(now))
        time.sleep(0.5)
        try:
            return fit(self, data)
        finally:
            with lock:
                now.remove(self.getMaxDepth())

    monkeypatch.setattr(M.Forest, "_fit", watched)
    monkeypatch.setattr(M, "FOREST_ROWS", TU.FITS_AT_A_TIME * 100)
    est = M.estimators()["random_forest"].setNumTrees(4)
    grid = [{"maxDepth": 12}, {"maxDepth": 2}, {"maxDepth": 13}]
    learners = {"random_forest": TU.Learner(rows, est, grid), "gbt": TU.Learner(rows, gbt(), [{"maxIter": 2}])}
    found = TU.fold_scores(learners, scratch_path(spark, "turns")).groupBy("learner", "point").count().collect()
    assert {(r["learner"], r["point"]): r["count"] for r in found} == {
        ("random_forest", 0): 240, ("random_forest", 1): 240, ("random_forest", 2): 240, ("gbt", 0): 240}
    assert len(most) == 9 and max(sum(d > 2 for d in x) for x in most) == 1 and max(map(len, most)) > 1


def test_patience(rows):
    train, valid = rows.where("fold > 0"), rows.where("fold = 0")
    model, losses, best = TU.fit_with_patience(gbt(stepSize=0.5), train, valid, rounds=40, patience=4, begin=6)
    assert model.getNumTrees == best and losses[best - 1] == min(losses)
    assert len(losses) == min(40, best + 4)
    whole, all_losses, _ = TU.fit_with_patience(gbt(stepSize=0.5), train, valid, rounds=5, patience=50, begin=2)
    assert len(all_losses) == 5 and all_losses == losses[:5]


def test_a_large_table_is_boosted_once(rows, monkeypatch):
    """No refits: as many rounds as allowed, one fit, and the result of the refits."""
    train, valid = rows.where("fold > 0"), rows.where("fold = 0")
    fits, fit = [], GBTClassifier.fit

    def counted(self, data, params=None):
        fits.append(self.getMaxIter())
        return fit(self, data, params)

    monkeypatch.setattr(GBTClassifier, "fit", counted)
    small, losses, best = TU.fit_with_patience(gbt(stepSize=0.1), train, valid, rounds=14, patience=13, begin=3)
    assert fits == [3, 6, 12, 14]
    fits.clear()
    monkeypatch.setattr(TU, "ONE_FIT_ROWS", train.count())
    large, same_losses, same_best = TU.fit_with_patience(gbt(stepSize=0.1), train, valid, rounds=14, patience=13, begin=3)
    assert fits == [14] and (same_losses, same_best) == (losses, best)
    assert large.toDebugString.partition("\n")[2] == small.toDebugString.partition("\n")[2]


def test_ordered_statistics_see_earlier_rows_only(spark, rows):
    stats = {r["id"]: r["stat"] for r in EN.ordered_target_stats(rows, ["kind"], "label", 0.5, 2.0).collect()}
    seen = {}
    data = sorted(((hashlib.md5(f"42:{r['id']}".encode()).hexdigest(), r["id"], r["kind"], r["label"]) for r in rows.collect()))
    for _, i, kind, label in data:
        n, total = seen.get(kind, (0, 0))
        assert math.isclose(stats[i], (total + 1.0) / (n + 2.0))
        seen[kind] = n + 1, total + label
    full = EN.full_target_stats(rows, ["kind"], "label")
    other = spark.createDataFrame([(1, "x"), (2, None), (3, "new")], "id long, kind string")
    got = {r["id"]: r["stat"] for r in EN.apply_target_stats(other, full, ["kind"], 0.5, 2.0).collect()}
    for i, kind in ((1, "x"), (2, None)):
        n, total = seen[kind]
        assert math.isclose(got[i], (total + 1.0) / (n + 2.0))
    assert got[3] == 0.5


def test_one_hot_of_a_wide_column(spark):
    train = spark.createDataFrame([(f"v{i % 3000}", "a" if i % 2 else None) for i in range(4000)], "wide string, narrow string")
    vocabulary = EN.numbered_vocabulary(train, ["wide", "narrow"])
    wide = {r["value"]: r["idx"] for r in vocabulary.where("column = 'wide'").collect()}
    assert sorted(wide.values()) == list(range(3000))
    df = spark.createDataFrame([(1, "v7", "a"), (2, "unseen", "a"), (3, None, None), (4, "v2999", "b")], "id long, wide string, narrow string")
    out = {r["id"]: r["features"] for r in EN.sparse_onehot(EN.index_columns(df, vocabulary, ["wide", "narrow"]), vocabulary,
                                                          ["wide", "narrow"]).collect()}
    assert {len(v) for v in out.values()} == {3001}
    assert sorted(out[1].indices) == sorted([wide["v7"], 3000]) and list(out[2].indices) == [3000]
    assert len(out[3].indices) == 0 and list(out[4].indices) == [wide["v2999"]]


def test_quantiles_narrow_in_stages(spark):
    """However few values may be ordered at once, the quantiles are numpy's."""
    rng = random.Random(3)
    data = [("skew", math.exp(12 * rng.random())) for _ in range(3000)] + [("few", float(rng.randrange(4))) for _ in range(900)]
    data += [("hot", 1.5 if rng.random() < 0.6 else rng.gauss(0, 1e6)) for _ in range(2000)] + [("one", 2.0), ("wide", -1e308), ("wide", 1e308)]
    df = spark.createDataFrame(data, "part string, v double")
    probs = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99, "lo": 0.0, "hi": 1.0}
    for most in (3, 50, 10_000):
        got = {r["part"]: r for r in exact_quantiles(df, ["part"], "v", probs, accuracy=200, most_ordered=most).collect()}
        for part in ("skew", "few", "hot", "one"):
            x = [v for p, v in data if p == part]
            for name, p in probs.items():
                assert math.isclose(got[part][name], float(np.quantile(x, p)), rel_tol=1e-12), (most, part, name)


def test_wide_correlation_with_gaps(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) + 1e6
    x[:, 5] = 3.0
    holes = rng.random(x.shape) < 0.1
    data = [(i, [None if h else float(v) for v, h in zip(r, hs)][:6 if i else 2]) for i, (r, hs) in enumerate(zip(x, holes))]
    got = {(r["dim_a"], r["dim_b"]): r["corr"] for r in wide_corr(spark.createDataFrame(data, "id long, v array<double>"), "v", 6).collect()}
    m = np.array([(v + [None] * 6)[:6] for _, v in data], float)
    assert len(got) == 15
    for (a, b), r in got.items():
        ok = ~np.isnan(m[:, a]) & ~np.isnan(m[:, b])
        assert r is None if b == 5 else math.isclose(r, np.corrcoef(m[ok, a], m[ok, b])[0, 1], abs_tol=1e-9)


def test_distinct_values_end_early(spark):
    df = spark.createDataFrame([(i, i % 3, None if i % 2 else "t", i % 12, i % 13) for i in range(500)], "id long, a int, t string, p int, q int")
    got = {r["column"]: (r["n_unique"], r["values"]) for r in unique_profile(df, df.columns, 12).collect()}
    assert got == {"id": (500, None), "a": (3, "0,1,2"), "t": (2, "0,t"), "q": (13, None),
                   "p": (12, ",".join(sorted(map(str, range(12)))))}


def test_lsh_neighbours(spark):
    """Recall of the true neighbours; a crowded cell is cut into parts and loses nothing."""
    rng = np.random.default_rng(2)
    hubs = rng.standard_normal((20, 32))
    x = hubs[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 32))
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [float("nan")] * 32), (5002, [1.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    asked = df.where("id % 100 = 0").select("id")
    exact = cut_lineage(brute_force_knn(df, "id", "v", asked, 5, block=16))
    d2 = ((x[::100, None] - x[None]) ** 2).sum(axis=2)
    d2[np.arange(30), np.arange(0, 3000, 100)] = np.inf
    assert {(r["id"], r["nn_rank"]): r["nn_id"] for r in exact.collect()} == {
        (100 * q, k + 1): int(j) for q in range(30) for k, j in enumerate(np.argsort(d2[q])[:5])}
    for how in ({}, {"cell_rows": 20, "query_rows": 2}):
        found = cut_lineage(lsh_knn(df, "id", "v", asked, 5, **how))
        hits = recall_of(found, exact).agg(F.sum("hits"), F.sum("wanted")).first()
        assert hits[1] == 150 and hits[0] >= 0.9 * hits[1]
        assert all(math.isclose(r["dist2"], d2[r["id"] // 100, r["nn_id"]]) for r in found.collect())
    assert lsh_knn(df.limit(0), "id", "v", asked, 5).count() == 0


def test_a_search_after_an_observation(spark, rows):
    """A fitted linear model's training summary leads to the session, which no
    longer travels to tasks once something in it was observed."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    linear = LogisticRegression(labelCol="label", featuresCol="features", maxIter=3)
    scores = TU.fold_scores({"linear": TU.Learner(rows, linear, [{"regParam": 0.0}])}, scratch_path(spark, "observed"))
    assert scores.count() == 240


def test_boosting_runs_on_few_partitions(spark):
    def parts(n, **how):
        return boosting_partitions(spark.range(n), "id", **how).rdd.getNumPartitions()

    assert (parts(0), parts(9_000), parts(20_000), parts(150_001), parts(600_000)) == (1, 1, 2, 3, 8)
    assert parts(3_000_000) == 12 and boosting_partitions(spark.range(150_001), "id").count() == 150_001


def test_a_comparison_boosts_on_few_partitions(rows):
    """Of the training part and of the folds, however they were dealt before."""
    seen = []

    class Watched(GBTClassifier):
        def _fit(self, data):
            seen.append(data.rdd.getNumPartitions())
            return super()._fit(data)

    many = cut_lineage(rows.repartition(6, "id"))
    est = Watched(labelCol="label", featuresCol="features", maxDepth=2, maxIter=2, seed=1)
    _, scored, _ = M.compare_scored({"train": many, "valid": rows, "test": rows}, {"gbt": est}, folds=many)
    assert seen == [1] * 4
    assert {r["part"]: r["count"] for r in scored.groupBy("part").count().collect()} == {
        "train": 240, "valid": 240, "test": 240, "fold0": 80, "fold1": 80, "fold2": 80}
