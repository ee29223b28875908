"""Split, folds, encoders, scalers, kNN and SMOTE properties."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from churnforge.operators import features as FE
from churnforge.operators.knn import exact_knn
from churnforge.operators.resample import smote
from churnforge.operators.split import class_quotas, kfold_assign, stratified_split


def test_reference_quota_arithmetic(spark):
    # 5174 No / 1869 Yes -> 1409 test rows = 1035 + 374 (reference report supports)
    rows = [(i, 0) for i in range(5174)] + [(5174 + i, 1) for i in range(1869)]
    df = spark.createDataFrame(rows, "id long, label int")
    q = {r["label"]: r["test_quota"] for r in class_quotas(df, "label", 0.2).collect()}
    assert q == {0: 1035, 1: 374}
    s = stratified_split(df, "label")
    got = {(r["label"], r["split"]): r["n"] for r in s.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got[(0, "test")] == 1035 and got[(1, "test")] == 374
    assert got[(0, "train")] == 4139 and got[(1, "train")] == 1495
    assert s.select("id").distinct().count() == 7043


def test_folds_balanced(spark):
    df = spark.range(103).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    f = kfold_assign(df, "label", 5)
    per = f.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in per.collect())


def test_onehot_and_unknown(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, x string")
    v = FE.fit_onehot(train, ["x"])
    assert v.values == {"x": ["a", "b", "c"]}
    test = spark.createDataFrame([(4, "b"), (5, "zz"), (6, None)], "id long, x string")
    out = {r["id"]: r for r in FE.apply_onehot(test, v, drop_first=True).collect()}
    assert (out[4]["x_b"], out[4]["x_c"]) == (1.0, 0.0)
    assert (out[5]["x_b"], out[5]["x_c"]) == (0.0, 0.0)          # unknown -> zeros
    with pytest.raises(Exception):
        FE.apply_onehot(test, v, drop_first=True, handle_unknown="error").collect()


def test_scalers_sklearn_semantics(spark):
    train = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id long, a double, k double")
    p = FE.fit_standard(train, ["a", "k"])
    assert p.b["a"] == pytest.approx(1.0)          # population std
    row = FE.apply_scaler(train, p).where("id = 1").first()
    assert row["a"] == pytest.approx(-1.0) and row["k"] == 0.0
    mm = FE.fit_minmax(train, ["a", "k"])
    rows = FE.apply_scaler(train, mm).collect()
    assert all(0.0 <= r["a"] <= 1.0 and r["k"] == 0.0 for r in rows)


def _brute_knn(pts, k):
    out = {}
    for i, p in pts.items():
        d = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), hashlib.md5(f"42:{j}".encode()).hexdigest(), j)
                   for j, q in pts.items() if j != i)
        out[i] = [j for _, _, j in d[:k]]
    return out


def test_exact_knn_matches_brute_force(spark):
    rnd = random.Random(5)
    pts = {i: (rnd.gauss(0, 1), rnd.gauss(0, 3), float(rnd.randint(0, 1))) for i in range(150)}
    for i in range(150, 170):            # a dense clump of exact duplicates
        pts[i] = (0.5, 0.5, 1.0)
    pts[170] = (40.0, -40.0, 0.0)        # a far outlier
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "id long, a double, b double, c double")
    got = exact_knn(df, "id", ["a", "b", "c"], k=4, leaf_vectors=4)
    res = {}
    for r in got.collect():
        res.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    expect = _brute_knn(pts, 4)
    assert set(res) == set(expect)
    for i, lst in res.items():
        assert [j for _, j in sorted(lst)] == expect[i]


def test_exact_knn_hot_duplicates_and_dense_cluster(spark):
    rnd = random.Random(9)
    pts = {i: (1.0, 2.0) for i in range(60)}                           # a third: one value
    pts.update({60 + i: (5 + rnd.random() * 1e-3, 5 + rnd.random() * 1e-3) for i in range(60)})  # dense
    pts.update({120 + i: (rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(60)})       # sparse
    pts[180] = (1.0, 2.0 + 1e-9)
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "id long, a double, b double")
    got = exact_knn(df, "id", ["a", "b"], k=3, leaf_vectors=4)
    res = {}
    for r in got.collect():
        res.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    expect = _brute_knn(pts, 3)
    assert set(res) == set(expect)
    for i, lst in res.items():
        assert [j for _, j in sorted(lst)] == expect[i]


def test_smote_balances_and_interpolates(spark):
    rows = [(i, 0, float(i % 7), float(i % 5)) for i in range(60)] + \
           [(100 + i, 1, 10.0 + i, 20.0 - i) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    out = smote(df, ["a", "b"], "label", "id", k=3)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 60, 1: 60}
    syn = out.where("synthetic = 1").collect()
    assert len(syn) == 48
    for r in syn:   # minority points lie on the line a + b = 30 -> so must synthetic ones
        assert r["a"] + r["b"] == pytest.approx(30.0)
        assert 10.0 <= r["a"] <= 21.0


def test_smote_single_class_passthrough(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "id long, label int, a double")
    assert smote(df, ["a"]).count() == 2


def test_knn_edge_cases(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(10)], "id long, a double, b double")
    got = exact_knn(same, "id", ["a", "b"], k=3).collect()
    assert len(got) == 30 and all(r["dist2"] == 0.0 for r in got)
    expect = _brute_knn({i: (1.0, 2.0) for i in range(10)}, 3)
    res = {}
    for r in got:
        res.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    assert {i: [j for _, j in sorted(v)] for i, v in res.items()} == expect
    two = spark.createDataFrame([(1, 0.0), (2, 3.0)], "id long, a double")
    pairs = {(r["id"], r["nn_id"], r["dist2"]) for r in exact_knn(two, "id", ["a"], k=5).collect()}
    assert pairs == {(1, 2, 9.0), (2, 1, 9.0)}
