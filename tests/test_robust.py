"""Inputs that churn tables really have: null labels and features, odd number
text, colliding names, constant columns, missing fields."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnforge.functions.exprs import coerce_numeric, unique_names
from churnforge.operators import clean as C
from churnforge.operators import features as FE
from churnforge.operators import profile as P
from churnforge.operators.evaluate import roc_auc
from churnforge.operators.knn import exact_knn
from churnforge.operators.ranking import exact_quantiles
from churnforge.operators.resample import smote
from churnforge.operators.split import kfold_assign, stratified_split
from churnforge.plans.scoring import ChurnScorer, split_records


def test_null_labels_stay_in_split_and_folds(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "id long, label int")
    s = stratified_split(df, "label")
    assert s.count() == 100 and s.where("split = 'test'").count() == 20
    assert s.where("label is null and split = 'test'").count() == 2
    folds = kfold_assign(df, "label", 5)
    assert folds.count() == 100
    assert {r["count"] for r in folds.where("label is null").groupBy("fold").count().collect()} == {2}


def test_null_groups_keep_their_quantiles_and_auc(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(5)] + [("a", 1.0), ("a", float("nan"))], "g string, v double")
    q = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert q == {None: 2.0, "a": 1.0}
    auc = spark.createDataFrame([(None, 0, 0.1), (None, 1, 0.9), ("a", 1, 0.2), ("a", 0, 0.3)], "m string, label int, score double")
    assert {r["m"]: r["auc"] for r in roc_auc(auc, ["m"]).collect()} == {None: 1.0, "a": 0.0}


def test_knn_reports_points_with_a_null(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else 1.0) for i in range(10)], "id long, a double, b double")
    got = exact_knn(df, "id", ["a", "b"], k=2).collect()
    assert {r["id"] for r in got} == set(range(10))
    assert [tuple(r) for r in got if r["id"] == 3] == [(3, None, None, None)]
    assert not any(r["nn_id"] == 3 for r in got)


def test_knn_takes_any_range(spark):
    rows = [(i, i * 1e-7) for i in range(30)] + [(100, 1e15), (101, -1e300), (102, 5e-324)]
    got = exact_knn(spark.createDataFrame(rows, "id long, a double"), "id", ["a"], k=1).collect()
    nearest = {r["id"]: r["nn_id"] for r in got}
    assert len(nearest) == 33 and nearest[100] in range(30) and nearest[0] == 102


def test_knn_of_stated_queries(spark):
    """Queries meet all points: copies, gaps and points that were not asked for included."""
    rows = [(i, float(i * i % 17), float(i % 5)) for i in range(300)] + [(1000, None, 1.0), (1001, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    asked = spark.createDataFrame([(i,) for i in [*range(0, 300, 50), 1000, 7777]], "q long")
    whole = {tuple(r) for r in exact_knn(df, "id", ["a", "b"], k=3, leaf_vectors=4).collect()}
    got = [tuple(r) for r in exact_knn(df, "id", ["a", "b"], k=3, leaf_vectors=4, queries=asked).collect()]
    assert len(got) == 6 * 3 + 1 and set(got) == {r for r in whole if r[0] % 50 == 0}


def test_knn_visits_travel_once_to_a_block(spark):
    """A vector goes to blocks of leaves, and its visits are not shuffled again for the join."""
    from churnforge.operators import knn

    leaves = spark.range(64).select(F.col("id").alias("leaf"), *[F.array(F.col("id").cast("double")).alias(c) for c in ("low", "high")])
    blocks = knn.make_blocks(leaves)
    assert sorted((r["block"], len(r["leaves"]), r["low"][0], r["high"][0]) for r in blocks.collect()) == [
        (b, 16, 16.0 * b, 16.0 * b + 15) for b in range(4)]
    visits = spark.range(100).select(F.col("id").alias("vid"), F.array(F.lit(1.0)).alias("x"), F.lit(1.0).alias("bound"),
                                     F.col("id").alias("own"), (F.col("id") % 4).alias("node"))
    joined = knn._gathered(visits, 128).join(blocks.hint("merge"), F.col("node") == F.col("block"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(node") == 1


def test_knn_work_follows_the_input(spark):
    """Leaves keep their size, and leaves visited a point their number, at ten times the points."""
    import random

    import numpy as np

    from churnforge.operators import knn

    def work(n):
        rng = random.Random(1)
        rows = [(i, [rng.random() for _ in range(3)], [(f"{i:032d}", i)]) for i in range(n)]
        vectors = spark.createDataFrame(rows, "vid bigint, x array<double>, members array<struct<nh:string,nid:bigint>>")
        leaves = knn.make_leaves(vectors, n, 3, knn.LEAF_VECTORS, 400).collect()
        assert sorted(v for r in leaves for v in r["vids"]) == list(range(n))
        assert len({r["leaf"] for r in leaves}) == len(leaves)
        low, high = (np.array([r[k] for r in leaves]) for k in ("low", "high"))
        visited = 0
        for r in leaves:
            x = np.array(r["flat"]).reshape(-1, 3)
            assert (x.min(axis=0) == r["low"]).all() and (x.max(axis=0) == r["high"]).all()
            visited += len(knn._within(x, knn._kth(knn._sq(x, x), 6), low, high)[0])
        return max(len(r["vids"]) for r in leaves), visited / n

    (most_few, few), (most_many, many) = work(800), work(8000)
    print(f"leaves visited a point: {few:.1f} of 800 points, {many:.1f} of 8000")
    assert most_few <= knn.LEAF_VECTORS and most_many <= knn.LEAF_VECTORS
    assert many < 2 * few


@pytest.mark.parametrize("fan,top,run", [(3, 4, 2), (64, 1024, 128)])
def test_knn_through_levels_of_boxes(spark, fan, top, run):
    """Any tree of boxes gives the brute-force answer, ties and copies included."""
    import random

    import numpy as np

    rng = random.Random(fan)
    rows = [(i, float(rng.randrange(12)), float(rng.randrange(12)), rng.random() * (i % 3)) for i in range(400)]
    rows += [(1000 + i, 5.0, 5.0, 0.0) for i in range(150)] + [(2000, None, 1.0, 1.0), (2001, 1.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = exact_knn(df, "id", ["a", "b", "c"], k=4, leaf_vectors=8, tree_sample=100, fan=fan, top_nodes=top, run_leaves=run).collect()
    good = [r for r in rows if r[0] < 2000]
    x = np.array([r[1:] for r in good])
    key = [hashlib.md5(f"42:{r[0]}".encode()).hexdigest() for r in good]
    want = set()
    for i, r in enumerate(good):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        near = sorted((d2[j], key[j], good[j][0]) for j in range(len(good)) if j != i)[:4]
        want |= {(r[0], n + 1, nid) for n, (_, _, nid) in enumerate(near)}
    assert {(r["id"], r["nn_rank"], r["nn_id"]) for r in got if r["nn_id"] is not None} == want
    assert sorted(r["id"] for r in got if r["nn_id"] is None) == [2000, 2001]


def test_colliding_names_lose_no_category(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b-c"), (3, "b c"), (4, "b_c")], "id long, x string")
    v = FE.fit_onehot(df, ["x"])
    names = [n for n, _, _ in v.feature_names(True)]
    assert len(names) == len(set(names)) == 3
    rows = FE.apply_onehot(df, v).orderBy("id").collect()
    assert [sum(r[n] for n in names) for r in rows] == [0.0, 1.0, 1.0, 1.0]
    assert unique_names(["a", "a", "a__2", "a"], ["b"]) == ["a", "a__2", "a__2__2", "a__3"]


@pytest.mark.parametrize("text,want", [("5d", None), ("7f", None), ("0x1p3", None), ("nan", None), ("Infinity", None), (" ", None),
                                       ("", None), (None, None), (" 5.5 ", 5.5), ("-1e3", -1000.0), (".5", 0.5), ("5.", 5.0), ("+2", 2.0)])
def test_number_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(coerce_numeric("t").alias("x")).first()["x"] == want


def test_nan_is_missing_and_constant_columns_are_flat(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (float("nan"), 4.0), (4.0, 4.0), (9.0, 4.0)], "a double, k double")
    d = {r["column"]: r for r in P.describe_numeric(df, ["a", "k"]).collect()}
    s = pd.Series([1.0, 2.0, math.nan, 4.0, 9.0])
    assert (d["a"]["count"], d["a"]["mean"], d["a"]["q50"]) == (4, s.mean(), s.median())
    m = {r["column"]: r for r in P.moments(df, ["a", "k"]).collect()}
    assert m["a"]["skewness"] == pytest.approx(s.skew()) and m["a"]["kurtosis"] == pytest.approx(s.kurt())
    assert (m["k"]["skewness"], m["k"]["kurtosis"]) == (0.0, 0.0)
    assert {r["column"]: r["n_missing"] for r in P.column_overview(df).collect()} == {"a": 1, "k": 0}
    assert C.drop_constant_columns(df, ["a", "k"]).columns == ["a"]
    filled = C.impute_median(df, "a").collect()
    assert [r["a"] for r in filled] == [1.0, 2.0, 3.0, 4.0, 9.0] and [r["was_missing"] for r in filled] == [0, 0, 1, 0, 0]


def test_a_label_named_all_is_a_label(spark):
    df = spark.createDataFrame([("all", 1.0), ("b", 2.0), (None, 3.0)], "l string, v double")
    got = {(r["overall"], r["group"]): r["n"] for r in P.boxplot_stats(df, ["v"], "l").collect()}
    assert got == {(1, None): 3, (0, "all"): 1, (0, "b"): 1}


def test_smote_with_too_few_or_broken_rows(spark):
    rows = [(i, 0, float(i)) for i in range(30)] + [(100 + i, 1, float(i)) for i in range(4)] + [(200, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, label int, a double")
    assert smote(df, ["a"], k=5).count() == 35                      # 4 rows have no 5 neighbours: all stay as they are
    more = df.unionByName(spark.createDataFrame([(300 + i, 1, None if i == 0 else float(i)) for i in range(5)], df.schema))
    out = smote(more, ["a"], k=5)
    assert out.where("synthetic = 0").count() == 40 and out.where("synthetic = 1 and a is null").count() == 0


def test_every_record_is_valid_or_rejected(spark):
    vocab = FE.Vocabulary(["segment", "region", "urgent_user"], {"segment": ["A"], "region": ["R"], "urgent_user": ["Yes", "No"]})
    good = dict(id=1, customer_id="C1", segment="A", region="R", urgent_user="Yes", in_debt=0, tenure=1, n_orders=1,
                max_order=1.0, acctbal=1.0, total_text="5")
    cases = [good, good | dict(id=2, region=None), good | dict(id=3, total_text="5d"), good | dict(id=4, segment="Z", region="Q")]
    schema = ("id long, customer_id string, segment string, region string, urgent_user string, in_debt int, tenure int, "
              "n_orders int, max_order double, acctbal double, total_text string")
    df = spark.createDataFrame([tuple(c.values()) for c in cases], schema)
    ok, bad = split_records(df, vocab)
    assert [r["id"] for r in ok.collect()] == [1]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {
        2: "missing:region", 3: "not_numeric:total_text", 4: "unknown_category:segment=Z,region=Q"}
    ok, bad = split_records(df.drop("tenure", "total_text"), vocab)          # absent fields
    assert ok.count() == 0 and "tenure" in bad.where("id = 1").first()["reason"]


def test_one_median_for_fit_and_score(spark):
    from churnforge.plans.churn import raw, split_table, typed
    from tests.conftest import SF_MID
    s = split_table(spark, SF_MID)
    train = s.where("split = 'train'").select("id")
    known = typed(spark, SF_MID).join(train, "id", "left_semi").where(F.col("total_charges").isNotNull()).toPandas()
    missing = typed(spark, SF_MID).where("total_charges is null").select("id")
    filled = {r["total_charges"] for r in s.join(missing, "id", "left_semi").select("total_charges").collect()}
    assert filled == {known["total_charges"].median()}
    from pyspark.ml.classification import LogisticRegression
    raw_train = raw(spark, SF_MID).join(train, "id", "left_semi")
    scorer = ChurnScorer.fit(s, raw_train, LogisticRegression(labelCol="label", featuresCol="features"))
    assert {scorer.median} == filled


def test_profile_keys_read_only_what_they_need(spark):
    from churnforge.plans.queries import REGISTRY
    from tests.conftest import SF_SMALL
    need = {"churn_rate_by": "o_orderdate", "category_counts": "o_orderdate", "crosstab_label": "o_orderdate"}
    for key, col in need.items():
        plan = REGISTRY[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan, key
        assert "o_totalprice" not in plan and col in plan, key


def test_no_checkpoint_folder_on_a_cluster_is_an_error():
    from churnforge.session import ensure_checkpoint_dir

    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_every_embedding_has_its_neighbours(spark, tmp_path):
    """Ids that are not divisible by 100 are asked for as well, by the key and by its SQL."""
    import duckdb

    from churnforge.plans.oracle import all_sql
    from churnforge.plans.queries import REGISTRY
    rows = [(i, [float((i * 7 + 3 * d) % 11) for d in range(4)]) for i in range(1, 31)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in REGISTRY["knn_embeddings"](spark, str(tmp_path)).select("id", "nn_rank", "nn_id", "dist2").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(con.execute(f"SELECT id, nn_rank, nn_id, dist2 FROM ({all_sql()['knn_embeddings']})").fetchall())
    assert len(got) == 150 and got == want
