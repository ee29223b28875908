"""Registered queries: smoke entry, DuckDB oracle parity at sf0.001, streaming = batch."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"column", "value", "n", "churn_rate"}


def test_every_oracle_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


FAST_KEYS = ["scan_schema", "csv_round_trip", "coerce_numeric", "impute_median", "validate_records", "reject_records", "describe_numeric",
             "moments", "unique_profile", "describe_categorical", "boxplot_stats", "high_corr_columns", "unknown_categories",
             "category_association", "stratified_split", "kfold_assign", "docs_split", "minmax_scale", "feature_names",
             "classification_report", "roc_auc", "smote", "class_balance", "check_linear", "check_importance",
             "check_shapley", "check_permutation", "check_search", "check_run_summary", "check_scoring",
             "ordered_target_stats", "onehot_wide", "corr_embeddings", "check_knn_lsh"]


@pytest.mark.parametrize("key", FAST_KEYS)
def test_oracle_parity(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    exp = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == exp


def test_reject_keys_find_something(con):
    for key in ("reject_records", "unknown_categories", "high_corr_columns"):
        assert con.execute(E.oracle_sql()[key]).fetchall(), key


def test_tree_scores_and_the_global_attribution(spark):
    """Keys without SQL of their own: sound probabilities, whole tables, sorted."""
    n_test = spark.sql("select 1") and E.queries()["stratified_split"](spark, SF_SMALL).where("split = 'test'").count()
    for key in ("gbt_scores", "gbt_categorical"):
        out = E.queries()[key](spark, SF_SMALL).collect()
        assert len(out) == n_test and all(0 <= r["probability"] <= 1 for r in out)
    top = [r["mean_abs_shap"] for r in E.queries()["shapley_global"](spark, SF_SMALL).collect()]
    assert len(top) == 10 and top == sorted(top, reverse=True) and top[0] > 0
