"""Profiling operators vs pandas on tiny frames; cleaning edge cases."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnforge.operators import clean as C
from churnforge.operators import profile as P
from churnforge.sources.reports import write_table
from churnforge.sources.tables import read_records
from churnforge.plans.churn import CHURN_SCHEMA

# Ten raw rows in the customer-table layout (blank TotalCharges-like text included).
ROWS = [
    (1, "C1", "BUILDING", "ASIA", "Yes", 0, 12, 3, 1000.5, 55.0, "1201.50", "No"),
    (2, "C2", "BUILDING", "ASIA", "No", 1, 0, 1, 20.0, -5.0, " ", "Yes"),
    (3, "C3", "MACHINERY", "EUROPE", "No", 0, 300, 9, 5000.0, 100.0, "9000.00", "No"),
    (4, "C4", "FURNITURE", "AFRICA", "Yes", 0, 45, 4, 250.0, 75.5, "600.25", "Yes"),
    (5, "C5", "BUILDING", "EUROPE", "No", 1, 700, 12, 7000.0, -1.0, "20000.00", "No"),
    (6, "C6", "HOUSEHOLD", "ASIA", "No", 0, 5, 2, 90.0, 10.0, "150.00", "Yes"),
    (7, "C7", "MACHINERY", "AFRICA", "Yes", 0, 88, 5, 888.0, 88.0, "2100.00", "No"),
    (8, "C8", "BUILDING", "ASIA", "No", 0, 33, 3, 330.0, 33.0, "abc", "No"),
    (9, "C9", "AUTOMOBILE", "EUROPE", "Yes", 1, 2, 1, 15.0, -20.0, "15.00", "Yes"),
    (10, "C10", "AUTOMOBILE", "AFRICA", "No", 0, 150, 6, 1500.0, 0.0, "4000.00", "No"),
]
NUM = ["in_debt", "tenure", "n_orders", "max_order", "acctbal"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, CHURN_SCHEMA)


def test_describe_matches_pandas(df):
    pdf = pd.DataFrame(ROWS, columns=CHURN_SCHEMA.fieldNames())
    got = {r["column"]: r for r in P.describe_numeric(df, NUM).collect()}
    d = pdf[NUM].astype(float).describe()
    for c in NUM:
        for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
            assert got[c][ours] == pytest.approx(d.loc[theirs, c], rel=1e-9, abs=1e-9)


def test_moments_match_pandas(df):
    pdf = pd.DataFrame(ROWS, columns=CHURN_SCHEMA.fieldNames())[NUM].astype(float)
    got = {r["column"]: r for r in P.moments(df, NUM).collect()}
    for c in NUM:
        assert got[c]["skewness"] == pytest.approx(pdf[c].skew(), rel=1e-9)
        assert got[c]["kurtosis"] == pytest.approx(pdf[c].kurt(), rel=1e-9)


def test_corr_matches_pandas(df):
    pdf = pd.DataFrame(ROWS, columns=CHURN_SCHEMA.fieldNames())[NUM].astype(float)
    cm = pdf.corr()
    for r in P.corr_matrix(df, NUM).collect():
        assert r["corr"] == pytest.approx(cm.loc[r["col_a"], r["col_b"]], rel=1e-9)


def test_coercion_and_validation(df):
    c = C.coerce_columns(df, {"tc": "total_text"})
    vals = {r["id"]: r["tc"] for r in c.collect()}
    assert vals[2] is None and vals[8] is None and vals[1] == 1201.5
    v = {r["id"]: r for r in C.validate_records(df, ["segment"], ["total_text"]).collect()}
    assert v[2]["bad_numeric"] == "total_text" and v[2]["is_valid"] == 0
    assert v[1]["is_valid"] == 1


def test_median_impute_and_constant(spark, df):
    c = C.coerce_columns(df, {"tc": "total_text"})
    out = {r["id"]: r for r in C.impute_median(c, "tc").collect()}
    known = sorted(x for x in [1201.5, 9000, 600.25, 20000, 150, 2100, 15, 4000])
    med = (known[3] + known[4]) / 2
    assert out[2]["tc"] == pytest.approx(med) and out[2]["was_missing"] == 1
    k = df.withColumn("const", F.lit("x"))
    cc = {r["column"]: r["is_constant"] for r in C.constant_columns(k, ["const", "segment"]).collect()}
    assert cc == {"const": 1, "segment": 0}


def test_categorical_profiles(df):
    top = {r["column"]: r for r in P.describe_categorical(df, ["segment"]).collect()}
    assert top["segment"]["top"] == "BUILDING" and top["segment"]["freq"] == 4
    odds = {r["value"]: r["odds_pct"] for r in
            P.category_odds(df.withColumn("label", (F.col("churn") == "Yes").cast("int")), ["region"], "label").collect()}
    assert odds["ASIA"] == round(2 / (2 + 1e-6) * 100, 2)


def test_csv_scan_with_schema(spark, tmp_path, df):
    path = str(tmp_path / "cust.csv")
    write_table(df, path, "csv")
    back = read_records(spark, path, CHURN_SCHEMA, "csv")
    assert back.count() == 10
    assert {r["total_text"] for r in back.where("id = 2").collect()} == {" "}


def test_column_overview_approx_close_to_exact(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    ex = {r["column"]: r["n_unique"] for r in P.column_overview(df).collect()}
    ap = {r["column"]: r["n_unique"] for r in P.column_overview(df, approx=True).collect()}
    assert ex == {"a": 5000, "b": 7}
    assert abs(ap["a"] - 5000) / 5000 < 0.06 and ap["b"] == 7
