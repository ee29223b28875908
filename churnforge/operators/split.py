"""Reproducible splits and folds.

Order inside a stratum is md5('<seed>:' || id), tie-broken by id, so
the same split is produced by Spark on any partitioning and by plain
SQL. Per-class quotas follow stratified shuffle-split arithmetic:
n_test = ceil(test_size * n); train quotas are floor(n_train * n_c / n)
plus one for the largest remainders (ties: smallest class value, null
last); test quota = n_c - train quota. Rows with a null label are a class
of their own and stay in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnforge.operators.ranking import hash_rank, hash_rank_below


def class_quotas(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """(label, n_c, test_quota): one row per class, a bounded table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = df.select(F.count(F.lit(1))).scalar()
    n_train = n - F.ceil(F.lit(test_size) * n)
    cont = n_train * F.col("n_c") / n
    q = counts.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont"))
    # the class table has one row per label value: a global window over it is bounded
    need = n_train - q.select(F.sum("_fl")).scalar()
    w = Window.orderBy((F.col("_cont") - F.col("_fl")).desc(), F.col(label).asc_nulls_last())
    q = q.withColumn("_extra", F.when(F.row_number().over(w) <= need, 1).otherwise(0))
    return q.select(label, "n_c", (F.col("n_c") - F.col("_fl") - F.col("_extra")).cast("long").alias("test_quota"))


def stratified_split(df: DataFrame, label: str, id_col: str = "id", test_size: float = 0.2,
                     seed: int = 42, bits: int = 16, split_col: str = "split") -> DataFrame:
    """Add ``split`` in {'train','test'} with exact per-class test quotas.

    Only the boundary md5 bucket of each class is ordered (hash_rank_below).
    """
    quotas = class_quotas(df, label, test_size).select(label, F.col("test_quota").alias("quota"))
    out = hash_rank_below(df, quotas, [label], id_col, seed, bits, "_test")
    return out.withColumn(split_col, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def random_split(df: DataFrame, id_col: str = "id", test_size: float = 0.2, seed: int = 42,
                 bits: int = 16, split_col: str = "split") -> DataFrame:
    """Unstratified: the ceil(test_size * n) rows first in hash order are test."""
    n = df.select(F.count(F.lit(1))).scalar()
    quotas = df.sparkSession.range(1).select(F.ceil(F.lit(test_size) * n).alias("quota"))
    out = hash_rank_below(df, quotas, [], id_col, seed, bits, "_test")
    return out.withColumn(split_col, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def kfold_assign(df: DataFrame, label: str | None, k: int = 5, id_col: str = "id",
                 seed: int = 42, bits: int = 16, fold_col: str = "fold") -> DataFrame:
    """Stratified k folds: fold = (rank within class in hash order) mod k,
    so every fold holds floor or ceil of n_c / k rows of each class."""
    parts = [label] if label else []
    ranked = hash_rank(df, parts, id_col, seed, bits, rank_col="_rank")
    return ranked.withColumn(fold_col, (F.col("_rank") % k).cast("int")).drop("_rank")
