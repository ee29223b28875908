"""Encodings whose fitted state is a table: ordered target statistics and
one-hot vectors of columns with any number of values (M5, M10, J3).

Nothing here is collected: a vocabulary is numbered by hash rank and rows meet
it in a join that the planner may broadcast or split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions.exprs import null_safe_join
from churnforge.operators.ranking import hash_prefix_sums, hash_rank
from churnforge.operators.reshape import to_long


# ---------------------------------------------------------------- ordered target statistics
def ordered_target_stats(train: DataFrame, cols: Sequence[str], label: str, prior: float, weight: float = 1.0,
                         id_col: str = "id", seed: int = 42) -> DataFrame:
    """(id, column, stat) of every training row and column: the mean label of
    the rows of the same category that come before it in the order of
    md5(seed:id), smoothed with ``weight`` rows of label ``prior``. A row's own
    label never counts, nor do later ones, so the statistic cannot leak it. A
    null category is a category; a null label counts as no row."""
    long = to_long(train.select(id_col, label, *cols), [id_col, label], cols)
    known = long.withColumns({"_n": F.col(label).isNotNull().cast("int"), "_sum": F.coalesce(F.col(label), F.lit(0)).cast("double")})
    sums = hash_prefix_sums(known, ["column", "value"], ["_n", "_sum"], id_col, seed)
    return sums.select(id_col, "column", _smoothed(F.col("_sum_before"), F.col("_n_before"), prior, weight).alias("stat"))


def full_target_stats(train: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(column, value, n, total) over all training rows: what rows outside the
    training set are encoded with."""
    long = to_long(train.select(label, *cols), [label], cols).where(F.col(label).isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("total"))


def apply_target_stats(rows: DataFrame, stats: DataFrame, cols: Sequence[str], prior: float, weight: float = 1.0,
                       id_col: str = "id") -> DataFrame:
    """(id, column, stat) of rows outside the training set; a category never
    seen has the prior."""
    long = to_long(rows.select(id_col, *cols), [id_col], cols)
    met = null_safe_join(long, stats, ["column", "value"], "left")
    return met.select(id_col, "column", _smoothed(F.coalesce("total", F.lit(0.0)), F.coalesce("n", F.lit(0)), prior, weight).alias("stat"))


def _smoothed(total, n, prior: float, weight: float):
    return (total + F.lit(prior * weight)) / (n + F.lit(weight))


def widen_stats(rows: DataFrame, stats: DataFrame, cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """rows with one more column ``<column>_stat`` a categorical column."""
    wide = stats.groupBy(F.col(id_col).alias("_id")).agg(
        *[F.max(F.when(F.col("column") == c, F.col("stat"))).alias(f"{c}_stat") for c in cols])
    return rows.join(wide, F.col(id_col) == F.col("_id")).drop("_id")


# ---------------------------------------------------------------- one-hot of wide columns
def numbered_vocabulary(train: DataFrame, cols: Sequence[str], seed: int = 42) -> DataFrame:
    """(column, value, idx, n): every non-null value of a column numbered from 0
    in the order of md5(seed:value), with its count. Distributed: no task sees
    more than a hash bucket of a column's values."""
    long = to_long(train.select(*cols), [], cols).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return hash_rank(counts, ["column"], "value", seed, rank_col="idx")


def index_columns(rows: DataFrame, vocabulary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rows with ``<column>_idx``: the value's number, null for a null or
    unknown value. One join a column; the vocabulary is unique, so the planner
    may split a hot value's rows."""
    out = rows
    for c in cols:
        own = vocabulary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("idx").alias(f"{c}_idx"))
        out = out.join(own, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
    return out


def sparse_onehot(indexed: DataFrame, vocabulary: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """One sparse vector a row with a component for every value of every column;
    null and unknown values have none. Sizes are one number a column."""
    sizes = {r["column"]: r["size"] for r in vocabulary.groupBy("column").agg((F.max("idx") + 1).alias("size")).collect()}
    given, names = indexed, []
    for c in cols:
        # the encoder takes its size from what it is fitted on: one row with the highest number
        top = indexed.sparkSession.createDataFrame([(float(sizes.get(c, 1)),)], f"{c}_idx double")
        coder = OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"_{c}_hot", dropLast=True).fit(top)
        known = F.coalesce(F.col(f"{c}_idx").cast("double"), F.lit(float(sizes.get(c, 1))))
        given = coder.transform(given.withColumn(f"{c}_idx", known))
        names.append(f"_{c}_hot")
    return VectorAssembler(inputCols=names, outputCol=out).transform(given).drop(*names)
