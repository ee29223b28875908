"""SMOTE oversampling to a 1:1 class balance (M6).

Synthetic row j (0 <= j < n_major - n_minor) takes minority row
number floor(u_b(j) * n_minor) in hash order as its base, its
(floor(u_n(j) * k) + 1)-th nearest minority neighbour, and the gap
u_g(j): x = base + gap * (neighbour - base). u_* are md5 uniforms with
distinct seeds, so the result is independent of partitioning and can be
reproduced in SQL. Everything is equi-joins on (row number, rank, id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions.exprs import hash_uniform
from churnforge.operators.knn import exact_knn
from churnforge.operators.ranking import hash_rank


def class_counts(df: DataFrame, label: str) -> list[tuple[int, int]]:
    """(label, n) sorted by (n, label): a handful of rows."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r[label], r["n"]) for r in rows), key=lambda t: (t[1], t[0]))


def smote(train: DataFrame, features: Sequence[str], label: str = "label", id_col: str = "id",
          k: int = 5, seed: int = 42) -> DataFrame:
    """Original rows plus synthetic minority rows.

    Output: row_id ('o:<id>' or 's:<j>'), label, synthetic (0/1), features.
    The input comes back unchanged if there is a single class, nothing to add, or
    a minority of k rows or fewer. Rows with a null label are no class here and
    stay as they are; minority rows with a null feature are never used as a base
    or a neighbour.
    """
    features = list(features)
    base_out = train.select(F.concat(F.lit("o:"), F.col(id_col).cast("string")).alias("row_id"),
                            F.col(label).cast("int").alias(label), F.lit(0).alias("synthetic"),
                            *[F.col(c).cast("double").alias(c) for c in features])
    counts = class_counts(train, label)
    if len(counts) < 2:
        return base_out
    (min_label, n_min), (_, n_maj) = counts[0], counts[-1]
    n_syn = n_maj - n_min
    # fewer than k + 1 minority rows have no k neighbours each: the rows stay as they are
    if n_syn <= 0 or n_min <= k:
        return base_out
    mins = train.where(F.col(label) == min_label).select(id_col, *features).dropna(subset=features)
    n_min = mins.count()
    if n_min <= k:
        return base_out
    ranked = hash_rank(mins, [], id_col, seed, rank_col="midx")
    knn = exact_knn(mins, id_col, features, k)
    spark = train.sparkSession
    j = F.col("id")
    syn = spark.range(n_syn).select(
        j.alias("j"),
        F.floor(hash_uniform(j, f"{seed}b") * n_min).cast("long").alias("midx"),
        (F.floor(hash_uniform(j, f"{seed}n") * k) + 1).cast("int").alias("nn_rank"),
        hash_uniform(j, f"{seed}g").alias("gap"))
    base = syn.join(ranked.select("midx", F.col(id_col).alias("base_id"),
                                  *[F.col(c).alias(f"b_{c}") for c in features]), "midx")
    with_nn = base.join(knn.select(F.col("id").alias("base_id"), "nn_rank", "nn_id"), ["base_id", "nn_rank"])
    full = with_nn.join(mins.select(F.col(id_col).alias("nn_id"), *[F.col(c).alias(f"n_{c}") for c in features]),
                        "nn_id")
    synth = full.select(
        F.concat(F.lit("s:"), F.col("j").cast("string")).alias("row_id"),
        F.lit(min_label).cast("int").alias(label), F.lit(1).alias("synthetic"),
        *[(F.col(f"b_{c}") + F.col("gap") * (F.col(f"n_{c}") - F.col(f"b_{c}"))).alias(c) for c in features])
    return base_out.unionByName(synth)
