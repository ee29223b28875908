"""Classification metrics as aggregations.

Inputs are (group..., label, prediction[, score]) rows; every metric
is a grouped count followed by arithmetic on a tiny table, so cost is
one scan plus one partial aggregation regardless of row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators.ranking import prefix_sums


def confusion_matrix(df: DataFrame, group: Sequence[str], label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """(group..., actual, predicted, n) with all four cells present."""
    group = list(group)
    g = df.groupBy(*group).agg(*[
        F.count(F.when((F.col(label) == a) & (F.col(prediction) == p), 1)).alias(f"c{a}{p}")
        for a in (0, 1) for p in (0, 1)])
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                               F.col(f"c{a}{p}").alias("n")) for a in (0, 1) for p in (0, 1)])
    return g.select(*group, F.explode(cells).alias("_c")).select(*group, "_c.*")


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, group: Sequence[str], label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support, macro and weighted averages,
    accuracy and specificity; zero division -> 0."""
    group = list(group)
    g = df.groupBy(*group).agg(*[
        F.count(F.when((F.col(label) == a) & (F.col(prediction) == p), 1)).cast("double").alias(f"c{a}{p}")
        for a in (0, 1) for p in (0, 1)])
    tn, fp, fn, tp = F.col("c00"), F.col("c01"), F.col("c10"), F.col("c11")
    n = tn + fp + fn + tp
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1 = _safe_div(2 * p1 * r1, p1 + r1)
    f0 = _safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    rows = F.array(
        F.struct(F.lit("0").alias("class"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("class"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), _safe_div(p0 * s0 + p1 * s1, n).alias("precision"),
                 _safe_div(r0 * s0 + r1 * s1, n).alias("recall"), _safe_div(f0 * s0 + f1 * s1, n).alias("f1"),
                 n.alias("support")),
        F.struct(F.lit("accuracy").alias("class"), _safe_div(tn + tp, n).alias("precision"),
                 _safe_div(tn + tp, n).alias("recall"), _safe_div(tn + tp, n).alias("f1"), n.alias("support")),
        F.struct(F.lit("specificity").alias("class"), r0.alias("precision"), r0.alias("recall"), r0.alias("f1"),
                 s0.alias("support")),
    )
    out = g.select(*group, F.explode(rows).alias("_r")).select(*group, "_r.*")
    return out.withColumn("support", F.col("support").cast("long"))


def accuracy(df: DataFrame, group: Sequence[str], label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*group).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, group: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC with ties counted one half (Mann-Whitney).

    Scores collapse to distinct values with (pos, neg) counts, then a
    distributed prefix sum gives negatives ranked below each score:
    AUC = sum(pos * (neg_below + neg / 2)) / (P * N).
    """
    group = list(group)
    by_score = df.groupBy(*group, F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("_neg"))
    cum = prefix_sums(by_score, group, "_s", ["_neg"])
    pairs = F.sum("_pos") * F.sum("_neg")
    # a single-class group has no (positive, negative) pair: AUC undefined -> null
    return cum.groupBy(*group).agg(
        F.when(pairs > 0, F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2.0)) / pairs)
        .alias("auc"))


def train_test_gap(df: DataFrame, group: Sequence[str], split_col: str = "split",
                   label: str = "label", prediction: str = "prediction") -> DataFrame:
    acc = accuracy(df, [*group, split_col], label, prediction)
    return acc.groupBy(*group).agg(
        F.max(F.when(F.col(split_col) == "train", F.col("accuracy"))).alias("train_accuracy"),
        F.max(F.when(F.col(split_col) == "test", F.col("accuracy"))).alias("test_accuracy")
    ).withColumn("gap", F.col("train_accuracy") - F.col("test_accuracy"))


def best_by(df: DataFrame, name: str, metric: str, order: str | None = None) -> DataFrame:
    """Argmax row name by metric; ties -> smallest ``order`` (list position)."""
    key = F.struct(F.col(metric), (-F.col(order)) if order else F.lit(0))
    return df.agg(F.max_by(name, key).alias(name), F.max(metric).alias(metric))


def top_k(df: DataFrame, score: str, k: int, tie: str = "id") -> DataFrame:
    """Top-k by score desc, ties by ``tie`` asc (TakeOrderedAndProject)."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)
