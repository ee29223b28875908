"""Shared plan fragments: raw customer table -> clean modelling table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.operators.clean import coerce_columns, encode_label, impute_median
from churnforge.sources.tables import CATEGORICAL, CHURN_SCHEMA, NUMERIC, churn_customers

NUMERIC_CLEAN = NUMERIC + ["total_charges"]
FEATURE_INPUTS = CATEGORICAL + NUMERIC_CLEAN


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast to a fixed schema (explicit-schema scan semantics)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(churn_customers(spark, sf_dir), CHURN_SCHEMA)


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers parsed, label encoded; total_charges may be missing. Lazy, so a
    profile that needs three columns reads three columns."""
    c = coerce_columns(raw(spark, sf_dir), {"total_charges": "total_text"})
    c = encode_label(c, "churn", "label")
    return c.select("id", *CATEGORICAL, *NUMERIC_CLEAN, "label")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiling table: ``typed`` with missing total_charges filled by the
    median of the whole table. Models never read it (see split_table)."""
    return impute_median(typed(spark, sf_dir), "total_charges", flag=None)


# ---------------------------------------------------------------- modelling inputs
from dataclasses import dataclass  # noqa: E402

from churnforge.operators import features as FE  # noqa: E402
from churnforge.operators.split import kfold_assign, stratified_split  # noqa: E402
from churnforge.session import cut_lineage  # noqa: E402

VALID_FOLDS = 5


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 80/20 ``split`` column (seed 42), then missing total_charges
    filled with the median of the training rows: nothing about the test rows
    reaches the table before the split.

    The table feeds several fits and scorers; it is written to the session's
    checkpoint folder (shared storage on a cluster), which cuts the lineage
    back to the orders aggregation.
    """
    s = cut_lineage(stratified_split(typed(spark, sf_dir), "label"))
    train = s.where(F.col("split") == "train")
    return cut_lineage(impute_median(s, "total_charges", flag=None, median_source=train))


def with_validation(train: DataFrame, label: str = "label") -> DataFrame:
    """Add ``is_valid``: one stratified fifth of the training rows, on which
    models are chosen; the test rows only ever measure the chosen one."""
    return kfold_assign(train, label, VALID_FOLDS).withColumn("is_valid", F.col("fold") == 0).drop("fold")


@dataclass
class Encoded:
    df: DataFrame               # id, label, split, feature columns
    features: list[str]         # model input order
    vocab: FE.Vocabulary
    scaler: FE.ScalerParams


def encode_standard(split_df: DataFrame) -> Encoded:
    """Variant A: standard-scaled numerics, then one-hot (drop first,
    unknown -> zeros); every parameter fitted on train rows only."""
    train = split_df.where(F.col("split") == "train")
    vocab = FE.fit_onehot(train, CATEGORICAL)
    sc = FE.fit_standard(train, NUMERIC_CLEAN)
    enc = FE.apply_onehot(FE.apply_scaler(split_df, sc), vocab, drop_first=True)
    names = NUMERIC_CLEAN + [n for n, _, _ in vocab.feature_names(True)]
    return Encoded(enc.select("id", "label", "split", *names), names, vocab, sc)


def encode_minmax(split_df: DataFrame) -> Encoded:
    """Variant B: one-hot (drop first), then min-max on every column."""
    train = split_df.where(F.col("split") == "train")
    vocab = FE.fit_onehot(train, CATEGORICAL)
    oh = FE.apply_onehot(split_df, vocab, drop_first=True)
    names = NUMERIC_CLEAN + [n for n, _, _ in vocab.feature_names(True)]
    sc = FE.fit_minmax(oh.where(F.col("split") == "train"), names)
    enc = FE.apply_scaler(oh, sc)
    return Encoded(enc.select("id", "label", "split", *names), names, vocab, sc)


# ---------------------------------------------------------------- rule scorers
# Deterministic score formulas (rational, so Spark and SQL agree bit for bit):
# the oracle-checkable stand-ins for a fitted model in the evaluation keys.
RULES = {
    "rule_tenure": "365.0 / (tenure + 365.0)",
    "rule_orders": "5.0 / (n_orders + 5.0)",
    "rule_blend": "0.5 * (365.0 / (tenure + 365.0)) + 0.3 * (5.0 / (n_orders + 5.0)) + 0.2 * in_debt",
}
RULE_ORDER = {name: i for i, name in enumerate(RULES)}


def rule_scores(split_df: DataFrame) -> DataFrame:
    """(id, label, split, model, model_order, score, prediction) for every rule."""
    arr = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(i).alias("model_order"),
                             F.expr(v).cast("double").alias("score")) for i, (k, v) in enumerate(RULES.items())])
    s = split_df.select("id", "label", "split", F.explode(arr).alias("_m")).select(
        "id", "label", "split", "_m.*")
    return s.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
