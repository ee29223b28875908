"""Fitted churn scorer: validate -> coerce -> impute -> encode -> scale ->
align -> predict, for batch tables and streams (C1-C3, S4).

Fitted state is a handful of small tables (median, scaler parameters,
vocabulary, feature list) plus a Spark ML model, saved under one
folder and reloaded without refitting. The transform is stateless and
row-local, so the same code scores a streaming DataFrame.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions.exprs import coerce_numeric
from churnforge.operators import features as FE
from churnforge.operators.clean import median_of, validate_records
from churnforge.operators.models import TREE_EXEC, assemble
from churnforge.session import boosting_partitions, cut_lineage, training_partitions
from churnforge.sources.tables import CATEGORICAL, NUMERIC

NUMERIC_CLEAN = NUMERIC + ["total_charges"]
RECORD_FIELDS = ["customer_id", *CATEGORICAL, *NUMERIC, "total_text"]


@dataclass
class ChurnScorer:
    median: float
    scaler: FE.ScalerParams
    vocab: FE.Vocabulary
    features: list[str]
    model: PipelineModel

    # ------------------------------------------------------------ fit
    @staticmethod
    def fit(split_df: DataFrame, raw_train: DataFrame, estimator: Estimator | None = None) -> ChurnScorer:
        """Fit every parameter on training rows only. ``split_df`` is filled with
        the training median; the same median fills records at scoring time.
        Any classifier on (features, label) will do; boosted trees by default."""
        coerced = raw_train.withColumn("total_charges", coerce_numeric("total_text"))
        spark = raw_train.sparkSession
        med = spark.range(1).select(median_of(coerced, "total_charges").alias("m")).first()["m"]
        train = split_df.where(F.col("split") == "train")
        vocab = FE.fit_onehot(train, CATEGORICAL)
        sc = FE.fit_standard(train, NUMERIC_CLEAN)
        feats = NUMERIC_CLEAN + [n for n, _, _ in vocab.feature_names(True)]
        enc = FE.apply_onehot(FE.apply_scaler(train, sc), vocab, drop_first=True)
        estimator = estimator or GBTClassifier(labelCol="label", featuresCol="features", maxIter=50, maxDepth=5,
                                               stepSize=0.3, seed=42, **TREE_EXEC)
        deal = boosting_partitions if isinstance(estimator, GBTClassifier) else training_partitions
        model = estimator.fit(cut_lineage(deal(cut_lineage(assemble(enc, feats)), "id")))
        return ChurnScorer(float(med) if med is not None else 0.0, sc, vocab, feats, PipelineModel([model]))

    # ------------------------------------------------------------ apply
    def prepare(self, records: DataFrame) -> DataFrame:
        r = records.withColumn("total_charges",
                               F.coalesce(coerce_numeric("total_text"), F.lit(self.median)))
        r = FE.apply_onehot(FE.apply_scaler(r, self.scaler), self.vocab, drop_first=True, keep_source=True)
        return VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(r)

    def score(self, records: DataFrame, id_col: str = "id") -> DataFrame:
        """(id, churn_prediction, churn_probability, no_churn_probability, churn_label)."""
        out = self.model.transform(self.prepare(records))
        prob = vector_to_array("probability")
        return out.select(
            id_col, F.col("prediction").cast("int").alias("churn_prediction"),
            prob[1].alias("churn_probability"), prob[0].alias("no_churn_probability"),
            F.when(F.col("prediction") == 1, "Churned").otherwise("Retain").alias("churn_label"))

    def split(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(valid records, rejected records with reason) by the fitted vocabulary."""
        return split_records(records, self.vocab)

    # ------------------------------------------------------------ persistence
    def save(self, spark: SparkSession, path: str) -> str:
        self.scaler.to_df(spark).write.mode("overwrite").parquet(f"{path}/scaler")
        self.vocab.to_df(spark).write.mode("overwrite").parquet(f"{path}/vocab")
        meta = json.dumps({"median": self.median, "features": self.features, "cols": self.vocab.cols,
                           "taken": self.vocab.taken})
        spark.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/meta")
        self.model.write().overwrite().save(f"{path}/model")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> ChurnScorer:
        """The saved scorer, whichever learner it holds."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        sc = FE.ScalerParams.from_df(spark.read.parquet(f"{path}/scaler").orderBy("column"))
        sc.cols = [c for c in NUMERIC_CLEAN if c in sc.a]
        vals: dict[str, list[str]] = {c: [] for c in meta["cols"]}
        for r in spark.read.parquet(f"{path}/vocab").orderBy("column", "idx").collect():
            vals[r["column"]].append(r["value"])
        return ChurnScorer(meta["median"], sc, FE.Vocabulary(meta["cols"], vals, meta["taken"]), meta["features"],
                           PipelineModel.load(f"{path}/model"))


def unknown_in(vocab: FE.Vocabulary, records: DataFrame) -> Column:
    """Comma list of the record's non-null categories outside the vocabulary."""
    return F.concat_ws(",", *[
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*vocab.values[c]), F.concat(F.lit(f"{c}="), F.col(c)))
        for c in vocab.cols if c in records.columns])


def split_records(records: DataFrame, vocab: FE.Vocabulary | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected records with reason).

    A record is rejected if a required field is null or absent, if a numeric
    field holds text that is no number, or if a category is not in the
    vocabulary; the first that holds, in this order, is the reason. Every
    record is in exactly one of the two. Row-local, so it serves streams.
    """
    v = validate_records(records, RECORD_FIELDS, ["total_text"])
    v = v.withColumn("unknown", unknown_in(vocab, records) if vocab is not None else F.lit(""))
    good = (F.col("is_valid") == 1) & (F.col("unknown") == "")
    reason = (F.when(F.col("missing_fields") != "", F.concat(F.lit("missing:"), "missing_fields"))
              .when(F.col("bad_numeric") != "", F.concat(F.lit("not_numeric:"), "bad_numeric"))
              .otherwise(F.concat(F.lit("unknown_category:"), "unknown")))
    return v.where(good).select(*records.columns), v.where(~good).select("id", reason.alias("reason"))
