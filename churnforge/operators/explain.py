"""Model explanations as Spark jobs.

Both operators build one exploded table and score it with a single
batch ``transform``:

* permutation importance: for feature f, each row takes f from its
  partner row (the next row in md5 order, cyclically) and keeps the
  rest; importance = AUC(original) - AUC(permuted f).
* sampled Shapley values: for row x, background row z (its partner)
  and M feature permutations p, step i uses x's values for the first
  i features of p and z's for the rest; the marginal change of the
  class-1 probability between steps i and i+1 is credited to p[i] and
  averaged over permutations (interventional Shapley, Monte Carlo).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnforge.operators import evaluate as EV
from churnforge.operators.ranking import hash_rank


def with_partner(df: DataFrame, id_col: str, features: Sequence[str], seed: int = 7) -> DataFrame:
    """Attach ``z_<f>``: feature values of the next row in md5 order (cyclic)."""
    n = df.select(F.count(F.lit(1))).scalar()
    r = hash_rank(df, [], id_col, seed, rank_col="_r")
    partner = r.select(((F.col("_r") - 1 + n) % n).alias("_r"), *[F.col(c).alias(f"z_{c}") for c in features])
    return r.join(partner, "_r").drop("_r")


def _vector(cols):
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def permutation_importance(model, test: DataFrame, features: Sequence[str], label: str = "label",
                           id_col: str = "id", seed: int = 7) -> DataFrame:
    features = list(features)
    p = with_partner(test.select(id_col, label, *features), id_col, features, seed)
    idx = F.explode(F.array(*[F.lit(i) for i in range(-1, len(features))])).alias("_f")
    x = p.select(id_col, label, *features, *[f"z_{c}" for c in features], idx)
    perm = x.select(id_col, label, "_f", *[F.when(F.col("_f") == i, F.col(f"z_{c}")).otherwise(F.col(c)).alias(c)
                                           for i, c in enumerate(features)])
    scored = model.transform(_vector(features).transform(perm)).select(
        "_f", label, vector_to_array("probability")[1].alias("score"))
    auc = EV.roc_auc(scored, ["_f"], label, "score")
    # the AUC table has d + 1 rows: a global window over it is bounded
    auc = auc.withColumn("base_auc", F.max(F.when(F.col("_f") == -1, F.col("auc"))).over(Window.partitionBy()))
    names = F.array(*[F.lit(c) for c in features])
    return (auc.where(F.col("_f") >= 0)
            .select(F.element_at(names, F.col("_f") + 1).alias("feature"),
                    F.col("auc").alias("permuted_auc"), (F.col("base_auc") - F.col("auc")).alias("importance")))


def _perm(m: int, features: Sequence[str], seed: int) -> list[int]:
    key = lambda i: hashlib.md5(f"{seed}:{m}:{features[i]}".encode()).hexdigest()
    return sorted(range(len(features)), key=key)


def hash_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = 7) -> DataFrame:
    """The n rows first in md5 order (all if there are fewer)."""
    return hash_rank(df, [], id_col, seed, rank_col="_r").where(F.col("_r") < n).drop("_r")


def shapley_sampled(model, rows: DataFrame, features: Sequence[str], id_col: str = "id",
                    n_perm: int = 8, seed: int = 7, sample_rows: int | None = None) -> DataFrame:
    """(id, feature, shap) averaged over ``n_perm`` permutations.

    ``sample_rows`` explains only so many rows (chosen by hash; None: all).
    The two vectors of a step lie in one row, so no step ever looks for its
    neighbour: the only shuffle is the pre-aggregated mean at the end.
    """
    features = list(features)
    d = len(features)
    p = with_partner(rows.select(id_col, *features), id_col, features, seed)
    if sample_rows is not None:
        p = hash_sample(p, sample_rows, id_col, seed)
    perms = [_perm(m, features, seed) for m in range(n_perm)]
    # position of each feature in each permutation: a (n_perm x d) literal table
    pos = F.array(*[F.array(*[F.lit(perm.index(j)) for j in range(d)]) for perm in perms])
    order = F.array(*[F.array(*[F.lit(j) for j in perm]) for perm in perms])
    steps = F.explode(F.sequence(F.lit(0), F.lit(n_perm * d - 1))).alias("_s")
    grid = p.select(id_col, *features, *[f"z_{c}" for c in features], steps)
    grid = grid.withColumn("_m", F.floor(F.col("_s") / d).cast("int")).withColumn("_i", (F.col("_s") % d).cast("int"))

    def mixed(done: int):
        """Features whose place in the permutation is below step + done come from x."""
        return [F.when(F.element_at(F.element_at(pos, F.col("_m") + 1), j + 1) < F.col("_i") + done, F.col(c))
                .otherwise(F.col(f"z_{c}")) for j, c in enumerate(features)]

    both = grid.select(id_col, F.element_at(F.element_at(order, F.col("_m") + 1), F.col("_i") + 1).alias("_feat"),
                       array_to_vector(F.array(*mixed(0))).alias("_before"),
                       array_to_vector(F.array(*mixed(1))).alias("_after"))

    def scored(df: DataFrame, col: str, out: str) -> DataFrame:
        done = model.transform(df.withColumnRenamed(col, "features"))
        keep = [c for c in df.columns if c != col]
        return done.select(*keep, vector_to_array("probability")[1].alias(out))

    delta = scored(scored(both, "_before", "_p0"), "_after", "_p1").withColumn("_delta", F.col("_p1") - F.col("_p0"))
    names = F.array(*[F.lit(c) for c in features])
    return delta.groupBy(id_col, "_feat").agg(F.avg("_delta").alias("shap")).select(
        id_col, F.element_at(names, F.col("_feat") + 1).alias("feature"), "shap")


def shapley_totals(model, rows: DataFrame, features: Sequence[str], id_col: str = "id", seed: int = 7) -> DataFrame:
    """(id, total): p(x) - p(z), what a row's Shapley values have to add up to."""
    features = list(features)
    p = with_partner(rows.select(id_col, *features), id_col, features, seed)
    x = _vector(features).transform(p)
    px = model.transform(x).select(id_col, vector_to_array("probability")[1].alias("_px"))
    z = _vector(features).transform(p.select(id_col, *[F.col(f"z_{c}").alias(c) for c in features]))
    pz = model.transform(z).select(F.col(id_col).alias("_z"), vector_to_array("probability")[1].alias("_pz"))
    return px.join(pz, F.col(id_col) == F.col("_z")).select(id_col, (F.col("_px") - F.col("_pz")).alias("total"))


def global_attribution(shap: DataFrame, k: int = 10) -> DataFrame:
    """Mean |shap| per feature, top k."""
    g = shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    return g.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(k)
