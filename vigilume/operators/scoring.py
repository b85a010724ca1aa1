"""Reconstruction errors of days, and scores of windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F
from pyspark.sql.types import DoubleType

from vigilume.config import Settings
from vigilume.functions.folded import FLAGS, FOLD, SCORES, is_folded, set_apart, unfold
from vigilume.operators.windows import WINDOW, window_totals


def profile_errors(days: DataFrame, columns: Sequence[str], history: int) -> DataFrame:
    """Squared distance of every column to the user's mean over the preceding ``history`` days.

    Without earlier days there is nothing to compare with, and the error is 0. Errors of folded days are folded; see
    :func:`_errors_of_folded`.
    """
    if is_folded(days):
        return _errors_of_folded(days, columns, history)
    before = W.partitionBy("user_id").orderBy("date").rowsBetween(-history, -1)

    kept = [c for c in days.columns if c not in columns]
    return _squared_errors(days, list(columns), before).select(*kept, *columns)


def _errors_of_folded(days: DataFrame, columns: Sequence[str], history: int) -> DataFrame:
    """:func:`profile_errors` of folded days, but for flags and trait scores, which :func:`unfold_errors` compares.

    After ``history`` rows of one folded row the rows before are all of it, so these are set apart, and what is left has one error for
    all its rows in what comes from the events.
    """
    rows = set_apart(days.repartition("user_id"), history)
    before = W.partitionBy("user_id").orderBy("date", "_place").rowsBetween(-history, -1)
    return _squared_errors(rows, [c for c in columns if c in rows.columns], before)


def _squared_errors(days: DataFrame, columns: list[str], before: WindowSpec) -> DataFrame:
    """``columns`` become their squared distance to their mean over ``before``, 0 without one; NULLs don't count.

    The days of a frame are held as one list of arrays: an average of its own for each of many columns takes many times as long.
    """
    met = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(before)
    none = F.array_repeat(F.lit(0.0), len(columns))
    added = lambda value: F.aggregate("_met", none, lambda so_far, x: F.zip_with(so_far, x, lambda a, b: a + value(b)))
    sums, known = added(lambda b: F.coalesce(b, F.lit(0.0))), added(lambda b: F.when(b.isNull(), 0.0).otherwise(1.0))
    means = F.zip_with(sums, known, lambda s, n: F.when(n > 0, s / n))
    compared = days.select("*", met.alias("_met")).select(*days.columns, means.alias("_means"))
    off = {c: F.col(c) - F.get("_means", F.lit(i)) for i, c in enumerate(columns)}
    return compared.select(*[F.coalesce(off[c] * off[c], F.lit(0.0)).alias(c) if c in off else F.col(c) for c in days.columns])


def unfold_errors(errors: DataFrame, columns: Sequence[str], history: int) -> DataFrame:
    """A row for each pair, with the errors of the flags and trait scores among ``columns``; errors that are not folded stay as they are."""
    if not is_folded(errors):
        return errors
    rows = unfold(errors, place="_pair")
    before = W.partitionBy("user_id").orderBy("date", "_pair").rowsBetween(-history, -1)
    context = [c for c in columns if c in (*FLAGS, *SCORES)]
    kept = [c for c in rows.columns if c not in ("_pair", *FLAGS, *SCORES)]
    off = {c: F.col(c) - F.avg(c).over(before) for c in context}  # a few columns of many rows
    return rows.select(*kept, *[F.coalesce(x * x, F.lit(0.0)).alias(c) for c, x in off.items()])


def day_error(errors: DataFrame, columns: Sequence[str], history: int | None = None) -> DataFrame:
    """Mean squared error of a day over the given columns; of folded errors, which need ``history``, a row for each pair."""
    if is_folded(errors):
        own = [c for c in columns if c in errors.columns]
        kept = [c for c in errors.columns if c not in (*columns, *FOLD)]
        summed = errors.select(*kept, *FOLD, sum((F.col(c) for c in own), F.lit(0.0)).alias("_summed"))
        rows = unfold_errors(summed, columns, history)
        total = sum((F.col(c) for c in columns if c not in own), F.col("_summed"))
        return rows.select(*kept, (total / F.lit(float(len(columns)))).alias("error"))
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    kept = [c for c in errors.columns if c not in columns]
    return errors.select(*kept, (total / F.lit(float(len(columns)))).alias("error"))


def window_score(day_errors: DataFrame, lookback: int, stride: int, cfg: Settings) -> DataFrame:
    """Weighted mean and maximum of the day errors of every window; padded days count with error 0."""
    return window_totals(
        day_errors.select("user_id", "date", "is_insider", "error"), lookback, stride,
        end_date=F.max("date"), label=F.max("is_insider"), _sum=F.sum("error"), max_error=F.max("error"),
    ).select(
        *WINDOW, "end_date", "label", (F.col("_sum") / F.lit(float(lookback))).alias("mean_error"), "max_error",
        (F.col("_sum") / F.lit(float(lookback)) * cfg.mean_weight + F.col("max_error") * cfg.max_weight).alias("score"),
    )


def day_vectors(days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Assemble ``columns`` into one vector per day; NULL counts as 0."""
    filled = days.na.fill(0.0, list(columns))
    return VectorAssembler(inputCols=list(columns), outputCol="vector").transform(filled)


def fit_pca(train: DataFrame, k: int) -> PCAModel:
    """Linear autoencoder: the covariance is summed on the executors, its eigenvectors are found once."""
    return PCA(k=k, inputCol="vector", outputCol="encoded").fit(train)


def pca_errors(days: DataFrame, model: PCAModel, n_features: int) -> DataFrame:
    """Mean squared reconstruction error under the model's components."""
    return projection_errors(model.transform(days), n_features)


def projection_errors(encoded: DataFrame, n_features: int) -> DataFrame:
    """Mean squared reconstruction error of ``vector`` from ``encoded``, its projection on orthonormal components: the squared
    residual is the squared length that the projection loses."""
    def squared(v: Column) -> Column:
        return F.aggregate(vector_to_array(v), F.lit(0.0), lambda acc, x: acc + x * x)

    lost = squared(F.col("vector")) - squared(F.col("encoded"))
    return encoded.withColumn("error", F.greatest(lost, F.lit(0.0)) / F.lit(float(n_features)))


def window_embedding(encoded: DataFrame, width: int, lookback: int, stride: int, pooling: str = "mean") -> DataFrame:
    """One vector per window from encoded days of ``width`` numbers: their mean (padding counts as
    zeros) or the last day."""
    day = encoded.select("user_id", "date", vector_to_array("encoded").alias("z"))
    names = [f"_z{i}" for i in range(width)]
    if pooling == "last":
        pooled, totals = F.col("_last"), {"_last": F.last("z")}
    elif pooling == "mean":
        pooled, totals = F.array(*[F.col(n) / F.lit(float(lookback)) for n in names]), {n: F.sum(F.col("z")[i]) for i, n in enumerate(names)}
    else:
        raise ValueError(f"unknown pooling {pooling!r}")
    return window_totals(day, lookback, stride, end_date=F.max("date"), **totals).select(*WINDOW, "end_date", pooled.alias("embedding"))


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, one row per dimension; sums are combined before the shuffle."""
    parts = vectors.select(group, F.posexplode(vector).alias("dim", "value"))
    return parts.groupBy(group, "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))


def batch_score(windows: DataFrame, make_predict: Callable, lookback: int, n_features: int, batch_size: int = 256) -> DataFrame:
    """Score whole windows with a supplied model.

    ``make_predict()`` loads the model once per Python worker and returns a function from an array
    (batch, lookback * n_features) to one score per row.
    """
    scorer = predict_batch_udf(
        make_predict, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[lookback * n_features]]
    )
    flat = F.flatten(F.transform("days", lambda d: d["x"]))
    return windows.withColumn("score", scorer(flat)).drop("days")


def linear_autoencoder(components: list[list[float]], lookback: int, cfg: Settings) -> Callable:
    """A model for ``batch_score``: squared residual after projecting on the given components."""
    mean_weight, max_weight = cfg.mean_weight, cfg.max_weight

    def make_predict():
        import numpy as np

        p = np.asarray(components, dtype=float)

        def predict(flat):
            x = np.asarray(flat, dtype=float).reshape(len(flat), lookback, p.shape[0])
            rest = x - x @ p @ p.T
            per_day = (rest**2).mean(axis=2)
            return mean_weight * per_day.mean(axis=1) + max_weight * per_day.max(axis=1)

        return predict

    return make_predict


def calibration_scores(scored: DataFrame, splits: DataFrame) -> DataFrame:
    """Scores of validation windows; of training windows where there are no validation users."""
    usable = splits.where(F.col("split").isin("train", "val"))
    chosen = usable.agg(F.max("split").alias("_chosen")).scalar()
    return scored.join(usable.where(F.col("split") == chosen), "user_id").drop("split")

