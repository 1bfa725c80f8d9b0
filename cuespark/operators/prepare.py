"""From an embedding table to scaled train and test features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.functions.vectors import fill_gaps, has_gap
from cuespark.operators.sampling import class_counts, stratified_split, train_quotas
from cuespark.schema import require_columns


def nan_audit(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with NULL or NaN elements: one row."""
    gap = F.coalesce(has_gap(F.col(column)), F.lit(True))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(gap).alias("rows_with_gaps"),
        F.coalesce(F.max(gap), F.lit(False)).alias("any_gap"),
    )


def clean_features(df: DataFrame, column: str = "embedding") -> DataFrame:
    """If any element is missing, fill gaps with zeros and make infinities finite."""
    if not nan_audit(df, column).first()["any_gap"]:
        return df
    return df.withColumn(column, fill_gaps(F.col(column)))


def feature_moments(df: DataFrame, by: str | None = None, column: str = "embedding") -> DataFrame:
    """Mean and population std of every dimension: (by, dim, mean, std).

    One vector summary per task is shuffled, not one row per element.
    """
    group = [by] if by else []
    rows = df.select(
        *group,
        array_to_vector(F.transform(F.col(column), lambda x: x.cast("double"))).alias("_v"),
    )
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col("_v"))
    found = rows.groupBy(*group).agg(summary.alias("s"))
    n = F.col("s.count")
    mean, variance = vector_to_array("s.mean"), vector_to_array("s.variance")
    return found.select(
        *group,
        F.posexplode(
            F.arrays_zip(
                mean.alias("mean"),
                F.transform(variance, lambda v: F.sqrt(v * (n - 1) / n)).alias("std"),
            )
        ).alias("dim", "_m"),
    ).select(*group, "dim", "_m.mean", "_m.std")


class _Scaling(HasInputCol, HasOutputCol):
    pass


class PopulationScaler(Estimator, _Scaling, DefaultParamsReadable, DefaultParamsWritable):
    """Standardise an array column with the population std; a constant dimension is centred.

    (Spark's own StandardScaler divides by the sample std.)
    """

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        rows = feature_moments(dataset, column=self.getInputCol()).orderBy("dim").collect()
        model = PopulationScalerModel(
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
            mean=[r["mean"] for r in rows],
            scale=[r["std"] or 1.0 for r in rows],
        )
        return model


class PopulationScalerModel(Model, _Scaling, DefaultParamsReadable, DefaultParamsWritable):
    mean = Param(Params._dummy(), "mean", "mean per dimension", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "divisor per dimension", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, mean=None, scale=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        centre = F.array(*[F.lit(float(m)) for m in self.getOrDefault(self.mean)])
        divisor = F.array(*[F.lit(float(s)) for s in self.getOrDefault(self.scale)])
        centred = F.zip_with(self.getInputCol(), centre, lambda x, m: x.cast("double") - m)
        scaled = F.zip_with(centred, divisor, lambda x, s: x / s)
        return dataset.withColumn(self.getOutputCol(), array_to_vector(scaled))


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    preprocessing: PipelineModel
    classes: list[str]
    n_train: int
    n_test: int
    dim: int

    def unpersist(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def split_and_scale(
    df: DataFrame,
    target: str = "gender",
    key: str = "vec_id",
    column: str = "embedding",
    test_size: float = 0.2,
    seed: int = 42,
    counts: dict[str, int] | None = None,
) -> tuple[DataFrame, PipelineModel]:
    """All rows with `split`, `label` and `features`; the scaler has seen training rows only."""
    require_columns(df, target, key, column)
    counts = counts or class_counts(df, target)
    cleaned = clean_features(df, column)
    parts = stratified_split(cleaned, target, key, test_size, seed, counts=counts)
    encoder = StringIndexerModel.from_labels(list(counts), inputCol=target, outputCol="label")
    train = parts.filter(F.col("split") == "train")
    scaler = PopulationScaler(inputCol=column, outputCol="features").fit(train)
    preprocessing = PipelineModel([encoder, scaler])
    return preprocessing.transform(parts), preprocessing


def prepare(
    df: DataFrame,
    target: str = "gender",
    key: str = "vec_id",
    column: str = "embedding",
    test_size: float = 0.2,
    seed: int = 42,
) -> Prepared:
    """Fill, encode, split, scale.  Both sides are persisted: every estimator reads them."""
    counts = class_counts(df, target)
    rows, preprocessing = split_and_scale(df, target, key, column, test_size, seed, counts)
    n_train = sum(train_quotas(counts, test_size).values())
    keep = [key, target, "label", "features"]
    train = rows.filter(F.col("split") == "train").select(*keep).persist()
    test = rows.filter(F.col("split") == "test").select(*keep).persist()
    scaler = preprocessing.stages[-1]
    return Prepared(
        train=train,
        test=test,
        preprocessing=preprocessing,
        classes=list(counts),
        n_train=n_train,
        n_test=sum(counts.values()) - n_train,
        dim=len(scaler.getOrDefault(scaler.mean)),
    )
