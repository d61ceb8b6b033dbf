"""Feature vectors and reproducible splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators.lags import lag_names


def label_indexer(label: str, index: str) -> StringIndexer:
    """Frequency-descending indexer, ties by label, for small label sets inside an ML pipeline.

    ``joins.fit_dictionary`` gives the same indexes without gathering the labels.
    """
    return StringIndexer(inputCol=label, outputCol=index, stringOrderType="frequencyDesc")


def assemble(df: DataFrame, inputs: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol=output).transform(df)


def assemble_lags(df: DataFrame, codes: Sequence[str], metric: str, horizon: int) -> DataFrame:
    """Code columns followed by the lags 1..H, the order every model here is trained on."""
    return assemble(df, [*codes, *lag_names(metric, horizon)])


def state_vector(codes: Sequence[str], state: Column) -> Column:
    """The same vector from code columns and a newest-first array of past values."""
    code_array = F.array(*[F.col(c).cast("double") for c in codes]) if codes else F.array().cast("array<double>")
    return array_to_vector(F.concat(code_array, state))


class FeatureSizeError(ValueError):
    """A model is fed vectors of another size than it was trained on."""


def check_feature_size(model: Model, size: int) -> None:
    """Tree models score over-long vectors without complaint, so compare before scoring."""
    trained = getattr(model, "bestModel", model).numFeatures
    if trained != size:
        raise FeatureSizeError(f"model was trained on {trained} features, got {size}")


def md5_bucket(keys: Sequence[str], buckets: int, seed: int = 0) -> Column:
    """Bucket of a key that no repartitioning changes."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def hash_split(df: DataFrame, keys: Sequence[str], train_share: float = 0.9, seed: int = 1234) -> DataFrame:
    """Add ``is_train``: a fixed share of the keys, the same on every run."""
    return df.withColumn("is_train", md5_bucket(keys, 1000, seed) < int(round(train_share * 1000)))


def random_split(df: DataFrame, train_share: float = 0.9, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    train, test = df.randomSplit([train_share, 1 - train_share], seed=seed)
    return train, test


def time_folds(df: DataFrame, folds: int, date: str = "Date", output: str = "fold") -> DataFrame:
    """Add a fold number by equal spans of days, for cross-validation blocked by time."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    first = span.select("a").scalar()
    days = span.select(F.datediff("b", "a") + 1).scalar()
    position = F.datediff(F.col(date), first) * folds / days
    return df.withColumn(output, F.floor(position).cast("int"))
