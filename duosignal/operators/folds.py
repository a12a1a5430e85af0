"""Cross-validation splits and scalers fitted on the training part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duosignal.operators.order import edges
from duosignal.operators.series import by


def contiguous_folds(df: DataFrame, keys: list[str], k: int, t: str = "t") -> DataFrame:
    """Adds ``fold`` from 0: k runs of each series, the remainder to the first ones."""
    return df.withColumn("fold", (F.ntile(k).over(by(keys, t)) - 1).cast("long"))


def train_test(df: DataFrame, k: int, inverted: bool = False) -> DataFrame:
    """Each row once for each of the k splits, with ``split`` and ``role``; inverted ones train on one fold."""
    inside, outside = ("train", "test") if inverted else ("test", "train")
    rows = df.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    return rows.withColumn("role", F.when(F.col("fold") == F.col("split"), inside).otherwise(outside))


def holdout_tail(df: DataFrame, keys: list[str], share: float, t: str = "t") -> DataFrame:
    """Adds ``part``: the first ``share`` of each series trains, the rest validates."""
    order = F.row_number().over(by(keys, t))
    return df.withColumn("part", F.when(order <= F.floor(F.count("*").over(Window.partitionBy(*keys)) * share), "train").otherwise("validation"))


def fitted(df: DataFrame, keys: list[str], columns: list[str], train: Column, stats: dict) -> DataFrame:
    """``df`` with <column>_<stat> fitted on its training rows, by key."""
    fit = df.where(train).groupBy(*keys).agg(*[fn(c).alias(f"{c}_{name}") for c in columns for name, fn in stats.items()])
    return df.join(fit, keys)


def standardise(df: DataFrame, keys: list[str], columns: list[str], train: Column) -> DataFrame:
    """Columns to the training rows' mean 0 and population deviation 1 (no spread: 0)."""
    rows = fitted(df, keys, columns, train, {"mean": F.avg, "sd": F.stddev_pop})
    return rows.select(*[c for c in df.columns if c not in columns], *[F.when(F.col(f"{c}_sd") > 0, F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_sd"))).otherwise(0.0).alias(c) for c in columns])


def min_max(df: DataFrame, keys: list[str], columns: list[str], train: Column) -> DataFrame:
    """Columns to the training rows' range from 0 to 1, not clipped (no range: 0)."""
    rows = fitted(df, keys, columns, train, {"min": F.min, "max": F.max})
    span = lambda c: F.col(f"{c}_max") - F.col(f"{c}_min")
    return rows.select(*[c for c in df.columns if c not in columns], *[F.when(span(c) == 0, 0.0).otherwise(F.try_divide(F.col(c) - F.col(f"{c}_min"), span(c))).alias(c) for c in columns])


def min_max_percentile(df: DataFrame, keys: list[str], columns: str | list[str], train: Column | None = None, percent: int = 5, t: str = "t") -> DataFrame:
    """Columns by the training rows' n-th smallest and n-th largest value, n = percent * rows - 1 over 100.

    Without ``train`` all rows train. Not clipped; no range: 0. Values are found by ranges, so no task
    holds a key.
    """
    columns = [columns] if isinstance(columns, str) else columns
    rows = df
    for column in columns:
        fit = edges(df if train is None else df.where(train), keys, column, percent, t).select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high"))
        span = F.col("_high") - F.col("_low")
        rows = rows.join(fit, keys, "left").withColumn(column, F.when(span == 0, 0.0).otherwise(F.try_divide(F.col(column) - F.col("_low"), span))).drop("_low", "_high")
    return rows.select(*df.columns)


def scale(df: DataFrame, keys: list[str], column: str, low: float, high: float, name: str) -> DataFrame:
    """Adds the column scaled to [low, high] over its whole series."""
    part = Window.partitionBy(*keys)
    least, most = F.min(column).over(part), F.max(column).over(part)
    return df.withColumn(name, F.when(most == least, low).otherwise(low + F.try_divide((F.col(column) - least) * (high - low), most - least)))


def preprocess(df: DataFrame, keys: list[str], stimuli: list[str], responses: list[str], train: Column, stimulus_by: str = "Normalize", response_by: str = "Standarize") -> DataFrame:
    """Stimuli and responses by the scaler named for each side, and the stimuli as one array ``x``.

    Normalize is the range for stimuli, and the range between percentiles for responses.
    """
    stimulus = {"Normalize": min_max, "Standarize": standardise}[stimulus_by]
    response = {"Normalize": min_max_percentile, "Standarize": standardise}[response_by]
    return response(stimulus(df, keys, stimuli, train), keys, responses, train).withColumn("x", F.array(*stimuli))
