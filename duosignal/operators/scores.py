"""Aggregations of scores and weights over folds, subjects, channels and lags."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duosignal.functions.numeric import pearson, t_two_sided


def nested_mean(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Means over the groups ``outer`` + ``inner``, then their mean and population deviation over ``inner``."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("_v")).groupBy(*outer).agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"))


def top_k(df: DataFrame, group: list[str], value: str, k: int, tie: str) -> DataFrame:
    """The k largest of each group, with their rank from 1."""
    order = Window.partitionBy(*group).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def self_pairs(df: DataFrame, item: str, on: list[str], value: str, distinct: bool = False) -> DataFrame:
    """(a, b, on, va, vb): all pairs of items (or each unordered pair once) that meet on equal keys."""
    a = df.select(F.col(item).alias("a"), *on, F.col(value).alias("va"))
    b = df.select(F.col(item).alias("b"), *on, F.col(value).alias("vb"))
    pairs = a.join(b, on)
    return pairs.where("a < b") if distinct else pairs


def similarity(df: DataFrame, item: str, group: list[str], on: list[str], value: str, distinct: bool = False) -> DataFrame:
    """(group, a, b, r, n): correlation of each two items within each group over the keys ``on``."""
    pairs = self_pairs(df, item, [*group, *on], value, distinct)
    return pairs.groupBy(*group, "a", "b").agg(pearson("va", "vb").alias("r"), F.count("*").alias("n"))


def with_correlation_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Adds t and the two-sided p of a correlation of n pairs; null where r is null or n < 3."""
    t = F.when((F.col(n) > 2) & (F.abs(r) < 1), F.col(r) * F.sqrt(F.try_divide(F.col(n) - 2, 1 - F.col(r) * F.col(r))))

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, k - 2) if pd.notna(x) else None for x, k in zip(t, n, strict=True)], dtype="float64")

    return df.withColumn("t", t).withColumn("p", tail("t", F.col(n).cast("double")))


def partition_2(both: Column, one: Column, two: Column) -> dict[str, Column]:
    """Unique and shared parts of r squared of two stimuli; negative parts count as 0."""
    zero = F.lit(0.0)
    return {"unique_1": F.greatest(zero, both - two), "unique_2": F.greatest(zero, both - one), "shared": F.greatest(zero, one + two - both)}


def partition_3(r: dict[str, Column]) -> dict[str, Column]:
    """The seven regions of three stimuli from r squared of 1, 2, 3, 12, 13, 23 and 123."""
    zero = F.lit(0.0)
    out = {f"unique_{i}": F.greatest(zero, r["123"] - r[rest]) for i, rest in (("1", "23"), ("2", "13"), ("3", "12"))}
    for pair, left in (("12", "3"), ("13", "2"), ("23", "1")):
        a, b = pair
        i, j = "".join(sorted(a + left)), "".join(sorted(b + left))
        out[f"only_{pair}"] = F.greatest(zero, r[i] + r[j] - r[left] - r["123"])
    out["all"] = F.greatest(zero, r["123"] + r["1"] + r["2"] + r["3"] - r["12"] - r["13"] - r["23"])
    return out


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, by the monotone chain."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convex_hull(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, x, y) of the corners of each group's hull: hulls within tasks, then the hull of those."""
    points = df.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    schema = f"{group} {df.schema[group].dataType.simpleString()}, x double, y double"

    def corners(own: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(list(zip(own["x"], own["y"], strict=True)))
        return pd.DataFrame([(own[group].iloc[0], *p) for p in hull], columns=[group, "x", "y"])

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, own in frame.groupby(group, sort=False):
                yield corners(own)

    return points.mapInPandas(part, schema).groupBy(group).applyInPandas(corners, schema)
