"""Exact ranks and quantiles of groups of any size: rows are dealt by ranges of key and value, not by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duosignal.sources.workspace import work_folder


def ranked(df: DataFrame, keys: list[str], value: str, tie: str = "t", name: str = "rank", count: str = "n") -> DataFrame:
    """``df`` with each row's rank (from 1) in its key by value, then tie, and the number of the key's rows.

    As row_number() would give it, nulls first. Rows are sorted by ranges of (keys, value, tie), so a key
    with many rows is in many tasks; a rank is how many of the key's rows earlier ranges have, and
    the place in the range. The ranges are written to the shared folder once, since both are read
    from them.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/ranges-{uuid.uuid4().hex}"
    df.repartitionByRange(*keys, value, tie).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_here"))  # a key's ranges, not its rows
    part = Window.partitionBy(*keys)
    sizes = sizes.select(*keys, "_range", (F.sum("_here").over(part.orderBy("_range")) - F.col("_here")).alias("_before"), F.sum("_here").over(part).alias(count))
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(value, tie))
    out = rows.withColumn("_place", place).join(sizes, [*keys, "_range"])
    return out.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], tie: str | None = None) -> DataFrame:
    """(keys, a column for each of ``shares``): exact quantiles, linear between two values, as percentile() gives them.

    Nulls are left out; a key with nulls alone has no row. Keys are not null. ``tie`` orders equal values,
    so that many of them are in several tasks.
    """
    rows = df.where(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, value, *([tie] if tie else [])]))
    rows = ranked(rows, keys, value, tie or value, "_rank", "_n").withColumn("_at", F.col("_rank") - 1)

    def at(share: float):
        place = (F.col("_n") - 1) * share
        low, high = (F.max(F.when(F.col("_at") == f(place), F.col(value).cast("double"))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    return rows.groupBy(*keys).agg(*[at(q).alias(name) for name, q in shares.items()])


def edges(df: DataFrame, keys: list[str], value: str, percent: int, tie: str = "t") -> DataFrame:
    """(keys, low, high): the (k + 1)-th smallest and largest value of each key, k = (percent * rows - 1) over 100."""
    rows = ranked(df.select(*dict.fromkeys([*keys, value, tie])), keys, value, tie, "_rank", "_n")
    k = F.floor((F.col("_n") * percent - 1) / 100)
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col(value)))
    return rows.groupBy(*keys).agg(at(k + 1).alias("low"), at(F.col("_n") - k).alias("high"))
