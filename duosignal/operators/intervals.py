"""Interval annotations of dialogues: expansion to samples, reconciliation, states, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duosignal.operators.series import by


def sample_counts(df: DataFrame, rate: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Adds n, the samples of each interval, rounded half to even."""
    return df.withColumn("n", F.bround((F.col(end) - F.col(start)) * rate, 0).cast("long"))


def interval_expand(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each of the ``n`` samples of the intervals, t running on along the key."""
    at = F.sum("n").over(by(keys, order)) - F.col("n")
    rows = df.withColumn("_at", at).where("n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.withColumn("t", F.col("_at") + F.col("_i")).drop("_at", "_i")


def interval_reconcile(df: DataFrame, keys: list[str], order: str, target: str) -> DataFrame:
    """The counts ``n`` made to sum to ``target``: cut from the tail, or the last one extended."""
    along = by(keys, order)
    after = F.sum("n").over(along)
    last = F.lead("n").over(along).isNull()
    whole = F.sum("n").over(Window.partitionBy(*keys))
    cut = F.greatest(F.lit(0), F.least(F.col("n"), F.col(target) - (after - F.col("n"))))
    return df.withColumn("n", (cut + F.when(last, F.greatest(F.lit(0), F.col(target) - whole)).otherwise(0)).cast("long"))


def speaker_state(first: DataFrame, second: DataFrame, keys: list[str], active: str = "active", t: str = "t") -> DataFrame:
    """first + 2 * second at each sample, the shorter one padded with 0."""
    a, b = (x.select(*keys, t, F.col(active).alias(n)) for x, n in ((first, "_a"), (second, "_b")))
    return a.join(b, [*keys, t], "full_outer").select(*keys, t, (F.coalesce("_a", F.lit(0)) + 2 * F.coalesce("_b", F.lit(0))).cast("long").alias("state"))


def pair_partner(df: DataFrame, keys: list[str], member: str, own: bool, t: str = "t", signal: str = "y", stimulus: str = "x") -> DataFrame:
    """Each member's signal with the other's stimulus at the same time (members are 1 and 2), or its own."""
    whose = F.col(member) if own else 3 - F.col(member)
    stim = df.select(*keys, F.col(member).alias("_of"), t, F.col(stimulus).alias("stimulus"))
    sig = df.select(*keys, F.col(member), whose.alias("_of"), t, F.col(signal).alias("signal"))
    return sig.join(stim, [*keys, "_of", t]).drop("_of")


def gap_intervals(df: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Free time between intervals: from the latest end so far to the next start, where positive."""
    before = F.max(end).over(by(keys, start, end).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_free", before).where(F.col("_free") < F.col(start)).select(*keys, F.col("_free").alias("free_from"), F.col(start).alias("free_to"))
