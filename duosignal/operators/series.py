"""Reshaping of ordered series: lags, resampling, alignment, labels, runs and rolling statistics.

A series is given by key columns and an order column ``t`` that counts from 0 without gaps. All
operators are window functions or equi-joins partitioned by the key, so series are worked on apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def runs(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Where runs of equal values of the columns start, and the number of rows."""
    codes = np.stack([batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in columns])
    return np.array([0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1), batch.num_rows])


def whole_runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole runs of equal values, many runs or one, with where each starts and the number of rows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_batches([held, batch]) if held else batch
        cuts = runs(held, columns)
        if len(cuts) > 2:
            yield held.slice(0, cuts[-2]), cuts[:-1]
            held = held.slice(cuts[-2])
    if held:
        yield held, np.array([0, held.num_rows])


def delay_set(tmin: float, tmax: float, rate: float) -> list[int]:
    """Delays in samples from a time range in seconds; positive ones look back."""
    return [-i for i in range(math.floor(tmin * rate), math.ceil(tmax * rate))]


def lagged(x: str, delay: int, over: WindowSpec) -> Column:
    """x at t - delay, zero outside of the series."""
    return F.lag(x, delay, 0.0).over(over) if delay >= 0 else F.lead(x, -delay, 0.0).over(over)


def lag_matrix(df: DataFrame, keys: list[str], features: list[str], delays: list[int], t: str = "t", name: str = "x") -> DataFrame:
    """Adds one column for each feature and delay, features first: <name>_<feature>_<j>."""
    w = by(keys, t)
    return df.withColumns({f"{name}_{f}_{j}": lagged(f, d, w) for f in features for j, d in enumerate(delays)})


def decimate(df: DataFrame, n: int, t: str = "t") -> DataFrame:
    """Every n-th sample of each series."""
    return df.where(F.col(t) % n == 0).withColumn(t, F.floor(F.col(t) / n))


def lengths(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def ratio_resample(df: DataFrame, keys: list[str], out: DataFrame, t: str = "t") -> DataFrame:
    """Samples floor(i * n / m) for i < m: series of n samples to the lengths ``m`` of ``out``."""
    size = lengths(df, keys, "_n").join(out, keys).select(*keys, "_n", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("_i")).where("m > 0")
    want = size.select(*keys, F.col("_i").cast("long").alias("i"), F.floor(F.col("_i") * F.col("_n") / F.col("m")).cast("long").alias(t))
    return df.join(want, [*keys, t]).drop(t).withColumnRenamed("i", t)


def hold_resample(df: DataFrame, keys: list[str], repeat: int, every: int, t: str = "t") -> DataFrame:
    """Each sample held ``repeat`` times, then every ``every``-th taken."""
    size = lengths(df, keys, "_n").select(*keys, F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") * repeat / every) - 1)).alias("_i"))
    want = size.select(*keys, F.col("_i").cast("long").alias("i"), F.floor(F.col("_i") * every / repeat).cast("long").alias(t))
    return df.join(want, [*keys, t]).drop(t).withColumnRenamed("i", t)


def align_lengths(streams: list[DataFrame], keys: list[str], t: str = "t") -> list[DataFrame]:
    """All streams cut to the shortest of each key."""
    sizes = [lengths(s, keys) for s in streams]
    least = sizes[0]
    for s in sizes[1:]:
        least = least.join(s.withColumnRenamed("n", "_m"), keys).select(*keys, F.least("n", "_m").alias("n"))
    return [s.join(least, keys).where(F.col(t) < F.col("n")).drop("n") for s in streams]


def islands(df: DataFrame, keys: list[str], x: str, step: float) -> DataFrame:
    """Adds ``island``, from 0: a new one begins where x grows by more than ``step``."""
    w = by(keys, x)
    return df.withColumn("_new", F.coalesce((F.col(x) - F.lag(x).over(w) > step).cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def normalise_label(c: str) -> Column:
    """Spellings of silence become empty; spaces, degree signs and hyphens go."""
    silence = ["sil", "sp", "sile", "silsil", "SP", "s¡p", "sils"]  # fixed values
    bare = F.translate(c, " º-", "")
    return F.when(bare.isin(silence), "").otherwise(bare)


def one_hot(label: str, names: list[str], value: Column | None = None, prefix: str = "is_") -> dict[str, Column]:
    """A column for each name: ``value`` (1 by default) where the label is that, else 0."""
    one = F.lit(1.0) if value is None else value
    return {prefix + n: F.when(F.col(label) == n, one).otherwise(0.0) for n in names}


def one_hot_onset(df: DataFrame, keys: list[str], label: str, names: list[str], t: str = "t") -> DataFrame:
    """1 only where the label differs from the sample before; the first one always does."""
    before = F.lag(label).over(by(keys, t))
    return df.withColumn("_on", F.when(before.isNull() | (before != F.col(label)), 1.0).otherwise(0.0)).withColumns(one_hot(label, names, F.col("_on"))).drop("_on")


def situation_filter(df: DataFrame, keys: list[str], state: str, target: int | None, delays: list[int], t: str = "t") -> DataFrame:
    """Samples whose state is ``target`` at every delay; outside of the trial the state is 0.

    Delays may have steps and gaps: each run of them is one window. Without a target all samples stay.
    """
    if target is None:
        return df
    runs: list[list[int]] = []
    for d in sorted(set(delays)):
        if runs and d == runs[-1][1] + 1:
            runs[-1][1] = d
        else:
            runs.append([d, d])
    hits = F.lit(0)
    for low, high in runs:
        w = by(keys, t).rowsBetween(-high, -low)
        hits = hits + F.coalesce(F.sum((F.col(state) == target).cast("int")).over(w), F.lit(0))
        if target == 0:
            hits = hits + (high - low + 1) - F.count("*").over(w)
    return df.withColumn("_hits", hits).where(F.col("_hits") == len(set(delays))).drop("_hits")


def as_arrays(df: DataFrame, keys: list[str], values: list[str], t: str = "t") -> DataFrame:
    """(keys, t, values) as arrays in the order of t, a row for each series."""
    rows = F.array_sort(F.collect_list(F.struct(t, *values)))
    each = lambda c: F.transform(rows, lambda r: r[c])
    return df.groupBy(*keys).agg(each(t).alias(t), *[each(v).cast("array<double>").alias(v) for v in values])


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """A list column as an array for each row, nulls as NaN, without an object for each value."""
    sizes = np.array(pc.list_value_length(column).to_numpy(zero_copy_only=False), int)
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes)[:-1])


def map_arrays(rows: DataFrame, keys: list[str], values: list[str], out: list[str], fn: Callable[..., list[np.ndarray]], keep: str = "t", held: int = 1 << 18) -> DataFrame:
    """(keys, ``keep`` if there, out): ``fn`` of whole series as arrays.

    Series of one length in a batch come to ``fn`` together, as matrices with a row for each; it gives
    a matrix for each of ``out``. Nulls come as NaN; an empty series gives empty arrays. ``fn`` gets about
    ``held`` samples of a value at once, or one series, however many series a batch has.
    """
    kept = [*keys, *([keep] if keep in rows.columns else [])]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            place = np.cumsum(pc.list_value_length(whole.column(values[0])).to_numpy(zero_copy_only=False)) // held
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), whole.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole.slice(start, end - start)
                columns = [_arrays(batch.column(c)) for c in values]
                sizes = np.array([len(v) for v in columns[0]], int)
                made: list[list] = [[np.empty(0)] * batch.num_rows for _ in out]
                for n in np.unique(sizes[sizes > 0]):
                    own = np.flatnonzero(sizes == n)
                    for target, matrix in zip(made, fn(*[np.stack([c[i] for i in own]) for c in columns]), strict=True):
                        for i, row in zip(own, matrix, strict=True):
                            target[i] = row
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(m, pa.list_(pa.float64())) for m in made]], names=[*kept, *out])

    return rows.select(*kept, *[v for v in values if v not in kept]).mapInArrow(run, schema + "".join(f", {o} array<double>" for o in out))


def from_arrays(rows: DataFrame, keys: list[str], values: list[str], t: str = "t") -> DataFrame:
    """(keys, t, values): a row for each sample again."""
    return rows.select(*keys, F.inline(F.arrays_zip(t, *values)))


def concat_trials(df: DataFrame, keys: list[str], trial: str, t: str = "t", name: str = "g") -> DataFrame:
    """Adds the position in the series of all trials of a key one after the other."""
    return df.withColumn(name, (F.row_number().over(by(keys, trial, t)) - 1).cast("long"))


def rolling(df: DataFrame, keys: list[str], x: str, window: int, stat: str, least: int, t: str = "t", name: str = "out") -> DataFrame:
    """``slope`` or ``mean`` over the window that starts at each sample; null with too few values."""
    w = by(keys, t).rowsBetween(0, window - 1)
    value = F.regr_slope(x, t) if stat == "slope" else F.avg(x)
    return df.withColumn(name, F.when(F.count(x).over(w) >= least, value.over(w)))


def find_peaks(df: DataFrame, keys: list[str], x: str, share: float, t: str = "t") -> DataFrame:
    """Local maxima of |x| of at least ``share`` of the largest; equal neighbours count once, at the first."""
    w = by(keys, t)
    runs = df.withColumn("_a", F.abs(x)).withColumn("_before", F.lag("_a").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("_a")))
    runs = runs.withColumns({"_left": F.lag("_a").over(w), "_right": F.lead("_a").over(w), "_top": F.max("_a").over(Window.partitionBy(*keys))})
    peak = (F.col("_a") > F.col("_left")) & (F.col("_a") > F.col("_right")) & (F.col("_a") >= share * F.col("_top"))
    return runs.where(peak).drop("_a", "_before", "_left", "_right", "_top")


def autocorrelation(df: DataFrame, keys: list[str], x: str, most: int | None = None, t: str = "t") -> DataFrame:
    """(keys, lag, r): Pearson's r of each series with itself at lags 1 to half its length (or ``most``), and 1 at lag 0.

    Each series is taken as an array; r is null where a part has no spread.
    """

    def lags(x: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1]
        out = np.ones((len(x), min(n if most is None else most, n // 2) + 1))
        for k in range(1, out.shape[1]):
            a, b = (v - v.mean(axis=1, keepdims=True) for v in (x[:, : n - k], x[:, k:]))
            size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            out[:, k] = np.divide((a * b).sum(axis=1), size, out=np.full(len(x), np.nan), where=size > 0)
        return [out]

    rows = map_arrays(as_arrays(df, keys, [x], t), keys, [x], ["r"], lags).select(*keys, F.posexplode("r").alias("lag", "r"))
    return rows.select(*keys, F.col("lag").cast("long").alias("lag"), F.nanvl("r", F.lit(None)).alias("r"))


def decorrelation_time(r: DataFrame, keys: list[str], below: float = 0.1, scale: float = 1.0) -> DataFrame:
    """The lag at which r first falls below, between the two lags by a straight line."""
    before = r.withColumn("_r0", F.lag("r").over(by(keys, "lag"))).where((F.col("r") < below) & (F.col("lag") > 0))
    first = before.groupBy(*keys).agg(F.min_by(F.struct("lag", "r", "_r0"), "lag").alias("_f"))
    f = F.col("_f")
    return first.select(*keys, ((f["lag"] - 1 + F.try_divide(f["_r0"] - below, f["_r0"] - f["r"])) * scale).alias("time"))


def melt_lags(df: DataFrame, keys: list[str], x: str, delays: list[int], t: str = "t") -> DataFrame:
    """Each row once for each delay, with <x>_lagged; rows without a partner are left out."""
    w = by(keys, t)
    at = lambda d: F.lag(x, d).over(w) if d >= 0 else F.lead(x, -d).over(w)
    rows = df.withColumn("_all", F.array(*[F.struct(F.lit(d).cast("long").alias("delay"), at(d).alias(f"{x}_lagged")) for d in delays]))
    return rows.select(*df.columns, F.inline("_all")).where(F.col(f"{x}_lagged").isNotNull())
