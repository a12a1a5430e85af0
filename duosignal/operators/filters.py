"""Filters of series that may be longer than a task: blocks of samples instead of whole series.

A finite filter needs the samples that its taps reach, so blocks overlap by them. A recursive one
needs its state: a block changes the state by a linear map and adds what its own samples leave, so
each block is filtered from zero first, the maps are followed block by block (a few numbers each),
and the blocks run again from their true states. Blocks of about one length take a step together.

A null sample counts as 0 for its neighbours and gives null itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.operators.series import runs, whole_runs
from duosignal.operators.spectral import band, butterworth, recursive
from duosignal.sources.workspace import discard, stored


def transition(low: float | None, high: float | None, rate: float) -> float:
    """The width in Hz of the narrower edge: a quarter of the edge's frequency, at least 2 Hz, if there is room."""
    edges = [min(max(low * 0.25, 2.0), low)] if low else []
    if high:
        edges.append(min(max(high * 0.25, 2.0), rate / 2 - high))
    return min(edges)


def fir_design(low: float | None, high: float | None, rate: float, width: float | None = None) -> np.ndarray:
    """Taps of a Hamming-windowed filter between low and high Hz, as many (an odd number) as its transition needs.

    Edges are halfway down in the middle of their transitions, which lie outside of the band. Without
    ``low`` it is a low-pass, without ``high`` a high-pass filter.
    """
    width = width or transition(low, high, rate)
    n = math.ceil(3.3 / width * rate) | 1
    at = np.arange(n) - n // 2
    ideal = lambda f: 2 * f / rate * np.sinc(2 * f / rate * at)
    whole = (at == 0).astype(float)
    upper = ideal(min(high + width / 2, rate / 2)) if high else whole
    lower = ideal(max(low - width / 2, 0.0)) if low else 0.0
    return (upper - lower) * np.hamming(n)


def minimum_phase(taps: np.ndarray, points: int = 1 << 17) -> np.ndarray:
    """The causal taps of the same magnitude whose zeros are not outside of the unit circle.

    The logarithm of the magnitude is folded in the cepstrum: what comes before 0 is put on what
    comes after. Magnitudes are held above 1e-6 of the largest, where the logarithm has poles.
    """
    size = np.abs(np.fft.fft(taps, points))
    cepstrum = np.fft.ifft(np.log(np.maximum(size, 1e-6 * size.max()))).real
    fold = np.zeros(points)
    fold[0] = fold[points // 2] = 1
    fold[1 : points // 2] = 2
    return np.fft.ifft(np.exp(np.fft.fft(cepstrum * fold))).real[: len(taps)]


def _schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers, null as NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.float64()))


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", F.asc_nulls_first("t"))


def fir_blocks(df: DataFrame, keys: list[str], x: str, taps: list[float] | np.ndarray, name: str = "y", t: str = "t", causal: bool = False, size: int = 1 << 16) -> DataFrame:
    """(keys, t, name): each series through the taps by overlapping blocks of ``size`` samples.

    Without delay for taps around their middle, or ``causal`` ones that look back. Outside of a series
    it is 0. t counts from 0 without gaps.
    """
    taps = np.asarray(taps, float)
    ahead = 0 if causal else len(taps) // 2
    back = len(taps) - 1 - ahead
    size = max(size, back, ahead, 1)
    block = F.floor(F.col("t") / size).cast("long")
    near = F.array_compact(F.array(block, F.when(F.col("t") >= (block + 1) * size - back, block + 1), F.when((F.col("t") < block * size + ahead) & (block > 0), block - 1)))
    rows = df.select(*keys, F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x")).withColumn("_block", F.explode(near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_runs(batches, [*keys, "_block"]):
            when, values = part.column("t").to_numpy(), _numbers(part.column("x"))
            numbers = part.column("_block").to_numpy()
            own, y = when // size == numbers, np.empty(len(when))
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                at = when[first:last] - (numbers[first] * size - back)
                wide = np.zeros(back + size + ahead)
                wide[at] = np.nan_to_num(values[first:last])
                n = len(wide) + len(taps) - 1
                out = np.fft.irfft(np.fft.rfft(wide, n) * np.fft.rfft(taps, n), n) if len(taps) > 64 else np.convolve(wide, taps)
                y[first:last] = out[at + ahead]
            kept = part.filter(pa.array(own))  # not neighbours' samples
            y = np.where(np.isnan(values), np.nan, y)[own]
            yield pa.RecordBatch.from_arrays([*[kept.column(k) for k in keys], kept.column("t"), pa.array(y, pa.float64(), from_pandas=True)], names=[*keys, "t", name])

    return _dealt(rows, keys).mapInArrow(run, f"{_schema(df, keys)}t long, {name} double")


def _through(b: np.ndarray, a: np.ndarray, x: np.ndarray, cuts: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What the filter gives of each block of x from its state (0 without), and the states they end in."""
    many, n = np.diff(cuts), len(a)
    y, end = np.empty(len(x)), np.zeros((len(many), n - 1))
    kinds = np.ceil(np.log2(np.maximum(many, 1)))
    for kind in np.unique(kinds):  # at most half of the matrix is past the blocks' ends
        own = np.flatnonzero(kinds == kind)
        at = np.arange(many[own].max() + n - 1)
        inside = at < many[own, None]
        from_x = (cuts[own, None] + at)[inside]
        wide = np.zeros(inside.shape)
        wide[inside] = x[from_x]
        out = recursive(b, a, wide, None if state is None else state[own].T)
        y[from_x] = out[inside]
        # The state is what the filter would give next, without input, by the direct form's recursion.
        tail = out[np.arange(len(own))[:, None], many[own, None] + np.arange(n - 1)]
        for i in range(n - 1):
            end[own, i] = tail[:, i] + sum(a[j] * tail[:, i - j] for j in range(1, i + 1))
    return y, end


def _companion(a: np.ndarray) -> np.ndarray:
    """How the state goes on without input."""
    step = np.eye(len(a) - 1, k=1)
    step[:, 0] -= a[1:]
    return step


def _samples(df: DataFrame, keys: list[str], x: str, t: str) -> DataFrame:
    """(keys, t, x, gone): a missing sample is 0."""
    gone = F.col(x).isNull() | F.isnan(F.col(x).cast("double"))
    return df.select(*keys, F.col(t).cast("long").alias("t"), F.when(gone, 0.0).otherwise(F.col(x).cast("double")).alias("x"), gone.alias("gone"))


def _recursive(rows: DataFrame, keys: list[str], b: np.ndarray, a: np.ndarray, first: np.ndarray | None, size: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (keys, t, x, gone) with x filtered, and the table that they are read from.

    Samples are read twice, for the states and for the run, so they are written to the shared folder once.
    """
    n = len(a)
    step = _companion(a)
    table = stored(rows.withColumn("_block", F.floor(F.col("t") / size).cast("long")), "blocks")
    spec = _schema(rows, keys)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_runs(batches, [*keys, "_block"]):
            x = part.column("x").to_numpy()
            own = pa.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([*[part.column(k).take(own) for k in [*keys, "_block"]], pa.array(np.diff(cuts)), pa.array(x[cuts[:-1]]), _lists(_through(b, a, x, cuts)[1])], names=[*keys, "_block", "n", "value", "end"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = cache(lambda many: np.linalg.matrix_power(step, many))
        at, state = None, np.zeros(n - 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = runs(batch, keys)
            series, length = cuts[:-1], np.diff(cuts)
            many, end = batch.column("n").to_numpy(), batch.column("end").flatten().to_numpy().reshape(-1, n - 1)
            kinds, kind = np.unique(many, return_inverse=True)
            after = np.stack([power(int(k)) for k in kinds])
            starts = np.zeros((batch.num_rows, n - 1))
            if first is not None:
                starts[series] = np.multiply.outer(batch.column("value").to_numpy()[series], first)
            if tuple(batch.column(k)[0].as_py() for k in keys) == at:
                starts[0] = state
            for i in range(1, length.max()):  # the i-th blocks of all series together
                now = series[length > i] + i
                starts[now] = np.einsum("kij,kj->ki", after[kind[now - 1]], starts[now - 1]) + end[now - 1]
            at, state = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys), after[kind[-1]] @ starts[-1] + end[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in [*keys, "_block"]], _lists(starts)], names=[*keys, "_block", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_runs(batches, [*keys, "_block"]):
            sample = part.column("t").is_valid()
            inside = sample.to_numpy(zero_copy_only=False)
            own = part.filter(sample)
            places = np.concatenate([[0], np.cumsum(inside)])[cuts]  # of blocks, a row with a state before each
            y, _ = _through(b, a, own.column("x").to_numpy(), places, part.column("start").flatten().to_numpy().reshape(-1, n - 1))
            yield pa.RecordBatch.from_arrays([*[own.column(k) for k in [*keys, "t"]], pa.array(y), own.column("gone")], names=[*keys, "t", "x", "gone"])

    found = _dealt(table, keys).select(*keys, "_block", "x").mapInArrow(ends, f"{spec}_block long, n long, value double, end array<double>")
    starts = found.repartition(*keys).sortWithinPartitions(*keys, "_block").mapInArrow(follow, f"{spec}_block long, start array<double>")
    return _dealt(table.unionByName(starts, allowMissingColumns=True), keys).mapInArrow(run, f"{spec}t long, x double, gone boolean"), table


def _padded(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of one length, the first of a being 1."""
    n = max(len(a), len(b))
    return np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]


def recursive_blocks(df: DataFrame, keys: list[str], b: np.ndarray, a: np.ndarray, x: str, name: str = "y", t: str = "t", first: np.ndarray | None = None, size: int = 1 << 16) -> DataFrame:
    """(keys, t, name): each series through the causal filter (b, a), by blocks of ``size`` samples.

    ``first`` times the first sample is the state that a series starts in (0 without). t counts from 0
    without gaps. What is gathered for a series is its blocks' states, len(a) - 1 numbers each.
    """
    out, _ = _recursive(_samples(df, keys, x, t), keys, *_padded(b, a), first, size)
    return out.select(*keys, "t", F.when(~F.col("gone"), F.col("x")).alias(name))


def both_ways_blocks(df: DataFrame, keys: list[str], b: np.ndarray, a: np.ndarray, x: str, name: str = "y", t: str = "t", size: int = 1 << 16) -> DataFrame:
    """(keys, t, name): the filter forward and backward by blocks, as ``spectral.both_ways`` does for whole series.

    Series go on at both ends by their odd mirror image and start in the state of a constant. Their
    lengths are joined once and go with the keys from then on.
    """
    b, a = _padded(b, a)
    first = np.linalg.solve(np.eye(len(a) - 1) - _companion(a), b[1:] - a[1:] * b[0])
    rows = _samples(df, keys, x, t)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by("x", "t").alias("_a"), F.max_by("x", "t").alias("_e"))
    edge, last = F.least(F.lit(3 * len(a)), F.col("_n") - 1), F.col("_n") - 1
    here = F.col("t")
    sample = lambda at, value, gone: F.struct((at + edge).alias("t"), value.alias("x"), gone.alias("gone"))
    each = F.array_compact(F.array(
        sample(here, F.col("x"), F.col("gone")),
        F.when((here > 0) & (here <= edge), sample(-here, 2 * F.col("_a") - F.col("x"), F.lit(False))),
        F.when((here < last) & (here >= last - edge), sample(2 * last - here, 2 * F.col("_e") - F.col("x"), F.lit(False))),
    ))
    own = [*keys, "_n"]
    wide = rows.join(sizes, keys).select(*own, F.explode(each).alias("_s")).select(*own, "_s.*")
    once, kept = _recursive(wide, own, b, a, first, size)
    turned = once.withColumn("t", F.col("_n") + 2 * edge - 1 - F.col("t"))
    twice, _ = _recursive(turned, own, b, a, first, size)
    discard(kept)
    back = twice.select(*own, (F.col("_n") + edge - 1 - F.col("t")).alias("t"), F.when(~F.col("gone"), F.col("x")).alias(name))
    return back.where((F.col("t") >= 0) & (F.col("t") < F.col("_n"))).drop("_n")


def band_filter(df: DataFrame, keys: list[str], x: str, name: str | tuple, rate: float, causal: bool = False, t: str = "t", **blocks) -> DataFrame:
    """(keys, t, y): each series in a band by name or (low, high): of zero phase, or ``causal`` by minimum phase."""
    taps = fir_design(*band(name), rate)
    return fir_blocks(df, keys, x, minimum_phase(taps) if causal else taps, "y", t, causal, **blocks)


def butter_blocks(df: DataFrame, keys: list[str], x: str, order: int, low: float | None, high: float | None, rate: float, forward_backward: bool = False, t: str = "t", size: int = 1 << 16) -> DataFrame:
    """(keys, t, y): ``spectral.butter_filter`` of series of any length."""
    b, a = butterworth(order, low, high, rate)
    through: Callable = both_ways_blocks if forward_backward else recursive_blocks
    return through(df, keys, b, a, x, "y", t, size=size)
