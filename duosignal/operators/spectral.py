"""Signal transforms of grouped, ordered series: means, filters, spectra, phases and synchrony.

Spectra of short frames are joins with a table of basis functions. Filters, analytic signals and mel
bands take whole series as arrays, a row each, and work on batches of them as matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duosignal.operators.ridge import gram
from duosignal.operators.series import as_arrays, from_arrays, map_arrays

#: Bands in Hz.
BANDS = {"Delta": (1.0, 4.0), "Theta": (4.0, 8.0), "Alpha": (8.0, 13.0), "Beta_1": (13.0, 19.0), "Beta_2": (19.0, 25.0), "All": (None, 40.0), "Delta_Theta": (1.0, 8.0), "Delta_Theta_Alpha": (1.0, 13.0)}


def band(name: str | tuple | None) -> tuple | None:
    """(low, high) of a band by name; a tuple is a band itself, None is no filter."""
    return BANDS[name] if isinstance(name, str) else name


def band_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *b) for n, b in BANDS.items()], "name string, low double, high double")


def tumbling_mean(df: DataFrame, keys: list[str], x: str, size: int, t: str = "t") -> DataFrame:
    """Means of whole windows of ``size`` samples; a last shorter one is dropped."""
    return df.groupBy(*keys, F.floor(F.col(t) / size).alias(t)).agg(F.avg(x).alias(x), F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")


def band_powers(power: DataFrame, keys: list[str], hertz: Column) -> DataFrame:
    """(keys, name, power): mean power of the catalogued bands that a frequency is in, low <= f < high."""
    bands = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(low or 0.0).alias("low"), F.lit(high).alias("high")) for n, (low, high) in BANDS.items()])
    rows = power.withColumn("_f", hertz).select(*keys, "_f", "power", F.inline(bands))
    return rows.where((F.col("_f") >= F.col("low")) & (F.col("_f") < F.col("high"))).groupBy(*keys, "name").agg(F.avg("power").alias("power"))


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of each row: the spectrum of positive frequencies doubled."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def over_gaps(fn: Callable[[np.ndarray], list[np.ndarray]]) -> Callable[[np.ndarray], list[np.ndarray]]:
    """``fn`` of series in which missing samples count as 0; what it gives at their places is missing."""

    def run(x: np.ndarray) -> list[np.ndarray]:
        gaps = np.isnan(x)
        return [np.where(gaps, np.nan, y) for y in fn(np.where(gaps, 0.0, x))] if gaps.any() else fn(x)

    return run


def analytic_arrays(rows: DataFrame, keys: list[str], x: str = "x", band: tuple | None = None, rate: float = 1.0, order: int = 3) -> DataFrame:
    """(keys, amplitude, phase) as arrays of each row's whole series; with ``band`` of the signal filtered to it both ways.

    A null sample counts as 0 for the others and has neither amplitude nor phase (NaN).
    """
    filters = butterworth(order, *band, rate) if band else None

    def both(x: np.ndarray) -> list[np.ndarray]:
        z = analytic(x)
        if filters:
            z = both_ways(*filters, z.real) + 1j * both_ways(*filters, z.imag)
        return [np.abs(z), np.angle(z)]

    return map_arrays(rows, keys, [x], ["amplitude", "phase"], over_gaps(both))


def analytic_signal(df: DataFrame, keys: list[str], x: str, t: str = "t") -> DataFrame:
    """(keys, t, amplitude, phase) of each series."""
    return from_arrays(analytic_arrays(as_arrays(df, keys, [x], t), keys, x), keys, ["amplitude", "phase"], t)


def windowed_sinc(low: float | None, high: float, rate: float, n: int) -> list[float]:
    """Taps (an odd number) of a Hann-windowed band-pass or, without ``low``, low-pass filter."""
    middle = (n - 1) / 2
    taps = []
    for i in range(n):
        x = i - middle
        ideal = lambda f: 2 * f / rate if x == 0 else math.sin(2 * math.pi * f / rate * x) / (math.pi * x)
        taps.append((ideal(high) - (ideal(low) if low else 0.0)) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))))
    return taps


def fir_filter(df: DataFrame, keys: list[str], x: str, taps: list[float], name: str, t: str = "t") -> DataFrame:
    """(keys, t, name): the series filtered without delay; outside of the series it is 0.

    A null sample counts as 0 for its neighbours and gives NaN itself. A series is one row in a task;
    longer ones are for ``filters.fir_blocks``.
    """
    half = len(taps) // 2

    def through(x: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1] + len(taps) - 1
        if len(taps) > 64:
            y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(taps, n), n)
        else:
            y = np.stack([np.convolve(row, taps) for row in x])
        return [y[:, half : half + x.shape[1]]]

    return from_arrays(map_arrays(as_arrays(df, keys, [x], t), keys, [x], [name], over_gaps(through)), keys, [name], t)


def butterworth(order: int, low: float | None, high: float | None, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a Butterworth filter by the bilinear transform."""
    poles = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * rate * math.tan(math.pi * f / rate)
    if low and high:
        width, middle = warp(high) - warp(low), math.sqrt(warp(high) * warp(low))
        p = poles * width / 2
        poles, zeros, gain = np.concatenate([p + np.sqrt(p * p - middle**2), p - np.sqrt(p * p - middle**2)]), np.zeros(order), width**order
    elif high:
        poles, zeros, gain = poles * warp(high), np.empty(0), warp(high) ** order
    else:
        zeros, gain = np.zeros(order), 1.0
        poles = warp(low) / poles
    c = 2 * rate
    z = np.concatenate([(c + zeros) / (c - zeros), -np.ones(len(poles) - len(zeros))])
    gain = gain * np.real(np.prod(c - zeros) / np.prod(c - poles))
    return np.real(gain * np.poly(z)), np.real(np.poly((c + poles) / (c - poles)))


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """The causal filter of coefficients (b, a) of each row; all rows take a step together."""
    x = np.asarray(x, float)
    rows = np.atleast_2d(x)
    size = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, size + 1 - len(b))) / a[0], np.pad(a, (0, size + 1 - len(a))) / a[0]
    held = np.zeros((size + 1, len(rows)))
    if state is not None:
        held[:size] = state
    out = np.empty(rows.shape[::-1])
    for i, v in enumerate(rows.T):
        out[i] = b[0] * v + held[0]
        held[:-1] = held[1:] + np.multiply.outer(b[1:], v) - np.multiply.outer(a[1:], out[i])
    return out.T.reshape(x.shape)


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter forward and backward, without delay.

    Rows go on at their ends by their odd mirror image, three times as many samples as coefficients,
    and the filter starts in the state that a constant leaves it in.
    """
    x = np.atleast_2d(np.asarray(x, float))
    size = max(len(a), len(b))
    edge = min(3 * size, x.shape[1] - 1)
    wide = np.hstack([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]])
    b, a = np.pad(b, (0, size - len(b))) / a[0], np.pad(a, (0, size - len(a))) / a[0]
    step = np.eye(size - 1, k=1)
    step[:, 0] -= a[1:]
    start = np.linalg.solve(np.eye(size - 1) - step, b[1:] - a[1:] * b[0])
    once = recursive(b, a, wide, np.multiply.outer(start, wide[:, 0]))[:, ::-1]
    twice = recursive(b, a, once, np.multiply.outer(start, once[:, 0]))[:, ::-1]
    return twice[:, edge : edge + x.shape[1]]


def butter_filter(df: DataFrame, keys: list[str], x: str, order: int, low: float | None, high: float | None, rate: float, forward_backward: bool = False, t: str = "t") -> DataFrame:
    """(keys, t, y): each series through a Butterworth filter, causal or forward and backward.

    A null sample counts as 0 for the others and gives NaN itself. A series is one row in a task;
    longer ones are for ``filters.butter_blocks``.
    """
    b, a = butterworth(order, low, high, rate)
    through = lambda x: [both_ways(b, a, x) if forward_backward else recursive(b, a, x)]
    return from_arrays(map_arrays(as_arrays(df, keys, [x], t), keys, [x], ["y"], over_gaps(through)), keys, ["y"], t)


def mel_filters(rate: float, frame: int, bands: int) -> np.ndarray:
    """Triangles (band, frequency) of equal area, evenly spaced in mel: linear to 1 kHz, logarithmic above."""
    # 200/3 Hz a mel below 1000 Hz, 27 mels for a factor of 6.4 above.
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)
    to_hertz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    edges = np.array([to_hertz(m) for m in np.linspace(0, to_mel(rate / 2), bands + 2)])
    f = np.arange(frame // 2 + 1) * rate / frame
    low, middle, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - low) / (middle - low), (high - f) / (high - middle))) * 2 / (high - low)


def mel_bands(df: DataFrame, keys: list[str], x: str, rate: float, frame: int = 125, bands: int = 16, floor_db: float = 80.0, t: str = "t") -> DataFrame:
    """(keys, frame, band, db): mel bands of frames around every ``frame``-th sample, as decibels below the series' largest.

    Frames are centred, so the series goes on with zeros for half a frame; at most ``floor_db`` below.
    """
    half, filters = frame // 2, mel_filters(rate, frame, bands)
    window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(frame) / frame)

    def spectra(x: np.ndarray) -> list[np.ndarray]:
        wide = np.pad(x, ((0, 0), (half, half)))
        cut = np.lib.stride_tricks.sliding_window_view(wide, frame, axis=1)[:, ::frame]
        power = np.abs(np.fft.rfft(cut * window)) ** 2 @ filters.T
        level = 10 * np.log10(np.maximum(power, 1e-10))
        level -= level.max(axis=(1, 2), keepdims=True)
        return [np.maximum(level, -floor_db).reshape(len(x), -1)]

    rows = map_arrays(as_arrays(df, keys, [x], t), keys, [x], ["db"], spectra).select(*keys, F.posexplode("db").alias("_i", "db"))
    return rows.select(*keys, F.floor(F.col("_i") / bands).alias("frame"), (F.col("_i") % bands).cast("long").alias("band"), "db")


def frame_power(df: DataFrame, keys: list[str], x: str, frame: int, frequencies: list[int], window: bool = True, t: str = "t") -> DataFrame:
    """(keys, frame, f, power) of whole frames: squared sums over a basis of cosines and sines."""
    i = F.col(t) % frame
    angle = 2 * math.pi / frame * i * F.col("f")
    weight = (0.5 - 0.5 * F.cos(2 * math.pi / frame * i)) if window else F.lit(1.0)
    rows = df.withColumn("frame", F.floor(F.col(t) / frame)).withColumn("f", F.explode(F.array(*map(F.lit, frequencies))))
    v = F.col(x) * weight
    sums = rows.groupBy(*keys, "frame", "f").agg(F.sum(v * F.cos(angle)).alias("_c"), F.sum(v * F.sin(angle)).alias("_s"), F.count("*").alias("_n"))
    return sums.where(F.col("_n") == frame).select(*keys, "frame", F.col("f").cast("long").alias("f"), (F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")).alias("power"))


def band_levels(power: DataFrame, keys: list[str], bands: Column, floor_db: float = 80.0) -> DataFrame:
    """(keys, frame, band, db): band sums in decibels below the series' largest, at most ``floor_db``."""
    sums = power.withColumn("band", bands).where("band is not null").groupBy(*keys, "frame", "band").agg(F.sum("power").alias("power"))
    top = sums.groupBy(*keys).agg(F.max("power").alias("_top")).where("_top > 0")
    level = 10 * F.log10(F.greatest(F.col("power") / F.col("_top"), F.lit(1e-30)))
    return sums.join(top, keys).select(*keys, "frame", "band", F.greatest(level, F.lit(-floor_db)).alias("db"))


def welch_psd(df: DataFrame, keys: list[str], x: str, rate: float, segment: int = 256, overlap: int = 0, low: float = 0.0, high: float | None = None, detrend: bool = True, t: str = "t") -> DataFrame:
    """(keys, f, power): power density by hertz, the mean over whole segments that share ``overlap`` samples.

    Segments are made free of their mean (``detrend``), weighed by a periodic Hamming window and
    transformed as arrays, so a series of any length is in as many groups as it has segments; a sample
    is sent to the segments that it is in. Frequencies from ``low`` to ``high`` Hz. A null sample
    counts as 0. A series shorter than a segment has no row.
    """
    step = segment - overlap
    window = 0.54 - 0.46 * np.cos(2 * math.pi * np.arange(segment) / segment)
    f = np.arange(segment // 2 + 1) * rate / segment
    own = np.flatnonzero((f >= low) & (f <= (f[-1] if high is None else high)))
    double = np.where((f == 0) | (f == rate / 2), 1.0, 2.0) / (rate * (window**2).sum())

    def density(x: np.ndarray) -> list[np.ndarray]:
        x = np.nan_to_num(x)
        if detrend:
            x = x - x.mean(axis=1, keepdims=True)
        return [(np.abs(np.fft.rfft(x * window)) ** 2 * double)[:, own]]

    first = F.greatest(F.lit(0), F.floor((F.col(t) - segment) / step) + 1)
    rows = df.select(*keys, F.col(t).alias("t"), F.col(x).cast("double").alias("x"), F.explode(F.sequence(first, F.floor(F.col(t) / step))).alias("_segment"))
    whole = as_arrays(rows, [*keys, "_segment"], ["x"]).where(F.size("x") == segment)
    each = map_arrays(whole, [*keys, "_segment"], ["x"], ["power"], density).select(*keys, F.posexplode("power").alias("_i", "power"))
    mean = each.groupBy(*keys, "_i").agg(F.avg("power").alias("power"))
    return mean.select(*keys, F.get(F.array(*[F.lit(float(f[i])) for i in own]), F.col("_i")).alias("f"), "power")


def welch(df: DataFrame, keys: list[str], x: str, segment: int, frequencies: list[int], t: str = "t") -> DataFrame:
    """(keys, f, power): mean power over the segments of each series."""
    return frame_power(df, keys, x, segment, frequencies, t=t).groupBy(*keys, "f").agg(F.avg("power").alias("power"))


def plv(angle: Column) -> Column:
    """Phase-locking value of phase differences: the length of the mean direction."""
    c, s = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    return F.sqrt(c * c + s * s)


def plv_arrays(rows: DataFrame, keys: list[str], a: str, b: str, lags: list[int]) -> DataFrame:
    """(keys, lag, plv) of two phase arrays of a row: of a against b so many samples before."""
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, out = [], [], []
            for i, (x, y) in enumerate(zip(batch.column(a).to_numpy(zero_copy_only=False), batch.column(b).to_numpy(zero_copy_only=False), strict=True)):
                for lag in lags:
                    n = min(len(x), len(y) + lag)
                    if n > lag:
                        own.append(i)
                        at.append(lag)
                        out.append(float(np.abs(np.exp(1j * (x[lag:n] - y[: n - lag])).mean())))
            kept = [batch.column(k).take(pa.array(own, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int64()), pa.array(out, pa.float64())], names=[*keys, "lag", "plv"])

    return rows.select(*keys, a, b).mapInArrow(run, f"{schema}lag long, plv double")


def product_means(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, size, means): means of products of the values of the arrays x then y, a matrix row by row."""
    at, size = F.col("mean"), F.size("mean")
    cell = lambda v, i: v / F.col("n") + F.get(at, F.floor(i / size).cast("int")) * F.get(at, (i % size).cast("int"))
    return gram(rows, keys, x, y).select(*keys, size.alias("size"), F.transform("products", cell).alias("means"))


def cross_means(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, a, b, v): mean products of all pairs of an array's values, from one matrix for each key."""
    means = product_means(rows.withColumn("_none", F.array().cast("array<double>")), keys, x, "_none")
    cells = means.select(*keys, "size", F.posexplode("means").alias("_i", "v"))
    return cells.select(*keys, F.floor(F.col("_i") / F.col("size")).alias("a"), (F.col("_i") % F.col("size")).cast("long").alias("b"), "v")


def plv_pairs(rows: DataFrame, keys: list[str], phases: str) -> DataFrame:
    """(keys, a, b, plv) of all pairs of channels whose phases are an array, a row for each sample.

    Sums of products of cosines and sines are all it takes, so no pairs of rows are made.
    """
    both = rows.select(*keys, F.transform(phases, F.cos).alias("_c"), F.transform(phases, F.sin).alias("_s"))
    means = product_means(both, keys, "_c", "_s")
    half = (F.col("size") / 2).cast("int")
    at = lambda i, j: F.get("means", i * F.col("size") + j)
    pairs = means.select(*keys, "size", "means", F.explode(F.sequence(F.lit(0), half * half - 1)).alias("_i"))
    a, b = F.floor(F.col("_i") / half).cast("int"), (F.col("_i") % half).cast("int")
    real, other = at(a, b) + at(a + half, b + half), at(a + half, b) - at(a, b + half)
    return pairs.select(*keys, a.cast("long").alias("a"), b.cast("long").alias("b"), F.sqrt(real * real + other * other).alias("plv"))
