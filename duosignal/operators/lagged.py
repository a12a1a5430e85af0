"""Ridge models of lagged features without their lagged columns.

The Gram matrix of a lagged design is block-Toeplitz but for the ends of each run of rows: features f
and g at the delays u and u + d have the sum of x_f[s] x_g[s - d] over the run moved by u. So tasks
add up one matrix of products for each difference of delays, over blocks of samples that overlap by
the delays, and keep the samples before the two ends of each run. The whole matrix is put together
where a split of a key is solved. A series is in as many tasks as it has blocks; one of a single block
is solved by the task that has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from duosignal.operators.ridge import FIT_COLUMNS, FIT_SCHEMA, _batches, _joined, _schema, _values, fitted_rows, ridge_weights, series_of
from duosignal.operators.series import delay_set

#: What is kept by key and fold: sums and ranges in pieces, the samples before each start and end of a run, the shift.
_PART = "kind string, piece long, content array<double>"


@dataclass(frozen=True)
class Lags:
    """The delays of the features and of the responses, and how many of each there are."""

    features: int
    responses: int
    delays: tuple[int, ...]
    y_delays: tuple[int, ...] = (0,)

    @property
    def first(self) -> int:
        return min(self.delays)

    @property
    def span(self) -> int:
        return max(self.delays) - self.first

    @property
    def back(self) -> int:
        """How many samples before a block its rows and the run's start need."""
        return max(2 * self.span + max(self.first, 0), *self.y_delays, 0) + 1

    @property
    def ahead(self) -> int:
        return max(-self.first, *(-d for d in self.y_delays), 0) + 1

    @property
    def columns(self) -> int:
        return self.features * len(self.delays)

    @property
    def targets(self) -> int:
        return self.responses * len(self.y_delays)


def _moved(values: np.ndarray, delay: int, fill: np.ndarray) -> np.ndarray:
    """values[t - delay], ``fill`` where there is none."""
    out = np.broadcast_to(fill, values.shape).copy()
    n = len(values)
    if delay >= 0:
        out[min(delay, n) :] = values[: max(n - delay, 0)]
    else:
        out[: max(n + delay, 0)] = values[min(-delay, n) :]
    return out


def _block(lags: Lags, start: int, size: int, t: np.ndarray, fold: np.ndarray, x: np.ndarray, y: np.ndarray, shift: np.ndarray) -> Iterator[tuple]:
    """(fold, sums, low, high, borders) of each run of rows of one fold in a block.

    borders are (kind, place, samples): the samples before a run's start or end, where the run does
    not go on in the next block.
    """
    at = t - (start - lags.back)
    n = lags.back + size + lags.ahead
    px, py = -shift[: lags.features], -shift[lags.features :]  # zero outside of the series
    xs, ys, folds = np.tile(px, (n, 1)), np.tile(py, (n, 1)), np.full(n, np.nan)
    xs[at], ys[at], folds[at] = x + px, y + py, fold
    bad = np.isnan(xs).any(axis=1)
    for d in lags.delays:
        folds[_moved(bad, d, np.array(False))] = np.nan
    z = _moved(xs, lags.first, px)
    z[np.isnan(z)] = 0.0
    ys = np.hstack([_moved(ys, d, py) for d in lags.y_delays]) if lags.y_delays != (0,) else ys
    folds[np.isnan(ys).any(axis=1)] = np.nan
    steps = [d - lags.first for d in lags.delays]
    same = folds[1:] == folds[:-1]
    edges = [lags.back, *(np.flatnonzero(~same[lags.back : lags.back + size - 1]) + lags.back + 1), lags.back + size]
    for a, e in zip(edges[:-1], edges[1:], strict=True):
        if np.isnan(folds[a]):
            continue
        own, target = z[a:e], ys[a:e]
        base = np.stack([own.T @ z[a - d : e - d] for d in range(lags.span + 1)])
        moved = [z[a - u : e - u] for u in steps]
        cross = np.stack([m.T @ target for m in moved], axis=1)  # feature, delay, response
        low = np.concatenate([np.stack([m.min(axis=0) for m in moved], axis=1).ravel(), target.min(axis=0)])
        high = np.concatenate([np.stack([m.max(axis=0) for m in moved], axis=1).ravel(), target.max(axis=0)])
        sums = np.concatenate([[e - a], own.sum(axis=0), base.ravel(), cross.ravel(), target.sum(axis=0), (target.T @ target).ravel()])
        borders = []
        if lags.span:
            place = start - lags.back
            if not same[a - 1]:
                borders.append(("start", place + a, z[a - 2 * lags.span : a].ravel()))
            if not same[e - 1]:
                borders.append(("end", place + e, z[e - 2 * lags.span : e].ravel()))
        yield folds[a], sums, low, high, borders


def _partial(keys: list[str], lags: Lags, size: int, held: int, piece: int):
    """What a task finds of each key and fold in its blocks."""
    names = [*keys, "fold", "kind", "piece", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[np.ndarray]] = {}
        borders: list[tuple] = []

        def out() -> Iterator[tuple]:
            for key, parts in found.items():
                for kind, values in zip(("sum", "low", "high"), parts, strict=True):
                    for i in range(0, len(values), piece):
                        yield *key, kind, i // piece, values[i : i + piece]
            yield from borders

        def add(key: tuple, rows: list[tuple]) -> None:
            shift = next((r[3] for r in rows if r[3] is not None), None)
            t = np.concatenate([r[0] for r in rows])
            start = key[-1] * size
            if shift is None or not ((t >= start) & (t < start + size)).any():
                return  # neighbours' samples alone
            for fold, sums, low, high, ends in _block(lags, start, size, t, np.concatenate([r[1] for r in rows]), *(np.concatenate([r[2][i] for r in rows]) for i in (0, 1)), shift):
                own = (*key[:-1], int(fold))
                if own in found:
                    old = found[own]
                    old[0] += sums
                    np.minimum(old[1], low, out=old[1])
                    np.maximum(old[2], high, out=old[2])
                else:
                    found[own] = [sums, low, high]
                borders.extend((*own, *end) for end in ends)

        at, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.select([*keys, "_block"]).to_pandas()
            change = (frame != frame.shift()).any(axis=1).to_numpy()
            cuts = [*np.flatnonzero(change), len(frame)] if change[0] else [0, *np.flatnonzero(change), len(frame)]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(frame.iloc[a].tolist())
                if key != at:
                    if at is not None:
                        add(at, rows)
                        if sum(v.size for f in found.values() for v in f) + sum(b[-1].size for b in borders) > held:
                            yield from _batches(out(), names)
                            found.clear()
                            borders.clear()
                    at, rows = key, []
                part = batch.slice(a, e - a)
                shift = next((np.asarray(s, float) for s in part.column("_shift").to_pylist() if s is not None), None)
                part = part.filter(pc.is_valid(part.column("t")))
                if part.num_rows or shift is not None:
                    x, y = (_values(part.column(c)) if part.num_rows else np.zeros((0, n)) for c, n in (("_x", lags.features), ("_y", lags.responses)))
                    rows.append((part.column("t").to_numpy(zero_copy_only=False).astype(np.int64), part.column("fold").cast("float64").to_numpy(zero_copy_only=False), (x, y), shift))
        if at is not None:
            add(at, rows)
        yield from _batches(out(), names)

    return run


def _merged(keys: list[str]):
    """Pieces of one key and fold made one: added up, or their ranges; borders stay as they are."""
    own = [*keys, "fold", "kind", "piece"]
    join = {"sum": np.add, "low": np.minimum, "high": np.maximum}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, now = None, None
            for batch in batches:
                for *key, content in zip(*[batch.column(c).to_pylist() for c in own], batch.column("content").to_numpy(zero_copy_only=False), strict=True):
                    key = tuple(key)
                    if key == at and key[-2] in join:
                        now = join[key[-2]](now, content)
                        continue
                    if at is not None:
                        yield *at, now
                    at, now = key, content
            if at is not None:
                yield *at, now

        yield from _batches(rows(), [*own, "content"])

    return run


def lagged_parts(df: DataFrame, keys: list[str], x: str, y: str, lags: Lags, fold: str = "fold", t: str = "t", size: int = 8192, held: int = 1 << 22, piece: int = 1 << 14) -> DataFrame:
    """(keys, fold, kind, piece, content): what the Gram matrices of the lagged arrays x and y are made of.

    ``size`` samples are a block, sent to a task with the neighbours that its delays need. A task
    holds about ``held`` numbers of what it found. Values are taken off the key's mean first, so
    large means cost no digits.
    """
    size = max(size, lags.back, lags.ahead)
    block = F.floor(F.col(t) / size).cast("long")
    base = df.select(*keys, F.col(t).cast("long").alias("t"), F.col(fold).cast("long").alias("fold"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    near = F.array_compact(F.array(block, F.when(F.col("t") >= (block + 1) * size - lags.back, block + 1), F.when((F.col("t") < block * size + lags.ahead) & (block > 0), block - 1)))
    rows = base.withColumn("_block", F.explode(near)).withColumn("_shift", F.lit(None).cast("array<double>"))
    mean = lambda c, n: [F.coalesce(F.avg(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)]
    shifts = base.groupBy(*keys).agg(F.array(*mean("_x", lags.features), *mean("_y", lags.responses)).alias("_shift"))
    heads = base.where(F.col("t") % size == 0).select(*keys, block.alias("_block")).join(shifts, keys)
    heads = heads.select(*keys, F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("fold"), F.lit(None).cast(base.schema["_x"].dataType).alias("_x"), F.lit(None).cast(base.schema["_y"].dataType).alias("_y"), "_block", "_shift")
    dealt = rows.union(heads.select(rows.columns)).repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", F.asc_nulls_first("t"))
    schema = f"{_schema(df, keys)}fold long, {_PART}"
    found = dealt.mapInArrow(_partial(keys, lags, size, held, piece), schema)
    order = [*keys, "fold", "kind", "piece"]
    merged = found.repartition(*order).sortWithinPartitions(*order).mapInArrow(_merged(keys), schema)
    return merged.union(shifts.select(*keys, F.lit(-1).cast("long"), F.lit("shift"), F.lit(0).cast("long"), "_shift"))


def whole_gram(lags: Lags, sums: np.ndarray, borders: list[tuple[str, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, centred products) of all features at all delays, features first, and of the responses."""
    f, q, many, span = lags.features, lags.targets, len(lags.delays), lags.span
    cuts = np.cumsum([1, f, (span + 1) * f * f, f * many * q, q])
    n, total, base, cross, target, products = np.split(sums, cuts)
    n, base = float(n[0]), base.reshape(span + 1, f, f)
    steps = [d - lags.first for d in lags.delays]
    sides = [(1.0 if kind == "start" else -1.0, z.reshape(2 * span, f)) for kind, z in borders]
    pairs: dict[int, list[tuple[int, int]]] = {}
    for i, u in enumerate(steps):
        for j, v in enumerate(steps):
            if v >= u:
                pairs.setdefault(v - u, []).append((i, j))
    whole = np.zeros((many, many, f, f))
    for d, own in pairs.items():
        more = np.zeros((span + 1, f, f))  # by the delay of the nearer feature
        for sign, z in sides:
            near, far = z[span:], z[span - d : 2 * span - d]
            more[1:] += sign * (near[::-1, :, None] * far[::-1, None, :]).cumsum(axis=0)
        i, j = np.array(own).T
        whole[i, j] = base[d] + more[np.take(steps, i)]
        whole[j, i] = whole[i, j].transpose(0, 2, 1)
    tail = np.zeros((span + 1, f))
    for sign, z in sides:
        tail[1:] += sign * z[span:][::-1].cumsum(axis=0)
    mean = np.concatenate([(total + tail[steps]).T.ravel(), target]) / n
    p = f * many
    c = np.empty((p + q, p + q))
    c[:p, :p], c[:p, p:], c[p:, p:] = whole.transpose(2, 0, 3, 1).reshape(p, p), cross.reshape(p, q), products.reshape(q, q)
    c[p:, :p] = c[:p, p:].T
    return n, mean, c - n * np.outer(mean, mean)


def _moments(lags: Lags, parts: dict[str, dict[int, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, products, low, high) of a fold, about the shift."""
    total, low, high = (np.concatenate([parts[kind][i] for i in sorted(parts[kind])]) for kind in ("sum", "low", "high"))
    return *whole_gram(lags, total, [(kind, z) for kind in ("start", "end") for z in parts.get(kind, {}).values()]), low, high


def _added(folds: list[tuple]) -> tuple:
    """The moments of several folds as those of one set of rows."""
    n, mean, c, low, high = folds[0]
    for m, other, more, least, most in folds[1:]:
        n, mean, c = _joined(n, mean, c, slice(None), (m, other, more))
        low, high = np.minimum(low, least), np.maximum(high, most)
    return n, mean, c, low, high


def _named(lags: Lags, moments: tuple, shift: np.ndarray, prefix: str) -> dict:
    """A row of moments, as the operators of wide models have it."""
    n, mean, c, low, high = moments
    up = np.concatenate([np.repeat(shift[: lags.features], len(lags.delays)), np.tile(shift[lags.features :], len(lags.y_delays))])
    return {f"{prefix}n": n, f"{prefix}mean": mean + up, f"{prefix}low": low + up, f"{prefix}high": high + up, f"{prefix}products": c}


def _together(folds: list[dict]) -> dict:
    """The parts of several folds as those of one set of rows."""
    out: dict[str, dict] = {}
    join = {"sum": np.add, "low": np.minimum, "high": np.maximum}
    for k, parts in enumerate(folds):
        for kind, pieces in parts.items():
            for i, content in pieces.items():
                if kind in join:
                    old = out.setdefault(kind, {})
                    old[i] = content if i not in old else join[kind](old[i], content)
                else:
                    out.setdefault(kind, {})[(k, i)] = content
    return out


def _whole(lags: Lags, t: np.ndarray, fold: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[dict[int, dict], np.ndarray]:
    """The parts by fold of a series that is one block, and its shift."""
    z = np.hstack([x, y])
    count = (~np.isnan(z)).sum(axis=0)
    shift = np.divide(np.nansum(z, axis=0), count, out=np.zeros(z.shape[1]), where=count > 0)
    folds: dict[int, dict] = {}
    for f, sums, low, high, ends in _block(lags, 0, int(t[-1]) + 1, t, fold, x, y, shift):
        new = {"sum": {0: sums}, "low": {0: low}, "high": {0: high}}
        for kind, place, samples in ends:
            new.setdefault(kind, {})[place] = samples
        folds[int(f)] = _together([folds[int(f)], new]) if int(f) in folds else new
    return folds, shift


def lagged_encode(
    df: DataFrame, keys: list[str], x: str, y: str, features: int, responses: int, delays: list[int], alphas: list[float], fold: str = "fold", t: str = "t",
    y_delays: tuple[int, ...] = (0,), x_by: str | None = "Normalize", y_by: str | None = "Standarize", weigh: Callable = ridge_weights, patterns: bool = False, size: int = 8192, scores: bool = False, **blocks,
) -> DataFrame:
    """Cross-validated ridge models of the array y on all features of the array x at all delays, as encode_wide gives them.

    w has features first, then delays; responses count first by ``y_delays``, then by y. A sample is zero
    outside of its series; t counts from 0 without gaps. Rows without a fold lend their samples to
    their neighbours' delays and count nowhere, as do rows whose y or lagged x has a null. A fold
    that has no other beside it has no model. ``weigh`` makes weights of the scaled centred matrix;
    ``patterns`` adds the forward patterns; with ``scores`` r and rmse come alone. No rows: no rows.

    Series of at most ``size`` samples, which are counted first, are one block each and solved where
    they are; what is found of longer ones is added up by block.
    """
    lags = Lags(features, responses, tuple(delays), tuple(y_delays))
    made = [*keys, "fold", *FIT_COLUMNS, "r", "rmse", *(["pattern"] if patterns else [])]
    names = [*keys, "fold", "alpha", "response", "r", "rmse"] if scores else made
    places = [made.index(c) for c in names]
    schema = f"{_schema(df, keys)}fold long, {FIT_SCHEMA}, r double, rmse double" + (", pattern array<double>" if patterns else "")
    schema = ", ".join(c for c in schema.split(", ") if c.split()[0] in names)

    def solved(key: tuple, folds: dict[int, dict], shift: np.ndarray) -> Iterator[tuple]:
        """The models of each split of a key."""
        each = {f: _moments(lags, folds[f]) for f in sorted(folds)}
        for split, own in each.items():
            rest = [m for f, m in each.items() if f != split]
            if rest:
                row = dict(zip(keys, key, strict=True)) | {"fold": split} | _named(lags, _added(rest), shift, "") | _named(lags, own, shift, "test_")
                for fit in fitted_rows(row, [*keys, "fold"], lags.columns, alphas, x_by, y_by, True, weigh, patterns):
                    yield tuple(fit[i] for i in places)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series = series_of(batches, keys, ["t", "fold"], ["_x", "_y"])
        yield from _batches((fit for key, (when, folds, xs, ys) in series for fit in solved(key, *_whole(lags, when.astype(np.int64), folds.astype(float), xs, ys))), names)

    def solve(table: pa.Table) -> pa.Table:
        frame = table.select([*keys, "fold", "kind", "piece"]).to_pandas()
        content = table.column("content").to_numpy()
        folds: dict[int, dict] = {}
        shift = None
        for fold_, kind, i, values in zip(frame["fold"], frame["kind"], frame["piece"], content, strict=True):
            if kind == "shift":
                shift = np.asarray(values)
            else:
                folds.setdefault(int(fold_), {}).setdefault(kind, {})[int(i)] = np.asarray(values)
        return pa.Table.from_pandas(pd.DataFrame(list(solved(tuple(frame.iloc[0][keys]), folds, shift)), columns=names), preserve_index=False)

    size = max(size, lags.back, lags.ahead)
    rows = df.select(*keys, F.col(t).cast("long").alias("t"), F.col(fold).cast("long").alias("fold"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = df.groupBy(*keys).count().where(F.col("count") > size).select(*keys)

    def by_series(own: DataFrame) -> DataFrame:
        return own.repartition(parts, *keys).sortWithinPartitions(*keys, "t").mapInArrow(whole, schema)

    if long.isEmpty():
        return by_series(rows)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    same = lambda own: reduce(lambda a, b: a & b, [own[k].eqNullSafe(long[k]) for k in keys])
    found = lagged_parts(rows.join(long, same(rows), "left_semi"), keys, "_x", "_y", lags, size=size, **blocks)
    return by_series(rows.join(long, same(rows), "left_anti")).union(found.groupBy(*keys).applyInArrow(lambda own: solve(own).cast(arrow), schema))


def lag_model(df: DataFrame, keys: list[str], x: str | list[str], responses: list[str], tmin: float, tmax: float, rate: float, alpha: float, fold: str = "fold", t: str = "t", **options) -> DataFrame:
    """lagged_encode of plain columns; the time range counts from the response, so delays change sign."""
    xs = [x] if isinstance(x, str) else x
    rows = df.select(*keys, fold, t, F.array(*xs).alias("_xs"), F.array(*responses).alias("_ys"))
    return lagged_encode(rows, keys, "_xs", "_ys", len(xs), len(responses), delay_set(-tmax, -tmin, rate), [alpha], fold, t, **options)


def decode(df: DataFrame, keys: list[str], channels: list[str], stimulus: str, delays: list[int], t_lag: int, alphas: list[float], fold: str = "fold", t: str = "t", **blocks) -> DataFrame:
    """The backward model: all channels at all delays to one stimulus column at delay ``t_lag``.

    Channels are standardised, the stimulus is scaled to its training range. Adds the forward
    patterns: the covariance of the features times the weights over the stimulus's variance.
    """
    rows = df.select(*keys, fold, t, F.array(*channels).alias("_xs"), F.array(stimulus).alias("_ys"))
    return lagged_encode(rows, keys, "_xs", "_ys", len(channels), 1, delays, alphas, fold, t, (t_lag,), "Standarize", "Normalize", patterns=True, **blocks)


def in_turn(cuts: list[int], c: np.ndarray, p: int, alphas: list[float]) -> np.ndarray:
    """Weights of groups of columns fitted each on what those before leave; ``cuts`` are where groups end.

    What a group leaves of the responses has moments that the joint matrix gives, so no rows are read.
    """
    out = np.zeros((len(alphas), p, c.shape[0] - p))
    for a, alpha in enumerate(alphas):
        for start, end in zip([0, *cuts[:-1]], cuts, strict=True):
            own = slice(start, end)
            left = c[own, p:] - c[own, :p] @ out[a]
            block = np.block([[c[own, own], left], [left.T, c[p:, p:]]])
            out[a, own] = ridge_weights(block, end - start, [alpha])[0]
    return out


def averaged(cuts: list[int], c: np.ndarray, p: int, alphas: list[float]) -> np.ndarray:
    """Weights of the mean of the models of each group of columns alone."""
    out = np.zeros((len(alphas), p, c.shape[0] - p))
    for start, end in zip([0, *cuts[:-1]], cuts, strict=True):
        own = np.r_[start:end, p : c.shape[0]]
        out[:, start:end] = ridge_weights(c[np.ix_(own, own)], end - start, alphas) / len(cuts)
    return out


def lagged_stages(df: DataFrame, keys: list[str], x: str, y: str, groups: list[int], responses: int, delays: list[int], alphas: list[float], how: str = "in turn", **options) -> DataFrame:
    """Models of several stimuli, the features of x in ``groups`` of so many: fitted "in turn" on residuals, or the "mean" of models."""
    cuts = [int(v) * len(delays) for v in np.cumsum(groups)]
    weigh = partial({"in turn": in_turn, "mean": averaged}[how], cuts)
    return lagged_encode(df, keys, x, y, sum(groups), responses, delays, alphas, weigh=weigh, **options)


def decode_sweep(df: DataFrame, keys: list[str], channels: str, stimulus: str, count: int, delays: list[int], t_lags: list[int], alpha: float, fold: str = "fold", t: str = "t", **blocks) -> DataFrame:
    """(keys, lag, r, best): the decoder of ``count`` channels at all delays for the stimulus at each lag, mean over folds.

    The stimulus at all lags are responses of one Gram matrix, which is factorised once for a split.
    best marks the lag of the highest mean score, the smallest on a tie.
    """
    rows = df.select(*keys, fold, t, channels, F.array(stimulus).alias("_stimulus"))
    fits = lagged_encode(rows, keys, channels, "_stimulus", count, 1, delays, [alpha], fold, t, tuple(t_lags), "Standarize", "Normalize", scores=True, **blocks)
    lag = F.get(F.array(*[F.lit(d).cast("long") for d in t_lags]), F.col("response").cast("int"))
    mean = fits.withColumn("lag", lag).groupBy(*keys, "lag").agg(F.avg("r").alias("r"))
    best = F.max_by("lag", F.struct("r", -F.col("lag"))).over(Window.partitionBy(*keys))  # a join would fit twice
    return mean.withColumn("_best", best).select(*keys, "lag", "r", (F.col("lag") == F.col("_best")).alias("best"))
