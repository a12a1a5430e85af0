"""Permutation nulls of ridge models: rows of the design shuffled against the responses, many times."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from duosignal.operators.ridge import NARROW, series_of

# A prime and two multipliers; the fifth power is a bijection by this prime.
PRIME, BY_T, BY_ITER = 2147483647, 48271, 69621


def shuffle_key_sql(t: str, iteration: str) -> str:
    """What rows are ordered by in an iteration, as SQL of integers that Spark and others share."""
    u = f"(({t} * {BY_T} + ({iteration} + 1) * {BY_ITER}) % {PRIME})"
    square = f"({u} * {u} % {PRIME})"
    return f"(({square} * {square} % {PRIME}) * {u} % {PRIME})"


def mixed(t: np.ndarray, iteration: np.ndarray) -> np.ndarray:
    """shuffle_key_sql of whole arrays."""
    u = (t * BY_T + (iteration + 1) * BY_ITER) % PRIME
    square = u * u % PRIME
    return square * square % PRIME * u % PRIME


def shuffle_keys(t: np.ndarray, iterations: np.ndarray) -> np.ndarray:
    """shuffle_key_sql for each iteration and t."""
    return mixed(t[None, :].astype(np.int64), iterations[:, None].astype(np.int64))


#: About so many rows are dealt in a unit of work, but 250 iterations at least.
WORK = 1 << 22
#: Of the bijection; a round changes one half of a place by the other.
ROUNDS = 6


def dealt(i: np.ndarray, n: np.ndarray | int, iteration: np.ndarray | int) -> np.ndarray:
    """The row whose features place i < n gets in an iteration: a bijection of the numbers below n for each iteration.

    A place is a pair (left, right) of digits; Feistel rounds add to one digit what the other gives
    with the iteration as the key. What leaves the numbers below n goes through it again until it is
    back. Every place is evaluated by itself, so no rows are sorted and any task can do any of them.
    """
    shape, one = np.broadcast_shapes(*map(np.shape, (i, n, iteration))), np.ndim(n) == 0
    flat = lambda v: np.broadcast_to(np.asarray(v, np.int64), shape).ravel()
    out, key, size = flat(i).copy(), flat(iteration) * ROUNDS, int(n) if one else flat(n)
    many = np.maximum(np.ceil(np.sqrt(size)), 1).astype(np.int64)
    each = -(-size // many)
    at = lambda v, rows: v if one else v[rows]
    for start in range(0, len(out), 1 << 15):  # of what a processor has at hand
        live = np.arange(start, min(start + (1 << 15), len(out)))
        while len(live):
            own, rows, columns = key[live], at(many, live), at(each, live)
            left, right = np.divmod(out[live], columns)
            for j in range(ROUNDS):
                if j % 2:
                    right = (right + mixed(left, own + j)) % columns
                else:
                    left = (left + mixed(right, own + j)) % rows
            out[live] = left * columns + right
            live = live[out[live] >= at(size, live)]
    return out.reshape(shape)


def dealt_sql(name: str, sizes: str, iterations: int) -> str:
    """A recursive CTE ``name`` (n, iter, i, v, step) of ``dealt`` for each n of the query ``sizes``; v holds where step > 0 and v < n."""
    step = f"select *, greatest(ceil(sqrt(n)), 1)::bigint as many from {name} where step = 0 or v >= n"
    step = f"select *, (n + many - 1) // many as each_ from ({step})"
    step = f"select *, v // each_ as l, v % each_ as r from ({step})"
    for j in range(ROUNDS):  # a subquery for each value that is used more than once
        at, other, size = ("r", "l", "each_") if j % 2 else ("l", "r", "many")
        step = f"select *, ({other} * {BY_T} + (iter * {ROUNDS} + {j} + 1) * {BY_ITER}) % {PRIME} as u from ({step})"
        step = f"select *, u * u % {PRIME} as s from ({step})"
        step = f"select n, iter, i, step, many, each_, {other}, ({at} + s * s % {PRIME} * u % {PRIME}) % {size} as {at} from ({step})"
    return f"""{name} as (select n::bigint as n, iter::bigint as iter, i::bigint as i, i::bigint as v, 0 as step from ({sizes}), (select unnest(range({iterations})) as iter), lateral (select unnest(range(n)) as i)
union all select n, iter, i, l * each_ + r, step + 1 from ({step}))"""


def permuted(rows: DataFrame, keys: list[str], x: str, iterations: int) -> DataFrame:
    """Each key's rows once for each iteration, x taken from the row that ``dealt`` gives the row's place in the order of t."""
    part = Window.partitionBy(*keys)
    rows = rows.withColumns({"_i": (F.row_number().over(part.orderBy("t")) - 1).cast("long"), "_n": F.count("*").over(part)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, n, iteration = (batch.column(c).to_numpy() for c in ("_i", "_n", "iter"))
            yield batch.append_column("_from", pa.array(dealt(i, n, iteration)))

    each = rows.withColumn("iter", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    each = each.mapInArrow(place, StructType([*each.schema.fields, StructField("_from", LongType())]))
    values = rows.select(*keys, F.col("_i").alias("_from"), F.col(x).alias(f"{x}_permuted"))
    return each.join(values, [*keys, "_from"]).drop("_i", "_n", "_from")


def _block(n: int) -> int:
    """So many iterations of a series of n rows are a unit of work: short series have all of theirs in one."""
    return max(250, WORK // n)


class _Deals:
    """dealt of whole blocks, kept for series of the same length: at most ``most`` numbers."""

    def __init__(self, most: int = 1 << 24) -> None:
        self.most, self.size, self.kept = most, 0, OrderedDict()

    def __call__(self, n: int, first: int, end: int) -> np.ndarray:
        """(iteration, place) of the iterations from ``first`` to ``end``."""
        key = (n, first, end)
        if (found := self.kept.get(key)) is not None:
            self.kept.move_to_end(key)
            return found
        found = dealt(np.arange(n), n, np.arange(first, end)[:, None])
        if found.size <= self.most // 8:
            self.kept[key] = found
            self.size += found.size
            while self.size > self.most:
                self.size -= self.kept.popitem(last=False)[1].size
        return found


def _scaled(z: np.ndarray, train: np.ndarray, by: str) -> np.ndarray:
    own = z[train]
    shift, size = (own.min(0), np.ptp(own, axis=0)) if by == "Normalize" else (own.mean(0), own.std(0))
    return np.divide(z - shift, size, out=np.zeros_like(z), where=size > 0)


def _crossed(x: np.ndarray, y: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(iteration, feature, response): products of the rows of x in each order with y, each iteration by itself."""
    own = np.take(np.ascontiguousarray(x.T), order, axis=1)
    if y.shape[1] <= NARROW:  # matrices of so few columns take longer
        return np.vecdot(own[:, :, None], np.ascontiguousarray(y.T)).transpose(1, 0, 2)
    return own.transpose(1, 0, 2) @ y


def _scores(x: np.ndarray, y: np.ndarray, fold: np.ndarray, first: int, end: int, alpha: float, both: bool, x_by: str, y_by: str, deals: _Deals) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, r, rmse, weights) of one series in the order of t: (response, iteration), weights with features last.

    Scores come from the test rows' moments, which shuffles of whole rows leave but for X'Y.
    """
    for split in np.unique(fold):
        train = fold != split
        if not train.any():
            continue
        xs, ys = _scaled(x, train, x_by), _scaled(y, train, y_by)
        x_mean, y_mean = xs[train].mean(0), ys[train].mean(0)
        xc, yc = xs - x_mean, ys - y_mean
        train_x, train_y = xc[train], yc[train]
        mean_x, mean_y = xc[~train].mean(0), yc[~train].mean(0)
        test_x, test_y = xc[~train] - mean_x, yc[~train] - mean_y
        n, p, m = len(train_x), x.shape[1], len(test_x)
        inverse = np.linalg.pinv(train_x.T @ train_x + alpha * np.eye(p))  # X'X is the same in all iterations
        xx, xy, yy = test_x.T @ test_x / m, test_x.T @ test_y / m, (test_y * test_y).mean(0)
        step = max(1, min((1 << 22) // max(1, n * p), deals.most // 8 // n))
        parts = []
        for a in range(first, end, step):
            e = min(a + step, end)
            w = inverse @ _crossed(train_x, train_y, deals(n, a, e))
            cross = _crossed(test_x, test_y, deals(m, a, e)) / m if both else xy
            spread, cov, off = (w * (xx @ w)).sum(1), (w * cross).sum(1), mean_x @ w - mean_y
            seen = (spread > 1e-24) & (yy > 1e-24)
            r = np.divide(cov, np.sqrt(np.maximum(spread, 0) * yy), out=np.full(cov.shape, np.nan), where=seen)
            parts.append((r.T, np.sqrt(np.maximum(spread - 2 * cov + yy, 0) + off * off).T, w.transpose(2, 0, 1)))
        yield int(split), *(np.concatenate(v, axis=1) for v in zip(*parts, strict=True))


def _lists(values: list[np.ndarray], depth: int = 1) -> pa.Array:
    """Arrays of ``depth`` dimensions, one a row, as lists; NaN becomes null."""
    out = pa.array(np.concatenate([v.ravel() for v in values]), from_pandas=True)
    for d in range(depth, 0, -1):
        sizes = np.concatenate([np.full(int(np.prod(v.shape[: d - 1])), v.shape[d - 1]) for v in values])
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), out)
    return out


def permutation_scores(
    df: DataFrame, keys: list[str], x: str, y: str, alpha: float, iterations: int, both: bool = False, fold: str = "fold", t: str = "t",
    x_by: str = "Normalize", y_by: str = "Standarize", weights: bool = False, block: int | None = None, mean: bool = False, held: int = 1 << 19,
) -> DataFrame:
    """(keys, fold, response, first, r, rmse): permutation_null with an array of the iterations from ``first`` on.

    ``weights`` adds the arrays w. With ``mean`` all are means over folds, without the column fold.
    Tasks get series of about one length, which share their shuffles.
    """
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keys).schema)
    kinds, own = to_arrow_schema(df.select(*keys).schema), [*keys, "_block"]
    names = [*keys, *([] if mean else ["fold"]), "response", "first", "r", "rmse", *(["w"] if weights else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deals, out, size = _Deals(), [], 0

        def made() -> pa.RecordBatch:
            key, split, response, first, r, rmse, w = zip(*out, strict=True)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*key, strict=True), kinds, strict=True)]
            columns += ([] if mean else [pa.array(split, pa.int64())]) + [pa.array(response, pa.int32()), pa.array(first, pa.int64()), _lists(r), _lists(rmse), *([_lists(w, 2)] if weights else [])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for (*key, number), (folds, xs, ys) in series_of(batches, own, [fold], [x, y]):
            many = block or _block(len(folds))
            first, end = number * many, min((number + 1) * many, iterations)
            found = list(_scores(xs, ys, folds, first, end, alpha, both, x_by, y_by, deals))
            if mean and found:
                count = np.sum([~np.isnan(f[1]) for f in found], axis=0)
                r = np.divide(np.sum([np.nan_to_num(f[1]) for f in found], axis=0), count, out=np.full(count.shape, np.nan), where=count > 0)
                found = [(0, r, *(sum(f[i] for f in found) / len(found) for i in (2, 3)))]
            for split, r, rmse, w in found:
                out.extend((tuple(key), split, j, first, r[j], rmse[j], w[j]) for j in range(len(r)))
                size += r.size * 2 + (w.size if weights else 0)
            if size > held:
                yield made()
                out, size = [], 0
        if out:
            yield made()

    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, t, fold, x, y)
    kept = kept.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    size = F.lit(block) if block else F.greatest(F.lit(250), F.expr(f"{WORK} div _n"))
    each = kept.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((iterations - 1) / size).cast("int"))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # results are many times the rows, by whose size parts would be joined
    dealt_out = each.repartitionByRange(parts, "_n", *own).sortWithinPartitions("_n", *own, t)
    return dealt_out.mapInArrow(run, f"{schema}{'' if mean else 'fold long, '}response int, first long, r array<double>, rmse array<double>{', w array<array<double>>' if weights else ''}")


def permutation_null(df: DataFrame, keys: list[str], x: str, y: str, alpha: float, iterations: int, both: bool = False, fold: str = "fold", t: str = "t", x_by: str = "Normalize", y_by: str = "Standarize", weights: bool = False, block: int | None = None, mean: bool = False) -> DataFrame:
    """(keys, fold, iter, response, r, rmse): ridge models fitted on shuffled training rows.

    x and y are arrays of features and responses. In each iteration the training rows' features are
    dealt anew to their responses; scores are those on the true test rows or, ``both``, on shuffled
    ones. X'X and the scalers don't change by that and are computed once for a split, so an iteration
    costs one product X'Y; shuffles depend on a split's length alone and are shared by series.
    ``weights`` adds the array w; with ``mean`` there is a row of means over folds instead of one for each.
    Repeats of a run give the same shuffles. The unit of work is a key with ``block`` iterations, or by
    the length of its series: its rows are sent once for each such block, and what an iteration gives
    is the same whatever their size. Iterations are gone through in pieces of bounded memory; a task holds one series.
    """
    arrays = permutation_scores(df, keys, x, y, alpha, iterations, both, fold, t, x_by, y_by, weights, block, mean)
    values = ["r", "rmse", *(["w"] if weights else [])]
    own = [*keys, *([] if mean else ["fold"])]
    rows = arrays.select(*own, "response", "first", F.posexplode(F.arrays_zip(*values)).alias("_i", "_at"))
    return rows.select(*own, (F.col("first") + F.col("_i")).alias("iter"), "response", *[F.col(f"_at.{v}").alias(v) for v in values])
