"""Statistical tests over scores: permutation p-values, t, sign flips, ranks, clusters, corrections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from duosignal.operators.nulls import shuffle_key_sql, shuffle_keys

def permutation_p(true: DataFrame, null: DataFrame, keys: list[str], score: str, less: str | None = None) -> DataFrame:
    """(keys, p): the rank of the true score among the iterations there are, (count + 1) / (n + 1).

    Counts null scores above the true one; with ``less``, of a second score, those below, as p_less.
    Without a null p is null. Null scores may be arrays of iterations, which are counted where they are.
    """
    scores = [score] if less is None else [score, less]
    own = true.select(*keys, *[F.col(c).alias(f"_true_{c}") for c in scores])
    both = own.join(null.select(*keys, *[F.col(c).alias(f"_null_{c}") for c in scores]), keys, "left")

    def rank(c: str, beyond: Column) -> Column:
        n = F.count(f"_null_{c}")
        return F.when(n > 0, (F.count_if(beyond) + 1) / (n + 1))

    if isinstance(null.schema[score].dataType, ArrayType):

        def rank(c: str, beyond: Callable[[Column, Column], Column]) -> Column:
            n = F.sum(F.coalesce(F.array_size(F.array_compact(f"_null_{c}")), F.lit(0)))
            above = F.sum(F.array_size(F.filter(f"_null_{c}", lambda v: beyond(v, F.col(f"_true_{c}")))))
            return F.when(n > 0, (above + 1) / (n + 1))

        out = [rank(score, lambda v, true: v > true).alias("p"), *([] if less is None else [rank(less, lambda v, true: v < true).alias("p_less")])]
        return both.groupBy(*keys).agg(*out)
    out = [rank(score, F.col(f"_null_{score}") > F.col(f"_true_{score}")).alias("p")]
    if less is not None:
        out.append(rank(less, F.col(f"_null_{less}") < F.col(f"_true_{less}")).alias("p_less"))
    return both.groupBy(*keys).agg(*out)


def passes_all_folds(p: DataFrame, keys: list[str], threshold: float | Column) -> DataFrame:
    """(keys, passed, p): if p is below the threshold in every fold, and the mean p."""
    return p.groupBy(*keys).agg(F.bool_and(F.col("p") < threshold).alias("passed"), F.avg("p").alias("p"))


def t_one_sample(n: Column, mean: Column, sd: Column) -> Column:
    """t of a sample of size n against 0, from its mean and sample deviation."""
    return F.when(sd > 0, F.try_divide(mean, sd / F.sqrt(n)))


def sign_sql(member: str, perm: str) -> str:
    """The sign of a member in a permutation, as SQL."""
    return f"case when {shuffle_key_sql(member, perm)} % 2 = 0 then 1e0 else -1e0 end"


def sign_flip_t(df: DataFrame, member: str, cells: list[str], value: str, permutations: int) -> DataFrame:
    """(perm, cells, t): t of each cell with the members' signs flipped at random, the same in all cells.

    The sum of squares doesn't change with signs, and sums of flipped values are products of a matrix
    of signs with one of values: a task sends a number for each permutation and cell, no row of its own.
    """
    schema = "perm long, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*cells).schema) + "s double"
    perms = np.arange(permutations)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for own in batches:
            if not len(own):
                continue
            who, row = np.unique(own[member], return_inverse=True)
            signs = np.where(shuffle_keys(who, perms) % 2 == 0, 1.0, -1.0)
            places = own.groupby(cells, sort=False).indices
            values = np.zeros((len(who), len(places)))
            for j, at in enumerate(places.values()):
                np.add.at(values, (row[at], j), own[value].to_numpy()[at])
            for cell, s in zip(places, (signs @ values).T, strict=True):
                cell = cell if isinstance(cell, tuple) else (cell,)
                found[cell] = found.get(cell, 0.0) + s
        for cell, s in found.items():
            yield pd.DataFrame({"perm": perms, **dict(zip(cells, cell, strict=True)), "s": s})

    known = df.where(F.col(value).isNotNull())
    sizes = known.groupBy(*cells).agg(F.count("*").alias("n"), F.sum(F.col(value) * F.col(value)).alias("q"))
    flipped = known.select(member, *cells, value).mapInPandas(sums, schema).groupBy("perm", *cells).agg(F.sum("s").alias("s")).join(sizes, cells)
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)))
    return flipped.select("perm", *cells, t_one_sample(F.col("n"), mean, sd).alias("t"))


def _heights(top: float, start: float, step: float) -> np.ndarray:
    """start (without one, step) and on by ``step``, as far as ``top``."""
    out, height = [], start if start > 0 else step
    while height <= top:
        out.append(height)
        height += step
    return np.array(out)


def _enhance(t: np.ndarray, start: float, step: float) -> np.ndarray:
    """Threshold-free cluster enhancement of a lattice: extent ** 0.5 * height ** 2 over heights.

    Cells come in falling order and join the clusters of their neighbours. A cluster of one extent
    lasts from the cell that made it down to the next that changes it; the heights in between are a
    difference of two prefix sums, whatever their number. Every cell's score is what its cluster and
    those that it became part of have, added once down the tree.
    """
    out = np.zeros_like(t)
    rows, columns = t.shape
    for sign in (1, -1):
        x = np.nan_to_num(sign * t)
        heights = _heights(x.max(initial=0.0), start, step)
        if not len(heights):
            continue
        gain = np.concatenate([[0.0], np.cumsum(heights**2 * step)])
        level = gain[np.searchsorted(heights, x.ravel(), "right")].tolist()
        order = np.flatnonzero(x.ravel() >= heights[0])
        order = order[np.argsort(-x.ravel()[order], kind="stable")].tolist()
        top, root, size, up, own = {}, {}, [], [], []  # a node for each cell, in the order of their coming
        for node, cell in enumerate(order):
            i, j = divmod(cell, columns)
            merged = set()
            for other in ((cell - columns) if i else -1, (cell + columns) if i + 1 < rows else -1, cell - 1 if j else -1, cell + 1 if j + 1 < columns else -1):
                if other in top:
                    at = top[other]
                    while root[at] != at:
                        root[at] = at = root[root[at]]
                    merged.add(at)
            size.append(1 + sum(size[m] for m in merged))
            for m in merged:
                own[m] = size[m] ** 0.5 * (own[m] - level[cell])
                root[m] = up[m] = node
            top[cell] = root[node] = node
            up.append(-1)
            own.append(level[cell])
        total = [0.0] * len(order)
        for node in range(len(order) - 1, -1, -1):
            total[node] = own[node] + total[up[node]] if up[node] >= 0 else size[node] ** 0.5 * own[node]
        out.ravel()[order] += sign * np.array(total)
    return out


def tfce(maps: DataFrame, row: str, column: str, start: float = 0.0, step: float = 0.2) -> DataFrame:
    """(perm, row, column, t, score): the enhanced map of each permutation; a map is a row, a task takes many."""
    kind = lambda c: maps.schema[c].dataType.simpleString()
    cells = F.array_sort(F.collect_list(F.struct(row, column, "t")))
    each = lambda c: F.transform(cells, lambda r: r[c]).alias(c)
    whole = maps.groupBy("perm").agg(each(row), each(column), each("t"))

    def enhance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for own in zip(*[batch.column(c).to_pylist() for c in (row, column, "t")], strict=True):
                rows, i = np.unique(own[0], return_inverse=True)
                columns, j = np.unique(own[1], return_inverse=True)
                grid = np.zeros((len(rows), len(columns)))
                grid[i, j] = np.nan_to_num(np.array(own[2], float))
                scores.append(_enhance(grid, start, step)[i, j])
            yield batch.append_column("score", pa.array(scores, pa.list_(pa.float64())))

    made = whole.mapInArrow(enhance, f"perm {kind('perm')}, {row} array<{kind(row)}>, {column} array<{kind(column)}>, t array<double>, score array<double>")
    return made.select("perm", F.inline(F.arrays_zip(row, column, "t", "score")))


def max_p(scores: DataFrame, true: DataFrame, cells: list[str], value: str) -> DataFrame:
    """(cells, p) of true values against the distribution of each permutation's largest absolute one.

    That distribution is one number for each permutation, and goes to all cells as one array.
    """
    tops = scores.groupBy("perm").agg(F.max(F.abs(value)).alias("_top")).agg(F.collect_list("_top").alias("_tops"))
    beyond = F.size(F.filter("_tops", lambda v: v >= F.abs(value)))
    return true.join(F.broadcast(tops)).select(*cells, ((beyond + 1) / (F.size("_tops") + 1)).alias("p"))


def threshold_map(p: str | Column, limit: float = 0.05) -> Column:
    """-log10 of p, at least 1e-5, where p above the limit counts as 1."""
    p = F.col(p) if isinstance(p, str) else p
    return -F.log10(F.greatest(F.when(p > limit, 1.0).otherwise(p), F.lit(1e-5))) + 0.0


def signed_ranks(df: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """(keys, n, plus, minus, w, ties, cube): Wilcoxon's sums of ranks of differences other than 0.

    Ties share their mean rank; cube is the sum of m^3 - m over groups of m tied ones.
    """
    rows = df.where(F.col(d) != 0).withColumn("_a", F.abs(d))
    part, same = Window.partitionBy(*keys), Window.partitionBy(*keys, "_a")
    rows = rows.withColumn("_m", F.count("*").over(same)).withColumn("_r", F.rank().over(part.orderBy("_a")) + (F.col("_m") - 1) / 2)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col(d) < 0, F.col("_r")).otherwise(0.0)).alias("minus"), F.sum(F.col("_m") * F.col("_m") - 1).cast("double").alias("cube"))
    return out.withColumns({"w": F.least("plus", "minus"), "ties": F.col("cube") > 0})


def _wilcoxon_p(n: int, w: float, ties: bool, cube: float) -> float:
    if n <= 25 and not ties:
        counts = [1]
        for rank in range(1, n + 1):
            counts = [(counts[s] if s < len(counts) else 0) + (counts[s - rank] if 0 <= s - rank < len(counts) else 0) for s in range(len(counts) + rank)]
        return min(1.0, 2 * sum(counts[: int(w) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - cube / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


def with_wilcoxon_p(ranks: DataFrame) -> DataFrame:
    """Adds the two-sided p: exact for up to 25 untied differences, else by the normal approximation."""

    @F.pandas_udf("double")
    def tail(n: pd.Series, w: pd.Series, ties: pd.Series, cube: pd.Series) -> pd.Series:
        return pd.Series([_wilcoxon_p(*x) for x in zip(n, w, ties, cube, strict=True)], dtype="float64")

    return ranks.withColumn("p", tail("n", "w", "ties", "cube"))


def fdr(df: DataFrame, group: list[str], p: str, limit: float = 0.05) -> DataFrame:
    """Adds Benjamini and Hochberg's ``corrected`` p and ``passed``."""
    part = Window.partitionBy(*group)
    up = F.row_number().over(part.orderBy(p))
    rows = df.withColumns({"_i": up, "_q": F.col(p) * F.count("*").over(part) / up})
    low = F.min("_q").over(part.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("corrected", F.least(F.lit(1.0), low)).withColumn("passed", F.col("corrected") < limit).drop("_i", "_q")


def bonferroni_log(df: DataFrame, p: str, tests: int, limit: float = 0.05) -> DataFrame:
    """Adds log10 of p (0 where it isn't below limit / tests) and ``passed``."""
    ok = F.col(p) < limit / tests
    return df.withColumns({"passed": ok, "log_p": F.when(ok, F.log10(F.greatest(F.col(p), F.lit(1e-300)))).otherwise(0.0)})


def cohen_d(df: DataFrame, keys: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """(keys, d): the absolute difference of means over the pooled sample deviation."""
    side = lambda fn, g: fn(F.when(F.col(group) == g, F.col(value)))
    n, m = (side(F.count, g) for g in (a, b))
    pooled = F.sqrt(F.try_divide((n - 1) * side(F.var_samp, a) + (m - 1) * side(F.var_samp, b), n + m - 2))
    return df.where(F.col(group).isin(a, b)).groupBy(*keys).agg(F.when(pooled > 0, F.try_divide(F.abs(side(F.avg, a) - side(F.avg, b)), pooled)).alias("d"))


def t_independent(df: DataFrame, keys: list[str], group: str, a: object, b: object, value: str) -> DataFrame:
    """(keys, t): two samples with pooled variance."""
    side = lambda fn, g: fn(F.when(F.col(group) == g, F.col(value)))
    n, m = (side(F.count, g) for g in (a, b))
    pooled = F.try_divide((n - 1) * side(F.var_samp, a) + (m - 1) * side(F.var_samp, b), n + m - 2)
    size = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m)))
    return df.groupBy(*keys).agg(F.when(size > 0, F.try_divide(side(F.avg, a) - side(F.avg, b), size)).alias("t"))
