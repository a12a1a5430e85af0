"""Copula and Gaussian information measures, in bits.

A variable is a column or a list of columns. Covariances are summed on Spark by key; those of one or
two columns go on as expressions, of more a log-determinant for each key is taken from them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duosignal.functions.numeric import digamma_sql, normal_quantile_sql, normal_quantiles
from duosignal.operators.order import quantiles, ranked
from duosignal.operators.series import as_arrays, map_arrays

LN2 = math.log(2)


def copula_rank(df: DataFrame, keys: list[str], x: str, name: str, tie: str = "t", ranges: bool = False) -> DataFrame:
    """Adds rank / (n + 1); equal values by the order ``tie``. With ``ranges`` no task holds a key."""
    if ranges:
        return ranked(df, keys, x, tie, "_rank", "_n").withColumn(name, F.col("_rank") / (F.col("_n") + 1)).drop("_rank", "_n")
    part = Window.partitionBy(*keys)
    return df.withColumn(name, F.row_number().over(part.orderBy(x, tie)) / (F.count("*").over(part) + 1))


def copula_normal(df: DataFrame, keys: list[str], x: str, name: str, tie: str = "t", ranges: bool = False) -> DataFrame:
    """Adds the normal quantile of the copula rank."""
    return copula_rank(df, keys, x, "_u", tie, ranges).withColumn(name, F.expr(normal_quantile_sql("_u"))).drop("_u")


def _bias(n: str, dims: int) -> str:
    """Of the entropy of ``dims`` Gaussian dimensions from n samples, in nats."""
    terms = " + ".join(digamma_sql(f"(({n} - {i}) / 2e0)") for i in range(1, dims + 1))
    return f"(({dims} * ln(2e0 / ({n} - 1)) + {terms}) / 2)"


def gauss_entropy_sql(n: str, determinant: str, dims: int, biased: bool = True, logarithm: bool = False) -> str:
    """Entropy in bits from the determinant of the sample covariance, or its logarithm."""
    nats = f"0.5e0 * {determinant if logarithm else f'ln({determinant})'} + {dims} * 0.5e0 * ln(2 * pi() * exp(1e0))"
    return f"(({nats}{' - ' + _bias(n, dims) if biased else ''}) / {LN2!r}e0)"


def listed(*variables: str | list[str]) -> list[list[str]]:
    return [[v] if isinstance(v, str) else list(v) for v in variables]


def log_determinants(df: DataFrame, keys: list[str], blocks: dict[str, list[str]]) -> DataFrame:
    """(keys, n, <block>): the log-determinant of the sample covariance of each block of columns.

    Null where a block has no full rank, or rows are not over one more than all columns. Covariances
    are taken to correlations first, so that the scale of a column costs no digits.
    """
    columns = list(dict.fromkeys(c for own in blocks.values() for c in own))
    cells = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.covar_samp(columns[i], columns[j]) for i, j in cells]).alias("_c"))
    places = [[columns.index(c) for c in own] for own in blocks.values()]

    @F.pandas_udf("array<double>")
    def logs(c: pd.Series) -> pd.Series:
        def one(values: np.ndarray) -> list[float | None]:
            m = np.zeros((len(columns), len(columns)))
            for (i, j), v in zip(cells, values, strict=True):
                m[i, j] = m[j, i] = v
            return [_log_determinant(m[np.ix_(own, own)]) for own in places]

        return pd.Series([one(np.asarray(x, float)) for x in c])

    rows = sums.withColumn("_l", F.when(F.col("n") > len(columns) + 1, logs("_c")))
    return rows.select(*keys, "n", *[F.get("_l", F.lit(i)).alias(b) for i, b in enumerate(blocks)])


def _log_determinant(c: np.ndarray) -> float | None:
    spread = np.diag(c)
    if not (spread > 0).all():
        return None
    values = np.linalg.eigvalsh(c / np.sqrt(np.outer(spread, spread)))
    return float(np.log(values).sum() + np.log(spread).sum()) if values.min() > 1e-12 else None


def mi_gauss_sql(n: str, r: str, biased: bool = True) -> str:
    """Information of two Gaussian variables of correlation r over n samples."""
    correct = f" - {digamma_sql(f'(({n} - 1) / 2e0)')} / 2 + {digamma_sql(f'(({n} - 2) / 2e0)')} / 2" if biased else ""
    return f"((-0.5e0 * ln(1e0 - {r} * {r}){correct}) / {LN2!r}e0)"


def mi_gauss(df: DataFrame, keys: list[str], x: str | list[str], y: str | list[str], biased: bool = True) -> DataFrame:
    """(keys, n, mi); null where a side has no spread, one follows from the other (to 1e-9), or rows are too few."""
    xs, ys = listed(x, y)
    if len(xs) == len(ys) == 1:
        sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_samp(xs[0], ys[0]).alias("_c"), F.stddev_samp(xs[0]).alias("_x"), F.stddev_samp(ys[0]).alias("_y"))
        sums = sums.withColumn("_r", F.when((F.col("_x") > 0) & (F.col("_y") > 0), F.try_divide("_c", F.col("_x") * F.col("_y"))))
        return sums.select(*keys, "n", F.when((F.col("n") > 3) & (F.abs("_r") < 1 - 1e-9), F.expr(mi_gauss_sql("n", "_r", biased))).alias("mi"))
    logs = log_determinants(df, keys, {"_x": xs, "_y": ys, "_xy": xs + ys})
    h = lambda b, k: gauss_entropy_sql("n", b, k, biased, logarithm=True)
    return logs.select(*keys, "n", F.expr(f"{h('_x', len(xs))} + {h('_y', len(ys))} - {h('_xy', len(xs) + len(ys))}").alias("mi"))


def _normals(df: DataFrame, keys: list[str], variables: list[list[str]], tie: str) -> tuple[DataFrame, list[list[str]]]:
    """``df`` with the copula-normal values of all columns, and their names by variable."""
    names = [[f"_n{i}_{j}" for j in range(len(v))] for i, v in enumerate(variables)]
    for v, own in zip(variables, names, strict=True):
        for c, n in zip(v, own, strict=True):
            df = copula_normal(df, keys, c, n, tie)
    return df, [own[0] if len(own) == 1 else own for own in names]


def gcmi_cc(df: DataFrame, keys: list[str], x: str | list[str], y: str | list[str], tie: str = "t") -> DataFrame:
    """(keys, n, mi, many_ties): copula information of x and y; flagged where over 10 % of a column's values repeat."""
    xs, ys = listed(x, y)
    fewest = [F.count_distinct(c) for c in xs + ys]
    ties = df.groupBy(*keys).agg((F.least(*fewest) / F.count("*") < 0.9).alias("many_ties"))
    normal, (cx, cy) = _normals(df, keys, [xs, ys], tie)
    return mi_gauss(normal, keys, cx, cy).join(ties, keys)


def gcmi_lagged(df: DataFrame, keys: list[str], x: str, responses: list[str], lags: list[int], t: str = "t") -> DataFrame:
    """(keys, lag, channel, n, mi): gcmi_cc of x so many samples before (0 outside of the series) and each response.

    Series are taken as arrays, so a lag costs a sort in memory and no shuffle; the values of the
    responses are made normal once. Equal values rank in the order of t.
    """

    def normal(v: np.ndarray) -> np.ndarray:
        rank = np.empty(v.shape)
        np.put_along_axis(rank, np.argsort(v, axis=1, kind="stable"), np.arange(1.0, v.shape[1] + 1)[None, :], axis=1)
        z = normal_quantiles(rank / (v.shape[1] + 1))
        return z - z.mean(axis=1, keepdims=True)

    def correlations(x: np.ndarray, *ys: np.ndarray) -> list[np.ndarray]:
        zs, n, out = [normal(y) for y in ys], x.shape[1], []
        for lag in lags:
            moved = np.zeros(x.shape)
            if lag < n:
                moved[:, max(lag, 0) : n + min(lag, 0)] = x[:, max(-lag, 0) : n - max(lag, 0)]
            a = normal(moved)
            for z in zs:
                size = np.sqrt((a * a).sum(axis=1) * (z * z).sum(axis=1))
                out.append(np.divide((a * z).sum(axis=1), size, out=np.full(len(x), np.nan), where=size > 0))
        return [np.stack(out, axis=1)]

    rows = map_arrays(as_arrays(df, keys, [x, *responses], t).withColumn("t", F.size(t).cast("long")), keys, [x, *responses], ["r"], correlations)
    names, at = F.array(*map(F.lit, responses)), F.col("_i")
    rows = rows.select(*keys, F.col("t").alias("n"), F.posexplode("r").alias("_i", "_r"))
    rows = rows.select(*keys, F.get(F.array(*[F.lit(d).cast("long") for d in lags]), F.floor(at / len(responses)).cast("int")).alias("lag"), F.get(names, (at % len(responses)).cast("int")).alias("channel"), "n", "_r")
    return rows.select(*keys, "lag", "channel", "n", F.when((F.col("n") > 3) & (F.abs("_r") < 1 - 1e-9), F.expr(mi_gauss_sql("n", "_r"))).alias("mi"))


def entropy_gauss(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, h): Gaussian entropy of one or more columns; null where they have no full rank."""
    logs = log_determinants(df, keys, {"_l": columns}).where(F.col("n") > len(columns) + 1)
    return logs.select(*keys, "n", F.expr(gauss_entropy_sql("n", "_l", len(columns), logarithm=True)).alias("h"))


def classes(df: DataFrame, keys: list[str], label: str, name: str = "class") -> DataFrame:
    """Adds dense class numbers from 0."""
    return df.withColumn(name, (F.dense_rank().over(Window.partitionBy(*keys).orderBy(label)) - 1).cast("long"))


def mi_model_gd(df: DataFrame, keys: list[str], x: str | list[str], label: str, least: int = 4) -> DataFrame:
    """(keys, mi): entropy of x less the weighted entropy within classes (of at least ``least`` rows)."""
    (xs,) = listed(x)
    if len(xs) > 1:
        each, whole = (log_determinants(df, own, {"v": xs}).withColumn("_h", F.expr(gauss_entropy_sql("n", "v", len(xs), logarithm=True))) for own in ([*keys, label], keys))
        within = each.where((F.col("n") >= least) & F.col("_h").isNotNull()).groupBy(*keys).agg(F.sum(F.col("n") * F.col("_h")).alias("_s"), F.sum("n").alias("_m"))
        return whole.join(within, keys).select(*keys, (F.col("_h") - F.col("_s") / F.col("_m")).alias("mi"))
    x = xs[0]
    entropy = lambda: F.expr(gauss_entropy_sql("n", "v", 1))
    whole = df.groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp(x).alias("v")).where("v > 0").select(*keys, F.col("n").alias("_n"), entropy().alias("_h"))
    each = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.var_samp(x).alias("v")).where((F.col("n") >= least) & (F.col("v") > 0)).withColumn("_e", entropy())
    within = each.groupBy(*keys).agg(F.sum(F.col("n") * F.col("_e")).alias("_s"), F.sum("n").alias("_m"))
    return whole.join(within, keys).select(*keys, (F.col("_h") - F.col("_s") / F.col("_m")).alias("mi"))


def mi_mixture_gd(df: DataFrame, keys: list[str], x: str | list[str], label: str, least: int = 4) -> DataFrame:
    """(keys, mi): entropy of the mixture of the classes' Gaussians less their mean entropy.

    The mixture's entropy is taken at each class's unscented points: mean and mean +- the rows of the
    Cholesky factor by the root of their number. Classes of less than full rank count nowhere.
    """
    (xs,) = listed(x)
    if len(xs) > 1:
        return _mixture_wide(df, keys, xs, label, least)
    x = xs[0]
    each = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).where((F.col("n") >= least) & (F.col("v") > 0))
    each = each.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    points = each.select(*keys, F.col(label).alias("_own"), F.col("w").alias("_w"), F.explode(F.array(F.col("m") - F.sqrt("v"), F.col("m") + F.sqrt("v"))).alias("_p"))
    density = F.col("w") * F.exp(-F.pow(F.col("_p") - F.col("m"), F.lit(2)) / (2 * F.col("v"))) / F.sqrt(2 * math.pi * F.col("v"))
    at = points.join(each, keys).groupBy(*keys, "_own", "_w", "_p").agg(F.sum(density).alias("_f"))
    mixture = at.groupBy(*keys).agg((-F.sum(F.col("_w") * F.log("_f")) / 2 / LN2).alias("_h"))
    own = each.groupBy(*keys).agg(F.sum(F.col("w") * F.expr(gauss_entropy_sql("n", "v", 1, biased=False))).alias("_e"))
    return mixture.join(own, keys).select(*keys, (F.col("_h") - F.col("_e")).alias("mi"))


def _mixture_wide(df: DataFrame, keys: list[str], xs: list[str], label: str, least: int) -> DataFrame:
    """mi_mixture_gd of several columns, from means and covariances of each class: a row for each class and key."""
    d = len(xs)
    cells = [(i, j) for i in range(d) for j in range(i + 1)]
    each = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in xs]).alias("m"), F.array(*[F.covar_samp(xs[i], xs[j]) for i, j in cells]).alias("c"))
    whole = each.where(F.col("n") >= max(least, d + 2)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "m", "c"))).alias("_classes"))

    @F.pandas_udf("double")
    def information(classes: pd.Series) -> pd.Series:
        def one(rows: list) -> float | None:
            own = []
            for r in rows:
                c = np.zeros((d, d))
                for (i, j), v in zip(cells, r["c"], strict=True):
                    c[i, j] = c[j, i] = v
                if _log_determinant(c) is not None:
                    own.append((float(r["n"]), np.asarray(r["m"], float), np.linalg.cholesky(c)))
            total = sum(n for n, _, _ in own)
            bits = 0.0
            for n, m, root in own:
                points = np.vstack([m + math.sqrt(d) * root, m - math.sqrt(d) * root])
                logs = np.stack([math.log(k / total) - 0.5 * (np.linalg.solve(q, (points - a).T) ** 2).sum(0) - np.log(np.diag(q)).sum() - d / 2 * math.log(2 * math.pi) for k, a, q in own])
                top = logs.max(axis=0)
                mixed = -(top + np.log(np.exp(logs - top).sum(axis=0))).mean()
                bits += n / total * (mixed - np.log(np.diag(root)).sum() - d / 2 * (math.log(2 * math.pi) + 1))
            return bits / LN2 if own else None

        return pd.Series([one(x) for x in classes], dtype="float64")

    return whole.select(*keys, information("_classes").alias("mi"))


def robust_copula(df: DataFrame, keys: list[str], x: str, label: str, name: str) -> DataFrame:
    """Adds x made normal within each class and set to the class's median and 1.4826 * MAD."""
    own = [*keys, label]
    middle = quantiles(df, own, x, {"_med": 0.5}, "t")
    rows = copula_normal(df, own, x, "_c").join(middle, own).withColumn("_dev", F.abs(F.col(x) - F.col("_med")))
    spread = quantiles(rows, own, "_dev", {"_mad": 0.5}, "t").withColumn("_mad", F.col("_mad") * 1.4826)
    return rows.join(spread, own).withColumn(name, F.col("_c") * F.col("_mad") + F.col("_med")).drop("_med", "_dev", "_mad", "_c")


def cmi_gauss(df: DataFrame, keys: list[str], x: str | list[str], y: str | list[str], z: str | list[str]) -> DataFrame:
    """(keys, n, cmi): information of x and y given z, from their joint covariance."""
    xs, ys, zs = listed(x, y, z)
    if max(map(len, (xs, ys, zs))) > 1:
        logs = log_determinants(df, keys, {"_xz": xs + zs, "_yz": ys + zs, "_xyz": xs + ys + zs, "_z": zs})
        h = lambda b, k: gauss_entropy_sql("n", b, k, logarithm=True)
        p, q, o = len(xs), len(ys), len(zs)
        return logs.select(*keys, "n", F.expr(f"{h('_xz', p + o)} + {h('_yz', q + o)} - {h('_xyz', p + q + o)} - {h('_z', o)}").alias("cmi"))
    names = {"a": xs[0], "b": ys[0], "c": zs[0]}
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.covar_samp(names[i], names[j]).alias(i + j) for i, j in ("aa", "ab", "ac", "bb", "bc", "cc")])
    return sums.where("n > 4").select(*keys, "n", F.expr(cmi_sql()).alias("cmi"))


def cmi_sql() -> str:
    """H(xz) + H(yz) - H(xyz) - H(z) of the columns n and aa ... cc."""
    two = lambda i, j, c: f"({i} * {j} - {c} * {c})"
    three = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
    h = [gauss_entropy_sql("n", d, k) for d, k in ((two("aa", "cc", "ac"), 2), (two("bb", "cc", "bc"), 2), (three, 3), ("cc", 1))]
    return f"({h[0]} + {h[1]} - {h[2]} - {h[3]})"


def gccmi_ccc(df: DataFrame, keys: list[str], x: str | list[str], y: str | list[str], z: str | list[str], tie: str = "t") -> DataFrame:
    normal, (cx, cy, cz) = _normals(df, keys, listed(x, y, z), tie)
    return cmi_gauss(normal, keys, cx, cy, cz)


def gccmi_ccd(df: DataFrame, keys: list[str], x: str | list[str], y: str | list[str], label: str, tie: str = "t", least: int = 4) -> DataFrame:
    """(keys, cmi, mi): information given the class, and of the pooled rows made normal by class."""
    own = [*keys, label]
    normal, (cx, cy) = _normals(df, own, listed(x, y), tie)
    each = mi_gauss(normal, own, cx, cy).where(F.col("n") >= least)
    given = each.where("mi is not null").groupBy(*keys).agg((F.sum(F.col("n") * F.col("mi")) / F.sum("n")).alias("cmi"))
    return given.join(mi_gauss(normal, keys, cx, cy).select(*keys, "mi"), keys)
