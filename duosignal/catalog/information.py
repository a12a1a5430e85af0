"""Queries over information measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.catalog.registry import E, L, Tables, query, r
from duosignal.functions.numeric import normal_quantile_sql, r6
from duosignal.operators import information as nf


def _rank(x: str, keys: str = "k", tie: str = "t") -> str:
    return f"(row_number() over (partition by {keys} order by {x}, {tie}) / (count(*) over (partition by {keys}) + 1e0))"


def _normals(source: str, columns: dict[str, str], keys: str = "k") -> str:
    """CTEs U and N: copula ranks, then normal values, of the columns (by new name)."""
    ranks = ", ".join(f"{_rank(x, keys)} as u_{n}" for n, x in columns.items())
    values = ", ".join(f"{normal_quantile_sql(f'u_{n}')} as {n}" for n in columns)
    return f"U as (select *, {ranks} from {source}), N as (select *, {values} from U)"


def _mi(x: str, y: str, source: str, keys: str, biased: bool = True) -> str:
    corr = f"covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y}))"
    inner = f"select {keys}, count(*) as n, case when stddev_samp({x}) > 0 and stddev_samp({y}) > 0 then {corr} end as r from {source} group by {keys}"
    return f"select {keys}, n, case when n > 3 and abs(r) < 1 - 1e-9 then {nf.mi_gauss_sql('n', 'r', biased)} end as mi from ({inner})"


@query("copula_rank_ranges", f"with {E} select k, t, {r(_rank('v'))} as u from E")
def copula_rank_ranges(t: Tables) -> DataFrame:
    """The same ranks by ranges of key and value, so that no task holds a key."""
    return nf.copula_rank(t.e, ["k"], "v", "u", ranges=True).select("k", "t", r6("u").alias("u"))


@query("copula_rank", f"with {E} select k, t, {r(_rank('v'))} as u from E")
def copula_rank(t: Tables) -> DataFrame:
    return nf.copula_rank(t.e, ["k"], "v", "u").select("k", "t", r6("u").alias("u"))


@query("copula_normal", f"with {E}, {_normals('E', {'c': 'v'})} select k, t, {r('c')} as c from N")
def copula_normal(t: Tables) -> DataFrame:
    return nf.copula_normal(t.e, ["k"], "v", "c").select("k", "t", r6("c").alias("c"))


_DET = "(var_samp(x) * var_samp(y2) - covar_samp(x, y2) ** 2)"
_LK = "L0 as (select cast(k as bigint) as k, t, x, y1 / 1e4 as y1, y2 * 100 as y2, y3 * 100 as y3 from L)"


def _l(t: Tables) -> DataFrame:
    return t.l.select("k", "t", "x", (F.col("y1") / 1e4).alias("y1"), (F.col("y2") * 100).alias("y2"), (F.col("y3") * 100).alias("y3"))


@query("entropy_gauss", f"with {L}, {_LK}, A as (select k, count(*) as n, var_samp(x) as v, {_DET} as d from L0 group by k) select k, {r(nf.gauss_entropy_sql('n', 'v', 1))} as h1, {r(nf.gauss_entropy_sql('n', 'd', 2))} as h2 from A")
def entropy_gauss(t: Tables) -> DataFrame:
    one, two = (nf.entropy_gauss(_l(t), ["k"], c).select("k", r6("h").alias(f"h{len(c)}")) for c in (["x"], ["x", "y2"]))
    return one.join(two, "k")


@query("entropy_gauss_wide")
def entropy_gauss_wide(t: Tables) -> DataFrame:
    return nf.entropy_gauss(_l(t), ["k"], ["x", "y1", "y2", "y3"])


@query("mi_gauss", f"with {L}, {_LK}, A as ({_mi('x', 'y1', 'L0', 'k')}) select k, n, {r('mi')} as mi from A")
def mi_gauss(t: Tables) -> DataFrame:
    return nf.mi_gauss(_l(t), ["k"], "x", "y1").select("k", "n", r6("mi").alias("mi"))


_EV = "E0 as (select k, t, label, state, v, v + event_id % 97 as w, v * 0.5e0 + event_id % 31 as z from E)"


def _e(t: Tables) -> DataFrame:
    return t.e.select("k", "t", "label", "state", "v", (F.col("v") + F.col("event_id") % 97).alias("w"), (F.col("v") * 0.5 + F.col("event_id") % 31).alias("z"))


@query("gcmi_cc", f"with {E}, {_EV}, {_normals('E0', {'cx': 'v', 'cy': 'w'})}, A as ({_mi('cx', 'cy', 'N', 'k')}), T as (select k, least(count(distinct v), count(distinct w)) / count(*) < 0.9 as many_ties from E0 group by k) select A.k, n, {r('mi')} as mi, many_ties from A join T on T.k = A.k")
def gcmi_cc(t: Tables) -> DataFrame:
    return nf.gcmi_cc(_e(t), ["k"], "v", "w").select("k", "n", r6("mi").alias("mi"), "many_ties")


_LAGS = list(range(16))


@query("gcmi_lagged", f"with {L}, {_LK}, X as (" + " union all ".join(f"select k, t, {d} as lag, '{c}' as channel, lag(x, {d}, 0.0) over (partition by k order by t) as x, {c} as y from L0" for d in _LAGS for c in ("y1", "y2")) + f"), {_normals('X', {'cx': 'x', 'cy': 'y'}, 'k, lag, channel')}, A as ({_mi('cx', 'cy', 'N', 'k, lag, channel')}) select k, cast(lag as bigint) as lag, channel, {r('mi')} as mi from A")
def gcmi_lagged(t: Tables) -> DataFrame:
    rows = nf.gcmi_lagged(_l(t), ["k"], "x", ["y1", "y2"], _LAGS)
    return rows.select("k", "lag", "channel", r6("mi").alias("mi"))


def _model(x: str, source: str) -> str:
    h = nf.gauss_entropy_sql("n", "v", 1)
    return f"""A as (select k, n, {h} as h from (select k, count(*) as n, var_samp({x}) as v from {source} group by k) where v > 0),
B as (select k, n, {h} as h from (select k, label, count(*) as n, var_samp({x}) as v from {source} group by k, label) where n >= 4 and v > 0),
G as (select k, sum(n * h) / sum(n) as h from B group by k), R as (select A.k, A.h - G.h as mi from A join G on G.k = A.k)"""


@query("mi_model_gd", f"with {E}, {_EV}, {_model('v', 'E0')} select k, {r('mi')} as mi from R")
def mi_model_gd(t: Tables) -> DataFrame:
    return nf.mi_model_gd(_e(t), ["k"], "v", "label").select("k", r6("mi").alias("mi"))


@query("gcmi_model_cd", f"with {E}, {_EV}, {_normals('E0', {'cx': 'v'})}, {_model('cx', 'N')} select k, {r('mi')} as mi from R")
def gcmi_model_cd(t: Tables) -> DataFrame:
    rows = nf.classes(nf.copula_normal(_e(t), ["k"], "v", "cx"), ["k"], "label")
    return nf.mi_model_gd(rows, ["k"], "cx", "class").select("k", r6("mi").alias("mi"))


def _mixture(x: str, source: str) -> str:
    return f"""B as (select *, n / sum(n) over (partition by k) as w from (select k, label, count(*) as n, avg({x}) as m, var_samp({x}) as v from {source} group by k, label) where n >= 4 and v > 0),
Q as (select k, label as own, w as ow, unnest([m - sqrt(v), m + sqrt(v)]) as p from B),
D as (select Q.k, own, ow, p, sum(w * exp(-((p - m) * (p - m)) / (2 * v)) / sqrt(2 * pi() * v)) as f from Q join B on B.k = Q.k group by all),
H as (select k, -sum(ow * ln(f)) / 2 / ln(2e0) as h from D group by k), G as (select k, sum(w * {nf.gauss_entropy_sql('n', 'v', 1, False)}) as e from B group by k), R as (select H.k, h - e as mi from H join G on G.k = H.k)"""


@query("mi_mixture_gd", f"with {E}, {_EV}, {_mixture('v', 'E0')} select k, {r('mi')} as mi from R")
def mi_mixture_gd(t: Tables) -> DataFrame:
    return nf.mi_mixture_gd(_e(t), ["k"], "v", "label").select("k", r6("mi").alias("mi"))


_ROBUST = f"{_normals('E0', {'c': 'v'}, 'k, label')}, M1 as (select k, label, median(v) as med from E0 group by all), M2 as (select E0.k, E0.label, any_value(med) as med, median(abs(v - med)) * 1.4826e0 as mad from E0 join M1 on M1.k = E0.k and M1.label = E0.label group by all), Z as (select N.k, N.label, c * mad + med as z from N join M2 on M2.k = N.k and M2.label = N.label)"


@query("gcmi_mixture_cd", f"with {E}, {_EV}, {_ROBUST}, {_mixture('z', 'Z')} select k, {r('mi')} as mi from R")
def gcmi_mixture_cd(t: Tables) -> DataFrame:
    rows = nf.robust_copula(_e(t).drop("z"), ["k"], "v", "label", "z")
    return nf.mi_mixture_gd(rows, ["k"], "z", "label").select("k", r6("mi").alias("mi"))


def _covariances(a: str, b: str, c: str, source: str) -> str:
    names = {"a": a, "b": b, "c": c}
    return f"K as (select k, count(*) as n, " + ", ".join(f"covar_samp({names[i]}, {names[j]}) as {i}{j}" for i, j in ("aa", "ab", "ac", "bb", "bc", "cc")) + f" from {source} group by k)"


@query("cmi_gauss", f"with {L}, {_LK}, {_covariances('x', 'y1', 'y2', 'L0')} select k, {r(nf.cmi_sql())} as cmi from K")
def cmi_gauss(t: Tables) -> DataFrame:
    return nf.cmi_gauss(_l(t), ["k"], "x", "y1", "y2").select("k", r6("cmi").alias("cmi"))


@query("gccmi_ccc", f"with {L}, {_LK}, {_normals('L0', {'cx': 'x', 'cy': 'y1', 'cz': 'y2'})}, {_covariances('cx', 'cy', 'cz', 'N')} select k, {r(nf.cmi_sql())} as cmi from K")
def gccmi_ccc(t: Tables) -> DataFrame:
    return nf.gccmi_ccc(_l(t), ["k"], "x", "y1", "y2").select("k", r6("cmi").alias("cmi"))


@query("gccmi_ccd", f"with {E}, {_EV}, {_normals('E0', {'cx': 'v', 'cy': 'w'}, 'k, label')}, A as ({_mi('cx', 'cy', 'N', 'k, label')}), G as (select k, sum(n * mi) / sum(n) as cmi from A where n >= 4 and mi is not null group by k), B as ({_mi('cx', 'cy', 'N', 'k')}) select G.k, {r('cmi')} as cmi, {r('mi')} as mi from G join B on B.k = G.k")
def gccmi_ccd(t: Tables) -> DataFrame:
    return nf.gccmi_ccd(_e(t), ["k"], "v", "w", "label").select("k", r6("cmi").alias("cmi"), r6("mi").alias("mi"))


def _det(columns: list[str]) -> str:
    """The determinant of the sample covariance of one to three columns."""
    c = lambda i, j: f"covar_samp({columns[i]}, {columns[j]})"
    if len(columns) == 1:
        return c(0, 0)
    if len(columns) == 2:
        return f"({c(0, 0)} * {c(1, 1)} - {c(0, 1)} * {c(0, 1)})"
    return f"({c(0, 0)} * ({c(1, 1)} * {c(2, 2)} - {c(1, 2)} * {c(1, 2)}) - {c(0, 1)} * ({c(0, 1)} * {c(2, 2)} - {c(1, 2)} * {c(0, 2)}) + {c(0, 2)} * ({c(0, 1)} * {c(1, 2)} - {c(1, 1)} * {c(0, 2)}))"


def _wide(source: str, signs: list[tuple[int, list[str]]], keys: str = "k") -> str:
    """A signed sum of entropies of blocks of columns, by key."""
    dets = ", ".join(f"{_det(own)} as d{i}" for i, (_, own) in enumerate(signs))
    total = " ".join(f"{'+' if sign > 0 else '-'} {nf.gauss_entropy_sql('n', f'd{i}', len(own))}" for i, (sign, own) in enumerate(signs))
    return f"select {keys}, n, {total} as v from (select {keys}, count(*) as n, {dets} from {source} group by {keys})"


@query("mi_gauss_wide", f"with {L}, {_LK}, A as ({_wide('L0', [(1, ['x', 'y2']), (1, ['y1']), (-1, ['x', 'y2', 'y1'])])}) select k, n, {r('v')} as mi from A")
def mi_gauss_wide(t: Tables) -> DataFrame:
    return nf.mi_gauss(_l(t), ["k"], ["x", "y2"], "y1").select("k", "n", r6("mi").alias("mi"))


@query("gcmi_cc_wide", f"with {L}, {_LK}, {_normals('L0', {'cx': 'x', 'cz': 'y2', 'cy': 'y1'})}, A as ({_wide('N', [(1, ['cx', 'cz']), (1, ['cy']), (-1, ['cx', 'cz', 'cy'])])}) select k, n, {r('v')} as mi from A")
def gcmi_cc_wide(t: Tables) -> DataFrame:
    return nf.gcmi_cc(_l(t), ["k"], ["x", "y2"], "y1").select("k", "n", r6("mi").alias("mi"))


_LC = "L1 as (select L0.*, cast(t % 3 as bigint) as label from L0)"


def _lc(t: Tables) -> DataFrame:
    return _l(t).withColumn("label", F.col("t") % 3)


def _model_wide(source: str, columns: list[str]) -> str:
    return f"A as ({_wide(source, [(1, columns)])}), B as ({_wide(source, [(1, columns)], 'k, label')}), G as (select k, sum(n * v) / sum(n) as h from B where n >= 4 group by k)"


@query("mi_model_gd_wide", f"with {L}, {_LK}, {_LC}, {_model_wide('L1', ['x', 'y1'])} select A.k, {r('A.v - G.h')} as mi from A join G on G.k = A.k")
def mi_model_gd_wide(t: Tables) -> DataFrame:
    return nf.mi_model_gd(_lc(t), ["k"], ["x", "y1"], "label").select("k", r6("mi").alias("mi"))


@query("gcmi_model_cd_wide", f"with {L}, {_LK}, {_LC}, {_normals('L1', {'cx': 'x', 'cy': 'y1'})}, {_model_wide('N', ['cx', 'cy'])} select A.k, {r('A.v - G.h')} as mi from A join G on G.k = A.k")
def gcmi_model_cd_wide(t: Tables) -> DataFrame:
    rows = nf.copula_normal(nf.copula_normal(_lc(t), ["k"], "x", "cx"), ["k"], "y1", "cy")
    return nf.mi_model_gd(rows, ["k"], ["cx", "cy"], "label").select("k", r6("mi").alias("mi"))


def _mixture_wide(source: str, x: str, y: str) -> str:
    """Two columns: points at the rows of the Cholesky factor ((p, 0), (q, s)) by the root of 2."""
    return f"""B as (select *, sqrt(a) as p, c / sqrt(a) as q, sqrt(b - c * c / a) as s, n / sum(n) over (partition by k) as w from (select k, label, count(*) as n, avg({x}) as m1, avg({y}) as m2, var_samp({x}) as a, var_samp({y}) as b, covar_samp({x}, {y}) as c from {source} group by k, label) where n >= 4),
Q as (select k, label as own, w as ow, unnest([m1 + sqrt(2e0) * p, m1 - sqrt(2e0) * p, m1 + sqrt(2e0) * q, m1 - sqrt(2e0) * q]) as u, unnest([m2, m2, m2 + sqrt(2e0) * s, m2 - sqrt(2e0) * s]) as v from B),
D as (select Q.k, own, ow, u, v, sum(w * exp(-0.5e0 * (((u - m1) / p) ** 2 + (((v - m2) - q * (u - m1) / p) / s) ** 2)) / (2 * pi() * p * s)) as f from Q join B on B.k = Q.k group by all),
H as (select k, -sum(ow * ln(f)) / 4 / ln(2e0) as h from D group by k), G as (select k, sum(w * (ln(p * s) + ln(2 * pi()) + 1)) / ln(2e0) as e from B group by k), R as (select H.k, h - e as mi from H join G on G.k = H.k)"""


@query("mi_mixture_gd_wide", f"with {L}, {_LK}, {_LC}, {_mixture_wide('L1', 'x', 'y1')} select k, {r('mi')} as mi from R")
def mi_mixture_gd_wide(t: Tables) -> DataFrame:
    return nf.mi_mixture_gd(_lc(t), ["k"], ["x", "y1"], "label").select("k", r6("mi").alias("mi"))


@query("cmi_gauss_wide", f"with {L}, {_LK}, A as ({_wide('L0', [(1, ['x', 'y2']), (1, ['y1', 'y2']), (-1, ['x', 'y1', 'y2']), (-1, ['y2'])])}) select k, {r('v')} as cmi from A")
def cmi_gauss_wide(t: Tables) -> DataFrame:
    """By the joint log-determinants; of more columns the same, compared with numpy in a test."""
    logs = nf.log_determinants(_l(t), ["k"], {"xz": ["x", "y2"], "yz": ["y1", "y2"], "xyz": ["x", "y1", "y2"], "z": ["y2"]})
    h = lambda b, k: nf.gauss_entropy_sql("n", b, k, logarithm=True)
    return logs.select("k", r6(F.expr(f"{h('xz', 2)} + {h('yz', 2)} - {h('xyz', 3)} - {h('z', 1)}")).alias("cmi"))


@query("gccmi_ccd_wide", f"with {L}, {_LK}, {_LC}, {_normals('L1', {'cx': 'x', 'cz': 'y2', 'cy': 'y1'}, 'k, label')}, A as ({_wide('N', [(1, ['cx', 'cz']), (1, ['cy']), (-1, ['cx', 'cz', 'cy'])], 'k, label')}), G as (select k, sum(n * v) / sum(n) as cmi from A where n >= 4 group by k), B as ({_wide('N', [(1, ['cx', 'cz']), (1, ['cy']), (-1, ['cx', 'cz', 'cy'])])}) select G.k, {r('cmi')} as cmi, {r('v')} as mi from G join B on B.k = G.k")
def gccmi_ccd_wide(t: Tables) -> DataFrame:
    return nf.gccmi_ccd(_lc(t), ["k"], ["x", "y2"], "y1", "label").select("k", r6("cmi").alias("cmi"), r6("mi").alias("mi"))
