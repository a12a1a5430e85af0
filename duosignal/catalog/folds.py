"""Queries over splits and scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.catalog.registry import E, L, Tables, query, r
from duosignal.functions.numeric import r6
from duosignal.operators import folds as f

KFOLD = "F as (select *, ntile(5) over (partition by k order by t) - 1 as fold from L)"


def _train():
    return F.col("fold") != 0


@query("kfold_contiguous", f"with {E} select k, t, ntile(5) over (partition by k order by t) - 1 as fold from E")
def kfold_contiguous(t: Tables) -> DataFrame:
    return f.contiguous_folds(t.e, ["k"], 5).select("k", "t", "fold")


@query("kfold_inverted", f"with {E}, F as (select k, t, ntile(25) over (partition by k order by t) - 1 as fold from E) select k, split, case when fold = split then 'train' else 'test' end as role, count(*) as n from F, (select unnest(range(25)) as split) group by all")
def kfold_inverted(t: Tables) -> DataFrame:
    return f.train_test(f.contiguous_folds(t.e.select("k", "t"), ["k"], 25), 25, inverted=True).groupBy("k", "split", "role").agg(F.count("*").alias("n"))


@query("holdout_tail", f"with {E} select k, t, case when row_number() over (partition by k order by t) <= floor(0.8e0 * count(*) over (partition by k)) then 'train' else 'validation' end as part from E")
def holdout_tail(t: Tables) -> DataFrame:
    return f.holdout_tail(t.e, ["k"], 0.8).select("k", "t", "part")


def _standard(c: str) -> str:
    return f"case when s_{c} > 0 then ({c} - m_{c}) / s_{c} else 0.0 end"


def _range(c: str) -> str:
    return f"case when h_{c} = l_{c} then 0.0 else ({c} - l_{c}) / (h_{c} - l_{c}) end"


_FIT = "S as (select k, " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}, min({c}) as l_{c}, max({c}) as h_{c}" for c in ("x", "y1", "y2")) + " from F where fold <> 0 group by k)"


@query("standardise", f"with {L}, {KFOLD}, {_FIT} select cast(F.k as bigint) as k, t, {r(_standard('y1'))} as y1, {r(_standard('y2'))} as y2 from F join S on F.k = S.k")
def standardise(t: Tables) -> DataFrame:
    rows = f.standardise(f.contiguous_folds(t.l, ["k"], 5).select("k", "t", "fold", "y1", "y2"), ["k"], ["y1", "y2"], _train())
    return rows.select("k", "t", r6("y1").alias("y1"), r6("y2").alias("y2"))


@query("minmax_fit", f"with {L}, {KFOLD}, {_FIT} select cast(F.k as bigint) as k, t, {r(_range('x'))} as x, {r(_range('y1'))} as y1 from F join S on F.k = S.k")
def minmax_fit(t: Tables) -> DataFrame:
    rows = f.min_max(f.contiguous_folds(t.l, ["k"], 5).select("k", "t", "fold", "x", "y1"), ["k"], ["x", "y1"], _train())
    return rows.select("k", "t", r6("x").alias("x"), r6("y1").alias("y1"))


@query("minmax_percentile", f"with {L}, A as (select k, t, y1, (count(*) over (partition by k) * 5 - 1) // 100 as n, row_number() over (partition by k order by y1) - 1 as u, row_number() over (partition by k order by y1 desc) - 1 as d from L), B as (select k, t, y1, max(case when u = n then y1 end) over (partition by k) as lo, max(case when d = n then y1 end) over (partition by k) as hi from A) select cast(k as bigint) as k, t, {r('case when hi = lo then 0.0 else (y1 - lo) / (hi - lo) end')} as y1 from B")
def minmax_percentile(t: Tables) -> DataFrame:
    return f.min_max_percentile(t.l.select("k", "t", "y1"), ["k"], "y1").select("k", "t", r6("y1").alias("y1"))


_LOW, _HIGH = "min(v) over (partition by k)", "max(v) over (partition by k)"


@query("scale_01", f"with {E} select k, t, {r(f'case when {_HIGH} = {_LOW} then 0 else (v - {_LOW}) / ({_HIGH} - {_LOW}) end')} as v from E")
def scale_01(t: Tables) -> DataFrame:
    return f.scale(t.e, ["k"], "v", 0.0, 1.0, "u").select("k", "t", r6("u").alias("v"))


@query("scale_11", f"with {E} select k, t, {r(f'case when {_HIGH} = {_LOW} then -1 else -1 + (v - {_LOW}) * 2 / ({_HIGH} - {_LOW}) end')} as v from E")
def scale_11(t: Tables) -> DataFrame:
    return f.scale(t.e, ["k"], "v", -1.0, 1.0, "u").select("k", "t", r6("u").alias("v"))


@query("preprocess_dispatch", f"with {L}, {KFOLD}, {_FIT} select cast(F.k as bigint) as k, t, {r(_range('x'))} as x0, {r(_range('y2'))} as x1, {r(_standard('y1'))} as y1 from F join S on F.k = S.k")
def preprocess_dispatch(t: Tables) -> DataFrame:
    rows = f.preprocess(f.contiguous_folds(t.l, ["k"], 5).select("k", "t", "fold", "x", "y1", "y2"), ["k"], ["x", "y2"], ["y1"], _train())
    return rows.select("k", "t", r6(F.get("x", F.lit(0))).alias("x0"), r6(F.get("x", F.lit(1))).alias("x1"), r6("y1").alias("y1"))


@query("preprocess_percentile", f"with {L}, {KFOLD}, {_FIT}, A as (select k, y1, (count(*) over (partition by k) * 5 - 1) // 100 as n, row_number() over (partition by k order by y1) - 1 as u, row_number() over (partition by k order by y1 desc) - 1 as d from F where fold <> 0), B as (select k, max(case when u = n then y1 end) as lo, max(case when d = n then y1 end) as hi from A group by k) select cast(F.k as bigint) as k, t, {r(_range('x'))} as x0, {r('case when hi = lo then 0.0 else (y1 - lo) / (hi - lo) end')} as y1 from F join S on F.k = S.k join B on B.k = F.k")
def preprocess_percentile(t: Tables) -> DataFrame:
    """Responses by the range between the training rows' percentiles."""
    rows = f.preprocess(f.contiguous_folds(t.l, ["k"], 5).select("k", "t", "fold", "x", "y1"), ["k"], ["x"], ["y1"], _train(), response_by="Normalize")
    return rows.select("k", "t", r6(F.get("x", F.lit(0))).alias("x0"), r6("y1").alias("y1"))
