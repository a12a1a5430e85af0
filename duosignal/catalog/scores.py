"""Queries over aggregations of scores and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.catalog.models import MODEL, encoded, folded
from duosignal.catalog.registry import E, M, P, Tables, query, r
from duosignal.functions.numeric import r6
from duosignal.operators.order import quantiles
from duosignal.operators import ridge
from duosignal.operators import scores as sc
from duosignal.operators.spectral import cross_means

_PAIRS = [("A", "N"), ("A", "R"), ("N", "R")]


_CROSS = f"with {M} select a.label, a.ch as a, b.ch as b, {r('avg(a.v * b.v)')} as v from M a join M b on a.vec_id = b.vec_id group by all"


@query("channel_cross_whole", _CROSS)
@query("channel_cross", _CROSS)
def channel_cross(t: Tables) -> DataFrame:
    rows = t["embeddings"].select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return cross_means(rows, ["label"], "v").select("label", "a", "b", r6("v").alias("v"))


@query("condition_pairs", f"with {P}, C as (select unnest(['A', 'A', 'N']) as a, unnest(['N', 'R', 'R']) as b) select C.a, C.b, x.subject, x.channel, {r('x.v - y.v')} as d from C join P x on x.condition = C.a join P y on y.condition = C.b and y.subject = x.subject and y.channel = x.channel")
def condition_pairs(t: Tables) -> DataFrame:
    return condition_differences(t).select("a", "b", "subject", "channel", r6("d").alias("d"))


def condition_differences(t: Tables) -> DataFrame:
    pairs = sc.self_pairs(t.p, "condition", ["subject", "channel"], "v", distinct=True)
    wanted = " or ".join(f"(a = '{a}' and b = '{b}')" for a, b in _PAIRS)
    return pairs.where(wanted).withColumn("d", F.col("va") - F.col("vb"))


@query("subject_mean", f"with {P}, A as (select condition, channel, subject, avg(v) as v from P group by all) select condition, channel, {r('avg(v)')} as mean, {r('stddev_pop(v)')} as sd from A group by all")
def subject_mean(t: Tables) -> DataFrame:
    return sc.nested_mean(t.p, ["condition", "channel"], ["subject"], "v").select("condition", "channel", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("subject_score_summary", f"with {MODEL} select k, {r('avg(r)')} as mean, {r('stddev_pop(r)')} as sd from S group by k")
def subject_score_summary(t: Tables) -> DataFrame:
    return encoded(t).groupBy("k").agg(r6(F.avg("r")).alias("mean"), r6(F.stddev_pop("r")).alias("sd"))


_TRF = "T as (select vec_id, cast(label as bigint) as label, ch // 8 as channel, ch % 8 as lag, v from M)"


def weights(t: Tables) -> DataFrame:
    return t.m.select("vec_id", "label", F.floor(F.col("ch") / 8).alias("channel"), (F.col("ch") % 8).alias("lag"), "v")


@query("weights_by_channel", f"with {M}, {_TRF} select channel, lag, {r('avg(v)')} as v from T group by all")
def weights_by_channel(t: Tables) -> DataFrame:
    return weights(t).groupBy("channel", "lag").agg(r6(F.avg("v")).alias("v"))


@query("weights_by_band", f"with {M}, {_TRF} select label as band, lag, {r('avg(v)')} as v from T group by all")
def weights_by_band(t: Tables) -> DataFrame:
    return weights(t).groupBy(F.col("label").alias("band"), "lag").agg(r6(F.avg("v")).alias("v"))


@query("best_channel", f"with {P} select condition, subject, {r('max(v)')} as top, arg_max(channel, v) as channel from P group by all")
def best_channel(t: Tables) -> DataFrame:
    return t.p.groupBy("condition", "subject").agg(r6(F.max("v")).alias("top"), F.max_by("channel", "v").alias("channel"))


_SIDE = "case when channel <= 3 then 'left' when channel >= 5 then 'right' end"


@query("topk_per_group", f"with {P}, A as (select {_SIDE} as side, subject, avg(v) as v from P where channel <> 4 group by all), B as (select *, row_number() over (partition by side order by v desc, subject) as rank from A) select side, subject, rank, {r('v')} as v from B where rank <= 12")
def topk_per_group(t: Tables) -> DataFrame:
    means = t.p.where("channel <> 4").groupBy(F.expr(_SIDE).alias("side"), "subject").agg(F.avg("v").alias("v"))
    return sc.top_k(means, ["side"], "v", 12, "subject").select("side", "subject", "rank", r6("v").alias("v"))


@query("fold_envelope", f"with {MODEL} select k, channel, {r('min(r)')} as low, {r('max(r)')} as high from S group by all")
def fold_envelope(t: Tables) -> DataFrame:
    return encoded(t).groupBy("k", "channel").agg(r6(F.min("r")).alias("low"), r6(F.max("r")).alias("high"))


@query("best_lag_profile", f"with {M}, {_TRF}, A as (select label, lag, avg(v) as v from T group by all), B as (select label, arg_max(lag, v) as lag from A group by label) select T.label, T.lag, T.channel, {r('avg(T.v)')} as v, {r('stddev_pop(T.v)')} as sd from T join B on B.label = T.label and B.lag = T.lag group by all")
def best_lag_profile(t: Tables) -> DataFrame:
    best = weights(t).groupBy("label", "lag").agg(F.avg("v").alias("v")).groupBy("label").agg(F.max_by("lag", "v").alias("lag"))
    return weights(t).join(best, ["label", "lag"]).groupBy("label", "lag", "channel").agg(r6(F.avg("v")).alias("v"), r6(F.stddev_pop("v")).alias("sd"))


@query("score_matrix", f"with {MODEL}, A as (select channel, fold, avg(r) as r, sum(case when r > 0 then 1 else 0 end) as n from S group by all) select channel, " + ", ".join(f"{r(f'max(r) filter (fold = {i})')} as r_{i}, cast(max(n) filter (fold = {i}) as bigint) as passed_{i}" for i in range(5)) + " from A group by channel")
def score_matrix(t: Tables) -> DataFrame:
    wide = encoded(t).groupBy("channel").pivot("fold", list(range(5))).agg(F.avg("r").alias("r"), F.count_if(F.col("r") > 0).alias("n"))
    return wide.select("channel", *[x for i in range(5) for x in (r6(F.col(f"{i}_r")).alias(f"r_{i}"), F.col(f"{i}_n").alias(f"passed_{i}"))])


@query("score_distribution", f"with {P} select condition, " + ", ".join(f"{r(f'quantile_cont(v, {q})', 3)} as q{int(q * 100)}" for q in (0, 0.25, 0.5, 0.75, 1)) + " from P group by condition")
def score_distribution(t: Tables) -> DataFrame:
    found = quantiles(t.p, ["condition"], "v", {f"q{int(q * 100)}": q for q in (0.0, 0.25, 0.5, 0.75, 1.0)}, "subject")
    return found.select("condition", *[F.round(c, 3).alias(c) for c in found.columns[1:]])


@query("subject_feature_stats", f"with {E} select k, {r('avg(v)')} as mean, {r('stddev_pop(v)')} as sd from E where v is not null group by k")
def subject_feature_stats(t: Tables) -> DataFrame:
    return t.e.groupBy("k").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("sd"))


@query("sample_counts", f"with {E} select k, count(*) as n from E where state <> 0 group by k")
def sample_counts(t: Tables) -> DataFrame:
    return t.e.where("state <> 0").groupBy("k").agg(F.count("*").alias("n"))


_SUBJECT = "U as (select label as subject, channel, lag, avg(v) as v from T group by all)"
_ALL = "A as (select subject, channel, lag, v from U union all select -1, channel, lag, avg(v) from U group by channel, lag)"
_SIM = "R as (select x.channel, x.subject as a, y.subject as b, corr(x.v, y.v) as r, count(*) as n from A x join A y on x.channel = y.channel and x.lag = y.lag group by all)"


def subject_weights(t: Tables, with_mean: bool) -> DataFrame:
    own = weights(t).groupBy(F.col("label").alias("subject"), "channel", "lag").agg(F.avg("v").alias("v"))
    return own.unionByName(own.groupBy("channel", "lag").agg(F.avg("v").alias("v")).withColumn("subject", F.lit(-1).cast("long"))) if with_mean else own


@query("weights_similarity", f"with {M}, {_TRF}, {_SUBJECT}, {_ALL}, {_SIM}, D as (select a as s, avg(r) as rm from R where b = -1 and a >= 0 group by a) select a, b, {r('case when a = b then max(rm) else avg(r) end')} as r, {r('stddev_pop(r)')} as sd from R left join D on D.s = R.a where a >= 0 and b >= 0 group by a, b")
def weights_similarity(t: Tables) -> DataFrame:
    each = sc.similarity(subject_weights(t, True), "subject", ["channel"], ["lag"], "v")
    mean = each.where("b = -1 and a >= 0").groupBy("a").agg(F.avg("r").alias("rm"))
    pairs = each.where("a >= 0 and b >= 0").groupBy("a", "b").agg(F.avg("r").alias("r"), F.stddev_pop("r").alias("sd")).join(mean, "a")
    return pairs.select("a", "b", r6(F.when(F.col("a") == F.col("b"), F.col("rm")).otherwise(F.col("r"))).alias("r"), r6("sd").alias("sd"))


@query("channel_similarity", f"with {M}, {_TRF}, {_SUBJECT}, R as (select x.channel, x.subject as a, y.subject as b, corr(x.v, y.v) as r from U x join U y on x.channel = y.channel and x.lag = y.lag and x.subject < y.subject group by all) select channel, {r('avg(abs(r))')} as r from R group by channel")
def channel_similarity(t: Tables) -> DataFrame:
    return sc.similarity(subject_weights(t, False), "subject", ["channel"], ["lag"], "v", distinct=True).groupBy("channel").agg(r6(F.avg(F.abs("r"))).alias("r"))


@query("similarity_pvalue")
def similarity_pvalue(t: Tables) -> DataFrame:
    each = sc.similarity(subject_weights(t, False), "subject", ["channel"], ["lag"], "v", distinct=True)
    return sc.with_correlation_p(each).select("channel", "a", "b", r6("r").alias("r"), r6("t").alias("t"), r6("p").alias("p"))


@query("similarity_t", f"with {M}, {_TRF}, {_SUBJECT}, R as (select x.channel, x.subject as a, y.subject as b, corr(x.v, y.v) as r, count(*) as n from U x join U y on x.channel = y.channel and x.lag = y.lag and x.subject < y.subject group by all) select channel, a, b, {r('case when n > 2 and abs(r) < 1 then r * sqrt((n - 2) / (1 - r * r)) end')} as t from R")
def similarity_t(t: Tables) -> DataFrame:
    each = sc.similarity(subject_weights(t, False), "subject", ["channel"], ["lag"], "v", distinct=True)
    return sc.with_correlation_p(each).select("channel", "a", "b", r6("t").alias("t"))


_R2 = "V as (select condition as band, avg(v / 1e5) as r1, avg(v / 1e5) * 0.8e0 + 0.01e0 as r2, avg(v / 1e5) * 1.1e0 as r3 from P group by condition)"


def _squares(t: Tables) -> DataFrame:
    mean = F.avg(F.col("v") / 1e5)
    return t.p.groupBy(F.col("condition").alias("band")).agg(mean.alias("r1"), (mean * 0.8 + 0.01).alias("r2"), (mean * 1.1).alias("r3"))


@query("variance_partition_2", f"with {P}, {_R2} select band, {r('greatest(0, r3 - r2)')} as unique_1, {r('greatest(0, r3 - r1)')} as unique_2, {r('greatest(0, r1 + r2 - r3)')} as shared from V")
def variance_partition_2(t: Tables) -> DataFrame:
    parts = sc.partition_2(F.col("r3"), F.col("r1"), F.col("r2"))
    return _squares(t).select("band", *[r6(c).alias(n) for n, c in parts.items()])


_NAMES = {"1": "r1", "2": "r2", "3": "r1 * 0.5e0", "12": "r3", "13": "r1 * 1.05e0", "23": "r2 * 1.1e0", "123": "r3 * 1.2e0"}
_Q = {k: f"({v})" for k, v in _NAMES.items()}


@query("variance_partition_3", f"with {P}, {_R2} select band, " + ", ".join(f"{r(f'greatest(0, {e})')} as \"{n}\"" for n, e in {
    "unique_1": f"{_Q['123']} - {_Q['23']}", "unique_2": f"{_Q['123']} - {_Q['13']}", "unique_3": f"{_Q['123']} - {_Q['12']}",
    "only_12": f"{_Q['13']} + {_Q['23']} - {_Q['3']} - {_Q['123']}", "only_13": f"{_Q['12']} + {_Q['23']} - {_Q['2']} - {_Q['123']}", "only_23": f"{_Q['12']} + {_Q['13']} - {_Q['1']} - {_Q['123']}",
    "all": f"{_Q['123']} + {_Q['1']} + {_Q['2']} + {_Q['3']} - {_Q['12']} - {_Q['13']} - {_Q['23']}"}.items()) + " from V")
def variance_partition_3(t: Tables) -> DataFrame:
    parts = sc.partition_3({k: F.expr(v) for k, v in _NAMES.items()})
    return _squares(t).select("band", *[r6(c).alias(n) for n, c in parts.items()])


@query("convex_hull")
def convex_hull(t: Tables) -> DataFrame:
    both = encoded(t).groupBy("k", "channel").agg(F.avg("r").alias("r"), F.avg("rmse").alias("rmse"))
    return sc.convex_hull(both, "channel", "r", "rmse")


@query("trf_compare", f"with {M}, {_TRF} select lag, " + ", ".join(f"{r(f'avg(v) filter (label % 3 = {i})')} as set_{i}" for i in range(3)) + " from T group by lag")
def trf_compare(t: Tables) -> DataFrame:
    wide = weights(t).withColumn("set", F.col("label") % 3).groupBy("lag").pivot("set", [0, 1, 2]).agg(F.avg("v"))
    return wide.select("lag", *[r6(F.col(str(i))).alias(f"set_{i}") for i in range(3)])


@query("signal_vs_pred_slice", f"with {MODEL} select k, t, {r('y')} as y, {r('p')} as p from P where channel = 'y1' and t between 18 and 26")
def signal_vs_pred_slice(t: Tables) -> DataFrame:
    rows = ridge.predict(folded(t).where("t between 18 and 26"), encoded(t).where("channel = 'y1'"), ["k"], "x")
    return rows.select("k", "t", r6(F.try_divide(F.col("y1") - F.col("_mid"), F.col("_sd"))).alias("y"), r6("p").alias("p"))
