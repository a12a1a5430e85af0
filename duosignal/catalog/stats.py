"""Queries over statistical tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duosignal.catalog.models import ALPHA, CHANNELS, ITERATIONS, decoded, decoder_null, named, null_arrays, null_sql, paired, wide
from duosignal.catalog.registry import E, M, P, Tables, query, r
from duosignal.catalog.scores import condition_differences, weights
from duosignal.functions.numeric import r6
from duosignal.operators import stats as st
from duosignal.operators.nulls import permutation_null

#: p-values of the true fit against the shuffled ones.
_PV = f"{null_sql()}, PV as (select S.k, S.channel, S.fold, (sum(case when N.r > S.r then 1 else 0 end) + 1) / (count(*) + 1e0) as p, (sum(case when N.rmse < S.rmse then 1 else 0 end) + 1) / (count(*) + 1e0) as q from S join N on N.k = S.k and N.channel = S.channel and N.fold = S.fold group by all)"
_DV = f"{null_sql(decoder=True)}, PV as (select S.k, S.fold, (sum(case when N.r > S.r then 1 else 0 end) + 1) / (count(*) + 1e0) as p from S join N on N.k = S.k and N.fold = S.fold group by all)"


def _p(t: Tables) -> DataFrame:
    return st.permutation_p(wide(t), null_arrays(t), ["k", "channel", "fold"], "r")


@query("permutation_pvalue", f"with recursive {_PV} select k, channel, fold, {r('p')} as p, {r('q')} as p_rmse from PV")
def permutation_pvalue(t: Tables) -> DataFrame:
    both = st.permutation_p(wide(t), null_arrays(t), ["k", "channel", "fold"], "r", "rmse")
    return both.select("k", "channel", "fold", r6("p").alias("p"), r6("p_less").alias("p_rmse"))


@query("significant_channels", f"with recursive {_PV}, A as (select k, channel, bool_and(p < 0.05 / 3) as passed, avg(p) as p from PV group by k, channel) select channel, sum(case when passed then 1 else 0 end)::bigint as subjects, {r('avg(p)')} as p from A group by channel")
def significant_channels(t: Tables) -> DataFrame:
    """Channels below 0.05 over the number of channels in every fold."""
    each = st.passes_all_folds(_p(t), ["k", "channel"], 0.05 / len(CHANNELS))
    return each.groupBy("channel").agg(F.count_if("passed").alias("subjects"), r6(F.avg("p")).alias("p"))


@query("decoder_significance", f"with recursive {_DV}, A as (select k, count(*) filter (p < 0.01) as n, bool_and(p < 0.01) as whole, avg(p) as p from PV group by k) select k % 4 as band, sum(n)::bigint as folds, (count(*) filter (whole))::bigint as subjects, {r('avg(p)')} as p from A group by all")
def decoder_significance(t: Tables) -> DataFrame:
    """Folds below 0.01, and subjects with all of them, by band."""
    p = st.permutation_p(decoded(t, ["y1", "y2"], [0]), decoder_null(t), ["k", "fold"], "r")
    each = p.groupBy("k").agg(F.count_if(F.col("p") < 0.01).alias("n"), F.bool_and(F.col("p") < 0.01).alias("whole"), F.avg("p").alias("p"))
    return each.groupBy((F.col("k") % 4).alias("band")).agg(F.sum("n").alias("folds"), F.count_if("whole").alias("subjects"), r6(F.avg("p")).alias("p"))


@query("downsize_null", f"with recursive {null_sql()} select k, channel, iter, {r('avg(r)')} as r from N where iter < 50 group by all")
def downsize_null(t: Tables) -> DataFrame:
    """The first half of the iterations, as means over folds."""
    null = permutation_null(paired(t), ["k"], "xs", "ys", ALPHA, ITERATIONS // 2, mean=True)
    return named(null, CHANNELS).select("k", "channel", "iter", r6("r").alias("r"))


@query("ttest_1samp", f"with {M} select ch // 8 as channel, ch % 8 as lag, {r('avg(v) / (stddev_samp(v) / sqrt(count(*)))')} as t from M group by ch")
def ttest_1samp(t: Tables) -> DataFrame:
    return weights(t).groupBy("channel", "lag").agg(r6(st.t_one_sample(F.count("*"), F.avg("v"), F.stddev_samp("v"))).alias("t"))


_PERMS = 1024
_FLIP = f"G as (select vec_id, perm, {st.sign_sql('vec_id', 'perm')} as s from (select distinct vec_id from M), (select unnest(range({_PERMS})) as perm)), T as (select perm, ch // 8 as channel, ch % 8 as lag, avg(v * s) / (stddev_samp(v * s) / sqrt(count(*))) as t from M join G on G.vec_id = M.vec_id group by perm, ch)"


def flipped(t: Tables) -> DataFrame:
    return st.sign_flip_t(weights(t), "vec_id", ["channel", "lag"], "v", _PERMS)


@query("signflip_null", f"with {M}, {_FLIP} select perm, {r('max(abs(t))')} as top, {r('avg(t)')} as mean from T group by perm")
def signflip_null(t: Tables) -> DataFrame:
    return flipped(t).groupBy("perm").agg(r6(F.max(F.abs("t"))).alias("top"), r6(F.avg("t")).alias("mean"))


@query("tfce")
def tfce(t: Tables) -> DataFrame:
    true = weights(t).groupBy("channel", "lag").agg(st.t_one_sample(F.count("*"), F.avg("v"), F.stddev_samp("v")).alias("t")).withColumn("perm", F.lit(-1).cast("long"))
    scores = st.tfce(flipped(t).unionByName(true), "channel", "lag")
    own = scores.where("perm = -1").select("channel", "lag", "t", "score")
    return own.join(st.max_p(scores.where("perm >= 0"), own, ["channel", "lag"], "score"), ["channel", "lag"])


@query("pmap_threshold", f"with {M}, V as (select ch, 1 / (1 + abs(avg(v)) * 300e0) as p from M group by ch) select ch, {r('-log10(greatest(case when p > 0.05 then 1 else p end, 1e-5))')} as z from V")
def pmap_threshold(t: Tables) -> DataFrame:
    return t.m.groupBy("ch").agg((1 / (1 + F.abs(F.avg("v")) * 300)).alias("p")).select("ch", r6(st.threshold_map("p")).alias("z"))


_DIFF = f"{P}, C as (select unnest(['A', 'A', 'N']) as a, unnest(['N', 'R', 'R']) as b), D as (select C.a, C.b, x.subject, x.channel, x.v - y.v as d from C join P x on x.condition = C.a join P y on y.condition = C.b and y.subject = x.subject and y.channel = x.channel), K as (select a, b, channel, d, rank() over (partition by a, b, channel order by abs(d)) + (count(*) over (partition by a, b, channel, abs(d)) - 1) / 2e0 as k from D where d <> 0)"


@query("wilcoxon", f"with {_DIFF}, S as (select a, b, channel, count(*) as n, sum(case when d > 0 then k else 0 end) as p, sum(case when d < 0 then k else 0 end) as q from K group by all) select a, b, channel, n, {r('least(p, q)')} as w, {r('p')} as plus from S")
def wilcoxon(t: Tables) -> DataFrame:
    ranks = st.signed_ranks(condition_differences(t), ["a", "b", "channel"])
    return ranks.select("a", "b", "channel", "n", r6("w").alias("w"), r6("plus").alias("plus"))


@query("wilcoxon_p")
def wilcoxon_p(t: Tables) -> DataFrame:
    return st.with_wilcoxon_p(st.signed_ranks(condition_differences(t), ["a", "b", "channel"])).select("a", "b", "channel", "n", "w", r6("p").alias("p"))


@query("lateralisation_test", f"with {P}, H as (select case when channel <= 3 then 'l' else 'r' end as side, subject, avg(v) as v from P where channel <> 4 group by all), O as (select side, v, row_number() over (partition by side order by v desc, subject) as i from H), D as (select x.v - y.v as d from O x join O y on x.i = y.i where x.side = 'l' and y.side = 'r' and x.i <= 12), K as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2e0 as k from D where d <> 0) select count(*) as n, {r('least(sum(case when d > 0 then k else 0 end), sum(case when d < 0 then k else 0 end))')} as w from K")
def lateralisation_test(t: Tables) -> DataFrame:
    mean = t.p.where("channel <> 4").groupBy(F.when(F.col("channel") <= 3, "l").otherwise("r").alias("side"), "subject").agg(F.avg("v").alias("v"))
    top = mean.withColumn("i", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("v"), "subject"))).where("i <= 12")
    left, right = (top.where(F.col("side") == s).select("i", F.col("v").alias(s)) for s in "lr")
    pairs = left.join(right, "i").select(F.lit(1).alias("one"), (F.col("l") - F.col("r")).alias("d"))
    return st.signed_ranks(pairs, ["one"]).select("n", r6("w").alias("w"))


_PS = "V as (select label as g, event_id, (event_id * 7919 % 10007 + 1) / 20014e0 as p from E)"


def _ps(t: Tables) -> DataFrame:
    return t.e.select(F.col("label").alias("g"), "event_id", ((F.col("event_id") * 7919 % 10007 + 1) / 20014).alias("p"))


@query("fdr_bh", f"with {E}, {_PS}, Q as (select *, row_number() over (partition by g order by p) as i, p * count(*) over (partition by g) / row_number() over (partition by g order by p) as q from V), C as (select g, event_id, least(1, min(q) over (partition by g order by i desc rows between unbounded preceding and current row)) as c from Q) select g, event_id, {r('c')} as corrected, c < 0.05 as passed from C")
def fdr_bh(t: Tables) -> DataFrame:
    return st.fdr(_ps(t), ["g"], "p").select("g", "event_id", r6("corrected").alias("corrected"), "passed")


@query("bonferroni_log", f"with {E}, {_PS} select event_id, p < 0.05 / 128 as passed, {r('case when p < 0.05 / 128 then log10(p) else 0 end')} as log_p from V")
def bonferroni_log(t: Tables) -> DataFrame:
    return st.bonferroni_log(_ps(t), "p", 128).select("event_id", "passed", r6("log_p").alias("log_p"))


_N, _M = "count(v) filter (g = 'A')", "count(v) filter (g = 'N')"
_POOL = f"(({_N} - 1) * var_samp(v) filter (g = 'A') + ({_M} - 1) * var_samp(v) filter (g = 'N')) / ({_N} + {_M} - 2e0)"
_GAP = "avg(v) filter (g = 'A') - avg(v) filter (g = 'N')"


@query("cohen_d", f"with {P}, X as (select channel, condition as g, v from P where condition in ('A', 'N')) select channel, {r(f'abs({_GAP}) / sqrt({_POOL})')} as d from X group by channel")
def cohen_d(t: Tables) -> DataFrame:
    return st.cohen_d(t.p, ["channel"], "condition", "A", "N", "v").select("channel", r6("d").alias("d"))


@query("ttest_ind", f"with {P}, X as (select channel, condition as g, v from P where condition in ('A', 'N')) select channel, {r(f'({_GAP}) / sqrt({_POOL} * (1e0 / {_N} + 1e0 / {_M}))')} as t from X group by channel")
def ttest_ind(t: Tables) -> DataFrame:
    return st.t_independent(t.p, ["channel"], "condition", "A", "N", "v").select("channel", r6("t").alias("t"))
