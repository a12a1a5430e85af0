"""Queries over the series and interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.catalog.registry import C, E, L, M, Tables, query, r
from duosignal.functions.numeric import r6, trunc_decimals
from duosignal.operators import intervals as iv
from duosignal.operators import series as s

LABELS = ["click", "view", "purchase"]
W = "over (partition by k order by t)"


@query("delay_set", f"with {E}, N as (select k, count(*) as n from E group by k) select k, cast(-i as bigint) as delay, (i * 1e0 / 128) as time, greatest(n - abs(i), 0) as samples from N, (select unnest(range(-77, 26)) as i)")
def delay_set(t: Tables) -> DataFrame:
    """The delays of a range of times for each series, and how many of its samples have a partner there."""
    delays = F.explode(F.array(*[F.lit(d).cast("long") for d in s.delay_set(-0.6, 0.2, 128)]))
    rows = s.lengths(t.e, ["k"]).select("k", "n", delays.alias("delay"))
    return rows.select("k", "delay", (-F.col("delay") / 128).alias("time"), F.greatest(F.col("n") - F.abs("delay"), F.lit(0)).alias("samples"))


_LAGS = [2, 1, 0, -1]


@query("lag_matrix", f"with {L} select cast(k as bigint) as k, t, " + ", ".join(f"{'lag' if d >= 0 else 'lead'}({f}, {abs(d)}, 0.0) {W} as x_{f}_{j}" for f in ("x", "y2") for j, d in enumerate(_LAGS)) + " from L")
def lag_matrix(t: Tables) -> DataFrame:
    return s.lag_matrix(t.l, ["k"], ["x", "y2"], _LAGS).select("k", "t", *[f"x_{f}_{j}" for f in ("x", "y2") for j in range(len(_LAGS))])


@query("decimate", f"with {E} select k, t // 4 as t, v from E where t % 4 = 0")
def decimate(t: Tables) -> DataFrame:
    return s.decimate(t.e, 4).select("k", "t", "v")


@query("hold_resample", f"with {E}, n as (select k, count(*) as n from E group by k), w as (select k, unnest(range(cast(ceil(n * 160 / 125) as bigint))) as i from n) select w.k, i as t, v from w join E on E.k = w.k and E.t = i * 125 // 160")
def hold_resample(t: Tables) -> DataFrame:
    return s.hold_resample(t.e.select("k", "t", "v"), ["k"], 160, 125).select("k", "t", "v")


@query("ratio_resample", f"with {E}, n as (select k, count(*) as n from E group by k), w as (select k, n, unnest(range(50)) as i from n) select w.k, i as t, v from w join E on E.k = w.k and E.t = i * n // 50")
def ratio_resample(t: Tables) -> DataFrame:
    e = t.e.select("k", "t", "v")
    return s.ratio_resample(e, ["k"], e.select("k").distinct().withColumn("m", F.lit(50))).select("k", "t", "v")


@query("align_lengths", f"with {E}, odd as (select k, t // 2 as t, v from E where t % 2 = 1), n as (select k, count(*) as n from odd group by k) select E.k, E.t, E.v, odd.v as v2 from E join n on n.k = E.k join odd on odd.k = E.k and odd.t = E.t where E.t < n.n")
def align_lengths(t: Tables) -> DataFrame:
    e = t.e.select("k", "t", "v")
    odd = e.where("t % 2 = 1").withColumn("t", F.floor(F.col("t") / 2)).withColumnRenamed("v", "v2")
    a, b = s.align_lengths([e, odd], ["k"])
    return a.join(b, ["k", "t"]).select("k", "t", "v", "v2")


_RATE = 0.5
_COUNTS = f"N as (select k, turn, speaker, cast(round_even((end_s - start_s) * {_RATE}, 0) as bigint) as n from C)"


@query("interval_expand", f"with {C}, {_COUNTS}, O as (select k, speaker, n, cast(sum(n) over (partition by k order by turn) as bigint) - n as a from N) select k, cast(speaker as bigint) as speaker, a + i as t from (select k, speaker, a, unnest(range(n)) as i from O)")
def interval_expand(t: Tables) -> DataFrame:
    return iv.interval_expand(iv.sample_counts(t.c, _RATE), ["k"], "turn").select("k", "speaker", "t")


@query("interval_reconcile", f"with {C}, {_COUNTS}, O as (select k, turn, n, 20 as target, sum(n) over (partition by k order by turn) as a, sum(n) over (partition by k) as w, lead(n) over (partition by k order by turn) is null as last from N) select k, turn, cast(greatest(0, least(n, target - (a - n))) + case when last then greatest(0, target - w) else 0 end as bigint) as n from O")
def interval_reconcile(t: Tables) -> DataFrame:
    counts = iv.sample_counts(t.c, _RATE).withColumn("target", F.lit(20))
    return iv.interval_reconcile(counts, ["k"], "turn", "target").select("k", "turn", "n")


_SPELT = "case event_id % 9 when 0 then 'sil' when 1 then 'sp' when 2 then 's¡p' when 3 then 'sils' when 4 then ' a º' when 5 then 'e-' else event_type end"


@query("label_normalise", f"select event_id, case when b in ('sil', 'sp', 'sile', 'silsil', 'SP', 's¡p', 'sils') then '' else b end as label from (select event_id, replace(replace(replace({_SPELT}, ' ', ''), 'º', ''), '-', '') as b from events)")
def label_normalise(t: Tables) -> DataFrame:
    return t["events"].withColumn("raw", F.expr(_SPELT)).select("event_id", s.normalise_label("raw").alias("label"))


def _cases(value: str) -> str:
    return ", ".join(f"case when label = '{n}' then {value} else 0.0 end as is_{n}" for n in LABELS)


@query("onehot_weighted", f"with {E} select k, t, {_cases('v')} from E")
def onehot_weighted(t: Tables) -> DataFrame:
    return t.e.withColumns(s.one_hot("label", LABELS, F.col("v"))).select("k", "t", *[f"is_{n}" for n in LABELS])


@query("onehot_binary", f"with {E} select k, t, {_cases('1.0e0')} from E")
def onehot_binary(t: Tables) -> DataFrame:
    return t.e.withColumns(s.one_hot("label", LABELS)).select("k", "t", *[f"is_{n}" for n in LABELS])


@query("onehot_onset", f"with {E}, O as (select k, t, label, case when lag(label) {W} is null or lag(label) {W} <> label then 1.0e0 else 0.0 end as o from E) select k, t, {_cases('o')} from O")
def onehot_onset(t: Tables) -> DataFrame:
    return s.one_hot_onset(t.e, ["k"], "label", LABELS).select("k", "t", *[f"is_{n}" for n in LABELS])


_SITUATIONS = [("silence", 0, [2, 1]), ("own", 1, [2, 1]), ("gap", 1, [4, 2]), ("steps", 0, [6, 3, 0, -2]), ("all", None, [2, 1])]


def _state_at(d: int) -> str:
    return f"{'lag' if d >= 0 else 'lead'}(state, {abs(d)}, 0) {W}"


@query("situation_filter", f"with {E}, O as (select k, t, " + ", ".join(" and ".join(f"{_state_at(d)} = {target}" for d in delays) + f" as {name}_" for name, target, delays in _SITUATIONS if target is not None) + ", true as all_ from E) " + " union all ".join(f"select k, t, '{name}' as situation from O where {name}_" for name, _, _ in _SITUATIONS))
def situation_filter(t: Tables) -> DataFrame:
    e = t.e.select("k", "t", "state")
    each = [s.situation_filter(e, ["k"], "state", target, delays).select("k", "t", F.lit(name).alias("situation")) for name, target, delays in _SITUATIONS]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out


_TRIALS = "T as (select k, t // 10 as trial, t % 10 as t, v from E)"
_G = "G as (select k, trial, t, v, row_number() over (partition by k order by trial, t) - 1 as g from T)"


@query("trial_concat", f"with {E}, {_TRIALS}, {_G} select k, trial, t, g, v from G")
def trial_concat(t: Tables) -> DataFrame:
    return s.concat_trials(_trials(t), ["k"], "trial").select("k", "trial", "t", "g", "v")


def _trials(t: Tables) -> DataFrame:
    return t.e.select("k", F.floor(F.col("t") / 10).alias("trial"), (F.col("t") % 10).alias("t"), "v")


@query("keep_offset", f"with {E}, {_TRIALS}, {_G} select k, g, v from G where t % 3 = 0")
def keep_offset(t: Tables) -> DataFrame:
    whole = s.concat_trials(_trials(t), ["k"], "trial")
    kept = _trials(t).where("t % 3 = 0").select("k", "trial", "t")
    return whole.join(kept, ["k", "trial", "t"], "left_semi").select("k", "g", "v")


@query("column_slice", f"with {M} select vec_id, (ch - 16) // 8 as band, (ch - 16) % 8 as lag, v from M where ch >= 16 and ch < 48")
def column_slice(t: Tables) -> DataFrame:
    part = t["embeddings"].select("vec_id", F.posexplode(F.slice("embedding", 17, 32)).alias("i", "w"))
    return part.select("vec_id", F.floor(F.col("i") / 8).alias("band"), (F.col("i") % 8).cast("long").alias("lag"), F.col("w").cast("double").alias("v"))


@query("axis_flip", f"with {M} select vec_id, ch // 8 as channel, -(ch % 8) as lag, -(ch % 8) / 128e0 as time, v from M")
def axis_flip(t: Tables) -> DataFrame:
    lag = -(F.col("ch") % 8)
    return t.m.select("vec_id", F.floor(F.col("ch") / 8).alias("channel"), lag.alias("lag"), (lag / 128).alias("time"), "v")


@query("trunc_decimals", f"with {E} select k, t, {r('sign(v) * floor(abs(v) * 10.0e0) / 10.0e0')} as v from E")
def trunc(t: Tables) -> DataFrame:
    return t.e.select("k", "t", r6(trunc_decimals("v", 1)).alias("v"))


@query("flatten", f"with {M} select vec_id, ch as i, v from M")
def flatten(t: Tables) -> DataFrame:
    halves = t["embeddings"].select("vec_id", F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("parts"))
    return halves.select("vec_id", F.posexplode(F.flatten("parts")).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


@query("islands", f"with {E}, D as (select distinct k, event_id // 40 as x from E), O as (select k, x, case when x - lag(x) over (partition by k order by x) > 2 then 1 else 0 end as n from D) select k, x, cast(sum(n) over (partition by k order by x) as bigint) as island from O")
def islands(t: Tables) -> DataFrame:
    return s.islands(t.e.select("k", F.floor(F.col("event_id") / 40).alias("x")).distinct(), ["k"], "x", 2).select("k", "x", "island")


@query("gap_intervals", "with X as (select l_suppkey as k, (epoch(l_shipdate) / 86400)::bigint as a, (epoch(l_shipdate) / 86400)::bigint + l_linenumber as b from lineitem), O as (select k, a, max(b) over (partition by k order by a, b rows between unbounded preceding and 1 preceding) as f from X) select cast(k as bigint) as k, f as free_from, a as free_to from O where f < a")
def gap_intervals(t: Tables) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    rows = t["lineitem"].select(F.col("l_suppkey").cast("long").alias("k"), day.alias("start_s"), (day + F.col("l_linenumber")).alias("end_s"))
    return iv.gap_intervals(rows, ["k"])


_ACTIVE = "A as (select k, speaker, a + i as t from (select k, speaker, a, unnest(range(n)) as i from (select k, speaker, n, cast(sum(n) over (partition by k order by turn) as bigint) - n as a from N)))"


@query("speaker_state", f"with {C}, {_COUNTS}, {_ACTIVE}, U as (select k, t // 2 as t, max(case when speaker = 1 then 1 else 0 end) as a from A group by all), V as (select k, t // 3 as t, max(case when speaker = 2 then 1 else 0 end) as b from A group by all) select coalesce(U.k, V.k) as k, coalesce(U.t, V.t) as t, cast(coalesce(a, 0) + 2 * coalesce(b, 0) as bigint) as state from U full outer join V on U.k = V.k and U.t = V.t")
def speaker_state(t: Tables) -> DataFrame:
    rows = iv.interval_expand(iv.sample_counts(t.c, _RATE), ["k"], "turn")
    side = lambda who, by: rows.groupBy("k", F.floor(F.col("t") / by).alias("t")).agg(F.max((F.col("speaker") == who).cast("int")).alias("active"))
    return iv.speaker_state(side(1, 2), side(2, 3), ["k"])


_DYAD = "D as (select k // 2 as session, k % 2 + 1 as subject, t, v as y, v * 2 as x from E)"


@query("pair_partner", f"with {E}, {_DYAD} select a.session, a.subject, a.t, a.y as signal, b.x as stimulus, 'partner' as whose from D a join D b on b.session = a.session and b.subject = 3 - a.subject and b.t = a.t union all select session, subject, t, y, x, 'own' from D")
def pair_partner(t: Tables) -> DataFrame:
    d = t.e.select(F.floor(F.col("k") / 2).alias("session"), (F.col("k") % 2 + 1).alias("subject"), "t", F.col("v").alias("y"), (F.col("v") * 2).alias("x"))
    both = [iv.pair_partner(d, ["session"], "subject", own).withColumn("whose", F.lit("own" if own else "partner")) for own in (False, True)]
    return both[0].unionByName(both[1]).select("session", "subject", "t", "signal", "stimulus", "whose")


_ROLL = "over (partition by k order by t rows between current row and 5 following)"


@query("rolling_stat", f"with {E} select k, t, case when count(v) {_ROLL} >= 6 then {r(f'regr_slope(v, t) {_ROLL}')} end as slope, case when count(v) {_ROLL} >= 6 then {r(f'avg(v) {_ROLL}')} end as mean from E")
def rolling_stat(t: Tables) -> DataFrame:
    rows = s.rolling(s.rolling(t.e, ["k"], "v", 6, "slope", 6, name="slope"), ["k"], "v", 6, "mean", 6, name="mean")
    return rows.select("k", "t", r6("slope").alias("slope"), r6("mean").alias("mean"))


@query("linear_slope", f"with {E} select k, {r('regr_slope(v, t)')} as slope from E group by k")
def linear_slope(t: Tables) -> DataFrame:
    return t.e.groupBy("k").agg(r6(F.regr_slope("v", "t")).alias("slope"))


_MEAN = "Q as (select label as k, ch as t, avg(v) as w from M group by label, ch)"


@query("find_peaks", f"with {M}, {_MEAN}, A as (select k, t, w, abs(w) as a, lag(abs(w)) {W} as p from Q), B as (select k, t, w, a, lag(a) {W} as l, lead(a) {W} as n, max(a) over (partition by k) as m from A where p is null or p <> a) select cast(k as bigint) as k, t, {r('w')} as w from B where a > l and a > n and a >= 0.3 * m")
def find_peaks(t: Tables) -> DataFrame:
    mean = t.m.groupBy(F.col("label").alias("k"), F.col("ch").alias("t")).agg(F.avg("v").alias("w"))
    return s.find_peaks(mean, ["k"], "w", 0.3).select("k", "t", r6("w").alias("w"))


_AUTO = f"N as (select k, count(*) // 2 as n from E group by k), R as (select a.k, b.t - a.t as lag, case when stddev_pop(a.v) > 0 and stddev_pop(b.v) > 0 then covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) end as r0 from E a join N on N.k = a.k join E b on b.k = a.k and b.t between a.t and a.t + N.n group by a.k, b.t - a.t), A as (select k, lag, case when lag = 0 then 1.0e0 else r0 end as r from R)"


@query("autocorrelation", f"with {E}, {_AUTO} select k, lag, {r('r')} as r from A")
def autocorrelation(t: Tables) -> DataFrame:
    return s.autocorrelation(t.e, ["k"], "v").select("k", "lag", r6("r").alias("r"))


@query("decorrelation_time", f"with {E}, {_AUTO}, B as (select k, lag, r, lag(r) over (partition by k order by lag) as p from A), F as (select k, arg_min(struct_pack(lag := lag, r := r, p := p), lag) as f from B where r < 0.1 and lag > 0 group by k) select k, {r('(f.lag - 1 + case when f.p - f.r <> 0 then (f.p - 0.1e0) / (f.p - f.r) end) * 7.8125e0')} as time from F")
def decorrelation_time(t: Tables) -> DataFrame:
    return s.decorrelation_time(s.autocorrelation(t.e, ["k"], "v"), ["k"], 0.1, 7.8125).select("k", r6("time").alias("time"))
