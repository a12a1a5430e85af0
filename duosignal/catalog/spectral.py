"""Queries over signal transforms and phase synchrony."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.catalog.registry import E, L, M, Tables, query, r
from duosignal.functions.numeric import pearson, r6
from duosignal.operators import series as se
from duosignal.operators import filters as ft
from duosignal.operators import spectral as sp

_PI = "pi()"


@query("tumbling_mean", f"with {E} select k, t // 5 as t, {r('avg(v)')} as v from E group by k, t // 5 having count(*) = 5")
def tumbling_mean(t: Tables) -> DataFrame:
    return sp.tumbling_mean(t.e, ["k"], "v", 5).select("k", "t", r6("v").alias("v"))


_SERIES = "S as (select vec_id as k, ch as t, v from M)"
#: The transform of 64 samples, and the analytic signal from it.
_HILBERT = f"""{M}, {_SERIES}, B as (select k, f, sum(v * cos(2 * {_PI} * f * t / 64)) as c, -sum(v * sin(2 * {_PI} * f * t / 64)) as s from S, (select unnest(range(33)) as f) group by all),
H as (select S.k, S.t, sum((case when f in (0, 32) then 1 else 2 end) * (c * cos(2 * {_PI} * f * t / 64) - s * sin(2 * {_PI} * f * t / 64))) / 64 as re, sum((case when f in (0, 32) then 0 else 2 end) * (c * sin(2 * {_PI} * f * t / 64) + s * cos(2 * {_PI} * f * t / 64))) / 64 as im from S join B on B.k = S.k group by all)"""


def vectors(t: Tables) -> DataFrame:
    """The embeddings as series k with their samples as the array x."""
    return t["embeddings"].select(F.col("vec_id").alias("k"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


_ANALYTIC = f"with {_HILBERT} select k, t, {r('sqrt(re * re + im * im)')} as amplitude, {r('re / sqrt(re * re + im * im)')} as cosine from H"


@query("analytic_signal_whole", _ANALYTIC)
@query("analytic_signal", _ANALYTIC)
def analytic_signal(t: Tables) -> DataFrame:
    rows = sp.analytic_arrays(vectors(t), ["k"])
    rows = rows.select("k", F.posexplode(F.arrays_zip("amplitude", "phase")).alias("t", "_z"))
    return rows.select("k", F.col("t").cast("long").alias("t"), r6("_z.amplitude").alias("amplitude"), r6(F.cos("_z.phase")).alias("cosine"))


_TAPS = sp.windowed_sinc(1.0, 4.0, 16.0, 7)


@query("fir_filter", f"with {E} select k, t, " + r(" + ".join(f"({'lag' if i - 3 >= 0 else 'lead'}(v, {abs(i - 3)}, 0.0) over (partition by k order by t)) * ({tap!r}e0)" if "e" not in repr(tap) else f"({'lag' if i - 3 >= 0 else 'lead'}(v, {abs(i - 3)}, 0.0) over (partition by k order by t)) * ({tap!r})" for i, tap in enumerate(_TAPS))) + " as y from E")
def fir_filter(t: Tables) -> DataFrame:
    return sp.fir_filter(t.e, ["k"], "v", _TAPS, "y").select("k", "t", r6("y").alias("y"))


@query("butter_filter")
def butter_filter(t: Tables) -> DataFrame:
    return sp.butter_filter(t.e, ["k"], "v", 3, 1.0, 4.0, 16.0, forward_backward=True)


#: The band Delta at 32 Hz, of minimum phase.
_LEAST = ft.minimum_phase(ft.fir_design(*sp.band("Delta"), 32.0))
_BACK = "H as (select * from (values " + ", ".join(f"({i}, {tap:.17e})" for i, tap in enumerate(_LEAST)) + ") h(d, tap))"


@query("fir_filter_minimum", f"with {E}, {_BACK} select a.k, a.t, {r('sum(coalesce(b.v, 0) * tap)')} as y from E a cross join H left join E b on b.k = a.k and b.t = a.t - d group by a.k, a.t")
def fir_filter_minimum(t: Tables) -> DataFrame:
    """A causal filter by the name of its band, over blocks of samples."""
    return ft.band_filter(t.e, ["k"], "v", "Delta", 32.0, causal=True, size=256).select("k", "t", r6("y").alias("y"))


_B, _A = sp.butterworth(3, None, 4.0, 32.0)
_STATES = ", ".join(f"{f's{i + 1} + ' if i < 2 else ''}{_B[i + 1]:.17e} * e.v - {_A[i + 1]:.17e} * ({_B[0]:.17e} * e.v + s0)" for i in range(3))


@query("butter_filter_causal", f"""with recursive {E}, R as (select k, -1::bigint as t, 0e0 as y, 0e0 as s0, 0e0 as s1, 0e0 as s2 from E where t = 0
union all select e.k, e.t, {_B[0]:.17e} * e.v + s0, {_STATES} from R join E e on e.k = R.k and e.t = R.t + 1) select k, t, {r('y')} as y from R where t >= 0""")
def butter_filter_causal(t: Tables) -> DataFrame:
    """A recursive filter over blocks of samples, whose states are followed from block to block."""
    return ft.butter_blocks(t.e, ["k"], "v", 3, None, 4.0, 32.0, size=16).select("k", "t", r6("y").alias("y"))


@query("butter_filter_blocks")
def butter_filter_blocks(t: Tables) -> DataFrame:
    """Forward and backward over blocks; compared with whole series in a test."""
    return ft.butter_blocks(t.e, ["k"], "v", 3, 1.0, 4.0, 16.0, True, size=32).select("k", "t", r6("y").alias("y"))


_FRAME = f"D as (select k, t // 16 as frame, f, sum(v * (0.5 - 0.5 * cos(2 * {_PI} * (t % 16) / 16)) * cos(2 * {_PI} * (t % 16) * f / 16)) as c, sum(v * (0.5 - 0.5 * cos(2 * {_PI} * (t % 16) / 16)) * sin(2 * {_PI} * (t % 16) * f / 16)) as s from E, (select unnest(range(1, 9)) as f) group by all having count(*) = 16), Q as (select k, frame, f, c * c + s * s as power from D)"


@query("band_power_frames", f"with {E}, {_FRAME}, B as (select k, frame, (f - 1) // 2 as band, sum(power) as power from Q group by all), T as (select *, max(power) over (partition by k) as top from B) select k, frame, band, {r('greatest(10 * log10(greatest(power / top, 1e-30)), -80)')} as db from T where top > 0")
def band_power_frames(t: Tables) -> DataFrame:
    power = sp.frame_power(t.e, ["k"], "v", 16, list(range(1, 9)))
    return sp.band_levels(power, ["k"], F.floor((F.col("f") - 1) / 2)).select("k", "frame", "band", r6("db").alias("db"))


@query("welch_psd", f"with {E}, {_FRAME} select k, f, {r('avg(power) / 1e4')} as power from Q where f between 2 and 6 group by k, f")
def welch_psd(t: Tables) -> DataFrame:
    return sp.welch(t.e, ["k"], "v", 16, list(range(2, 7))).select("k", "f", r6(F.col("power") / 1e4).alias("power"))


_OVERLAP = f"""G as (select k, s, t - s * 8 as i, v from E, (select unnest(range(500)) as s) where t >= s * 8 and t < s * 8 + 16),
H as (select *, v - avg(v) over o as d, count(*) over o as n from G window o as (partition by k, s)),
D as (select k, s, f, sum(d * (0.54 - 0.46 * cos(2 * {_PI} * i / 16)) * cos(2 * {_PI} * i * f / 16)) as c, sum(d * (0.54 - 0.46 * cos(2 * {_PI} * i / 16)) * sin(2 * {_PI} * i * f / 16)) as z from H, (select unnest(range(1, 8)) as f) where n = 16 group by all),
U as (select 2 / (32 * sum(power(0.54 - 0.46 * cos(2 * {_PI} * i / 16), 2))) as u from (select unnest(range(16)) as i))"""


@query("welch_overlap", f"with {E}, {_OVERLAP} select k, f * 2e0 as f, {r('avg((c * c + z * z) * u)', 4)} as power from D, U group by k, f")
def welch_overlap(t: Tables) -> DataFrame:
    """Power density at 32 Hz from 1 to 15 Hz, over segments that share half of their samples."""
    found = sp.welch_psd(t.e, ["k"], "v", 32.0, 16, 8, 1.0, 15.0)
    return found.select("k", "f", (F.round("power", 4) + 0.0).alias("power"))


@query("psd_corr", f"with {E}, P as (select k, t, v, lag(v, 1, 0.0) over (partition by k order by t) as p from E), "
       + ", ".join(f"D{n} as (select k, t // 16 as frame, f, sum({n} * (0.5 - 0.5 * cos(2 * {_PI} * (t % 16) / 16)) * cos(2 * {_PI} * (t % 16) * f / 16)) as c, sum({n} * (0.5 - 0.5 * cos(2 * {_PI} * (t % 16) / 16)) * sin(2 * {_PI} * (t % 16) * f / 16)) as s from P, (select unnest(range(1, 9)) as f) group by all having count(*) = 16), W{n} as (select k, f, avg(c * c + s * s) as w from D{n} group by k, f)" for n in "vp")
       + f" select a.k, {r('corr(a.w, b.w)')} as r from Wv a join Wp b on a.k = b.k and a.f = b.f group by a.k")
def psd_corr(t: Tables) -> DataFrame:
    rows = t.e.withColumn("p", F.lag("v", 1, 0.0).over(se.by(["k"], "t")))
    signal, other = (sp.welch(rows, ["k"], x, 16, list(range(1, 9))).withColumnRenamed("power", x) for x in ("v", "p"))
    return signal.join(other, ["k", "f"]).groupBy("k").agg(r6(pearson("v", "p")).alias("r"))


@query("band_catalog", f"with {E}, {_FRAME}, W as (select k, f, avg(power) / 1e4 as power from Q group by k, f), B as (select * from (values ('Delta', 1e0, 4e0), ('Theta', 4e0, 8e0), ('Alpha', 8e0, 13e0), ('Beta_1', 13e0, 19e0), ('Beta_2', 19e0, 25e0), ('All', 0e0, 40e0), ('Delta_Theta', 1e0, 8e0), ('Delta_Theta_Alpha', 1e0, 13e0)) b(name, low, high)) select k, name, {r('avg(power)')} as power from W join B on f * 3 >= low and f * 3 < high group by k, name")
def band_catalog(t: Tables) -> DataFrame:
    """Mean power of each series in the catalogued bands, of frames of 16 samples at 48 Hz."""
    power = sp.welch(t.e, ["k"], "v", 16, list(range(1, 9)))
    return sp.band_powers(power, ["k"], F.col("f") * 3).select("k", "name", r6(F.col("power") / 1e4).alias("power"))


_MEL = [[float(f"{v:.15g}") for v in row] for row in sp.mel_filters(16000.0, 125, 16)]
_MEL_SQL = "K as (select * from (values " + ", ".join(f"({b}, {f}, {v:.16e})" for b, row in enumerate(_MEL) for f, v in enumerate(row) if v) + ") m(band, f, share))"


@query("mel_bands", f"""with {L}, {_MEL_SQL}, N as (select cast(k as bigint) as k, count(*) as n from L group by k), R as (select k, unnest(range((n + 124 - 125 + 125) // 125)) as frame from N),
X as (select R.k, frame, L.t - frame * 125 + 62 as i, x * (0.5 - 0.5 * cos(2 * {_PI} * (L.t - frame * 125 + 62) / 125)) as v from R join L on L.k = R.k and L.t - frame * 125 + 62 between 0 and 124),
D as (select k, frame, f, sum(v * cos(2 * {_PI} * i * f / 125)) as c, sum(v * sin(2 * {_PI} * i * f / 125)) as s from X, (select distinct f from K) group by all),
P as (select k, frame, band, greatest(10 * log10(greatest(sum((c * c + s * s) * share), 1e-10)), -1e9) as level from D join K using (f) group by all),
T as (select *, max(level) over (partition by k) as top from P) select k, frame, cast(band as bigint) as band, {r('greatest(level - top, -80)')} as db from T""")
def mel_bands(t: Tables) -> DataFrame:
    return sp.mel_bands(t.l, ["k"], "x", 16000.0).select("k", "frame", "band", r6("db").alias("db"))


_PHASE = f"{_HILBERT}, A as (select k, t, atan2(im, re) as phase from H)"
_LAGGED = f"with {_PHASE}, L as (select a.k, l as lag, a.phase - b.phase as d from A a, (select unnest(range(16)) as l) join A b on b.k = (a.k + 1) and b.t = a.t - l) select k, lag, {r('sqrt(avg(cos(d)) ** 2 + avg(sin(d)) ** 2)')} as plv from L group by k, lag"


def _lagged(t: Tables, **stimulus) -> DataFrame:
    """Each vector as a channel, the next one as the stimulus."""
    signal = sp.analytic_arrays(vectors(t), ["k"]).select("k", F.col("phase").alias("a"))
    other = sp.analytic_arrays(vectors(t), ["k"], **stimulus).select((F.col("k") - 1).alias("k"), F.col("phase").alias("b"))
    return sp.plv_arrays(signal.join(other, "k"), ["k"], "a", "b", list(range(16))).select("k", "lag", r6("plv").alias("plv"))


@query("plv_lagged_whole", _LAGGED)
@query("plv_lagged", _LAGGED)
def plv_lagged(t: Tables) -> DataFrame:
    return _lagged(t)


@query("plv_lagged_band")
def plv_lagged_band(t: Tables) -> DataFrame:
    """The stimulus filtered to 4 to 8 Hz both ways; compared with brute force in a test."""
    return _lagged(t, band=(4.0, 8.0), rate=128.0)


_MP = "G as (select label, vec_id, ch, v * 20 as phase from M)"
_INTRA = "I as (select a.label, a.ch as a, b.ch as b, sqrt(avg(cos(a.phase - b.phase)) ** 2 + avg(sin(a.phase - b.phase)) ** 2) as plv from G a join G b on a.vec_id = b.vec_id group by all)"
_INTRA_SQL = f"with {M}, {_MP}, {_INTRA} select label, a, b, {r('plv')} as plv from I"


def intra(t: Tables) -> DataFrame:
    """Pairs of all channels of each label."""
    rows = vectors(t).select("label", F.transform("x", lambda v: v * 20).alias("phases"))
    return sp.plv_pairs(rows, ["label"], "phases")


@query("plv_intra_whole", _INTRA_SQL)
@query("plv_intra", _INTRA_SQL)
def plv_intra(t: Tables) -> DataFrame:
    return intra(t).select("label", "a", "b", r6("plv").alias("plv"))


@query("plv_inter", f"with {E}, X as (select k // 2 as s, k % 2 as m, t, state as ch, v / 10 as phase from E) select x.s as session, x.ch as a, y.ch as b, {r('sqrt(avg(cos(x.phase - y.phase)) ** 2 + avg(sin(x.phase - y.phase)) ** 2)')} as plv from X x join X y on y.s = x.s and y.t = x.t and x.m = 0 and y.m = 1 group by all")
def plv_inter(t: Tables) -> DataFrame:
    rows = t.e.select(F.floor(F.col("k") / 2).alias("session"), (F.col("k") % 2).alias("m"), "t", F.col("state").alias("ch"), (F.col("v") / 10).alias("phase"))
    listener = rows.where("m = 0").select("session", "t", F.col("ch").alias("a"), F.col("phase").alias("pa"))
    speaker = rows.where("m = 1").select("session", "t", F.col("ch").alias("b"), F.col("phase").alias("pb"))
    return listener.join(speaker, ["session", "t"]).groupBy("session", "a", "b").agg(r6(sp.plv(F.col("pa") - F.col("pb"))).alias("plv"))


_LESS = f"{M}, {_MP}, {_INTRA}, Z as (select x.label, x.a, x.b, greatest(0, x.plv - y.plv) as plv from I x join I y on y.a = x.b and y.b = x.a and y.label = 0 where x.label <> 0)"
_BASELINE = f"with {_LESS} select label, a, b, {r('plv')} as plv from Z"


@query("plv_baseline_whole", _BASELINE)
@query("plv_baseline", _BASELINE)
def plv_baseline(t: Tables) -> DataFrame:
    return _less_silence(intra(t)).select("label", "a", "b", r6("plv").alias("plv"))


@query("plv_baseline_mean", f"with {_LESS} select a, b, {r('avg(plv)')} as plv from Z group by a, b")
def plv_baseline_mean(t: Tables) -> DataFrame:
    return _less_silence(intra(t)).groupBy("a", "b").agg(r6(F.avg("plv")).alias("plv"))


def _less_silence(p: DataFrame) -> DataFrame:
    """Less the matrix of label 0 turned over, negatives 0."""
    silence = p.where("label = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("plv").alias("base"))
    return p.where("label <> 0").join(silence, ["a", "b"]).select("label", "a", "b", F.greatest(F.lit(0.0), F.col("plv") - F.col("base")).alias("plv"))
