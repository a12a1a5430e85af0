"""Queries over ridge models, their scores and the choice of penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duosignal.catalog.registry import E, L, Tables, query, r
from duosignal.functions.numeric import r6
from duosignal.operators import lagged as lag
from duosignal.operators import ridge as m
from duosignal.operators import series as s
from duosignal.operators.folds import contiguous_folds
from duosignal.operators.nulls import dealt_sql, permutation_null, permutation_scores, permuted
from duosignal.operators.spectral import windowed_sinc

ALPHA = 5.0
CHANNELS = ["y1", "y2", "y3"]


def folded(t: Tables, k: int = 5) -> DataFrame:
    """lineitem as series, with folds."""
    return contiguous_folds(t.l, ["k"], k)


def encoded(t: Tables, x: str = "x", channels: list[str] = CHANNELS, alpha: float = ALPHA) -> DataFrame:
    return m.encode(folded(t), ["k"], x, channels, alpha)


#: The same model row by row: folds, long form Y, fits T on scaled rows Z, lines W, predictions P, scores S.
FOLDED = f"{L}, F as (select cast(k as bigint) as k, t, x, y1, y2, y3, ntile(5) over (partition by k order by t) - 1 as fold from L)"


def model_sql(x: str = "x", channels: list[str] = CHANNELS, tag: str = "", alpha: str = "5e0") -> str:
    union = " union all ".join(f"select k, t, fold, {x} as x, '{c}' as channel, {c} as y from F" for c in channels)
    return f"""Y{tag} as ({union}),
T{tag} as (select k, channel, split, min(x) as lo, max(x) as hi, avg(y) as my, stddev_pop(y) as sy from Y{tag}, (select unnest(range(5)) as split) where fold <> split group by all),
Z{tag} as (select a.k, a.channel, split, fold, t, case when hi = lo then 0.0 else (x - lo) / (hi - lo) end as x, (y - my) / sy as y from Y{tag} a join T{tag} b on a.k = b.k and a.channel = b.channel),
W{tag} as (select k, channel, split, regr_sxy(y, x) / (regr_sxx(y, x) + {alpha}) as w, avg(y) - regr_sxy(y, x) / (regr_sxx(y, x) + {alpha}) * avg(x) as b from Z{tag} where fold <> split group by all),
P{tag} as (select a.k, a.channel, a.split as fold, t, x, y, w, w * x + b as p from Z{tag} a join W{tag} b on a.k = b.k and a.channel = b.channel and a.split = b.split where a.fold = a.split),
S{tag} as (select k, channel, fold, case when stddev_pop(p) > 1e-9 and stddev_pop(y) > 1e-9 then corr(p, y) end as r, sqrt(avg((p - y) * (p - y))) as rmse from P{tag} group by all)"""


MODEL = f"{FOLDED}, {model_sql()}"


def wide_sql(source: str, group: str, responses: list[str], alpha: str = "5e0", x_by: str = "Normalize", y_by: str = "Standarize") -> str:
    """The ridge models of two features a and b row by row, from ``source`` (group, t, fold, a, b, responses).

    CTEs: long form Y, training statistics T, scaled rows Z, moments H, weights W, predictions P, scores S.
    """

    def scaled(c: str, by: str) -> str:
        size, shift = (f"(h{c} - l{c})", f"l{c}") if by == "Normalize" else (f"s{c}", f"m{c}")
        return f"case when h{c} > l{c} then ({c} - {shift}) / {size} else 0.0 end"

    union = " union all ".join(f"select {group}, t, fold, a, b, '{c}' as channel, {c} as y from {source}" for c in responses)
    stats = ", ".join(f"min({c}) as l{c}, max({c}) as h{c}, avg({c}) as m{c}, stddev_pop({c}) as s{c}" for c in "aby")
    det = f"((aa + {alpha}) * (bb + {alpha}) - ab * ab)"
    return f"""Y as ({union}), T as (select {group}, channel, split, {stats} from Y, (select unnest(range(5)) as split) where fold <> split group by all),
Z as (select {group}, channel, split, fold, t, {scaled('a', x_by)} as a, {scaled('b', x_by)} as b, {scaled('y', y_by)} as y from Y join T using ({group}, channel)),
H as (select {group}, channel, split, count(*) as n, regr_sxx(a, a) as aa, regr_sxx(b, b) as bb, regr_sxy(a, b) as ab, regr_sxy(y, a) as ay, regr_sxy(y, b) as by_, avg(a) as ma, avg(b) as mb, avg(y) as my, regr_sxx(y, y) as yy from Z where fold <> split group by all),
W as (select *, ((bb + {alpha}) * ay - ab * by_) / {det} as wa, ((aa + {alpha}) * by_ - ab * ay) / {det} as wb from H),
P as (select {group}, channel, split as fold, t, y, wa * a + wb * b + my - wa * ma - wb * mb as p from Z join W using ({group}, channel, split) where Z.fold = split),
S as (select {group}, channel, fold, case when stddev_pop(p) > 1e-12 and stddev_pop(y) > 1e-12 then corr(p, y) end as r, sqrt(avg((p - y) * (p - y))) as rmse from P group by all)"""


#: Two features: x and x one sample before.
PAIRED = f"{FOLDED}, G as (select k, t, fold, x as a, lag(x, 1, 0.0) over (partition by k order by t) as b, y1, y2, y3 from F)"
WIDE = f"{PAIRED}, {wide_sql('G', 'k', CHANNELS)}"


def paired(t: Tables) -> DataFrame:
    """Features and responses as the arrays xs and ys."""
    rows = s.lag_matrix(folded(t), ["k"], ["x"], [0, 1])
    return rows.select("k", "t", "fold", F.array("x_x_0", "x_x_1").alias("xs"), F.array(*CHANNELS).alias("ys"))


def wide(t: Tables, alphas: list[float] | None = None) -> DataFrame:
    return named(m.encode_wide(paired(t), ["k"], "xs", "ys", 2, alphas or [ALPHA]), CHANNELS)


def named(fits: DataFrame, channels: list[str]) -> DataFrame:
    return fits.withColumn("channel", F.get(F.array(*map(F.lit, channels)), F.col("response").cast("int")))


@query("gram", f"with {FOLDED} select k, fold, count(*) as n, {r('avg(x)')} as mx, {r('avg(y1)')} as my, {r('var_pop(x)')} as vx, {r('covar_pop(x, y1) / 1e3')} as vxy, {r('var_pop(y1) / 1e6')} as vy, min(x) as low, max(x) as high from F group by k, fold")
def gram(t: Tables) -> DataFrame:
    rows = m.pair_blocks(folded(t).withColumnRenamed("y1", "y"), ["k"])
    n = F.col("n")
    dx, dy = F.col("sx") / n, F.col("sy") / n
    moments = {"mx": F.col("x0") + dx, "my": F.col("y0") + dy, "vx": F.col("sxx") / n - dx * dx, "vxy": (F.col("sxy") / n - dx * dy) / 1e3, "vy": (F.col("syy") / n - dy * dy) / 1e6}
    return rows.select("k", "fold", n.cast("long").alias("n"), *[r6(c).alias(k) for k, c in moments.items()], "low", "high")


@query("gram_wide", f"with {FOLDED} select k, {r('covar_pop(x, y1)')} as xy1, {r('covar_pop(y2, y1)')} as y2y1, {r('avg(y2)')} as y2, min(x) as low, max(y1) as high, count(*) as n from F group by k")
def gram_wide(t: Tables) -> DataFrame:
    grams = m.gram(folded(t).select("k", F.array("x", "y2").alias("xs"), F.array("y1").alias("ys")), ["k"], "xs", "ys", widths=(2, 1))
    at = lambda c, i: F.get(c, F.lit(i))
    return grams.select("k", r6(at("products", 2) / F.col("n")).alias("xy1"), r6(at("products", 5) / F.col("n")).alias("y2y1"), r6(at("mean", 1)).alias("y2"), at("low", 0).alias("low"), at("high", 2).alias("high"), F.col("n").cast("long").alias("n"))


@query("encode_wide", f"with {WIDE} select k, channel, fold, {r('r')} as r, {r('rmse')} as rmse from S")
def encode_wide(t: Tables) -> DataFrame:
    return wide(t).select("k", "channel", "fold", r6("r").alias("r"), r6("rmse").alias("rmse"))


@query("encode_wide_weights", f"with {WIDE} select k, channel, split as fold, {r('wa')} as wa, {r('wb')} as wb, {r('my - wa * ma - wb * mb')} as b from W")
def encode_wide_weights(t: Tables) -> DataFrame:
    return wide(t).select("k", "channel", "fold", *[r6(F.get("w", F.lit(i))).alias(c) for i, c in enumerate(("wa", "wb"))], r6("b").alias("b"))


@query("predict_wide", f"with {WIDE} select k, t, channel, {r('y')} as y, {r('p')} as p from P")
def predict_wide(t: Tables) -> DataFrame:
    rows = named(m.predict_wide(paired(t), wide(t).drop("channel"), ["k", "fold"], "xs", "ys"), CHANNELS)
    return rows.select("k", "t", "channel", r6("y_true").alias("y"), r6("p").alias("p"))


@query("ridge_encode", f"with {MODEL} select k, channel, split as fold, {r('w')} as w, {r('b')} as b from W")
def ridge_encode(t: Tables) -> DataFrame:
    return encoded(t).select("k", "channel", "fold", r6("w").alias("w"), r6("b").alias("b"))


@query("predict", f"with {MODEL} select k, t, channel, {r('p')} as p from P")
def predict(t: Tables) -> DataFrame:
    return m.predict(folded(t), encoded(t), ["k"], "x").select("k", "t", "channel", r6("p").alias("p"))


@query("channel_corr", f"with {MODEL} select k, channel, fold, {r('r')} as r from S")
def channel_corr(t: Tables) -> DataFrame:
    return encoded(t).select("k", "channel", "fold", r6("r").alias("r"))


@query("channel_rmse", f"with {MODEL} select k, channel, fold, {r('rmse')} as rmse from S")
def channel_rmse(t: Tables) -> DataFrame:
    return encoded(t).select("k", "channel", "fold", r6("rmse").alias("rmse"))


@query("fold_mean", f"with {MODEL} select S.k, S.channel, {r('avg(r)')} as r, {r('avg(rmse)')} as rmse, {r('avg(w)')} as w from S join W on W.k = S.k and W.channel = S.channel and W.split = S.fold group by S.k, S.channel")
def fold_mean(t: Tables) -> DataFrame:
    return encoded(t).groupBy("k", "channel").agg(*[r6(F.avg(c)).alias(c) for c in ("r", "rmse", "w")])


#: Lags 2 and 1 of x: the range of times is turned round.
_TRF = f"{FOLDED}, G as (select k, t, fold, lag(x, 2, 0.0) over (partition by k order by t) as a, lag(x, 1, 0.0) over (partition by k order by t) as b, y1 from F), {wide_sql('G', 'k', ['y1'])}"


@query("lag_model", f"with {_TRF} select k, split as fold, cast(0 as bigint) as lag, {r('wa')} as w, {r('S.r')} as r from W join S using (k, channel) where S.fold = split union all select k, split, 1, {r('wb')}, {r('S.r')} from W join S using (k, channel) where S.fold = split")
def lag_model(t: Tables) -> DataFrame:
    fits = lag.lag_model(folded(t), ["k"], "x", ["y1"], 0.0, 2 / 128, 128, ALPHA)
    return fits.select("k", "fold", F.posexplode("w").alias("lag", "w"), "r").select("k", "fold", F.col("lag").cast("long").alias("lag"), r6("w").alias("w"), r6("r").alias("r"))


#: Two channels to the stimulus one sample before.
_DECODED = f"{FOLDED}, G as (select k, t, fold, y1 as a, y2 as b, lag(x, 1, 0.0) over (partition by k order by t) as x from F), {wide_sql('G', 'k', ['x'], x_by='Standarize', y_by='Normalize')}"


def decoded(t: Tables, channels: list[str], delays: list[int]) -> DataFrame:
    return lag.decode(folded(t), ["k"], channels, "x", delays, 1, [ALPHA])


@query("ridge_decode", f"with {_DECODED} select k, W.split as fold, {r('wa')} as w1, {r('wb')} as w2, {r('S.r')} as r, {r('S.rmse')} as rmse from W join S using (k, channel) where S.fold = W.split")
def ridge_decode(t: Tables) -> DataFrame:
    w = lambda i: r6(F.get("w", F.lit(i)))
    return decoded(t, ["y1", "y2"], [0]).select("k", "fold", w(0).alias("w1"), w(1).alias("w2"), r6("r").alias("r"), r6("rmse").alias("rmse"))


@query("ridge_decode_wide")
def ridge_decode_wide(t: Tables) -> DataFrame:
    """All channels at four delays; compared with rows in a test."""
    fits = decoded(t, CHANNELS, [0, -1, -2, -3])
    return fits.select("k", "fold", F.posexplode("w").alias("feature", "w"), "r")


@query("decode_patterns", f"with {_DECODED} select k, split as fold, {r('(aa * wa + ab * wb) / yy')} as p1, {r('(ab * wa + bb * wb) / yy')} as p2 from W")
def decode_patterns(t: Tables) -> DataFrame:
    at = lambda i: r6(F.get("pattern", F.lit(i)))
    return decoded(t, ["y1", "y2"], [0]).select("k", "fold", at(0).alias("p1"), at(1).alias("p2"))


#: Every second lag of a range of 77, by which the stimulus goes before the sample.
SWEEP_LAGS = list(range(0, 77, 2))


@query("decode_lag_sweep", f"with {FOLDED}, G as (" + " union all ".join(f"select k, t, fold, {d} as lag, y1 as a, y2 as b, lag(x, {d}, 0.0) over (partition by k order by t) as x from F" for d in SWEEP_LAGS)
       + f"), {wide_sql('G', 'k, lag', ['x'], x_by='Standarize', y_by='Normalize')}, A as (select k, lag, avg(r) as r from S group by k, lag) select k, cast(lag as bigint) as lag, {r('r')} as r, r = max(r) over (partition by k) as best from A")
def decode_lag_sweep(t: Tables) -> DataFrame:
    """The decoder of the stimulus at every second lag, all from one Gram matrix; the lag of the best mean score is marked."""
    rows = folded(t).withColumn("channels", F.array("y1", "y2"))
    return lag.decode_sweep(rows, ["k"], "channels", "x", 2, [0], SWEEP_LAGS, ALPHA).withColumn("r", r6("r"))


@query("decode_lag_sweep_wide")
def decode_lag_sweep_wide(t: Tables) -> DataFrame:
    """All channels at six delays for 39 lags in two bands of the stimulus; compared with separate fits in a test."""
    rows = folded(t).withColumn("channels", F.array(*CHANNELS))
    bands = {"low": windowed_sinc(1.0, 4.0, 32.0, 7), "high": windowed_sinc(4.0, 8.0, 32.0, 7)}
    w = s.by(["k"], "t")
    in_band = lambda taps: sum((F.lit(tap) * s.lagged("x", i - len(taps) // 2, w) for i, tap in enumerate(taps)), F.lit(0.0))
    rows = rows.withColumns({band: in_band(taps) for band, taps in bands.items()})
    rows = rows.select("k", "t", "fold", "channels", *bands).unpivot(["k", "t", "fold", "channels"], list(bands), "band", "stimulus")
    return lag.decode_sweep(rows, ["k", "band"], "channels", "stimulus", len(CHANNELS), [-3, -2, -1, 0, 1, 2], SWEEP_LAGS, ALPHA).withColumn("r", r6("r"))


_BEFORE = f"{FOLDED}, G as (select k, t, fold, lag(x, 1, 0.0) over o as a, lag(y2, 1, 0.0) over o as b, y1, y3 from F window o as (partition by k order by t))"


def stages(t: Tables, how: str, delays: list[int]) -> DataFrame:
    """The stimuli x and y2 at some delays to y1 and y3."""
    rows = folded(t).select("k", "t", "fold", F.array("x", "y2").alias("xs"), F.array("y1", "y3").alias("ys"))
    return named(lag.lagged_stages(rows, ["k"], "xs", "ys", [1, 1], 2, delays, [ALPHA], how), ["y1", "y3"])


_ENDED = "P as (select {group}, channel, split as fold, y, {p} as p from Z join V using (k, channel, split) where fold = split), S as (select k, channel, fold, corr(p, y) as r, sqrt(avg((p - y) * (p - y))) as rmse from P group by all) select k, channel, fold, {r}, {e} from S"
_ENDED = _ENDED.replace("{group}", "k").replace("{r}", f"{r('r')} as r").replace("{e}", f"{r('rmse')} as rmse")
_HALF = wide_sql("G", "k", ["y1", "y3"]).split("W as (")[0]


@query("residual_stages", f"with {_BEFORE}, {_HALF} U as (select *, ay / (aa + 5e0) as wa from H), V as (select *, (by_ - ab * wa) / (bb + 5e0) as wb from U), {_ENDED.replace('{p}', 'wa * a + wb * b + my - wa * ma - wb * mb')}")
def residual_stages(t: Tables) -> DataFrame:
    """A stimulus fitted on what the one before it leaves of the responses, from blocks of one Gram matrix."""
    return stages(t, "in turn", [1]).select("k", "channel", "fold", r6("r").alias("r"), r6("rmse").alias("rmse"))


@query("ensemble_stages", f"with {_BEFORE}, {_HALF} V as (select *, ay / (aa + 5e0) as wa, by_ / (bb + 5e0) as wb from H), {_ENDED.replace('{p}', '(wa * a + wb * b - wa * ma - wb * mb) / 2 + my')}")
def ensemble_stages(t: Tables) -> DataFrame:
    """The mean of one model for each stimulus, from blocks of one Gram matrix."""
    return stages(t, "mean", [1]).select("k", "channel", "fold", r6("r").alias("r"), r6("rmse").alias("rmse"))


@query("residual_stages_wide")
def residual_stages_wide(t: Tables) -> DataFrame:
    """Two stimuli at three delays each; compared with fits row by row in a test."""
    return stages(t, "in turn", [0, 1, 2]).select("k", "channel", "fold", r6("r").alias("r"), r6("rmse").alias("rmse"))


@query("ensemble_stages_wide")
def ensemble_stages_wide(t: Tables) -> DataFrame:
    return stages(t, "mean", [0, 1, 2]).select("k", "channel", "fold", r6("r").alias("r"), r6("rmse").alias("rmse"))


_BOTH = f"{FOLDED}, {model_sql(tag='1')}, {model_sql('y2', ['y1', 'y3'], tag='2')}"


@query("ensemble_mean", f"with {_BOTH}, A as (select a.k, a.channel, a.fold, a.t, a.y, (a.p + b.p) / 2 as p from P1 a join P2 b on a.k = b.k and a.channel = b.channel and a.t = b.t) select k, channel, fold, {r('corr(p, y)')} as r, {r('sqrt(avg((p - y) * (p - y)))')} as rmse from A group by all")
def ensemble_mean(t: Tables) -> DataFrame:
    long = m.melt(folded(t).select("k", "fold", "x", "y1", "y2", "y3"), ["y1", "y3"])
    return m.column_stages(long, ["k", "channel"], ["x", "y2"], "y", ALPHA, "mean").select("k", "channel", "fold", r6("r").alias("r"), r6("rmse").alias("rmse"))


_X, _Y2 = "(x - lx) / (hx - lx)", "(y2 - l2) / (h2 - l2)"


@query("residual_boost", f"""with {FOLDED}, T as (select k, split, min(x) as lx, max(x) as hx, min(y2) as l2, max(y2) as h2 from F, (select unnest(range(5)) as split) where fold <> split group by all),
Z as (select F.k, split, fold, t, {_X} as a, {_Y2} as b, y1 as y from F join T on T.k = F.k),
W as (select k, split, regr_sxy(y, a) / (regr_sxx(y, a) + 5e0) as w, avg(y) - regr_sxy(y, a) / (regr_sxx(y, a) + 5e0) * avg(a) as c from Z where fold <> split group by all),
R as (select Z.*, w * a + c as p, y - (w * a + c) as e from Z join W on W.k = Z.k and W.split = Z.split),
V as (select k, split, regr_sxy(e, b) / (regr_sxx(e, b) + 5e0) as v, avg(e) - regr_sxy(e, b) / (regr_sxx(e, b) + 5e0) * avg(b) as d from R where fold <> split group by all),
Q as (select R.k, R.split, R.y, p + v * b + d as p from R join V on V.k = R.k and V.split = R.split where fold = R.split)
select k, split as fold, {r('corr(p, y)')} as r, {r('sqrt(avg((p - y) * (p - y)))')} as rmse from Q group by all""")
def residual_boost(t: Tables) -> DataFrame:
    scores = m.column_stages(folded(t), ["k"], ["x", "y2"], "y1", ALPHA, "in turn", y_by=None)
    return scores.select("k", "fold", r6("r").alias("r"), r6("rmse").alias("rmse"))


@query("corr_loss_fit")
def corr_loss_fit(t: Tables) -> DataFrame:
    grams = m.gram(folded(t).select("k", F.array("x", "y2").alias("xs"), F.array("y1").alias("ys")), ["k"], "xs", "ys", widths=(2, 1))
    return m.corr_loss_fit(grams, ["k"], 2, 0.01)


ALPHAS = [10 ** (-1 + 7 * i / 31) for i in range(32)]


@query("alpha_sweep", f"""with {FOLDED}, T as (select k, split, min(x) as lo, max(x) as hi, avg(y1) as my, stddev_pop(y1) as sy from F, (select unnest(range(5)) as split) where fold <> split group by all),
Z as (select F.k, split, fold, (x - lo) / (hi - lo) as x, (y1 - my) / sy as y from F join T on T.k = F.k),
A as (select i, 10e0 ** (-1 + 7 * i / 31e0) as alpha from (select unnest(range(32)) as i)),
M as (select k, split, regr_sxy(y, x) as xy, regr_sxx(y, x) as xx, avg(x) as mx, avg(y) as my from Z where fold <> split group by all),
R as (select M.k, M.split, i, avg((w.w * x + M.my - w.w * mx - y) ** 2) as e, corr(x, y) * sign(any_value(w.w)) as r from M join A on true join Z on Z.k = M.k and Z.split = M.split and Z.fold = Z.split, lateral (select xy / (xx + alpha) as w) w group by all)
select cast(i as bigint) as i, {r('avg(r)')} as r, {r('stddev_pop(r)')} as sd, {r('avg(sqrt(e))')} as rmse from R group by i""")
def alpha_sweep(t: Tables) -> DataFrame:
    long = m.melt(folded(t).select("k", "fold", "x", "y1"), ["y1"])
    splits = m.with_training(m.pair_blocks(long, ["k", "channel"]), ["k", "channel"])
    each = splits.withColumn("at", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(a).alias("alpha")) for i, a in enumerate(ALPHAS)]))).select("*", "at.*")
    scores = m.univariate_scores(m.univariate_fit(each, F.col("alpha")))
    return scores.groupBy("i").agg(r6(F.avg("r")).alias("r"), r6(F.stddev_pop("r")).alias("sd"), r6(F.avg("rmse")).alias("rmse"))


_ALPHA_DET = "((aa + alpha) * (bb + alpha) - ab * ab)"


@query("alpha_sweep_wide", f"""with {WIDE}, A as (select cast(i as bigint) as i, 10e0 ** (-1 + 7 * i / 31e0) as alpha from (select unnest(range(32)) as i)),
E as (select k, channel, split, regr_sxx(a, a) as taa, regr_sxx(b, b) as tbb, regr_sxy(a, b) as tab, regr_sxy(y, a) as tay, regr_sxy(y, b) as tby, regr_sxx(y, y) as tyy from Z where fold = split group by all),
V as (select H.*, i, ((bb + alpha) * ay - ab * by_) / {_ALPHA_DET} as va, ((aa + alpha) * by_ - ab * ay) / {_ALPHA_DET} as vb from H, A),
R as (select i, channel, (va * tay + vb * tby) / sqrt((va * va * taa + 2 * va * vb * tab + vb * vb * tbb) * tyy) as r from V join E using (k, channel, split))
select i, channel, {r('avg(r)')} as r, {r('stddev_pop(r)')} as sd from R group by i, channel""")
def alpha_sweep_wide(t: Tables) -> DataFrame:
    """Two features, so that r depends on the penalty."""
    scores = wide(t, ALPHAS).withColumn("i", F.array_position(F.array(*map(F.lit, ALPHAS)), F.col("alpha")) - 1)
    return scores.groupBy("i", "channel").agg(r6(F.avg("r")).alias("r"), r6(F.stddev_pop("r")).alias("sd"))


@query("alpha_select", f"with {E}, A as (select k, 10e0 ** (t % 4) as alpha, avg(v) as r from E group by all), T as (select *, max(r) over (partition by k) as top from A) select k, max(alpha) as alpha from T where abs(top - r) < abs(0.1e0 * top) group by k")
def alpha_select(t: Tables) -> DataFrame:
    scores = t.e.groupBy("k", F.pow(F.lit(10.0), F.col("t") % 4).alias("alpha")).agg(F.avg("v").alias("r"))
    return m.alpha_select(scores, ["k"], 0.1)


_GRID = [(float(low), width / 2) for low in range(8, 1, -1) for width in range(1, 14)]
_GRID_TAPS = {(low, width): windowed_sinc(low, low + width, 32.0, 7) for low, width in _GRID}
_CELLS = "C as (select * from (values " + ", ".join(f"({low}e0, {width}e0, {i - 3}, {tap:.17e})" for (low, width), taps in _GRID_TAPS.items() for i, tap in enumerate(taps)) + ") c(low, width, d, tap))"


@query("band_grid_search", f"""with {E}, {_CELLS}, V as (select k, t, cast(state as double) as x, ntile(5) over (partition by k order by t) - 1 as fold, v from E),
Q as (select low, width, V.k, V.t, any_value(V.x) as x, any_value(V.fold) as fold, sum(coalesce(U.v, 0) * tap) as y from V cross join C left join V U on U.k = V.k and U.t = V.t - d group by low, width, V.k, V.t),
B as (select low, width, k, split, regr_sxy(y, x) filter (fold <> split) as c, corr(x, y) filter (fold = split) as r from Q, (select unnest(range(5)) as split) group by all),
G as (select low, width, avg(case when not isnan(r) and c <> 0 then sign(c) * r end) as r from B group by low, width), T as (select *, max(r) over () as top from G)
select low, width, {r('r')} as r, r = top as best, r >= 0.99 * top as close from T""")
def band_grid_search(t: Tables) -> DataFrame:
    """Each band of a grid: filter the response, fit and score lines by fold, and take the mean score."""
    rows = contiguous_folds(t.e.select("k", "t", F.col("state").cast("double").alias("x"), "v"), ["k"], 5)
    scores = m.band_grid_scores(rows, ["k"], "x", "v", _GRID_TAPS, ALPHA)
    best = m.grid_best(scores, ["band_low", "band_width"])
    return best.select(F.col("band_low").alias("low"), F.col("band_width").alias("width"), r6("r").alias("r"), "best", "close")


@query("alpha_lookup", f"with {E}, A as (select k, 10e0 ** (k % 4) as alpha from (select distinct k from E) where k % 3 <> 0) select E.k, t, coalesce(alpha, 1000.0e0) as alpha from E left join A on A.k = E.k")
def alpha_lookup(t: Tables) -> DataFrame:
    known = t.e.select("k").distinct().where("k % 3 <> 0").withColumn("alpha", F.pow(F.lit(10.0), F.col("k") % 4))
    return t.e.join(known, "k", "left").select("k", "t", F.coalesce("alpha", F.lit(1000.0)).alias("alpha"))


@query("best_lag_lookup", f"with {E}, B as (select label, t % 8 as lag, avg(v) as r from E group by all), A as (select label, arg_max(lag, r) as lag from B group by label) select E.k, E.t, E.label, E.v from E join A on A.label = E.label and E.t % 8 = A.lag")
def best_lag_lookup(t: Tables) -> DataFrame:
    e = t.e.withColumn("lag", F.col("t") % 8)
    best = e.groupBy("label", "lag").agg(F.avg("v").alias("r")).groupBy("label").agg(F.max_by("lag", "r").alias("lag"))
    return e.join(best, ["label", "lag"]).select("k", "t", "label", "v")


_PLACED = dealt_sql("D", "select distinct n from X", 3)


@query("permute_rows", f"with recursive {E}, X as (select k, t, v, row_number() over (partition by k order by t) - 1 as i, count(*) over (partition by k) as n from E), {_PLACED} select a.k, D.iter, a.t, b.v as v from X a join D on D.n = a.n and D.i = a.i and D.step > 0 and D.v < D.n join X b on b.k = a.k and b.i = D.v")
def permute_rows(t: Tables) -> DataFrame:
    return permuted(t.e.select("k", "t", "v"), ["k"], "v", 3).select("k", "iter", "t", F.col("v_permuted").alias("v"))


ITERATIONS = 100
#: Of permutation_null, as in the studies; the other nulls of the encoder take the first ITERATIONS.
ENCODER_ITERATIONS = 3000
#: Of the decoder, as in the studies; the smallest p is 1 / 201.
DECODER_ITERATIONS = 200


def null_sql(both: bool = False, decoder: bool = False, iterations: int = ITERATIONS) -> str:
    """CTEs up to N (k, channel, fold, iter, r, rmse): scores of weights that shuffled training rows give."""
    source = (_DECODED if decoder else WIDE).replace("with ", "", 1)
    channel, many = ("x", DECODER_ITERATIONS) if decoder else ("y1", iterations)

    def shuffle(rows: str, name: str) -> str:
        return f"""{name}I as (select k, channel, split, a, b, y, row_number() over o - 1 as i, count(*) over (partition by k, channel, split) as n from Z where fold {rows} split window o as (partition by k, channel, split order by t)),
{dealt_sql(name + 'D', f'select distinct n from {name}I', many)},
{name}X as (select O.k, O.channel, O.split, D.iter, regr_sxy(O.y, J.a) as ay, regr_sxy(O.y, J.b) as by_ from {name}I O join {name}D D on D.n = O.n and D.i = O.i and D.step > 0 and D.v < D.n join {name}I J on J.k = O.k and J.split = O.split and J.channel = '{channel}' and J.i = D.v group by all)"""

    det = "((aa + 5e0) * (bb + 5e0) - ab * ab)"
    test = "join QX on QX.k = V.k and QX.channel = V.channel and QX.split = V.split and QX.iter = V.iter" if both else ""
    ay, by = ("QX.ay", "QX.by_") if both else ("tay", "tby")
    return f"""{source}, {shuffle('<>', 'K')}{', ' + shuffle('=', 'Q') if both else ''},
D as (select k, channel, split, count(*) as tn, avg(a) as tma, avg(b) as tmb, avg(y) as tmy, regr_sxx(a, a) as taa, regr_sxx(b, b) as tbb, regr_sxy(a, b) as tab, regr_sxy(y, a) as tay, regr_sxy(y, b) as tby, regr_sxx(y, y) as tyy from Z where fold = split group by all),
V as (select H.k, H.channel, H.split, iter, ma, mb, my, ((bb + 5e0) * KX.ay - ab * KX.by_) / {det} as va, ((aa + 5e0) * KX.by_ - ab * KX.ay) / {det} as vb from H join KX on KX.k = H.k and KX.channel = H.channel and KX.split = H.split),
M as (select V.*, tn, tyy, {ay} * va + {by} * vb as cross_, va * va * taa + 2 * va * vb * tab + vb * vb * tbb as spread, va * (tma - ma) + vb * (tmb - mb) + my - tmy as off from V join D on D.k = V.k and D.channel = V.channel and D.split = V.split {test}),
N as (select k, channel, split as fold, iter, cross_ / sqrt(spread * tyy) as r, sqrt(greatest(spread - 2 * cross_ + tyy, 0) / tn + off * off) as rmse from M)"""


def null_scores(t: Tables, both: bool = False, iterations: int = ITERATIONS) -> DataFrame:
    return named(permutation_null(paired(t), ["k"], "xs", "ys", ALPHA, iterations, both), CHANNELS)


def null_arrays(t: Tables) -> DataFrame:
    """null_scores with an array of iterations."""
    return named(permutation_scores(paired(t), ["k"], "xs", "ys", ALPHA, ITERATIONS), CHANNELS)


@query("permutation_null", f"with recursive {null_sql(iterations=ENCODER_ITERATIONS)} select k, channel, fold, iter, {r('r')} as r, {r('rmse')} as rmse from N")
def permutation_null_query(t: Tables) -> DataFrame:
    return null_scores(t, iterations=ENCODER_ITERATIONS).select("k", "channel", "fold", "iter", r6("r").alias("r"), r6("rmse").alias("rmse"))


@query("permutation_null_both", f"with recursive {null_sql(True)} select k, channel, fold, iter, {r('r')} as r, {r('rmse')} as rmse from N")
def permutation_null_both(t: Tables) -> DataFrame:
    return null_scores(t, True).select("k", "channel", "fold", "iter", r6("r").alias("r"), r6("rmse").alias("rmse"))


@query("permutation_null_weights")
def permutation_null_weights(t: Tables) -> DataFrame:
    """Mean weights of the shuffled fits over folds; compared with rows in a test."""
    null = permutation_null(paired(t), ["k"], "xs", "ys", ALPHA, ITERATIONS, weights=True, mean=True)
    return named(null, CHANNELS).select("k", "channel", "iter", F.posexplode("w").alias("feature", "w")).withColumn("w", r6("w"))


def decoder_null(t: Tables) -> DataFrame:
    rows = folded(t).withColumn("_x", s.lagged("x", 1, s.by(["k"], "t"))).select("k", "t", "fold", F.array("y1", "y2").alias("xs"), F.array("_x").alias("ys"))
    return permutation_scores(rows, ["k"], "xs", "ys", ALPHA, DECODER_ITERATIONS, x_by="Standarize", y_by="Normalize")
