"""End-to-end studies as compositions of operators; every arrow between steps is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.operators import ridge, stats
from duosignal.operators.folds import contiguous_folds
from duosignal.operators.information import gcmi_cc
from duosignal.operators.series import lag_matrix, melt_lags
from duosignal.operators.spectral import analytic_signal, plv


def encoding_study(series: DataFrame, keys: list[str], stimulus: str, responses: list[str], alpha: float, k: int = 5) -> DataFrame:
    """Mean weight, correlation and error over folds of each response: scaling, lines, scores in one pass."""
    scores = ridge.encode(contiguous_folds(series, keys, k), keys, stimulus, responses, alpha)
    return scores.groupBy(*keys, "channel").agg(*[F.avg(c).alias(c) for c in ("w", "r", "rmse")])


def receptive_field_study(series: DataFrame, keys: list[str], stimulus: str, responses: list[str], delays: list[int], alphas: list[float], k: int = 5, limit: float = 0.01) -> DataFrame:
    """Lagged models: the penalty chosen per key by cross-validated correlation, and the weights it gives."""
    lagged = lag_matrix(contiguous_folds(series, keys, k), keys, [stimulus], delays)
    rows = lagged.select(*keys, "fold", F.array(*[f"x_{stimulus}_{j}" for j in range(len(delays))]).alias("xs"), F.array(*responses).alias("ys"))
    scores = ridge.encode_wide(rows, keys, "xs", "ys", len(delays), alphas, x_by=None, y_by=None).groupBy(*keys, "alpha").agg(F.avg("r").alias("r"))
    chosen = ridge.alpha_select(scores, keys, limit)
    fits = ridge.fit_wide(ridge.gram(rows, keys, "xs", "ys"), keys, len(delays), alphas, x_by=None, y_by=None)
    return ridge.weights_long(fits.join(chosen, [*keys, "alpha"], "left_semi"), [*keys, "alpha"])


def significance_study(scores: DataFrame, null: DataFrame, keys: list[str], fold: str = "fold", limit: float = 0.05, tests: int = 128) -> DataFrame:
    """Keys whose permutation p is below limit / tests in every fold."""
    p = stats.permutation_p(scores, null, [*keys, fold], "r")
    return stats.passes_all_folds(p, keys, limit / tests)


def synchrony_study(series: DataFrame, keys: list[str], x: str, y: str, delays: list[int], t: str = "t") -> DataFrame:
    """Phase locking and copula information of two signals at each delay; phases are taken once."""
    a = analytic_signal(series, keys, x, t).select(*keys, t, F.col("phase").alias("_x"))
    b = analytic_signal(series, keys, y, t).select(*keys, t, F.col("phase").alias("_y"))
    long = melt_lags(a.join(b, [*keys, t]), keys, "_x", delays, t)
    locked = long.groupBy(*keys, "delay").agg(plv(F.col("_x_lagged") - F.col("_y")).alias("plv"))
    shared = gcmi_cc(melt_lags(series, keys, x, delays, t), [*keys, "delay"], f"{x}_lagged", y, t).select(*keys, "delay", "mi")
    return locked.join(shared, [*keys, "delay"])
