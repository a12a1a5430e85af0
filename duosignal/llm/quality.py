"""Quality rules: text statistics and robust multivariate outliers, with DataFrame functions only.

The statistics come from array functions inside each row. Their transformed vectors are judged per
language and source by a minimum-covariance-determinant estimate: concentration steps keep the 75 %
of a group with the smallest Mahalanobis distances and take mean and covariance anew. A step is one
join with the groups' estimates and one grouped sum by distance bin, so no group meets in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duosignal.llm.shared import fitting, free_names, stored, table

WHITE = " \t\n\x0b\x0c\r"
VECTOR = ["v_word", "v_symbol", "v_line", "v_repeat", "v_size"]
#: Added to the variances: a share that is 0 for most documents has no spread of its own. A twentieth of symbols is
#: an outlier by itself; of lines, the third that labels of clean documents show is not.
FLOOR = {"v_word": 0.05, "v_symbol": 0.05, "v_line": 0.13, "v_repeat": 0.12, "v_size": 0.5}
D = len(VECTOR)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``.

    Null texts count as empty. Words are runs without ASCII white space.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.char_length(text)
    out = docs.withColumn("_words", F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, WHITE, "")) > 0))
    five = F.transform(F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(5)]))
    out = out.withColumn("_grams", F.when(F.size("_words") >= 5, five))
    doubled = F.size(F.array_distinct("_grams")) < F.size("_grams")
    out = out.withColumn("_sorted", F.when(doubled, F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda s, i, k: F.coalesce(F.get("_sorted", i + k)["g"] == s["g"], F.lit(False))
    at = F.filter(F.transform("_sorted", lambda s, i: F.when(same(s, i, -1) | same(s, i, 1), s["i"])), lambda x: x.isNotNull())
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate(F.sort_array(at), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (size - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("_words", "_lines", "_grams", "_sorted")


def transformed() -> dict[str, Column]:
    """The vector that outliers are judged by: shares by square root, sizes by logarithm."""
    n = F.greatest("n_words", F.lit(1))
    return {
        "v_word": F.log(F.col("word_chars") / n + 1),
        "v_symbol": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "v_line": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "v_repeat": F.sqrt(F.col("n_repeat_words") / n),
        "v_size": F.log(n),
    }


def chi2_cdf(x: float, d: int) -> float:
    """Of the chi-squared distribution with d degrees of freedom, by the recurrence over d."""
    p = math.erf(math.sqrt(x / 2)) if d % 2 else 1 - math.exp(-x / 2)
    for k in range(1 if d % 2 else 2, d, 2):
        p -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return p


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return low


def _consistency(share: float) -> float:
    """What the covariance of the inner ``share`` of a normal sample is multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, D), D + 2)


def _factor(estimates: DataFrame) -> DataFrame:
    """(g, m_i, k_i_j): means and inverse covariances, by way of the Cholesky factor l and its inverse e.

    One select whose columns refer to those before them, so the plan is analysed once.
    """
    columns = {}
    for i, j in sorted(PAIRS, key=lambda p: (p[1], p[0])):
        rest = " - ".join([f"c_{i}_{j}", *(f"l_{i}_{k} * l_{j}_{k}" for k in range(j))])
        columns[f"l_{i}_{j}"] = f"sqrt(greatest({rest}, 1e-6D))" if i == j else f"({rest}) / l_{j}_{j}"
    for i, j in sorted(PAIRS, key=lambda p: (p[1], p[0])):
        columns[f"e_{i}_{j}"] = f"1D / l_{i}_{i}" if i == j else f"-({' + '.join(f'l_{i}_{k} * e_{k}_{j}' for k in range(j, i))}) / l_{i}_{i}"
    columns |= {f"k_{i}_{j}": " + ".join(f"e_{k}_{i} * e_{k}_{j}" for k in range(i, D)) for i, j in PAIRS}
    whole = estimates.selectExpr("*", *[f"{x} as {c}" for c, x in columns.items()])
    return whole.select("g", *[f"m_{i}" for i in range(D)], *[f"k_{i}_{j}" for i, j in PAIRS])


def _distance(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance. ``factors`` is a stored table, a row for each group.

    It is broadcast behind a count: else rows could be dealt by g before it shows how small it is.
    """
    at = [f"({v} - m_{i})" for i, v in enumerate(VECTOR)]
    d2 = " + ".join(f"{'' if i == j else '2D * '}k_{i}_{j} * {at[i]} * {at[j]}" for i, j in PAIRS)
    return rows.join(fitting(factors), "g").selectExpr(*rows.columns, f"{d2} as d2")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    own = [F.sum(v).alias(f"s_{i}") for i, v in enumerate(VECTOR)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *own, *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"s_{i}_{j}") for i, j in PAIRS])


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    mean = lambda i: F.col(f"s_{i}") / F.col("n")
    floor = lambda i, j: FLOOR[VECTOR[i]] ** 2 if i == j else 0.0
    return moments.select("g", *[mean(i).alias(f"m_{i}") for i in range(D)], *[((F.col(f"s_{i}_{j}") / F.col("n") - mean(i) * mean(j)) * factor + floor(i, j)).alias(f"c_{i}_{j}") for i, j in PAIRS])


def _concentrate(rows: DataFrame, factors: DataFrame, share: float) -> DataFrame:
    """One C-step: moments of the nearest ``share`` of each group, to the precision of a bin.

    Bins are summed map-side and by (g, bin); of a group a few hundred are left whatever its size.
    """
    sums = [f"s_{i}" for i in range(D)] + [f"s_{i}_{j}" for i, j in PAIRS]
    bins = _moments(_distance(rows, factors).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 16)), ["g", "bin"])
    # Another name for g: else what is not yet summed by bin would be dealt by g alone.
    bins = bins.select(F.concat("g", F.lit("")).alias("g"), "bin", "n", *sums)
    order = Window.partitionBy("g").orderBy("bin")
    near = bins.withColumns({"before": F.sum("n").over(order) - F.col("n"), "all": F.sum("n").over(Window.partitionBy("g"))})
    near = near.where(F.col("before") < F.col("all") * share).groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in sums])
    return _factor(_estimates(near, _consistency(share)))


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """Adds g: language and source, or what pools those of fewer than ``least`` rows."""
    both = rows.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    both = both.withColumn("_rest", F.sum(F.when(F.col("_n") < least, F.col("_n"))).over(Window.partitionBy("lang")))
    name = F.when(F.col("_n") >= least, F.to_json(F.array(F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))))).when(F.col("_rest") >= least, F.to_json(F.array(F.coalesce("lang", F.lit("\0"))))).otherwise("")
    both = fitting(stored(both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), name.alias("g")), "groups"))
    return rows.join(both, rows.lang.eqNullSafe(F.col("_lang")) & rows.source.eqNullSafe(F.col("_source"))).drop("_lang", "_source")


def quality(docs: DataFrame, least: int = 50, share: float = 0.75, steps: int = 4, tail: float = 1e-3) -> DataFrame:
    """The five statistics, base_failed, distance and kept for each row of ``docs``.

    ``docs`` has doc_id, text, lang and source; further columns are ignored. A row is kept unless
    n_words < 10, or 100 * n_repeat_words > 20 * n_words, or its squared distance from its group's
    estimate exceeds the chi-squared quantile of 1 - ``tail``. Rows that fail the base rules take no
    part in the estimates. Groups of under ``least`` rows are pooled by language, then altogether;
    a pool of fewer rows is judged by the estimate of all rows. If there are fewer than ``least``
    in all, none is rejected (distance null). ``share`` is the part that a
    concentration step keeps, ``steps`` their number. distance is given for rejected rows alone.

    Null text: no words, fails. Null lang or source: a group like any other. Repeated rows and ties
    are judged alike. No rows: no rows. row_key is a fingerprint of the row, to join verdicts by.
    """
    base = docs.select("doc_id", "text", "lang", "source", F.xxhash64("doc_id", "lang", "source", "text").alias("row_key"))
    rows = text_statistics(base).drop("text").withColumns(transformed())
    rows = stored(rows.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)), "statistics")
    sound = _grouped(rows.where(~F.col("base_failed")), least)
    sound = stored(sound, "sound")
    basis = sound
    if 0 < sound.where("g = ''").limit(least).count() < least:
        basis = sound.where("g <> ''").unionByName(sound.withColumn("g", F.lit("")))
    middle = basis.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, v in enumerate(VECTOR)]).where(F.col("n") >= least)
    spread = lambda i: F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(2)) + FLOOR[VECTOR[i]] ** 2
    start = middle.select("g", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(D)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS])
    factors = stored(_factor(start), "factors")
    for _ in range(steps):
        factors = stored(_concentrate(basis, factors, share), "factors")
    near = _distance(basis, factors).where(F.col("d2") <= chi2_quantile(0.975, D))
    factors = stored(_factor(_estimates(_moments(near, ["g"]), _consistency(0.975))), "factors")
    judged = _distance(sound, factors).where(F.col("d2") > chi2_quantile(1 - tail, D)).select("doc_id", "row_key", "d2").distinct()
    far = judged.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("d2").alias("distance"))
    out = rows.join(far, rows.doc_id.eqNullSafe(far["_id"]) & (rows.row_key == far["_key"]), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("distance").isNull()).alias("kept"), "distance", "row_key")


def keep_good(docs: DataFrame, judge: Callable[[DataFrame], DataFrame] = quality) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns whatever their names."""
    row, key, own = free_names(docs, "row", "key", "own")
    bad = judge(docs).where("not kept").select(F.col("doc_id").alias(row), F.col("row_key").alias(key)).distinct()
    here = docs.withColumn(own, F.xxhash64("doc_id", "lang", "source", "text"))
    return here.join(bad, here.doc_id.eqNullSafe(F.col(row)) & (F.col(own) == F.col(key)), "left_anti").select(*docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("row_key")
