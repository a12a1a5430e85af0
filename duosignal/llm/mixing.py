"""Mixing to target weights by soft membership, with DataFrame functions only.

A classifier of labelled documents gives every document posteriors over domains. Nonnegative rates
are then fitted so that the expected tokens of each domain meet their targets: projected-gradient
least squares, where a step needs a few sums over all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duosignal.llm.shared import first_by_hash, free_names, stored, table

TARGETS = {"high": 0.85, "low": 0.1, "toxic": 0.05}


def _share(chars: str) -> Column:
    """The part of the text that is of a class of characters, in twelve steps of rising width."""
    part = F.regexp_count("_text", F.lit(chars)) / F.greatest(F.char_length("_text"), F.lit(1))
    return F.floor(F.sqrt(part) * 12).cast("int")


def _features(docs: DataFrame, buckets: int, words: float) -> DataFrame:
    """(doc_id, h, g, n_tokens, feature, weight): different words by hash bucket, and text shape.

    The words of a document weigh ``words`` together, each shape feature 1. Feature -1 marks a row.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"), F.coalesce("text", F.lit("")).alias("_text"))
    own = own.withColumn("_all", F.array_remove(F.split(F.lower("_text"), "[\\x09-\\x0D\\x20]+"), ""))
    shape = {"symbol": _share("[#*$%&|<>]"), "digit": _share("[0-9]"), "upper": _share("[A-Z]"), "mark": _share("[.,;:!?]"), "line": _share("\n"), "long": F.least(F.floor(F.char_length("_text") / (F.size("_all") + 1)), F.lit(20)).cast("int"), "size": F.floor(F.log2(F.size("_all") + 1)).cast("int")}
    own = own.select("doc_id", "h", "g", F.size("_all").cast("long").alias("n_tokens"), F.array_distinct("_all").alias("_words"), F.array(*[F.concat(F.lit(f"{k} "), v.cast("string")) for k, v in shape.items()], F.lit("row")).alias("_shape"))
    own = own.withColumn("_n", F.size("_words")).select("doc_id", "h", "g", "n_tokens", "_n", F.posexplode(F.concat("_shape", "_words")).alias("_at", "_feature"))
    is_shape = F.col("_at") <= len(shape)
    bucket = F.pmod(F.xxhash64("_feature"), F.lit(buckets)).cast("int")
    feature = F.when(F.col("_at") == len(shape), F.lit(-1)).when(is_shape, bucket + buckets).otherwise(bucket)
    return own.select("doc_id", "h", "g", "n_tokens", feature.alias("feature"), F.when(is_shape, F.lit(1.0)).otherwise(words / F.col("_n")).alias("weight"))


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = 2000, buckets: int = 1 << 14, words: float = 12.0, prior: float = 20.0) -> DataFrame:
    """(doc_id, h, g, rows, n_tokens, p): each different row's tokens and posteriors over ``domains``.

    ``labelled`` has doc_id and domain. The classifier is a naive Bayes model of the presence of
    features (each domain's share drawn to the common one as by ``prior`` documents), fitted on at most ``sample`` labelled documents of each domain, taken in the order of
    a hash of doc_id; its table has 2 * ``buckets`` rows at most. Domains weigh as often as they are
    among all labels. rows counts equal rows. Labels of documents that are not in ``docs`` count nowhere.
    """
    present = stored(labelled.where(F.col("domain").isin(domains)).join(docs.select("doc_id"), "doc_id", "left_semi"), "present")
    chosen = stored(first_by_hash(present.select("doc_id", "domain"), "domain", sample), "chosen")
    tally = lambda rows: {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # noqa: E731  one row for each domain
    sizes, labels = tally(chosen), tally(present)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    seen = _features(known, buckets, words).select("doc_id", "feature").distinct().join(F.broadcast(chosen), "doc_id").where("feature >= 0")
    counts = seen.groupBy("feature").agg(*[F.sum((F.col("domain") == d).cast("int")).alias(f"c_{i}") for i, d in enumerate(domains)])
    common = (reduce(lambda a, b: a + b, [F.col(f"c_{i}") for i in range(len(domains))]) + 0.5) / (sum(sizes.values()) + 1.0)
    weights = stored(counts.select("feature", *[F.log((F.col(f"c_{i}") + common * prior) / (sizes.get(d, 0) + prior)).alias(f"w_{i}") for i, d in enumerate(domains)]), "weights")
    marks = docs.sparkSession.range(1).select(F.lit(-1).alias("feature"), *[F.lit(0.0).alias(f"w_{i}") for i in range(len(domains))])
    all_rows = _features(docs.select("doc_id", "text"), buckets, words).join(F.broadcast(weights.union(marks)), "feature")
    summed = all_rows.groupBy("doc_id", "h", "g").agg(F.max("n_tokens").alias("n_tokens"), F.sum((F.col("feature") == -1).cast("int")).alias("rows"), *[F.sum(F.col("weight") * F.col(f"w_{i}")).alias(f"s_{i}") for i in range(len(domains))])
    total = sum(labels.values()) + len(domains)
    score = summed.select("doc_id", "h", "g", "rows", "n_tokens", *[(F.col(f"s_{i}") / F.col("rows") + F.log(F.lit((labels.get(d, 0) + 1) / total))).alias(f"s_{i}") for i, d in enumerate(domains)])
    top = F.greatest(*[F.col(f"s_{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("s_0")
    raw = score.select("doc_id", "h", "g", "rows", "n_tokens", *[F.exp(F.col(f"s_{i}") - top).alias(f"e_{i}") for i in range(len(domains))])
    norm = reduce(lambda a, b: a + b, [F.col(f"e_{i}") for i in range(len(domains))])
    return raw.select("doc_id", "h", "g", "rows", "n_tokens", *[(F.col(f"e_{i}") / norm).alias(f"p_{i}") for i in range(len(domains))])


def _solved(m: list[list[float]], v: list[float]) -> list[float]:
    """The x of m x = v, m a small matrix, by Gauss-Jordan steps."""
    n = len(m)
    rows = [[*m[i], v[i]] for i in range(n)]
    for i in range(n):
        best = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[best] = rows[best], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [r[n] for r in rows]


def _dot(a: list[float], b: list[float]) -> float:
    return sum(x * y for x, y in zip(a, b, strict=True))


def fit_rates(members: DataFrame, targets: list[float], most: float | None = None, steps: int = 400, close: float = 1e-8, gain: float = 1e-12, ridges: tuple[float, ...] = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6, 1e-7)) -> tuple[list[float], list[float]]:
    """What makes the rates of ``with_rates``: (x, miss), a row's rate being 1 - p x between the bounds.

    miss is what the domains' expected tokens are off their targets, as shares of all tokens.

    Gradients are added up in x and projected on the bounds only for the rates (lazy projected
    gradient). A gradient is p' M e with the residuals e and a metric M; M comes from the rows that
    are not at a bound, so a step has the size that meets the targets if none of them reaches one,
    and is cut until the concave dual grows. A weight on the distance of rates from 1 (``ridges``, in
    falling order, each from the last one's x) makes the answer unique and holds x where targets are
    out of reach. A weight is done with when the dual's gradient is below ``close`` of all tokens or
    a step promises less than the share ``gain``; the last one ends with residuals of about 1e-7 x
    (targets in reach) or at the least weighed squares. Only some sums over all documents come to the
    driver, none larger than the square of the number of domains.
    """
    k = len(targets)
    p = [F.col(f"p_{i}") for i in range(k)]
    tokens = F.col("rows") * F.col("n_tokens")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = members.agg(F.sum(tokens).alias("n"), *[F.sum(tokens * p[i] * p[j]).alias(f"m_{i}_{j}") for i, j in pairs]).first()
    if not sums["n"]:
        return [0.0] * k, [0.0] * k
    scale = float(sums["n"])
    goal, n = [t / scale for t in targets], tokens / scale

    def square(row, name: str) -> list[list[float]]:
        return [[row[f"{name}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]

    metric = [[v / scale for v in r] for r in square(sums, "m")]
    floor = 1e-6 * sum(metric[i][i] for i in range(k)) / k
    metric = [[v + (floor if i == j else 0.0) for j, v in enumerate(r)] for i, r in enumerate(metric)]

    def at(x: list[float]) -> tuple[list[float], list[list[float]], float]:
        """Residuals, the metric's inverse and the dual at x."""
        push, rate, free = _rate(p, x, most)
        row = members.agg(
            F.sum(n * ((rate - 1) * (rate - 1) / 2 + rate * push)).alias("dual"), *[F.sum(n * rate * p[i]).alias(f"t_{i}") for i in range(k)],
            *[F.sum(F.when(free, n * p[i] * p[j]).otherwise(0.0)).alias(f"h_{i}_{j}") for i, j in pairs],
        ).first()
        return [row[f"t_{i}"] - goal[i] for i in range(k)], square(row, "h"), row["dual"] - _dot(x, goal)

    x, turn = [0.0] * k, 0
    e, h, dual = at(x)
    for ridge in ridges:
        while turn < steps:
            held = [ridge * _dot(r, x) for r in metric]
            slope = [a - b for a, b in zip(e, held, strict=True)]
            if max(map(abs, slope)) < close:
                break
            step = _solved([[a + ridge * b for a, b in zip(r, m, strict=True)] for r, m in zip(h, metric, strict=True)], slope)
            now, size = dual - _dot(x, held) / 2, 1.0
            if _dot(slope, step) <= gain * abs(now):
                break
            while True:
                y = [a + size * b for a, b in zip(x, step, strict=True)]
                turn += 1
                found = at(y)
                better = found[2] - ridge * _dot(y, [_dot(r, y) for r in metric]) / 2
                if better >= now + 1e-4 * size * _dot(slope, step) or size < 1e-9:
                    break
                size /= 4
            if better <= now:
                break
            x, (e, h, dual) = y, found
        if max(map(abs, e)) < close:
            break
    return x, e


def _rate(p: list[Column], x: list[float], most: float | None) -> tuple[Column, Column, Column]:
    """(p x, the rate, whether it is not at a bound)."""
    push = reduce(lambda a, b: a + b, [c * v for c, v in zip(p, x, strict=True)])
    rate = F.greatest(F.lit(0.0), F.lit(1.0) - push)
    free = push < 1
    return (push, rate, free) if most is None else (push, F.least(F.lit(float(most)), rate), free & (push > 1 - most))


def with_rates(members: DataFrame, targets: list[float], most: float | None = None, **fitting) -> DataFrame:
    """``members`` (rows, n_tokens, p_0 ...) with the ``rate`` of each row.

    Least squares of the domains' expected tokens against ``targets`` over rates between 0 and
    ``most``, residuals weighed by the inverse of sum n p p'. Where rates exist that meet the targets,
    they are those nearest to 1.
    """
    x, _ = fit_rates(members, targets, most, **fitting)
    return members.withColumn("rate", _rate([F.col(f"p_{i}") for i in range(len(targets))], x, most)[1])


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], size: float | str = 1.0, most: float | None = None, **classifier) -> DataFrame:
    """(doc_id, h, g, n_tokens, p_<domain> ..., miss_<domain> ..., rate, copies) for each different row of ``docs``.

    ``targets`` are the domains' weights; their token totals are these shares of ``size`` times all
    tokens (words between ASCII white space). If ``size`` is a domain's name, its expected tokens are
    its share, so it is used up; then no domain is asked for more than it is expected to have. miss_<domain> is how far the fitted rates
    leave its expected tokens off that, as a share of all tokens. copies is the rate, rounded up or down by a hash of
    the row so that it is met on average. Equal rows have one result. Null text: no tokens, a
    posterior by its shape. Labels of unknown documents, other domains or null are left out; with
    none at all every posterior is even. No rows: no rows. Further columns are ignored.
    """
    domains = sorted(targets)
    members = stored(posteriors(docs, labelled, domains, **classifier), "members")
    n = F.col("rows") * F.col("n_tokens")
    total, *held = members.agg(F.sum(n), *[F.sum(n * F.col(f"p_{i}")) for i in range(len(domains))]).first()  # one sum for each domain
    whole = sum(targets.values())
    asked = {d: targets[d] / whole * (total or 0) for d in domains}
    if isinstance(size, str):
        have = {d: h or 0.0 for d, h in zip(domains, held, strict=True)}
        asked = {d: min(have[d], targets[d] / targets[size] * have[size]) for d in domains}
    else:
        asked = {d: n * size for d, n in asked.items()}
    x, miss = fit_rates(members, [asked[d] for d in domains], most)
    p = [F.col(f"p_{i}") for i in range(len(domains))]
    out = members.select("doc_id", "h", "g", "n_tokens", *[c.alias(f"p_{d}") for c, d in zip(p, domains, strict=True)], *[F.lit(m).alias(f"miss_{d}") for m, d in zip(miss, domains, strict=True)], _rate(p, x, most)[1].alias("rate"))
    chance = F.pmod(F.xxhash64("doc_id", "h", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels table: toxic, else high or low by quality."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    return one.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """``docs`` with each row as often as its copies say, with their columns whatever their names."""
    row, h, g, n, copy = free_names(docs, "row", "h", "g", "copies", "copy")
    rates = mixed(docs, labelled, targets, **options).where("copies > 0").select(F.col("doc_id").alias(row), F.col("h").alias(h), F.col("g").alias(g), F.col("copies").cast("int").alias(n))
    here = docs.join(rates, docs.doc_id.eqNullSafe(F.col(row)) & (F.xxhash64("text") == F.col(h)) & (F.hash("text") == F.col(g)))
    return here.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*docs.columns)


def op6_mixing_weights(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS).drop("h", "g")
