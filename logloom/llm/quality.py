"""Quality rules by robust multivariate outliers, DataFrame operations only.

Word statistics of each text become a vector of four transformed values.  For
each language and source the minimum-covariance-determinant estimate is found
by concentration steps: the three quarters of the vectors that are nearest in
Mahalanobis distance give the next mean and covariance, until the determinant
no longer falls.  A text is rejected if its distance is beyond the cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Fixed values of the contract: white space between words, and symbol characters.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
FEATURES = ("x_length", "x_symbols", "x_lines", "x_repeats")
#: Least spread of each value: differences below it are never called outliers.
FLOORS = (0.06, 0.05, 0.15, 0.15)
#: Share of the vectors that an estimate rests on, steps at most, vectors that a group needs.
SHARE, STEPS, LEAST = 0.75, 12, 50
#: Groups up to which estimates are broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 10_000


def chi2_cdf(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi2_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, freedom) < p else (low, mid)
    return high


def base_statistics(documents: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep``, then word statistics of the whole text (null: no words)."""
    body = F.coalesce(documents[text].cast("string"), F.lit(""))
    split = documents.select(*keep, body.alias("__t"), F.array_remove(F.split(F.translate(body, SPACES, " " * len(SPACES)), " "), "").alias("__w"))
    n = F.size("__w")
    windows = F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice("__w", i, 8)))).otherwise(F.array().cast("array<bigint>"))
    names = [c for c in split.columns if c not in ("__t", "__w")]
    filled = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    one = split.select(
        *names,
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        filled.alias("__l"),
        windows.alias("__h"),
    )
    # Windows in hash order; those equal to a neighbour are the repeated ones, and their starts in order give the words covered.
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    two = one.withColumn("__s", F.when(repeated, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    nxt = F.slice("__s", F.lit(2), F.greatest(F.size("__s"), F.lit(1)))
    three = two.withColumn("__m", F.zip_with("__s", nxt, lambda a, b: F.struct(a["i"].alias("i"), (a["h"].eqNullSafe(b["h"])).alias("n"))))
    previous = F.concat(F.array(F.lit(False)), F.transform("__m", lambda x: x["n"]))
    four = three.withColumn("__p", F.sort_array(F.array_compact(F.zip_with("__m", previous, lambda a, p: F.when(a["n"] | p, a["i"])))))
    later = F.slice("__p", F.lit(2), F.greatest(F.size("__p"), F.lit(1)))
    covered = F.aggregate(F.zip_with("__p", later, lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8)))), F.lit(0), lambda s, x: s + x)
    return four.select(
        *names,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def features(stats: DataFrame) -> DataFrame:
    """Transformed values; additions to the denominators keep short texts near the middle."""
    return stats.select(
        "*",
        F.log((F.col("word_chars") + 300.0) / (F.col("n_words") + 50.0)).alias("x_length"),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 200.0)).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)).alias("x_lines"),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50.0)).alias("x_repeats"),
    )


def _with_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    small = params.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(params) if small else params, "g")


def _cholesky(params: DataFrame) -> DataFrame:
    """Add the lower factor of the covariance ``s_i_j`` and the log of its determinant."""
    p = len(FEATURES)
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"s_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}"))
    return params.withColumn("logdet", sum(2 * F.log(f"l_{i}_{i}") for i in range(p)))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, name in enumerate(FEATURES):
        value = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * z[k]
        z.append(value / F.col(f"l_{i}_{i}"))
    return sum(v * v for v in z)


def _estimate(rows: DataFrame, factor: float) -> DataFrame:
    p = len(FEATURES)
    means = [F.avg(name).alias(f"m_{i}") for i, name in enumerate(FEATURES)]
    covs = [F.coalesce(F.covar_pop(FEATURES[i], FEATURES[j]), F.lit(0.0)).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy("g").agg(*means, *covs)
    return _cholesky(out.select("g", *[f"m_{i}" for i in range(p)], *[(F.col(f"s_{i}_{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]))


def outlier_bounds(vectors: DataFrame) -> DataFrame:
    """Estimates by group ``g``: mean and Cholesky factor, one row for each group of ``vectors``."""
    p = len(FEATURES)
    factor = SHARE / chi2_cdf(chi2_quantile(SHARE, p), p + 2)  # so that normal data get their own covariance
    middle = vectors.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m_{i}") for i, x in enumerate(FEATURES)])
    spread = _with_params(vectors, cut_lineage(middle)).groupBy("g").agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)], *[(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 10_000) * 1.4826).alias(f"d_{i}") for i, x in enumerate(FEATURES)])
    params = cut_lineage(_cholesky(spread.select("g", *[f"m_{i}" for i in range(p)], *[(F.pow(F.col(f"d_{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])))
    last = None
    for _ in range(STEPS):
        near = _with_params(vectors, params).withColumn("d2", _distance()).select("g", *FEATURES, "d2")
        cuts = cut_lineage(near.groupBy("g").agg(F.percentile_approx("d2", SHARE, 10_000).alias("cut")))
        params = cut_lineage(_estimate(_with_params(near, cuts).where("d2 <= cut"), factor))
        total = params.agg(F.sum("logdet")).first()[0] or 0.0
        if last is not None and last - total < 1e-3 * max(1.0, abs(last)):
            break
        last = total
    return params


def quality(documents: DataFrame, cutoff: float = 0.99999, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Word statistics and verdict of every row.

    ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance``.  ``kept`` is false if the base rules fail,
    else whether the squared distance is within the chi-squared quantile
    ``cutoff``.  Estimates rest on all rows that pass the base rules.  Groups
    of fewer than 50 such rows are pooled within their language, and what is
    then still small over all languages.  Null languages and sources are groups
    of their own; a null text has no words and so fails the base rules; null
    keys and repeated rows are judged row by row; an empty table gives no rows;
    other columns are not read.
    """
    raw = base_statistics(documents, [documents[key].alias("key"), F.coalesce(documents[lang].cast("string"), F.lit("")).alias("l"), F.coalesce(documents[source].cast("string"), F.lit("")).alias("s")], text)
    stats = cut_lineage(features(raw))
    sizes = stats.where("not base_failed").groupBy("l", "s").agg(F.count(F.lit(1)).alias("n"))
    rest = sizes.where(F.col("n") < LEAST).groupBy("l").agg(F.sum("n").alias("n_l"))
    named = cut_lineage(sizes.join(rest, "l", "left").select("l", "s", F.when(F.col("n") >= LEAST, F.concat_ws("\x1f", F.lit("s"), "l", "s")).when(F.col("n_l") >= LEAST, F.concat_ws("\x1f", F.lit("l"), "l")).otherwise("all").alias("g")))
    small = named.count() <= BROADCAST_GROUPS
    grouped = stats.join(F.broadcast(named) if small else named, ["l", "s"], "left")
    fit = cut_lineage(grouped.where("not base_failed").select("g", *FEATURES))
    params = outlier_bounds(fit)
    judged = grouped.join(F.broadcast(params) if small else params, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance") <= chi2_quantile(cutoff, len(FEATURES)), F.lit(True)))
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
