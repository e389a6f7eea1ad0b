"""Quality rules: fixed base rules, and robust multivariate outliers by the minimum covariance determinant.

For each language and source, location and scatter of a vector of transformed statistics are estimated by
concentration steps: the rows with the smallest distances (a share `core` of the group) give the next mean and
covariance. Three starts (median and MAD; the shortest half's middle and length; mean and deviation) take two steps
each, the one with the smallest determinant goes on for `steps` more. A row is rejected whose squared Mahalanobis
distance exceeds the number of statistics over `beyond`: by Chebyshev's inequality at most that share of any population,
whatever its tails, lies farther out. (Chi-square's 0.999 point, 22 for six statistics, holds for normal data only: of
the texts labelled good on sf0.01 the farthest has 47, of those labelled bad the median is beyond 1,000.)
Every row takes part in the estimates; each step is one aggregation over a fixed number of distance bins, so
a group of any size, also one with a third of all rows, is summed on the map side and meets in a bounded number of rows.

Rates of short texts are shrunk towards the table's own median rates, so that a few words are no outlier by chance.

Defined cases: a null or empty text has all counts 0 and fails the base rule on n_words; null lang or source form
groups of their own; a group of fewer than `least` rows is judged by its language, a language of fewer by all rows,
and those estimates come from all rows of the language or table, also of groups that have their own;
constant statistics get a floor of variance, so ties don't make the scatter singular; repeated rows count each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import size_checked, stored
from graphspark.llm.stats import COUNTS, features, usual_rates, with_counts

VECTOR = ("word_length", "symbols", "upper", "punct", "top_word", "short")
#: Standard deviation that is added in quadrature to each statistic.
FLOOR = 0.05
_BINS = 512
_GRID, _MOST = 256, 64.0


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _chi2_cdf(x: float, df: float) -> float:
    """By the series of the lower incomplete gamma function."""
    a, x = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-12:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def consistency(core: float, dims: int) -> float:
    """What the covariance of the central share `core` of normal data must be multiplied with."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, dims) < core else (lo, mid)
    return core / _chi2_cdf(lo, dims + 2)


_PARAMS = "grp string, start int, logdet double, mu array<double>, inv array<double>"
STARTS, FIRST_STEPS = 3, 2


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    """The starts of a group from the histograms of its statistics: rows (grp, dim, bin, n)."""
    mu, spread = np.zeros((STARTS, len(VECTOR))), np.zeros((STARTS, len(VECTOR)))
    for d in range(len(VECTOR)):
        part = pdf[pdf["dim"] == d].sort_values("bin")
        v, n = part["bin"].to_numpy() / _GRID, part["n"].to_numpy()
        upto = np.cumsum(n)
        middle = v[np.searchsorted(upto, n.sum() / 2)]
        order = np.argsort(abs(v - middle), kind="stable")
        mad = abs(v - middle)[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
        # the shortest stretch of bins with half of the rows
        ends = np.searchsorted(upto, upto - n + n.sum() / 2)
        fits = ends < len(v)
        width = np.where(fits, v[np.minimum(ends, len(v) - 1)] - v, np.inf)
        best = int(width.argmin())
        mean = (v * n).sum() / n.sum()
        mu[:, d] = middle, v[best] + width[best] / 2, mean
        spread[:, d] = 1.4826 * mad, 1.4826 * width[best] / 2, math.sqrt(((v - mean) ** 2 * n).sum() / n.sum())
    var = spread**2 + FLOOR**2
    return pd.DataFrame({"grp": pdf["grp"].iloc[0], "start": range(STARTS), "logdet": np.log(var).sum(1), "mu": mu.tolist(), "inv": [np.diag(1 / x).ravel().tolist() for x in var]})


def _step(core: float):  # noqa: ANN202
    scale, dims = consistency(core, len(VECTOR)), len(VECTOR)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Mean and covariance of the rows in the nearest bins: rows (grp, start, bin, n, sums, products)."""
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy()
        upto = int(np.searchsorted(np.cumsum(n), core * n.sum())) + 1
        m = n[:upto].sum()
        mu = np.stack(pdf["s"].to_numpy()[:upto]).sum(0) / m
        prod = np.zeros((dims, dims))
        prod[np.triu_indices(dims)] = np.stack(pdf["q"].to_numpy()[:upto]).sum(0) / m
        cov = (prod + np.triu(prod, 1).T - np.outer(mu, mu)) * scale + np.eye(dims) * FLOOR**2
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "start": [pdf["start"].iloc[0]], "logdet": [np.linalg.slogdet(cov)[1]], "mu": [mu.tolist()], "inv": [np.linalg.inv(cov).ravel().tolist()]})

    return run


def _distance() -> Column:
    d = len(VECTOR)
    off = [F.col("z")[i] - F.col("mu")[i] for i in range(d)]
    return sum((off[i] * off[j] * F.col("inv")[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)), F.lit(0.0))


def _levels() -> tuple[Column, Column, Column]:
    """Names of the groups that a row is in: language and source, language, all. No two levels share a name."""
    pair, every = F.struct("lang", "source"), {"ignoreNullFields": "false"}
    fine = F.when(F.col("source").isNull() & F.col("lang").isNotNull(), F.to_json(pair, every)).otherwise(F.to_json(pair))
    return fine, F.to_json(F.struct("lang"), every), F.lit("all")


def grouped(stats: DataFrame, least: int) -> DataFrame:
    """stats with grp: language and source, or the language, or all, whichever first has `least` rows."""
    fine, coarse, every = _levels()
    sizes = stats.where(~base_failed()).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_fine"))
    per_lang = sizes.groupBy("lang").agg(F.sum("n_fine").alias("n_lang"))
    names = sizes.alias("a").join(per_lang.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang"))).select(F.col("a.lang").alias("g_lang"), F.col("a.source").alias("g_source"), "n_fine", "n_lang")
    named = stats.join(size_checked(stored(names, "groups")), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return named.withColumn("grp", F.when(F.col("n_fine") >= least, fine).when(F.col("n_lang") >= least, coarse).otherwise(every)).drop("g_lang", "g_source", "n_fine", "n_lang")


def estimates(stats: DataFrame, core: float, steps: int) -> DataFrame:
    """grp, mean and inverse covariance, from the rows that the base rules keep. Each row counts in its language and
    source, its language and the whole, as far as some row is judged by them."""
    ok = stats.where(~base_failed())
    used = size_checked(stored(ok.select("grp").distinct(), "levels"))
    ok = ok.select("z", F.explode(F.array(*_levels())).alias("grp")).join(used, "grp", "left_semi")
    d = len(VECTOR)
    hist = ok.select("grp", F.posexplode("z").alias("dim", "v")).groupBy("grp", "dim", F.round(F.least("v", F.lit(_MOST)) * _GRID).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    params = stored(hist.groupBy("grp").applyInPandas(_start, _PARAMS), "estimates")
    # numbered sums in a fixed order of magnitude: rounding to 1e-9 makes them independent of the tasks' order
    fixed = lambda c: F.sum(c.cast("decimal(28,9)")).cast("double")
    for k in range(FIRST_STEPS + steps):
        if k == FIRST_STEPS:
            best = params.groupBy("grp").agg(F.min_by(F.struct("start", "logdet", "mu", "inv"), F.struct("logdet", "start")).alias("b"))
            params = best.select("grp", "b.*")
        near = ok.join(size_checked(params), "grp").withColumn("bin", F.least(F.lit(_BINS - 1), F.floor(F.log2(1 + F.greatest(_distance(), F.lit(0.0))) * 20)).cast("int"))
        sums = near.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *[fixed(F.col("z")[i]).alias(f"s{i}") for i in range(d)], *[fixed(F.col("z")[i] * F.col("z")[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)])
        sums = sums.select("grp", "start", "bin", "n", F.array(*[f"s{i}" for i in range(d)]).alias("s"), F.array(*[f"q{i}_{j}" for i in range(d) for j in range(i, d)]).alias("q"))
        params = stored(sums.groupBy("grp", "start").applyInPandas(_step(core), _PARAMS), "estimates")
    return params.select("grp", "mu", "inv")


def _vectors(counts: DataFrame) -> DataFrame:
    f = features(usual_rates(counts, VECTOR))
    return counts.withColumn("z", F.array(*[f[k] for k in VECTOR]))


def judge(df: DataFrame, core: float = 0.75, beyond: float = 0.05, steps: int = 2, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared Mahalanobis; null if no estimate) and kept of each row."""
    rows = df.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in df.columns})
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("lang", "source")})
    counts = stored(with_counts(rows, id_col, text_col, ("lang", "source")), "counts")
    stats = grouped(_vectors(counts), least)
    found = stats.join(size_checked(estimates(stats, core, steps)), "grp", "left").withColumn("distance", F.when(~base_failed(), _distance()))
    return found.select("doc_id", *COUNTS, "lang", "source", base_failed().alias("base_failed"), "distance", (~base_failed() & F.coalesce(F.col("distance") <= len(VECTOR) / beyond, F.lit(True))).alias("kept"))


def keep_good(df: DataFrame, **options: float) -> DataFrame:
    """The rows of df that judge() keeps; rows with a null id stay, rows that share an id share the verdict."""
    bad = stored(judge(df, **options).where(~F.col("kept")).select("doc_id").where("doc_id is not null").distinct(), "rejected")
    return df.join(size_checked(bad), "doc_id", "left_anti")


def brute_distances(z: np.ndarray, core: float, steps: int) -> np.ndarray:
    """Squared distances of one group by the same estimate without bins; for tests."""
    mu = np.median(z, 0)
    cov = np.diag((1.4826 * np.median(abs(z - mu), 0)) ** 2 + FLOOR**2)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(cov), z - mu)
        near = np.argsort(d, kind="stable")[: int(np.ceil(core * len(z)))]
        mu = z[near].mean(0)
        cov = np.cov(z[near].T, bias=True) * consistency(core, z.shape[1]) + np.eye(z.shape[1]) * FLOOR**2
    return np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(cov), z - mu)
