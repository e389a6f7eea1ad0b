"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees over the statistics of a text are grown on labelled rows; each path from a root is a
conjunctive rule. A logistic model with an L1 penalty (lasso) over the rules leaves few of them with a weight. The
rules and weights are compiled into one Spark column expression, so scoring is a projection.

Defined cases: null and empty texts have all counts 0 and get a score like any other; rows without a label, or with a
null one, only get scores; of several labels of one id the more frequent counts, on a tie none; repeated rows each count and get a row; ties in a statistic fall on the same side of a
threshold; with no labelled rows, or rows of one class only, the score is the (smoothed) share of label 1; extra
columns are ignored. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import stored
from graphspark.llm.stats import features, with_counts

#: The bound of the training sample: labelled rows that the trees see, at most.
MAX_ROWS = 20_000

Condition = tuple[str, bool, float]  # statistic, True for "above", threshold
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as a column over the statistics of features()."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            held = F.lit(True)
            for name, above, at in rule:
                held = held & ((F.col(name) > F.lit(at)) if above else (F.col(name) <= F.lit(at)))
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """The same in numpy; for tests."""
        total = np.full(len(next(iter(x.values()))), self.intercept)
        for rule, weight in self.rules:
            total += weight * held(rule, x)
        return 1 / (1 + np.exp(-total))


def held(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([(x[n] > at) if above else (x[n] <= at) for n, above, at in rule])


def grow_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int, depth: int, bins: int = 48, rate: float = 0.3, least: int = 20) -> list[Rule]:
    """The paths of boosted regression trees on the logistic loss, each once, in order of growth."""
    names = sorted(x)
    edges = {n: np.unique(np.quantile(x[n], np.linspace(0, 1, bins + 1)[1:-1])) for n in names}
    coded = {n: np.searchsorted(edges[n], x[n], side="left") for n in names}  # code c: above edge c - 1, at most edge c
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    f, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        level: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for d in range(depth + 1):
            nxt = []
            for path, at in level:
                best = (1e-3, "", 0)
                if d < depth and len(at) >= 2 * least:
                    gt, ht = g[at].sum(), h[at].sum()
                    for n in names:
                        if not len(edges[n]):
                            continue
                        c, k = coded[n][at], len(edges[n]) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(c, w, k))[:-1] for w in (g[at], h[at], None))
                        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                        gain[(nl < least) | (len(at) - nl < least)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), n, i)
                if not best[1]:
                    f[at] += rate * g[at].sum() / (h[at].sum() + 1)
                    continue
                n, i = best[1:]
                for above in (False, True):
                    side = at[(coded[n][at] > i) == above]
                    new = (*path, (n, above, float(edges[n][i])))
                    rules.setdefault(tuple(sorted(set(new))), None)
                    nxt.append((new, side))
            level = nxt
    return list(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean logistic loss + penalty * sum |w|, by accelerated proximal gradient."""
    n, k = a.shape
    a1 = np.column_stack([np.ones(n), a])
    v = np.ones(k + 1)
    for _ in range(30):  # largest eigenvalue of the Gram matrix
        v = a1.T @ (a1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (a1.T @ (a1 @ v)))
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        new = z - step * (a1.T @ (1 / (1 + np.exp(-(a1 @ z))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.0015) -> RuleModel:
    """Fit the ensemble on statistics x and labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = grow_rules(x, y.astype(float), trees, depth)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    b, w = lasso_logistic(np.column_stack([held(r, x) for r in rules]).astype(float), y.astype(float), penalty)
    return RuleModel(b, tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-9))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def score_quality(df: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row. Learns from at most max_rows labelled rows, those with
    the smallest hash of doc_id among the rows that aren't held out."""
    f = features()
    stats = stored(with_counts(df, id_col, text_col).select("doc_id", *[c.alias(k) for k, c in f.items()]), "statistics")
    marks = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("y")).where(~held_out() & F.col("y").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.avg("y").alias("y")).where("y <> 0.5").withColumn("y", F.round("y").cast("int"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    train = stats.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *f).limit(max_rows).toPandas()
    names = list(f)
    model = fit_rules({n: train[n].to_numpy(float) for n in names}, train["y"].to_numpy(int))
    return stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
