"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to column expressions.

Small trees are boosted on labelled rows; every path from a root to a node is a conjunctive rule over the statistics.
Logistic weights with a lasso penalty keep a few of the rules, and these become one built-in expression of the score, so
a corpus is scored by a single projection over its texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import unpacked

#: At most so many labelled rows are fitted, those whose ids hash lowest.
MAX_LABELS = 20_000
TREES, DEPTH, CUTS, SHRINK, THRESHOLD = 30, 3, 32, 0.3, 0.7
#: Lasso penalties that are tried, the largest first; the simplest ensemble within TOLERANCE of the best loss is taken.
PENALTIES, TOLERANCE = (0.03, 0.01, 0.003, 0.001), 0.003

#: Statistics of a text by name, as SQL over columns t (the text, not null) and w (its words).
STATISTICS: dict[str, str] = {
    "n_words": "cast(size(w) AS double)",
    "mean_word": "length(t) / greatest(size(w), 1.0D)",
    "distinct_words": "size(array_distinct(w)) / greatest(size(w), 1.0D)",
    "symbols": "regexp_count(t, '[#$%&*!@^~|<>{}\\\\[\\\\]=+_/]') / greatest(length(t), 1.0D)",
    "capitals": "regexp_count(t, '[A-Z]') / greatest(length(t), 1.0D)",
    "digits": "regexp_count(t, '[0-9]') / greatest(length(t), 1.0D)",
    "stops": "regexp_count(t, '[.,;:?]') / greatest(length(t), 1.0D)",
    "distinct_lines": "size(array_distinct(l)) / greatest(size(l), 1.0D)",
}


def statistics(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` columns, then the statistics of the whole text; a null text is an empty one."""
    t = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    names = t.columns[:-1]
    split = t.select(*names, "t", F.expr("filter(split(t, '[ \\\\t\\\\n\\\\r]+'), x -> x <> '')").alias("w"), F.expr("split(t, '\\\\n')").alias("l"))
    return split.select(*names, *[F.expr(f"cast({sql} AS double)").alias(name) for name, sql in STATISTICS.items()])


Condition = tuple[str, str, float]  # statistic, "<=" or ">", bound


@dataclass
class RuleModel:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, sign, bound in conditions:
                holds = holds & (F.col(name) <= bound if sign == "<=" else F.col(name) > bound)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list) -> np.ndarray:
    """Values of a regression tree on residuals g for ``rows``; the path of each node goes to ``out``."""
    value = np.full(len(rows), g[rows].mean())
    if depth == 0 or len(rows) < 20:
        return value
    best, total, n = (1e-9, None), g[rows].sum(), len(rows)
    for j, bounds in enumerate(cuts):
        if not len(bounds):
            continue
        at = np.searchsorted(bounds, x[rows, j], "left")  # x <= bounds[k] for k >= at
        left_n = np.cumsum(np.bincount(at, minlength=len(bounds) + 1))[:-1]
        left_g = np.cumsum(np.bincount(at, weights=g[rows], minlength=len(bounds) + 1))[:-1]
        ok = (left_n >= 5) & (left_n <= n - 5)
        gain = np.where(ok, left_g**2 / np.maximum(left_n, 1) + (total - left_g) ** 2 / np.maximum(n - left_n, 1) - total**2 / n, 0)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = gain[k], (j, float(bounds[k]))
    if best[1] is None:
        return value
    j, bound = best[1]
    left = x[rows, j] <= bound
    for side, sign in ((left, "<="), (~left, ">")):
        more = (*path, (j, sign, bound))
        out.append(more)
        value[side] = _grow(x, cuts, g, rows[side], more, depth - 1, out)
    return value


def _simplify(path: tuple) -> tuple:
    """One bound for each statistic and side."""
    kept: dict[tuple[int, str], float] = {}
    for j, sign, bound in path:
        old = kept.get((j, sign))
        kept[j, sign] = bound if old is None else min(old, bound) if sign == "<=" else max(old, bound)
    return tuple(sorted((j, s, b) for (j, s), b in kept.items()))


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, sign, bound in path:
        ok &= x[:, j] <= bound if sign == "<=" else x[:, j] > bound
    return ok


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Logistic weights of the 0/1 columns of r with an L1 penalty, by accelerated proximal gradient steps."""
    n = len(y)
    step = 4.0 / (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2 / n)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w = z = np.zeros(r.shape[1])
    b = c = float(np.log(mean / (1 - mean)))
    t = 1.0
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-(r @ z + c))) - y) / n
        v = z - step * (r.T @ e)
        v = np.sign(v) * np.maximum(np.abs(v) - step * penalty, 0)
        d = c - step * float(e.sum())
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, c = v + (t - 1) / u * (v - w), d + (t - 1) / u * (d - b)
        w, b, t = v, d, u
    return b, w


def _share(y: np.ndarray) -> RuleModel:
    share = (float(y.sum()) + 1) / (len(y) + 2)
    return RuleModel(float(np.log(share / (1 - share))), [])


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """The distinct paths of boosted trees on 0/1 labels, but for those that hold for the same rows, or for nearly none or all."""
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1]))
        cuts.append(q[q < x[:, j].max()])
    paths: list[tuple] = []
    f = np.zeros(len(y))
    for _ in range(TREES):
        g = y - 1 / (1 + np.exp(-f))
        f += SHRINK * 4 * _grow(x, cuts, g, np.arange(len(y)), (), DEPTH, paths)
    rules, seen = [], set()
    for p in dict.fromkeys(map(_simplify, paths)):
        holds = _holds(x, p)
        if holds.tobytes() not in seen and 0.002 < holds.mean() < 0.998:
            seen.add(holds.tobytes())
            rules.append(p)
    return rules


def _matrix(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    return np.stack([_holds(x, p) for p in rules], axis=1).astype(np.float64)


def choose_penalty(x: np.ndarray, y: np.ndarray) -> float:
    """The largest penalty whose loss on a fifth of the rows, which neither trees nor weights have seen, is near the least."""
    test = np.arange(len(y)) % 5 == 0
    rules = grow_rules(x[~test], y[~test])
    if not rules:
        return PENALTIES[0]
    seen, unseen = _matrix(x[~test], rules), _matrix(x[test], rules)
    losses = []
    for penalty in PENALTIES:
        b, w = _lasso(seen, y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(unseen @ w + b))), 1e-6, 1 - 1e-6)
        losses.append(-float(np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))))
    return next(p for loss, p in zip(losses, PENALTIES, strict=True) if loss <= min(losses) + TOLERANCE)


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """A rule model of 0/1 labels y; with fewer than 20 rows or one class alone, the smoothed share of label 1."""
    if len(y) < 20 or y.min() == y.max():
        return _share(y)
    rules = grow_rules(x, y)
    if not rules:
        return _share(y)
    b, w = _lasso(_matrix(x, rules), y, choose_penalty(x, y))
    kept = [(tuple((names[j], s, v) for j, s, v in rules[i]), float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-3).tolist()]
    return RuleModel(b, kept)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", usable: Column | None = None, limit: int = MAX_LABELS) -> RuleModel:
    """Fit on at most ``limit`` rows of ``labels`` (key, label), of those where ``usable`` holds; null labels are none.

    Statistics are those of whole texts. The rows are chosen by a hash of their key, whatever the order of the table.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if usable is not None:
        chosen = chosen.filter(usable)
    chosen = chosen.select(F.col(key).alias("k"), (F.col(label).cast("double") > 0.5).cast("double").alias("y")).orderBy(F.xxhash64("k"), "k", "y").limit(limit)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    rows = statistics(texts.join(F.broadcast(chosen), F.col("id") == F.col("k")), "t", F.col("k"), F.col("y")).collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=np.float64).reshape(len(rows), 2 + len(STATISTICS))
    order = np.random.default_rng(0).permutation(len(data))  # ids may carry an order; the split must not
    data = data[order]
    return fit(data[:, 2:], data[:, 1], list(STATISTICS))


def quality_scores(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) for each row of ``docs``: score from 0 to 1, predicted 1 if score >= threshold, else 0.

    A null or empty text has the statistics of one (all zero) and is scored like any other. Repeated rows and null keys
    come out as they come in; an empty table gives an empty one. Other columns are not read.
    """
    scored = statistics(docs, text, F.col(key).alias("k")).select("k", model.score().alias("score"))
    return scored.select(F.col("k").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns as they are."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    scored = statistics(rows, "text", F.col("row")).filter(model.score() >= threshold)
    return unpacked(scored.select("row"), docs.columns)
