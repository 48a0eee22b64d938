"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of a text are Spark expressions. On a bounded sample of labelled
documents (``sample`` rows by hash of id), boosted shallow trees over binned
statistics give paths; every node's path is a conjunctive rule. Logistic
weights with a lasso penalty pick few rules, and these are compiled into one
Spark column: documents are scored without Python.

Cases: null texts, and texts that are empty or white space, are rejected. Rows
are judged each on its own; ids may be null. Several labels of an id count as
bad if any is. Without labels of both classes every other document stays.
A probability of exactly ``threshold`` stays. Further columns are kept by
:func:`accept`; columns that clash with statistics don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, TREES, LEVELS, LASSO, THRESHOLD, SEED = 8000, 30, 3, 0.003, 0.5, 5


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; 0 where a denominator is 0."""
    n = F.length(text).cast("double")
    words = F.regexp_count(text, F.lit(r"\S+")).cast("double")
    parts = F.split(text, r"\s+")
    lines = (n - F.length(F.replace(text, F.lit("\n"), F.lit("")))) + 1

    def share(x: Column, of: Column) -> Column:
        return F.coalesce(F.when(of > 0, x / of), F.lit(0.0)).cast("double")

    return {
        "chars": F.coalesce(F.log1p(n), F.lit(0.0)),
        "word_length": share(n, words),
        "upper": share(F.regexp_count(text, F.lit("[A-ZÀ-ÖØ-Þ]")), n),
        "digits": share(F.regexp_count(text, F.lit("[0-9]")), n),
        "marks": share(F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")), n),
        "signs": share(F.regexp_count(text, F.lit(r"[!#$%&*+<=>@^|~]")), n),
        "distinct": share(F.size(F.array_distinct(parts)), words),
        "line_length": share(n, lines),
    }


def grow(x: np.ndarray, g: np.ndarray, w: np.ndarray, rows: np.ndarray, levels: int, bins: int, least: int, path=()):
    """Leaf values and paths of a tree by greedy squared-loss splits; x holds bin numbers."""
    value = g[rows].sum() / max(w[rows].sum(), 1e-9)
    if not levels or len(rows) < 2 * least:
        return [(path, value)], []
    best = (1e-9, None)
    base = g[rows].sum() ** 2 / max(w[rows].sum(), 1e-9)
    for f in range(x.shape[1]):
        gs = np.bincount(x[rows, f], weights=g[rows], minlength=bins).cumsum()[:-1]
        ws = np.bincount(x[rows, f], weights=w[rows], minlength=bins).cumsum()[:-1]
        ns = np.bincount(x[rows, f], minlength=bins).cumsum()[:-1]
        ok = (ns >= least) & (len(rows) - ns >= least)
        gain = np.where(ok, gs**2 / np.maximum(ws, 1e-9) + (g[rows].sum() - gs) ** 2 / np.maximum(w[rows].sum() - ws, 1e-9) - base, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (f, k))
    if best[1] is None:
        return [(path, value)], []
    f, k = best[1]
    leaves, rules = [], []
    for side in (0, 1):
        p = (*path, (f, k, side))
        part = rows[(x[rows, f] > k) == bool(side)]
        a, b = grow(x, g, w, part, levels - 1, bins, least, p)
        leaves += a
        rules += [p, *b]
    return leaves, rules


def _holds(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, k, side in rule:
        out &= (x[:, f] > k) == bool(side)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty * |weights|, by accelerated proximal steps."""
    n, m = r.shape
    a = np.c_[np.ones(n), r].astype(np.float64)
    v = np.ones(m + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / n * 1.05)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -50, 50))) - y) / n
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


class Rules:
    """Intercept and [(weight, [(statistic, bound, above)])]."""

    def __init__(self, intercept: float, rules: list):
        self.intercept, self.rules = intercept, rules

    def probability(self, stats: dict[str, Column]) -> Column:
        """The rules as one column over columns of the statistics."""
        total = F.lit(self.intercept)
        for w, conditions in self.rules:
            holds = None
            for name, bound, above in conditions:
                c = stats[name] > bound if above else stats[name] <= bound
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def learn(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, levels: int = LEVELS, penalty: float = LASSO, bins: int = 32, seed: int = SEED) -> Rules | None:
    """Rules of labelled statistics; None unless both classes occur."""
    if len(y) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    base = np.log(y.mean() / (1 - y.mean()))
    raw, found = np.full(len(y), base), {}
    least = max(5, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        some = np.sort(rng.choice(len(y), max(2, len(y) // 2), replace=False))
        leaves, rules = grow(b, y - p, p * (1 - p), some, levels, bins, least)
        for path, value in leaves:
            raw[_holds(b, path)] += 0.3 * np.clip(value, -4, 4)
        for rule in rules:
            found.setdefault(_holds(b, rule).tobytes(), rule)
    rules = list(found.values())
    if not rules:
        return None
    r = np.stack([_holds(b, rule) for rule in rules], 1).astype(np.float64)
    intercept, w = lasso_logistic(r, y, penalty)
    kept = [
        (float(w[j]), [(names[f], float(cuts[f][k]), bool(side)) for f, k, side in rules[j]])
        for j in np.argsort(-np.abs(w), kind="stable")
        if abs(w[j]) > 1e-3
    ]
    return Rules(intercept, kept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, **how) -> Rules | None:
    """Rules learnt from at most ``sample`` labelled documents."""
    one = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    one = one.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    got = text.join(F.broadcast(one), "id").where("text is not null")  # at most ``sample`` labels
    stats = statistics(F.col("text"))
    t = got.select("id", "y", *(c.alias(k) for k, c in stats.items())).toPandas()  # bounded by the sample
    t = t.sort_values(["id", *stats]).head(sample)
    return learn(t[list(stats)].to_numpy(np.float64), t["y"].to_numpy(np.float64), list(stats), **how)


_STATS = "__siftline_stats"


def _kept(docs: DataFrame, rules: Rules | None, text_col: str, threshold: float) -> tuple[DataFrame, Column]:
    """The accepted rows, with the statistics in ``_STATS``, and their probability as a column over these.

    A generator carries the statistics, so that a filter on the probability is
    not pushed below them and each is computed once a row.
    """
    t = F.col(f"`{text_col}`").cast("string")
    some = docs.where(t.rlike(r"\S"))
    if rules is None:
        return some, F.lit(1.0)
    used = {name for _, conditions in rules.rules for name, *_ in conditions} | {"chars"}
    stats = F.struct(*(c.alias(k) for k, c in statistics(t).items() if k in used))
    p = rules.probability({k: F.col(f"{_STATS}.{k}") for k in used})
    return some.select("*", F.explode(F.array(stats)).alias(_STATS)).where(p >= threshold), p


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """The documents of good quality, with all their columns."""
    return _kept(docs, fit(docs, labels, id_col, text_col, **how), text_col, threshold)[0].drop(_STATS)


def qualities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, quality) of the documents of good quality."""
    some, p = _kept(docs, fit(docs, labels, id_col, text_col, **how), text_col, threshold)
    return some.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), p.alias("quality"))
