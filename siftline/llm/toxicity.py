"""Toxic passages by maximum-scoring segments with extreme-value calibration.

Fit. A bounded sample of labelled documents (``sample`` a class, by hash of id)
is counted by documents that hold each word. A word's score is its log odds
between toxic and other documents under an informative Dirichlet prior that
weighs ``prior`` of the sample. It is drawn towards 0 as its evidence (Chernoff's
bound of how its documents fall to the classes) nears what ``chance`` words of
the vocabulary reach by luck: few labels give lower scores, not none. Every word
pays ``drift``, so a document's expected score is negative.

Scan. All maximal-scoring segments of a document (Ruzzo and Tompa) are found in
linear time; between scored words only the sum matters, so long texts cost
little. A segment of score S in m words has the E value K m exp(-lambda S):
lambda solves sum p exp(lambda s) = 1 over the other documents' words, K is
its maximum-likelihood value over their best segments. Both are taken out of
sample: the labelled documents are split into ``FOLDS`` parts by hash, and each
part is measured by scores fit on the others. A document's p value
combines its r best segments by the Poisson sum statistic, at the r where it is
least, halved for each r. Documents at or below ``alpha`` are toxic.

Cases: null and empty texts, and texts without words, have no passages. Rows are
scanned as often as they occur; ids may be null. Words are runs of letters,
digits, underscores and non-ASCII bytes, ASCII case folded. Copies and near
copies of a text count once in the fit; several labels of an id count as toxic if any is.
Labels of one class only, none at all, or labels whose words don't tell the
classes apart even after the prior: nothing can be learned, no document is
toxic, and a warning says so. A small set of labels of both classes is fit like
a large one. Ties between segments keep the text's order. Further columns are
ignored.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import kernels as K
from siftline.plans.scratch import cut

SAMPLE, PRIOR, CHANCE, DRIFT, ALPHA = 10_000, 0.05, 1.0, 0.05, 0.01
FOLDS = 5
OUT = "doc_id long, start_word int, end_word int, score double, e_value double, doc_p double"


def _words(batch, column: str = "text"):
    """(i, j, token hashes, first token of each document) for pieces of a batch."""
    buf, off = K.utf8(batch.column(column))
    for i, j in K.runs(off):
        b = K.LOWER[buf[off[i] : off[j]]]
        s, e, first = K.tokens(b, off[i : j + 1] - off[i], K.WORD)
        yield i, j, K.token_hash(b, s, e), first


def _frequencies(batches):
    """(toxic, fold, text) → (word, fold, documents that hold it, by class)."""
    np.seterr(over="ignore")
    parts = []
    for batch in batches:
        toxic, fold = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
        for i, j, h, first in _words(batch):
            doc = np.repeat(np.arange(j - i), np.diff(first))
            key = np.stack([doc, (h >> K.U(1)).view(np.int64)], 1)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key = key[order]
            key = key[np.r_[True, (key[1:] != key[:-1]).any(1)]] if len(key) else key
            parts.append((key[:, 1], fold[i:j][key[:, 0]], toxic[i:j][key[:, 0]].astype(np.int64)))
    if not parts:
        return
    w, f, t = (np.concatenate(x) for x in zip(*parts))
    for k in range(FOLDS):
        mine = f == k
        u, back = np.unique(w[mine], return_inverse=True)
        n = [np.bincount(back, weights=x, minlength=len(u)).astype(np.int64) for x in (t[mine], 1 - t[mine])]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.full(len(u), k, np.int32)), *map(pa.array, n)], names=["word", "fold", "toxic", "other"])


_MINS = 3


def _min_shingles(batches):
    """(label, text) → + a hash of the text and the least hashes of its word pairs, by three orders."""
    np.seterr(over="ignore")
    for batch in batches:
        least = np.zeros((_MINS, batch.num_rows), np.int64)
        for i, j, h, first in _words(batch):
            nxt = np.r_[h[1:], K.U(0)]
            nxt[first[1:][np.diff(first) > 0] - 1] = 0
            two = K.pair(h, nxt)
            some = np.flatnonzero(np.diff(first))
            for m in range(_MINS):
                if len(some):
                    least[m, i + some] = np.minimum.reduceat(K.mix(two + K.U(m)), first[:-1][some]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("text"), *map(pa.array, least)], names=["label", "text", *(f"m{k}" for k in range(_MINS))])


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(label, fold, text) of at most ``sample`` labelled documents a class.

    Copies and near copies count once, or every word of a toxic text with many
    copies would look toxic: texts that agree in the least of their word pairs
    are merged, by three orders in turn; a group is toxic if any of it is.
    """
    one = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    one = one.groupBy("id").agg(F.max("label").alias("label"))
    parts = [one.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    some = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample rows
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    mins = ", ".join(f"m{k} long" for k in range(_MINS))
    rows = text.join(some, "id").where("text is not null").select("label", "text").mapInArrow(_min_shingles, f"label int, text string, {mins}")
    rows = cut(rows.withColumn("h", F.xxhash64("text", "label")), "labelled")
    left = rows.drop("text")
    for k in range(_MINS):
        best = F.max(F.struct("label", "h", *(f"m{j}" for j in range(_MINS))))
        left = left.groupBy(F.col(f"m{k}").alias("m")).agg(best.alias("b")).select("b.*")
    kept = F.broadcast(left.select("h").distinct())  # at most 2 * sample rows
    return rows.join(kept, "h", "left_semi").dropDuplicates(["h"]).select("label", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "text")


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log odds of words with these counts, under a Dirichlet prior in proportion to the mean of their rates in both classes.

    The prior weighs ``prior`` of each class, so the share of toxic documents
    among the labels doesn't shift the odds.
    """
    n, m = toxic.sum(), other.sum()
    rate = prior * (toxic / n + other / m) / 2
    x, y = toxic / n + rate, other / m + rate
    return np.log(x / (1 + prior - x)) - np.log(y / (1 + prior - y))


def evidence(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Chernoff's bound of -ln P that a word's occurrences fall so far to one class by chance."""
    q, n = toxic.sum() / (toxic.sum() + other.sum()), toxic + other
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(toxic > 0, toxic * np.log(toxic / (n * q)), 0) + np.where(other > 0, other * np.log(other / (n * (1 - q))), 0)
    return np.maximum(out, 0)


def word_scores(toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR, chance: float = CHANCE) -> np.ndarray:
    """Log odds, drawn towards 0 by the share of a word's evidence that ``chance`` in as many words would give."""
    out, some = np.zeros(len(toxic)), (toxic + other) > 0
    if toxic.sum() and other.sum():
        e = evidence(toxic[some], other[some])
        out[some] = log_odds(toxic[some], other[some], prior) * np.maximum(0, 1 - np.log(some.sum() / chance) / np.maximum(e, 1e-9))
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in order.

    Ruzzo and Tompa's algorithm in linear time: each kept segment links to the
    nearest one before it whose sum before is less, and a new segment looks for
    its own along those links instead of walking the list.
    """
    total = 0.0
    start, end, before, after, link = [], [], [], [], []
    for i, s in enumerate(scores.tolist()):
        if s <= 0:
            total += s
            continue
        a, x = i, total
        total += s
        j = len(start) - 1
        while True:
            while j >= 0 and before[j] >= x:
                j = link[j]
            if j < 0 or after[j] >= total:
                break
            a, x, nxt = start[j], before[j], link[j]
            del start[j:], end[j:], before[j:], after[j:], link[j:]
            j = nxt
        start.append(a)
        end.append(i + 1)
        before.append(x)
        after.append(total)
        link.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(start, end, before, after)]


def _scan_doc(h: np.ndarray, words: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """Segments of a document's token hashes; tokens between scored ones only add their drift."""
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    hit = np.flatnonzero(words[at] == h)
    s = score[at[hit]]
    if not (s > drift).any():
        return []
    where, value = [], []
    before = np.diff(hit, prepend=-1) - 1
    for p, gap, x in zip(hit.tolist(), before.tolist(), s.tolist()):
        if gap:
            where.append(p - gap)
            value.append(-drift * gap)
        where.append(p)
        value.append(x - drift)
    got = segments(np.array(value))
    return [(where[a], where[b - 1] + 1, v) for a, b, v in got]


def solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """Positive root of sum p exp(lambda s) = 1, for a negative mean and some s > 0."""
    lo, hi = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    while f(hi) < 0:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def sum_p(scores: list[float], lam: float, k: float, m: int) -> float:
    """p value of a document by its r best segments, at the best r; each r halves it."""
    best, total, fact = 1.0, 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += s
        fact += math.log(r) + (math.log(r - 1) if r > 1 else 0.0)
        x = lam * total - r * math.log(max(k * m, 1e-300))
        if r == 1:
            p = -math.expm1(-min(math.exp(min(-x, 50)), 50))
        else:
            p = math.exp(min(0.0, -x + (r - 1) * math.log(x) - fact)) if x > r else 1.0
        best = min(best, p * 2**r)
    return min(1.0, best)


def _maxima(words, scores, drift):
    """Other documents of the sample → (words, best score), each by the scores that its own part didn't enter."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            fold, m, best = batch.column("fold").to_numpy(), [], []
            for i, j, h, first in _words(batch):
                h = (h >> K.U(1)).view(np.int64)
                for k in range(j - i):
                    d = h[first[k] : first[k + 1]]
                    m.append(len(d))
                    best.append(max([0.0, *(x for *_, x in _scan_doc(d, words, scores[fold[i + k]], drift))]))
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(best, pa.float64())], names=["m", "best"])

    return run


class Fit:
    """Scored words, and lambda and K of their extreme values."""

    def __init__(self, words, score, drift, lam, k):
        self.words, self.score, self.drift, self.lam, self.k = words, score, drift, lam, k


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, prior: float = PRIOR, chance: float = CHANCE, drift: float = DRIFT,
) -> Fit | None:
    some = cut(sampled(docs, labels, id_col, text_col, label_col, sample), "sample")
    counted = some.select(F.col("label").alias("toxic"), "fold", "text").mapInArrow(_frequencies, "word long, fold int, toxic long, other long")
    t = counted.groupBy("word", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()  # words of a sample of bounded size
    words, at = np.unique(t["word"].to_numpy(), return_inverse=True)
    by_fold = np.zeros((2, FOLDS, len(words)))
    for k, c in enumerate(("toxic", "other")):
        by_fold[k, t["fold"].to_numpy(), at] = t[c].to_numpy()
    toxic, other = by_fold.sum(1)
    score = word_scores(toxic, other, prior, chance) if len(words) else np.zeros(0)
    if not (score > drift).any():
        warnings.warn("the labels don't tell toxic words from others; no document will be found toxic", stacklevel=2)
        return None
    cross = np.stack([word_scores(*(by_fold.sum(1) - by_fold[:, k]), prior, chance) for k in range(FOLDS)])
    keep = (score != 0) | (cross != 0).any(0)
    words, score, cross = words[keep], score[keep], cross[:, keep]
    n = by_fold[1].sum()
    p, s = (by_fold[1][:, keep] / n).ravel(), cross.ravel()
    p, s = np.r_[p, max(0.0, 1 - p.sum())], np.r_[s, 0.0]
    if (p * (s - drift)).sum() >= 0:
        drift += float((p * (s - drift)).sum()) + DRIFT
    if not (s[p > 0] > drift).any():  # no other document scores out of sample: by all scores, and half a document a word
        p = (other[keep] + 0.5) / (n + 0.5 * keep.sum())
        p, s = np.r_[p, max(0.0, 1 - p.sum())], np.r_[score, 0.0]
    lam = solve_lambda(p, s - drift)
    clean = some.where("label = 0").mapInArrow(_maxima(words, cross, drift), "m long, best double").where("m > 0")
    r = clean.agg(F.count("*").alias("n"), F.sum(F.col("m") * F.exp(-lam * F.col("best"))).alias("x")).first()
    return Fit(words, score, drift, lam, r.n / r.x if r.x else 1.0)


def _scan(model: Fit, alpha: float):
    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            rows = []
            for i, j, h, first in _words(batch):
                h = (h >> K.U(1)).view(np.int64)
                at = np.searchsorted(model.words, h)
                at[at == len(model.words)] = 0
                hot = np.flatnonzero((model.words[at] == h) & (model.score[at] > model.drift))
                for k in np.unique(np.searchsorted(first, hot, "right") - 1):
                    d = h[first[k] : first[k + 1]]
                    got = _scan_doc(d, model.words, model.score, model.drift)
                    p = sum_p([x for *_, x in got], model.lam, model.k, len(d))
                    if p > alpha:
                        continue
                    top = max(x for *_, x in got)
                    for a, b, x in got:
                        e = model.k * len(d) * math.exp(-model.lam * x)
                        if e <= 1 or x == top:
                            rows.append((i + k, a, b, x, e, p))
            if rows:
                r, a, b, x, e, p = map(np.array, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(r)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(x), pa.array(e), pa.array(p)],
                    names=["doc_id", "start_word", "end_word", "score", "e_value", "doc_p"],
                )

    return run


def passages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, **how) -> DataFrame:
    """Passages of the toxic documents: words from start to end (exclusive), score, E value, the document's p value."""
    model = fit(docs, labels, id_col, text_col, **how)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if model is None:
        return docs.sparkSession.createDataFrame([], OUT)
    return rows.mapInArrow(_scan(model, alpha), OUT)
