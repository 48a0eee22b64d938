"""Packing documents into windows by non-negative least squares over their lengths.

Lengths are counted in words between white space and put into ``bins`` classes,
each rounded up. Texts longer than a window are cut into full windows and a
rest, so nothing is lost. All combinations of up to ``depth`` classes that fill
a window exactly are enumerated; non-negative least squares finds how often
each is to be used so that the histogram of lengths is met; the solution is
rounded, cut back where it asks for more than there is, and what is left over is
packed greedily, longest first. All of this runs on the histogram of at most
``bins`` numbers. Rows find their pack by their rank within their class: ranks
are counted within hashed slices of a class and shifted by the slices before, so
no class is ranked by one task alone.

Cases: null and empty texts, and texts of white space, have no words and no
pack. Rows are packed as often as they occur; ids may be null. Ties of length
are ordered by (id, text hash, window). Further columns are ignored. An empty
table has no packs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.identity import identity
from siftline.plans.scratch import cut

WINDOW, BINS, DEPTH = 2048, 128, 3
#: Rows of a slice of a length class that one task ranks.
SLICE = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\x0B\f]+"))


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``depth`` classes that sum to ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, parts: tuple[int, ...]) -> None:
        if not left:
            out.append(parts)
        elif len(parts) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(parts)) < left:
                    break
                grow(left - x, x, (*parts, x))

    grow(bins, bins, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min |ax - b|, x ≥ 0, on the normal equations."""
    n = a.shape[1]
    gram, rhs = a.T @ a, a.T @ b
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n):
        gain = rhs - gram[:, passive] @ x[passive]
        gain[passive] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            try:
                z = np.linalg.solve(gram[np.ix_(at, at)], rhs[at])
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > tol).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= tol
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            passive[at[x[at] <= tol]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(hist: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """[(classes of a pack, number of such packs)] that uses up ``hist`` (hist[k]: pieces of class k + 1)."""
    bins = len(hist)
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if not left.sum():
        return out
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for k, c in enumerate(combos):
        for x in c:
            a[x - 1, k] += 1
    scale = float(left.max())
    ask = np.rint(nnls(a, left / scale) * scale).astype(np.int64)
    for k in np.argsort(-ask, kind="stable"):
        c = combos[k]
        n = min([int(ask[k]), *(int(left[x - 1]) // c.count(x) for x in c)])
        if n > 0:
            out.append((c, n))
            for x in c:
                left[x - 1] -= n
    while left.any():
        parts, room = [], bins
        avail = left.copy()
        for x in range(bins, 0, -1):
            while x <= room and avail[x - 1]:
                parts.append(x)
                avail[x - 1] -= 1
                room -= x
        n = min(int(left[x - 1]) // parts.count(x) for x in set(parts))
        out.append((tuple(parts), n))
        for x in parts:
            left[x - 1] -= n
    return out


def allotments(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, first pack, first slot, pieces a pack) rows of a plan."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for parts, n in packs:
        slot = 0
        for x in sorted(set(parts), reverse=True):
            m = parts.count(x)
            at = rank.get(x, 0)
            rows.append((x, at, at + n * m, base, slot, m))
            rank[x] = at + n * m
            slot += m
        base += n
    return rows


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    bins: int = BINS,
    depth: int = DEPTH,
    length: Column | None = None,
) -> DataFrame:
    """(pack_id, slot, offset, doc_id, piece, start_word, n_words): where each piece of each document lies.

    ``length``: words of a document, if not those of its text.
    """
    if window % bins:
        raise ValueError("bins must divide window")
    spark, step = docs.sparkSession, window // bins
    i, th, t = identity(id_col, text_col)
    n = F.coalesce(words(t) if length is None else length, F.lit(0)).cast("long")
    lengths = cut(docs.select(i.alias("id"), th.alias("th"), n.alias("n")).where("n > 0"), "lengths")
    full, rest = F.floor(F.col("n") / window), F.col("n") % window
    hist = np.zeros(bins, np.int64)
    for r in lengths.groupBy(F.ceil(rest / step).alias("k")).agg(F.count("*").alias("c"), F.sum(full).alias("f")).collect():  # at most bins rows
        hist[bins - 1] += r.f
        if r.k:
            hist[r.k - 1] += r.c
    rows = allotments(plan(hist, depth))
    slices = max(1, int(hist.max()) // SLICE)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / window)))
    pieces = (
        lengths.select("id", "th", "n", piece.alias("piece"))
        .select("id", "th", "piece", F.least(F.col("n") - F.col("piece") * window, F.lit(window)).alias("words"))
        .withColumns({"k": F.ceil(F.col("words") / step).cast("int"), "slice": F.pmod(F.xxhash64("id", "th", "piece"), F.lit(slices)).cast("int")})
    )
    own = Window.partitionBy("k", "slice")
    order = own.orderBy(F.col("id").asc_nulls_last(), "th", "piece")
    before = (
        pieces.groupBy("k", "slice").agg(F.count("*").alias("c"))
        .withColumn("before", F.sum("c").over(Window.partitionBy("k").orderBy("slice")) - F.col("c"))
        .select("k", "slice", "before")
    )
    ranked = pieces.withColumn("r", F.row_number().over(order) - 1).join(before, ["k", "slice"]).withColumn("r", F.col("r") + F.col("before"))
    where = spark.createDataFrame(rows, "k int, lo long, hi long, base long, slot0 int, m int")  # as many rows as the plan has parts, whatever the data
    placed = ranked.join(F.broadcast(where), "k").where("r >= lo and r < hi")
    placed = placed.select(
        (F.col("base") + F.floor((F.col("r") - F.col("lo")) / F.col("m"))).alias("pack_id"),
        (F.col("slot0") + (F.col("r") - F.col("lo")) % F.col("m")).cast("int").alias("slot"),
        "id", "piece", "words",
    )
    in_pack = Window.partitionBy("pack_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "pack_id",
        "slot",
        (F.sum("words").over(in_pack) - F.col("words")).alias("offset"),
        F.col("id").alias("doc_id"),
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * window).alias("start_word"),
        F.col("words").alias("n_words"),
    )
