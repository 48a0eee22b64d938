"""Exact-passage dedup over a corpus by bucket-pointer refinement.

Suffixes start at words (runs between ASCII white space) and count up to
``length`` words deep: two suffixes whose first ``length`` words agree are a
repeat. Refinement goes as in a bucket-pointer suffix sort. The initial bucket
of a suffix is its q-gram. A bucket is refined by the bucket identifiers at
later offsets: the identifier at depth 2h is the pair of those at depth h of the
suffix itself and of the suffix h words later, so every level reuses the update
before it, up to the full depth. Identifiers are 64-bit names instead of ranks;
hence the pointer of a later offset is known where the text lies.

Buckets with one member are final. To find the others cheaply, each window of
``length`` words is filed under its least q-gram, the leftmost of equals: equal
windows have equal least q-grams at equal offsets. Only those anchors (about 2
in ``length - q + 2`` words) are shuffled at first. Anchors alone in their bucket
drop out, and only the windows filed under the rest are refined, each bucket
sorted by document and offset: the first window of a kind stays, and the words
of every later one are a repeat.

Cases: null and empty texts, and texts of fewer than ``length`` words, have no
repeats. Rows that agree in id and text are one document, a null id orders
last, and the least (id, text hash, offset) is the first. A passage repeated
within one document counts too. Long texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import kernels as K
from siftline.llm.identity import KEY, TH, identified, keyed
from siftline.plans.scratch import cut, release

LENGTH, Q = 50, 8
_NULL = np.iinfo(np.int64).max


def _deeper(level: dict, depth: int) -> np.ndarray:
    """Bucket identifiers at ``depth``; ``level`` keeps those of the powers of two."""
    at, have = 1, None
    out, done = None, 0
    for bit in reversed(range(depth.bit_length())):
        size = 1 << bit
        if not depth & size:
            continue
        at = 1
        while at < size:
            if 2 * at not in level:
                h = level[at]
                level[2 * at] = K.pair(h[:-at], h[at:]) if len(h) > at else h[:0]
            at *= 2
        have = level[size]
        out = have if out is None else K.pair(out[: max(0, len(have) - done)], have[done:])
        done += size
    return out


def _windows(b: np.ndarray, off: np.ndarray, length: int, q: int):
    """(first token of each document, window starts, their anchors, q-gram and window identifiers)."""
    s, e, first = K.tokens(b, off, K.NOT_SPACE)
    level = {1: K.token_hash(b, s, e)}
    n = len(s)
    if n < length:
        return first, np.empty(0, np.int64), np.empty(0, np.int64), level, None
    grams = _deeper(level, q)
    value, where = grams, np.arange(len(grams))
    width, need = 1, length - q + 1
    while width < need:
        step = min(width, need - width)
        v, w = value[step:], where[step:]
        left, lw = value[: len(v)], where[: len(v)]
        less = v < left
        value, where = np.where(less, v, left), np.where(less, w, lw)
        width += step
    end = np.repeat(first[1:], np.diff(first))[: len(where)]
    p = np.flatnonzero(np.arange(len(where)) + length <= end)
    return first, p, where[p], level, grams


def _anchors(length: int, q: int):
    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            buf, off = K.utf8(batch.column("text"))
            for i, j in K.runs(off):
                first, _, anchor, _, grams = _windows(buf[off[i] : off[j]], off[i : j + 1] - off[i], length, q)
                if not len(anchor):
                    continue
                a = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
                doc = np.searchsorted(first, a, "right") - 1
                ids = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[a].view(np.int64)),
                        batch.column("id").take(ids),
                        batch.column("th").take(ids),
                        pa.array((a - first[doc]).astype(np.int32)),
                    ],
                    names=["gram", "id", "th", "at"],
                )

    return run


def _filed(length: int, q: int):
    """(id, th, text, at[]) → (gram, id, th, start, windows): identifiers of the windows filed under each anchor."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            buf, off = K.utf8(batch.column("text"))
            at = batch.column("at")
            for i, j in K.runs(off):
                first, p, anchor, level, grams = _windows(buf[off[i] : off[j]], off[i : j + 1] - off[i], length, q)
                if not len(p):
                    continue
                part = at.slice(i, j - i)
                shared = np.zeros(len(grams), bool)
                n = part.value_lengths().to_numpy(zero_copy_only=False)
                shared[part.flatten().to_numpy() + np.repeat(first[:-1], n)] = True
                full = _deeper(level, length)
                keep = shared[anchor]
                p, anchor = p[keep], anchor[keep]
                if not len(p):
                    continue
                cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                a = anchor[cuts]
                doc = np.searchsorted(first, a, "right") - 1
                ids = pa.array(doc + i)
                data = np.ascontiguousarray(full[p])
                offsets = (np.r_[cuts, len(p)] * 8).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[a].view(np.int64)),
                        batch.column("id").take(ids),
                        batch.column("th").take(ids),
                        pa.array((p[cuts] - first[doc]).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]),
                    ],
                    names=["gram", "id", "th", "start", "windows"],
                )

    return run


def _later(length: int):
    """Rows sorted by (gram, id, th, start) → intervals of windows that are not the first of their kind."""

    def run(batches):
        np.seterr(over="ignore")
        seen, owner, seen_gram, last = np.empty(0, np.uint64), np.empty(0, np.int64), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            null_id = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy().copy()
            ids[null_id] = _NULL
            th, start = batch.column("th").to_numpy(), batch.column("start").to_numpy()
            row = np.stack([gram, ids, th, start.astype(np.int64)], 1)
            again = np.r_[last is not None and bool((row[0] == last).all()), (row[1:] == row[:-1]).all(1)]
            last = row[-1]
            win = batch.column("windows")
            if not pa.types.is_large_binary(win.type):
                win = win.cast(pa.large_binary())
            _, o, data = win.buffers()
            o = np.frombuffer(o, np.int64)[win.offset : win.offset + len(win) + 1]
            w = np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(np.uint64)
            n = np.diff(o) // 8
            r = np.repeat(np.arange(len(n)), n)
            p = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + start[r]
            use = ~again[r]
            w, r, p = w[use], r[use], p[use]
            name = K.pair(gram.view(np.uint64)[r], w)
            if seen_gram != gram[0]:
                seen, owner = seen[:0], owner[:0]
            every, who = np.r_[seen, name], np.r_[owner, ids[r]]
            _, at, back = np.unique(every, return_index=True, return_inverse=True)
            first = at[back]
            m = len(seen)
            late = first[m:] != np.arange(m, len(every))
            origin = who[first[m:]]
            ending = gram[-1]
            tail = np.r_[np.full(m, seen_gram == ending), gram[r] == ending]
            new = np.zeros(len(every), bool)
            new[at] = True
            seen, owner, seen_gram = every[new & tail], who[new & tail], ending
            r, p, origin = r[late], p[late], origin[late]
            if not len(r):
                continue
            cuts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)])
            ends = np.r_[cuts[1:], len(r)] - 1
            least = np.minimum.reduceat(origin, cuts)
            k = pa.array(r[cuts])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(k),
                    batch.column("th").take(k),
                    pa.array(p[cuts].astype(np.int32)),
                    pa.array((p[ends] + length).astype(np.int32)),
                    pa.array(least, mask=least == _NULL),
                ],
                names=["id", "th", "start", "end", "first_id"],
            )

    return run


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q) -> DataFrame:
    """(id, th, start, end, first_id): maximal runs of repeated words, end exclusive.

    ``first_id`` is the least id among the first occurrences of the run's windows.
    """
    q = min(q, length)
    rows = identified(docs, id_col, text_col)
    bucket = Window.partitionBy("gram")
    who = F.struct("id", "th", "at")
    shared = (
        rows.mapInArrow(_anchors(length, q), "gram long, id long, th long, at int")
        .withColumns({"lo": F.min(who).over(bucket), "hi": F.max(who).over(bucket)})
        .where("not (lo <=> hi)")
        .groupBy(F.coalesce("id", F.lit(0)).alias(KEY), F.col("th").alias(TH))
        .agg(F.collect_set("at").alias("at"))
    )
    filed = (
        rows.withColumns({KEY: F.coalesce("id", F.lit(0)), TH: F.col("th")})
        .join(shared, [KEY, TH])
        .select("id", "th", "text", "at")
        .mapInArrow(_filed(length, q), "gram long, id long, th long, start int, windows binary")
    )
    late = (
        filed.repartition("gram")
        .sortWithinPartitions("gram", F.col("id").asc_nulls_last(), "th", "start")
        .mapInArrow(_later(length), "id long, th long, start int, end int, first_id long")
    )
    doc = Window.partitionBy(F.coalesce("id", F.lit(0)), "th").orderBy("start", "end")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    return (
        late.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(F.coalesce("id", F.lit(0)).alias("key"), "th", "run")
        .agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_id").alias("first_id"))
        .select("id", "th", "start", "end", "first_id")
    )


def repeats(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id) of every repeated passage but its first occurrence."""
    return spans(docs, **how).select(
        F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("first_id").alias("first_doc_id")
    )


def _without(text: str, starts, ends) -> str:
    b = text.encode()
    s, _, _ = K.tokens(np.frombuffer(b, np.uint8), np.array([0, len(b)]), K.NOT_SPACE)
    s = np.r_[s, len(b)]
    out, at = [], 0
    for x, y in sorted(zip(starts, ends)):
        out.append(b[at : s[x]])
        at = s[y]
    out.append(b[at:])
    left = b"".join(out).decode()
    return left if left.strip(" \t\n\r\v\f") else ""


@F.pandas_udf(T.StringType())
def _remove(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _without(t, x, y) for t, x, y in zip(text, starts, ends)], dtype=object)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the repeated words; rows repeated in full are one.

    A document of which nothing is left goes; one that was null or empty stays.
    White space after a removed word goes with it.
    """
    found = (
        spans(docs, id_col, text_col, **how)
        .groupBy(F.coalesce("id", F.lit(0)).alias(KEY), F.col("th").alias(TH))
        .agg(F.collect_list(F.struct("start", "end")).alias("__siftline_spans"))
    )
    found = cut(found, "spans")
    release(docs.sparkSession)
    sp = F.col("__siftline_spans")
    cleaned = _remove(F.when(sp.isNotNull(), F.col(f"`{text_col}`")), sp.getField("start"), sp.getField("end"))
    return (
        keyed(docs, id_col, text_col)
        .join(found, [KEY, TH], "left")
        .dropDuplicates([KEY, TH])
        .withColumn(text_col, F.when(sp.isNull(), F.col(f"`{text_col}`")).otherwise(cleaned))
        .where(sp.isNull() | (F.col(f"`{text_col}`") != ""))
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )
