"""Exact top-k search by Fagin's threshold algorithm over sorted lists.

Vectors are normalised and laid out in shards. A shard holds its vectors and,
for each dimension, the list of its vectors sorted by that coordinate; the files
lie in the shared folder and workers map them into memory. For a query, a
dimension's list is read from the top where the query's coordinate is positive
and from the bottom where it is negative. After depth t no unseen vector can
score more than the sum over dimensions of query coordinate times list value at
t. Once that bound is below the query's k-th score, the lists are read no
further; at depth 0 the shard is not opened at all.

A task answers one shard's vectors as queries: first among themselves, then
against the other shards in order of their bounds, so the k-th score is high
early. Queries whose bound falls early score just the vectors seen; those that
have to read so deep that the lists cover the shard score all of it at once, in
single precision first, and in double precision what comes within its rounding
of their k-th score.

Cases: a null vector, one with a null, NaN or infinite coordinate, of length 0
or of another length than most rows have, is neither query nor result. Rows
that agree in id and vector are one; other rows of the same id are vectors of
their own; ids may be null. Scores are cosines, compared at nine digits; ties
go to the lesser id (null last). Fewer than k others: all are returned.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.ngram_lm import local_path
from siftline.plans.scratch import cut, new_path

KTOP, SHARD = 10, 1024
_DIGITS = 10**9
_NULL = np.iinfo(np.int64).max
#: Twice the rounding of single precision; of a product of unit vectors, d + 2 roundings at most.
_ROUNDED = 2.0**-23


def _save(path: str, x: np.ndarray) -> None:
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.save(f, x)
    os.replace(tmp, f"{path}.npy")


def _build(folder: str):
    """A partition's vectors → shard files, one row (shard, n, box) each."""

    def flush(part: int, k: int, rows: pd.DataFrame):
        ids = np.array([_NULL if v is None or v != v else int(v) for v in rows["id"].astype(object)], np.int64)
        x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        x /= np.sqrt((x * x).sum(1))[:, None]
        lists = np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)
        name = part * 1_000_000 + k
        for what, a in (("ids", ids), ("x", x), ("lists", lists)):
            _save(f"{folder}/{name}.{what}", np.ascontiguousarray(a))
        return {"shard": name, "n": len(ids), "hi": x.max(0), "lo": x.min(0)}

    def run(batches):
        held, k = [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["part"].iloc[0])
            held.append(pdf)
            while sum(map(len, held)) >= SHARD:
                rows = pd.concat(held, ignore_index=True)
                yield pd.DataFrame([flush(part, k, rows[:SHARD])])
                held, k = [rows[SHARD:]], k + 1
        if sum(map(len, held)):
            yield pd.DataFrame([flush(part, k, pd.concat(held, ignore_index=True))])

    return run


def _read(folder: str, shard: int):
    return tuple(np.load(f"{folder}/{shard}.{x}.npy", mmap_mode="r") for x in ("ids", "x", "lists"))


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest integers of each row, in no order."""
    if keys.shape[1] <= k:
        return np.tile(np.arange(keys.shape[1]), (len(keys), 1))
    return np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]


class _Top:
    """Current best (score, id, shard, position) of each query."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -(2**62), np.int64)
        self.id = np.full((n, k), _NULL, np.int64)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add_some(self, rows: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of row ``rows[i]`` and an id, sorted by i."""
        good = score >= self.kth()[rows[i]]
        i, score, ids = i[good], score[good], ids[good]
        if not len(i):
            return
        hit, first, count = np.unique(i, return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(hit)), count), np.arange(len(i)) - np.repeat(first, count)
        s = np.full((len(hit), int(count.max())), -(2**62), np.int64)
        v = np.full(s.shape, _NULL, np.int64)
        s[at], v[at] = score, ids
        self.add(rows[hit], s, v)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.id[rows], ids], 1)
        o = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of the pairs (query, vector)."""
    out, step = np.empty(len(i), np.int64), max(1, (1 << 20) // x.shape[1])
    for at in range(0, len(i), step):
        s = slice(at, at + step)
        out[s] = np.rint(np.einsum("ij,ij->i", q[i[s]], x[c[s]]) * _DIGITS)
    return out


def search_shard(q: np.ndarray, top: _Top, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, rows: np.ndarray, own: bool = False) -> None:
    """Threshold algorithm of the queries ``rows`` over one shard; ``own``: query r is the shard's r-th vector."""
    n, d = x.shape
    x, lists = np.asarray(x), np.asarray(lists)
    grid = np.unique(np.minimum(n - 1, np.r_[0, 2 ** np.arange(0, max(1, n.bit_length()))]))
    down = np.take_along_axis(x.T, lists[:, grid].astype(np.int64), 1)
    up = np.take_along_axis(x.T, lists[:, n - 1 - grid].astype(np.int64), 1)
    qr = q[rows]
    bound = np.maximum(qr, 0) @ down + np.minimum(qr, 0) @ up
    over = np.floor((bound + 1e-11) * _DIGITS) >= top.kth()[rows][:, None]
    depth = np.where(over.all(1), len(grid), over.argmin(1))  # grid step at which the bound is below the k-th score
    reach = np.r_[grid, n][depth]
    deep = reach * d >= n
    alone = np.arange(n)
    for r, t in zip(rows[(depth > 0) & ~deep], reach[(depth > 0) & ~deep]):
        seen = np.unique(np.where((q[r] > 0)[:, None], lists[:, :t], lists[:, n - t :]))
        score = np.rint((x[seen] @ q[r]) * _DIGITS).astype(np.int64)
        if own:
            score[seen == r] = -(2**62)
        top.add(np.array([r]), score[None], np.where(score == -(2**62), _NULL, ids[seen])[None])
    left = rows[(depth > 0) & deep]
    short = x.astype(np.float32)
    for at in range(0, len(left), 512):
        r = left[at : at + 512]
        if not own:
            near = q[r].astype(np.float32) @ short.T
            least = np.nextafter((top.kth()[r] / _DIGITS - (d + 8) * _ROUNDED).astype(np.float32), np.float32(-np.inf))
            i, c = np.divmod(np.flatnonzero(near >= least[:, None]), n)
            if len(i) <= near.size // 16:
                top.add_some(r, i, _scores(q, x, r[i], c), ids[c])
                continue
        score = np.rint((q[r] @ x.T) * _DIGITS).astype(np.int64)
        if own:
            score[np.arange(len(r)), r] = -(2**40)
        best = _best(score * n + (n - 1 - alone), top.k)
        s = np.take_along_axis(score, best, 1)
        top.add(r, np.where(s == -(2**40), -(2**62), s), np.where(s == -(2**40), _NULL, ids[best]))


def _search(folder: str, boxes: str, k: int):
    def run(batches):
        shards, hi, lo = (np.load(f"{boxes}.{x}.npy", mmap_mode="r") for x in ("shards", "hi", "lo"))
        for pdf in batches:
            for shard in pdf["shard"]:
                ids, q, lists = _read(folder, int(shard))
                ids, q = np.asarray(ids), np.asarray(q)
                top = _Top(len(q), k)
                search_shard(q, top, ids, q, lists, np.arange(len(q)), own=True)
                most = np.full(len(shards), -np.inf)
                for at in range(0, len(shards), 4096):
                    b = np.maximum(q, 0) @ hi[at : at + 4096].T + np.minimum(q, 0) @ lo[at : at + 4096].T
                    most[at : at + 4096] = b.max(0)
                for s in np.argsort(-most, kind="stable"):
                    if shards[s] == shard:
                        continue
                    b = np.maximum(q, 0) @ hi[s] + np.minimum(q, 0) @ lo[s]
                    rows = np.flatnonzero(np.floor((b + 1e-11) * _DIGITS) >= top.kth())
                    if len(rows):
                        search_shard(q, top, *_read(folder, int(shards[s])), rows)
                r, c = np.nonzero(top.score > -(2**62))
                who = pd.array(ids[r], dtype="Int64")
                who[ids[r] == _NULL] = pd.NA
                what = pd.array(top.id[r, c], dtype="Int64")
                what[top.id[r, c] == _NULL] = pd.NA
                yield pd.DataFrame({"query_id": who, "rank": (c + 1).astype(np.int32), "vec_id": what, "score": top.score[r, c] / _DIGITS})

    return run


def top_k(vectors: DataFrame, k: int = KTOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest cosines of every row with other rows."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
        .where(F.col("v").isNotNull() & (F.size("v") > 0))
        .where(~bad)
        .where((norm > 0) & (norm < float("inf")))
        .dropDuplicates(["id", "v"])
    )
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head(1)
    if not sizes:
        return spark.createDataFrame([], out)
    d, n = sizes[0]
    rng = np.random.default_rng(3)
    planes = rng.normal(size=(16, d)).round(6).tolist()
    code = F.lit(0)
    for p in planes:  # near vectors share leading sides of random planes, which makes a shard's lists short
        dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, p)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        code = code * 2 + (dot > 0).cast("int")
    folder = local_path(new_path(spark, "topk"))
    os.makedirs(folder, exist_ok=True)
    parts = max(1, -(-n // (8 * SHARD)))
    built = (
        rows.where(F.size("v") == d)
        .withColumn("code", code)
        .repartitionByRange(parts, "code", "id")
        .sortWithinPartitions("code", "id")
        .select("id", "v", F.spark_partition_id().alias("part"))
        .mapInPandas(_build(folder), "shard long, n long, hi array<double>, lo array<double>")
    )
    shards = cut(built, "shards").orderBy("shard").collect()  # one row for 1024 vectors
    boxes = f"{folder}/boxes"
    _save(f"{boxes}.shards", np.array([r.shard for r in shards], np.int64))
    _save(f"{boxes}.hi", np.array([r.hi for r in shards]))
    _save(f"{boxes}.lo", np.array([r.lo for r in shards]))
    todo = spark.createDataFrame([(r.shard,) for r in shards], "shard long").repartition(len(shards), "shard")
    return todo.mapInPandas(_search(folder, boxes, k), out)


SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 9) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {KTOP}
"""
