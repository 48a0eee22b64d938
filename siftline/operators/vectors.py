"""Exact vector search over a table of (id, embedding)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.plans.best import ROWS, Best, blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; null when the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


_METRICS = {"cosine": cosine, "dot": dot, "euclid": euclid}


def top_k(
    vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", where: Column | None = None, threshold: float | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, score) of the best k; ``where`` filters before, ``threshold`` bounds the score."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors if where is None else vectors.where(where)
    out = rows.withColumn("score", _METRICS[metric](F.col(vector_col), q))
    if threshold is not None:
        out = out.where(F.col("score") <= threshold if metric == "euclid" else F.col("score") >= threshold)
    by = F.asc("score") if metric == "euclid" else F.desc("score")
    return out.orderBy(by, id_col).limit(k).select(id_col, "score")


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot product of each row, added up in order, as :func:`dot` does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _batch(files: list[str], k: int, threshold: float, id_col: str):
    def run(batches):
        held = []
        for f in files:
            pdf = pd.read_pickle(f)
            for d, part in pdf.groupby(pdf["v"].map(len)):
                x = np.array(part["v"].tolist(), np.float64).reshape(len(part), d)
                held.append((d, x, np.sqrt(_in_turn(x, x)), Best(part["id"].to_numpy(), k)))
        for pdf in batches:
            for d, part in pdf.groupby(pdf["v"].map(len)):
                for at in range(0, len(part), ROWS):
                    x = np.array(part["v"].iloc[at : at + ROWS].tolist(), np.float64).reshape(-1, d)
                    ids, n = part["id"].to_numpy()[at : at + ROWS], np.sqrt(_in_turn(x, x))
                    for _, q, m, best in (h for h in held if h[0] == d):
                        with np.errstate(all="ignore"):
                            s, of = x @ q.T, n[:, None] * m
                            s = np.where(of == 0, 0.0, s / of)
                            s[s < threshold - 1e-9] = -np.inf
                            i, j = best.candidates(s, 1e-9)
                            i, j = (y[s[i, j] != -np.inf] for y in (i, j))
                            of = n[i] * m[j]
                            v = np.where(of == 0, 0.0, _in_turn(x[i], q[j]) / of)
                        ok = ~(v < threshold)
                        best.add(j[ok], ids[i[ok]], np.where(np.isnan(v), np.inf, v)[ok], v[ok])
        for h in held:
            if (got := h[3].found(id_col)) is not None:
                yield got

    return run


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for every row of ``queries``; a query's own id is left out.

    Every vector is compared with every query, in matrix products; a task reads
    the queries from the shared folder and keeps the best k a query. What comes
    near a query's k-th score is scored again coordinate by coordinate.
    """
    x = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda y: y.isNull()))
    kind = vectors.schema[id_col].dataType.simpleString()
    _, files = blocks(x(queries), "id")
    s = x(vectors).mapInPandas(_batch(files, k, threshold, id_col), f"query_id {kind}, `{id_col}` {kind}, score double")
    s = s.withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # pandas hands NaN over as null
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(results: DataFrame) -> DataFrame:
    """Adds the reranked score: base, quality, middling complexity, exact and name hits, mean similarity to the others."""
    s = (
        F.col("score")
        + 0.2 * F.col("quality")
        + 0.1 * (1 - 2 * F.abs(F.col("complexity") - 0.5))
        + F.when(F.col("exact"), 0.3).otherwise(0.0)
        + F.when(F.col("name_hit"), 0.2).otherwise(0.0)
        + 0.15 * F.col("cross_similarity")
    )
    return results.withColumn("reranked", s)


def without_orphans(vectors: DataFrame, files: DataFrame, path_col: str) -> DataFrame:
    return vectors.join(files.select(path_col).distinct(), path_col, "left_semi")


def collection_stats(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    return vectors.groupBy(by).agg(F.count("*").alias("n"), F.max(F.size(vector_col)).cast("long").alias("dims"), F.avg(norm(F.col(vector_col))).alias("mean_norm"))
