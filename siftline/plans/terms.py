"""Counts of hashed terms, as sorted files in the shared folder that workers map.

Terms are 64-bit hashes, so no text is shuffled; two of ten million terms share
a hash with a probability of three in a million.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.scratch import new_folder


def hashes(terms: Column) -> Column:
    """Array of terms → array of their hashes; a null term has a hash, a null array none."""
    return F.transform(terms, lambda x: F.xxhash64(x))


def save(path: str, x: np.ndarray) -> None:
    """Whole or not at all; a task that runs again writes the same."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.save(f, x)
    os.replace(tmp, f"{path}.npy")


def store(terms: DataFrame, also: list[int] = ()) -> str:
    """``terms(term)``, a row a document that has it → folder of the terms of more than one document, and those of ``also``."""
    folder = new_folder(terms.sparkSession, "terms")

    def write(key, pdf):
        pdf = pdf.sort_values("term")
        save(f"{folder}/{key[0]}.term", pdf["term"].to_numpy(np.int64))
        save(f"{folder}/{key[0]}.n", pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"part": [key[0]]})

    n = terms.groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("term").isin(list(also)))
    n.groupBy(F.shiftright("term", 58).cast("int").alias("part")).applyInPandas(write, "part int").collect()  # 64 rows at most
    return folder


class Counts:
    """Counts of terms in a folder of :func:`store`; those that aren't there have one document."""

    def __init__(self, folder: str):
        self.folder, self.parts = folder, {}

    def _part(self, p: int):
        if p not in self.parts:
            at = f"{self.folder}/{p}"
            self.parts[p] = tuple(np.load(f"{at}.{x}.npy", mmap_mode="r") for x in ("term", "n")) if os.path.exists(f"{at}.n.npy") else None
        return self.parts[p]

    def __call__(self, terms: np.ndarray, absent: int = 1) -> np.ndarray:
        u, back = np.unique(terms, return_inverse=True)
        out = np.full(len(u), absent, np.int64)
        edges = np.searchsorted(u >> 58, np.arange(-32, 33))
        for p, a, b in zip(range(-32, 32), edges[:-1], edges[1:]):
            if a < b and (part := self._part(p)) is not None:
                at = np.minimum(np.searchsorted(part[0], u[a:b]), len(part[0]) - 1)
                out[a:b] = np.where(part[0][at] == u[a:b], part[1][at], absent)
        return out[back]
